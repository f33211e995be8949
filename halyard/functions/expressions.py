"""Column expressions of the job scripts and helpers. All stay inside Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid and box of the coordinate transforms, the sentinel, and the driving signals' names.
AXIS, ECCENTRICITY = 6378245.0, 0.00669342162296594323
BOX = {"lng": (72.004, 137.8347), "lat": (0.8293, 55.8271)}
SENTINEL = -99999
SIGNALS = ("brake", "hard_to", "unsafe_follow", "force_to_quit")

BD_ANGLE = math.pi * 3000.0 / 180.0


def sentinel(value: Column, kind: str = "bigint", missing: int = SENTINEL, strict_empty: bool = True) -> Column:
    """value cast to kind; null becomes `missing`. Empty text does too, or, with strict_empty=False (the scripts' own OR), stays null. Other text that is no number is null."""
    absent = value.isNull() | (value == "") if strict_empty else value.isNull()
    return F.when(absent, F.lit(missing).cast(kind)).otherwise(value.try_cast(kind))


def epoch_ms_to_timestamp(value: Column) -> Column:
    """Epoch milliseconds, as text or number, to a timestamp without zone in the session's zone, whole seconds."""
    seconds = F.floor(value.cast("bigint") / F.lit(1000)).cast("bigint")
    return F.to_timestamp_ntz(F.from_unixtime(seconds))


def partition_day(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def default_day(value: Column, missing: str = "9999-99-99") -> Column:
    """The day of a timestamp written as text; null and empty become `missing`, junk null."""
    return F.when(value.isNotNull() & (value != ""), F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd")).otherwise(F.lit(missing))


def row_key(*parts: Column, separator: str = "&") -> Column:
    """Parts joined; nulls are skipped."""
    return F.concat_ws(separator, *[p.cast("string") for p in parts])


def masked(value: Column, salt: str) -> Column:
    """MD5 of value and a salt; null stays null."""
    return F.md5(F.concat(value.cast("string"), F.lit(salt)))


def to_degrees(degrees: Column, minutes: Column, seconds: Column) -> Column:
    """Degrees, minutes and seconds as a decimal; the sign of degrees is dropped."""
    return (minutes + seconds / F.lit(60.0)) / F.lit(60.0) + F.abs(degrees)


def is_scientific(value: Column) -> Column:
    return value.rlike(r"^[-+]?\d+(\.\d+)?[eE][-+]?\d+$")


def in_box(lng: Column, lat: Column) -> Column:
    return lng.between(*BOX["lng"]) & lat.between(*BOX["lat"])


def _waves(lng: Column, lat: Column, base: list[tuple[Column, float]], first: Column, second: Column, terms: list[tuple[float, float]]) -> Column:
    out = F.lit(0.0)
    for column, factor in base:
        out = out + column * F.lit(factor)
    out = out + first
    out = out + (F.lit(20.0) * F.sin(F.lit(6.0) * lng * F.lit(math.pi)) + F.lit(20.0) * F.sin(F.lit(2.0) * lng * F.lit(math.pi))) * F.lit(2.0) / F.lit(3.0)
    pairs = [(F.lit(big) * F.sin(second * F.lit(math.pi) / F.lit(by))) for big, by in terms]
    out = out + (pairs[0] + pairs[1]) * F.lit(2.0) / F.lit(3.0)
    return out + (pairs[2] + pairs[3]) * F.lit(2.0) / F.lit(3.0)


def _shift(lng: Column, lat: Column) -> tuple[Column, Column]:
    """How far the survey grid moves a point."""
    x, y = lng - F.lit(105.0), lat - F.lit(35.0)
    d_lat = _waves(x, y, [(x, 2.0), (y, 3.0)], F.lit(-100.0) + F.lit(0.2) * y * y + F.lit(0.1) * x * y + F.lit(0.2) * F.sqrt(F.abs(x)), y, [(20.0, 1.0), (40.0, 3.0), (160.0, 12.0), (320.0, 30.0)])
    d_lng = _waves(x, y, [(x, 1.0), (y, 2.0)], F.lit(300.0) + F.lit(0.1) * x * x + F.lit(0.1) * x * y + F.lit(0.1) * F.sqrt(F.abs(x)), x, [(20.0, 1.0), (40.0, 3.0), (150.0, 12.0), (300.0, 30.0)])
    angle = lat / F.lit(180.0) * F.lit(math.pi)
    magic = F.lit(1.0) - F.lit(ECCENTRICITY) * F.sin(angle) * F.sin(angle)
    root = F.sqrt(magic)
    d_lat = d_lat * F.lit(180.0) / (F.lit(AXIS * (1 - ECCENTRICITY)) / (magic * root) * F.lit(math.pi))
    d_lng = d_lng * F.lit(180.0) / (F.lit(AXIS) / root * F.cos(angle) * F.lit(math.pi))
    return d_lng, d_lat


def wgs84_to_gcj02(lng: Column, lat: Column, check_box: bool = True) -> tuple[Column, Column]:
    """Points outside the box stay as they are, unless check_box is off."""
    d_lng, d_lat = _shift(lng, lat)
    if not check_box:
        return lng + d_lng, lat + d_lat
    inside = in_box(lng, lat)
    return F.when(inside, lng + d_lng).otherwise(lng), F.when(inside, lat + d_lat).otherwise(lat)


def gcj02_to_wgs84(lng: Column, lat: Column, check_box: bool = True) -> tuple[Column, Column]:
    """The inverse to first order: twice the point less its image."""
    x, y = wgs84_to_gcj02(lng, lat, check_box)
    return lng * F.lit(2.0) - x, lat * F.lit(2.0) - y


def gcj02_to_bd09(lng: Column, lat: Column, angle: float = BD_ANGLE) -> tuple[Column, Column]:
    z = F.sqrt(lng * lng + lat * lat) + F.lit(0.00002) * F.sin(lat * F.lit(angle))
    theta = F.atan2(lat, lng) + F.lit(0.000003) * F.cos(lng * F.lit(angle))
    return z * F.cos(theta) + F.lit(0.0065), z * F.sin(theta) + F.lit(0.006)


def bd09_to_gcj02(lng: Column, lat: Column, angle: float = BD_ANGLE) -> tuple[Column, Column]:
    x, y = lng - F.lit(0.0065), lat - F.lit(0.006)
    z = F.sqrt(x * x + y * y) - F.lit(0.00002) * F.sin(y * F.lit(angle))
    theta = F.atan2(y, x) - F.lit(0.000003) * F.cos(x * F.lit(angle))
    return z * F.cos(theta), z * F.sin(theta)


def wgs84_to_bd09(lng: Column, lat: Column) -> tuple[Column, Column]:
    return gcj02_to_bd09(*wgs84_to_gcj02(lng, lat))


def bd09_to_wgs84(lng: Column, lat: Column) -> tuple[Column, Column]:
    return gcj02_to_wgs84(*bd09_to_gcj02(lng, lat))


SYSTEMS = {"wgs84": "wgs84", "gcj02": "gcj02", "gaode": "gcj02", "bd09": "bd09", "baidu": "bd09"}


def convert_coordinates(to: str, origin: str, lng: Column, lat: Column) -> tuple[Column, Column]:
    """(lng, lat) from one system to another; equal systems change nothing."""
    a, b = SYSTEMS[origin.lower()], SYSTEMS[to.lower()]
    if a == b:
        return lng, lat
    return globals()[f"{a}_to_{b}"](lng, lat)


def bit_set(x: Column, n: int) -> Column:
    return x.bitwiseOR(F.lit(1 << n))


def bit_clear(x: Column, n: int) -> Column:
    return x.bitwiseAND(F.lit(~(1 << n)))


def bit_toggle(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.lit(1 << n))


def bit_test(x: Column, n: int) -> Column:
    return x.bitwiseAND(F.lit(1 << n)) != 0


def map_to_string(m: Column) -> Column:
    """k=v pairs joined by commas, in the map's order; null values read null, a null map is empty."""
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    return F.coalesce(F.array_join(pairs, ","), F.lit(""))


def special_parts(s: Column) -> Column:
    """An array of (type, value) structs: the comma-separated parts by position, four at most; trailing empty parts are dropped. Explode it with inline()."""
    parts = F.slice(F.split(F.regexp_replace(s, ",+$", ""), ","), 1, len(SIGNALS))
    kinds = F.array(*map(F.lit, SIGNALS))
    return F.transform(parts, lambda v, i: F.struct(F.element_at(kinds, i + 1).alias("type"), v.alias("value")))


def factor(values: Column | None = None, by: int = 2020) -> Column:
    """`by`, times all numbers of an array if there is one, with 32-bit overflow wrapped."""
    if values is None:
        return F.lit(by)
    wrapped = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    product = F.aggregate(values, F.lit(1).cast("bigint"), lambda a, x: wrapped(a * x.cast("bigint")))
    return wrapped(product * F.lit(by)).cast("int")


def epoch_seconds(s: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "+08:00") -> Column:
    """Seconds since 1970 of a local time written as text."""
    return F.unix_seconds(F.to_utc_timestamp(F.to_timestamp_ntz(s, F.lit(pattern)).cast("timestamp"), zone))


def local_time(s: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.to_timestamp_ntz(s, F.lit(pattern))


def format_epoch_ms(ms: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_millis(ms), pattern)


def fixed_six(x: Column) -> Column:
    return F.format_string("%.6f", x)


def json_string(value: Column, key: str) -> Column:
    return F.get_json_object(value, f"$.{key}")


def json_double(value: Column, key: str) -> Column:
    """The number under key; 0 where it is missing."""
    return F.coalesce(F.get_json_object(value, f"$.{key}").try_cast("double"), F.lit(0.0))


def words_by_space(line: Column) -> Column:
    """Parts between single spaces; inner empty ones stay, trailing ones go."""
    return F.split(F.regexp_replace(line, " +$", ""), " ")


def word_tokens(line: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.filter(F.split(F.lower(line), r"\W+"), lambda w: w != "")
