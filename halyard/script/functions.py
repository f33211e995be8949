"""Built-in functions of the scripts' dialect whose names, arguments, defaults or null rules aren't Spark's, as Spark SQL.

Functions that mean the same in both are left to Spark and aren't listed. Backslashes in literals are Spark's: a pattern's are written twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from halyard.script.tokens import Token, unquoted

#: How a parameter's kind is written: `any` as it stands, `whole` as a number, `time` as a time without zone, null where text holds none.
_KINDS = {"any": "{}", "whole": "CAST({} AS BIGINT)", "time": "try_cast({} AS TIMESTAMP_NTZ)"}
_STAMP = "'yyyy-MM-dd HH:mm:ss'"
_UNIT = {"SECOND": "INTERVAL '1' SECOND", "MINUTE": "INTERVAL '1' MINUTE", "HOUR": "INTERVAL '1' HOUR", "DAY": "INTERVAL '1' DAY", "WEEK": "INTERVAL '7' DAY"}
_MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str
    default: str | None = None


@dataclass(frozen=True)
class Function:
    """body: Spark SQL with {parameter}; {args} are all arguments, {known} says that none of them is null. rest: the last parameter repeats."""

    group: str
    parameters: tuple[Parameter, ...]
    body: str
    rest: bool = False

    def call(self, args: list[str]) -> str | None:
        """The call in Spark SQL; None if the function doesn't take so many arguments, which is left to Spark."""
        least = sum(p.default is None for p in self.parameters)
        if len(args) < least or len(args) > len(self.parameters) and not self.rest:
            return None
        values = {p.name: _KINDS[p.kind].format(args[k] if k < len(args) else p.default) for k, p in enumerate(self.parameters)}
        return self.body.format(args=", ".join(args), known=" AND ".join(f"({a}) IS NOT NULL" for a in args), **values)


def _function(group: str, signature: str, body: str) -> Function:
    """signature: `name kind [= default]`, comma-separated; three dots behind the last repeat it."""
    rest = signature.endswith("...")
    parameters = []
    for part in signature.removesuffix("...").split("; ") if signature else []:
        head, _, default = part.partition(" = ")
        parameters.append(Parameter(*head.split(), default or None))
    return Function(group, tuple(parameters), body, rest)


_PAIR = "split(e, {pair}, 2)"

FUNCTIONS = {
    # Text. SPLIT_INDEX counts from 0, takes the mark literally and is null outside; a pattern's whole match is group 0, and no match is null.
    "SPLIT_INDEX": _function("text", "s any; mark any; at whole", "(CASE WHEN {at} >= 0 AND {at} < ifnull((length({s}) - length(replace({s}, {mark}, ''))) div nullif(length({mark}), 0), 0) + 1 AND {s} <> '' THEN split_part({s}, {mark}, CAST({at} + 1 AS INT)) END)"),
    "REGEXP_EXTRACT": _function("text", "s any; pattern any; at any = 0", "(CASE WHEN {s} RLIKE {pattern} THEN regexp_extract({s}, {pattern}, {at}) END)"),
    "STR_TO_MAP": _function("text", "s any; entry any = ','; pair any = '='", f"aggregate(split({{s}}, {{entry}}), CAST(map() AS MAP<STRING, STRING>), (m, e) -> map_concat(map_filter(m, (k, v) -> k <> get({_PAIR}, 0)), map(get({_PAIR}, 0), get({_PAIR}, 1))))"),
    "IS_DIGIT": _function("text", "s any", "ifnull(CAST({s} AS STRING) RLIKE R'\\A\\p{{Nd}}+\\z', false)"),
    "IS_ALPHA": _function("text", "s any", "ifnull(CAST({s} AS STRING) RLIKE R'\\A\\p{{L}}+\\z', false)"),
    "IS_DECIMAL": _function("text", "s any", "(try_cast({s} AS DOUBLE) IS NOT NULL)"),
    "TO_BASE64": _function("text", "s any", "base64(CAST({s} AS BINARY))"),
    "FROM_BASE64": _function("text", "s any", "CAST(unbase64({s}) AS STRING)"),
    "SHA224": _function("text", "s any", "sha2({s}, 224)"),
    "SHA256": _function("text", "s any", "sha2({s}, 256)"),
    "SHA384": _function("text", "s any", "sha2({s}, 384)"),
    "SHA512": _function("text", "s any", "sha2({s}, 512)"),
    "LISTAGG": _function("text", "s any; mark any = ','", "listagg({s}, {mark})"),
    # Numbers. The greatest and the least of arguments with a null are null.
    "GREATEST": _function("number", "x any...", "(CASE WHEN {known} THEN greatest({args}) END)"),
    "LEAST": _function("number", "x any...", "(CASE WHEN {known} THEN least({args}) END)"),
    "TRUNCATE": _function("number", "x any; places any = 0", "(CASE WHEN {x} < 0 THEN ceil({x}, {places}) ELSE floor({x}, {places}) END)"),
    "RAND_INTEGER": _function("number", "n any", "CAST(floor(rand() * ({n})) AS INT)"),
    # Times. Text that is no time gives null; differences are of wall clocks, whole units towards zero.
    "DATE_FORMAT": _function("time", "at time; form any", "date_format({at}, {form})"),
    "UNIX_TIMESTAMP": _function("time", f"s any; form any = {_STAMP}", "unix_timestamp(try_to_timestamp({s}, {form}))"),
    "TO_DATE": _function("time", "s any; form any = 'yyyy-MM-dd'", "try_to_date({s}, {form})"),
    "TO_TIMESTAMP_LTZ": _function("time", "n whole; digits any = 3", "(CASE {digits} WHEN 0 THEN timestamp_seconds({n}) WHEN 3 THEN timestamp_millis({n}) ELSE CAST(raise_error('TO_TIMESTAMP_LTZ takes 0 or 3 digits') AS TIMESTAMP) END)"),
    "CONVERT_TZ": _function("time", "at time; source any; target any", f"date_format(convert_timezone({{source}}, {{target}}, {{at}}), {_STAMP})"),
    "WEEK": _function("time", "day any", "weekofyear({day})"),
    "CURRENT_ROW_TIMESTAMP": _function("time", "", "current_timestamp()"),
    "PROCTIME": _function("time", "", "current_timestamp()"),
    # Arrays, maps and rows. CARDINALITY of null is null; ELEMENT is an array's only one, null of an empty array; a slice has both its ends.
    "CARDINALITY": _function("collection", "a any", "(CASE WHEN {a} IS NOT NULL THEN cardinality({a}) END)"),
    "ELEMENT": _function("collection", "a any", "(CASE WHEN cardinality({a}) > 1 THEN raise_error('ELEMENT of several') ELSE get({a}, 0) END)"),
    "ARRAY_CONCAT": _function("collection", "a any...", "concat({args})"),
    "ARRAY_REVERSE": _function("collection", "a any", "reverse({a})"),
    "ROW": _function("collection", "x any...", "struct({args})"),
}


def _unix(args: list[str]) -> str | None:
    """FROM_UNIXTIME(seconds[, form[, zone]]): the wall clock of a zone, by default the session's. Years beyond 9999 are written without Spark's plus sign."""
    if len(args) not in (1, 2, 3):
        return None
    seconds, form = f"CAST({args[0]} AS BIGINT)", args[1] if len(args) > 1 else _STAMP
    if len(args) == 3:
        at = f"convert_timezone('UTC', {args[2]}, TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(CAST({seconds} div 86400 AS INT), 0, 0, {seconds} % 86400))"
    else:
        at = f"timestamp_seconds({seconds})"
    # Four or five letters ask for the sign, three don't; text between quotes stays.
    plain = f"regexp_replace({form}, R'(?<!y)y{{4,5}}(?!y)(?=[^\\x27]*(\\x27[^\\x27]*\\x27[^\\x27]*)*$)', 'yyy')"
    return f"(CASE WHEN year({at}) > 9999 THEN date_format({at}, {plain}) ELSE date_format({at}, {form}) END)"


def _difference(args: list[str]) -> str | None:
    """TIMESTAMPDIFF(unit, from, to)."""
    if len(args) != 3:
        return None
    unit = args[0].upper().removeprefix("SQL_TSI_")
    first, last = (_KINDS["time"].format(a) for a in args[1:])
    if unit in _UNIT:
        return f"(({last} - {first}) div {_UNIT[unit]})"
    return f"(timestampdiff(MONTH, {first}, {last}) div {_MONTHS[unit]})" if unit in _MONTHS else None


def _slice(args: list[str]) -> str | None:
    """ARRAY_SLICE(array, from[, to]): places count from 1, below 0 from the end; empty where the ends cross."""
    if len(args) not in (2, 3):
        return None
    a, n = args[0], f"cardinality({args[0]})"

    def at(x: str) -> str:
        return f"(CASE WHEN {x} < 0 THEN {n} + {x} + 1 ELSE {x} END)"

    first, last = f"greatest({at(args[1])}, 1)", f"least({at(args[2]) if len(args) == 3 else n}, {n})"
    return f"slice({a}, {first}, greatest({last} - {first} + 1, 0))"


_SHAPED: dict[str, Callable[[list[str]], str | None]] = {"FROM_UNIXTIME": _unix, "TIMESTAMPDIFF": _difference, "ARRAY_SLICE": _slice}


def builtin_call(name: str, args: list[list[Token]], text: Callable[[list[Token]], str]) -> str | None:
    """The call in Spark SQL, or None if Spark has it as it stands. text: writes an argument's tokens in Spark SQL."""
    if name in ("JSON_VALUE", "JSON_QUERY", "JSON_EXISTS"):
        return _json(name, args, text)
    if name in ("FLOOR", "CEIL", "CEILING"):
        return _rounded(name, args, text)
    if name not in FUNCTIONS and name not in _SHAPED:
        return None
    given = [text(a) for a in args]
    if given == [""]:
        given = []
    shaped = _SHAPED[name](given) if name in _SHAPED else None
    return shaped if shaped or name not in FUNCTIONS else FUNCTIONS[name].call(given)


def _rounded(name: str, args: list[list[Token]], text: Callable[[list[Token]], str]) -> str | None:
    """FLOOR(time TO unit) and CEIL(time TO unit)."""
    words = [t for t in args[0] if t[0] != "space"]
    if len(args) != 1 or len(words) < 3 or words[-2][1].upper() != "TO" or words[-1][1].upper() not in (*_UNIT, *_MONTHS):
        return None
    unit = words[-1][1].upper()
    last = max(k for k, t in enumerate(args[0]) if t[1].upper() == "TO")
    at = _KINDS["time"].format(text(args[0][:last]))
    down = f"CAST(date_trunc('{unit}', {at}) AS TIMESTAMP_NTZ)"
    return down if name == "FLOOR" else f"(CASE WHEN {down} = {at} THEN {at} ELSE timestampadd({unit}, 1, {down}) END)"


def _json(name: str, args: list[list[Token]], text: Callable[[list[Token]], str]) -> str | None:
    """JSON_VALUE gives a scalar, JSON_QUERY an object or array, JSON_EXISTS whether there is something at the path.

    A path is strict unless `lax` stands before it. Of JSON_VALUE a null there is empty; text that isn't JSON is an error; a missing or compound value is empty in a
    lax path, else an error. Both give null where nothing else is said. Numbers are in their shortest form; a name twice in one object isn't JSON.
    """
    clauses = [t for t in args[1] if t[0] != "space"] if len(args) == 2 else []
    if not clauses or clauses[0][0] != "string":
        return None
    mode, path = re.match(r"\s*(lax\s|strict\s|)\s*(.*)", unquoted(clauses[0][1]), re.I | re.S).groups()
    path = re.sub(r"\['([^'\"]*)'\]", r'["\1"]', path.replace(".[", "["))
    source = text(args[0])
    whole = f"try_parse_json({source})"
    found = f"try_variant_get({whole}, '{path}', 'variant')"
    compound = f"(schema_of_variant({found}) RLIKE '^(OBJECT|ARRAY)')"
    if name == "JSON_EXISTS":
        return f"({source} IS NOT NULL AND {found} IS NOT NULL)" if len(clauses) == 1 else None
    if name == "JSON_QUERY":
        return f"(CASE WHEN {compound} THEN to_json({found}) END)" if len(clauses) == 1 else None
    kind, on = "STRING", {"EMPTY": "NULL", "ERROR": "NULL"}
    k = 1
    while k < len(clauses):
        word = clauses[k][1].upper()
        if word == "RETURNING":
            kind, k = clauses[k + 1][1].upper(), k + 2
            continue
        if word not in ("NULL", "ERROR", "DEFAULT"):
            raise ValueError(f"JSON_VALUE doesn't take {clauses[k][1]}")
        end = next((j for j in range(k + 1, len(clauses) - 1) if clauses[j][1].upper() == "ON" and clauses[j + 1][1].upper() in on), None)
        if end is None:
            raise ValueError("JSON_VALUE: ON EMPTY or ON ERROR expected")
        case = clauses[end + 1][1].upper()
        given = text([x for t in clauses[k + 1 : end] for x in (t, ("space", " "))]) if word == "DEFAULT" else None
        on[case] = f"CAST({given} AS {kind})" if given is not None else "NULL" if word == "NULL" else f"raise_error('JSON_VALUE: {case.lower()}')"
        k = end + 2
    value = f"try_variant_get({whole}, '{path}', '{kind}')"
    missing = on["EMPTY" if mode.strip().lower() == "lax" else "ERROR"]
    if on == {"EMPTY": "NULL", "ERROR": "NULL"}:
        return f"(CASE WHEN {compound} THEN NULL ELSE {value} END)"
    return (
        f"(CASE WHEN {source} IS NULL THEN NULL WHEN {whole} IS NULL THEN {on['ERROR']} WHEN {found} IS NULL THEN {missing} "
        f"WHEN is_variant_null({found}) THEN {on['EMPTY']} WHEN {compound} THEN {missing} WHEN {value} IS NULL THEN {on['ERROR']} ELSE {value} END)"
    )
