"""Tables of scripts as readers and writers, by connector name. Kafka needs its Spark package on the class path; files and memory stand in for it with the same schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.script.ddl import TableDef
from halyard.sources.lines import lines_stream


def starting_offsets(mode: str, timestamp_ms: str | None = None) -> dict[str, str]:
    """Options of Spark's Kafka source for a startup mode.

    group-offsets means: go on from the checkpoint, and from the earliest without one, as Spark keeps offsets there and never reads a group's."""
    if mode in ("latest", "latest-offset"):
        return {"startingOffsets": "latest"}
    if mode == "timestamp":
        if timestamp_ms is None:
            raise ValueError("the mode timestamp needs scan.startup.timestamp-millis")
        return {"startingTimestamp": timestamp_ms}
    return {"startingOffsets": "earliest"}


def kafka_options(options: dict[str, str]) -> dict[str, str]:
    """A script's Kafka options as Spark's; partition discovery is built in."""
    out = {"kafka.bootstrap.servers": options["properties.bootstrap.servers"], "subscribe": options["topic"]}
    if group := options.get("properties.group.id"):
        out["kafka.group.id"] = group
    return out | starting_offsets(options.get("scan.startup.mode", "group-offsets"), options.get("scan.startup.timestamp-millis"))


def parse_json(raw: DataFrame, table: TableDef, lenient: bool) -> DataFrame:
    """A column value of JSON text by the table's columns. Lenient: rows that aren't JSON go, bad fields are null; else they fail the query."""
    schema = table.schema
    if lenient:
        parsed = raw.select(F.from_json("value", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.col("value"))
        bad = F.col("r._corrupt").isNotNull() & F.try_parse_json("value").isNull()
        return parsed.filter(~F.coalesce(bad, F.lit(True))).select(*[f"r.`{n}`" for n, _ in table.columns])
    return raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def finish(df: DataFrame, table: TableDef, streaming: bool) -> DataFrame:
    """Adds computed columns, and for streams the watermark, whose column becomes a timestamp with zone."""
    if table.computed:
        df = df.select("*", *[F.expr(e).alias(n) for n, e in table.computed])
    if streaming and table.watermark:
        w = table.watermark
        df = df.withColumn(w.column, F.col(w.column).cast("timestamp")).withWatermark(w.column, w.delay)
    return df


#: Startup modes of files that grow; a time is a filter on event time, so it reads from the beginning.
_FILE_MODES = {"earliest": "earliest-offset", "earliest-offset": "earliest-offset", "latest": "latest-offset", "latest-offset": "latest-offset", "timestamp": "earliest-offset"}


def _since(df: DataFrame, table: TableDef) -> DataFrame:
    """With the mode timestamp, rows whose event time (scan.startup.timestamp-column, else the watermark's column) isn't before scan.startup.timestamp-millis."""
    if table.options.get("scan.startup.mode") != "timestamp":
        return df
    column = table.options.get("scan.startup.timestamp-column") or (table.watermark.column if table.watermark else None)
    if column is None or "scan.startup.timestamp-millis" not in table.options:
        raise ValueError("the mode timestamp needs scan.startup.timestamp-millis and an event time")
    return df.filter(F.unix_millis(F.col(column).cast("timestamp")) >= int(table.options["scan.startup.timestamp-millis"]))


def read_table(spark: SparkSession, table: TableDef, streaming: bool) -> DataFrame:
    """A table with options as a DataFrame."""
    options = table.options
    kind = options.get("connector", "filesystem")
    reader = spark.readStream if streaming else spark.read
    lenient = options.get("json.ignore-parse-errors", "false").lower() == "true"
    if kind == "kafka":
        given = kafka_options(options)
        if not streaming and given.get("startingOffsets") == "latest":
            given["startingOffsets"] = "earliest"
        raw = reader.format("kafka").options(**given).load().select(F.col("value").cast("string").alias("value"))
        return finish(parse_json(raw, table, lenient), table, streaming)
    if kind == "socket":
        raw = spark.readStream.format("socket").option("host", options["hostname"]).option("port", options["port"]).load()
        return finish(raw, table, True)
    if kind == "filesystem":
        form = options.get("format", "json")
        mode = options.get("scan.startup.mode")
        if form == "json" and streaming and mode is not None:
            return finish(_since(parse_json(lines_stream(spark, options["path"], _FILE_MODES.get(mode, "group-offsets"), options.get("properties.group.id")), table, lenient), table), table, True)
        if form == "json":
            raw = (reader.schema("value STRING") if streaming else reader).text(options["path"])
            return finish(parse_json(raw, table, lenient), table, streaming)
        return finish(reader.schema(table.schema).format(form).load(options["path"]), table, streaming)
    if kind == "memory":
        return finish(spark.table(options["table"]), table, False)
    if kind == "jdbc":
        given = {k: options[k] for k in ("url", "driver") if k in options} | {"dbtable": options["table-name"], "user": options.get("username", ""), "password": options.get("password", "")}
        if "scan.partition.column" in options:  # else the database is read by one task
            given |= {to: options[f"scan.partition.{of}"] for of, to in (("column", "partitionColumn"), ("lower-bound", "lowerBound"), ("upper-bound", "upperBound"), ("num", "numPartitions"))}
        return finish(spark.read.format("jdbc").options(**given).load(), table, False)
    raise ValueError(f"unknown connector {kind}")


def text_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return spark.readStream.schema("value STRING").text(path) if streaming else spark.read.text(path)


def elements(spark: SparkSession, values: list, kind: str = "int") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"value {kind}")
