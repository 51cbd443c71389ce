"""File sources with the checks their formats ask for, and the result sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loglattice.functions.records import base64url
from loglattice.operators.incident import FAMILIES

METRICS = "timestamp long, service string, metric string, value double"
SPANS = "trace_id string, span_id string, parent_span_id string, service string, start_time_unix_ms long, duration long, status_code long, status_code_kind string, operation string"
PRECEDENTS = "schema_version int, incidents array<struct<id: string, service: string, fault_type: string, metric_family_shifts: map<string, double>>>"
MOST_VALUE = 1e100
NAME = "^[A-Za-z0-9._-]{1,128}$"


class InvalidInput(ValueError):
    """A file breaks its format's rules; nothing of it is used."""


BOM = b"\xef\xbb\xbf"


def exact_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole uncompressed files, byte for byte: path, seq (from 0), payload (binary), terminator (binary; null for an unended tail).

    Split on line feeds only; a carriage return before one joins the
    terminator. Files are read in splits, so one may be of any size; lines are
    numbered within a split and splits by running sums. An empty file has none, nor
    has one that is nothing but a byte order mark.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("at"),
        F.col("value").cast("binary").alias("raw"), F.monotonically_increasing_id().alias("i"),
    )
    splits = rows.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw") + 1).alias("bytes"), F.min("i").alias("low"), F.max("size").alias("size"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    # what the lines with their line feeds fall short of the file: a missing last line feed (-1), a byte order mark the reader swallows (3)
    placed = splits.select("path", "at", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(whole).alias("lines"), (F.col("size") - F.sum("bytes").over(whole)).alias("short"))
    # rows of a split are read in order, so their numbers rise by one
    seq = F.col("first") + F.col("i") - F.col("low")
    bare = F.when((seq == 0) & F.col("short").isin(2, 3), F.concat(F.lit(BOM), F.col("raw"))).otherwise(F.col("raw"))
    ended = ~((seq == F.col("lines") - 1) & F.col("short").isin(-1, 2))
    lines = rows.drop("size").join(placed, ["path", "at"]).select("path", seq.alias("seq"), bare.alias("raw"), ended.alias("ended"))
    return lines.select("path", "seq", *_terminated("raw", F.col("ended")))


def _terminated(raw: str, ended) -> list:
    crlf = ended & (F.substring(raw, -1, 1) == F.lit(b"\r"))
    payload = F.when(crlf, F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(F.col(raw))
    return [payload.alias("payload"), F.when(crlf, F.lit(b"\r\n")).when(ended, F.lit(b"\n")).alias("terminator")]


def streamed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that come into a folder, as a stream: path, payload and terminator (binary), as in ``exact_lines``.

    Files must be whole when they appear; a last line without a line feed counts as ended.
    """
    rows = spark.readStream.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("raw")).select("path", *_terminated("raw", F.lit(True)))


def _checked(rows: DataFrame, wrong, what: str) -> DataFrame:
    """Rows, or InvalidInput if any is wrong; one pass that stops at the first."""
    if rows.where(F.coalesce(wrong, F.lit(True))).limit(1).count():
        raise InvalidInput(what)
    return rows


def read_metrics(spark: SparkSession, path: str, most_series: int = 512) -> DataFrame:
    """NDJSON points; every line must parse, name a service and a metric, and hold a finite value."""
    rows = spark.read.schema(METRICS).option("mode", "FAILFAST").json(path)
    wrong = F.col("timestamp").isNull() | ~F.col("service").rlike(NAME) | F.col("metric").isNull() | F.isnan("value") | (F.abs("value") > MOST_VALUE)
    _checked(rows, wrong, "metrics")
    if rows.select("service", "metric").distinct().limit(most_series + 1).count() > most_series:
        raise InvalidInput(f"more than {most_series} series")
    return rows


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON spans; unknown fields, empty ids and bad service names are refused."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    known = [x.split()[0] for x in SPANS.split(", ")]
    keys = F.coalesce(F.json_object_keys("value"), F.array(F.lit("?")))
    _checked(raw, F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0, "span fields")
    rows = raw.select(F.from_json("value", SPANS, {"mode": "FAILFAST"}).alias("s")).select("s.*")
    wrong = (F.col("trace_id") == "") | (F.col("span_id") == "") | F.col("trace_id").isNull() | F.col("span_id").isNull() | ~F.col("service").rlike(NAME)
    return _checked(rows, wrong, "spans")


def read_precedents(spark: SparkSession, path: str, most: int = 256) -> DataFrame:
    """Confirmed incidents: id, service, fault_type, shifts. Ids are unique, families known, shifts finite and not negative."""
    rows = spark.read.schema(PRECEDENTS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if [r[0] for r in rows.select("schema_version").limit(2).collect()] != [1]:
        raise InvalidInput("schema_version")
    flat = rows.select(F.explode("incidents").alias("i")).select("i.id", "i.service", "i.fault_type", F.col("i.metric_family_shifts").alias("shifts"))
    known = F.array(*map(F.lit, FAMILIES))
    bad_shift = F.exists(F.map_values("shifts"), lambda v: F.isnan(v) | (v < 0) | (v > MOST_VALUE))
    wrong = (F.size(F.array_except(F.map_keys("shifts"), known)) > 0) | bad_shift | ~F.col("service").rlike(NAME) | F.col("id").isNull()
    _checked(flat, wrong, "incidents")
    n = flat.limit(most + 1).count()
    if n > most or flat.select("id").distinct().count() < n:
        raise InvalidInput("incident ids")
    return flat


def result_lines(records: DataFrame) -> DataFrame:
    """JSON lines of a result: source_id, native_id (URL-safe base64), position, repeat_count, and raw as text or, where it isn't UTF-8, as base64.

    records: source_id, native_id (binary), position, repeat_count, raw (binary).
    """
    text = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string"))
    coded = F.when(text.isNull(), F.base64("raw"))
    doc = F.struct("source_id", base64url(F.col("native_id")).alias("native_id"), "position", "repeat_count", text.alias("raw"), coded.alias("raw_base64"))
    return records.select(F.to_json(doc).alias("value"))


def write_results(records: DataFrame, path: str) -> None:
    result_lines(records).write.mode("overwrite").text(path)
