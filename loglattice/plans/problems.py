"""Queries of the general data problems (p1, p2, p4, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglattice.operators import dedup, heavy_keys, late_events, log_entries
from loglattice.plans.tables import table
from loglattice.session import written

HEAVY = (1, 50)
LATE = late_events.WindowSpec(("log_group",), "event_timestamp_millis", "ingestion_timestamp_millis")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    streams = heavy_keys.heavy_keys(table(spark, sf, "cloudwatch_messages"), "log_stream", HEAVY)
    services = heavy_keys.heavy_keys(table(spark, sf, "log_groups"), "service", HEAVY, ["repeat_count"])
    parts = [("stream_rows", streams["rows"]), ("service_groups", services["rows"]), ("service_repeats", services["repeat_count"])]
    frames = [df.select(F.lit(m).alias("measure"), "heavy_key") for m, df in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def p1_stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys.key_totals(table(spark, sf, "cloudwatch_messages"), "log_stream")


def p1_service_totals(spark: SparkSession, sf: str) -> DataFrame:
    return heavy_keys.key_totals(table(spark, sf, "log_groups"), "service", ["repeat_count"])


def p1_cards_with_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each card with the number and evidence of the edges that leave its service."""
    edges = table(spark, sf, "service_edges").groupBy(F.col("source_service").alias("service")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("evidence_count").alias("evidence"))
    cards = table(spark, sf, "log_groups").select("group_id", "service", "repeat_count")
    return heavy_keys.fragment_replicate_join(cards, edges, "service", ["group_id"], "left").select("group_id", "service", "repeat_count", "n_edges", "evidence")


def source_identity(df: DataFrame) -> DataFrame:
    """Letter case of source_id has no meaning; that of native_id has."""
    return df.withColumn("source_id", F.lower("source_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    messages = dedup.repeated_deliveries(table(spark, sf, "cloudwatch_messages").select("event_id", "delivery_id"), ["event_id"], "delivery_id")
    records = dedup.repeated_deliveries(source_identity(table(spark, sf, "source_records")).select("source_id", "native_id", "record_no"), ["source_id", "native_id"], "record_no")
    return messages.select(F.lit("cloudwatch_messages").alias("origin"), F.col("delivery_id").alias("row_id")).unionByName(records.select(F.lit("source_records").alias("origin"), F.col("record_no").alias("row_id")))


def p2_message_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Kept messages, parsed; copies are removed after parsing, when rows are narrow."""
    rows = table(spark, sf, "cloudwatch_messages")
    parsed = log_entries.parse_messages(rows, "message", "event_timestamp_millis", ["delivery_id", "event_id"])
    return dedup.first_copies(parsed, ["event_id"], "delivery_id", log_entries.PARSED)


def p2_record_entries(spark: SparkSession, sf: str, message: bool = False) -> DataFrame:
    """Entries of kept records: single ones, and those put together from numbered lines."""
    rows = source_identity(table(spark, sf, "source_records"))
    said = ["message"] if message else []
    parsed = log_entries.parse_records(rows, "raw_base64", "native_id", ["record_no", "source_id", "native_id"], message=message)
    kept = dedup.first_copies(parsed, ["source_id", "native_id"], "record_no", [*log_entries.PARSED, "line_no", "has_bytes", "is_head", "is_open", *said]).where("has_bytes")
    kept = written(kept, "entries")  # read by both branches: parsed once
    single = kept.where("line_no is null").select("source_id", "record_no", *log_entries.PARSED, *said)
    lines = log_entries.put_json_together(kept.where("line_no is not null"), rows, "raw_base64", "source_id", ["native_id"], "record_no", message)
    return single.unionByName(log_entries.join_lines(lines, "source_id", ["native_id"], "record_no", message=message))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    messages = log_entries.complete(p2_message_entries(spark, sf))
    records = log_entries.complete(p2_record_entries(spark, sf))
    return messages.select(F.lit("cloudwatch_messages").alias("origin"), F.col("delivery_id").alias("row_id"), *log_entries.PARSED).unionByName(
        records.select(F.lit("source_records").alias("origin"), F.col("record_no").alias("row_id"), *log_entries.PARSED)
    )


def p2_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivered message and every entry of the kept records, with its fields and message text; row_id as in p2_found."""
    rows = table(spark, sf, "cloudwatch_messages")
    messages = log_entries.parse_messages(rows, "message", "event_timestamp_millis", ["delivery_id"], message=True)
    records = p2_record_entries(spark, sf, message=True)
    fields = [*log_entries.PARSED, "message"]
    return messages.select(F.lit("cloudwatch_messages").alias("origin"), F.col("delivery_id").alias("row_id"), *fields).unionByName(
        records.select(F.lit("source_records").alias("origin"), F.col("record_no").alias("row_id"), *fields)
    )


def kept_events(spark: SparkSession, sf: str, carry: list[str]) -> DataFrame:
    """One kept copy of each event with its own columns."""
    return dedup.first_copies(table(spark, sf, "cloudwatch_messages").where("event_id is not null"), ["event_id"], "delivery_id", carry)


def _late_state(spark: SparkSession, sf: str, carry: tuple[str, ...] = ()) -> late_events.WindowState:
    times = ["log_group", "event_timestamp_millis", "ingestion_timestamp_millis"]
    return late_events.taken_in(kept_events(spark, sf, times), LATE, carry, like=table(spark, sf, "cloudwatch_messages"))


def p5_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _late_state(spark, sf).windows()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return late_events.late_windows(p5_windows(spark, sf)).select("log_group", "period_start_millis", "n_events")


def p5_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return _late_state(spark, sf, ("delivery_id",)).diverted().select("delivery_id", "log_group", "period_start_millis", "reason", "over_cutoff_millis")


QUERIES = {
    "p1_found": p1_found,
    "p1_stream_totals": p1_stream_totals,
    "p1_service_totals": p1_service_totals,
    "p1_cards_with_edges": p1_cards_with_edges,
    "p2_found": p2_found,
    "p2_fields": p2_fields,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_windows": p5_windows,
    "p5_dropped": p5_dropped,
}

_KEPT = """kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY delivery_id) AS rn
    FROM cloudwatch_messages WHERE event_id IS NOT NULL) WHERE rn = 1),
timed AS (
  SELECT *, event_timestamp_millis - ((event_timestamp_millis % 3600000) + 3600000) % 3600000 AS p
  FROM kept)"""

SQL = {
    "p1_found": """
WITH s AS (SELECT log_stream AS k, count(*) AS n FROM cloudwatch_messages GROUP BY 1),
g AS (SELECT service AS k, count(*) AS n, sum(repeat_count) AS r FROM log_groups GROUP BY 1)
SELECT 'stream_rows' AS measure, k AS heavy_key FROM s WHERE 50 * n >= (SELECT sum(n) FROM s) AND k IS NOT NULL
UNION ALL SELECT 'service_groups', k FROM g WHERE 50 * n >= (SELECT sum(n) FROM g) AND k IS NOT NULL
UNION ALL SELECT 'service_repeats', k FROM g WHERE 50 * r >= (SELECT sum(r) FROM g) AND k IS NOT NULL""",
    "p1_stream_totals": "SELECT log_stream, count(*) AS n_rows FROM cloudwatch_messages GROUP BY 1",
    "p1_service_totals": "SELECT service, count(*) AS n_rows, sum(repeat_count)::BIGINT AS sum_repeat_count FROM log_groups GROUP BY 1",
    "p1_cards_with_edges": """
SELECT group_id, service, repeat_count, n_edges, evidence FROM log_groups
LEFT JOIN (SELECT source_service AS service, count(*) AS n_edges, sum(evidence_count)::BIGINT AS evidence FROM service_edges GROUP BY 1) USING (service)""",
    "p4_found": """
SELECT 'cloudwatch_messages' AS origin, delivery_id AS row_id FROM (
  SELECT delivery_id, row_number() OVER (PARTITION BY event_id ORDER BY delivery_id) AS rn FROM cloudwatch_messages WHERE event_id IS NOT NULL) WHERE rn > 1
UNION ALL SELECT 'source_records', record_no FROM (
  SELECT record_no, row_number() OVER (PARTITION BY lower(source_id), native_id ORDER BY record_no) AS rn FROM source_records
  WHERE source_id IS NOT NULL AND native_id IS NOT NULL) WHERE rn > 1""",
    "p5_found": f"""
WITH {_KEPT}
SELECT log_group, p AS period_start_millis, count(*) FILTER (ingestion_timestamp_millis < p + 7 * 3600000) AS n_events
FROM timed WHERE ingestion_timestamp_millis IS NOT NULL AND log_group IS NOT NULL GROUP BY 1, 2
HAVING count(*) FILTER (ingestion_timestamp_millis >= p + 3600000) > 0""",
    "p5_windows": f"""
WITH {_KEPT}
SELECT log_group, p AS period_start_millis,
  count(*) FILTER (ingestion_timestamp_millis < p + 3600000) AS n_on_time,
  count(*) FILTER (ingestion_timestamp_millis >= p + 3600000 AND ingestion_timestamp_millis < p + 7 * 3600000) AS n_corrected,
  count(*) FILTER (ingestion_timestamp_millis >= p + 7 * 3600000) AS n_dropped,
  count(*) FILTER (ingestion_timestamp_millis < p + 7 * 3600000) AS n_events
FROM timed WHERE ingestion_timestamp_millis IS NOT NULL AND log_group IS NOT NULL GROUP BY 1, 2""",
    "p5_dropped": f"""
WITH {_KEPT}
SELECT delivery_id, log_group, p AS period_start_millis, 'late' AS reason, ingestion_timestamp_millis - p - 7 * 3600000 AS over_cutoff_millis
FROM timed WHERE ingestion_timestamp_millis >= p + 7 * 3600000 AND log_group IS NOT NULL
UNION ALL SELECT delivery_id, log_group, NULL, 'incomplete', NULL FROM timed WHERE ingestion_timestamp_millis IS NULL OR log_group IS NULL""",
}
