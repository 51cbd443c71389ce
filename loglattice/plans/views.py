"""Log records derived from the events table, for queries whose SQL must see their input.

Each event becomes a JSON record of a service, with a level, a message and at
times a peer. ``RECORDS_SQL`` states the same records' parsed form directly.

Searches read a stored index of these records. The first query of an
application that needs it takes the records in; the others search it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglattice.functions.records import parse_records
from loglattice.operators.index import Index
from loglattice.plans.tables import table
from loglattice.session import filesystem, work_folder

SERVICES = 16
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """native_id, ts_ms, raw."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    message = (
        F.when(kind == "error", F.concat(F.lit("request failed request_id=r"), F.col("event_id"), F.lit(" upstream svc-"), F.col("k") % 16))
        .when(kind == "purchase", F.concat(F.lit("slow purchase bucket "), F.col("k") % 10))
        .when(kind == "signup", F.concat(F.lit("deploy of signup flow "), F.col("k") % 5))
        .when(kind == "click", F.concat(F.lit("no error in click path "), F.col("k") % 20))
        .otherwise(F.concat(F.lit("page view took 12:30:05.25 at 10.0.0."), F.col("k") % 8, F.lit(":"), 1000 + F.col("event_id") % 100))
    )
    level = F.when(kind == "error", "err").when(kind == "purchase", "WARN").otherwise("info")
    rows = table(spark, sf, "events").withColumn("k", k)
    ms = F.expr(f"{MICROS} div 1000")
    peer = F.when(F.col("k") % 3 == 0, F.concat(F.lit("svc-"), F.col("k") % SERVICES))
    doc = F.struct(
        F.expr(f"{MICROS} div 1000000").alias("timestamp"),
        F.concat(F.lit("svc-"), F.col("user_id") % SERVICES).alias("service"),
        level.alias("level"),
        message.alias("message"),
        peer.alias("peer.service"),
    )
    return rows.select(F.col("event_id").cast("string").alias("native_id"), ms.alias("ts_ms"), F.to_json(doc).alias("raw"))


def layout_records(spark: SparkSession, sf: str) -> DataFrame:
    """native_id and raw in six layouts other than plain JSON: a RAS line, a framework's preamble, an access line, a bracketed head, OpenTelemetry and key=value."""
    i, u = F.col("event_id"), F.col("user_id") % SERVICES
    grave = F.col("event_type") == "error"
    raw = (
        F.when(i % 6 == 0, F.concat(F.lit("- 1117838570 2005.06.03 R02-M1 2005-06-03-15.42.50.363779 R02-M1 RAS KERN"), u, F.lit(" "), F.when(grave, "FATAL").otherwise("INFO"), F.lit("  data  at 12:30:05.25 on "), i % 9))
        .when(i % 6 == 1, F.concat(F.lit("2024-01-15 10:00:00.123 "), F.when(grave, "ERROR").otherwise("WARN"), F.lit(" [svc,ab"), u, F.lit("] 12 --- [main] c.x.Y : took "), i % 7))
        .when(i % 6 == 2, F.concat(F.lit("GET /v1/items/"), u, F.lit(" "), F.when(grave, 503).when(F.col("event_type") == "click", 404).otherwise(200), F.lit(" 12.5 ms - "), i))
        .when(i % 6 == 3, F.concat(F.lit("[svc-"), u, F.lit("] "), F.when(grave, "ERROR").otherwise("info"), F.lit(": request_id=r"), i, F.lit(" restart of 10.0.0.1:"), i % 999 + 1))
        .when(i % 6 == 4, F.concat(F.lit('{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-'), u, F.lit('"}}]},"severityNumber":'), F.when(grave, 21).otherwise(13), F.lit(',"body":{"stringValue":"lost shard '), i % 5, F.lit('"},"timeUnixNano":"17040672'), F.lpad((i % 100).cast("string"), 2, "0"), F.lit('999999999"}')))
        .otherwise(F.concat(F.lit("timestamp=5 level="), F.when(grave, "critical").otherwise("debug"), F.lit(" service=svc-"), u, F.lit(", without error "), i % 8))
    )
    return table(spark, sf, "events").select(i.cast("string").alias("native_id"), raw.alias("raw"))


LAYOUTS_SQL = f"""WITH e AS (SELECT event_id AS i, user_id % {SERVICES} AS u, event_type = 'error' AS grave, event_type FROM events)
SELECT i::VARCHAR AS native_id,
  CASE i % 6 WHEN 0 THEN 'kern' || u WHEN 3 THEN 'svc-' || u WHEN 4 THEN 'svc-' || u WHEN 5 THEN 'svc-' || u ELSE 'unknown' END AS service,
  CASE i % 6 WHEN 0 THEN CASE WHEN grave THEN 'critical' ELSE 'context' END WHEN 1 THEN CASE WHEN grave THEN 'error' ELSE 'warning' END
    WHEN 2 THEN CASE WHEN grave THEN 'error' WHEN event_type = 'click' THEN 'warning' ELSE 'context' END WHEN 3 THEN CASE WHEN grave THEN 'error' ELSE 'change' END
    WHEN 4 THEN CASE WHEN grave THEN 'critical' ELSE 'warning' END ELSE CASE WHEN grave THEN 'critical' ELSE 'context' END END AS role,
  CASE i % 6 WHEN 0 THEN 'data at <time> on ' || (i % 9) WHEN 1 THEN '<date> <time> ' || CASE WHEN grave THEN 'error' ELSE 'warn' END || ' [svc,ab' || u || '] 12 --- [main] c.x.y : took ' || (i % 7)
    WHEN 2 THEN 'get /v1/items/' || u || ' ' || CASE WHEN grave THEN 503 WHEN event_type = 'click' THEN 404 ELSE 200 END || ' <latency> ms - <bytes>'
    WHEN 3 THEN '[svc-' || u || '] ' || CASE WHEN grave THEN 'error' ELSE 'info' END || ': request_id=<id> restart of 10.0.0.1:<port>' WHEN 4 THEN 'lost shard ' || (i % 5) ELSE 'without error ' || (i % 8) END AS fingerprint,
  CASE i % 6 WHEN 0 THEN 1117838570 WHEN 4 THEN 1704067200 + i % 100 END::BIGINT AS ts_seconds
FROM e"""

_INDEXES: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    fs, p = filesystem(spark, path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))


def index(spark: SparkSession, sf: str) -> Index:
    """The index of a data folder's records, taken in once per application and state of its files."""
    key = (spark.sparkContext.applicationId, sf, _files(spark, f"{sf.rstrip('/')}/events.parquet"))
    if key not in _INDEXES:
        path = work_folder(spark, "index")
        Index(spark, path).add(records(spark, sf), 0)
        _INDEXES[key] = path
    return Index(spark, _INDEXES[key])


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The records with what parsing finds in them."""
    return parse_records(records(spark, sf), "raw")


def members(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).members()


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).groups()


MEMBERS_SQL = f"""members AS (
  SELECT event_id::VARCHAR AS native_id, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000000 AS ts_seconds, event_type, user_id, value, k,
    'svc-' || (user_id % {SERVICES}) AS service,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'change' ELSE 'context' END AS role,
    CASE event_type WHEN 'error' THEN 'request failed request_id=<id> upstream svc-' || (k % 16)
      WHEN 'purchase' THEN 'slow purchase bucket ' || (k % 10) WHEN 'signup' THEN 'deploy of signup flow ' || (k % 5)
      WHEN 'click' THEN 'no error in click path ' || (k % 20) ELSE 'page view took <time> at 10.0.0.' || (k % 8) || ':<port>' END AS fingerprint,
    CASE WHEN k % 3 = 0 THEN 'svc-' || (k % {SERVICES}) END AS peer
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"""

RECORDS_SQL = f"""records AS (
  SELECT event_id::VARCHAR AS native_id, epoch_us(ts) // 1000 AS ts_ms,
    '{{"timestamp":' || (epoch_us(ts) // 1000000) || ',"service":"svc-' || (user_id % {SERVICES}) || '","level":"' || CASE event_type WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'WARN' ELSE 'info' END
    || '","message":"' || CASE event_type WHEN 'error' THEN 'request failed request_id=r' || event_id || ' upstream svc-' || (k % 16)
      WHEN 'purchase' THEN 'slow purchase bucket ' || (k % 10) WHEN 'signup' THEN 'deploy of signup flow ' || (k % 5)
      WHEN 'click' THEN 'no error in click path ' || (k % 20) ELSE 'page view took 12:30:05.25 at 10.0.0.' || (k % 8) || ':' || (1000 + event_id % 100) END
    || '"' || CASE WHEN k % 3 = 0 THEN ',"peer.service":"svc-' || (k % {SERVICES}) || '"' ELSE '' END || '}}' AS raw
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"""

GROUPS_SQL = (
    MEMBERS_SQL
    + """,
grouped AS (
  SELECT service, role, fingerprint, count(*) AS repeat_count, min((ts_ms, native_id)) AS f, max((ts_ms, native_id)) AS l FROM members GROUP BY 1, 2, 3),
groups AS (
  SELECT row_number() OVER (ORDER BY f[1], f[2], service, role, fingerprint) AS group_id, service, role, fingerprint, repeat_count,
    f[1] AS first_timestamp_millis, f[2] AS first_native_id, l[1] AS last_timestamp_millis, l[2] AS last_native_id FROM grouped)"""
)

_STOP = "'the','and','for','with','from','that','this','then','into','what','when','where','why','how','logs','log','find','show'"
TERMS_SQL = (
    GROUPS_SQL
    + f""",
terms AS (
  SELECT DISTINCT group_id, unnest(list_transform(list_filter(string_split_regex(service || ' ' || role || ' ' || fingerprint, '[^A-Za-z0-9]'),
    lambda x: length(x) BETWEEN 3 AND 64 AND lower(x) NOT IN ({_STOP}))[1:64], lambda x: lower(x))) AS term FROM groups)"""
)

ROLE_RANK_SQL = "CASE role WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'change' THEN 3 ELSE 4 END"
