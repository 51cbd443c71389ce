"""Queries over metrics, traces and services around an incident, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglattice.operators import incident
from loglattice.operators.corpus import bounded
from loglattice.plans import views
from loglattice.plans.tables import table

INCIDENT = 1_705_276_800  # 2024-01-15T00:00:00Z, in the middle of the events
WIDTH = 7 * 86_400
TRACE_INCIDENT = 852_076_800_000  # 1997-01-01
TRACE_WIDTH = 400 * 86_400_000
FOCUS = ("svc-3", "svc-5")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as metric points: a series per service and event type."""
    return table(spark, sf, "events").select(
        F.expr(f"{views.MICROS} div 1000000").alias("at"), F.concat(F.lit("svc-"), F.col("user_id") % views.SERVICES).alias("service"), F.col("event_type").alias("metric"), "value", F.col("event_id").alias("id")
    )


def metric_shift(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(incident.metric_shifts(points(spark, sf), INCIDENT, WIDTH), ["baseline_median", "incident_median", "relative_shift"])


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def metric_families(spark: SparkSession, sf: str) -> DataFrame:
    shifts = incident.metric_shifts(points(spark, sf), INCIDENT, WIDTH)
    return shifts.select("service", "metric", incident.metric_family(F.col("metric")).alias("family"))


def group_periods(spark: SparkSession, sf: str) -> DataFrame:
    return incident.group_periods(views.members(spark, sf), ["service", "role", "fingerprint"], "ts_seconds", INCIDENT, WIDTH)


def chronic_conflict(spark: SparkSession, sf: str) -> DataFrame:
    shifts = incident.metric_shifts(points(spark, sf), INCIDENT, WIDTH)
    return incident.chronic_conflict(shifts, group_periods(spark, sf), "svc-1")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as parent spans of their customer's nation, their lines as child spans of the supplier's."""
    ms = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {}) div 1000"
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    orders = table(spark, sf, "orders").join(customers, "o_custkey").select(
        F.col("o_orderkey").alias("trace_id"), F.lit("o").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.concat(F.lit("nation"), "c_nationkey").alias("service"),
        F.expr(ms.format("o_orderdate")).alias("start_ms"), F.col("o_totalprice").cast("long").alias("duration"), F.lit(0).cast("long").alias("status_code"), F.lit(None).cast("string").alias("operation"),
        F.lit(None).cast("string").alias("status_code_kind"), (F.col("o_orderkey") * 10).alias("line"),
    )
    status = F.when(F.col("l_returnflag") == "R", 14).when(F.col("l_returnflag") == "A", 5).otherwise(0).cast("long")
    lines = table(spark, sf, "lineitem").join(suppliers, "l_suppkey").select(
        F.col("l_orderkey").alias("trace_id"), F.concat(F.lit("l"), "l_linenumber").alias("span_id"), F.lit("o").alias("parent_span_id"), F.concat(F.lit("nation"), "s_nationkey").alias("service"),
        F.expr(ms.format("l_shipdate")).alias("start_ms"), F.col("l_quantity").cast("long").alias("duration"), status.alias("status_code"),
        F.concat(F.lit("shop.nation"), F.col("l_partkey") % 25, F.lit("/Ship")).alias("operation"),
        F.when(F.col("l_returnflag") == "R", "grpc").alias("status_code_kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
    )
    return orders.unionByName(lines)


def span_links(spark: SparkSession, sf: str) -> DataFrame:
    return incident.link_counts(spans(spark, sf))


def span_edges(spark: SparkSession, sf: str) -> DataFrame:
    return incident.span_edges(spans(spark, sf))


def trace_service_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(incident.trace_signals(spans(spark, sf), TRACE_INCIDENT, TRACE_WIDTH), ["before_median", "after_median", "priority"])


def trace_status_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = spans(spark, sf)
    return incident.operation_signals(rows, incident.span_edges(rows), TRACE_INCIDENT, TRACE_WIDTH)


def top_operations(spark: SparkSession, sf: str) -> DataFrame:
    """The sixteen operation statuses that rose most."""
    rows = spans(spark, sf)
    found = incident.operation_signals(rows, incident.span_edges(rows), TRACE_INCIDENT, TRACE_WIDTH, 16)
    return found.select("rank", "service", "operation", "status_code", "after_count", "truncated")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "service_edges")


def transitive_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return incident.transitive_dependents(_edges(spark, sf))


def service_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Role counts of the group cards, weighted by nothing, beside the stored edges."""
    cards, edges = table(spark, sf, "log_groups"), _edges(spark, sf)
    known = cards.select("service").union(edges.select("source_service")).union(edges.select("target_service"))
    return incident.service_signals(cards, edges, known)


def precedent_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Past incidents: a user's mean value per event type of a service; now: the service's own means."""
    family = F.create_map(*[x for pair in (("error", "loss"), ("purchase", "cpu"), ("signup", "mem"), ("click", "delay"), ("view", "socket")) for x in map(F.lit, pair)])
    rows = points(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id"), "id").withColumn("family", family[F.col("metric")])

    def shifts(keys: list[str]) -> DataFrame:
        means = rows.groupBy(*keys, "family").agg(F.avg("value").alias("v"))
        return means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("family", "v"))).alias("shifts"))

    history = shifts(["service", "user_id"]).withColumn("id", F.concat(F.lit("u"), "user_id"))
    return _rounded(incident.precedents(shifts(["service"]), history), ["distance"])


def focus_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.members(spark, sf).select("service", F.col("native_id").cast("long").alias("line"))
    return incident.focus_context(rows, FOCUS)


def group_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first groups a reader sees."""
    groups = table(spark, sf, "log_groups").select("group_id", "service", "role", "repeat_count")
    return bounded(groups, incident.group_priority(groups, ["quota-gate"]), 50)


QUERIES = {
    f.__name__: f
    for f in (
        metric_shift, metric_families, group_periods, chronic_conflict, span_links, span_edges, trace_service_signals, trace_status_signals, top_operations,
        transitive_dependents, service_signals, precedent_knn, focus_context, group_order,
    )
}

_POINTS = f"points AS (SELECT epoch_us(ts) // 1000000 AS sec, 'svc-' || (user_id % {views.SERVICES}) AS service, event_type AS metric, value, event_id AS id, user_id FROM events)"
_SHIFTS = f"""{_POINTS},
sided AS (SELECT *, CASE WHEN sec >= {INCIDENT - WIDTH} AND sec < {INCIDENT} THEN 0 WHEN sec >= {INCIDENT} AND sec <= {INCIDENT + WIDTH} THEN 1 END AS p FROM points),
series AS (
  SELECT service, metric, median(value) FILTER (p = 0) AS b, median(value) FILTER (p = 1) AS i, count(*) FILTER (p = 0) AS nb, count(*) FILTER (p = 1) AS ni,
    list(id ORDER BY value, id) FILTER (p = 0) AS lb, list(id ORDER BY value, id) FILTER (p = 1) AS li FROM sided WHERE p IS NOT NULL GROUP BY 1, 2),
shifts AS (SELECT *, abs(i - b) / greatest(abs(b), abs(i) * 0.01, 1e-6) AS shift FROM series WHERE nb >= 5 AND ni >= 5)"""
_PERIODS = f"""periods AS (
  SELECT service, role, fingerprint, count(*) FILTER (ts_seconds >= {INCIDENT - WIDTH} AND ts_seconds < {INCIDENT}) AS before,
    count(*) FILTER (ts_seconds >= {INCIDENT} AND ts_seconds <= {INCIDENT + WIDTH}) AS after,
    count(*) FILTER (ts_seconds < {INCIDENT - WIDTH} OR ts_seconds > {INCIDENT + WIDTH}) AS unclassified FROM members GROUP BY 1, 2, 3)"""
_SPANS = """spans AS (
  SELECT o_orderkey AS trace_id, 'o' AS span_id, NULL AS parent_span_id, 'nation' || c_nationkey AS service, epoch_us(o_orderdate) // 1000 AS start_ms, trunc(o_totalprice)::BIGINT AS duration,
    0 AS status_code, NULL AS operation, o_orderkey * 10 AS line FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT l_orderkey, 'l' || l_linenumber, 'o', 'nation' || s_nationkey, epoch_us(l_shipdate) // 1000, trunc(l_quantity)::BIGINT,
    CASE l_returnflag WHEN 'R' THEN 14 WHEN 'A' THEN 5 ELSE 0 END, 'shop.nation' || (l_partkey % 25) || '/Ship', l_orderkey * 10 + l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
keys AS (SELECT trace_id, span_id, count(*) AS n, min(service) AS parent_service, min(line) AS parent_line FROM spans GROUP BY 1, 2),
linked AS (
  SELECT s.*, p.parent_service, p.parent_line, CASE WHEN k.n > 1 THEN 'ambiguous_span' WHEN s.parent_span_id IS NULL THEN 'root' WHEN p.n > 1 THEN 'ambiguous_parent' WHEN p.n IS NULL THEN 'missing_parent' ELSE 'matched' END AS link
  FROM spans s JOIN keys k ON k.trace_id = s.trace_id AND k.span_id = s.span_id LEFT JOIN keys p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id),
edges AS (
  SELECT parent_service AS source_service, service AS target_service, count(*) AS span_count, min((line, parent_line))[2] AS example_parent, min((line, parent_line))[1] AS example_child
  FROM linked WHERE link = 'matched' AND parent_service <> service GROUP BY 1, 2)"""
_TRACE_P = f"CASE WHEN start_ms >= {TRACE_INCIDENT - TRACE_WIDTH} AND start_ms < {TRACE_INCIDENT} THEN 0 WHEN start_ms >= {TRACE_INCIDENT} AND start_ms <= {TRACE_INCIDENT + TRACE_WIDTH} THEN 1 END"
_CLOSURE = """reach(service, dependent) AS (
  SELECT target_service, source_service FROM service_edges WHERE target_service <> source_service
  UNION SELECT r.service, e.source_service FROM reach r JOIN service_edges e ON e.target_service = r.dependent WHERE e.source_service <> r.service)"""
_FAMILY = "CASE metric WHEN 'error' THEN 'loss' WHEN 'purchase' THEN 'cpu' WHEN 'signup' THEN 'mem' WHEN 'click' THEN 'delay' ELSE 'socket' END"

SQL = {
    "metric_shift": f"""WITH {_SHIFTS}
SELECT service, metric, round(b, 6) AS baseline_median, round(i, 6) AS incident_median, nb AS baseline_count, ni AS incident_count, round(shift, 6) AS relative_shift,
  lb[len(lb) // 2 + 1] AS baseline_id, li[len(li) // 2 + 1] AS incident_id FROM shifts""",
    "metric_families": f"WITH {_SHIFTS} SELECT service, metric, CASE WHEN metric = 'error' THEN 'loss' END AS family FROM shifts",
    "group_periods": f"WITH {views.MEMBERS_SQL}, {_PERIODS} SELECT * FROM periods",
    "chronic_conflict": f"""WITH {views.MEMBERS_SQL}, {_PERIODS}, {_SHIFTS},
top AS (SELECT max((shift, service)) AS t, coalesce(max(shift) FILTER (service = 'svc-1'), 0) AS own FROM shifts),
own AS (SELECT coalesce(sum(before), 0) AS b, coalesce(sum(after), 0) AS a FROM periods WHERE service = 'svc-1')
SELECT t[2] AS strongest_service, t[2] <> 'svc-1' AND t[1] >= 1.0 AND t[1] >= 5 * top.own AND b + a >= 4 AND 5 * a <= 6 * b AS conflict FROM top, own""",
    "span_links": f"WITH {_SPANS} SELECT link, count(*) AS n_spans FROM linked GROUP BY 1",
    "span_edges": f"WITH {_SPANS} SELECT * FROM edges",
    "trace_service_signals": f"""WITH {_SPANS}, sided AS (SELECT *, {_TRACE_P} AS p FROM spans),
s AS (
  SELECT service, {", ".join(f"count(*) FILTER (p = {p}) AS {n}_count, count(*) FILTER (p = {p} AND status_code <> 0) AS {n}_failed, count(duration) FILTER (p = {p}) AS {n}_durations, median(duration) FILTER (p = {p}) AS {n}_m, list(line ORDER BY duration, line) FILTER (p = {p}) AS {n}_l" for p, n in ((0, "before"), (1, "after")))}
  FROM sided WHERE p IS NOT NULL GROUP BY 1)
SELECT service, before_count, before_failed, before_durations, round(before_m::DOUBLE, 6) AS before_median, before_l[len(before_l) // 2 + 1] AS before_example,
  after_count, after_failed, after_durations, round(after_m::DOUBLE, 6) AS after_median, after_l[len(after_l) // 2 + 1] AS after_example,
  round(greatest(after_failed / greatest(after_count, 1) - before_failed / greatest(before_count, 1), 0) * 10
    + CASE WHEN before_durations >= 5 AND after_durations >= 5 THEN ln(1 + after_m / greatest(before_m, 1)) ELSE 0 END, 6) AS priority FROM s""",
    "trace_status_signals": f"""WITH {_SPANS}, sided AS (SELECT *, {_TRACE_P} AS p FROM spans WHERE operation IS NOT NULL),
totals AS (SELECT service, operation, count(*) FILTER (p = 0) AS before_operations, count(*) FILTER (p = 1) AS after_operations FROM sided WHERE p IS NOT NULL GROUP BY 1, 2),
failing AS (
  SELECT service, operation, status_code::BIGINT AS status_code, count(*) FILTER (p = 0) AS before_count, count(*) FILTER (p = 1) AS after_count, min(line) FILTER (p = 1) AS example_after
  FROM sided WHERE p IS NOT NULL AND status_code <> 0 GROUP BY 1, 2, 3),
only_one AS (SELECT source_service AS service, lower(target_service) AS wanted, min(target_service) AS observed_target FROM edges GROUP BY 1, 2 HAVING count(*) = 1)
SELECT f.*, CASE WHEN status_code = 14 THEN 'grpc' END AS status_code_kind, CASE WHEN status_code = 14 THEN 'UNAVAILABLE' END AS status_name, before_operations, after_operations, observed_target FROM failing f JOIN totals USING (service, operation)
LEFT JOIN only_one o ON o.service = f.service AND o.wanted = lower(string_split(string_split(f.operation, '/')[1], '.')[-1])""",
    "transitive_dependents": f"WITH RECURSIVE {_CLOSURE} SELECT service, dependent FROM reach",
    "service_signals": f"""WITH RECURSIVE {_CLOSURE},
known AS (SELECT service FROM log_groups UNION SELECT source_service FROM service_edges UNION SELECT target_service FROM service_edges),
roles AS (SELECT service, {", ".join(f"count(*) FILTER (role = '{r}') AS {r}_count" for r in ("critical", "error", "warning", "change"))} FROM log_groups GROUP BY 1),
direct AS (SELECT target_service AS service, count(DISTINCT source_service) AS n FROM service_edges GROUP BY 1),
deep AS (SELECT service, count(*) AS n FROM reach GROUP BY 1)
SELECT service, coalesce(critical_count, 0) AS critical_count, coalesce(error_count, 0) AS error_count, coalesce(warning_count, 0) AS warning_count, coalesce(change_count, 0) AS change_count,
  coalesce(direct.n, 0) AS direct_dependents, coalesce(deep.n, 0) AS transitive_dependents
FROM known LEFT JOIN roles USING (service) LEFT JOIN direct USING (service) LEFT JOIN deep USING (service)""",
    "precedent_knn": f"""WITH {_POINTS},
now AS (SELECT service, {_FAMILY} AS family, avg(value) AS v FROM points GROUP BY 1, 2),
past AS (SELECT service, user_id, {_FAMILY} AS family, avg(value) AS v FROM points GROUP BY 1, 2, 3),
cells AS (SELECT DISTINCT p.service, p.user_id, n.family, n.v AS nv FROM (SELECT DISTINCT service, user_id FROM past) p JOIN now n USING (service)),
d AS (SELECT c.service, c.user_id, sum((ln(1 + nv) - ln(1 + coalesce(p.v, 0))) ** 2) AS distance FROM cells c LEFT JOIN past p ON p.service = c.service AND p.user_id = c.user_id AND p.family = c.family GROUP BY 1, 2)
SELECT service, row_number() OVER (PARTITION BY service ORDER BY distance, 'u' || user_id) AS rank, 'u' || user_id AS id, round(distance, 6) AS distance FROM d QUALIFY rank <= 3""",
    "focus_context": f"""WITH {views.MEMBERS_SQL},
l AS (SELECT service, list(native_id::BIGINT ORDER BY native_id::BIGINT) AS l FROM members WHERE service IN {FOCUS} GROUP BY 1)
SELECT DISTINCT service, unnest([l[1], l[len(l) // 2 + 1], l[-1]]) AS line FROM l""",
    "group_order": """SELECT group_id, service, role, repeat_count,
  row_number() OVER (ORDER BY service <> 'quota-gate', CASE role WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'change' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END, repeat_count, group_id) AS rank,
  (SELECT count(*) FROM log_groups) > 50 AS truncated FROM log_groups QUALIFY rank <= 50""",
}
SQL["top_operations"] = f"""WITH s AS ({SQL["trace_status_signals"]})
SELECT row_number() OVER (ORDER BY greatest(after_count - before_count, 0) DESC, after_count DESC, service, operation, status_code) AS rank, service, operation, status_code, after_count, (SELECT count(*) FROM s) > 16 AS truncated
FROM s QUALIFY rank <= 16"""
