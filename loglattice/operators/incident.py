"""Before/after signals around an incident from logs, metrics and traces.

Baseline is the half-open window before the incident, incident the closed
window from it on. Medians are exact; their representative is the upper middle
row. Series with fewer than ``least`` points on either side give no signal.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglattice.operators.corpus import bounded
from loglattice.operators.prefix import medians, order_statistics
from loglattice.session import cut

# Fixed values.
METRIC_FAMILIES = {"cpu": "cpu", "mem": "mem", "diskio": "disk", "error": "loss", "socket": "socket"}
FAMILIES = ("cpu", "mem", "disk", "delay", "loss", "socket")
GRPC_STATUS = "OK CANCELLED UNKNOWN INVALID_ARGUMENT DEADLINE_EXCEEDED NOT_FOUND ALREADY_EXISTS PERMISSION_DENIED RESOURCE_EXHAUSTED FAILED_PRECONDITION ABORTED OUT_OF_RANGE UNIMPLEMENTED INTERNAL UNAVAILABLE DATA_LOSS UNAUTHENTICATED".split()


def period(at: Column, centre: int, width: int) -> Column:
    """0 before, 1 from the incident on, null outside both windows."""
    offset = at - centre
    return F.when((offset >= -width) & (offset < 0), 0).when((offset >= 0) & (offset <= width), 1)


def metric_shifts(points: DataFrame, incident: int, width: int = 300, least: int = 5) -> DataFrame:
    """points: at, service, metric, value, id. One row per series with enough points on both sides."""
    sided = points.withColumn("p", period(F.col("at"), incident, width)).where("p is not null")
    both = medians(sided, ["service", "metric", "p"], "value", "id")
    named = {"median": "median", "count": "n", "id": "example"}
    sides = [F.max(F.when(F.col("p") == p, F.col(c))).alias(f"{side}_{name}") for p, side in ((0, "baseline"), (1, "incident")) for name, c in named.items()]
    series = both.groupBy("service", "metric").agg(*sides).where((F.col("baseline_count") >= least) & (F.col("incident_count") >= least))
    old, now = F.col("baseline_median"), F.col("incident_median")
    return series.withColumn("relative_shift", F.abs(now - old) / F.greatest(F.abs(old), F.abs(now) * 0.01, F.lit(1e-6)))


def metric_family(metric: Column) -> Column:
    out = F.when(metric.startswith("latency-"), "delay")
    for name, family in METRIC_FAMILIES.items():
        out = out.when(metric == name, family)
    return out


def group_periods(members: DataFrame, keys: Sequence[str], at: str, incident: int, width: int) -> DataFrame:
    """Counts of a group's records before, after and outside the windows, records without a time included."""
    p = period(F.col(at), incident, width)
    return members.groupBy(*keys).agg(F.count(F.when(p == 0, 1)).alias("before"), F.count(F.when(p == 1, 1)).alias("after"), F.count(F.when(p.isNull(), 1)).alias("unclassified"))


def chronic_conflict(shifts: DataFrame, periods: DataFrame, candidate: str) -> DataFrame:
    """One row: the service whose metric moved most, and whether it contradicts a candidate whose logs were as busy before."""
    top = shifts.agg(F.max(F.struct("relative_shift", "service")).alias("t"), F.coalesce(F.max(F.when(F.col("service") == candidate, F.col("relative_shift"))), F.lit(0.0)).alias("own"))
    own = periods.where(F.col("service") == candidate).agg(F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))
    strong = (F.col("t.service") != candidate) & (F.col("t.relative_shift") >= 1.0) & (F.col("t.relative_shift") >= 5 * F.col("own"))
    chronic = (F.col("before") + F.col("after") >= 4) & (5 * F.col("after") <= 6 * F.col("before"))
    return top.join(F.broadcast(own)).select(F.col("t.service").alias("strongest_service"), F.coalesce(strong & chronic, F.lit(False)).alias("conflict"))  # one row each


# --- traces ---


def linked_spans(spans: DataFrame) -> DataFrame:
    """Spans with ``link``: root, matched, missing_parent, ambiguous_parent or ambiguous_span, and the matched parent's service and line.

    A (trace, span) id that stands twice is ambiguous wherever it is used.
    """
    keys = spans.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("n"), F.min("service").alias("parent_service"), F.min("line").alias("parent_line"))
    own = keys.select("trace_id", "span_id", F.col("n").alias("own_n"))
    parents = keys.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("n").alias("parent_n"), "parent_service", "parent_line")
    joined = spans.join(own, ["trace_id", "span_id"]).join(parents, ["trace_id", "parent_span_id"], "left")
    no_parent = F.col("parent_span_id").isNull() | (F.col("parent_span_id") == "")
    link = (
        F.when(F.col("own_n") > 1, "ambiguous_span").when(no_parent, "root").when(F.col("parent_n") > 1, "ambiguous_parent").when(F.col("parent_n").isNull(), "missing_parent").otherwise("matched")
    )
    return joined.withColumn("link", link).drop("own_n", "parent_n")


def span_edges(spans: DataFrame) -> DataFrame:
    """Service pairs of matched spans, with the earliest child line and its parent's as the example."""
    pairs = linked_spans(spans).where("link = 'matched' and parent_service <> service")
    edges = pairs.groupBy(F.col("parent_service").alias("source_service"), F.col("service").alias("target_service")).agg(F.count(F.lit(1)).alias("span_count"), F.min(F.struct("line", "parent_line")).alias("e"))
    return edges.select("source_service", "target_service", "span_count", F.col("e.parent_line").alias("example_parent"), F.col("e.line").alias("example_child"))


def link_counts(spans: DataFrame) -> DataFrame:
    return linked_spans(spans).groupBy("link").agg(F.count(F.lit(1)).alias("n_spans"))


def trace_signals(spans: DataFrame, incident_ms: int, width_ms: int = 300_000) -> DataFrame:
    """Per service counts, failing statuses and duration medians before and after, and a priority."""
    sided = cut(spans.withColumn("p", period(F.col("start_ms"), incident_ms, width_ms)).where("p is not null").select("service", "p", "status_code", "duration", "line"))
    failed = F.coalesce(F.col("status_code"), F.lit(0)) != 0
    counts = []
    for p, name in ((0, "before"), (1, "after")):
        mine = F.col("p") == p
        counts += [
            F.count(F.when(mine, 1)).alias(f"{name}_count"), F.count(F.when(mine & failed, 1)).alias(f"{name}_failed"), F.count(F.when(mine, F.col("duration"))).alias(f"{name}_durations")
        ]
    out = sided.groupBy("service").agg(*counts)
    middle = medians(sided, ["service", "p"], "duration", "line")
    sides = [F.max(F.when(F.col("p") == p, F.col(c))).alias(f"{name}_{c}") for p, name in ((0, "before"), (1, "after")) for c in ("median", "example")]
    out = out.join(middle.groupBy("service").agg(*sides), "service", "left")
    rate = {n: F.col(f"{n}_failed") / F.greatest(F.col(f"{n}_count"), F.lit(1)) for n in ("before", "after")}
    enough = (F.col("before_durations") >= 5) & (F.col("after_durations") >= 5)
    slower = F.when(enough, F.log1p(F.col("after_median") / F.greatest(F.col("before_median"), F.lit(1.0)))).otherwise(0.0)
    return out.withColumn("priority", F.greatest(rate["after"] - rate["before"], F.lit(0.0)) * 10 + slower)


def grpc_status_name(code: Column) -> Column:
    """Name of a gRPC status that isn't OK; null for any other number."""
    return F.when(code.between(1, len(GRPC_STATUS) - 1), F.get(F.array(*map(F.lit, GRPC_STATUS)), code.cast("int")))


def operation_signals(spans: DataFrame, edges: DataFrame, incident_ms: int, width_ms: int = 300_000, most: int | None = None) -> DataFrame:
    """Per service, operation, failing status and its kind the counts before and after, the status's name if it's a gRPC one, and the operation's target if exactly one observed edge fits its name.

    spans may have ``status_code_kind`` (grpc, or null for untyped). With
    ``most`` the signals that rose most come first, with rank and truncated.
    """
    if "status_code_kind" not in spans.columns:
        spans = spans.withColumn("status_code_kind", F.lit(None).cast("string"))
    sided = cut(spans.withColumn("p", period(F.col("start_ms"), incident_ms, width_ms)).where("p is not null and operation is not null").select("service", "operation", "status_code", "status_code_kind", "p", "line"))
    count = lambda p: F.count(F.when(F.col("p") == p, 1))
    totals = sided.groupBy("service", "operation").agg(count(0).alias("before_operations"), count(1).alias("after_operations"))
    failing = sided.where("status_code <> 0").groupBy("service", "operation", "status_code", "status_code_kind").agg(count(0).alias("before_count"), count(1).alias("after_count"), F.min(F.when(F.col("p") == 1, F.col("line"))).alias("example_after"))
    named = F.lower(F.element_at(F.split(F.element_at(F.split("operation", "/"), 1), r"\."), -1))
    targets = edges.select(F.col("source_service").alias("service"), F.lower("target_service").alias("wanted"), "target_service").distinct()
    only = targets.groupBy("service", "wanted").agg(F.count(F.lit(1)).alias("n"), F.min("target_service").alias("observed_target")).where("n = 1").drop("n")
    out = failing.join(totals, ["service", "operation"]).withColumn("wanted", named).join(only, ["service", "wanted"], "left").drop("wanted")
    out = out.withColumn("status_name", F.when(F.col("status_code_kind") == "grpc", grpc_status_name(F.col("status_code"))))
    if most is None:
        return out
    rise = F.greatest(F.col("after_count") - F.col("before_count"), F.lit(0))
    return bounded(out, [rise.desc(), F.desc("after_count"), F.asc("service"), F.asc("operation"), F.asc("status_code"), F.asc("status_code_kind")], most)


# --- services ---


def transitive_dependents(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """service and dependent pairs of the closure of "source depends on target"; cycles end by themselves.

    Each round joins only the pairs the last one found with the edges, and
    keeps those that are new; lineage is cut every round. There are as many
    rounds as the longest shortest path has edges.
    """
    direct = cut(edges.select(F.col("target_service").alias("service"), F.col("source_service").alias("dependent")).where("service <> dependent").distinct())
    onward = direct.select(F.col("service").alias("via"), F.col("dependent").alias("next"))
    reach = found = direct
    for _ in range(most_rounds):
        step = found.join(onward, F.col("dependent") == F.col("via")).select("service", F.col("next").alias("dependent")).where("service <> dependent").distinct()
        known = reach.select(F.col("service").alias("s"), F.col("dependent").alias("d"))
        found = cut(step.join(known, (F.col("service") == F.col("s")) & (F.col("dependent") == F.col("d")), "left_anti"))
        if found.limit(1).count() == 0:
            return reach
        reach = cut(reach.union(found))
    raise RuntimeError("the closure didn't end")


def service_signals(members: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Per known service its role counts, direct and transitive dependents."""
    roles = members.groupBy("service").agg(*[F.count(F.when(F.col("role") == r, 1)).alias(f"{r}_count") for r in ("critical", "error", "warning", "change")])
    direct = edges.groupBy(F.col("target_service").alias("service")).agg(F.countDistinct("source_service").alias("direct_dependents"))
    deep = transitive_dependents(edges).groupBy("service").agg(F.count(F.lit(1)).alias("transitive_dependents"))
    out = known.select("service").distinct().join(roles, "service", "left").join(direct, "service", "left").join(deep, "service", "left")
    return out.na.fill(0)


def group_priority(groups: DataFrame, focus: Sequence[str], first: str = "group_id") -> list[Column]:
    """Order of groups for a reader: focus services, then role (a change before a warning), the rarest, the first."""
    role = F.when(F.col("role") == "critical", 0).when(F.col("role") == "error", 1).when(F.col("role") == "change", 2).when(F.col("role") == "warning", 3).otherwise(4)
    return [(~F.col("service").isin(*focus)).asc(), role.asc(), F.asc("repeat_count"), F.asc(first)]


def precedents(current: DataFrame, history: DataFrame, most: int = 3) -> DataFrame:
    """Nearest confirmed incidents of the same service: current and history have service and a map of family shifts; history has id.

    Equi-join on service; distance is the squared difference of log1p shifts over the families.
    """
    total = F.lit(0.0)
    for f in FAMILIES:
        total = total + F.pow(F.log1p(F.coalesce(F.col("now")[f], F.lit(0.0))) - F.log1p(F.coalesce(F.col("then")[f], F.lit(0.0))), 2)
    pairs = history.select("id", "service", F.col("shifts").alias("then")).join(current.select("service", F.col("shifts").alias("now")), "service").select("service", "id", total.alias("distance"))
    nearest = Window.partitionBy("service").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= most).select("service", F.col("rank").cast("long").alias("rank"), "id", "distance")


def mentions(question: str, service: str) -> bool:
    return re.search(rf"(?<![a-z0-9]){re.escape(service.lower())}(?![a-z0-9])", question.lower()) is not None


def service_alias(service: str) -> str | None:
    low = service.lower()
    alias = low.removesuffix("service").rstrip("-_")
    return alias if low.endswith("service") and len(alias) >= 4 else None


def focus_services(question: str, known: Sequence[str], most: int = 4) -> list[str]:
    """Known services a question names, or names by an alias only one of them has."""
    aliases = [a for s in known if (a := service_alias(s))]
    hits = [s for s in sorted(set(known)) if s != "unknown" and (mentions(question, s) or ((a := service_alias(s)) and aliases.count(a) == 1 and mentions(question, a)))]
    return hits[:most]


def focus_context(numbered: DataFrame, focus: Sequence[str]) -> DataFrame:
    """First, middle and last record of each focus service; ``numbered`` has service and a numeric line."""
    own = numbered.where(F.col("service").isin(*focus))
    places = {"a": lambda n: F.lit(0).cast("long"), "b": lambda n: F.call_function("div", n, F.lit(2)), "c": lambda n: n - 1}
    found = order_statistics(own, ["service"], "line", "line", places)
    return found.select("service", F.explode(F.array_distinct(F.array("a.id", "b.id", "c.id"))).alias("line"))
