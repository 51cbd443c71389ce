"""Whole analyses: supplied logs compacted to a few exact lines, and the bounded evidence around an incident."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from loglattice.functions.records import is_sensitive, parse_records
from loglattice.operators import corpus, incident, selection
from loglattice.operators.receipts import report_status
from loglattice.session import cut

MOST_GROUPS = 4096
PER_SERVICE, METRICS, TRACES = 3, 24, 16


class Sensitive(ValueError):
    """A chosen record holds something that must not be shown; nothing is."""


def compact(lines: DataFrame, select: selection.Selector = selection.first_ids, budget: int = 32 * 1024) -> DataFrame:
    """Supplied lines (line, raw) -> the first and last exact line of the groups a selector chooses, in source order.

    More than MOST_GROUPS groups are refused. A group whose lines no longer
    fit the byte budget is left out whole.
    """
    rows = lines.select(F.lpad(F.col("line").cast("string"), 12, "0").alias("native_id"), F.col("line").cast("long").alias("ts_ms"), "raw")
    members = cut(parse_records(rows, "raw"))
    groups = corpus.template_groups(members)
    pool = selection.collected(groups.select(*corpus.CARD).orderBy("first_timestamp_millis", "group_id"), MOST_GROUPS)
    chosen, _ = selection.tournament(pool, select)
    by_id = {c["group_id"]: c for c in pool}
    ends = sorted({by_id[g][f"{e}_native_id"] for g in chosen for e in ("first", "last")})
    raw = {r["native_id"]: r for r in members.where(F.col("native_id").isin(ends)).select("native_id", "raw", is_sensitive(F.col("raw")).alias("s"), F.octet_length("raw").alias("n")).collect()}
    taken, left = {}, budget
    for g in chosen:
        first, last = by_id[g]["first_native_id"], by_id[g]["last_native_id"]
        own = [first] if raw[first]["raw"] == raw[last]["raw"] else [first, last]
        if sum(raw[i]["n"] for i in own) <= left:
            left -= sum(raw[i]["n"] for i in own)
            taken |= {i: g for i in own}
    if any(raw[i]["s"] for i in taken):
        raise Sensitive
    out = [(int(i), g, by_id[g]["repeat_count"], raw[i]["raw"]) for i, g in sorted(taken.items())]
    return lines.sparkSession.createDataFrame(out, "line long, group_id long, repeat_count long, raw string")


def expand(lines: DataFrame, line: int, before: int, after: int, most: int = 128) -> DataFrame:
    """Lines around one of them."""
    if max(before, after) > most:
        raise selection.NeedsMore(f"at most {most} lines each way")
    return lines.where(F.col("line").between(line - before, line + after))


def group_examples(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group its first and last line, and for critical and error groups the lines beside them; each line once, with ``n_lines`` of the group.

    lines: line (numbered without gaps), raw. groups: group_id, role, first_line, last_line.
    """
    reach = F.when(F.col("role").isin("critical", "error"), 1).otherwise(0)
    wanted = F.array_distinct(F.flatten(F.array(*[F.sequence(F.col(c) - reach, F.col(c) + reach) for c in ("first_line", "last_line")])))
    return groups.select("group_id", F.explode(wanted).alias("line")).join(lines.select("line", "raw"), "line")


def visible_groups(groups: DataFrame, focus: Sequence[str], per_service: int = PER_SERVICE) -> DataFrame:
    """The first groups of each service in a reader's order, with ``turn``: their rank within the service."""
    order = incident.group_priority(groups, focus)
    turn = F.row_number().over(Window.partitionBy("service").orderBy(*order))
    return groups.withColumn("turn", turn).where(F.col("turn") <= per_service).withColumn("turn", F.col("turn").cast("long"))


def omitted_inventory(groups: DataFrame, focus: Sequence[str], limit: int) -> DataFrame:
    """What else there is, a service's first groups before any service's second ones."""
    rest = visible_groups(groups, focus, per_service=PER_SERVICE + limit).where(F.col("turn") > PER_SERVICE)
    focus_last = (~F.col("service").isin(*focus)).asc()
    order = [F.asc("turn"), focus_last, *incident.group_priority(groups, focus)[1:2], F.asc("group_id")]
    return corpus.bounded(rest, order, limit)


def top_metrics(shifts: DataFrame, most: int = METRICS) -> DataFrame:
    return corpus.bounded(shifts, [F.desc("relative_shift"), F.asc("service"), F.asc("metric")], most)


def top_traces(signals: DataFrame, most: int = TRACES) -> DataFrame:
    return corpus.bounded(signals, [F.desc("priority"), F.asc("service")], most)


def analyze(members: DataFrame, points: DataFrame | None, spans: DataFrame | None, topology: DataFrame, at: int, width: int, question: str) -> dict:
    """The evidence a reader gets without any model: frames by name, the focus services, and the report's status.

    members: parsed records with ts_seconds. topology: source_service, target_service.
    """
    told = cut(members.where("role <> 'context'"))
    groups = corpus.template_groups(told)
    edges = topology.select("source_service", "target_service")
    if spans is not None:
        edges = edges.union(incident.span_edges(spans).select("source_service", "target_service"))
    edges = cut(edges.distinct())
    known = members.select("service").union(edges.select("source_service")).union(edges.select("target_service")).where("service is not null").distinct()
    names = [r[0] for r in known.limit(10_001).collect()]
    if len(names) > 10_000:
        raise selection.NeedsMore("more than 10,000 services")
    focus = incident.focus_services(question, names)
    out = {"groups": visible_groups(groups, focus), "services": incident.service_signals(members, edges, known), "periods": incident.group_periods(told, ["service", "role", "fingerprint"], "ts_seconds", at, width)}
    counts = {"groups_omitted": groups.count() > out["groups"].count(), "no_metric_series": points is not None, "focus_missing": bool(focus) and groups.where(F.col("service").isin(*focus)).limit(1).count() == 0}
    if points is not None:
        shifts = cut(incident.metric_shifts(points, at, width))
        out["metrics"] = top_metrics(shifts)
        n = shifts.count()
        counts |= {"metrics_omitted": n > METRICS, "no_metric_series": n == 0}
    if spans is not None:
        signals = cut(incident.trace_signals(spans, at * 1000, width * 1000))
        out["traces"] = top_traces(signals)
        out["operations"] = incident.operation_signals(spans, incident.span_edges(spans), at * 1000, width * 1000)
        counts["traces_omitted"] = signals.count() > TRACES
    return out | {"focus": focus, "status": report_status(counts)}
