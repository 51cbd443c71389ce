"""Accounting: every record is in exactly one place, every case in a run once, every citation holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


class Unaccounted(ValueError):
    """A record is missing, or is in two places."""


def accounting(universe: DataFrame, parts: dict[str, DataFrame], key: str, size: str) -> DataFrame:
    """Rows and bytes by disposition, after checking that the parts make up the universe.

    universe: key, size. Each part: key. Raises Unaccounted where a record of
    the universe has no or several dispositions, or a part holds a stranger.
    """
    union = None
    for name, part in parts.items():
        rows = part.select(key, F.lit(name).alias("disposition"))
        union = rows if union is None else union.unionByName(rows)
    placed = universe.select(key, size).join(union, key, "full_outer")
    per = placed.groupBy(key).agg(F.count("disposition").alias("n"), F.max(F.col(size).isNotNull()).alias("known"))
    if per.where("n <> 1 or not known").limit(1).count():
        raise Unaccounted("dispositions don't partition the records")
    return placed.groupBy("disposition").agg(F.count(F.lit(1)).alias("n_records"), F.sum(size).alias("n_bytes"))


def run_totals(manifest: DataFrame, runs: DataFrame, cost: str) -> DataFrame:
    """One row: totals over a run that must hold every case of the manifest once; complete, partial and unknown cases counted.

    runs: case_id, status, cost.
    """
    per = manifest.select("case_id").withColumn("m", F.lit(1)).join(runs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")), "case_id", "full_outer")
    if per.where("m is null or n is null or n <> 1").limit(1).count():
        raise Unaccounted("a case is missing, extra or repeated")
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return runs.agg(F.count(F.lit(1)).alias("n_cases"), n("complete"), n("partial"), n("unknown"), F.sum(cost).alias("total_cost"))


def verified_citations(citations: DataFrame, visible: DataFrame, dependents: DataFrame) -> DataFrame:
    """Citations with ``holds``: the shown sample contains the quote, and its service is the hypothesis or depends on it.

    citations: hypothesis, event_id, quote. visible: event_id, service, sample. dependents: service, dependent.
    """
    shown = citations.join(visible, "event_id", "left")
    known = dependents.select(F.col("service").alias("hypothesis"), F.col("dependent").alias("service")).distinct().withColumn("dep", F.lit(True))
    near = (F.col("service") == F.col("hypothesis")) | F.coalesce(F.col("dep"), F.lit(False))
    holds = F.coalesce(F.col("sample").contains(F.col("quote")) & (F.col("quote") != "") & near, F.lit(False))
    return shown.join(known, ["hypothesis", "service"], "left").withColumn("holds", holds).drop("dep")


def report_status(counts: dict[str, int | bool]) -> str:
    """partial if anything was left out or contradicts, else source_linked_hypotheses."""
    worse = ("groups_omitted", "metrics_omitted", "traces_omitted", "abstained", "dependent_only", "focus_missing", "no_metric_series", "disagreement", "rejected_ids")
    return "partial" if any(counts.get(k) for k in worse) else "source_linked_hypotheses"


def fidelity(shown: Column, source: Column, decoded: Column) -> Column:
    """source_exact, reversible (a lossless coding of the source) or transformed."""
    return F.when(shown == source, "source_exact").when(decoded == source, "reversible").otherwise("transformed")


def packet_cost(text: Column, overhead: int = 64) -> Column:
    """Upper bound of a packet's rendered bytes: what must be escaped takes four."""
    return F.octet_length(F.regexp_replace(text, r"[^\x20-\x7e]", "....")) + overhead
