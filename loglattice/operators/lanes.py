"""Ordered analytics over lanes: boundaries, strata, neighbours by key, budgets.

A lane may hold a third of all rows, so nothing here sorts a lane in one task:
boundaries are aggregates, and positions come from bucketed running sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglattice.operators.prefix import dense_ids, running_sums
from loglattice.session import cut

BLOCK = 4096


def positions(rows: DataFrame, keys: list[str], seq: str, name: str = "position") -> DataFrame:
    """0-based position of each row within its keys by ``seq`` (a unique non-negative number)."""
    if not keys:  # numbered by ranges: no task sees more than its own rows and one row per task
        return dense_ids(rows, name, [seq]).withColumn(name, F.col(name) - 1)
    marked = rows.withColumns({"_ll_all": F.lit(0), "_ll_bucket": F.expr(f"{seq} div {BLOCK}"), "_ll_one": F.lit(1).cast("long")})
    return running_sums(marked, [*keys, "_ll_all"], "_ll_bucket", [seq], {name: "_ll_one"}).drop("_ll_all", "_ll_bucket", "_ll_one")


def boundaries(rows: DataFrame, lane: str, seq: str, failure: Column, onset: Column) -> DataFrame:
    """Per lane: head, tail, first failure and the row before it, first onset and the row before it, number of failures."""
    base = rows.select(lane, F.col(seq).alias("seq"), failure.alias("f"), onset.alias("o"))
    firsts = cut(base.groupBy(lane).agg(
        F.min("seq").alias("head"), F.max("seq").alias("tail"), F.min(F.when(F.col("f"), F.col("seq"))).alias("first_failure"), F.min(F.when(F.col("o"), F.col("seq"))).alias("first_onset"), F.count(F.when(F.col("f"), 1)).alias("n_failures")
    ))  # one row per lane, read below twice
    marks = firsts.select(lane, "first_failure", "first_onset")
    before = base.select(lane, "seq").join(marks, lane).groupBy(lane).agg(
        F.max(F.when(F.col("seq") < F.col("first_failure"), F.col("seq"))).alias("before_failure"), F.max(F.when(F.col("seq") < F.col("first_onset"), F.col("seq"))).alias("before_onset")
    )
    return firsts.join(before, lane)


def failure_ordinals(rows: DataFrame, lane: str, seq: str, failure: Column) -> DataFrame:
    """Each failure with its ordinal in its lane (from 0)."""
    return positions(rows.where(failure).select(lane, seq), [lane], seq, "ordinal")


def strata(rows: DataFrame, seq: str, most: int = 8) -> DataFrame:
    """Rows at the positions i * n div k, i = 0 .. k-1, with k = min(most, n)."""
    return _at(rows, seq, lambda n: [i * n // min(most, n) for i in range(min(most, n))])


def midpoints(rows: DataFrame, seq: str, k: int) -> DataFrame:
    """Rows at the positions (2i + 1) * n div 2k."""
    return _at(rows, seq, lambda n: sorted({(2 * i + 1) * n // (2 * k) for i in range(k)}))


def _at(rows: DataFrame, seq: str, places) -> DataFrame:
    n = rows.count()
    wanted = places(n) if n else []
    return positions(rows.select(seq), [], seq).where(F.col("position").isin(wanted))


def representatives(rows: DataFrame, kind: str, seq: str, most: int = 5) -> DataFrame:
    """At most ``most`` rows of each kind, spread evenly from its first to its last: offsets i * (n - 1) div (k - 1)."""
    placed = positions(rows.select(kind, seq), [kind], seq)
    sizes = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("_ll_n"))
    k = F.least(F.col("_ll_n"), F.lit(most))
    offsets = F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.when(k == 1, 0).otherwise(F.call_function("div", i * (F.col("_ll_n") - 1), F.greatest(k - 1, F.lit(1)))))
    return placed.join(sizes.select(kind, F.explode(offsets).alias("position")).distinct(), [kind, "position"])


def prefix_within(rows: DataFrame, seq: str, cost: str, budget: int) -> DataFrame:
    """The longest prefix by ``seq`` whose cost stays within the budget, with ``used`` after each row."""
    marked = rows.select(seq, F.col(cost).cast("long").alias("cost")).withColumns({"_ll_all": F.lit(0), "_ll_bucket": F.expr(f"{seq} div {BLOCK}")})
    run = running_sums(marked, ["_ll_all"], "_ll_bucket", [seq], {"used": "cost"})
    return run.select(seq, "cost", (F.col("used") + F.col("cost")).alias("used")).where(F.col("used") <= budget)


def correlation_edges(rows: DataFrame, key: str, lane: str, seq: str) -> DataFrame:
    """Edges between consecutive rows of a lane that share a key, for keys of any size.

    Windows see at most ``BLOCK`` numbers of ``seq`` (unique); between these
    blocks only the first and last row of each meet.
    """
    ours = rows.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).select(key, lane, seq, F.expr(f"{seq} div {BLOCK}").alias("_ll_bucket"))
    after = F.lead(seq).over(Window.partitionBy(key, lane, "_ll_bucket").orderBy(seq))
    inside = ours.select(key, lane, F.col(seq).alias("earlier"), after.alias("later"))
    ends = ours.groupBy(key, lane, "_ll_bucket").agg(F.min(seq).alias("_ll_first"), F.max(seq).alias("earlier"))
    across = ends.select(key, lane, "earlier", F.lead("_ll_first").over(Window.partitionBy(key, lane).orderBy("_ll_bucket")).alias("later"))
    return inside.unionByName(across).where("later is not null")


def wide_keys(rows: DataFrame, key: str, most: int = 64) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > most)


def around(rows: DataFrame, lane: str, seq: str, anchors: DataFrame, n: int) -> DataFrame:
    """Rows of an anchor's lane at most n positions before or after it. anchors: lane and seq."""
    placed = positions(rows.select(lane, seq), [lane], seq)
    at = placed.join(anchors.select(lane, seq), [lane, seq]).select(lane, F.col(seq).alias("anchor"), F.explode(F.sequence(F.col("position") - n, F.col("position") + n)).alias("position"))
    return placed.join(at, [lane, "position"]).select(lane, "anchor", seq)


def around_within(rows: DataFrame, lane: str, seq: str, size: str, anchors: DataFrame, n: int, most_bytes: int) -> DataFrame:
    """As ``around`` with whole rows within a byte budget per anchor: the anchor, then the ones before it from the nearest on, then the ones after.

    A side stops at the first row that doesn't fit; an anchor that alone passes
    the budget has no rows. Groups have at most 2n + 1 rows.
    """
    near = around(rows, lane, seq, anchors, n).join(rows.select(lane, seq, size), [lane, seq])
    offset = F.row_number().over(Window.partitionBy(lane, "anchor", "side").orderBy(F.abs(F.col(seq) - F.col("anchor"))))
    sided = near.withColumn("side", F.sign(F.col(seq) - F.col("anchor")).cast("int"))
    along = Window.partitionBy(lane, "anchor", "side").orderBy(F.abs(F.col(seq) - F.col("anchor"))).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(lane, "anchor")
    summed = sided.withColumns({"used": F.sum(size).over(along), "offset": offset})
    own = F.max(F.when(F.col("side") == 0, F.col(size))).over(whole)
    summed = summed.withColumn("own", own).withColumn("left", F.lit(most_bytes) - F.col("own"))
    before = F.coalesce(F.max(F.when((F.col("side") < 0) & (F.col("used") <= F.col("left")), F.col("used"))).over(whole), F.lit(0))
    fits = F.when(F.col("side") == 0, F.col("left") >= 0).when(F.col("side") < 0, F.col("used") <= F.col("left")).otherwise(F.col("used") + F.col("before") <= F.col("left"))
    return summed.withColumn("before", before).where((F.col("left") >= 0) & fits).select(lane, "anchor", seq)


def merged_affinities(lanes: Sequence[DataFrame]) -> DataFrame:
    """Facet affinities of several lanes: the greatest per (block, facet)."""
    union = lanes[0]
    for x in lanes[1:]:
        union = union.unionByName(x)
    return union.groupBy("block_id", "facet_id").agg(F.max("affinity").alias("affinity"))


def facet_coverage(affinities: DataFrame, facets: DataFrame, two: bool = False) -> DataFrame:
    """Per facet its coverage by the blocks given: the best affinity, or the sum of the best two; times its weight."""
    ranked = affinities.withColumn("_ll_n", F.row_number().over(Window.partitionBy("facet_id").orderBy(F.desc("affinity"), F.asc("block_id"))))
    cov = ranked.where(F.col("_ll_n") <= (2 if two else 1)).groupBy("facet_id").agg(F.sum("affinity").alias("coverage"))
    return facets.join(cov, "facet_id", "left").select("facet_id", "weight", F.coalesce("coverage", F.lit(0)).alias("coverage"), (F.col("weight") * F.coalesce("coverage", F.lit(0))).alias("gain"))
