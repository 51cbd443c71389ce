"""Blocks of a large retrieval reduced to as many as the later, bounded steps can take.

A retrieval that fits one partition stays whole. Otherwise blocks with an
identifier of the question, and blocks evenly spaced over all, are kept; the
rest is added by score, skipping what no longer fits the working bytes, until
there are enough. The score adds up the rarity of the question's terms a block
holds, and twice the number of blocks if it holds a failure word.

Cases: a null text holds no word and no bytes. Ties go to the smaller block_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loglattice.functions.records import ascii_lower, settled
from loglattice.functions.signals import Question
from loglattice.operators import lanes
from loglattice.operators.selection import skip_packing_by
from loglattice.session import cut

# Words that mark a block as failed.
FAILURE_WORDS = "error exception failed fatal panic traceback".split()
STRATA = 8


@dataclass(frozen=True)
class Capacity:
    blocks: int = 4096
    partition_bytes: int = 32 << 20
    working_bytes: int = 7 << 20


def scored(blocks: DataFrame, question: Question) -> DataFrame:
    """block_id, n_bytes, score and mandatory; blocks: block_id, text."""
    words = F.array_distinct(F.split(ascii_lower(F.col("text")), "[^a-z0-9_-]"))
    base = settled(blocks, ["block_id"], [F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(words, F.array().cast("array<string>")).alias("w")])
    has = lambda w: F.array_contains("w", w)
    failed = F.arrays_overlap("w", F.array(*map(F.lit, FAILURE_WORDS)))
    must = F.lit(False)
    for _, token in question.identifiers:
        must = must | has(token)
    flags = cut(base.select("block_id", "n_bytes", failed.alias("failed"), must.alias("mandatory"), F.array(*[has(t) for t in question.terms]).cast("array<boolean>").alias("t")))
    stats = flags.agg(F.count(F.lit(1)), *[F.count_if(F.col("t")[i]) for i in range(len(question.terms))]).first()
    n = stats[0]
    score: Column = F.when(F.col("failed"), 2 * max(n, 1)).otherwise(0).cast("long")
    for i, df in enumerate(stats[1:]):
        score = score + F.when(F.col("t")[i], n - df + 1).otherwise(0)
    return flags.select("block_id", "n_bytes", score.alias("score"), "mandatory")


def reduced(blocks: DataFrame, question: Question, capacity: Capacity = Capacity()) -> DataFrame:
    """block_id and ``reason``: whole, mandatory, stratum or ranked."""
    rows = scored(blocks, question)
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    if n <= 1 or (n <= capacity.blocks and size <= capacity.partition_bytes):
        return rows.select("block_id", F.lit("whole").alias("reason"))
    spaced = [r["block_id"] for r in lanes.midpoints(blocks, "block_id", STRATA).collect()]
    reason = F.when(F.col("mandatory"), "mandatory").when(F.col("block_id").isin(spaced), "stratum")
    first = rows.where("mandatory").orderBy("block_id").limit(capacity.blocks).unionByName(rows.where(~F.col("mandatory") & F.col("block_id").isin(spaced))).withColumn("reason", reason)
    taken, used = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    rest = rows.where(~F.col("mandatory") & ~F.col("block_id").isin(spaced)).withColumn("all", F.lit(0))
    room, left = max(0, capacity.blocks - taken), max(-1, capacity.working_bytes - used)
    added = skip_packing_by(rest, "all", [("score", True), ("block_id", False)], "block_id", "n_bytes", left, page=capacity.blocks, most=room)
    return first.select("block_id", "reason").unionByName(added.select("block_id", F.lit("ranked").alias("reason")))
