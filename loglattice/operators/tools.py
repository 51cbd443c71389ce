"""The five requests a caller makes, as thin functions over the operators.

``logs`` and ``expand`` work on supplied lines, the ``connected`` ones on a
stored index. A connected pack is of one generation: if records came in while
it was put together, it is refused, and the caller asks again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loglattice.operators import analysis, corpus, selection
from loglattice.operators.feedback import VERDICTS, Store
from loglattice.operators.index import Index

CANDIDATES, REPEATED, POOL, BUDGET = 200, 8, 512, 4096
PACK = "position int, group_id long, native_id string, raw string"


class Stale(RuntimeError):
    """The index moved on while an answer was put together."""


def logs(lines: DataFrame, select: selection.Selector = selection.first_ids, budget: int = 32 * 1024) -> DataFrame:
    """Supplied lines (line, raw) -> the exact lines of the chosen groups."""
    return analysis.compact(lines, select, budget)


def expand(lines: DataFrame, line: int, before: int, after: int) -> DataFrame:
    """Lines around one of the supplied ones."""
    return analysis.expand(lines, line, before, after)


def connected_logs(index: Index, task: str, select: selection.Selector = selection.first_ids, budget: int = BUDGET) -> DataFrame:
    """Task -> candidates -> tournament -> the exact first records of the winners that fit the budget, in their order.

    Repeated severe groups are carried through every round. No rows for a task
    nothing matches.
    """
    spark, generation = index.spark, index.generation()
    merged = corpus.merged_candidates([index.lexical_candidates(task, CANDIDATES), corpus.repeated_severe(index.groups(generation), REPEATED)])
    pool = selection.collected(merged.orderBy("rank"), POOL)
    carried = [c["group_id"] for c in sorted(pool, key=lambda c: -c["repeat_count"]) if c["role"] in corpus.SEVERE and c["repeat_count"] > 1][:REPEATED]
    final, _ = selection.tournament(pool, select, [carried])
    wanted = {c["group_id"]: c["first_native_id"] for c in pool if c["group_id"] in set(final)}
    exact = index.records(generation).where(F.col("native_id").isin(sorted(set(wanted.values())))).select("native_id", "raw", F.octet_length("raw").alias("n"))
    by_id = {r["native_id"]: r for r in exact.collect()}  # the final twelve
    taken, _ = selection.pack([(g, by_id[wanted[g]]["n"]) for g in final], budget)
    if index.generation() != generation:
        raise Stale(f"version {generation} is no longer the last")
    rows = [(i, g, wanted[g], by_id[wanted[g]]["raw"]) for i, g in enumerate(taken)]
    return spark.createDataFrame(rows, PACK)


def connected_expand(index: Index, native_id: str, before: int, after: int, max_bytes: int) -> DataFrame:
    """Records around one of the index, in (time, id) order."""
    return corpus.nearby_records(index.records(), native_id, before, after, max_bytes)


def connected_feedback(store: Store, task: str, native_ids: list[str], nonce: str, verdict: int, number: int) -> None:
    """Rates records a task was answered with, 1 or -1."""
    if verdict not in (1, -1):
        raise ValueError("a verdict is 1 or -1")
    store.add_verdicts(store.spark.createDataFrame([(task, i, nonce, verdict) for i in native_ids], VERDICTS), number)
