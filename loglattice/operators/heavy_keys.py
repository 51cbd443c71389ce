"""Per-key results when a few keys hold most records.

Fragment-replicate by estimated load. A mergeable frequent-items sketch over
the key column estimates each large key's load; keys are packed into tasks
(largest first, least-filled task), a key larger than its fair part is split
into proportionate shards, and the other side of a join is replicated only to
the shards of its own key. Light keys keep plain hash placement.

The sketch decides placement only. Results are exact whatever it estimates.

Cases: a null key is one key of its own, reported as null (it never matches in
a join). An empty table gives an empty result. Repeated rows count each time.
Columns the operator adds begin with ``_ll_`` so that extra columns of any
other name may clash with nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loglattice.session import cut, partitions_of

#: A key is split once its load passes this part of one task's fair load.
SPLIT_AT = 0.5


@dataclass(frozen=True)
class LoadPlan:
    """Where rows of each key go.

    shards: routing key -> task of each of its shards; holds large keys only,
    so at most ``tasks / SPLIT_AT`` entries whatever the table's size.
    """

    tasks: int
    total_rows: int
    sums: dict[str, int | float | None]
    shards: dict[str, list[int]] = field(default_factory=dict)
    task_load: list[float] = field(default_factory=list)


def routing_key(key: str | Column) -> Column:
    col = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.concat(F.lit("v"), col.cast("string")), F.lit("n"))


def pack(loads: dict[str, int], total: int, tasks: int) -> tuple[dict[str, list[int]], list[float]]:
    """Bin-packs large keys; returns their shards' tasks and each task's expected load."""
    fair = max(1.0, total / tasks)
    large = {k: n for k, n in loads.items() if n > SPLIT_AT * fair}
    light = max(0, total - sum(large.values()))
    heap = [(light / tasks, t) for t in range(tasks)]
    heapq.heapify(heap)
    pieces = []
    for key, n in large.items():
        parts = min(tasks, math.ceil(n / (SPLIT_AT * fair)))
        pieces += [(n / parts, key, i) for i in range(parts)]
    shards: dict[str, list[int]] = {}
    for load, key, _ in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        filled, task = heapq.heappop(heap)
        heapq.heappush(heap, (filled + load, task))
        shards.setdefault(key, []).append(task)
    out = [0.0] * tasks
    for filled, task in heap:
        out[task] = filled
    return shards, out


def plan_loads(rows: DataFrame, key: str, sums: Sequence[str] = (), tasks: int | None = None) -> LoadPlan:
    """Estimates loads in one pass over the key column; exact row count and sums come along."""
    tasks = tasks or max(2, partitions_of(rows.sparkSession))
    most = min(100_000, math.ceil(tasks / SPLIT_AT))
    tracked = min(1_000_000, max(1024, 8 * most))
    row = rows.select(routing_key(key).alias("_ll_k"), *[F.col(c) for c in sums]).agg(
        F.expr(f"approx_top_k(_ll_k, {most}, {tracked})").alias("top"),
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"sum_{i}") for i, c in enumerate(sums)],
    ).first()
    loads = {x["item"]: x["count"] for x in row["top"] or [] if x["item"] is not None}
    shards, filled = pack(loads, row["n"], tasks)
    return LoadPlan(tasks, row["n"], {c: row[f"sum_{i}"] for i, c in enumerate(sums)}, shards, filled)


def _with_shards(df: DataFrame, key: Column, plan: LoadPlan) -> DataFrame:
    schema = T.StructType([T.StructField("_ll_k", T.StringType()), T.StructField("_ll_tasks", T.ArrayType(T.IntegerType()))])
    shards = df.sparkSession.createDataFrame(sorted(plan.shards.items()), schema)
    # at most tasks / SPLIT_AT rows: LoadPlan's bound
    return df.withColumn("_ll_k", key).join(F.broadcast(shards), "_ll_k", "left")


def _light_task(plan: LoadPlan) -> Column:
    return F.pmod(F.xxhash64("_ll_k"), F.lit(plan.tasks)).cast("int")


def fragment(df: DataFrame, key: str | Column, spread: Column, plan: LoadPlan) -> DataFrame:
    """Gives each row its task in ``_ll_task``; rows of a split key spread over its shards by ``spread``."""
    task = F.coalesce(
        F.try_element_at("_ll_tasks", (F.pmod(F.xxhash64(spread), F.size("_ll_tasks")) + 1).cast("int")),
        _light_task(plan),
    )
    return _with_shards(df, routing_key(key), plan).withColumn("_ll_task", task).drop("_ll_tasks")


def replicate(df: DataFrame, key: str | Column, plan: LoadPlan) -> DataFrame:
    """Copies each row to the tasks that hold a shard of its key, and to those only."""
    tasks = F.coalesce("_ll_tasks", F.array(_light_task(plan)))
    return _with_shards(df, routing_key(key), plan).withColumn("_ll_task", F.explode(F.array_distinct(tasks))).drop("_ll_tasks")


def place(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """Moves rows to the partition named by ``_ll_task``."""
    return df.repartitionById(plan.tasks, "_ll_task")


def partial_totals(rows: DataFrame, key: str, sums: Sequence[str] = ()) -> DataFrame:
    """One row per key ``k`` and input task ``piece``: n_rows, and sum_<column> and some_<column> (its non-null rows) of each.

    The engine combines each task's rows before any moves, so a key that holds
    a third of all rows leaves as many rows as there are input tasks.
    """
    narrow = rows.select(F.col(key).cast("string").alias("k"), F.spark_partition_id().alias("piece"), *[F.col(c).cast("long").alias(f"v_{i}") for i, c in enumerate(sums)])
    of = [x for i, c in enumerate(sums) for x in (F.coalesce(F.sum(f"v_{i}"), F.lit(0)).alias(f"sum_{c}"), F.count(f"v_{i}").alias(f"some_{c}"))]
    return narrow.groupBy("k", "piece").agg(F.count(F.lit(1)).alias("n_rows"), *of)


def _totals(rows: DataFrame, key: str, sums: Sequence[str]) -> tuple[DataFrame, LoadPlan]:
    """Per key its totals, and the plan by which they were made, with the sums of all keys.

    What the plan loads, packs and splits are the partial rows, for these are
    the rows that are placed.
    """
    names = ["n_rows"] + [x for c in sums for x in (f"sum_{c}", f"some_{c}")]
    partial = cut(partial_totals(rows, key, sums))  # read by the plan and by what it places; about as many rows as keys times input tasks
    plan = plan_loads(partial, "k", names)
    placed = place(fragment(partial, "k", F.col("piece"), plan), plan)
    per_shard = placed.groupBy("_ll_task", "k").agg(*[F.sum(n).alias(n) for n in names])
    merged = per_shard.groupBy("k").agg(*[F.sum(n).alias(n) for n in names])
    return merged, plan


def key_totals(rows: DataFrame, key: str, sums: Sequence[str] = ()) -> DataFrame:
    """Per key its row count ``n_rows`` and ``sum_<column>`` of each integer column in ``sums``.

    Rows are combined in their input tasks, the partial rows go to the tasks the
    plan packs their keys into, and the few shards of a split key are merged
    last. A null in a summed column adds nothing; a key whose values are all
    null gets a null sum.
    """
    merged, _ = _totals(rows, key, sums)
    return merged.select(F.col("k").alias(key), "n_rows", *[F.when(F.col(f"some_{c}") > 0, F.col(f"sum_{c}")).alias(f"sum_{c}") for c in sums])


def fragment_replicate_join(rows: DataFrame, other: DataFrame, key: str, spread: Sequence[str], how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """Equi-join on ``key`` (a column of both); ``how`` is inner, left, left_semi or left_anti.

    The rows of a large key are split over its shards by a hash of the
    ``spread`` columns; the other side's rows of that key are copied to those
    shards only. Both sides may share further column names: the other side's
    are kept under ``other_<name>``, with as many ``other_`` as it takes.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of a split key can't be joined {how}")
    plan = plan or plan_loads(rows, key)
    taken, names = set(rows.columns), {}
    for c in other.columns:
        name = c
        while c != key and name in taken:
            name = f"other_{name}"
        names[c] = name
        taken.add(name)
    right = other.select([F.col(c).alias(n) for c, n in names.items()]).where(F.col(key).isNotNull())
    # both sides go to the partitions the plan names; the join needs no exchange beyond these
    left = place(fragment(rows, key, F.struct(*spread), plan).drop("_ll_k"), plan)
    right = place(replicate(right, key, plan).drop("_ll_k"), plan)
    return left.join(right, ["_ll_task", key], how).drop("_ll_task")


def heavy_keys(rows: DataFrame, key: str, share: tuple[int, int], sums: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Keys holding at least share[0]/share[1] of all rows, and of each summed column; compared exactly.

    Gives a frame with the column ``heavy_key`` for ``rows`` and for each name
    in ``sums``. Null keys and keys with a null sum aren't reported; a whole of
    zero or less has no heavy keys.
    """
    merged, plan = _totals(rows, key, sums)
    totals = merged.where("k is not null")
    if sums:
        totals = cut(totals)  # one row per key, read for each measure
    part, whole = share
    found = {}
    for name, column, some in [("rows", "n_rows", "n_rows"), *((c, f"sum_{c}", f"some_{c}") for c in sums)]:
        total = int(plan.sums[column] or 0)
        own = F.col(column).cast("decimal(38,0)") * whole >= F.lit(str(part * total)).cast("decimal(38,0)")
        found[name] = totals.where(own & (F.col(some) > 0) & F.lit(total > 0)).select(F.col("k").alias("heavy_key"))
    return found
