"""Running sums and dense numbers over a whole table without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglattice.session import cut


def running_sums(rows: DataFrame, keys: list[str], bucket: str, order: list, sums: dict[str, str], totals: bool = False) -> DataFrame:
    """Adds <name> = sum of a column over all earlier rows of the keys, in (bucket, order), and <name>_total if asked for.

    Buckets are ordered and each fits a task; between them only one row per
    key and bucket is summed. ``order`` must be total within a bucket. Keys
    mustn't be null.
    """
    per = rows.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"_ll_sum_{n}") for n, c in sums.items()])
    along = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    added = [F.sum(f"_ll_sum_{n}").over(whole).alias(f"{n}_total") for n in sums] if totals else []
    before = per.select(*keys, bucket, *[F.coalesce(F.sum(f"_ll_sum_{n}").over(along), F.lit(0)).alias(f"_ll_before_{n}") for n in sums], *added)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(before, [*keys, bucket])
    return joined.select(*rows.columns, *[f"{n}_total" for n in sums if totals], *[(F.col(f"_ll_before_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])


STEPS, ACCURACY = 256, 10_000


def order_statistics(rows: DataFrame, keys: list[str], value: str, row_id: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows at given ranks of each key, exactly: ``n`` and per name a struct (value, id).

    ``wanted`` maps a name to the 0-based rank as an expression of n, in the
    order of (value, id). Rows with a null key or value take no part. A sketch
    per key bounds the value at each rank from both sides; rows below the bounds
    are only counted, and only those between them (about a hundredth of a key's
    rows, and more where values repeat) are sorted. The sketch decides what is
    sorted, not the result. The rows are read three times: pass them cut where
    they are costly.
    """
    some = rows.select(*keys, F.col(value).alias("_ll_v"), F.col(row_id).alias("_ll_i")).dropna(subset=[*keys, "_ll_v"])
    steps = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    sketch = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_ll_v", steps, F.lit(ACCURACY)).alias("_ll_e"))

    def band(k: int, at: Callable[[Column], Column]) -> Column:
        rank = at(F.col("n")).cast("long")
        step = F.call_function("div", rank * STEPS, F.col("n")).cast("int")
        low = F.when(step > 1, F.get("_ll_e", step - 2))
        high = F.when(step < STEPS - 3, F.get("_ll_e", step + 3))
        return F.struct(F.lit(k).alias("_ll_k"), rank.alias("_ll_rank"), low.alias("low"), high.alias("high"))

    bands = sketch.select(*keys, "n", F.array(*[band(k, at) for k, at in enumerate(wanted.values())]).alias("_ll_b"))
    v = F.col("_ll_v")
    joined = some.join(bands, keys)
    below = joined.groupBy(*keys).agg(F.first("n").alias("n"), F.array(*[F.count_if(v < F.col("_ll_b")[k]["low"]) for k in range(len(wanted))]).alias("_ll_below"))
    inside = F.filter("_ll_b", lambda b: (b["low"].isNull() | (v >= b["low"])) & (b["high"].isNull() | (v <= b["high"])))
    near = joined.select(*keys, "_ll_v", "_ll_i", F.inline(F.transform(inside, lambda b: F.struct(b["_ll_k"].alias("_ll_k"), b["_ll_rank"].alias("_ll_rank")))))
    placed = near.withColumn("_ll_turn", F.row_number().over(Window.partitionBy(*keys, "_ll_k").orderBy("_ll_v", "_ll_i")))
    hit = placed.join(below, keys).where(F.col("_ll_turn") - 1 + F.get("_ll_below", F.col("_ll_k")) == F.col("_ll_rank"))
    pick = [F.max(F.when(F.col("_ll_k") == k, F.struct(v.alias("value"), F.col("_ll_i").alias("id")))).alias(name) for k, name in enumerate(wanted)]
    return hit.groupBy(*keys).agg(F.first("n").alias("n"), *pick)


def medians(rows: DataFrame, keys: list[str], value: str, row_id: str) -> DataFrame:
    """keys, n, exact ``median`` and ``example``: the id of the upper middle row."""
    upper = lambda n: F.call_function("div", n, F.lit(2))
    lower = lambda n: F.call_function("div", n - 1, F.lit(2))
    found = order_statistics(rows, keys, value, row_id, {"lo": lower, "hi": upper})
    return found.select(*keys, "n", ((F.col("lo.value").cast("double") + F.col("hi.value").cast("double")) / 2).alias("median"), F.col("hi.id").alias("example"))


def dense_ids(rows: DataFrame, name: str, order: list[str | Column]) -> DataFrame:
    """Numbers rows from 1 in an order that is total: sorted by ranges over as many tasks as there are, which then only need their counts."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_ll_part": F.spark_partition_id(), "_ll_i": F.monotonically_increasing_id()})
    ordered = cut(ordered)  # the ranges must be the same for counts and rows
    counts = ordered.groupBy("_ll_part").agg(F.count(F.lit(1)).alias("_ll_n"), F.min("_ll_i").alias("_ll_low"))
    before = F.coalesce(F.sum("_ll_n").over(Window.orderBy("_ll_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per task
    first = counts.select("_ll_part", (before - F.col("_ll_low") + 1).alias("_ll_shift"))
    return ordered.join(F.broadcast(first), "_ll_part").withColumn(name, (F.col("_ll_i") + F.col("_ll_shift")).cast("long")).drop("_ll_part", "_ll_i", "_ll_shift")  # one row per task
