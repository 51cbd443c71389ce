"""Sources mixed to target weights, as a curriculum whose weights vary over training time.

Each source has a weight schedule w(t) = share * (1 + tilt * (2t - 1)) over
training time t in [0, 1]. Its integral is the source's cumulative token
demand; a text that covers the source's tokens [c, c + n) gets the time at
which the demand reaches the text's middle, by inverting the integral, and all
texts are range-sorted by that time. The tilts are centred so that all weights
add up to one at any time; at the end every source has its share.

The mixture is as large as it can be with every source at its share and no
text used more often than allowed: total = min over sources of capacity /
share. A larger ``total_tokens`` may be asked for; sources that run out then
fall short, and the report shows it. Prefix sums run in hash buckets, so no
source, however large, meets in one task.

Texts are taken whole, in an order shuffled by hash, as long as they fit a
source's demand; what is then left of it is filled, ``FILLS`` times, with the unused
text that leaves least. So a source that has more unused texts than it is
given misses its demand by less than its shortest unused text, and mostly by
a few tokens.

A text is one text wherever it was posted: exact copies count as one, kept
under the smallest doc_id and its source, and may be used as often as the
strictest source that holds them allows.

Cases: documents with a null doc_id or source, one without target, a null, empty or
token-free text take no part. A source without documents gets nothing, and the
other shares are scaled up to fill the whole (the report keeps the target). A
target whose share or max_repeats is null or not above zero takes no part; of
several targets of a source the smallest share and max_repeats hold.
Doc ids must be unique; ties in size or time are broken by hash and doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from loglattice.llm import tokens
from loglattice.operators.prefix import running_sums
from loglattice.session import written

BUCKET_ROWS = 50_000  # rows of a prefix-sum bucket, about
MOST_TARGETS = 10_000
MOST_PASSES = 100_000  # sources times passes over their texts; more are refused
FILLS = 3
TILT = 0.5


@dataclass(frozen=True)
class Source:
    name: str
    share: float  # of the mixture
    demand: float  # tokens
    passes: tuple[float, ...]  # tokens used before the first, second, ... pass
    tilt: float


def one_target_each(targets: DataFrame) -> DataFrame:
    """Of several targets of a source the smallest share and the smallest max_repeats hold."""
    return targets.groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def targets_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """share and max_repeats by source; the table is read by the driver and its size checked."""
    rows = one_target_each(targets).where("source is not null and target_share > 0 and max_repeats > 0").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return {r[0]: (r[1], r[2]) for r in rows}


def sized_texts(documents: DataFrame, targets: dict[str, tuple[float, int]], raw: bytes | None = None) -> DataFrame:
    """doc_id, source, n_tokens, cap: one row per distinct text that takes part."""
    spark = documents.sparkSession
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("cap", T.IntegerType())])
    caps = spark.createDataFrame([(s, c) for s, (_, c) in sorted(targets.items())], schema)
    rows = documents.select("doc_id", "source", "text").where("doc_id is not null and text is not null and text <> ''").join(F.broadcast(caps), "source")  # at most MOST_TARGETS rows
    sized = tokens.sizes(rows.withColumn("same", F.sha2(F.col("text"), 256)), "text", ["doc_id", "source", "cap", "same"], raw)
    first = F.min(F.struct("doc_id", "source", "n_tokens")).alias("first")
    return sized.where("n_tokens > 0").groupBy("same").agg(first, F.min("cap").alias("cap")).select("first.*", "cap")


def plan_sources(by_cap: list[tuple[str, int, int, int]], targets: dict[str, tuple[float, int]], total_tokens: int | None = None, tilt: float = TILT) -> list[Source]:
    """by_cap: (source, cap, texts, tokens). The plan has one entry per source that has any tokens."""
    held: dict[str, dict[int, tuple[int, int]]] = {}
    for source, cap, n, size in by_cap:
        held.setdefault(source, {})[cap] = (n, size)
    whole = sum(targets[s][0] for s in held)
    shares = {s: targets[s][0] / whole for s in held}
    capacity = {s: sum(cap * size for cap, (_, size) in caps.items()) for s, caps in held.items()}
    total = total_tokens if total_tokens is not None else min((capacity[s] / shares[s] for s in held), default=0)
    # short texts first: the schedule rises with a source's mean size
    order = sorted(held, key=lambda s: (sum(x for _, x in held[s].values()) / sum(n for n, _ in held[s].values()), s))
    rank = {s: (i + 0.5) / len(order) - 0.5 for i, s in enumerate(order)}
    centre = sum(shares[s] * rank[s] for s in order)
    out, planned = [], 0
    for s in sorted(held):
        demand = float(min(total * shares[s], capacity[s]))
        passes, used, k = [], 0.0, 1
        while used < demand and k <= max(held[s]):
            passes.append(used)
            used += sum(size for cap, (_, size) in held[s].items() if cap >= k)
            k += 1
            planned += 1
            if planned > MOST_PASSES:
                raise ValueError(f"more than {MOST_PASSES} passes over sources")
        out.append(Source(s, shares[s], demand, tuple(passes), max(-1.0, min(1.0, 2 * tilt * (rank[s] - centre)))))
    return out


def training_time(covered, tilt):
    """Time at which a source's demand reaches the part ``covered`` of the whole: the schedule's integral inverted."""
    level = F.lit(1.0) - tilt
    return 2 * covered / (level + F.sqrt(level * level + 4 * tilt * covered))


def chosen_uses(texts: DataFrame, plan: list[Source], seed: int = 0) -> DataFrame:
    """doc_id, source, use_no, n_tokens and training time t of each use of a text."""
    spark = texts.sparkSession
    schema = "source string, use_no int, used double, demand double, tilt double"
    passes = spark.createDataFrame([(s.name, k, used, s.demand, s.tilt) for s in plan for k, used in enumerate(s.passes, 1)], schema)
    buckets = max(1, texts.count() // BUCKET_ROWS)
    uses = texts.join(F.broadcast(passes), "source").where("use_no <= cap")  # at most MOST_TARGETS times the largest cap, and only as many passes as are needed
    uses = uses.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "use_no")).withColumn("hb", F.pmod(F.shiftright("h", 7), F.lit(buckets)))
    placed = running_sums(uses, ["source", "use_no"], "hb", ["h", "doc_id"], {"in_pass": "n_tokens"})
    placed = placed.withColumn("covered", F.col("used") + F.col("in_pass")).select("doc_id", "source", "use_no", "n_tokens", "covered", "demand", "tilt", "h")
    placed = written(placed, "placed")  # read for what fits and by each fill
    fits = F.col("covered") + F.col("n_tokens") <= F.col("demand")
    taken = placed.where(fits).withColumn("middle", F.col("covered") + F.col("n_tokens") / 2).drop("covered", "h")
    left = {r[0]: r[1] for r in taken.groupBy("source").agg(F.max("demand") - F.sum("n_tokens")).collect()}  # one row per source
    left = {s.name: left.get(s.name, s.demand) for s in plan}
    spare = placed.where(~fits)
    fills: list[tuple] = []
    for _ in range(FILLS):
        gaps = spark.createDataFrame(sorted(left.items()), "source string, gap double")
        used = spark.createDataFrame([f[:3] for f in fills], "doc_id long, source string, use_no int")
        free = spare.join(F.broadcast(used), ["doc_id", "source", "use_no"], "left_anti").join(F.broadcast(gaps), "source").where("n_tokens < 2 * gap")  # at most a row per source and fill
        best = free.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("n_tokens")).alias("off"), "use_no", "h", "doc_id", "n_tokens", "demand", "tilt", "gap")).alias("b"))
        rows = best.select("b.doc_id", "source", "b.use_no", "b.n_tokens", "b.demand", "b.tilt", (F.col("b.demand") - F.col("b.gap") / 2).alias("middle")).collect()  # one row per source
        for r in rows:
            fills.append(tuple(r))
            left[r["source"]] -= r["n_tokens"]
        if not rows:
            break
    added = spark.createDataFrame(fills, taken.select("doc_id", "source", "use_no", "n_tokens", "demand", "tilt", "middle").schema)
    whole = taken.select(*added.columns).unionByName(added)
    return whole.select("doc_id", "source", "use_no", "n_tokens", training_time(F.col("middle") / F.col("demand"), F.col("tilt")).alias("t"))


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tilt: float = TILT, seed: int = 0, raw: bytes | None = None) -> DataFrame:
    """position, doc_id, source, use_no, n_tokens, token_start and t of each use, sorted by position."""
    uses = planned_uses(documents, targets, total_tokens, tilt, seed, raw)
    buckets = max(1, uses.count() // BUCKET_ROWS)
    timed = uses.withColumn("tb", F.least(F.floor(F.col("t") * buckets), F.lit(buckets - 1))).withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    placed = running_sums(timed, ["all"], "tb", ["t", "source", "doc_id", "use_no"], {"position": "one", "token_start": "n_tokens"})
    return placed.select("position", "doc_id", "source", "use_no", "n_tokens", "token_start", "t").orderBy("position")


def planned_uses(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tilt: float = TILT, seed: int = 0, raw: bytes | None = None) -> DataFrame:
    wanted = targets_of(targets)
    texts = written(sized_texts(documents, wanted, raw), "texts")
    by_cap = texts.groupBy("source", "cap").agg(F.count(F.lit(1)), F.sum("n_tokens")).collect()  # sources times caps: bounded by the targets
    plan = plan_sources([tuple(r) for r in by_cap], wanted, total_tokens, tilt)
    return written(chosen_uses(texts, plan, seed), "uses")


def shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source what it was to get and what it got."""
    got = uses.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_uses"), F.countDistinct("doc_id").alias("n_texts"), F.max("use_no").alias("most_uses"))
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    out = one_target_each(targets).join(got, "source", "left")
    out = out.withColumn("actual_share", F.coalesce(F.col("n_tokens") / total, F.lit(0.0)))
    return out.select("source", "target_share", "actual_share", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_tokens", "n_uses", "n_texts", "most_uses")], "max_repeats")
