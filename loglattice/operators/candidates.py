"""Three lanes of candidate evidence over blocks, and their merge.

A lane is two tables: facets (facet_id, kind, weight) and affinities (block_id,
facet_id, affinity); weights and affinities are in millionths. Blocks have a
unique block_id that rises in the order of retrieval, a lane and a text, and
for the third lane any number of correlation keys.

* lexical: the question's terms, weighted by rarity, each block's affinity by
  BM25; and its validated identifiers, which make a block mandatory.
* coverage: failure and onset signals; the first failure and onset of each
  lane and the block before it; head and tail of each lane and of the whole;
  and blocks evenly spaced over the whole. Facets that only spread the choice
  weigh a quarter.
* provider: keys that two or more blocks share; they weigh half, and count
  twice (see ``TOP_TWO``).

Bounds are part of the result: beyond ``Bounds`` a lane is refused, never cut.
Cases: a null or empty text holds nothing but still has its place in its lane;
null keys are none; no blocks give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loglattice.functions.records import ascii_lower, settled
from loglattice.functions.signals import Question, compound_tokens, signals
from loglattice.operators import lanes
from loglattice.operators.ranking import SCALE, div, rarity_weight
from loglattice.operators.selection import NeedsMore
from loglattice.session import cut

STRATA = 8
TOP_TWO = frozenset({"provider_attested_graph_relation"})
COVERAGE_ONLY = frozenset({"source_coverage_stratum", "time_coverage_stratum"})
FACETS, AFFINITIES = "facet_id string, kind string, weight long", "block_id long, facet_id string, affinity long"


class FacetCollision(ValueError):
    """Two lanes give one facet different kinds or weights, or a lane an affinity to no facet."""


@dataclass(frozen=True)
class Bounds:
    """Most blocks an identifier may stand in, blocks identifiers may make mandatory, blocks a key may join; None: any number."""

    identifier_blocks: int | None = 64
    mandatory_blocks: int | None = 64
    key_blocks: int | None = 64


@dataclass(frozen=True)
class Lane:
    facets: DataFrame
    affinities: DataFrame
    mandatory: DataFrame | None = None  # block_id, facet_id


def _refused(n: int, most: int | None, what: str) -> None:
    if most is not None and n > most:
        raise NeedsMore(f"{what}: {n} of at most {most}")


def lexical(blocks: DataFrame, question: Question, bounds: Bounds = Bounds()) -> Lane:
    spark = blocks.sparkSession
    terms = list(question.terms)
    named = [(kind, token) for kind, token in question.identifiers]
    tokens = settled(blocks, ["block_id"], [F.coalesce(compound_tokens(ascii_lower(F.col("text"))), F.array().cast("array<string>")).alias("_ll_t")])

    def times(word: str) -> Column:
        return F.size(F.filter("_ll_t", lambda t: t == word))

    counts = settled(tokens, ["block_id"], [F.size("_ll_t").cast("long").alias("n_tokens"), F.array(*[times(w) for w in [*terms, *[t for _, t in named]]]).cast("array<int>").alias("tf")])
    counts = cut(counts)  # a few numbers per block, read for the statistics and the affinities
    n_all = len(terms) + len(named)
    stats = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0)), *[F.count(F.when(F.col("tf")[i] > 0, 1)) for i in range(n_all)]).first()
    n, total, df = stats[0], stats[1], stats[2:]
    for (_, token), held in zip(named, df[len(terms) :]):
        _refused(held, bounds.identifier_blocks, f"blocks of {token}")
    weights = [("term:" + t, "query_term", rarity_weight(n, d)) for t, d in zip(terms, df)] + [(f"identifier:{k}:{t}", "validated_query_identifier", SCALE) for k, t in named]
    facets = spark.createDataFrame(weights, FACETS)
    names = F.array(*[F.lit(w[0]) for w in weights]) if weights else F.array().cast("array<string>")
    hits = counts.select("block_id", "n_tokens", F.posexplode("tf").alias("i", "f")).where("f > 0")
    base = F.lit(10 * total).cast("decimal(38,0)") * F.col("f")
    bm25 = div(base * SCALE, base + 3 * total + F.col("n_tokens").cast("decimal(38,0)") * 9 * n).cast("long")
    affinity = F.when(F.col("i") < len(terms), bm25).otherwise(F.lit(SCALE).cast("long"))
    found = hits.select("block_id", names[F.col("i")].alias("facet_id"), affinity.alias("affinity"), (F.col("i") >= len(terms)).alias("must"))
    mandatory = found.where("must").select("block_id", "facet_id")
    if named:
        _refused(mandatory.select("block_id").distinct().count(), bounds.mandatory_blocks, "mandatory blocks")
    return Lane(facets, found.where("affinity > 0").select("block_id", "facet_id", "affinity"), mandatory)


def coverage(blocks: DataFrame) -> Lane:
    spark = blocks.sparkSession
    full, part = SCALE, SCALE // 4
    found = cut(signals(blocks, ["block_id", "lane"], "text"))
    marks = lanes.boundaries(found, "lane", "block_id", F.size("failures") > 0, F.size("onsets") > 0)
    kinds = F.concat(
        F.transform("failures", lambda k: F.struct(F.concat(F.lit("failure:"), k).alias("facet_id"), F.lit("failure_role").alias("kind"))),
        F.transform("onsets", lambda k: F.struct(F.concat(F.lit("onset:"), k).alias("facet_id"), F.lit("onset_role").alias("kind"))),
    )
    parts = [found.select("block_id", F.inline(F.array_distinct(kinds)))]
    of_lane = [("head", "lane_head", "source_coverage_stratum"), ("tail", "lane_tail", "source_coverage_stratum")]
    of_lane += [(c, c, "onset_role") for c in ("first_failure", "before_failure", "first_onset", "before_onset")]
    stacked = F.array(*[F.struct(F.col(c).alias("block_id"), F.concat(F.lit(f"{name}:"), "lane").alias("facet_id"), F.lit(kind).alias("kind")) for c, name, kind in of_lane])
    parts.append(marks.select(F.inline(stacked)).where("block_id is not null"))
    ends = blocks.agg(F.min("block_id").alias("a"), F.max("block_id").alias("b"))
    parts.append(ends.select(F.inline(F.array(*[F.struct(F.col(c).alias("block_id"), F.lit(name).alias("facet_id"), F.lit("source_coverage_stratum").alias("kind")) for c, name in (("a", "retrieval_head"), ("b", "retrieval_tail"))]))).where("block_id is not null"))
    spaced = sorted((r["position"], r["block_id"]) for r in lanes.strata(blocks, "block_id", STRATA).collect())
    parts.append(spark.createDataFrame([(b, f"stratum:{i}/{len(spaced)}", "time_coverage_stratum") for i, (_, b) in enumerate(spaced)], "block_id long, facet_id string, kind string"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    union = cut(union.distinct())
    weight = F.when(F.col("kind").isin(*COVERAGE_ONLY), part).otherwise(full).cast("long")
    return Lane(union.select("facet_id", "kind", weight.alias("weight")).distinct(), union.select("block_id", "facet_id", F.lit(SCALE).cast("long").alias("affinity")))


def provider(blocks: DataFrame, keys: str = "keys", bounds: Bounds = Bounds()) -> Lane:
    """keys: an array column of correlation keys."""
    held = blocks.select("block_id", F.explode(F.array_distinct(keys)).alias("key")).where("key is not null")
    shared = held.groupBy("key").agg(F.count_distinct("block_id").alias("n")).where("n > 1")
    if bounds.key_blocks is not None:
        _refused(shared.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], bounds.key_blocks, "blocks of a key")
    name = F.concat(F.lit("relation:"), "key")
    facets = shared.select(name.alias("facet_id"), F.lit("provider_attested_graph_relation").alias("kind"), F.lit(SCALE // 2).cast("long").alias("weight"))
    return Lane(facets, held.join(shared.select("key"), "key", "left_semi").select("block_id", name.alias("facet_id"), F.lit(SCALE).cast("long").alias("affinity")))


def merged(parts: list[Lane]) -> Lane:
    """All lanes as one: facets once, the greatest affinity of a block to each. Raises FacetCollision."""
    facets, affinities, mandatory = parts[0].facets, parts[0].affinities, parts[0].mandatory
    for p in parts[1:]:
        facets, affinities = facets.unionByName(p.facets), affinities.unionByName(p.affinities)
        if p.mandatory is not None:
            mandatory = p.mandatory if mandatory is None else mandatory.unionByName(p.mandatory)
    facets = cut(facets.distinct())
    best = affinities.groupBy("block_id", "facet_id").agg(F.max("affinity").alias("affinity"))
    if facets.groupBy("facet_id").count().where("count > 1").limit(1).count():
        raise FacetCollision("a facet of two lanes")
    best = cut(best)
    if best.join(facets, "facet_id", "left_anti").limit(1).count():
        raise FacetCollision("an affinity to no facet")
    return Lane(facets, best, mandatory)
