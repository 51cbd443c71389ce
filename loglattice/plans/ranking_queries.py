"""Queries of rankers, lanes and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglattice.operators import lanes, ranking
from loglattice.operators.corpus import bounded
from loglattice.plans.tables import table

QUESTION = "Why did the registry on node-12 restart after the rollout of cedar-feed? checkpoint quorum lost"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def bm25_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.bm25_affinities(_docs(spark, sf), "doc_id", "text", QUESTION)


def bm25f_rank(spark: SparkSession, sf: str) -> DataFrame:
    return bounded(ranking.bm25f_scores(_docs(spark, sf), "doc_id", "text", QUESTION), [F.desc("score"), F.asc("doc_id")], 100)


FEATURE_ORDER = ("full_match", "identifier_exact", "exact", "matched", "specificity")


def query_feature_hits(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.query_features(_docs(spark, sf), "doc_id", "text", QUESTION)


def query_feature_rank(spark: SparkSession, sf: str) -> DataFrame:
    return bounded(query_feature_hits(spark, sf), [*[F.desc(c) for c in FEATURE_ORDER], F.asc("doc_id")], 100)


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """The best hundred by both rankings, each over all documents it scores."""
    scores = ranking.bm25f_scores(_docs(spark, sf), "doc_id", "text", QUESTION)
    features = query_feature_hits(spark, sf)
    lists = [ranking.full_ranks(scores, "doc_id", ["score"]), ranking.full_ranks(features, "doc_id", FEATURE_ORDER)]
    return bounded(ranking.reciprocal_ranks(lists, "doc_id"), [F.desc("score"), F.asc("doc_id")], 100)


FAILURE = "(?i)error|fatal|panic|critical|exception|failed"
ONSET = "(?i)restart|rollout|config changed"


def _lane_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloudwatch_messages").select("log_stream", "delivery_id", F.coalesce("message", F.lit("")).alias("message"))


def lane_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.boundaries(_lane_rows(spark, sf), "log_stream", "delivery_id", F.col("message").rlike(FAILURE), F.col("message").rlike(ONSET))


def failure_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.failure_ordinals(_lane_rows(spark, sf), "log_stream", "delivery_id", F.col("message").rlike(FAILURE))


def coverage_strata(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.strata(_lane_rows(spark, sf), "delivery_id")


def coverage_midpoints(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.midpoints(_lane_rows(spark, sf), "delivery_id", 7)


def risk_representatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "log_groups").select("role", "group_id")
    return lanes.representatives(rows, "role", "group_id")


def raw_prefix_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lane_rows(spark, sf).select("delivery_id", F.octet_length("message").alias("n_bytes"))
    return lanes.prefix_within(rows, "delivery_id", "n_bytes", 1_000_000)


def provider_correlation_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return lanes.correlation_edges(rows, "user_id", "event_type", "event_id")


def wide_correlation_keys(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.wide_keys(table(spark, sf, "events"), "user_id")


def neighbours_in_lane(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lane_rows(spark, sf).select("log_stream", "delivery_id")
    anchors = rows.where("delivery_id % 20 = 0")  # the query set that is asked for, whole
    return lanes.around(rows, "log_stream", "delivery_id", anchors, 2)


def facet_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How well each question term is covered by the documents, as a facet with its rarity weight."""
    rows = bm25_affinity(spark, sf)
    facets = rows.groupBy(F.col("term").alias("facet_id")).agg(F.max("weight").alias("weight"))
    merged = lanes.merged_affinities([rows.select(F.col("doc_id").alias("block_id"), F.col("term").alias("facet_id"), "affinity")])
    return lanes.facet_coverage(merged, facets, two=True)


def recall_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases: the parts they require, against the parts shipped in quantities over 25."""
    lines = table(spark, sf, "lineitem")
    alternatives = lines.groupBy(F.col("l_orderkey").alias("case_id"), "l_returnflag").agg(F.sum("l_tax").alias("weight"), F.array(F.collect_set("l_partkey")).alias("alternatives"))
    picked = lines.where("l_quantity > 25").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("id"))
    out = ranking.weighted_requirements(alternatives, picked)
    return out.withColumns({c: F.round(c, 6) for c in ("total_weight", "met_weight", "weighted_recall")})


def recall_required(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    cases = lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set("l_partkey").alias("required"))
    return ranking.recall(cases, lines.where("l_quantity > 25").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("id")))


def pareto_skyline(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", (F.col("p_partkey") % 97).alias("p_cost"))
    return ranking.skyline(rows, ["p_retailprice"], ["p_size", "p_cost"])


def paired_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sum("l_quantity").alias("q"), (F.sum(F.round(F.col("l_discount") * 100).cast("long")) > 5 * F.count(F.lit(1))).alias("d"))
    runs = lines.select("case_id", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.col("q") > 100, F.col("d")))).alias("arm", "passed"))
    return ranking.paired_outcomes(runs, "a", "b")


def nearest_rank_p95(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.nearest_rank(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_affinity, bm25f_rank, query_feature_rank, rrf_fuse, lane_boundaries, failure_ordinals, coverage_strata, coverage_midpoints, risk_representatives, raw_prefix_budget,
        provider_correlation_edges, wide_correlation_keys, neighbours_in_lane, facet_coverage, recall_weighted, recall_required, pareto_skyline, paired_counts, nearest_rank_p95,
    )
}


def _list(items) -> str:
    return ", ".join("'" + x + "'" for x in items)


_TERMS = ranking.query_tokens(QUESTION)
_FEATURES = ranking.feature_terms(QUESTION)
_LOW = f"translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
_COUNTS = f"""tok AS (SELECT doc_id, list_filter(regexp_extract_all({_LOW}, '[a-z0-9_.-]+'), lambda t: length(t) <= 64) AS t FROM documents WHERE text IS NOT NULL),
doc AS (SELECT doc_id, len(t)::HUGEINT AS dl, len(list_filter(t, lambda x: regexp_matches(x, '[0-9_.-]')))::HUGEINT AS il, t FROM tok),
st AS (SELECT count(*)::HUGEINT AS n, sum(dl)::HUGEINT AS td, sum(il)::HUGEINT AS ti FROM doc),
q AS (SELECT unnest([{_list(_TERMS)}]) AS term),
hits AS (SELECT doc_id, dl, il, term, len(list_filter(t, lambda x: x = term))::HUGEINT AS tf FROM doc, q WHERE list_contains(t, term)),
df AS (SELECT term, count(*)::HUGEINT AS df FROM hits GROUP BY 1)"""
_BM25 = f"""{_COUNTS},
aff AS (SELECT doc_id, term, tf::BIGINT AS tf, ((10 * td * tf * 1000000) // (10 * td * tf + 3 * td + 9 * dl * n))::BIGINT AS affinity, (1000000 * (n - df + 1) // (n + 1))::BIGINT AS weight FROM hits JOIN df USING (term), st)"""
_BM25F = f"""{_COUNTS},
w AS (
  SELECT doc_id, term, df, n, (tf * 1000000 * 1000000) // (250000 + (dl * 750000 * n) // td)
    + CASE WHEN regexp_matches(term, '[0-9_.-]') THEN (tf * 2000000 * 1000000) // (750000 + (il * 250000 * n) // ti) ELSE 0 END AS w FROM hits JOIN df USING (term), st),
scores AS (SELECT doc_id, sum(((w * 2200000) // (w + 1200000)) * (1000000 + (n - df) * 1000000 // (df + 1)) // 1000000)::BIGINT AS score, count(*) AS matched FROM w GROUP BY 1),
bm25f AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, (SELECT count(*) FROM scores) > 100 AS truncated FROM scores QUALIFY rank <= 100)"""
_SUMS = {
    "identifier_exact": " + ".join(f"(list_contains(t, '{t}'))::BIGINT" for t, i in _FEATURES if i) or "0",
    "exact": " + ".join(f"(list_contains(t, '{t}'))::BIGINT" for t, _ in _FEATURES),
    "matched": " + ".join(f"(contains(low, '{t}'))::BIGINT" for t, _ in _FEATURES),
    "specificity": " + ".join(f"(contains(low, '{t}'))::BIGINT * {len(t)} * greatest(1, 1 + (SELECT count(*) FILTER (NOT contains(low, '{t}')) FROM f))" for t, _ in _FEATURES),
}
_FEATURE_RANK = f"""f AS MATERIALIZED (SELECT doc_id, {_LOW} AS low, regexp_extract_all({_LOW}, '[a-z0-9_./:-]+') AS t FROM documents WHERE text IS NOT NULL),
feat AS (SELECT doc_id, contains(low, '{QUESTION.lower()}') AS full_match, {", ".join(f"({e})::BIGINT AS {c}" for c, e in _SUMS.items())} FROM f),
some_match AS (SELECT * FROM feat WHERE full_match OR matched > 0),
featured AS (SELECT *, row_number() OVER (ORDER BY full_match DESC, identifier_exact DESC, exact DESC, matched DESC, specificity DESC, doc_id) AS rank, (SELECT count(*) FROM some_match) > 100 AS truncated FROM some_match QUALIFY rank <= 100)"""
_F, _O = FAILURE.replace("(?i)", ""), ONSET.replace("(?i)", "")
_MARKED = f"m AS (SELECT log_stream, delivery_id, regexp_matches(lower(coalesce(message, '')), '{_F}') AS f, regexp_matches(lower(coalesce(message, '')), '{_O}') AS o FROM cloudwatch_messages)"
_POSITIONS = "pos AS (SELECT delivery_id, row_number() OVER (ORDER BY delivery_id) - 1 AS position, count(*) OVER () AS n FROM cloudwatch_messages)"

SQL = {
    "bm25_affinity": f"WITH {_BM25} SELECT * FROM aff",
    "bm25f_rank": f"WITH {_BM25F} SELECT doc_id, score, matched, rank, truncated FROM bm25f",
    "query_feature_rank": f"WITH {_FEATURE_RANK} SELECT * FROM featured",
    "rrf_fuse": f"""WITH {_BM25F}, {_FEATURE_RANK},
r1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores),
r2 AS (SELECT doc_id, row_number() OVER (ORDER BY full_match DESC, identifier_exact DESC, exact DESC, matched DESC, specificity DESC, doc_id) AS rank FROM some_match),
fused AS (SELECT doc_id, sum(1000000 // (rank + 60))::BIGINT AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, (SELECT count(*) FROM fused) > 100 AS truncated FROM fused QUALIFY rank <= 100""",
    "lane_boundaries": f"""WITH {_MARKED},
a AS (SELECT log_stream, min(delivery_id) AS head, max(delivery_id) AS tail, min(delivery_id) FILTER (f) AS first_failure, min(delivery_id) FILTER (o) AS first_onset, count(*) FILTER (f) AS n_failures FROM m GROUP BY 1)
SELECT a.*, (SELECT max(delivery_id) FROM m WHERE m.log_stream = a.log_stream AND delivery_id < first_failure) AS before_failure,
  (SELECT max(delivery_id) FROM m WHERE m.log_stream = a.log_stream AND delivery_id < first_onset) AS before_onset FROM a""",
    "failure_ordinals": f"WITH {_MARKED} SELECT log_stream, delivery_id, row_number() OVER (PARTITION BY log_stream ORDER BY delivery_id) - 1 AS ordinal FROM m WHERE f",
    "coverage_strata": f"WITH {_POSITIONS} SELECT delivery_id, position FROM pos WHERE position IN (SELECT i * n // least(8, n) FROM range(8) r(i))",
    "coverage_midpoints": f"WITH {_POSITIONS} SELECT delivery_id, position FROM pos WHERE position IN (SELECT (2 * i + 1) * n // 14 FROM range(7) r(i))",
    "risk_representatives": """WITH p AS (SELECT role, group_id, row_number() OVER (PARTITION BY role ORDER BY group_id) - 1 AS position, count(*) OVER (PARTITION BY role) AS n FROM log_groups)
SELECT role, position, group_id FROM p WHERE position IN (SELECT CASE WHEN n = 1 THEN 0 ELSE i * (n - 1) // (least(n, 5) - 1) END FROM range(5) r(i) WHERE i < least(n, 5))""",
    "raw_prefix_budget": """SELECT delivery_id, n AS cost, used FROM (
  SELECT delivery_id, octet_length(encode(coalesce(message, '')))::BIGINT AS n, sum(octet_length(encode(coalesce(message, '')))) OVER (ORDER BY delivery_id)::BIGINT AS used FROM cloudwatch_messages) WHERE used <= 1000000""",
    "provider_correlation_edges": """SELECT * FROM (SELECT user_id, event_type, event_id AS earlier, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS later
  FROM events WHERE user_id IS NOT NULL) WHERE later IS NOT NULL""",
    "wide_correlation_keys": "SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1 HAVING count(*) > 64",
    "neighbours_in_lane": """WITH p AS (SELECT log_stream, delivery_id, row_number() OVER (PARTITION BY log_stream ORDER BY delivery_id) AS position FROM cloudwatch_messages)
SELECT a.log_stream, a.delivery_id AS anchor, p.delivery_id FROM p a JOIN p ON p.log_stream = a.log_stream AND p.position BETWEEN a.position - 2 AND a.position + 2 WHERE a.delivery_id % 20 = 0""",
    "facet_coverage": f"""WITH {_BM25}, top AS (SELECT term AS facet_id, max(weight) AS weight, list_sum(list(affinity ORDER BY affinity DESC)[1:2])::BIGINT AS coverage FROM aff GROUP BY 1)
SELECT *, weight * coverage AS gain FROM top""",
    "recall_weighted": """WITH r AS (SELECT l_orderkey AS case_id, l_returnflag, sum(l_tax) AS weight, list(DISTINCT l_partkey) AS need FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_orderkey AS case_id, list(DISTINCT l_partkey) AS got FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
s AS (SELECT case_id, sum(weight) AS t, coalesce(sum(weight) FILTER (list_has_all(coalesce(got, []), need)), 0) AS m FROM r LEFT JOIN g USING (case_id) GROUP BY 1)
SELECT case_id, round(t, 6) AS total_weight, round(m, 6) AS met_weight, round(CASE WHEN t <> 0 THEN m / t END, 6) AS weighted_recall FROM s""",
    "recall_required": """WITH r AS (SELECT l_orderkey AS case_id, count(DISTINCT l_partkey) AS n_required, count(DISTINCT l_partkey) FILTER (l_quantity > 25) AS n_found FROM lineitem GROUP BY 1)
SELECT *, n_required = n_found AS complete FROM r""",
    "pareto_skyline": """WITH p AS (SELECT p_partkey, p_retailprice, p_size, p_partkey % 97 AS p_cost FROM part)
SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND b.p_cost <= a.p_cost
  AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size OR b.p_cost < a.p_cost))""",
    "paired_counts": """WITH c AS (SELECT l_orderkey, sum(l_quantity) > 100 AS a, sum(round(l_discount * 100)::BIGINT) > 5 * count(*) AS b FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM c""",
    "nearest_rank_p95": """SELECT l_returnflag, l[ceil(len(l) * 95 / 100)::BIGINT] AS p95 FROM (SELECT l_returnflag, list(l_quantity ORDER BY l_quantity) AS l FROM lineitem GROUP BY 1)""",
}
