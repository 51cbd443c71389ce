"""Whole pipelines that end in a bounded choice, and framing; checked by tests rather than SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglattice.operators import corpus, framing, lanes, ranking, selection, tools
from loglattice.plans import corpus_queries, ranking_queries, views
from loglattice.plans.tables import table
from loglattice.session import cut

BUDGET = 4096


def exact_lines(spark: SparkSession, sf: str) -> DataFrame:
    return framing.split_lines(table(spark, sf, "documents"), "doc_id", "text")


def framing_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the documents' lines; a document is a lane."""
    return framing.frame(exact_lines(spark, sf), "doc_id", "seq", "payload")


def skip_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Per service those of its severe groups, newest first, that fit a byte budget; cost is 40 bytes a repeat."""
    cards = corpus.severe(table(spark, sf, "log_groups")).withColumn("cost", 40 * F.col("repeat_count"))
    return selection.skip_packing_by(cards, "service", [("last_timestamp_millis", True), ("group_id", True)], "group_id", "cost", BUDGET)


def tournament_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Task -> candidates -> tournament by severity -> exact first records within the byte budget."""
    return tools.connected_logs(views.index(spark, sf), corpus_queries.TASK, selection.gravest, BUDGET)


def selection_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Documents chosen to cover the question's terms within a byte budget, out of all that hold any of them."""
    rows = ranking_queries.bm25_affinity(spark, sf)
    terms = ranking.query_tokens(ranking_queries.QUESTION)
    of = [F.max(F.when(F.col("term") == t, F.col("affinity"))) for t in terms]
    facets = rows.groupBy("doc_id").agg(F.array(*[F.coalesce(a, F.lit(0).cast("long")) for a in of]).alias("affinities"))
    sized = table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("cost"))
    packets = cut(facets.join(sized.where(F.col("cost") <= BUDGET), "doc_id").select(F.col("doc_id").alias("id"), F.col("cost").cast("long").alias("cost"), "affinities"))
    weights = {r["term"]: r["weight"] for r in rows.groupBy("term").agg(F.max("weight").alias("weight")).collect()}  # one row per term
    chosen = selection.select_rows(packets, [weights.get(t, 0) for t in terms], BUDGET)
    return spark.createDataFrame(sorted(chosen.items()), "doc_id long, cost long")


PAGE_ROWS = 1000
HEAD, TAIL, SPACED = 50, 50, 32  # documents of the head and tail lanes, and evenly spaced ones


def quota_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Head, tail, all by question and evenly spaced documents under one byte budget."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.octet_length("text").alias("cost"))
    head = [r[0] for r in docs.orderBy("doc_id").limit(HEAD).collect()]
    tail = [r[0] for r in docs.orderBy(F.desc("doc_id")).limit(TAIL).collect()]
    even = sorted(r["doc_id"] for r in selection.collected(lanes.midpoints(docs, "doc_id", SPACED), SPACED))
    costs = {r[0]: r[1] for r in docs.where(F.col("doc_id").isin(sorted({*head, *tail, *even}))).collect()}
    place = F.struct(*[(-F.col(c).cast("long")).alias(c) for c in ranking_queries.FEATURE_ORDER], F.col("doc_id"))
    ranked = cut(ranking_queries.query_feature_hits(spark, sf).join(docs, "doc_id").select(place.alias("place"), "doc_id", "cost"))

    def page(after: tuple | None, left: int, most: int = PAGE_ROWS) -> list:
        rows = ranked.where(F.col("cost") <= left)
        if after is not None:
            rows = rows.where(F.col("place") > F.struct(*[F.lit(x).cast("long") for x in after]))
        return [(tuple(r["place"]), r["doc_id"], r["cost"]) for r in rows.orderBy("place").limit(most).collect()]

    first = page(None, 2**31, max(len(head), len(tail), len(even)))
    chosen = selection.quota_hybrid_paged(page, first, 8000, [(head, 4000), (tail, 4000), (even, 4000)], costs, 24_000)
    return spark.createDataFrame(list(chosen.items()), "doc_id long, cost long")


QUERIES = {f.__name__: f for f in (exact_lines, framing_blocks, skip_packing, tournament_pack, selection_greedy, quota_hybrid)}
_GRAVE = "CASE role WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'change' THEN 3 ELSE 4 END"
SQL = {
    "tournament_pack": f"""WITH RECURSIVE {corpus_queries._HITS.replace(f"QUALIFY rank <= {corpus_queries.LIMIT}", "QUALIFY rank <= 200")}, {views.RECORDS_SQL},
repeated AS (SELECT row_number() OVER (ORDER BY repeat_count DESC, group_id) AS rank, group_id FROM groups WHERE role IN ('critical', 'error', 'warning') AND repeat_count > 1 QUALIFY rank <= 8),
lists AS (SELECT CASE WHEN rank = 1 THEN 0 ELSE 2 END AS phase, rank AS pos, group_id FROM lexical UNION ALL SELECT 1, rank, group_id FROM repeated),
once AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY phase, pos) = 1),
pool AS (SELECT row_number() OVER (ORDER BY phase, pos) AS rank, group_id, role, repeat_count, first_native_id FROM once JOIN groups USING (group_id)),
carried AS (SELECT group_id, row_number() OVER (ORDER BY repeat_count DESC, rank) AS pos FROM pool WHERE role IN ('critical', 'error', 'warning') AND repeat_count > 1 QUALIFY pos <= 8),
winners AS (SELECT group_id, (rank - 1) // 64 AS page, row_number() OVER (PARTITION BY (rank - 1) // 64 ORDER BY {_GRAVE}, rank) AS pos FROM pool QUALIFY pos <= 8),
kept AS (SELECT 0 AS part, 0 AS page, pos, group_id FROM carried UNION ALL SELECT 1, page, pos, group_id FROM winners),
one AS (SELECT group_id, row_number() OVER (ORDER BY part, page, pos) AS pos FROM (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY part, page, pos) = 1)),
last AS (SELECT group_id, pos FROM one WHERE (SELECT count(*) FROM pool) > 64 UNION ALL SELECT group_id, rank FROM pool WHERE (SELECT count(*) FROM pool) <= 64),
final AS (SELECT row_number() OVER (ORDER BY {_GRAVE}, pos) AS i, group_id, native_id, raw, octet_length(encode(raw))::BIGINT AS n
  FROM last JOIN pool USING (group_id) JOIN records ON native_id = first_native_id QUALIFY i <= 12),
go AS (SELECT 0::BIGINT AS i, {BUDGET}::BIGINT AS room, 0 AS k, NULL::BIGINT AS taken
  UNION ALL SELECT f.i, CASE WHEN n <= room THEN room - n ELSE room END, CASE WHEN n <= room THEN k + 1 ELSE k END, CASE WHEN n <= room THEN f.group_id END FROM go JOIN final f ON f.i = go.i + 1)
SELECT (k - 1)::INTEGER AS position, taken AS group_id, native_id, raw FROM go JOIN final ON group_id = taken""",
    "skip_packing": f"""WITH RECURSIVE s AS (
  SELECT service, group_id, 40 * repeat_count AS cost, row_number() OVER (PARTITION BY service ORDER BY last_timestamp_millis DESC, group_id DESC) AS n
  FROM log_groups WHERE role IN ('critical', 'error', 'warning') AND service IS NOT NULL),
r AS (
  SELECT DISTINCT service, 0::BIGINT AS n, {BUDGET}::BIGINT AS room, NULL::BIGINT AS taken FROM s
  UNION ALL SELECT s.service, s.n, CASE WHEN cost <= room THEN room - cost ELSE room END, CASE WHEN cost <= room THEN s.group_id END FROM r JOIN s ON s.service = r.service AND s.n = r.n + 1)
SELECT service, taken AS group_id FROM r WHERE taken IS NOT NULL""",
    "exact_lines": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
u AS (SELECT doc_id, p, unnest(range(len(p))) AS seq FROM s),
x AS (SELECT doc_id, seq, p[seq + 1] AS raw, seq = len(p) - 1 AS tail FROM u)
SELECT doc_id, seq, CASE WHEN NOT tail AND ends_with(raw, chr(13)) THEN left(raw, -1) ELSE raw END AS payload,
  CASE WHEN tail THEN NULL WHEN ends_with(raw, chr(13)) THEN chr(13) || chr(10) ELSE chr(10) END AS terminator FROM x WHERE NOT (tail AND raw = '')""",
}
