"""Queries over template groups, terms, edges, records and feedback, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglattice.functions import records as fn
from loglattice.operators import corpus, dedup
from loglattice.operators.index import Index
from loglattice.plans import views
from loglattice.plans.tables import table
from loglattice.session import work_folder

TASK = "Why did the purchase request fail with an error upstream of svc-3? Show failed requests"
LIMIT = 40
SEEDS = ("svc-1", "svc-2")
ANCHOR_ID = "500"
CARD_SQL = ", ".join(corpus.CARD)


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """The stored group cards as one corpus."""
    return table(spark, sf, "log_groups")


def parse_records(spark: SparkSession, sf: str) -> DataFrame:
    return views.parsed(spark, sf).drop("raw")


def parse_layouts(spark: SparkSession, sf: str) -> DataFrame:
    return fn.parse_records(views.layout_records(spark, sf), "raw").select("native_id", "service", "role", "fingerprint", "ts_seconds")


def template_groups(spark: SparkSession, sf: str) -> DataFrame:
    return views.groups(spark, sf)


def group_terms(spark: SparkSession, sf: str) -> DataFrame:
    return views.index(spark, sf).terms().select("group_id", "term")


def group_members(spark: SparkSession, sf: str) -> DataFrame:
    return views.index(spark, sf).group_members()


def lexical_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return views.index(spark, sf).lexical_candidates(TASK, LIMIT)


def task_match_strength(spark: SparkSession, sf: str) -> DataFrame:
    return views.index(spark, sf).task_match_strength(TASK)


def lexical_records(spark: SparkSession, sf: str) -> DataFrame:
    """Exact first records of the lexical candidates: only the winners' bytes are fetched."""
    found = lexical_candidates(spark, sf).select("rank", "group_id", F.col("first_native_id").alias("native_id"))
    return views.records(spark, sf).join(F.broadcast(found), "native_id").select("rank", "group_id", "native_id", F.octet_length("raw").cast("long").alias("n_bytes"))  # at most LIMIT rows


def repeated_severe(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.repeated_severe(cards(spark, sf), LIMIT)


def severe_newest(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.severe_by_time(cards(spark, sf), LIMIT)


def severe_oldest(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.severe_by_time(cards(spark, sf), LIMIT, newest=False)


ANCHOR_MS = 1_673_200_000_000


def severe_from_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.severe_from_anchor(cards(spark, sf), ANCHOR_MS, LIMIT)


def severe_service_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.severe_service_summary(cards(spark, sf))


def service_directory(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.service_directory(cards(spark, sf), "c", 32)


def service_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.service_interleave(cards(spark, sf), "quota-gate", 15)


def service_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.service_representatives(cards(spark, sf), 9)


def candidate_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.candidate_representatives(cards(spark, sf), 16)


def priority_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.priority_fallback(cards(spark, sf), 64)


def merged_candidates(spark: SparkSession, sf: str) -> DataFrame:
    index = views.index(spark, sf)
    return corpus.merged_candidates([index.lexical_candidates(TASK, LIMIT), corpus.repeated_severe(index.groups(), 8)]).select("rank", "group_id")


def edge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return views.index(spark, sf).evidence()


def service_edges(spark: SparkSession, sf: str) -> DataFrame:
    return views.index(spark, sf).edges()


def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return views.index(spark, sf).graph_neighbours(SEEDS, 64)


def record_page(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.record_page(views.records(spark, sf), (1_704_200_000_000, "7"), 256, 20_000)


def record_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.record_of(views.index(spark, sf).records(), ANCHOR_ID).select("native_id", "ts_ms", F.octet_length("raw").cast("long").alias("n_bytes"))


def group_page(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.page_after(views.groups(spark, sf).select(*corpus.CARD), ["group_id"], [100], 256)


def edge_page(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.page_after(views.index(spark, sf).edges(), ["source_service", "target_service"], ["svc-1", "svc-12"], 32)


def evidence_page(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the records that support one edge."""
    mine = views.index(spark, sf).evidence().where("source_service = 'svc-1' and target_service = 'svc-9'").select("native_id")
    return corpus.page_after(mine, ["native_id"], ["2"], 8)


def stream_upsert_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of an index that took its records in three batches, in order of time."""
    own = Index(spark, work_folder(spark, "index"))
    for i, part in enumerate(dedup.in_batches(views.records(spark, sf), "ts_ms", 3)):
        own.add(part, i)
    return own.groups()


def nearby_records(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.nearby_records(views.records(spark, sf), ANCHOR_ID, 20, 20, 4_000)


def record_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Heads and tails of the decoded records; null bytes give nulls."""
    raw = F.unbase64(F.translate(F.regexp_replace("raw_base64", "[^A-Za-z0-9+/_-]", ""), "-_", "+/"))
    rows = table(spark, sf, "source_records").select(F.col("record_no").alias("native_id"), raw.alias("raw"))
    return corpus.record_samples(rows, 12).select("native_id", F.hex("prefix").alias("prefix"), F.hex("suffix").alias("suffix"), "n_bytes")


def missing_members(spark: SparkSession, sf: str) -> DataFrame:
    indexed = views.members(spark, sf).where("role <> 'change'")
    return corpus.missing_members(views.records(spark, sf), indexed).select("native_id")


def insert_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of a message against its first one."""
    rows = table(spark, sf, "cloudwatch_messages").where("event_id is not null").select("delivery_id", F.col("event_id").alias("native_id"), F.col("event_timestamp_millis").alias("ts_ms"), F.coalesce("message", F.lit("")).alias("raw"))
    first = rows.groupBy("native_id").agg(F.min(F.struct("delivery_id", "ts_ms", "raw")).alias("f")).select("native_id", "f.*")
    again = rows.join(first.select("delivery_id"), "delivery_id", "left_anti")
    return corpus.insert_outcome(first, again).select("delivery_id", "outcome")


def sensitive_screen(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fn.is_sensitive(F.col("text")).alias("is_sensitive"))


def safe_samples(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    sample = fn.safe_sample(F.substring(text, 1, 120), F.right(text, F.lit(120)), F.octet_length(text), 90)
    return table(spark, sf, "documents").select("doc_id", sample.alias("sample"))


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("event_type <> 'view'")
    verdict = F.when(F.col("user_id") % 40 == 0, -1).otherwise(1)
    return rows.select(F.col("event_id").cast("string").alias("native_id"), (F.col("user_id") % 5).alias("nonce"), verdict.alias("verdict"))


def feedback_standing(spark: SparkSession, sf: str) -> DataFrame:
    baseline = lexical_candidates(spark, sf)
    return corpus.feedback_standing(_observations(spark, sf), group_members(spark, sf), baseline)


def shadow_bonus(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("event_type in ('error', 'purchase')")
    labels = rows.select(F.col("event_id").cast("string").alias("native_id"), (F.col("event_id") % 60).alias("case_id"), F.when(F.col("event_id") % 31 == 0, -1).otherwise(1).alias("label"))
    terms = labels.select("case_id").distinct().select("case_id", F.when(F.col("case_id") % 2 == 0, "purchase").otherwise("other").alias("term"))
    return corpus.shadow_bonus(labels, group_members(spark, sf), terms, TASK, most_rows=1_000_000)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("event_type in ('error', 'purchase')")
    return rows.select(F.col("event_id").cast("string").alias("native_id"), (F.col("event_id") % 60).alias("case_id"), F.when(F.col("event_id") % 31 == 0, -1).otherwise(1).alias("label"))


def shadow_bonus_rule(spark: SparkSession, sf: str) -> DataFrame:
    """As shadow_bonus under its own bound: no bonus at all where a task matches more than 4,096 label rows. Every case is on the task."""
    labels = _labels(spark, sf)
    terms = labels.select("case_id").distinct().select("case_id", F.lit("purchase").alias("term"))
    return corpus.shadow_bonus(labels, group_members(spark, sf), terms, TASK)


def promoted_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of the records that were rated well."""
    return corpus.promoted_groups(_observations(spark, sf).where("verdict = 1"), group_members(spark, sf))


def labels_digest(spark: SparkSession, sf: str) -> DataFrame:
    index = views.index(spark, sf)
    return corpus.labels_digest(_labels(spark, sf), index.group_members(), index.groups())


def term_digests(spark: SparkSession, sf: str) -> DataFrame:
    return views.index(spark, sf).terms().select("group_id", F.sha2("term", 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_records, parse_layouts, template_groups, group_terms, group_members, lexical_candidates, task_match_strength, lexical_records, repeated_severe, severe_newest, severe_oldest,
        severe_from_anchor, severe_service_summary, service_directory, service_interleave, service_representatives, candidate_representatives, priority_fallback, merged_candidates,
        edge_evidence, service_edges, graph_neighbours, record_page, record_lookup, group_page, edge_page, evidence_page, stream_upsert_parity, nearby_records, record_samples, missing_members, insert_outcome, sensitive_screen, safe_samples, feedback_standing, shadow_bonus, shadow_bonus_rule, promoted_groups, labels_digest, term_digests,
    )
}

_TERMS = ", ".join(f"'{t}'" for t in fn.search_terms_of(TASK, corpus.QUERY_TERMS))
_SEVERE = "role IN ('critical', 'error', 'warning')"
_HITS = f"""{views.TERMS_SQL},
hits AS (SELECT group_id, count(*) AS matches FROM terms WHERE term IN ({_TERMS}) GROUP BY 1),
lexical AS (
  SELECT row_number() OVER (ORDER BY matches DESC, {views.ROLE_RANK_SQL}, last_timestamp_millis DESC, group_id DESC) AS rank, {CARD_SQL}, matches,
    (SELECT count(*) FROM hits) > {LIMIT} AS truncated
  FROM hits JOIN groups USING (group_id) QUALIFY rank <= {LIMIT})"""


def _top(where: str, order: str, limit: int, source: str = "log_groups") -> str:
    return f"""SELECT row_number() OVER (ORDER BY {order}) AS rank, {CARD_SQL}, (SELECT count(*) FROM {source} WHERE {where}) > {limit} AS truncated
FROM {source} WHERE {where} QUALIFY rank <= {limit}"""


_SUMMARY = f"""summary AS (
  SELECT service, count(*) AS group_count, min((last_timestamp_millis, group_id))[2] AS oldest_group_id, max((last_timestamp_millis, group_id))[2] AS newest_group_id
  FROM log_groups WHERE {_SEVERE} GROUP BY 1)"""


def _representatives(n: int) -> str:
    return f"""{_SUMMARY},
chosen AS (
  SELECT 0 AS phase, row_number() OVER (ORDER BY group_count, service) AS pos, * FROM summary QUALIFY pos <= {(n + 1) // 2}
  UNION ALL SELECT 1, row_number() OVER (ORDER BY group_count DESC, service DESC) AS pos, * FROM summary QUALIFY pos <= {n // 2}),
ends AS (SELECT phase, pos, 0 AS stream, oldest_group_id AS group_id FROM chosen UNION ALL SELECT phase, pos, 1, newest_group_id FROM chosen),
representatives AS (
  SELECT row_number() OVER (ORDER BY phase, pos, stream) AS rank, group_id FROM (
    SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY phase, pos, stream) = 1))"""


_FALLBACK = 64
_ENDS = _FALLBACK // 3
_PER = -(-(_FALLBACK - 2 * _ENDS) // 8)
_STREAMS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT 1 AS phase, row_number() OVER (ORDER BY last_timestamp_millis, group_id) AS pos, {i} AS stream, group_id FROM severe, span WHERE last_timestamp_millis >= lo + (hi - lo) * {part} // 9) WHERE pos <= {_PER}"
    for i, part in enumerate(corpus.ANCHOR_PARTS, 2)
)

SQL = {
    "parse_layouts": views.LAYOUTS_SQL,
    "parse_records": f"WITH {views.MEMBERS_SQL} SELECT native_id, ts_ms, service, role, fingerprint, ts_seconds, peer FROM members",
    "template_groups": f"WITH {views.GROUPS_SQL} SELECT * FROM groups",
    "group_terms": f"WITH {views.TERMS_SQL} SELECT * FROM terms",
    "group_members": f"WITH {views.GROUPS_SQL} SELECT native_id, group_id FROM members JOIN groups USING (service, role, fingerprint)",
    "lexical_candidates": f"WITH {_HITS} SELECT * FROM lexical",
    "task_match_strength": f"""WITH {_HITS} SELECT {len(fn.search_terms_of(TASK, 32))}::BIGINT AS n_terms, coalesce(max(matches), 0) AS best_matches,
  NOT ({len(fn.search_terms_of(TASK, 32))} >= 3 AND 3 * coalesce(max(matches), 0) >= 2 * {len(fn.search_terms_of(TASK, 32))}) AS is_weak FROM hits""",
    "repeated_severe": _top(f"{_SEVERE} AND repeat_count > 1", "repeat_count DESC, group_id", LIMIT),
    "severe_newest": _top(_SEVERE, "last_timestamp_millis DESC, group_id DESC", LIMIT),
    "severe_oldest": _top(_SEVERE, "last_timestamp_millis, group_id", LIMIT),
    "severe_from_anchor": _top(f"{_SEVERE} AND last_timestamp_millis >= {ANCHOR_MS}", "last_timestamp_millis, group_id", LIMIT),
    "severe_service_summary": f"WITH {_SUMMARY} SELECT * FROM summary",
    "service_directory": f"""WITH {_SUMMARY}
SELECT s.service, group_count, o.first_native_id AS oldest_native_id, n.last_native_id AS newest_native_id, (SELECT count(*) FROM summary WHERE service > 'c') > 32 AS has_more
FROM (SELECT * FROM summary WHERE service > 'c' ORDER BY service LIMIT 32) s
JOIN log_groups o ON o.group_id = oldest_group_id JOIN log_groups n ON n.group_id = newest_group_id""",
    "service_interleave": f"""WITH own AS (SELECT * FROM log_groups WHERE service = 'quota-gate' AND {_SEVERE}),
sides AS (
  SELECT row_number() OVER (ORDER BY last_timestamp_millis, group_id) AS pos, 0 AS stream, group_id FROM own QUALIFY pos <= 8
  UNION ALL SELECT row_number() OVER (ORDER BY last_timestamp_millis DESC, group_id DESC) AS pos, 1, group_id FROM own QUALIFY pos <= 8),
once AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY pos, stream) = 1),
ranked AS (SELECT row_number() OVER (ORDER BY pos, stream) AS rank, group_id FROM once)
SELECT rank, {CARD_SQL}, (SELECT count(*) FROM own) > 15 AS truncated FROM ranked JOIN own USING (group_id) WHERE rank <= 15""",
    "service_representatives": f"WITH {_representatives(9)} SELECT rank, {CARD_SQL} FROM representatives JOIN log_groups USING (group_id)",
    "candidate_representatives": """WITH best AS (
  SELECT source_id, service, count(*) AS n_candidates, min((CASE role WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, repeat_count, group_id))[3] AS group_id
  FROM log_groups WHERE service NOT IN ('', 'unknown') GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY n_candidates, source_id, service) AS rank, (SELECT count(*) FROM best) > 16 AS truncated FROM best QUALIFY rank <= 16""",
    "priority_fallback": f"""WITH {_representatives(_FALLBACK // 8)},
severe AS (SELECT * FROM log_groups WHERE {_SEVERE}),
span AS (SELECT min(last_timestamp_millis) AS lo, max(last_timestamp_millis) AS hi FROM severe),
newest AS (SELECT row_number() OVER (ORDER BY last_timestamp_millis DESC, group_id DESC) AS pos, group_id FROM severe),
oldest AS (SELECT row_number() OVER (ORDER BY last_timestamp_millis, group_id) AS pos, group_id FROM severe),
streams AS (
  SELECT 0 AS phase, rank AS pos, 0 AS stream, group_id FROM representatives
  UNION ALL SELECT 1, pos, 0, group_id FROM oldest WHERE pos <= {_ENDS}
  UNION ALL SELECT 1, pos, 1, group_id FROM newest WHERE pos <= {_ENDS}
  UNION ALL {_STREAMS}
  UNION ALL SELECT 2, pos, 0, group_id FROM newest WHERE pos > {_ENDS} AND pos <= {_FALLBACK + 1}),
once AS (SELECT * FROM streams QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY phase, pos, stream) = 1),
ranked AS (SELECT row_number() OVER (ORDER BY phase, pos, stream) AS rank, group_id FROM once),
short AS (SELECT (SELECT count(*) FROM severe) <= {_FALLBACK} AS fits)
SELECT rank, {CARD_SQL}, true AS truncated FROM ranked JOIN log_groups USING (group_id), short WHERE rank <= {_FALLBACK} AND NOT fits
UNION ALL SELECT pos AS rank, {CARD_SQL}, false FROM newest JOIN log_groups USING (group_id), short WHERE fits""",
    "merged_candidates": f"""WITH {_HITS},
repeated AS (SELECT row_number() OVER (ORDER BY repeat_count DESC, group_id) AS rank, group_id FROM groups WHERE {_SEVERE} AND repeat_count > 1 QUALIFY rank <= 8),
lists AS (SELECT CASE WHEN rank = 1 THEN 0 ELSE 2 END AS phase, rank AS pos, group_id FROM lexical UNION ALL SELECT 1, rank, group_id FROM repeated),
once AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY phase, pos) = 1)
SELECT row_number() OVER (ORDER BY phase, pos) AS rank, group_id FROM once""",
    "edge_evidence": f"WITH {views.MEMBERS_SQL} SELECT native_id, ts_ms, service AS source_service, peer AS target_service FROM members WHERE peer IS NOT NULL AND peer <> service",
    "service_edges": f"""WITH {views.MEMBERS_SQL}
SELECT service AS source_service, peer AS target_service, count(*) AS evidence_count, min((ts_ms, native_id))[1] AS first_timestamp_millis, min((ts_ms, native_id))[2] AS first_native_id,
  max((ts_ms, native_id))[1] AS last_timestamp_millis, max((ts_ms, native_id))[2] AS last_native_id FROM members WHERE peer IS NOT NULL AND peer <> service GROUP BY 1, 2""",
    "graph_neighbours": f"""WITH {views.GROUPS_SQL},
near AS (SELECT peer AS service FROM members WHERE service IN {SEEDS} AND peer IS NOT NULL AND peer <> service UNION SELECT service FROM members WHERE peer IN {SEEDS} AND peer <> service),
cards AS (SELECT * FROM groups WHERE service IN (SELECT service FROM near) AND service NOT IN {SEEDS})
{_top("true", f"{views.ROLE_RANK_SQL}, last_timestamp_millis DESC, group_id DESC", 64, "cards")}""",
    "lexical_records": f"""WITH {_HITS}, {views.RECORDS_SQL}
SELECT rank, group_id, native_id, octet_length(encode(raw))::BIGINT AS n_bytes FROM lexical JOIN records ON native_id = first_native_id""",
    "record_page": f"""WITH {views.RECORDS_SQL},
rest AS (SELECT ts_ms, native_id, octet_length(encode(raw))::BIGINT AS n_bytes FROM records WHERE (ts_ms, native_id) > (1704200000000, '7')),
page AS (SELECT *, sum(n_bytes) OVER (ORDER BY ts_ms, native_id)::BIGINT AS used_bytes FROM rest ORDER BY ts_ms, native_id LIMIT 256)
SELECT *, (SELECT count(*) FROM rest) > (SELECT count(*) FROM page WHERE used_bytes <= 20000) AS has_more FROM page WHERE used_bytes <= 20000""",
    "record_lookup": f"WITH {views.RECORDS_SQL} SELECT native_id, ts_ms, octet_length(encode(raw))::BIGINT AS n_bytes FROM records WHERE native_id = '{ANCHOR_ID}'",
    "group_page": f"WITH {views.GROUPS_SQL} SELECT {CARD_SQL}, (SELECT count(*) FROM groups WHERE group_id > 100) > 256 AS has_more FROM groups WHERE group_id > 100 ORDER BY group_id LIMIT 256",
    "edge_page": f"""WITH {views.MEMBERS_SQL},
edges AS (SELECT service AS source_service, peer AS target_service, count(*) AS evidence_count, min((ts_ms, native_id)) AS f, max((ts_ms, native_id)) AS l
  FROM members WHERE peer IS NOT NULL AND peer <> service AND (service, peer) > ('svc-1', 'svc-12') GROUP BY 1, 2)
SELECT source_service, target_service, evidence_count, f[1] AS first_timestamp_millis, f[2] AS first_native_id, l[1] AS last_timestamp_millis, l[2] AS last_native_id,
  (SELECT count(*) FROM edges) > 32 AS has_more FROM edges ORDER BY 1, 2 LIMIT 32""",
    "evidence_page": f"""WITH {views.MEMBERS_SQL}, e AS (SELECT native_id FROM members WHERE service = 'svc-1' AND peer = 'svc-9' AND native_id > '2')
SELECT native_id, (SELECT count(*) FROM e) > 8 AS has_more FROM e ORDER BY 1 LIMIT 8""",
    "stream_upsert_parity": f"WITH {views.GROUPS_SQL} SELECT * FROM groups",
    "nearby_records": f"""WITH {views.RECORDS_SQL},
sized AS (SELECT ts_ms, native_id, octet_length(encode(raw))::BIGINT AS n_bytes FROM records),
anchor AS (SELECT * FROM sized WHERE native_id = '{ANCHOR_ID}'),
before AS (
  SELECT *, sum(n_bytes) OVER (ORDER BY n) AS used FROM (
    SELECT s.*, row_number() OVER (ORDER BY s.ts_ms DESC, s.native_id DESC) AS n FROM sized s, anchor a WHERE (s.ts_ms, s.native_id) < (a.ts_ms, a.native_id))),
earlier AS (SELECT b.* FROM before b, anchor a WHERE n <= 20 AND used <= 4000 - a.n_bytes),
after AS (
  SELECT *, sum(n_bytes) OVER (ORDER BY n) AS used FROM (
    SELECT s.*, row_number() OVER (ORDER BY s.ts_ms, s.native_id) AS n FROM sized s, anchor a WHERE (s.ts_ms, s.native_id) > (a.ts_ms, a.native_id))),
later AS (SELECT f.* FROM after f, anchor a WHERE n <= 20 AND used <= 4000 - a.n_bytes - (SELECT coalesce(max(used), 0) FROM earlier)),
found AS (
  SELECT ts_ms, native_id, n_bytes, -n AS "offset" FROM earlier UNION ALL SELECT ts_ms, native_id, n_bytes, 0 FROM anchor UNION ALL SELECT ts_ms, native_id, n_bytes, n FROM later)
SELECT *, (SELECT count(*) FROM before) > (SELECT count(*) FROM earlier) AS before_truncated, (SELECT count(*) FROM after) > (SELECT count(*) FROM later) AS after_truncated FROM found""",
    "record_samples": """WITH r AS (SELECT record_no, translate(regexp_replace(raw_base64, '[^A-Za-z0-9+/_-]', '', 'g'), '-_', '+/') AS b FROM source_records),
d AS (SELECT record_no, hex(from_base64(rpad(b, ((length(b) + 3) // 4 * 4)::INTEGER, '='))) AS h FROM r)
SELECT record_no AS native_id, left(h, 24) AS prefix, right(h, 24) AS suffix, (length(h) // 2)::BIGINT AS n_bytes FROM d""",
    "safe_samples": f"""WITH s AS (
  SELECT doc_id, text, regexp_matches(translate(left(text, 120) || chr(1) || right(text, 120), '{fn.UPPER}', '{fn.LOWER}'), '{"|".join(fn.SENSITIVE_PHRASES)}|"(?:{"|".join(fn.SENSITIVE_KEYS)})"\\s*:') AS bad FROM documents)
SELECT doc_id, CASE WHEN bad THEN '{fn.OMITTED}' WHEN length(text) <= 90 THEN text WHEN text IS NOT NULL THEN left(text, 24) || '{fn.MIDDLE}' || right(text, 48) END AS sample FROM s""",
    "missing_members": f"WITH {views.MEMBERS_SQL} SELECT native_id FROM members WHERE role = 'change'",
    "insert_outcome": """WITH d AS (
  SELECT delivery_id, event_timestamp_millis AS ms, coalesce(message, '') AS raw, row_number() OVER w AS rn, first_value(event_timestamp_millis) OVER w AS ms1, first_value(coalesce(message, '')) OVER w AS raw1
  FROM cloudwatch_messages WHERE event_id IS NOT NULL WINDOW w AS (PARTITION BY event_id ORDER BY delivery_id))
SELECT delivery_id, CASE WHEN ms = ms1 AND raw = raw1 THEN 'duplicate' ELSE 'conflict' END AS outcome FROM d WHERE rn > 1""",
    "sensitive_screen": f"""SELECT doc_id, regexp_matches(translate(text, '{fn.UPPER}', '{fn.LOWER}'), '{"|".join(fn.SENSITIVE_PHRASES)}|"(?:{"|".join(fn.SENSITIVE_KEYS)})"\\s*:') AS is_sensitive FROM documents""",
    "feedback_standing": f"""WITH {_HITS},
gm AS (SELECT native_id, group_id, event_type, user_id FROM members JOIN groups USING (service, role, fingerprint)),
st AS (
  SELECT group_id, count(DISTINCT user_id % 5) FILTER (user_id % 40 <> 0) AS n_positive, count(*) FILTER (user_id % 40 = 0) AS n_negative FROM gm WHERE event_type <> 'view' GROUP BY 1)
SELECT *, n_positive >= 3 AND n_negative = 0 AND group_id NOT IN (SELECT group_id FROM lexical) AS eligible FROM st""",
    "shadow_bonus": f"""WITH {views.GROUPS_SQL},
hit AS (
  SELECT DISTINCT group_id, native_id::BIGINT % 60 AS case_id, CASE WHEN native_id::BIGINT % 31 = 0 THEN -1 ELSE 1 END AS label
  FROM members JOIN groups USING (service, role, fingerprint) WHERE event_type IN ('error', 'purchase') AND native_id::BIGINT % 60 % 2 = 0)
SELECT group_id, least(count(DISTINCT case_id) FILTER (label = 1), 4) AS bonus FROM hit GROUP BY 1
HAVING count(DISTINCT case_id) FILTER (label = 1) >= 2 AND count(*) FILTER (label = -1) = 0""",
    "shadow_bonus_rule": f"""WITH {views.GROUPS_SQL},
hit AS (
  SELECT DISTINCT group_id, native_id::BIGINT % 60 AS case_id, CASE WHEN native_id::BIGINT % 31 = 0 THEN -1 ELSE 1 END AS label
  FROM members JOIN groups USING (service, role, fingerprint) WHERE event_type IN ('error', 'purchase'))
SELECT group_id, least(count(DISTINCT case_id) FILTER (label = 1), 4) AS bonus FROM hit WHERE (SELECT count(*) FROM hit) <= 4096 GROUP BY 1
HAVING count(DISTINCT case_id) FILTER (label = 1) >= 2 AND count(*) FILTER (label = -1) = 0""",
    "promoted_groups": f"""WITH {views.GROUPS_SQL} SELECT DISTINCT group_id FROM members JOIN groups USING (service, role, fingerprint) WHERE event_type <> 'view' AND user_id % 40 <> 0""",
    "labels_digest": f"""WITH {views.GROUPS_SQL},
l AS (SELECT native_id, native_id::BIGINT % 60 AS case_id, CASE WHEN native_id::BIGINT % 31 = 0 THEN -1 ELSE 1 END AS label, group_id, service, role, fingerprint
  FROM members JOIN groups USING (service, role, fingerprint) WHERE event_type IN ('error', 'purchase')),
d AS (SELECT case_id, native_id, sha256(concat_ws(chr(31), 'v' || case_id, 'v' || native_id, 'v' || label, 'v' || group_id, 'v' || service, 'v' || role, 'v' || fingerprint)) AS d FROM l),
c AS (SELECT case_id, count(*) AS n, sha256(string_agg(d, '' ORDER BY native_id)) AS d FROM d GROUP BY 1)
SELECT sum(n)::BIGINT AS n_labels, sha256(string_agg(d, '' ORDER BY case_id)) AS digest FROM c""",
    "term_digests": f"WITH {views.TERMS_SQL} SELECT group_id, sha256(term) AS digest FROM terms",
}
