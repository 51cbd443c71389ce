"""Queries over signals, receipts and whole analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglattice.functions import signals
from loglattice.functions.records import base64url, settled, utf8_prefix
from loglattice.operators import analysis, candidates, corpus, dedup, incident, lanes, receipts, reducer, selection
from loglattice.plans import corpus_queries, incident_queries, pipeline_queries, ranking_queries, views
from loglattice.plans.tables import table
from loglattice.session import cut, work_folder
from loglattice.sources import files, runs

FOCUS = ["quota-gate"]


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return signals.signals(table(spark, sf, "cloudwatch_messages"), ["delivery_id", "log_stream"], "message")


def failure_signals(spark: SparkSession, sf: str) -> DataFrame:
    """How often each kind of failure or onset stands in a stream's messages."""
    found = _signals(spark, sf)
    kinds = F.concat(F.transform("failures", lambda k: F.struct(F.lit("failure").alias("side"), k.alias("kind"))), F.transform("onsets", lambda k: F.struct(F.lit("onset").alias("side"), k.alias("kind"))))
    return found.select("log_stream", F.inline(kinds)).groupBy("log_stream", "side", "kind").agg(F.count(F.lit(1)).alias("n"))


def question_lane(spark: SparkSession, sf: str) -> DataFrame:
    question = signals.question_of(ranking_queries.QUESTION)
    found = signals.question_lane(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", question)
    return found.withColumn("tf", F.col("tf").cast("long"))


def merged_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Per facet of the three lanes over all documents its kind and weight, the number of its blocks, and their affinities."""
    text = F.col("text")
    blocks = table(spark, sf, "documents").select(F.col("doc_id").alias("block_id"), F.coalesce("source", F.lit("?")).alias("lane"), "text", F.array(F.when(text != "", F.md5(text))).alias("keys"))
    any_number = candidates.Bounds(None, None, None)
    parts = [candidates.lexical(blocks, signals.question_of(ranking_queries.QUESTION), any_number), candidates.coverage(blocks), candidates.provider(blocks, bounds=any_number)]
    both = candidates.merged(parts)
    held = both.affinities.groupBy("facet_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("affinity").alias("affinity"), F.sum("affinity").alias("total"))
    return both.facets.join(held, "facet_id", "left").select("facet_id", "kind", "weight", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "affinity", "total")


def delivery_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivered message kept, left out as a copy, or without an identifier; each in one of these."""
    rows = table(spark, sf, "cloudwatch_messages").select("delivery_id", "event_id", F.coalesce(F.octet_length("message"), F.lit(0)).cast("long").alias("n_bytes"))
    copies = dedup.repeated_deliveries(rows, ["event_id"], "delivery_id")
    named = rows.where("event_id is not null")
    parts = {"copy": copies, "kept": named.join(copies, "delivery_id", "left_anti"), "unnamed": rows.where("event_id is null")}
    return receipts.accounting(rows, parts, "delivery_id", "n_bytes")


def block_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of the documents in a block of one family, or in none."""
    lines = pipeline_queries.exact_lines(spark, sf).select(F.concat_ws("/", "doc_id", "seq").alias("id"), F.octet_length("payload").cast("long").alias("n_bytes"))
    blocks = pipeline_queries.framing_blocks(spark, sf)
    inside = blocks.select("lane", "state", F.explode(F.sequence("first_seq", "last_seq")).alias("seq")).select(F.concat_ws("/", "lane", "seq").alias("id"), "state")
    inside = cut(inside)  # read once for each state
    states = ("reconstructed", "ambiguous", "provider_atomic", "fallback")
    return receipts.accounting(lines, {s: inside.where(F.col("state") == s) for s in states}, "id", "n_bytes")


REDUCED = reducer.Capacity(256, 400_000, 200_000)


def reduced_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "documents").select(F.col("doc_id").alias("block_id"), "text")
    return reducer.reduced(blocks, signals.question_of(ranking_queries.QUESTION), REDUCED)


def group_examples(spark: SparkSession, sf: str) -> DataFrame:
    """First and last event of each service and type, with the events beside those of errors."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("line"), "event_type", F.concat(F.lit("svc-"), F.col("user_id") % 16).alias("service"))
    role = F.when(F.col("event_type") == "error", "error").otherwise("context")
    groups = rows.groupBy("service", "event_type").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).select(F.concat_ws("/", "service", "event_type").alias("group_id"), role.alias("role"), "first_line", "last_line")
    return analysis.group_examples(rows.select("line", F.col("event_type").alias("raw")), groups)


def expanded_within(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three deliveries before and after each delivery_id divisible by 20, in its stream, within 600 bytes."""
    rows = table(spark, sf, "cloudwatch_messages").select("log_stream", "delivery_id", F.coalesce(F.octet_length("message"), F.lit(0)).cast("long").alias("n_bytes"))
    return lanes.around_within(rows, "log_stream", "delivery_id", "n_bytes", rows.where("delivery_id % 20 = 0"), 3, 600)


def source_digests(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of every exact line of the documents."""
    return pipeline_queries.exact_lines(spark, sf).select("doc_id", "seq", F.sha2("payload", 256).alias("digest"))


def fidelities(spark: SparkSession, sf: str) -> DataFrame:
    """What each document's rendering is to it, by language, and the bytes it may take at most."""
    text = F.col("text")
    shown = F.when(F.col("lang") == "en", text).when(F.col("lang") == "de", F.base64(F.encode(text, "UTF-8"))).otherwise(F.upper(text))
    decoded = F.when(F.col("lang") == "de", text)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", receipts.fidelity(shown, text, decoded).alias("fidelity"), receipts.packet_cost(text).cast("long").alias("cost"))


def omitted_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.omitted_inventory(table(spark, sf, "log_groups").select("group_id", "service", "role", "repeat_count"), FOCUS, 40)


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Each card cites its own role under each service its service is an edge's target or source of; only dependents' citations hold."""
    cards, edges = table(spark, sf, "log_groups"), table(spark, sf, "service_edges")
    visible = cards.select(F.col("group_id").alias("event_id"), "service", F.concat_ws(" ", "service", "role").alias("sample"))
    pairs = edges.select(F.col("source_service").alias("service"), F.col("target_service").alias("hypothesis")).union(edges.select(F.col("target_service"), F.col("source_service"))).distinct()
    cited = cards.join(pairs, "service").select("hypothesis", F.col("group_id").alias("event_id"), F.when(F.col("repeat_count") > 1, F.col("role")).otherwise("absent").alias("quote"))
    return receipts.verified_citations(cited, visible, incident.transitive_dependents(edges)).select("hypothesis", "event_id", "holds")


def compound_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """How many compound tokens each document has, and a digest of them in order."""
    tokens = signals.compound_tokens(F.col("text"))
    rows = settled(table(spark, sf, "documents").where("text is not null"), ["doc_id"], [tokens.alias("t")])
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "\x1f")).alias("digest"))


def utf8_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """The longest prefix of each document within 40 bytes."""
    return table(spark, sf, "documents").select("doc_id", utf8_prefix(F.col("text"), 40).alias("prefix"))


def base64url_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", base64url(F.encode("text", "UTF-8")).alias("coded"))


def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One row: records, groups, severe groups, edges and evidence of the index."""
    index = views.index(spark, sf)
    counts = [index.records().agg(F.count(F.lit(1)).alias("records")), index.groups().agg(F.count(F.lit(1)).alias("groups")), index.summary().agg(F.sum("group_count").alias("severe_groups"))]
    counts.append(index.edges().agg(F.count(F.lit(1)).alias("edges"), F.sum("evidence_count").alias("evidence")))
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def told_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups an analysis tells of: those that aren't mere context."""
    return views.groups(spark, sf).where("role <> 'context'").select("group_id", "service", "role", "repeat_count")


def topology_union(spark: SparkSession, sf: str) -> DataFrame:
    """Services and the edges between them, declared or observed in traces."""
    return table(spark, sf, "service_edges").select("source_service", "target_service").union(incident_queries.span_edges(spark, sf).select("source_service", "target_service")).distinct()


def acquired_run(spark: SparkSession, sf: str) -> DataFrame:
    """What one run over all pages of deliveries acquires: it stops where an event comes again with other bytes."""
    rows = table(spark, sf, "cloudwatch_messages").where("event_id is not null")
    records = rows.select(F.col("page_no").cast("int").alias("page_no"), F.col("delivery_id").cast("int").alias("position"), F.col("event_id").alias("native_id"), F.col("delivery_id").alias("ts_ms"), F.coalesce("message", F.lit("")).alias("raw"), F.coalesce("log_stream", F.lit("?")).alias("stream"))
    pages = records.select("page_no").distinct().withColumn("token", F.concat(F.lit("t"), "page_no"))
    kept, _ = runs.acquire(records, pages, runs.Caps(1 << 30, 1 << 60, 1 << 60, 1 << 30))
    return kept.select("page_no", "position", "native_id", "stream", "sequence")


def exact_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The messages written as text files and read again byte for byte: how often each line stands, with its terminator."""
    folder = work_folder(spark, "lines")
    table(spark, sf, "cloudwatch_messages").select(F.coalesce("message", F.lit("")).alias("value")).write.text(folder)
    lines = files.exact_lines(spark, folder)
    return lines.groupBy(F.sha2("payload", 256).alias("digest"), F.hex("terminator").alias("terminator")).agg(F.count(F.lit(1)).alias("n"))


def metrics_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    """Metric points written as JSON lines and read with the checks of that format."""
    folder = work_folder(spark, "metrics")
    incident_queries.points(spark, sf).select(F.col("at").alias("timestamp"), "service", "metric", "value").write.json(folder)
    return files.read_metrics(spark, folder).groupBy("service", "metric").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.round(F.max("value"), 6).alias("most"))


def spans_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    """Spans written as JSON lines and read with the checks of that format."""
    folder = work_folder(spark, "spans")
    rows = incident_queries.spans(spark, sf).withColumnRenamed("start_ms", "start_time_unix_ms").drop("line").withColumn("trace_id", F.col("trace_id").cast("string"))
    rows.write.json(folder)
    return files.read_spans(spark, folder).groupBy("service", "status_code", "status_code_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"), F.min("start_time_unix_ms").alias("first"), F.count("parent_span_id").alias("children"))


def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    """First records of the cards as result lines."""
    cards = table(spark, sf, "log_groups")
    rows = cards.select("source_id", F.encode("first_native_id", "UTF-8").alias("native_id"), F.lit("first").alias("position"), "repeat_count", F.encode("service", "UTF-8").alias("raw"))
    return files.result_lines(rows)


def directory_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of the first four services of each directory page, interleaved."""
    return corpus.directory_expansion(table(spark, sf, "log_groups"), lambda offered: [x["service"] for x in offered[:4]]).select("rank", "group_id", "service")


HITS_BUDGET = 60_000


def grep_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline of a plain search: its hundred best documents, then the last 200, then the first 20, each whole or not at all."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("cost"))
    ranked = [r["doc_id"] for r in ranking_queries.query_feature_rank(spark, sf).orderBy("rank").collect()]
    tail = [r[0] for r in docs.orderBy(F.desc("doc_id")).limit(200).collect()][::-1]
    head = [r[0] for r in docs.orderBy("doc_id").limit(20).collect()]
    order = list(dict.fromkeys([*ranked, *tail, *head]))
    costs = {r[0]: r[1] for r in docs.where(F.col("doc_id").isin(order)).collect()}  # at most 320
    taken, _ = selection.pack([(i, costs[i]) for i in order], HITS_BUDGET)
    return spark.createDataFrame([(i, costs[i]) for i in sorted(taken)], "doc_id long, cost long")


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("unknown")
    return receipts.run_totals(orders.select(F.col("o_orderkey").alias("case_id")), orders.select(F.col("o_orderkey").alias("case_id"), status.alias("status"), F.col("o_custkey").alias("cost")), "cost")


def visible_groups(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.visible_groups(table(spark, sf, "log_groups").select("group_id", "service", "role", "repeat_count"), FOCUS)


def top_metrics(spark: SparkSession, sf: str) -> DataFrame:
    shifts = incident.metric_shifts(incident_queries.points(spark, sf), incident_queries.INCIDENT, incident_queries.WIDTH)
    return analysis.top_metrics(shifts).select("rank", "service", "metric", "truncated")


def top_traces(spark: SparkSession, sf: str) -> DataFrame:
    found = incident.trace_signals(incident_queries.spans(spark, sf), incident_queries.TRACE_INCIDENT, incident_queries.TRACE_WIDTH)
    return analysis.top_traces(found).select("rank", "service", "truncated")


QUERIES = {f.__name__: f for f in (failure_signals, question_lane, merged_facets, block_accounting, delivery_accounting, reduced_blocks, group_examples, expanded_within, source_digests, fidelities, omitted_inventory, citations, compound_tokens, utf8_prefixes, base64url_texts, corpus_counts, told_groups, topology_union, acquired_run, exact_file_lines, metrics_ndjson, spans_ndjson, result_lines, directory_loop, grep_head_tail, run_totals, visible_groups, top_metrics, top_traces)}

_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def _words(items) -> str:
    return ", ".join("'" + x + "'" for x in items)


def _tokens(text: str) -> str:
    """Compound tokens of a text in SQL."""
    parts = f"""flatten(list_transform(list_filter(list_transform(string_split(c, '/'), lambda s: trim(s, '.-')), lambda s: s <> ''), lambda s: list_concat(
    CASE WHEN s <> c THEN [s] ELSE [] END, CASE WHEN regexp_matches(s, '{_UUID}') THEN [] ELSE list_filter(string_split_regex(s, '[.-]'), lambda p: p <> '' AND p <> s AND p <> c) END)))"""
    return f"""flatten(list_transform(list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9_./-]+'), lambda x: trim(x, '.-')), lambda x: x <> ''), lambda c: list_concat([c], {parts})))"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FAILED = "CASE " + " ".join(f"WHEN w IN ({_words(v)}) THEN '{k}'" for k, v in signals.FAILURES.items()) + """
  WHEN regexp_full_match(t, '[A-Za-z0-9_]+(Exception|Error)') AND regexp_matches(t, '[A-Z][A-Za-z0-9_]*(Exception|Error)$') THEN 'exception'
  WHEN regexp_full_match(w, 'e[0-9]{4}') AND w <> 'e0000' THEN 'compiler_error' END"""
_ONSET = "CASE " + " ".join(f"WHEN w IN ({_words(v)}) THEN '{k}'" for k, v in signals.ONSETS.items()) + " END"


def _found(source: str, keep: str, text: str) -> str:
    """CTEs ending in ``found``: keep columns, side and kind of each signal."""
    return f"""tok AS (SELECT {keep}, {_tokens(text)} AS ts FROM {source} WHERE {text} IS NOT NULL),
one AS (SELECT {keep}, unnest(list_transform(ts, lambda t, i: {{'t': t, 'p': CASE WHEN i > 1 THEN ts[i - 1] END}})) AS x FROM tok),
low AS (SELECT {keep}, x.t AS t, {_LOWER.format('x.t')} AS w, {_LOWER.format('x.p')} AS before FROM one),
found AS (
  SELECT {keep}, 'failure' AS side, {_FAILED} AS kind FROM low WHERE before IS NULL OR before NOT IN ({_words(signals.NEGATORS)})
  UNION ALL SELECT {keep}, 'onset', {_ONSET} FROM low)"""


_ASKED = signals.question_of(ranking_queries.QUESTION)
_TERMS = _words(_ASKED.terms)
_DOC_TOKENS = f"dt AS (SELECT doc_id, {_tokens(_LOWER.format('text'))} AS ts FROM documents)"
_HITS = f"{_DOC_TOKENS}, q AS (SELECT unnest([{_TERMS}]) AS term), hit AS (SELECT doc_id, term, len(list_filter(ts, lambda x: x = term)) AS tf FROM dt, q WHERE list_contains(ts, term))"
_ORDER = "service <> 'quota-gate', CASE role WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'change' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END, repeat_count, group_id"
SQL = {
    "failure_signals": f"WITH {_found('cloudwatch_messages', 'log_stream', 'message')} SELECT log_stream, side, kind, count(*) AS n FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    "question_lane": f"WITH {_HITS} SELECT doc_id, 'term:' || term AS facet_id, 'term' AS kind, tf, false AS mandatory FROM hit",
    "merged_facets": f"""WITH {_found('documents', 'doc_id', 'text')}, {_HITS},
st AS (SELECT count(*)::HUGEINT AS n, sum(coalesce(len(ts), 0))::HUGEINT AS total FROM dt),
df AS (SELECT q.term, count(doc_id)::HUGEINT AS df FROM q LEFT JOIN hit USING (term) GROUP BY 1),
b AS (SELECT doc_id, coalesce(source, '?') AS lane, coalesce((SELECT bool_or(f.side = 'failure' AND f.kind IS NOT NULL) FROM found f WHERE f.doc_id = d.doc_id), false) AS f,
  coalesce((SELECT bool_or(f.side = 'onset' AND f.kind IS NOT NULL) FROM found f WHERE f.doc_id = d.doc_id), false) AS o FROM documents d),
m AS (SELECT lane, min(doc_id) AS head, max(doc_id) AS tail, min(doc_id) FILTER (f) AS ff, min(doc_id) FILTER (o) AS fo FROM b GROUP BY 1),
n AS (SELECT m.lane, max(doc_id) FILTER (doc_id < ff) AS bf, max(doc_id) FILTER (doc_id < fo) AS bo FROM m JOIN b USING (lane) GROUP BY 1),
pos AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents),
strata AS (SELECT pos.doc_id, i, least(8, n) AS k FROM pos, range(8) r(i) WHERE i < least(8, n) AND p = i * n // least(8, n)),
keyed AS (SELECT doc_id, md5(text) AS key FROM documents WHERE text <> ''),
aff AS (
  SELECT doc_id, 'term:' || term AS facet_id, 'query_term' AS kind, (1000000 * (n - df + 1) // (n + 1))::BIGINT AS weight,
    ((10 * total * tf * 1000000) // (10 * total * tf + 3 * total + 9 * len(ts) * n))::BIGINT AS affinity FROM hit JOIN df USING (term) JOIN dt USING (doc_id), st
  UNION ALL SELECT DISTINCT doc_id, side || ':' || kind, side || '_role', 1000000, 1000000 FROM found WHERE kind IS NOT NULL
  UNION ALL SELECT head, 'lane_head:' || lane, 'source_coverage_stratum', 250000, 1000000 FROM m
  UNION ALL SELECT tail, 'lane_tail:' || lane, 'source_coverage_stratum', 250000, 1000000 FROM m
  UNION ALL SELECT ff, 'first_failure:' || lane, 'onset_role', 1000000, 1000000 FROM m WHERE ff IS NOT NULL
  UNION ALL SELECT fo, 'first_onset:' || lane, 'onset_role', 1000000, 1000000 FROM m WHERE fo IS NOT NULL
  UNION ALL SELECT bf, 'before_failure:' || lane, 'onset_role', 1000000, 1000000 FROM n WHERE bf IS NOT NULL
  UNION ALL SELECT bo, 'before_onset:' || lane, 'onset_role', 1000000, 1000000 FROM n WHERE bo IS NOT NULL
  UNION ALL SELECT min(doc_id), 'retrieval_head', 'source_coverage_stratum', 250000, 1000000 FROM documents
  UNION ALL SELECT max(doc_id), 'retrieval_tail', 'source_coverage_stratum', 250000, 1000000 FROM documents
  UNION ALL SELECT doc_id, 'stratum:' || i || '/' || k, 'time_coverage_stratum', 250000, 1000000 FROM strata
  UNION ALL SELECT doc_id, 'relation:' || key, 'provider_attested_graph_relation', 500000, 1000000 FROM keyed WHERE key IN (SELECT key FROM keyed GROUP BY 1 HAVING count(*) > 1))
SELECT facet_id, kind, weight, count(*) AS n_blocks, max(affinity) AS affinity, sum(affinity)::BIGINT AS total FROM aff GROUP BY 1, 2, 3
UNION ALL SELECT 'term:' || term, 'query_term', (1000000 * (n - df + 1) // (n + 1))::BIGINT, 0, NULL, NULL FROM df, st WHERE df = 0""",
    "delivery_accounting": """WITH d AS (
  SELECT coalesce(octet_length(encode(message)), 0)::BIGINT AS n, event_id, row_number() OVER (PARTITION BY event_id ORDER BY delivery_id) AS rn FROM cloudwatch_messages)
SELECT CASE WHEN event_id IS NULL THEN 'unnamed' WHEN rn = 1 THEN 'kept' ELSE 'copy' END AS disposition, count(*) AS n_records, sum(n)::BIGINT AS n_bytes FROM d GROUP BY 1""",
    "run_totals": """SELECT count(*) AS n_cases, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'P') AS partial,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS unknown, sum(o_custkey)::BIGINT AS total_cost FROM orders""",
    "visible_groups": f"SELECT group_id, service, role, repeat_count, row_number() OVER (PARTITION BY service ORDER BY {_ORDER}) AS turn FROM log_groups QUALIFY turn <= 3",
    "top_metrics": f"WITH s AS ({incident_queries.SQL['metric_shift']}) SELECT row_number() OVER (ORDER BY relative_shift DESC, service, metric) AS rank, service, metric, (SELECT count(*) FROM s) > 24 AS truncated FROM s QUALIFY rank <= 24",
    "top_traces": f"WITH s AS ({incident_queries.SQL['trace_service_signals']}) SELECT row_number() OVER (ORDER BY priority DESC, service) AS rank, service, (SELECT count(*) FROM s) > 16 AS truncated FROM s QUALIFY rank <= 16",
    "reduced_blocks": f"""WITH RECURSIVE w AS (SELECT doc_id AS b, coalesce(octet_length(encode(text)), 0)::BIGINT AS n, string_split_regex({_LOWER.format('text')}, '[^a-z0-9_-]') AS w FROM documents),
f AS (SELECT b, n, coalesce(len(list_intersect(w, [{_words(reducer.FAILURE_WORDS)}])), 0) > 0 AS failed, w FROM w),
q AS (SELECT unnest([{_TERMS}]) AS term), hit AS (SELECT b, term FROM f, q WHERE list_contains(w, term)),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY 1), st AS (SELECT count(*) AS nb, sum(n) AS size FROM f),
s AS (SELECT b, n, CASE WHEN failed THEN 2 * nb ELSE 0 END + coalesce((SELECT sum(nb - df + 1) FROM hit JOIN df USING (term) WHERE hit.b = f.b), 0) AS score FROM f, st),
pos AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS p FROM f), strata AS (SELECT b FROM pos, st WHERE p IN (SELECT (2 * i + 1) * nb // 16 FROM range(8) r(i), st)),
first AS (SELECT count(*) AS k, coalesce(sum(n), 0) AS used FROM f WHERE b IN (SELECT b FROM strata)),
r AS (SELECT b, n, row_number() OVER (ORDER BY score DESC, b) AS i FROM s WHERE b NOT IN (SELECT b FROM strata)),
go AS (SELECT 0::BIGINT AS i, (200000 - used)::BIGINT AS room, (256 - k)::BIGINT AS more, NULL::BIGINT AS taken FROM first
  UNION ALL SELECT r.i, CASE WHEN n <= room AND more > 0 THEN room - n ELSE room END, CASE WHEN n <= room AND more > 0 THEN more - 1 ELSE more END, CASE WHEN n <= room AND more > 0 THEN b END FROM go JOIN r ON r.i = go.i + 1),
big AS (SELECT nb > 256 OR size > 400000 AS big FROM st)
SELECT b AS block_id, 'whole' AS reason FROM f, big WHERE NOT big
UNION ALL SELECT b, 'stratum' FROM strata, big WHERE big UNION ALL SELECT taken, 'ranked' FROM go, big WHERE big AND taken IS NOT NULL""",
    "group_examples": """WITH e AS (SELECT event_id AS line, event_type, 'svc-' || (user_id % 16) AS service FROM events),
g AS (SELECT service || '/' || event_type AS group_id, event_type, min(line) AS a, max(line) AS b FROM e GROUP BY ALL),
x AS (SELECT group_id, unnest(CASE WHEN event_type = 'error' THEN [a - 1, a, a + 1, b - 1, b, b + 1] ELSE [a, b] END) AS line FROM g)
SELECT DISTINCT group_id, line, event_type AS raw FROM x JOIN e USING (line)""",
    "expanded_within": """WITH p AS (
  SELECT log_stream, delivery_id, coalesce(octet_length(encode(message)), 0)::BIGINT AS n, row_number() OVER (PARTITION BY log_stream ORDER BY delivery_id) AS p FROM cloudwatch_messages),
x AS (SELECT a.log_stream, a.delivery_id AS anchor, a.n AS own, p.delivery_id, p.n, p.p - a.p AS o FROM p a JOIN p ON p.log_stream = a.log_stream AND p.p BETWEEN a.p - 3 AND a.p + 3 WHERE a.delivery_id % 20 = 0),
u AS (SELECT *, sum(n) OVER (PARTITION BY anchor, sign(o) ORDER BY abs(o)) AS used FROM x),
b AS (SELECT *, coalesce(max(CASE WHEN o < 0 AND used <= 600 - own THEN used END) OVER (PARTITION BY anchor), 0) AS before FROM u)
SELECT log_stream, anchor, delivery_id FROM b WHERE own <= 600 AND (o = 0 OR (o < 0 AND used <= 600 - own) OR (o > 0 AND used + before <= 600 - own))""",
    "source_digests": f"WITH l AS ({pipeline_queries.SQL['exact_lines']}) SELECT doc_id, seq, sha256(payload) AS digest FROM l",
    "fidelities": """SELECT doc_id, CASE WHEN lang = 'en' THEN 'source_exact' WHEN lang = 'de' THEN CASE WHEN text = '' THEN 'source_exact' ELSE 'reversible' END WHEN upper(text) = text THEN 'source_exact' ELSE 'transformed' END AS fidelity,
  (octet_length(encode(regexp_replace(text, '[^\\x20-\\x7e]', '....', 'g'))) + 64)::BIGINT AS cost FROM documents WHERE text IS NOT NULL""",
    "omitted_inventory": f"""WITH t AS (SELECT group_id, service, role, repeat_count, row_number() OVER (PARTITION BY service ORDER BY {_ORDER}) AS turn FROM log_groups),
r AS (SELECT * FROM t WHERE turn BETWEEN 4 AND 43)
SELECT *, row_number() OVER (ORDER BY turn, service <> 'quota-gate', CASE role WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'change' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END, group_id) AS rank,
  (SELECT count(*) FROM r) > 40 AS truncated FROM r QUALIFY rank <= 40""",
    "citations": f"""WITH RECURSIVE {incident_queries._CLOSURE},
pairs AS (SELECT source_service AS service, target_service AS hypothesis FROM service_edges UNION SELECT target_service, source_service FROM service_edges)
SELECT p.hypothesis, c.group_id AS event_id, coalesce(c.repeat_count > 1 AND (c.service = p.hypothesis OR EXISTS (SELECT 1 FROM reach r WHERE r.service = p.hypothesis AND r.dependent = c.service)), false) AS holds
FROM log_groups c JOIN pairs p ON p.service = c.service""",
    "compound_tokens": f"WITH t AS (SELECT doc_id, {_tokens('text')} AS ts FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(ts) AS n_tokens, md5(array_to_string(ts, chr(31))) AS digest FROM t",
    "utf8_prefixes": "SELECT doc_id, left(text, (SELECT max(k) FROM range(41) r(k) WHERE octet_length(encode(left(text, k))) <= 40)) AS prefix FROM documents",
    "base64url_texts": "SELECT doc_id, rtrim(translate(base64(encode(text)), '+/', '-_'), '=') AS coded FROM documents",
    "corpus_counts": f"""WITH {views.GROUPS_SQL},
e AS (SELECT service, peer, count(*) AS n FROM members WHERE peer IS NOT NULL AND peer <> service GROUP BY ALL)
SELECT (SELECT count(*) FROM members) AS records, (SELECT count(*) FROM groups) AS groups, (SELECT count(*) FROM groups WHERE role IN ('critical', 'error', 'warning')) AS severe_groups,
  (SELECT count(*) FROM e) AS edges, (SELECT sum(n)::BIGINT FROM e) AS evidence""",
    "told_groups": f"WITH {views.GROUPS_SQL} SELECT group_id, service, role, repeat_count FROM groups WHERE role <> 'context'",
    "topology_union": f"WITH e AS ({incident_queries.SQL['span_edges']}) SELECT source_service, target_service FROM service_edges UNION SELECT source_service, target_service FROM e",
    "grep_head_tail": f"""WITH RECURSIVE {ranking_queries._FEATURE_RANK},
n AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS cost, row_number() OVER (ORDER BY doc_id) AS a, row_number() OVER (ORDER BY doc_id DESC) AS z FROM documents),
l AS (SELECT 0 AS part, rank AS pos, doc_id FROM featured UNION ALL SELECT 1, -z, doc_id FROM n WHERE z <= 200 UNION ALL SELECT 2, a, doc_id FROM n WHERE a <= 20),
o AS (SELECT doc_id, cost, row_number() OVER (ORDER BY part, pos) AS i FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) = 1) JOIN n USING (doc_id)),
go AS (SELECT 0::BIGINT AS i, {HITS_BUDGET}::BIGINT AS room, NULL::BIGINT AS doc_id, NULL::BIGINT AS cost
  UNION ALL SELECT o.i, CASE WHEN o.cost <= room THEN room - o.cost ELSE room END, CASE WHEN o.cost <= room THEN o.doc_id END, o.cost FROM go JOIN o ON o.i = go.i + 1)
SELECT doc_id, cost FROM go WHERE doc_id IS NOT NULL""",
    "acquired_run": """WITH d AS (SELECT page_no::INTEGER AS page_no, delivery_id::INTEGER AS position, event_id AS native_id, coalesce(message, '') AS raw, coalesce(log_stream, '?') AS stream FROM cloudwatch_messages WHERE event_id IS NOT NULL),
f AS (SELECT *, row_number() OVER w AS rn, first_value(raw) OVER w AS raw1 FROM d WINDOW w AS (PARTITION BY stream, native_id ORDER BY page_no, position)),
stop AS (SELECT min((page_no, position)) AS place FROM f WHERE raw <> raw1)
SELECT page_no, position, native_id, stream, row_number() OVER (PARTITION BY stream ORDER BY page_no, position) - 1 AS sequence FROM f, stop WHERE rn = 1 AND (place IS NULL OR (page_no, position) < place)""",
    "exact_file_lines": """WITH l AS (SELECT unnest(string_split(coalesce(message, ''), chr(10))) AS x FROM cloudwatch_messages),
p AS (SELECT CASE WHEN ends_with(x, chr(13)) THEN left(x, -1) ELSE x END AS payload, CASE WHEN ends_with(x, chr(13)) THEN '0D0A' ELSE '0A' END AS terminator FROM l)
SELECT sha256(payload) AS digest, terminator, count(*) AS n FROM p GROUP BY 1, 2""",
    "metrics_ndjson": """WITH p AS (SELECT epoch_us(ts) // 1000000 AS sec, 'svc-' || (user_id % 16) AS service, event_type AS metric, value FROM events)
SELECT service, metric, count(*) AS n, min(sec) AS first, max(sec) AS last, round(max(value), 6) AS most FROM p GROUP BY 1, 2""",
    "spans_ndjson": f"""WITH {incident_queries._SPANS} SELECT service, status_code::BIGINT AS status_code, CASE WHEN status_code = 14 THEN 'grpc' END AS status_code_kind, count(*) AS n, sum(duration)::BIGINT AS duration, min(start_ms) AS first,
  count(parent_span_id) AS children FROM spans GROUP BY 1, 2, 3""",
    "result_lines": """SELECT '{"source_id":"' || source_id || '","native_id":"' || rtrim(translate(base64(encode(first_native_id)), '+/', '-_'), '=') || '","position":"first","repeat_count":' || repeat_count || ',"raw":"' || service || '"}' AS value FROM log_groups""",
    "directory_loop": f"""WITH sv AS (SELECT DISTINCT service FROM log_groups WHERE {corpus_queries._SEVERE}), nb AS (SELECT service, row_number() OVER (ORDER BY service) AS rn FROM sv),
ch AS (SELECT service, row_number() OVER (ORDER BY rn) - 1 AS stream FROM nb WHERE (rn - 1) % 32 < 4 AND rn <= 128), k AS (SELECT greatest(1, 64 // count(*)) AS each FROM ch),
sides AS (
  SELECT service, group_id, 0 AS side, row_number() OVER (PARTITION BY service ORDER BY last_timestamp_millis, group_id) AS pos FROM log_groups WHERE {corpus_queries._SEVERE}
  UNION ALL SELECT service, group_id, 1, row_number() OVER (PARTITION BY service ORDER BY last_timestamp_millis DESC, group_id DESC) FROM log_groups WHERE {corpus_queries._SEVERE}),
own AS (SELECT * FROM sides, k WHERE pos <= (each + 1) // 2 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY pos, side) = 1),
inner_rank AS (SELECT service, group_id, each, row_number() OVER (PARTITION BY service ORDER BY pos, side) AS position FROM own)
SELECT row_number() OVER (ORDER BY position, stream) AS rank, group_id, service FROM inner_rank JOIN ch USING (service) WHERE position <= each QUALIFY rank <= 64""",
}
