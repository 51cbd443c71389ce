import json
import random

import pytest
from pyspark.sql import functions as F

from loglattice.functions.records import parse_records
from loglattice.operators import corpus, selection, tools
from loglattice.operators.feedback import Store
from loglattice.operators.index import Conflict, Index, flat_groups
from loglattice.session import work_folder
from loglattice.streaming import pipelines

SCHEMA = "native_id string, ts_ms long, raw string"


def record(i):
    return (f"n{i:03d}", 1000 + i // 2, json.dumps({"service": f"s{i % 3}", "level": "error" if i % 2 else "warn", "message": f"lost request_id={i} kind {i % 4}", **({"peer.service": f"s{i % 5}"} if i % 4 == 0 else {})}))


ROWS = [record(i) for i in range(90)]


@pytest.fixture
def index(spark):
    return Index(spark, work_folder(spark, "index"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_batches_in_any_order_give_the_groups_of_one(spark, index):
    random.seed(3)
    mixed = ROWS[:]
    random.shuffle(mixed)
    for b in range(3):
        index.add(spark.createDataFrame(mixed[b * 30 : (b + 1) * 30] + mixed[:5] + mixed[b * 30 : b * 30 + 2], SCHEMA), b)  # some come again
    parsed = parse_records(spark.createDataFrame(ROWS, SCHEMA), "raw")
    want = flat_groups(parsed)
    assert rows(index.groups(), *want.columns) == rows(want, *want.columns)
    assert index.records().count() == 90 and index.members().count() == 90
    edges = corpus.service_edges(corpus.edge_evidence(parsed))
    assert rows(index.edges(), *edges.columns) == rows(edges, *edges.columns)
    ids = [r[0] for r in index.groups().select("group_id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    terms = corpus.group_terms(index.groups())
    assert rows(index.terms(), "group_id", "term") == rows(terms, "group_id", "term")
    of = {r["native_id"]: r["group_id"] for r in index.group_members().collect()}
    counts = {r["group_id"]: r["repeat_count"] for r in index.groups().collect()}
    assert len(of) == 90 and all(sum(v == g for v in of.values()) == n for g, n in counts.items())
    summary = corpus.severe_service_summary(index.groups())
    assert rows(index.summary(), *summary.columns) == rows(summary, *summary.columns)


def test_ids_stay_and_a_search_sees_one_version(spark, index):
    index.add(spark.createDataFrame(ROWS[:40], SCHEMA), 0)
    before = {tuple(r[1:4]): r[0] for r in index.groups().collect()}
    old = index.groups(0)
    n, generation = old.count(), index.generation()
    index.add(spark.createDataFrame(ROWS[40:] + [("x", 5, '{"service": "new", "message": "other words"}')], SCHEMA), 1)
    after = {tuple(r[1:4]): r[0] for r in index.groups().collect()}
    assert all(after[k] == i for k, i in before.items()) and len(after) == n + 1
    assert old.count() == n and index.generation() != generation
    index.add(spark.createDataFrame(ROWS[:3], SCHEMA), 1)  # delivered again
    assert index.generation() == 1 and index.records().count() == 91


def test_conflicts_take_in_nothing(spark, index):
    index.add(spark.createDataFrame(ROWS[:4], SCHEMA), 0)
    for bad in ([("n001", 5, "other")], [("q", 1, "a"), ("q", 1, "b")], [("n001", 1000, "bytes"), ("fresh", 1, "x")], [(None, 1, "x")]):
        with pytest.raises(Conflict):
            index.add(spark.createDataFrame(bad, SCHEMA), 1)
    assert index.generation() == 0 and index.records().count() == 4
    index.add(spark.createDataFrame([], SCHEMA), 1)
    assert index.generation() == 1 and index.groups().agg(F.sum("repeat_count")).first()[0] == 4


def test_an_empty_index(spark, index):
    index.add(spark.createDataFrame([], SCHEMA), 0)
    assert index.groups().count() == 0 and index.lexical_candidates("lost request").count() == 0


def test_searches_read_the_parts_of_their_terms(spark, index):
    index.add(spark.createDataFrame(ROWS, SCHEMA), 0)
    plan = index.holding(["lost", "kind"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters")[1][:40]
    assert "PushedFilters: [In(term" in plan
    direct = corpus.lexical_candidates(index.groups(), corpus.group_terms(index.groups()), "lost kind 3", 5)
    assert rows(index.lexical_candidates("lost kind 3", 5), *direct.columns) == rows(direct, *direct.columns)
    assert "Join" in index.group_members()._jdf.queryExecution().executedPlan().toString()


def test_streamed_corpus(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame(ROWS[i * 30 : (i + 1) * 30], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pipelines.run(stream, pipelines.upsert_corpus(str(tmp_path / "corpus")), str(tmp_path / "cp")).awaitTermination(120)
    got = Index(spark, str(tmp_path / "corpus"))
    assert got.generation() == 2 and got.records().count() == 90


def test_priority_fallback_against_a_plain_one(spark):
    random.seed(8)
    cards = [(i, f"s{int(random.random() ** 3 * 9)}", random.choice(["error", "warning", "context"]), random.randint(1, 9), random.randint(0, 300)) for i in range(1, 500)]
    df = spark.createDataFrame([(*c, c[4], f"f{c[0]}", f"l{c[0]}") for c in cards], "group_id long, service string, role string, repeat_count long, last_timestamp_millis long, first_timestamp_millis long, first_native_id string, last_native_id string")
    severe = sorted((c for c in cards if c[2] != "context"), key=lambda c: (c[4], c[0]))
    for limit in (1, 7, 64, 1000):
        low, high, n = severe[0][4], severe[-1][4], len(severe)
        if n <= limit or limit == 1:
            want = [c[0] for c in severe[::-1][:limit]]
        else:
            ends = max(limit // 3, 1)
            per = -(-max(0, limit - 2 * ends) // 8)
            k = min(32, max(1, limit // 8))
            by = {}
            for c in severe:
                by.setdefault(c[1], []).append(c[0])
            order = sorted(by, key=lambda s: (len(by[s]), s))
            picked = order[: (k + 1) // 2] + order[::-1][: k // 2]
            want = [x for s in picked for x in (by[s][0], by[s][-1])]
            streams = [[c[0] for c in severe[:ends]], [c[0] for c in severe[::-1][:ends]]]
            streams += [[c[0] for c in severe if c[4] >= low + (high - low) * p // 9][:per] for p in corpus.ANCHOR_PARTS]
            want += [s[i] for i in range(max(map(len, streams))) for s in streams if i < len(s)] + [c[0] for c in severe[::-1][ends : limit + 1]]
            want = list(dict.fromkeys(want))[:limit]
        got = [r["group_id"] for r in corpus.priority_fallback(df, limit).orderBy("rank").collect()]
        assert got == want, limit
    assert corpus.priority_fallback(df.limit(0), 5).count() == 0


def test_pages_and_nearby_flags(spark):
    df = spark.createDataFrame([(f"n{i}", i, "x" * 10) for i in range(9)], SCHEMA)
    page = corpus.page_after(df.select("ts_ms", "native_id"), ["ts_ms", "native_id"], [3, "n3"], 2).collect()
    assert [(r["ts_ms"], r["has_more"]) for r in page] == [(4, True), (5, True)]
    assert not corpus.page_after(df.select("ts_ms"), ["ts_ms"], [6], 2).first()["has_more"]
    assert corpus.record_page(df, (5, "n5"), 9, 20).collect()[0]["has_more"] and not corpus.record_page(df, (5, "n5"), 3, 30).collect()[0]["has_more"]
    for before, after, budget, want in ((2, 2, 1000, ([2, 3, 4, 5, 6], True, True)), (9, 9, 1000, (list(range(9)), False, False)), (2, 4, 40, ([2, 3, 4, 5], True, True)), (4, 4, 90, (list(range(9)), False, False)), (1, 0, 20, ([3, 4], True, True))):
        got = corpus.nearby_records(df, "n4", before, after, budget).collect()
        assert (sorted(r["ts_ms"] for r in got), got[0]["before_truncated"], got[0]["after_truncated"]) == want
    assert corpus.nearby_records(df, "none", 1, 1, 10).count() == 0


def test_a_connected_pack_is_of_one_generation(spark, index):
    index.add(spark.createDataFrame(ROWS, SCHEMA), 0)
    rows = tools.connected_logs(index, "lost kind 3").collect()
    raw = {r[0]: r[2] for r in ROWS}
    assert rows and all(raw[r["native_id"]] == r["raw"] for r in rows) and [r["position"] for r in rows] == list(range(len(rows)))
    assert sum(len(r["raw"]) for r in rows) <= tools.BUDGET and tools.connected_logs(index, "lost", budget=5).count() == 0

    def late(cards, most):
        index.add(spark.createDataFrame([("new", 1, "x")], SCHEMA), 1)
        return selection.first_ids(cards, most)

    with pytest.raises(tools.Stale):
        tools.connected_logs(index, "lost kind 3", late)
    assert tools.connected_expand(index, "n010", 1, 1, 10_000).count() == 3
    store = Store(spark, work_folder(spark, "feedback"))
    tools.connected_feedback(store, "t", ["n010"], "n", -1, 0)
    assert [tuple(r) for r in store.verdicts().collect()] == [("t", "n010", "n", -1)]
    with pytest.raises(ValueError):
        tools.connected_feedback(store, "t", ["n010"], "n", 0, 1)
    lines = spark.createDataFrame([(i, f"level=error service=s kind {i % 2}") for i in range(6)], "line long, raw string")
    got = {r["line"]: r["raw"] for r in tools.logs(lines).collect()}
    assert set(got) <= set(range(6)) and {"level=error service=s kind 0", "level=error service=s kind 1"} == set(got.values())
    assert tools.expand(lines, 3, 1, 1).count() == 3
