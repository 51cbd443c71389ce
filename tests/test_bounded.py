"""Framing, bounded selection, evaluation: small cases against brute force."""

import itertools
import os
import random

import pytest

from loglattice.operators import framing, incident, lanes, ranking, selection

SMALL = "/root/testdata/sf0.001"
BLOCKS = {
    "python": ["Traceback (most recent call last):", '  File "/a.py", line 1, in x', "    y()", "ValueError: bad", "", "The above exception was the direct cause of the following exception:", "", "Traceback (most recent call last):", '  File "/b.py"', "KeyError: 1"],
    "jvm_dotnet": ["io.x.BadException: no", "\tat io.x.Y(Z.java:1)", "Caused by: io.x.E", "\t... 3 more"],
    "javascript": ["TypeError: no", "    at f (a.js:1)"],
    "rust": ["thread 'main' panicked at src/a.rs:1", "note: run with `RUST_BACKTRACE=1`", "stack backtrace:", "   0: core::x"],
    "go": ["panic: bad", "", "goroutine 1 [running]:", "main.f(0x1)", "\t/a.go:1 +0x1"],
    "compiler": ["error[E0308]: mismatched", " --> src/a.rs:1", "  |", "1 | x", "  = note: y"],
    "assertion": ["assertion failed: x == y", "  left: 1", " right: 2"],
}


@pytest.mark.parametrize("family", BLOCKS)
def test_families(family):
    lines = ["before", *BLOCKS[family], "after"]
    found = framing.frame_lane([(i, x, i * 10) for i, x in enumerate(lines)])
    assert [f[:3] for f in found] == [(0, 1, ""), (1, len(lines) - 1, family), (len(lines) - 1, len(lines), "")]
    assert found[1][3:] == ("reconstructed", "high") and found[0][3:] == ("fallback", "certain")


def test_what_ends_a_block():
    frames = ["panic: bad", "goroutine 1 [running]:", "main.f(0x1)"]
    assert framing.frame_lane([(0, frames[0], 0), (2, frames[1], 1)])[0][:2] == (0, 1)  # a gap in the sequence
    assert framing.frame_lane([(0, frames[0], 0), (1, frames[1], 60_000)])[0][:2] == (0, 1)  # too late
    assert framing.frame_lane([(0, frames[0], None), (1, frames[1], None)])[0][4] == "medium"
    many = framing.frame_lane([(i, x, i) for i, x in enumerate(["panic: bad", *["goroutine 1 [running]:"] * 40])])
    assert many[0][:2] == (0, 33) and many[0][4] == "medium"
    assert framing.frame_lane([(0, None, 0), (1, "caf\xe9", 0), (2, "  at x", 0), (3, "a\nb", 0)]) == [
        (0, 1, "", "ambiguous", "unknown"), (1, 2, "", "fallback", "unknown"), (2, 3, "", "ambiguous", "low"), (3, 4, "", "provider_atomic", "certain")
    ]
    assert framing.frame_lane([]) == []


def test_chunked_lanes_frame_like_whole_ones(spark, monkeypatch):
    random.seed(3)
    lines = [x for _ in range(60) for x in (*random.choice(list(BLOCKS.values())), *["plain line"] * random.randint(0, 2))]
    df = spark.createDataFrame([("l", i, x) for i, x in enumerate(lines)], "lane string, seq long, line string")
    want = {(a, b - 1, f) for a, b, f, *_ in framing.frame_lane([(i, x, None) for i, x in enumerate(lines)])}
    monkeypatch.setattr(framing, "BLOCK", 64)
    got = {(r["first_seq"], r["last_seq"], r["family"]) for r in framing.frame(df, "lane", "seq", "line").collect()}
    assert got == want


def test_long_soft_runs_frame_like_whole_ones(spark):
    """Runs beyond a chunk without any hard line: chained tracebacks, which stay together, and blank lines, which are cut where no start is near."""
    chain = BLOCKS["python"][:4]
    lines = ["plain", *chain * 2500, *[""] * 9000, *chain, "plain"]
    df = spark.createDataFrame([("l", i, x) for i, x in enumerate(lines)], "lane string, seq long, line string")
    want = {(a, b - 1, f) for a, b, f, *_ in framing.frame_lane([(i, x, None) for i, x in enumerate(lines)])}
    got = {(r["first_seq"], r["last_seq"], r["family"]) for r in framing.frame(df, "lane", "seq", "line").collect()}
    assert got == want


def test_exact_lines(spark):
    texts = [(1, "a\r\nb\n\nc"), (2, "x\ry\n"), (3, ""), (4, None), (5, "\n")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = sorted((r["id"], r["seq"], r["payload"], r["terminator"]) for r in framing.split_lines(df, "id", "text").collect())
    assert [g for g in got if g[0] == 1] == [(1, 0, "a", "\r\n"), (1, 1, "b", "\n"), (1, 2, "", "\n"), (1, 3, "c", None)]
    assert [g[2:] for g in got if g[0] == 2] == [("x\ry", "\n")] and [g[2:] for g in got if g[0] == 5] == [("", "\n")]
    assert not [g for g in got if g[0] in (3, 4)]


def test_tournament():
    cards = [{"group_id": i, "role": "error" if i % 50 == 0 else "context"} for i in range(200)]
    final, pruned = selection.tournament(cards, selection.gravest, [[199, 5], [7]])
    assert set(final) >= {0, 50, 100, 150} and len(final) == 12 and pruned == 200 - 33  # 5 and 7 win their page as well
    with pytest.raises(ValueError):
        selection.tournament(cards, lambda c, n: [10**6])
    assert selection.tournament([], selection.first_ids) == ([], 0)


def test_pack_and_quota():
    assert selection.pack([(1, 5), (2, 9), (3, 5)], 10) == ([1, 3], True)
    assert selection.quota_hybrid([([1, 2], 5), ([2, 3], 5)], {1: 4, 2: 5, 3: 6}, 15) == [1, 2, 3]
    assert selection.quota_hybrid([], {}, 5) == []


def test_skip_packing_by_pages(spark):
    random.seed(9)
    rows = [(random.choice(["hot", "hot", "b", None]), i, random.randint(0, 50), random.randint(0, 30)) for i in range(800)] + [("hot", None, 1, 1), ("c", 9000, 5, 1000)]
    df = spark.createDataFrame(rows, "k string, id long, at long, cost long").repartition(4)
    want = set()
    for k in ("hot", "b", "c"):
        mine = sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: (-r[2], r[1]))
        want |= {(k, i) for i in selection.pack([(r[1], r[3]) for r in mine], 400)[0]}
    for page in (3, 40, 512):
        got = selection.skip_packing_by(df, "k", [("at", True), ("id", False)], "id", "cost", 400, page)
        assert {tuple(r) for r in got.collect()} == want
    assert selection.skip_packing_by(df.limit(0), "k", [("id", False)], "id", "cost", 400).count() == 0


def test_top_two_facets():
    """A second packet adds what it holds beyond the second best so far."""
    packets = [selection.Packet(0, 1, {"f": 10}), selection.Packet(1, 1, {"f": 5}), selection.Packet(2, 1, {"f": 4})]
    assert selection.select_packets(packets, {"f": 1}, 3, frozenset("f")) == [0, 1]
    assert selection.select_packets(packets, {"f": 1}, 3) == [0]


def test_priorities():
    packets = [selection.Packet(0, 2, {"a": 1000}), selection.Packet(1, 2, {"b": 995}), selection.Packet(2, 2, {"c": 900})]
    weights = {"a": 1, "b": 1, "c": 1}
    assert selection.select_packets(packets, weights, 2) == [0]
    assert selection.select_packets(packets, weights, 2, priorities={1: selection.SCALE}) == [1]  # 995 + 9 > 1000
    assert selection.select_packets(packets, weights, 2, priorities={2: selection.SCALE}) == [0]  # a hundredth isn't enough
    for wrong in ({9: 5}, {0: 0}, {0: selection.SCALE + 1}):
        with pytest.raises(ValueError):
            selection.select_packets(packets, weights, 2, priorities=wrong)


@pytest.mark.parametrize("two", [frozenset(), frozenset("ab"), frozenset("abc")])
def test_selection_against_all_subsets(two):
    random.seed(2)
    for _ in range(30):
        weights = {f: random.randint(1, 9) for f in "abc"}
        packets = [selection.Packet(i, random.randint(1, 6), {f: random.randint(1, 10) for f in random.sample("abc", 2)}) for i in range(7)]
        budget = random.randint(4, 15)

        def worth(ids, packets=packets, weights=weights):
            return sum(w * sum(sorted((packets[i].affinities.get(f, 0) for i in ids), reverse=True)[: 2 if f in two else 1]) for f, w in weights.items())

        chosen = selection.select_packets(packets, weights, budget, two)
        assert sum(packets[i].cost for i in chosen) <= budget
        best = max(worth(s) for n in range(8) for s in itertools.combinations(range(7), n) if sum(packets[i].cost for i in s) <= budget)
        assert worth(chosen) >= 0.5 * (1 - 1 / 2.72) * best
    must = [selection.Packet(0, 9, {}, mandatory=True)]
    with pytest.raises(selection.NeedsMore):
        selection.select_packets(must, {}, 8)
    assert selection.select_packets(must, {}, 9) == [0]


def test_skyline_and_tail(spark):
    random.seed(5)
    rows = [(i, random.randint(0, 20), random.randint(0, 20)) for i in range(300)] + [(999, None, 1)]
    df = spark.createDataFrame(rows, "id long, gain long, cost long").repartition(5)
    full = [r for r in rows if r[1] is not None]
    want = {a[0] for a in full if not any(b[1] >= a[1] and b[2] <= a[2] and (b[1] > a[1] or b[2] < a[2]) for b in full)}
    assert {r["id"] for r in ranking.skyline(df, ["gain"], ["cost"]).collect()} == want
    assert ranking.binomial_tail(5, 0) == pytest.approx(1 / 32) and ranking.binomial_tail(0, 0) == 1.0


def test_order_statistics_of_a_hot_key(spark):
    from loglattice.operators.prefix import medians

    random.seed(6)
    rows = [("hot" if i % 3 else "b", random.choice([None, 1.5, random.random()]), i) for i in range(2000)] + [(None, 1.0, -1)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    got = {r["k"]: (r["n"], r["median"], r["example"]) for r in medians(df, ["k"], "v", "id").collect()}
    for k in ("hot", "b"):
        vals = sorted((v, i) for kk, v, i in rows if kk == k and v is not None)
        n = len(vals)
        assert got[k] == (n, (vals[n // 2][0] + vals[(n - 1) // 2][0]) / 2, vals[n // 2][1])


def test_focus_and_closure(spark):
    known = ["cart-service", "pay", "cartservice", "unknown", "shipping-service"]
    assert incident.focus_services("why is PAY slow, and shipping?", known) == ["pay", "shipping-service"]
    assert incident.focus_services("payment of unknown", known) == []
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "source_service string, target_service string")
    got = {(r["service"], r["dependent"]) for r in incident.transitive_dependents(edges).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc" if x != y}
    assert incident.transitive_dependents(edges.limit(0)).count() == 0


def test_lanes_of_nothing(spark):
    empty = spark.createDataFrame([], "lane string, seq long")
    assert lanes.strata(empty, "seq").count() == 0 and lanes.positions(empty, ["lane"], "seq").count() == 0


def test_edges_of_wide_keys(spark):
    random.seed(7)
    rows = [("hot", random.choice(["a", "b", None]), i * 97) for i in range(500)] + [("few", "a", 5), ("few", "a", 100_000), (None, "a", 7), ("one", "a", 8)]
    df = spark.createDataFrame(rows, "k string, lane string, seq long").repartition(5)
    want = set()
    for group in {r[:2] for r in rows if r[0]}:
        seqs = sorted(r[2] for r in rows if r[:2] == group)
        want |= {(*group, x, y) for x, y in itertools.pairwise(seqs)}
    got = [tuple(r) for r in lanes.correlation_edges(df, "k", "lane", "seq").collect()]
    assert len(got) == len(want) and set(got) == want


def test_selection_of_rows_is_that_of_packets(spark):
    random.seed(8)
    for budget in (3, 9, 200):
        packets = [selection.Packet(i, random.randint(0, 8), {f: random.randint(1, 6) for f in random.sample("abcd", random.randint(0, 3))}) for i in range(60)]
        weights = dict(zip("abcd", (random.randint(1, 9) for _ in range(4))))
        df = spark.createDataFrame([(p.id, p.cost, [p.affinities.get(f, 0) for f in "abcd"]) for p in packets], "id long, cost long, affinities array<bigint>").repartition(3)
        got = selection.select_rows(df, list(weights.values()), budget)
        assert sorted(got) == selection.select_packets(packets, weights, budget)
        assert all(packets[i].cost == c for i, c in got.items())
    assert selection.select_rows(df.limit(0), [1, 1, 1, 1], 5) == {}
    # one large packet worth more than all the greedy choice, and more than a pool of a hundred before it
    big = [(i, 1, [10]) for i in range(150)] + [(999, 10, [99])]
    df = spark.createDataFrame(big, "id long, cost long, affinities array<bigint>")
    assert selection.select_rows(df, [1], 10) == {999: 10}


def test_quota_by_pages_is_that_of_the_whole_lane():
    random.seed(9)
    for _ in range(200):
        costs = {i: random.choice([0, 1, 2, 3, 5, 9, 30]) for i in range(120)}
        ranked = random.sample(range(120), random.choice([0, 4, 119]))
        others = [(random.sample(range(120), 6), random.randint(0, 20)) for _ in range(3)]
        own, budget = random.randint(0, 60), random.randint(60, 200)
        lane = [(at, i, costs[i]) for at, i in enumerate(ranked)]

        def page(after, left, lane=lane):
            return [x for x in lane if (after is None or x[0] > after) and x[2] <= left][:3]

        want = selection.quota_hybrid([(ranked, own), *others], costs, budget)
        got = selection.quota_hybrid_paged(page, lane[:6], own, others, costs, budget)
        assert list(got) == want and all(costs[i] == c for i, c in got.items())


def test_neighbours_of_every_anchor(spark):
    from loglattice.plans import ranking_queries

    if not os.path.exists(SMALL):
        pytest.skip("no test tables here")
    lanes_of: dict[str, list[int]] = {}
    for stream, i in ranking_queries._lane_rows(spark, SMALL).select("log_stream", "delivery_id").collect():
        lanes_of.setdefault(stream, []).append(i)
    want = set()
    for stream, ids in lanes_of.items():
        ids.sort()
        want |= {(stream, a, b) for at, a in enumerate(ids) if a % 20 == 0 for b in ids[max(0, at - 2) : at + 3]}
    got = [tuple(r) for r in ranking_queries.neighbours_in_lane(spark, SMALL).collect()]
    assert len(got) == len(want) and set(got) == want


def test_fusion_of_whole_rankings(spark):
    random.seed(10)
    rows = [(i, random.randint(0, 3), random.choice([False, True]), random.randint(0, 900)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a long, b boolean, s long").repartition(4)
    by_s = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[3], r[0])), 1)}
    by_ab = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], not r[2], r[0])), 1)}
    lists = [ranking.full_ranks(df, "id", ["s"]), ranking.full_ranks(df, "id", ["a", "b"])]
    assert [{r["id"]: r["rank"] for r in x.collect()} for x in lists] == [by_s, by_ab]
    assert ranking.full_ranks(df.limit(0), "id", ["s"]).count() == 0


def test_rrf_counts_ranks_beyond_the_first_hundred(spark, monkeypatch):
    from loglattice.plans import ranking_queries as rq

    n = 150
    scores = spark.createDataFrame([(i, 1000 - i, 1) for i in range(n)], "doc_id long, score long, matched long")
    features = spark.createDataFrame([(i, False, 0, 0, 1, i) for i in range(n)], "doc_id long, full_match boolean, identifier_exact long, exact long, matched long, specificity long")
    monkeypatch.setattr(ranking, "bm25f_scores", lambda *a: scores)
    monkeypatch.setattr(ranking, "query_features", lambda *a: features)
    monkeypatch.setattr(rq, "_docs", lambda *a: None)
    fused = {i: 1_000_000 // (61 + i) + 1_000_000 // (60 + n - i) for i in range(n)}
    want = sorted(fused.items(), key=lambda x: (-x[1], x[0]))[:100]
    got = rq.rrf_fuse(spark, "").orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == want and all(r["truncated"] for r in got)


def test_every_error_and_purchase_is_a_label(spark, monkeypatch):
    from loglattice.plans import corpus_queries

    if not os.path.exists(SMALL):
        pytest.skip("no test tables here")
    seen = []
    monkeypatch.setattr(corpus_queries.corpus, "shadow_bonus", lambda labels, *a, **k: seen.append(labels) or labels)
    corpus_queries.shadow_bonus(spark, SMALL)
    events = spark.read.parquet(f"{SMALL}/events.parquet").where("event_type in ('error', 'purchase')")
    want = {(str(r[0]), r[0] % 60, 1 if r[0] % 31 else -1) for r in events.select("event_id").collect()}
    assert {tuple(r) for r in seen[0].select("native_id", "case_id", "label").collect()} == want
