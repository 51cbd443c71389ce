import random

import pytest
from pyspark.sql import functions as F

from loglattice.functions import signals
from loglattice.functions.records import parse_records
from loglattice.operators import analysis, feedback, receipts, selection

UUID = "6c106fc2-789a-4b68-8b48-f2375b55a60b"
TEXTS = [f"see -a/b.c-d/{UUID}. x", "io.x.ParseError: no error, failed E0308 e0000", "without failure; zero crash. panicked", "feature-flag-enabled then config_reloaded", "...", "", None, "ERROR error/fatal"]


def test_tokens_and_signals(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "i long, t string, failures string")
    got = {r["i"]: r["x"] for r in df.select("i", signals.compound_tokens(F.col("t")).alias("x")).collect()}
    assert all(got[i] == (None if t is None else signals.compound_tokens_of(t)) for i, t in enumerate(TEXTS))
    assert got[0] == ["see", f"a/b.c-d/{UUID}", "a", "b.c-d", "b", "c", "d", UUID, "x"]
    kinds = {r["i"]: (r["failures"], r["onsets"]) for r in signals.signals(df, ["i"], "t").collect()}
    assert kinds[1] == (["exception", "failure", "compiler_error"], []) or kinds[1][0][-2:] == ["failure", "compiler_error"]
    assert kinds[2] == (["panic"], []) and kinds[3][1] == ["feature_flag_change", "configuration_change"]
    assert kinds[6] == ([], []) and kinds[7][0].count("error") == 2


def test_question():
    q = signals.question_of(f"Why did {UUID} fail with E0308? trace_id 4bf92f3577b34da6a3ce929d0e0e4736 on svc-a")
    assert {k for k, _ in q.identifiers} == {"uuid", "compiler_code", "trace_id"}
    assert set(q.terms) == {"fail", "svc-a", "svc"} and "why" not in q.terms
    with pytest.raises(signals.QueryTooLarge):
        signals.question_of("w " * 300)


def test_question_lane(spark):
    df = spark.createDataFrame([(1, "registry/registry lost"), (2, None), (3, f"id {UUID}"), (4, "nothing")], "doc long, text string")
    q = signals.question_of(f"registry {UUID}")
    got = {(r["doc"], r["facet_id"]): (r["tf"], r["mandatory"]) for r in signals.question_lane(df, "doc", "text", q).collect()}
    assert got == {(1, "term:registry"): (2, False), (3, f"identifier:{UUID}"): (1, True)}


def test_accounting(spark):
    whole = spark.createDataFrame([(i, 10) for i in range(6)], "id long, n long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = {r["disposition"]: (r["n_records"], r["n_bytes"]) for r in receipts.accounting(whole, {"a": ids(0, 1), "b": ids(2, 3, 4, 5)}, "id", "n").collect()}
    assert got == {"a": (2, 20), "b": (4, 40)}
    for parts in ({"a": ids(0)}, {"a": ids(*range(6)), "b": ids(3)}, {"a": ids(*range(7))}):
        with pytest.raises(receipts.Unaccounted):
            receipts.accounting(whole, parts, "id", "n")
    runs = spark.createDataFrame([(i, "complete", 5) for i in range(6)], "case_id long, status string, cost long")
    cases = whole.withColumnRenamed("id", "case_id")
    assert receipts.run_totals(cases, runs, "cost").first()["total_cost"] == 30
    with pytest.raises(receipts.Unaccounted):
        receipts.run_totals(cases, runs.union(runs.limit(1)), "cost")


def test_citations_and_status(spark):
    cites = spark.createDataFrame([("a", "1", "lost"), ("a", "2", "lost"), ("a", "3", "lost"), ("a", "9", "lost")], "hypothesis string, event_id string, quote string")
    shown = spark.createDataFrame([("1", "a", "it lost"), ("2", "b", "lost it"), ("3", "c", "lost")], "event_id string, service string, sample string")
    deps = spark.createDataFrame([("a", "b")], "service string, dependent string")
    assert {r["event_id"]: r["holds"] for r in receipts.verified_citations(cites, shown, deps).collect()} == {"1": True, "2": True, "3": False, "9": False}
    assert receipts.report_status({}) == "source_linked_hypotheses" and receipts.report_status({"abstained": True}) == "partial"


def test_feedback_states():
    p = feedback.Promotions()
    p.promote([3, 1])
    p.promote([5])
    p.demote(5)
    assert p.members() == ()
    p.rollback()
    p.rollback()
    assert p.members() == (1, 3)
    with pytest.raises(feedback.NotAllowed):
        p.promote(range(17))
    good = feedback.Trial(12, 3, 3, 12, 4, 8, 0, 1.0, 1.0)
    r = feedback.Routes()
    a = r.register("d")
    with pytest.raises(feedback.NotAllowed):
        r.promote(a, feedback.Trial(12, 3, 3, 12, 11, 1, 0, 1.0, 1.0), "d")
    with pytest.raises(feedback.NotAllowed):
        r.promote(a, good, "other labels")
    r.promote(a, good, "d")
    b = r.register("d")
    r.promote(b, good, "d")
    assert r.active() == b
    r.rollback()
    assert r.active() == a


def test_more_selection():
    packets = [selection.Packet(0, 5, {"term:a": 5}, mandatory=True), selection.Packet(1, 4, {"term:b": 9, "failure:x": 3}), selection.Packet(2, 4, {"failure:x": 4})]
    w = {"term:a": 1, "term:b": 1, "failure:x": 1}
    assert selection.pack_in_order(packets, [2, 1, 0], 10) == [0, 2]
    with pytest.raises(ValueError):
        selection.pack_in_order(packets, [1, 1, 2], 10)
    assert selection.normalized_gain(packets, w, [1, 2]) == 1.0 and selection.normalized_gain(packets, w, []) == 0.0
    assert [p.id for p in selection.without_lane(packets, "failure:")] == [0, 1]
    assert selection.grep_head_tail([5], 10, dict.fromkeys(range(10), 1), 4, head=2, tail=2) == [0, 5, 8, 9]


def test_compact_and_analyze(spark):
    random.seed(8)
    raws = [f'{{"timestamp":{1000 + i},"service":"s{i % 4}","level":"{"error" if i % 5 == 0 else "info"}","message":"did thing {i % 9}"}}' for i in range(300)]
    lines = spark.createDataFrame(list(enumerate(raws)), "line long, raw string")
    out = analysis.compact(lines, selection.gravest, 2000).collect()
    assert out and [r["line"] for r in out] == sorted(r["line"] for r in out) and all(r["raw"] == raws[r["line"]] for r in out)
    assert sum(len(r["raw"]) for r in out) <= 2000
    secret = spark.createDataFrame([(0, "password=1 error")], "line long, raw string")
    with pytest.raises(analysis.Sensitive):
        analysis.compact(secret)
    assert analysis.expand(lines, 5, 2, 2).count() == 5
    members = parse_records(lines.select(F.col("line").cast("string").alias("native_id"), (F.col("line") * 1000).alias("ts_ms"), "raw"), "raw")
    topo = spark.createDataFrame([("s1", "s0"), ("s2", "s1")], "source_service string, target_service string")
    points = spark.createDataFrame([(1000 + i, "s0", "cpu", float(i), i) for i in range(300)], "at long, service string, metric string, value double, id long")
    got = analysis.analyze(members, points, None, topo, 1150, 300, "why is s0 slow?")
    assert got["focus"] == ["s0"] and got["metrics"].count() == 1 and got["status"] == "partial"
    services = {r["service"]: r for r in got["services"].collect()}
    assert services["s0"]["transitive_dependents"] == 2 and services["s0"]["error_count"] == 15


def test_brief():
    from loglattice.operators import brief

    records = [("a", b"one\n"), ("b", b"two \xff\\"), ("c", b"three")]
    assert brief.passthrough(records, 1000) == "# all records\na one\\x0a\nb two \\xff\\x5c\nc three\n"
    assert brief.passthrough(records, 20) is None
    text = brief.compiled(records, ["c", "a"], {"c": "error"}, 1000)
    assert text.splitlines()[1:3] == ["E1 a context one\\x0a", "E2 c error three"] and "6 bytes in 1 records" in text
    with pytest.raises(ValueError):
        brief.compiled(records, ["z"], {}, 1000)


def test_directory(spark):
    from loglattice.operators import corpus

    rows = [(i, f"s{i % 7}", "error", 1, i, i, str(i), str(i)) for i in range(70)]
    groups = spark.createDataFrame(rows, "group_id long, service string, role string, repeat_count long, first_timestamp_millis long, last_timestamp_millis long, first_native_id string, last_native_id string")
    got = corpus.directory_expansion(groups, lambda offered: [offered[0]["service"]], page=3, pages=2, most=6).collect()
    assert [r["service"] for r in sorted(got, key=lambda r: r["rank"])] == ["s0", "s3"] * 3
    assert corpus.directory_expansion(groups, lambda offered: [], page=3).count() == 0
    with pytest.raises(ValueError):
        corpus.directory_expansion(groups, lambda offered: ["s9"])
