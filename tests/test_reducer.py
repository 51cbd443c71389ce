import random

import pytest
from pyspark.sql import functions as F

from loglattice.functions.signals import Question
from loglattice.operators import analysis, corpus, feedback, lanes, reducer
from loglattice.session import work_folder

ID = "123e4567-e89b-12d3-a456-426614174000"
ASKED = Question(("disk", "lost"), (("uuid", ID),))


def plain(blocks, cap):
    """blocks: (id, text) in order."""
    words = {b: set((t or "").lower().replace(":", " ").split()) for b, t in blocks}
    size = {b: len((t or "").encode()) for b, t in blocks}
    ids = sorted(words)
    n = len(ids)
    if n <= 1 or (n <= cap.blocks and sum(size.values()) <= cap.partition_bytes):
        return {b: "whole" for b in ids}
    df = {t: sum(t in w for w in words.values()) for t in ASKED.terms}
    must = [b for b in ids if ID in words[b]]
    strata = [ids[min((2 * i + 1) * n // 16, n - 1)] for i in range(8)]
    out = {b: "stratum" for b in strata} | {b: "mandatory" for b in must}
    used = sum(size[b] for b in out)
    score = {b: sum(n - df[t] + 1 for t in ASKED.terms if t in words[b]) + (2 * n if words[b] & set(reducer.FAILURE_WORDS) else 0) for b in ids}
    for b in sorted(ids, key=lambda b: (-score[b], b)):
        if len(out) >= cap.blocks:
            break
        if b not in out and used + size[b] <= cap.working_bytes:
            out[b] = "ranked"
            used += size[b]
    return out


@pytest.mark.parametrize("cap", [reducer.Capacity(), reducer.Capacity(40, 10**6, 900), reducer.Capacity(15, 10**6, 10**6), reducer.Capacity(400, 100, 1200)])
def test_reduced(spark, cap):
    random.seed(11)
    blocks = [(i * 3, " ".join(random.choice(["disk", "lost", "error", "fine", "words", "here"]) for _ in range(random.randint(1, 9)))) for i in range(120)]
    blocks += [(1000, None), (1001, ""), (1002, f"has {ID}"), (1003, "disk " * 500)]
    df = spark.createDataFrame(blocks, "block_id long, text string").repartition(4)
    assert {r["block_id"]: r["reason"] for r in reducer.reduced(df, ASKED, cap).collect()} == plain(blocks, cap)


def test_reduced_nothing(spark):
    empty = spark.createDataFrame([], "block_id long, text string")
    assert reducer.reduced(empty, ASKED).count() == 0 and reducer.reduced(empty, Question((), ())).count() == 0


def test_around_within(spark):
    rows = [("a", i, 10 if i != 4 else 100) for i in range(9)] + [("b", 100, 5)]
    df = spark.createDataFrame(rows, "lane string, seq long, n long")
    anchors = spark.createDataFrame([("a", 2), ("a", 6), ("b", 100)], "lane string, seq long")
    got = {}
    for r in lanes.around_within(df, "lane", "seq", "n", anchors, 3, 50).collect():
        got.setdefault(r["anchor"], set()).add(r["seq"])
    assert got == {2: {0, 1, 2, 3}, 6: {5, 6, 7, 8}, 100: {100}}
    assert lanes.around_within(df, "lane", "seq", "n", anchors, 3, 9).collect() == [("b", 100, 100)]


def test_group_examples(spark):
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(6)], "line long, raw string")
    groups = spark.createDataFrame([("g", "error", 0, 3), ("h", "context", 2, 2)], "group_id string, role string, first_line long, last_line long")
    got = {(r["group_id"], r["line"]) for r in analysis.group_examples(lines, groups).collect()}
    assert got == {("g", i) for i in (0, 1, 2, 3, 4)} | {("h", 2)}


def test_labels_digest_changes_with_labels_and_groups(spark):
    groups = spark.createDataFrame([(1, "s", "error", "f"), (2, "s", "error", "g")], "group_id long, service string, role string, fingerprint string")
    members = spark.createDataFrame([("a", 1), ("b", 2)], "native_id string, group_id long")
    labels = spark.createDataFrame([(1, "a", 1), (1, "b", -1), (2, "gone", 1)], "case_id long, native_id string, label int")
    digest = lambda *x: tuple(corpus.labels_digest(*x).first())
    base = digest(labels, members, groups)
    assert base[0] == 3 and base == digest(labels.repartition(3), members, groups)
    others = [
        digest(labels.withColumn("label", F.lit(1)), members, groups), digest(labels.where("case_id = 1"), members, groups),
        digest(labels, members.withColumn("group_id", F.lit(1).cast("long")), groups), digest(labels, members, groups.withColumn("fingerprint", F.upper("fingerprint"))),
    ]
    assert len({base, *others}) == 5
    assert digest(labels.limit(0), members, groups)[0] == 0


def test_feedback_survives_a_restart(spark):
    path = work_folder(spark, "feedback")
    store = feedback.Store(spark, path)
    assert store.verdicts().count() == 0 and store.promotions("t").members() == ()
    store.add_verdicts(spark.createDataFrame([("t", "a", "n1", 1), ("t", "a", "n2", 1)], feedback.VERDICTS), 0)
    store.add_verdicts(spark.createDataFrame([("t", "a", "n1", -1)], feedback.VERDICTS), 1)
    store.add_verdicts(spark.createDataFrame([("t", "a", "n2", -1)], feedback.VERDICTS), 1)  # taken in before
    again = feedback.Store(spark, path)
    assert {(r["nonce"], r["verdict"]) for r in again.verdicts().collect()} == {("n1", -1), ("n2", 1)}
    again.change_promotions("t", lambda p: p.promote([3, 1]))
    again.change_promotions("t", lambda p: p.demote(3))
    assert store.promotions("t").members() == (1,)
    assert store.change_promotions("t", lambda p: p.rollback()).members() == (1, 3)
    with pytest.raises(feedback.NotAllowed):
        store.change_promotions("u", lambda p: p.rollback())
    trial = feedback.Trial(12, 3, 3, 12, 4, 8, 0, 1.0, 1.0)
    store.change_routes(lambda r: r.register("d"))
    again.change_routes(lambda r: r.promote(0, trial, "d"))
    assert feedback.Store(spark, path).routes().active() == 0

    def raced(p):
        again.change_promotions("t", lambda q: q.demote(1))
        p.demote(3)

    with pytest.raises(feedback.NotAllowed):
        store.change_promotions("t", raced)
    assert store.promotions("t").members() == (3,)
