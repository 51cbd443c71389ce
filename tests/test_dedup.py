import random

import pytest

from loglattice.operators import dedup
from loglattice.session import created_alone, work_folder


def ids(df):
    return sorted(r[0] for r in df.collect())


def n_bits(store):
    return store.seen_bits().selectExpr("sum(bitmap_count(_ll_bits))").first()[0]


ROWS = [(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, None, "n"), (5, "", "e"), (6, "", "f"), (7, None, "n"), (8, "A", "case"), (9, "a", None)]


@pytest.fixture
def store(spark):
    return dedup.SeenStore(spark, work_folder(spark, "seen"), ["id"], buckets=3)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_copies_in_batches(spark, batches):
    df = spark.createDataFrame(ROWS, "row long, id string, text string")
    assert ids(dedup.repeated_deliveries(df, ["id"], "row", batches=batches)) == [3, 6, 9]
    first = dedup.first_copies(df, ["id"], "row", ["text"])
    assert sorted((r["row"], r["text"]) for r in first.collect()) == [(1, "x"), (2, "y"), (4, "n"), (5, "e"), (7, "n"), (8, "case")]


def test_two_part_identifier_and_null_row(spark):
    df = spark.createDataFrame([(1, "s", "n"), (2, "s", "N"), (3, "s", None), (4, "s", "n"), (None, "s", "n"), (5, "t", "n"), (4, "s", "n")], "row long, s string, n string")
    assert ids(dedup.repeated_deliveries(df, ["s", "n"], "row")) == [4, 4]


def test_batches_keep_what_one_batch_keeps(spark, store):
    random.seed(4)
    rows = [(i, f"e{random.randint(0, 400)}" if random.random() > 0.02 else None) for i in range(1500)]
    whole = spark.createDataFrame(rows, "row long, id string")
    kept = []
    for b in range(3):
        part = spark.createDataFrame(rows[b * 500 : (b + 1) * 500], "row long, id string")
        kept += ids(store.apply(part, "row", f"{b}"))
    want = set(r[0] for r in rows if r[1]) - set(ids(dedup.repeated_deliveries(whole, ["id"], "row")))
    assert set(kept) == want and len(kept) == len(want)
    # applied again, a batch gives the same and adds nothing
    again = spark.createDataFrame(rows[500:1000], "row long, id string")
    assert set(ids(store.apply(again, "row", "1"))) == {k for k in kept if 500 <= k < 1000}
    assert store.committed() == ["0", "1", "2"]
    assert n_bits(store) == len({r[1] for r in rows if r[1]})


def test_only_a_set_bit_keeps_an_arrival_out(spark, store, monkeypatch):
    """Registered identifiers are in the dictionary but not seen; without the bitmaps copies of earlier batches come through."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "row long, id string")
    store.register(df)
    assert store.state().bits == []
    assert ids(store.apply(df, "row", "0")) == [1, 2]
    later = df.selectExpr("row + 10 as row", "id")
    assert ids(store.apply(later, "row", "1")) == []
    monkeypatch.setattr(store, "_unseen", lambda coded, bits: coded)
    assert ids(store.apply(later, "row", "2")) == [11, 12]


def test_two_writers_keep_one_copy(spark, store):
    """B commits between A's selection and A's commit: A selects again."""
    other = dedup.SeenStore(spark, store.path, ["id"], buckets=3)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row long, id string")
    b = spark.createDataFrame([(3, "x"), (4, "z")], "row long, id string")
    real, raced = store._commit, []

    def late(*args):
        if not raced:
            raced.append(ids(other.apply(b, "row", "B")))
        return real(*args)

    store._commit = late
    assert ids(store.apply(a, "row", "A")) == [2] and raced == [[3, 4]]
    entries = [tuple(r)[1:] for p in store.state().ids for r in store._dictionary(p, 3).collect()]
    assert len(entries) == len(set(entries)) == 3  # no code twice
    assert n_bits(store) == 3 and store.committed() == ["A", "B"]


def test_a_retried_writer_leaves_a_committed_batch_alone(spark, store):
    """The same batch by two writers: the second gets the first one's answer."""
    other = dedup.SeenStore(spark, store.path, ["id"], buckets=3)
    df = spark.createDataFrame([(1, "a"), (2, "a")], "row long, id string")
    real, once = store._commit, []

    def late(*args):
        if not once:
            once.append(ids(other.apply(df, "row", "x")))
        return real(*args)

    store._commit = late
    assert ids(store.apply(df, "row", "x")) == [1] == once[0]
    assert store.state().version == 1


def test_uncommitted_parts_do_not_count(spark, store):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "row long, id string")
    store._attempt(df, "row", 1, store.state(), "leftover")
    assert store.committed() == [] and ids(store.apply(df, "row", "x")) == [1]


def test_a_commit_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/c/1"
    assert created_alone(spark, path, "a") and not created_alone(spark, path, "b")
    assert open(path).read() == "a" and len(list((tmp_path / "c").iterdir())) <= 2  # its checksum beside it


def test_the_dictionary_is_not_shuffled(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(200).selectExpr("id as row", "concat('e', id) as id")
        store.apply(df, "row", "0")
        old = store._dictionary(store.state().ids[0], 3)
        arrivals = store._arrivals(df, "row").repartition(3, "_ll_id0")
        plan = arrivals.join(old, "_ll_id0", "left")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "row long, id string, text string")
    assert dedup.repeated_deliveries(empty, ["id"], "row").count() == 0
    assert dedup.first_copies(empty, ["id"], "row", ["text"]).count() == 0


def test_hot_identifier(spark):
    df = spark.range(3000).selectExpr("id as row", "if(id % 3 = 0, 'hot', cast(id as string)) as id")
    assert dedup.repeated_deliveries(df, ["id"], "row").count() == 999


def test_codes_beyond_one_bitmap(spark, store):
    df = spark.range(70_000).selectExpr("id as row", "concat('i', id % 69000) as id").coalesce(1)
    assert store.apply(df, "row", "0").count() == 69_000
    assert store.apply(df.selectExpr("row + 100000 as row", "id"), "row", "1").count() == 0


def test_compaction_changes_no_answer(spark, store):
    parts = [spark.range(100).selectExpr(f"id + {b}000 as row", f"concat('e', id + {b * 40}) as id") for b in range(4)]
    kept = [ids(store.apply(p, "row", f"{b}")) for b, p in enumerate(parts[:3])]
    assert [len(k) for k in kept] == [100, 40, 40]
    assert n_bits(store) == 180
    assert store.compact() and store.compact()
    assert len(store.state().ids) == len(store.state().bits) == 1 and n_bits(store) == 180
    assert len(ids(store.apply(parts[3], "row", "3"))) == 40
    assert ids(store.apply(parts[1], "row", "1")) == kept[1]  # a replay
    assert store.compact() and n_bits(store) == 220


def test_many_batches_compact_by_themselves(spark, store):
    for b in range(dedup.MOST_DICTIONARIES + 1):
        assert len(ids(store.apply(spark.range(3).selectExpr(f"id + {b}0 as row", f"concat('e', id + {b}) as id"), "row", f"{b}"))) == (3 if b == 0 else 1)
    assert len(store.state().ids) == 2
