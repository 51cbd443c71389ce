import random

import pytest

from loglattice.operators import late_events as le
from loglattice.session import work_folder

H = 3_600_000
SPEC = le.WindowSpec(("g",), "at", "arrived")
ROW = "g string, at long, arrived long"


def brute(rows):
    out = {}
    for g, at, arrived in rows:
        if g is None or at is None or arrived is None:
            continue
        p = at // H * H
        c = out.setdefault((g, p), [0, 0, 0])
        c[0 if arrived < p + H else 1 if arrived < p + 7 * H else 2] += 1
    return {k: tuple(v) for k, v in out.items()}


def as_dict(df):
    return {(r["g"], r["period_start_millis"]): (r["n_on_time"], r["n_corrected"], r["n_dropped"]) for r in df.collect()}


EDGES = [("a", 0, H - 1), ("a", 0, H), ("a", H - 1, 7 * H - 1), ("a", 5, 7 * H), ("a", -1, -1), ("a", -H, 0), (None, 1, 1), ("b", None, 1), ("b", 1, None)]


def random_rows(n, seed):
    random.seed(seed)
    return [(random.choice("abc"), at := random.randint(0, 40 * H), at + random.choice([0, 10, H, 8 * H])) for _ in range(n)]


@pytest.fixture
def state(spark):
    return le.WindowState(spark, work_folder(spark, "windows"), SPEC)


def test_edges_and_nulls(spark):
    df = spark.createDataFrame(EDGES, ROW)
    state = le.taken_in(df, SPEC)
    assert as_dict(state.windows()) == brute(EDGES) == {("a", 0): (1, 2, 1), ("a", -H): (1, 1, 0)}
    late = le.late_windows(state.windows())
    assert {(r["period_start_millis"], r["n_events"]) for r in late.collect()} == {(0, 3), (-H, 2)}
    report = {(r["g"], r["at"], r["reason"]) for r in state.diverted().collect()}
    assert report == {("a", 5, "late"), (None, 1, "incomplete"), ("b", None, "incomplete"), ("b", 1, "incomplete")}


@pytest.mark.parametrize("slots", [1, 3, 5])
def test_slots_give_the_whole(spark, slots):
    rows = random_rows(600, 1)
    assert as_dict(le.taken_in(spark.createDataFrame(rows, ROW), SPEC, slots=slots).windows()) == brute(rows)


def test_a_window_of_dropped_records_only_counts_none(spark):
    rows = [("a", 0, 9 * H)]
    got = le.late_windows(le.taken_in(spark.createDataFrame(rows, ROW), SPEC).windows()).collect()
    assert [(r["period_start_millis"], r["n_events"], r["n_dropped"]) for r in got] == [(0, 0, 1)]


def test_windows_behind_the_watermark_leave_the_state(spark, state):
    """Without the watermark the state would grow with history, and a batch out of order would change windows already given out."""
    rows = sorted(random_rows(900, 2), key=lambda r: r[2])
    for b in range(9):
        state.advance(spark.createDataFrame(rows[b * 100 : (b + 1) * 100], ROW), b)
        mark = state.watermark()
        assert mark == rows[b * 100 + 99][2]
        assert all(r["period_start_millis"] + 7 * H > mark for r in state.state.read().collect())
    assert state.state.read().count() < len(brute(rows)) / 2
    assert as_dict(state.windows()) == brute(rows)
    assert len(state.state.committed()) <= 2  # old versions go
    state.advance(spark.createDataFrame([("a", 0, H), ("a", 1, 20 * H)], ROW), 9)  # arrived in time, but its batch came too late
    assert {(r["at"], r["reason"]) for r in state.diverted(9).collect()} == {(0, "behind"), (1, "late")}
    assert state.updates(9).count() == 0 and state.watermark() == rows[-1][2]


def test_updates_are_whole_counts_of_changed_windows(spark, state):
    state.advance(spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 2)], ROW), 0)
    state.advance(spark.createDataFrame([("a", 0, H + 1)], ROW), 1)
    assert as_dict(state.updates(1)) == {("a", 0): (2, 1, 0)}
    state.advance(spark.createDataFrame([("a", 0, H + 1)], ROW), 1)  # delivered again
    assert as_dict(state.windows()) == {("a", 0): (2, 1, 0), ("b", 0): (1, 0, 0)}


def test_allowed_disorder(spark):
    state = le.WindowState(spark, work_folder(spark, "windows"), SPEC, disorder_ms=2 * H)
    state.advance(spark.createDataFrame([("a", 7 * H, 8 * H)], ROW), 0)
    assert state.watermark() == 6 * H
    state.advance(spark.createDataFrame([("a", 0, 6 * H)], ROW), 1)
    assert as_dict(state.windows())[("a", 0)] == (0, 1, 0)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], ROW)
    state = le.taken_in(empty, SPEC)
    assert state.windows().count() == 0 and state.diverted().count() == 0
    rows = spark.createDataFrame([("a", 0, 1, "x", 5)], ROW + ", batch string, n_events long")
    assert as_dict(le.taken_in(rows, SPEC).windows()) == {("a", 0): (1, 0, 0)}
