import random

import pandas as pd
import pytest

from loglattice.functions.layouts import Router
from loglattice.llm import runs

R = Router()
key = lambda t: runs.same_event_key(R, t)

SAME = [
    ("[svc-a] WARN: cache waited 5.48s for shard 'morel'", "[svc-a] WARN: CACHE WAITED 19m51s FOR SHARD 'OTHER'"),
    ("[svc-a] INFO: pool holds 936 B for 17 shards", "[svc-a] INFO: pool  holds 122.7 KiB for 3 shards request-id: r7815cb73"),
    ("[svc-a] INFO: lease 6c106fc2-789a-b68b-8b48-f2375b55a60b moved", "[svc-a] INFO: lease deadbeef-beef-beef-beef-deadbeefbeef moved span_id=r1"),
    ("[svc-a] INFO: token 94fce407415d lost at 10.0.0.1:80", "[svc-a] INFO: token 7e0000000000 lost at 10.250.1.7:53352"),
    ("[svc-a] INFO: seen at 2022-08-26T18:57:43Z on node-12", "[svc-a] INFO: seen at 2021-01-01T00:00:00Z on node-399"),
    ("2023-01-09T11:31:02.583Z WARN  [svc-a] slow", "2023-01-10T00:00:00.001Z  WARN [svc-a] slow"),
    ("GET /v2/labels 200 877.925 ms - 66323", "GET /v2/labels 404 1.0 ms - 1"),
    ('level=info msg="wrote 675.8\\u00b5s" service=a ts=2023-01-09T11:31:02Z', 'level=info msg="wrote 5 ms" service=a ts=2023-01-09T11:31:03Z trace_id=77'),
]
DIFFERENT = [
    ("[svc-a] INFO: opened", "[svc-b] INFO: opened"),
    ("[svc-a] INFO: opened", "[svc-a] WARN: opened"),
    ("[svc-a] INFO: opened mirror", "[svc-a] INFO: opened cache"),
    ("[svc-a] INFO: opened", "[svc-a] INFO: opened\n  state of pool"),
    ("GET /v2/labels 200 877.925 ms - 66323", "PUT /v2/labels 200 877.925 ms - 66323"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_values_do_not_matter(a, b):
    assert key(a) == key(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_words_level_and_component_do(a, b):
    assert key(a) != key(b)


def test_symbols():
    assert runs.symbol_runs(list("aabccc")) == [(0, 2), (2, 3), (3, 6)]
    assert runs.symbol_runs([]) == []
    many = [i // 2 for i in range(2 * 60_000)][: runs.PIECE]
    assert len(runs.symbol_runs(many)) == runs.PIECE // 2


def as_set(df):
    return {(r["entity"], bytes(r["same"]), r["first_id"], r["last_id"], r["first_ms"], r["last_ms"], r["n_events"]) for r in df.collect()}


@pytest.mark.parametrize("partitions, most", [(7, 3), (3, 2)])
def test_runs_over_task_borders(spark, partitions, most):
    random.seed(partitions)
    rows = []
    for i in range(800):
        rows.append((random.choice(["hot", "hot", "hot", "b", "c"]), random.randint(0, 300), f"{i:05d}", bytes([random.randint(1, most)] * 2), "clash"))
    rows += [("solid", i, f"s{i}", b"same", "x") for i in range(900)]  # one run over several whole tasks
    rows += [("x", None, "1", b"a", ""), (None, 1, "2", b"a", ""), ("x", 1, None, b"a", ""), ("x", 1, "3", None, "")]
    df = spark.createDataFrame(rows, "entity string, at long, id string, digest binary, part string")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = runs.collapse_runs(df, "entity", "at", "id", "digest")
        full = pd.DataFrame([r[:4] for r in rows if None not in r[:4]], columns=["entity", "ms", "id", "same"])
        want = set(map(tuple, [(e, s, a, b, m, n, c) for e, s, a, b, m, n, c in runs.runs_in_order(full)]))
        assert as_set(got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_and_null_messages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "x" * 500_000)], "id long, text string")
    got = {r["id"]: r["same"] for r in runs.event_keys(df, "text", ["id"]).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None and got[4] is not None
    empty = spark.createDataFrame([], "entity string, at long, id string, digest binary")
    assert runs.collapse_runs(empty, "entity", "at", "id", "digest").count() == 0
