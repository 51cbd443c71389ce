import json
import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import late_events as le
from loglattice.sources import files, runs
from loglattice.sources.pages import IntegrityError, RecordedPages, read_page
from loglattice.streaming import pipelines, sync
from loglattice.streaming.versions import Versions

H = 3_600_000


@pytest.fixture()
def folders(tmp_path):
    return lambda name: str(tmp_path / name)


def feed(spark, path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/p{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def test_messages_kept_once_over_batches(spark, folders):
    random.seed(1)
    rows = [(i, f"e{random.randint(0, 60)}" if i % 20 else None, f"t{i}") for i in range(200)]
    stream = feed(spark, folders("in"), [rows[i : i + 50] for i in range(0, 200, 50)], "row long, id string, text string")
    pipelines.run(stream, pipelines.keep_once(["id"], "row", folders("seen"), folders("out")), folders("cp")).awaitTermination(120)
    got = [r["id"] for r in spark.read.parquet(folders("out")).collect()]
    assert len(got) == len({r[1] for r in rows if r[1]}) + sum(r[1] is None for r in rows)
    assert len({g for g in got if g}) == len([g for g in got if g])


def test_windows_corrected_over_batches(spark, folders):
    random.seed(2)
    spec = le.WindowSpec(("g",), "at", "arrived")
    rows = [(random.choice("ab"), at := random.randint(0, 9 * H), at + random.choice([0, H, 9 * H])) for _ in range(150)]
    rows.sort(key=lambda r: r[2])
    schema = "g string, at long, arrived long"
    stream = feed(spark, folders("in"), [rows[:50], rows[50:100], rows[100:]], schema)
    pipelines.run(stream, pipelines.correct_windows(spec, folders("state"), disorder_ms=20 * H), folders("cp")).awaitTermination(120)
    state = le.WindowState(spark, folders("state"), spec)
    whole = le.taken_in(spark.createDataFrame(rows, schema), spec).windows()
    order = ["g", "period_start_millis", *le.COUNTERS]
    assert sorted(map(tuple, state.windows().select(*order).collect())) == sorted(map(tuple, whole.select(*order).collect()))
    assert state.diverted().count() == whole.agg(F.sum("n_dropped")).first()[0]


def test_versions(spark, folders):
    v = Versions(spark, folders("v"))
    assert v.read() is None
    v.write(spark.range(1), 0)
    v.write(spark.range(5), 1)
    v.write(spark.range(9), 1)  # committed already: unchanged
    assert v.read().count() == 5 and v.read(0).count() == 1
    v.drop_before(1)
    assert v.committed() == [1]


def test_sync_replays_halves_and_stops():
    history = {f"r{i}": (i * 10, "x") for i in range(40)}
    stored = {}

    def fetch(start, end, token):
        inside = sorted((ts, i) for i, (ts, _) in history.items() if start <= ts <= end)
        at = int(token or 0)
        return [(i, ts, "x") for ts, i in inside[at : at + 3]], str(at + 3) if at + 3 < len(inside) else None

    commit = lambda records: stored.update({i: (ts, raw) for i, ts, raw in records})
    cp = sync.Checkpoint()
    assert sync.backfill(fetch, commit, cp, 0, 395, span=400, most_pages=3, most_ranges=2) == "backfilling"
    assert sync.backfill(fetch, commit, cp, 0, 395, span=400, most_pages=3) == "scanned"
    assert stored == history and cp.completed_ms == 395
    history["late"] = (390, "x")
    assert sync.replay(fetch, commit, cp, window=20) == 1 and "late" in stored
    with pytest.raises(sync.InvalidPage):
        sync.read_range(lambda s, e, t: ([], "same"), commit, 0, 1)
    with pytest.raises(sync.InvalidPage):
        sync.read_range(lambda s, e, t: ([("a", 5, "x")], None), commit, 0, 1)
    assert sync.backfill(lambda s, e, t: ([], f"{t}x"), commit, sync.Checkpoint(), 0, 7, span=8, most_pages=2) == "partial"
    assert sync.sweep(None, 0, 99, 10, 3) == ([(0, 9), (10, 19), (20, 29)], 30) and sync.sweep(90, 0, 99, 10)[1] is None
    assert [sync.backoff_seconds(60, n) for n in (0, 3, 9)] == [60, 480, 3600]


def test_a_restart_goes_on(spark, folders):
    history = [(f"r{i}", i * 10, "x") for i in range(20)]
    read = []

    def fetch(start, end, token):
        return [r for r in history if start <= r[1] <= end], None

    commit = lambda records: read.extend(r[1] for r in records)
    cp = sync.StoredCheckpoint(spark, folders("cp"))
    assert cp.completed_ms is None
    assert sync.backfill(fetch, commit, cp, 0, 195, span=50, most_ranges=2) == "backfilling"
    again = sync.StoredCheckpoint(spark, folders("cp"))
    assert again.completed_ms == 99
    assert sync.backfill(fetch, commit, again, 0, 195, span=50) == "scanned" and read == [i * 10 for i in range(20)]
    assert not sync.sweep_on(fetch, commit, again, 0, 195, 40, 3)
    assert sync.StoredCheckpoint(spark, folders("cp")).cursor_ms == 120
    assert sync.sweep_on(fetch, commit, sync.StoredCheckpoint(spark, folders("cp")), 0, 195, 40, 3)
    with pytest.raises(RuntimeError):
        cp.completed_ms = 5  # an older process
    pauses, turns = [], iter(["scanned", sync.PageLimit(), sync.PageLimit(), "scanned"])

    def turn():
        x = next(turns)
        if isinstance(x, Exception):
            raise x
        return x

    assert sync.watch(turn, 4, 60, pauses.append) == ["scanned", "PageLimit", "PageLimit", "scanned"] and pauses == [60, 120, 240]


@pytest.mark.parametrize("content", [b"a\xff\xfeb\n", b"one\r\ntwo\n\xff", b"", b"\n", b"\xef\xbb\xbfx\r\n\r\n\x00y\r", b"a\rb\n\xc3"])
def test_exact_bytes(spark, tmp_path, content):
    (tmp_path / "a.log").write_bytes(content)
    rows = files.exact_lines(spark, str(tmp_path / "a.log")).orderBy("seq").collect()
    want = [x for x in content.split(b"\n")]
    ended = [b"\n"] * (len(want) - 1) + [b""]
    if not want[-1]:
        want, ended = want[:-1], ended[:-1]
    assert b"".join(bytes(r["payload"]) + bytes(r["terminator"] or b"") for r in rows) == content
    assert [r["seq"] for r in rows] == list(range(len(want)))
    assert [(bytes(r["payload"]), bytes(r["terminator"] or b"")) for r in rows] == [(w[:-1], b"\r\n") if e and w.endswith(b"\r") else (w, e) for w, e in zip(want, ended)]


def test_exact_bytes_over_splits(spark, tmp_path):
    random.seed(4)
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(b"".join(bytes(random.randrange(256) for _ in range(random.randint(0, 60))) + random.choice([b"\n", b"\r\n"]) for _ in range(3000)) + b"tail")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = files.exact_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("a", "b"):
        mine = sorted((r for r in rows if r["path"].endswith(f"/{name}")), key=lambda r: r["seq"])
        assert b"".join(bytes(r["payload"]) + bytes(r["terminator"] or b"") for r in mine) == (tmp_path / name).read_bytes()


def test_streamed_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"x\xff\r\ny\n")
    q = files.streamed_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((bytes(r["payload"]), bytes(r["terminator"])) for r in spark.table("lines").collect()) == [(b"x\xff", b"\r\n"), (b"y", b"\n")]


def plain_run(pages, caps):
    """pages: (token that led to it, records); the rules one after the other."""
    seen, tokens, got, size, last = {}, set(), [], 0, None
    for p, (token, records) in enumerate(pages):
        if p >= caps.pages:
            return "page_cap", got
        if token is not None and (token == "" or token in tokens):
            return "pagination_incomplete", got
        tokens.add(token)
        kept, stop = [], None
        for i, (native_id, ts, raw) in enumerate(records):
            if not native_id:
                stop = "missing_identity"
            elif native_id in seen:
                if seen[native_id] == raw:
                    continue
                stop = "integrity_conflict"
            elif len(raw) > caps.record_bytes:
                stop = "record_too_large"
            elif len(got) + len(kept) >= caps.records:
                stop = "record_cap"
            elif size + sum(len(k[3]) for k in kept) + len(raw) > caps.bytes:
                stop = "byte_cap"
            if stop:
                break
            seen[native_id] = raw
            kept.append((p, ts, native_id, raw))
        kept.sort()
        if kept and last is not None and kept[0][1:3] < last and stop is None:
            return "order_regressed", got
        got += kept
        size += sum(len(k[3]) for k in kept)
        if kept:
            last = kept[-1][1:3]
        if stop:
            return stop, got
    return "finished", got


BASE = [(None, [("a", 1, "xx"), ("b", 2, "yy"), ("a", 1, "xx")]), ("t1", [("d", 5, "zz"), ("c", 4, "w")]), ("t2", []), ("t3", [("e", 9, "vvv"), ("a", 1, "xx")])]
RUNS = {
    "finished": (BASE, runs.Caps()),
    "page_cap": (BASE, runs.Caps(pages=3)),
    "record_cap": (BASE, runs.Caps(records=3)),
    "byte_cap": (BASE, runs.Caps(bytes=6)),
    "record_too_large": (BASE, runs.Caps(record_bytes=2)),
    "integrity_conflict": ([*BASE, ("t4", [("f", 10, "q"), ("b", 2, "other"), ("g", 11, "q")])], runs.Caps()),
    "pagination_incomplete": ([*BASE, ("t1", [("f", 10, "q")])], runs.Caps()),
    "order_regressed": ([*BASE, ("t4", [("f", 3, "q")])], runs.Caps()),
    "missing_identity": ([*BASE, ("t4", [("f", 10, "q"), ("", 11, "q")])], runs.Caps()),
}


@pytest.mark.parametrize("rule", RUNS)
def test_runs(spark, rule):
    pages, caps = RUNS[rule]
    rows = [(p, i, n, t, raw, "s") for p, (_, records) in enumerate(pages) for i, (n, t, raw) in enumerate(records)]
    df = spark.createDataFrame(rows, "page_no int, position int, native_id string, ts_ms long, raw string, stream string")
    index = spark.createDataFrame([(p, token) for p, (token, _) in enumerate(pages)], "page_no int, token string")
    got, outcome = runs.acquire(df, index, caps)
    want, records = plain_run(pages, caps)
    assert outcome.outcome == want == rule
    assert [(r["page_no"], r["ts_ms"], r["native_id"], r["raw"]) for r in got.orderBy("sequence").collect()] == records
    assert outcome.records == len(records) and outcome.n_bytes == sum(len(r[3]) for r in records)


def test_an_empty_run(spark):
    df = spark.createDataFrame([], "page_no int, position int, native_id string, ts_ms long, raw string, stream string")
    got, outcome = runs.acquire(df, spark.createDataFrame([], "page_no int, token string"))
    assert got.count() == 0 and outcome == runs.Outcome("finished", None, None, 0, 0, 0)


@pytest.mark.parametrize("provider", ["cloudwatch", "sentry", "datadog", "kubernetes"])
def test_recorded_runs(spark, tmp_path, provider):
    spark.dataSource.register(RecordedPages)
    when = lambda i: f"2023-01-01T00:00:{i:02d}Z"

    def page(n, ids, following):
        if provider == "cloudwatch":
            return {"events": [{"eventId": f"e{i}", "timestamp": i, "message": f"m{i}", "logStreamName": "s"} for i in ids], "nextToken": following}
        if provider == "sentry":
            return {"data": [{"eventID": f"e{i}", "dateCreated": when(i)} for i in ids], "next": following}
        if provider == "datadog":
            return {"data": [{"id": f"e{i}", "attributes": {"timestamp": when(i)}} for i in ids], "meta": {"page": {"after": following}}}
        return {"instance": f"pod/{n}", "lines": [f"{when(i)} stdout F m{i}" for i in ids], "continue": following}

    for n, (ids, following) in enumerate([([1, 2], "a"), ([2, 3] if provider != "kubernetes" else [3], "b"), ([4], None)]):
        (tmp_path / f"{n}.json").write_text(json.dumps(page(n, ids, following)))
    got, outcome = runs.recorded_run(spark, str(tmp_path), provider)
    assert outcome.outcome == "finished" and outcome.pages == 3 and outcome.records == got.count() == 4
    capped, outcome = runs.recorded_run(spark, str(tmp_path), provider, runs.Caps(records=2))
    assert (outcome.outcome, outcome.records) == ("record_cap", 2) and capped.count() == 2
    (tmp_path / "3.json").write_text(json.dumps(page(3, [5], "b")))
    (tmp_path / "4.json").write_text(json.dumps(page(4, [6], None)))
    (tmp_path / "2.json").write_text(json.dumps(page(2, [4], "a")))
    assert runs.recorded_run(spark, str(tmp_path), provider)[1].outcome == "pagination_incomplete"
    if provider == "cloudwatch":
        assert runs.recorded_run(spark, str(tmp_path), provider, streams=["other"])[1].records == 0
        assert runs.recorded_run(spark, str(tmp_path), provider, contains="m1")[1].records == 1


def test_recorded_pages(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    for p in range(3):
        (pages / f"{p}.json").write_text(json.dumps({"events": [{"eventId": f"e{p}{i}", "timestamp": 100 - i, "message": "m"} for i in (0, 1, 1)]}))
    spark.dataSource.register(RecordedPages)
    got = spark.read.format("recorded_pages").option("provider", "cloudwatch").load(str(pages))
    assert sorted(r["native_id"] for r in got.collect()) == ["e00", "e01", "e10", "e11", "e20", "e21"]
    stream = spark.readStream.format("recorded_pages").load(str(pages))
    q = stream.writeStream.format("memory").queryName("pages").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pages").count() == 6
    bad = pages / "9.json"
    bad.write_text(json.dumps({"events": [{"eventId": "a", "timestamp": 1, "message": "x"}, {"eventId": "a", "timestamp": 1, "message": "y"}]}))
    with pytest.raises(IntegrityError):
        read_page("cloudwatch", str(bad))
    for provider, page, want in (
        ("sentry", [{"eventID": "s", "dateCreated": "2023-01-01T00:00:00Z"}], ("s", 1672531200000)),
        ("datadog", {"data": [{"id": "d", "attributes": {"timestamp": "2023-01-01T00:00:00.5Z"}}]}, ("d", 1672531200500)),
        ("kubernetes", {"instance": "pod/c/0", "lines": ["2023-01-01T00:00:00Z stdout F hello there"]}, ("pod/c/0/stdout/0", 1672531200000)),
    ):
        bad.write_text(json.dumps(page))
        assert read_page(provider, str(bad))[0][:2] == want == read_page(provider, f"file://{bad}")[0][:2]


def test_file_sources(spark, tmp_path):
    m = tmp_path / "m.json"
    m.write_text('{"timestamp":1,"service":"a","metric":"cpu","value":1.5}\n')
    assert files.read_metrics(spark, str(m)).count() == 1
    m.write_text('{"timestamp":1,"service":"a b","metric":"cpu","value":1.5}\n')
    with pytest.raises(files.InvalidInput):
        files.read_metrics(spark, str(m))
    t = tmp_path / "t.json"
    t.write_text('{"trace_id":"t","span_id":"s","service":"a"}\n\n')
    assert files.read_spans(spark, str(t)).count() == 1
    t.write_text('{"trace_id":"t","span_id":"s","service":"a","color":1}\n')
    with pytest.raises(files.InvalidInput):
        files.read_spans(spark, str(t))
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"schema_version": 1, "incidents": [{"id": "i", "service": "a", "fault_type": "f", "metric_family_shifts": {"cpu": 1.0}}]}))
    assert files.read_precedents(spark, str(p)).first()["shifts"] == {"cpu": 1.0}
    p.write_text(json.dumps({"schema_version": 1, "incidents": [{"id": "i", "service": "a", "fault_type": "f", "metric_family_shifts": {"heat": 1.0}}]}))
    with pytest.raises(files.InvalidInput):
        files.read_precedents(spark, str(p))


def test_result_lines(spark, tmp_path):
    rows = [("s", bytearray(b"\xfb\xff"), "first", 2, bytearray(b"text")), ("s", bytearray(b"n"), "last", 2, bytearray(b"\xff"))]
    df = spark.createDataFrame(rows, "source_id string, native_id binary, position string, repeat_count long, raw binary")
    got = [json.loads(r[0]) for r in files.result_lines(df).collect()]
    assert got[0] == {"source_id": "s", "native_id": "-_8", "position": "first", "repeat_count": 2, "raw": "text"}
    assert got[1]["raw_base64"] == "/w==" and "raw" not in got[1]
    files.write_results(df, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(json.dumps(g, separators=(",", ":")) for g in got)
