import base64
import os

import pytest

from loglattice.functions import layouts
from loglattice.operators import log_entries as le

NEAR = 1_672_617_600_000  # 2023-01-02T00:00:00Z
ROUTER = layouts.Router()
FORMS = [
    ("2023-01-09T11:31:02.583Z WARN  [svc-a] slow", "2023-01-09T11:31:02.583", "WARN", "svc-a"),
    ("2023-01-09T14:12:28Z [info] svc-a: opened", "2023-01-09T14:12:28", "INFO", "svc-a"),
    ('ts=2023-01-09T09:13:00.174Z level=error service=svc-a msg="not \\"done\\" in 6.8\\u00b5s"', "2023-01-09T09:13:00.174", "ERROR", "svc-a"),
    ('lvl=debug message="x" svc=svc_a trace_id=3a time=2023-01-09T09:47:11.069Z', "2023-01-09T09:47:11.069", "DEBUG", "svc_a"),
    ("I0108 15:28:55.841156   45406 proxy_io.go:673] heartbeat", "2023-01-08T15:28:55.841", "INFO", "proxy_io.go"),
    ("F1231 23:59:59.000001 7 main.cpp:1] end of year", "2022-12-31T23:59:59.000", "FATAL", "main.cpp"),
    ("<11>1 2023-01-09T02:07:19.750+05:30 node-2 auditd 4340 ID36 - differs", "2023-01-08T20:37:19.750", "ERROR", "auditd"),
    ("<12>Jan  2 21:47:02 node-1 feedd[18982]: asks", "2023-01-02T21:47:02", "WARN", "feedd"),
    ("2023-01-08T22:39:18.226904Z \x1b[32m INFO\x1b[0m ThreadId(08) a_b::store: written", "2023-01-08T22:39:18.226", "INFO", "a_b::store"),
    ("WARNING:a_b.net:2023-01-07 18:32:45,707:clock", "2023-01-07T18:32:45.707", "WARN", "a_b.net"),
    ("2023-01-05 13:39:57,412 - a_b.worker - CRITICAL - gone", "2023-01-05T13:39:57.412", "FATAL", "a_b.worker"),
    ("2023-01-09 08:05:33.069  INFO [svc-a,09,5a,false] 12 --- [nio-1] io.x.Handler : got", "2023-01-09T08:05:33.069", "INFO", "svc-a"),
    ("[2023-01-11 17:34:06,583] WARN too deep (io.x.Handler)", "2023-01-11T17:34:06.583", "WARN", "io.x.Handler"),
    ("09/Jan/2023:13:57:31 +0200 | NOTICE | svc-a | written", "2023-01-09T11:57:31", "INFO", "svc-a"),
    ("LINK 1673375926 2023.01.10 R33 2023-01-10-18.38.46.637002 R33 RAS KERNEL WARNING seen", "2023-01-10T18:38:46.637", "WARN", "KERNEL"),
    ("1673429683.497 err svc-a: checksum", "2023-01-11T09:34:43.497", "ERROR", "svc-a"),
    ('{"timeUnixNano": "1672928151943542841", "severityNumber": 17, "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}}', "2023-01-05T14:15:51.943", "ERROR", "svc"),
    ('{"attributes":{"timestamp":1673406970,"severity_text":"panic","service":"svc","message":"m"}}', "2023-01-11T03:16:10", "FATAL", "svc"),
    ('{"@timestamp":"2023-01-11T06:52:53.880Z","level":"trace","service":"svc","message":"cut of', "2023-01-11T06:52:53.880", "TRACE", "svc"),
]


@pytest.mark.parametrize("text, when, level, component", FORMS)
def test_each_layout(text, when, level, component):
    e = ROUTER.parse(text, NEAR)
    assert (e.ts_ms, e.level, e.component) == (layouts.iso_ms(when), level, component)
    assert "2023-01" not in (e.message or "") or e.layout == "json"


def test_what_states_less():
    assert ROUTER.parse("[svc-a] INFO: opened").ts_ms is None
    assert ROUTER.parse("GET /v2/labels 200 877.925 ms - 66323").level is None
    assert ROUTER.parse("2023-01-08T0") is None and ROUTER.parse("    | 2023-01-02 04:05:06 WARN x quoted") is None
    assert ROUTER.parse("I0108 15:28:55.841156 4 io.go:6] x", None).ts_ms is None
    assert ROUTER.parse("2023-13-45T11:31:02.583Z WARN [a] x").ts_ms is None
    assert ROUTER.parse('ts=2023-01-09T09:13:00Z msg="2022-01-01T00:00:00Z level=error"').level is None


@pytest.mark.parametrize("n", [10, 250, 5000])
def test_anchors_anywhere_in_the_head(n):
    name = "s" * n
    for text in (f"2023-01-09T11:31:02.583Z INFO [{name}] hello", f"2023-01-09 11:31:02.583 INFO {name}: hello", f"2023-01-09T11:31:02.583Z  INFO 1 --- [main] {name} : hello"):
        e = ROUTER.parse(text)
        assert (e.level, e.component, e.message) == ("INFO", name, "hello")


def test_decode():
    for text in (b"any \xff bytes", b"", b"x" * 1000):
        std, url = base64.b64encode(text).decode(), base64.urlsafe_b64encode(text).decode()
        for form in (std, url, std.rstrip("="), url.rstrip("="), "\n".join(std[i : i + 60] for i in range(0, len(std), 60))):
            assert le.decode_base64(form) == text
    assert le.decode_base64(None) is None and le.decode_base64("A") is None


def brute(lines):
    """lines: (record, number, text or None) in order -> {head record: lines of the entry}."""
    out, head = {}, None
    for rec, _, text in sorted(lines, key=lambda x: x[1]):
        if text is None:
            continue
        if ROUTER.parse(text):
            head = rec
            out[head] = 0
        if head is not None:
            out[head] += 1
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_entries_over_blocks(spark, block):
    head = "1673429683.497 err svc-a: checksum"
    texts = ["\tat x", head, "a", None, "", "b", head, head] + ["deep"] * 11 + [head, None, "end"]
    lines = [(100 + i, i, t) for i, t in enumerate(texts)]
    coded = [(r, "f", f"line-{n:06d}", None if t is None else base64.urlsafe_b64encode(t.encode() + b"\n" * bool(t)).decode(), "clash") for r, n, t in lines]
    df = spark.createDataFrame(coded, "record_no long, file string, native_id string, raw string, level string")
    parsed = le.parse_records(df, "raw", "native_id", ["record_no", "file", "native_id"]).where("has_bytes")
    got = {r["record_no"]: r["n_lines"] for r in le.join_lines(parsed, "file", ["native_id"], "record_no", block).collect()}
    assert got == brute(lines)


def test_messages_with_nulls_and_long_texts(spark):
    long = FORMS[0][0] + "\n" + "\n".join(f"\tat line {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, None, NEAR), (2, "", NEAR), (3, long, None), (4, FORMS[0][0] + "\r\n", NEAR), (5, "\n", NEAR)], "id long, text string, near long")
    got = {r["id"]: (r["ts_millis"], r["level"], r["n_lines"]) for r in le.parse_messages(df, "text", "near", ["id"]).collect()}
    at = layouts.iso_ms(FORMS[0][1])
    assert got == {1: (None, None, None), 2: (None, None, None), 3: (at, "WARN", 20_001), 4: (at, "WARN", 1), 5: (None, None, 1)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, text string, near long, file string, native_id string")
    assert le.parse_messages(empty, "text", "near", ["id"], message=True).count() == 0
    parsed = le.parse_records(empty, "text", "native_id", ["id", "file", "native_id"])
    assert le.join_lines(parsed, "file", ["native_id"], "id").count() == 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_message_of_joined_lines(spark, block):
    head = "1673429683.497 err svc-a: checksum"
    texts = ["early", head, "\tat x", None, "", "\x1b[31mb\x1b[0m", head + " two", head, *[f"deep {i}" for i in range(7)], None, "end"]
    coded = [(i, "f", f"line-{i}", None if t is None else base64.b64encode(t.encode() + [b"\n", b"\r\n", b""][i % 3]).decode()) for i, t in enumerate(texts)]
    coded += [(100, "g", "one", base64.b64encode(b"1673429683.497 err svc-a: alone\n  at y").decode()), (101, "g", "two", base64.b64encode(b"no head").decode())]
    df = spark.createDataFrame(coded, "record_no long, file string, native_id string, raw string")
    parsed = le.parse_records(df, "raw", "native_id", ["record_no", "file", "native_id"], message=True).where("has_bytes")
    got = {r["record_no"]: r["message"] for r in le.join_lines(parsed.where("line_no is not null"), "file", ["native_id"], "record_no", block, message=True).collect()}
    entries = {1: texts[1:6], 6: texts[6:7], 7: texts[7:]}
    assert got == {i: ROUTER.parse("\n".join(t for t in ts if t is not None)).message for i, ts in entries.items()}
    single = {r["record_no"]: r["message"] for r in parsed.where("line_no is null").collect()}
    assert single == {100: ROUTER.parse("1673429683.497 err svc-a: alone\n  at y").message, 101: "no head"}


@pytest.mark.parametrize("block", [1, 3, 4096])
@pytest.mark.parametrize("message", [False, True])
def test_json_over_numbered_lines(spark, block, message):
    head = "1673429683.497 err svc-a: checksum"
    record = ["{", '  "level": "warn",', '  "time": "2023-01-09T00:00:00Z",', '  "service": "svc-b",', '  "message": "it is", "more": {"a": [', "{}]}", "}"]
    texts = [head, *record, "after", head, "{", '  "no": "record"', "}", head, '{"level": "info", "service": "cut off', "tail"]
    rows = [(i, "f", f"line-{i}", base64.b64encode(t.encode() + b"\n").decode()) for i, t in enumerate(texts)]
    rows += [(100, "g", "line-1", base64.b64encode(head.encode()).decode()), (101, "f", "line-900", None)]
    df = spark.createDataFrame(rows, "record_no long, file string, native_id string, raw string")
    parsed = le.parse_records(df, "raw", "native_id", ["record_no", "file", "native_id"], message=message).where("has_bytes")
    whole = le.put_json_together(parsed, df, "raw", "file", ["native_id"], "record_no", message, block)
    got = {r["record_no"]: r for r in le.join_lines(whole, "file", ["native_id"], "record_no", block, message=message).collect()}
    assert {i: (r["level"], r["component"], r["n_lines"]) for i, r in got.items()} == {
        0: ("ERROR", "svc-a", 1), 1: ("WARN", "svc-b", 8), 9: ("ERROR", "svc-a", 4), 13: ("ERROR", "svc-a", 1), 14: ("INFO", None, 2), 100: ("ERROR", "svc-a", 1),
    }
    assert got[1]["ts_millis"] == layouts.iso_ms("2023-01-09T00:00:00Z")
    if message:
        assert got[1]["message"].startswith("it is")


def test_fields_cover_both_tables(spark):
    from loglattice.plans import problems

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no test tables here")
    rows = problems.p2_fields(spark, sf).collect()
    found = {(r["origin"], r["row_id"]): r[2:6] for r in problems.p2_found(spark, sf).collect()}
    fields = {(r["origin"], r["row_id"]): r for r in rows}
    assert {k: fields[k][2:6] for k in found} == found
    assert sum(r["message"] is not None for r in rows if r["origin"] == "source_records") > 0
