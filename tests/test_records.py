import re

import pytest
from pyspark.sql import functions as F

from loglattice.functions import records as fn

UUID = "6c106fc2-789a-b68b-8b48-f2375b55a60b"
CASES = [
    # raw, service, role, fingerprint, ts
    ('{"service":"pay","level":"error","message":"lost 2023-01-02 03:04:05","timestamp":7}', "pay", "error", "lost <date> <time>", 7),
    ('{"service":"pay","status":"warn","message":"2023-01-02 03:04:05.5 slow","timestamp":"8"}', "pay", "warning", "slow", 8),
    ('{"resource":{"attributes":[{"key":"x"},{"key":"service.name","value":{"stringValue":"o"}}]},"severityNumber":22,"body":{"stringValue":"b"},"timeUnixNano":"1672928151943542841"}', "o", "critical", "b", 1672928151),
    ('{"eventID":"e","projectID":"42","title":"Boom","level":"fatal"}', "sentry-project-42", "critical", "boom", None),
    ('{"id":"1","attributes":{"service":"a","status":"info","message":"rollout done"}}', "a", "change", "rollout done", None),
    ('{"service":"a","level":3,"status":"error","message":"fine"}', "a", "context", "fine", None),
    ("LINK 1673375926 2023.01.10 R33 2023-01-10-18.38.46.637002 R33 RAS KERNEL FATAL cache parity", "kernel", "critical", "cache parity", 1673375926),
    ("[svc-a] ERROR: lost at 10.0.0.1:80", "svc-a", "error", "[svc-a] error: lost at 10.0.0.1:<port>", None),
    ("2023-01-09T11:31:02.583Z service=b level=warn request_id=77 waited", "b", "warning", "request_id=<id> waited", None),
    ("GET /v2/labels 503 877.925 ms - 66323", "unknown", "error", "get /v2/labels 503 <latency> ms - <bytes>", None),
    ("no error in the audit", "unknown", "context", "no error in the audit", None),
    ("no, error in the audit", "unknown", "error", "no, error in the audit", None),
    (f"id {UUID}, at 1672617600000 or 16726176000001", "unknown", "context", "id <uuid> at <epoch_ms> or 16726176000001", None),
    ("host 300.0.0.1:80 é É", "unknown", "context", "host 300.0.0.1:80 é É".replace("É", "É"), None),
    ("2023-01-09 08:05:33.069  INFO [s,09,5a,false] 12 --- [nio-1] io.x.H : restart", "unknown", "change", "<date> <time> info [s,09,5a,false] 12 --- [nio-1] io.x.h : restart", None),
    ("", "unknown", "context", "", None),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(CASES)] + [(99, None, "x")], "i long, raw string, level string")
    got = {r["i"]: r for r in fn.parse_records(df, "raw").collect()}
    for i, (raw, service, role, fingerprint, ts) in enumerate(CASES):
        r = got[i]
        assert (r["service"], r["role"], r["ts_seconds"]) == (service, role, ts), raw
        assert r["fingerprint"] == fingerprint.replace("É", "É"), raw
    assert (got[99]["service"], got[99]["role"], got[99]["fingerprint"]) == (None, None, None)


def test_peer(spark):
    raws = ['{"peer.service":"p"}', '{"target_service":"t t"}', '{"peer":{"service":"n"}}', '{"attributes":{"attributes":{"peer.service":"d"}}}', '{"peer.service":5,"peer_service":"q"}', "peer.service=x"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string").select(fn.peer_service(F.try_parse_json("raw")).alias("p"))
    assert [r[0] for r in df.collect()] == ["p", None, "n", "d", "q", None]


@pytest.mark.parametrize("cap", [2, 64])
def test_search_terms(spark, cap):
    text = "The error, the ERROR and id-12 of x: " + "w" * 65 + " café logs again"
    got = spark.createDataFrame([(text,)], "t string").select(fn.search_terms(F.col("t"), cap)).first()[0]
    assert got == fn.search_terms_of(text, cap) == (["error"] if cap == 2 else ["again", "caf", "error"])


def test_sensitive_and_samples(spark):
    texts = ['x {"token" : 1}', "bearer abc", "my Password=1", '"token" 1', "plain " * 40, "short é", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fn.is_sensitive(F.col("t"))).collect()] == [True, True, True, False, False, False, None]
    sample = fn.safe_sample(F.substring("t", 1, 60), F.right("t", F.lit(60)), F.octet_length("t"), 50)
    out = [r[0] for r in df.select(sample).collect()]
    assert out[0] == fn.OMITTED and out[5] == "short é" and len(out[4]) == 50 and fn.MIDDLE in out[4]
    cut = [r[0] for r in df.select(fn.utf8_prefix(F.col("t"), 7)).collect()]
    assert cut[5] == "short " and cut[3] == '"token"'


def test_base64url(spark):
    got = spark.createDataFrame([(bytearray(b"\xfb\xff\xfe?"),)], "b binary").select(fn.base64url(F.col("b"))).first()[0]
    assert re.fullmatch(r"[A-Za-z0-9_-]+", got) and got == "-__-Pw"
