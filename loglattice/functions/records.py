"""Scalar functions over raw log records, as Column expressions that stay in the JVM.

``parse_records`` gives service, role, fingerprint and time of a record:
JSON first, then the RAS layout, the bracketed head and key=value fields.
Case folding and tokens are ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values.
SEARCH_STOP_WORDS = "the and for with from that this then into what when where why how logs log find show".split()
FAILURE_WORDS = "error failed failure panic exception".split()
NEGATORS = "no without zero".split()
CHANGE_PHRASES = ["deploy", "restart", "migration", "config changed", "rollout"]
ID_KEYS = "request_id request-id requestid x-request-id trace_id trace-id span_id span-id correlation_id correlation-id".split()
PEER_KEYS = ["$['peer.service']", "$.peer_service", "$.target_service", "$.downstream_service"]
PEER_PATHS = ["$.peer.service", "$.attributes.attributes['peer.service']", "$.attributes.attributes.peer.service"]
LEVEL_PATHS = ["$.severity_text", "$.severityText", "$.level", "$.status", "$.attributes.status"]
SERVICE_PATHS = ["$.service", "$.resource['service.name']", "$['service.name']", "$.attributes.service"]

SPACE = "[ \\t\\n\\f\\r]"
WORD = "[^ \\t\\n\\f\\r]"
VALID_SERVICE = "^[A-Za-z0-9._-]{1,128}$"
_OCTET = r"\+?0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_RAS = (
    rf"^{SPACE}*{WORD}+{SPACE}+([0-9]{{10}}){SPACE}+([0-9]{{4}}\.[0-9]{{2}}\.[0-9]{{2}}){SPACE}+({WORD}+){SPACE}+({WORD}+){SPACE}+\3{SPACE}+RAS{SPACE}+"
    rf"([A-Za-z0-9._-]{{1,128}}){SPACE}+(FATAL|ERROR|WARN|WARNING|INFO|DEBUG){SPACE}+({WORD}[\s\S]*)$"
)
_PREAMBLE = rf"^{SPACE}*{_DATE}{SPACE}+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}{WORD}*{SPACE}+(FATAL|ERROR|WARN|INFO|DEBUG|TRACE){SPACE}+\[{WORD}*,{WORD}*\]{SPACE}+[0-9]+{SPACE}+---{SPACE}+\[{WORD}*\]{SPACE}+{WORD}+{SPACE}*$"
_ACCESS = rf"^{SPACE}*(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS){SPACE}+(/{WORD}*){SPACE}+([1-5][0-9]{{2}}){SPACE}+(?:[0-9]+\.?[0-9]*|\.[0-9]+){SPACE}+ms{SPACE}+-{SPACE}+[0-9]+{SPACE}*$"
_ISO_TOKEN = rf"^[0-9]{{4}}-{WORD}{{2}}-{WORD}{{2}}T{WORD}{{2}}:{WORD}{{2}}:{WORD}{{3,}}$"


def settled(df: DataFrame, keep: list[str], made: list[Column]) -> DataFrame:
    """``keep`` columns and the fields of ``made``, behind a generator.

    Conditions on made columns aren't pushed below it, where each mention
    would compute its column again.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*made))))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def lossy_text(raw: Column) -> Column:
    """UTF-8 text of bytes, malformed sequences replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")


def valid_service(name: Column) -> Column:
    return F.when(name.rlike(VALID_SERVICE), name)


def json_string(doc: Column, path: str) -> Column:
    """A JSON string at a path; null for any other kind of value."""
    at = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(doc, path, "string"))


def field_value(toks: Column, prefix: str) -> Column:
    """First valid value of a ``prefix``ed token, trimmed of what no service name has at its ends."""
    values = F.transform(F.filter(toks, lambda t: t.startswith(prefix)), lambda t: F.regexp_replace(F.substring(t, len(prefix) + 1, 1 << 30), r"^[^A-Za-z0-9._-]+|[^A-Za-z0-9._-]+$", ""))
    return F.try_element_at(F.filter(values, lambda v: v.rlike(VALID_SERVICE)), F.lit(1))


def temporal_fragments(text: Column) -> Column:
    """Dates, times of day and 13-digit times replaced by their kinds."""
    text = F.regexp_replace(text, rf"(?<![0-9]){_DATE}(?![0-9])", "<date>")
    text = F.regexp_replace(text, r"(?<![0-9:])[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]++)?+(?![0-9:])", "<time>")
    return F.regexp_replace(text, r"(?<![0-9])[0-9]{13}(?![0-9])", "<epoch_ms>")


def fingerprint_token(token: Column) -> Column:
    lower = ascii_lower(token)
    edge = r"[,;\"'()\[\]{}]+"
    trimmed = F.regexp_replace(lower, f"^{edge}|{edge}$", "")
    keys = "|".join(sorted(ID_KEYS, key=len, reverse=True))
    return (
        F.when(trimmed.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}:[0-9]+$"), F.regexp_replace(trimmed, ":[0-9]+$", ":<port>"))
        .when(trimmed.rlike(rf"^(?:{keys})[=:][\s\S]"), F.concat(F.regexp_extract(trimmed, rf"^({keys})[=:]", 1), F.lit("=<id>")))
        .when(trimmed.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit("<uuid>"))
        .when(trimmed.rlike("^[0-9a-f]{32,}$"), F.lit("<hex-id>"))
        .otherwise(temporal_fragments(lower))
    )


def role_of(level: Column, message: Column) -> Column:
    """critical, error, warning, change or context."""
    level = ascii_lower(level)
    negated = "|".join(NEGATORS)
    failure = rf"(?i)(?<![a-z0-9])(?<!(?<![a-z0-9])(?:{negated})[^a-z0-9])(?:{'|'.join(FAILURE_WORDS)})(?![a-z0-9])"
    return (
        F.when(level.isin("fatal", "critical", "panic"), "critical")
        .when(level.isin("error", "err"), "error")
        .when(level.isin("warn", "warning"), "warning")
        .when(message.rlike(failure), "error")
        .when(ascii_lower(message).rlike("|".join(CHANGE_PHRASES)), "change")
        .otherwise("context")
    )


def peer_service(doc: Column) -> Column:
    """The peer a JSON record names explicitly, if its name is valid."""
    return valid_service(F.coalesce(*[json_string(doc, p) for p in PEER_KEYS + PEER_PATHS]))


def _otel_service(doc: Column) -> Column:
    items = F.try_variant_get(doc, "$.resource.attributes", "array<struct<key:string,value:variant>>")
    named = F.try_element_at(F.filter(items, lambda i: i["key"] == "service.name"), F.lit(1))["value"]
    return F.coalesce(json_string(named, "$.stringValue"), json_string(doc, "$.resource.attributes['service.name']"), json_string(doc, "$.resource.attributes['service.name'].stringValue"))


def parse_records(rows: DataFrame, raw: str) -> DataFrame:
    """Adds service, role, fingerprint, ts_seconds and peer to rows with a text column ``raw``.

    A null text gives nulls. Rows keep all their columns.
    """
    base = rows.columns
    text = F.col(raw)
    doc = F.col("_ll_doc")
    one = rows.withColumn("_ll_doc", F.try_parse_json(text))
    is_json = doc.isNotNull()
    ras = ~is_json & text.contains(" RAS ") & text.rlike(_RAS)
    ras = ras & F.regexp_extract(text, _RAS, 4).startswith(F.translate(F.regexp_extract(text, _RAS, 2), ".", "-"))
    one = one.withColumns({"_ll_ras": F.coalesce(ras, F.lit(False)), "_ll_toks": tokens(text)})
    number = F.try_variant_get(doc, "$.timestamp", "variant")
    stated = F.when(F.schema_of_variant(number).isin("BIGINT", "STRING"), F.try_variant_get(doc, "$.timestamp", "string"))
    nanos = json_string(doc, "$.timeUnixNano")
    whole = r"^[+-]?[0-9]{1,19}$"
    ts = F.coalesce(
        F.when(stated.rlike(whole), stated.try_cast("long")),
        F.when(nanos.rlike(whole), F.call_function("div", nanos.try_cast("decimal(38,0)"), F.lit(1_000_000_000).cast("decimal(38,0)"))),
        F.when(F.col("_ll_ras"), F.regexp_extract(text, _RAS, 1).cast("long")),
    )
    message = F.coalesce(
        F.when(json_string(doc, "$.message") != "", json_string(doc, "$.message")),
        *[json_string(doc, p) for p in ("$.title", "$.body", "$.body.stringValue", "$.attributes.message")],
        F.when(F.col("_ll_ras"), F.array_join(tokens(F.regexp_extract(text, _RAS, 7)), " ")),
        text,
    )
    two = one.withColumns({"_ll_message": message, "ts_seconds": ts})
    said = F.col("_ll_message")
    cut = F.instr(said, " : ")
    prefix, body = F.substring(said, F.lit(1), cut - 1), F.substring(said, cut + 3, F.length(said))
    preamble = (cut > 0) & (body != "") & prefix.rlike(_PREAMBLE)
    three = two.withColumns({"_ll_body": F.when(preamble, body).otherwise(said), "_ll_spring": F.when(preamble, F.regexp_extract(prefix, _PREAMBLE, 1))})
    body = F.col("_ll_body")
    status = F.regexp_extract(body, _ACCESS, 3)
    access = body.rlike(_ACCESS) & (F.octet_length(F.regexp_extract(body, _ACCESS, 2)) <= 512)
    three = three.withColumn("_ll_status", F.when(access, status))
    project = json_string(doc, "$.projectID")
    bracketed = F.regexp_extract(text, r"^\[([^\]]*)\]", 1)
    service = F.coalesce(
        valid_service(F.coalesce(*[json_string(doc, p) for p in SERVICE_PATHS], _otel_service(doc))),
        F.when(project.rlike("^[0-9]+$"), F.concat(F.lit("sentry-project-"), project)),
        F.when(F.col("_ll_ras"), ascii_lower(F.regexp_extract(text, _RAS, 5))),
        valid_service(bracketed),
        field_value(F.col("_ll_toks"), "service="),
        F.lit("unknown"),
    )
    present = [F.try_variant_get(doc, p, "variant").isNotNull() for p in LEVEL_PATHS]
    json_level = F.lit(None).cast("string")
    for has, path in reversed(list(zip(present, LEVEL_PATHS))):
        json_level = F.when(has, json_string(doc, path)).otherwise(json_level)
    n = F.when(F.schema_of_variant(F.try_variant_get(doc, "$.severityNumber", "variant")) == "BIGINT", F.try_variant_get(doc, "$.severityNumber", "long"))
    after = F.regexp_replace(F.try_element_at(tokens(F.regexp_extract(text, r"^\[[^\]]*\]([\s\S]*)$", 1)), F.lit(1)), ":+$", "")
    level = F.coalesce(
        json_level,
        F.when(n.between(21, 24), "critical").when(n.between(17, 20), "error").when(n.between(13, 16), "warning"),
        F.when(ascii_lower(after).isin("fatal", "critical", "panic", "error", "err", "warn", "warning", "info", "debug"), after),
        field_value(F.col("_ll_toks"), "level="),
        F.when(F.col("_ll_ras"), ascii_lower(F.regexp_extract(text, _RAS, 6))),
        F.col("_ll_spring"),
        F.when(F.col("_ll_status") >= "500", "error").when(F.col("_ll_status") >= "400", "warning").when(F.col("_ll_status").isNotNull(), "info"),
        F.lit(""),
    )
    inner = tokens(body)
    first = F.try_element_at(inner, F.lit(1))
    second = F.try_element_at(inner, F.lit(2))
    skip = F.when(F.coalesce(first.rlike(f"^{_DATE}$"), F.lit(False)), F.when(F.coalesce(second.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}"), F.lit(False)), 2).otherwise(1)).otherwise(0)
    inner = F.slice(inner, skip + 1, F.greatest(F.size(inner), F.lit(1)))
    stamped = F.coalesce(F.try_element_at(inner, F.lit(1)).rlike("^ts=" + _ISO_TOKEN[1:]), F.lit(False))
    inner = F.when(stamped, F.slice(inner, F.lit(2), F.greatest(F.size(inner), F.lit(1)))).otherwise(inner)
    plain = F.filter(F.col("_ll_toks"), lambda t: ~(t.startswith("service=") | t.startswith("level=") | t.startswith("timestamp=") | t.rlike(_ISO_TOKEN)))
    normal = F.array_join(F.transform(F.when(is_json | F.col("_ll_ras"), inner).otherwise(plain), fingerprint_token), " ")
    access_print = F.concat(ascii_lower(F.regexp_extract(body, _ACCESS, 1)), F.lit(" "), F.regexp_extract(body, _ACCESS, 2), F.lit(" "), F.col("_ll_status"), F.lit(" <latency> ms - <bytes>"))
    fingerprint = F.when(F.col("_ll_status").isNotNull(), access_print).otherwise(normal)
    known = text.isNotNull()
    out = three.withColumns({"service": F.when(known, service), "_ll_level": level, "fingerprint": F.when(known, fingerprint), "peer": peer_service(doc)})
    role = F.when(known, role_of(F.col("_ll_level"), body)).alias("role")
    return settled(out, base, [F.col("service"), role, F.col("fingerprint"), F.col("ts_seconds"), F.col("peer")])


def search_terms(text: Column, cap: int) -> Column:
    """Sorted distinct search terms; the cap counts terms before repetitions are removed."""
    parts = F.split(text, "[^A-Za-z0-9]")
    fit = F.filter(F.transform(F.filter(parts, lambda t: F.length(t).between(3, 64)), ascii_lower), lambda t: ~t.isin(SEARCH_STOP_WORDS))
    return F.array_sort(F.array_distinct(F.slice(fit, 1, cap)))


def search_terms_of(text: str, cap: int) -> list[str]:
    """The same for one query string on the driver."""
    import re

    fit = [t for t in (x.translate(str.maketrans(UPPER, LOWER)) for x in re.split("[^A-Za-z0-9]", text) if 3 <= len(x) <= 64) if t not in SEARCH_STOP_WORDS]
    return sorted(set(fit[:cap]))


def base64url(raw: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(raw), "+/\r\n", "-_"), F.lit("="))


# What marks a record as sensitive.
SENSITIVE_PHRASES = ["password=", "passwd=", "api_key=", "access_token=", "secret=", "authorization:", "dsn=", "bearer ", "-----begin private key-----"]
SENSITIVE_KEYS = (
    "password passwd api_key apikey access_token accesstoken refresh_token session_token secret client_secret private_key "
    "authorization token dsn connection_string aws_access_key_id aws_secret_access_key"
).split()
OMITTED = "[sensitive log line omitted from model input]"
MIDDLE = " [middle omitted] "


def is_sensitive(text: Column) -> Column:
    """Whether a text holds a sensitive phrase, or a sensitive key in double quotes followed by a colon."""
    lower = ascii_lower(text)
    phrases = "|".join(p.replace("-", "[-]") for p in SENSITIVE_PHRASES)
    return lower.rlike(rf"{phrases}|\"(?:{'|'.join(SENSITIVE_KEYS)})\"\s*:")


def safe_sample(prefix: Column, suffix: Column, original_bytes: Column, max_chars: int) -> Column:
    """One line for a reader: omitted if sensitive, whole if it fits, else a third from its head and the rest from its tail."""
    room = max_chars - len(MIDDLE)
    fits = (original_bytes <= F.octet_length(prefix)) & (F.char_length(prefix) <= max_chars)
    if room <= 0:
        cut = F.substring(prefix, 1, max_chars)
    else:
        head = room // 3
        cut = F.concat(F.substring(prefix, 1, head), F.lit(MIDDLE), F.right(suffix, F.lit(room - head)))
    return F.when(is_sensitive(prefix) | is_sensitive(suffix), OMITTED).when(fits, prefix).otherwise(cut)


def utf8_prefix(text: Column, max_bytes: int) -> Column:
    """The longest prefix of at most so many bytes that ends between characters."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, max_bytes)
    # a cut character leaves one to three bytes that aren't valid on their own
    tries = [F.substring(raw, F.lit(1), F.octet_length(raw) - k) for k in range(4)]
    return F.coalesce(*[F.when(F.is_valid_utf8(t.cast("string")), t.cast("string")) for t in tries])
