"""Layouts of log entries: literal routing, then anchored expressions.

An Aho-Corasick automaton over the layouts' anchor literals runs once over the
first line of an entry, and where no layout found there applies over the whole
entry, and retrieves the layouts that can apply; their anchored expressions
verify and extract time, level, component and message. Plain Python without
Spark, so that it can run inside any Arrow batch function.
"""

from __future__ import annotations

import json
import re
from datetime import date
from functools import lru_cache

import ahocorasick

DAY_MS = 86_400_000

# Spellings of levels.
LEVELS = {
    **dict.fromkeys("fatal critical crit panic emerg emergency alert f c".split(), "FATAL"),
    **dict.fromkeys("error err severe failure e".split(), "ERROR"),
    **dict.fromkeys("warn warning wrn w".split(), "WARN"),
    **dict.fromkeys("info information informational inf notice note config i n".split(), "INFO"),
    **dict.fromkeys("debug dbg fine d".split(), "DEBUG"),
    **dict.fromkeys("trace trc verbose finer finest t v".split(), "TRACE"),
}
SYSLOG = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
OTEL = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")  # four numbers each, from 1
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
TIME_KEYS = ("timeUnixNano", "time_unix_nano", "observedTimeUnixNano", "@timestamp", "timestamp", "time", "ts", "t", "datetime", "date")
LEVEL_KEYS = ("severityText", "severity_text", "level", "lvl", "severity", "sev", "status", "log.level", "loglevel", "severityNumber", "severity_number", "priority")
SERVICE_KEYS = ("service", "service.name", "svc", "service_name", "component", "app", "application")
PROGRAM_KEYS = ("logger", "logger_name", "module", "caller", "file", "facility", "program", "process", "name")
MESSAGE_KEYS = ("message", "msg", "event", "title", "body")

ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
WORD = r"[A-Za-z]+"
ISO = r"\d{4}-\d\d-\d\d(?:T|\s+)\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?:\s?(?:Z|[+-]\d\d:?\d\d))?"
CLF = r"\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d(?:[.,]\d+)?(?:\s+[+-]\d{4})?"
NAME = r"[A-Za-z0-9_./$@-]+"
_ISO = re.compile(r"(\d{4}-\d\d-\d\d)[T\s]+(\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9}))?\s?(Z|[+-]\d\d:?\d\d)?$")
_CLF = re.compile(r"(\d\d)/([A-Z][a-z]{2})/(\d{4}):(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?\s*([+-]\d{4})?$")
_BGL = re.compile(r"(\d{4}-\d\d-\d\d)-(\d\d)\.(\d\d)\.(\d\d)(?:\.(\d{1,9}))?$")


@lru_cache(maxsize=4096)
def day_ms(text: str) -> int | None:
    """Epoch milliseconds of a YYYY-MM-DD day; None where there is no such day."""
    try:
        return (date.fromisoformat(text).toordinal() - 719_163) * DAY_MS
    except ValueError:
        return None


def _clock(h: str, m: str, s: str, fraction: str | None) -> int:
    return (int(h) * 3600 + int(m) * 60 + int(s)) * 1000 + (int(fraction[:3].ljust(3, "0")) if fraction else 0)


def _offset(text: str | None) -> int:
    if not text or text == "Z":
        return 0
    ms = (int(text[1:3]) * 60 + int(text[-2:])) * 60_000
    return -ms if text[0] == "-" else ms


def iso_ms(text: str) -> int | None:
    m = _ISO.match(text)
    day = day_ms(m[1]) if m else None
    return None if day is None else day + _clock(m[2], m[3], m[4], m[5]) - _offset(m[6])


def clf_ms(text: str) -> int | None:
    m = _CLF.match(text)
    if not m or m[2].lower() not in MONTHS:
        return None
    day = day_ms(f"{m[3]}-{MONTHS[m[2].lower()]:02}-{m[1]}")
    return None if day is None else day + _clock(m[4], m[5], m[6], m[7]) - _offset(m[8])


def bgl_ms(text: str) -> int | None:
    m = _BGL.match(text)
    day = day_ms(m[1]) if m else None
    return None if day is None else day + _clock(m[2], m[3], m[4], m[5])


def epoch_ms(text: str) -> int | None:
    """Seconds (with or without a fraction), milliseconds, microseconds or nanoseconds, told apart by size."""
    whole, _, fraction = text.partition(".")
    if not whole.isdigit() or (fraction and not fraction.isdigit()):
        return None
    n = int(whole)
    if len(whole) <= 11:
        return n * 1000 + (int(fraction[:3].ljust(3, "0")) if fraction else 0)
    return n if len(whole) <= 14 else n // 1000 if len(whole) <= 17 else n // 1_000_000


def yearless_ms(month: int, day: str, clock: int, near_ms: int | None) -> int | None:
    """The year that brings the time closest to near_ms; None without near_ms."""
    if near_ms is None:
        return None
    year = 1970 + int(near_ms // 31_556_952_000)
    found = [d + clock for y in (year - 1, year, year + 1) if (d := day_ms(f"{y:04}-{month:02}-{int(day):02}")) is not None]
    return min(found, key=lambda t: abs(t - near_ms)) if found else None


def any_ms(value) -> tuple[int | None, int]:
    """Time of a field's value and how exact it is (digits after the second)."""
    if isinstance(value, bool) or value is None:
        return None, -1
    text = str(value).strip() if not isinstance(value, float) else f"{value:.6f}"
    ms = epoch_ms(text)
    if ms is not None:
        whole, _, fraction = text.partition(".")
        return ms, max(0, len(whole) - 10) + len(fraction)
    ms = iso_ms(text)
    if ms is not None:
        m = _ISO.match(text)
        return ms, len(m[5] or "")
    ms = clf_ms(text)
    return ms, 0 if ms is not None else -1


def fold_level(text: str | None) -> str | None:
    return LEVELS.get(text.strip().lower()) if text else None


def number_level(n: int, otel: bool) -> str | None:
    if otel:
        return OTEL[(n - 1) // 4] if 1 <= n <= 24 else None
    return SYSLOG[n] if 0 <= n <= 7 else number_level(n, True)


def field_level(key: str, value) -> str | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int) or (isinstance(value, str) and value.strip().isdigit()):
        return number_level(int(value), key.lower().replace("_", "") == "severitynumber")
    return fold_level(value) if isinstance(value, str) else None


class Entry:
    """What an entry states: ts_ms, level, component (each None if not stated), message, and its layout."""

    __slots__ = ("component", "layout", "level", "message", "ts_ms")

    def __init__(self, layout, ts_ms, level, component, message):
        self.layout, self.ts_ms, self.level, self.component, self.message = layout, ts_ms, level, component, message


# --- extraction by layout: each gets the match, the whole text and the event time near it ---


def _simple(layout: str, when):
    def read(m, text, near):
        return Entry(layout, when(m["ts"]), fold_level(m["level"]), m["comp"], text[m.end() :])

    return read


def _trailing_logger(m, text, near):
    """[time] LEVEL message (logger): the logger ends the first line that ends so, or the whole entry."""
    rest = text[m.end() :]
    line, nl, more = rest.partition("\n")
    tail = _LOGGER_END.search(line.rstrip())
    if tail:
        return Entry("trailing_logger", iso_ms(m["ts"]), fold_level(m["level"]), tail[1], line[: tail.start()] + nl + more)
    tail = _LOGGER_END.search(rest.rstrip())
    message = rest[: tail.start()] if tail else rest
    return Entry("trailing_logger", iso_ms(m["ts"]), fold_level(m["level"]), tail[1] if tail else None, message)


_LOGGER_END = re.compile(r"\(([A-Za-z_][\w.$-]*)(?::\d+)?\)$")


def _spring(m, text, near):
    return Entry("preamble", iso_ms(m["ts"]), fold_level(m["level"]), m["comp"] or m["logger"], text[m.end() :])


def _glog(m, text, near):
    ts = yearless_ms(int(m["mon"]), m["day"], _clock(m["h"], m["mi"], m["s"], m["f"]), near)
    return Entry("letter_head", ts, fold_level(m["level"]), m["comp"], text[m.end() :])


def _syslog_new(m, text, near):
    comp = m["comp"] if m["comp"] != "-" else None
    return Entry("syslog_new", iso_ms(m["ts"]), SYSLOG[int(m["pri"]) % 8], comp, text[m.end() :])


def _syslog_old(m, text, near):
    mon = MONTHS.get(m["mon"].lower())
    ts = yearless_ms(mon, m["day"], _clock(m["h"], m["mi"], m["s"], None), near) if mon else None
    level = SYSLOG[int(m["pri"]) % 8] if m["pri"] else None
    return Entry("syslog_old", ts, level, m["comp"], text[m.end() :])


def _bgl(m, text, near):
    return Entry("ras", bgl_ms(m["ts"]), fold_level(m["level"]), m["comp"], text[m.end() :])


def _bracket(m, text, near):
    level = fold_level(m["level"])
    return Entry("bracket", None, level, m["comp"], text[m.end() :]) if level else None


def _access(m, text, near):
    return Entry("access", None, None, None, text)


_PAIR = re.compile(r'\s*([A-Za-z_@][\w.@-]*)=("(?:[^"\\]|\\.)*"|\S*)', re.S)
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\(.)", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPED.get(m[2], m[2]), text) if "\\" in text else text


def _pairs(m, text, near):
    fields, at = {}, 0
    while p := _PAIR.match(text, at):
        value = p[2]
        if value.startswith('"'):
            if len(value) < 2 or not value.endswith('"'):
                break
            value = unescape(value[1:-1])
        elif p.end() == len(text) and not text.endswith(("\n", " ")) and value.startswith('"'):
            break
        fields.setdefault(p[1], value)
        at = p.end()
    if not any(k in fields for k in (*TIME_KEYS, *LEVEL_KEYS)):
        return None
    entry = _from_fields("pairs", fields)
    rest = text[at:]
    if entry.message is None:
        tail = re.search(r'\b(?:msg|message|event)="?(.*)', text, re.S)
        entry.message = unescape(tail[1]) if tail else rest
    elif rest.strip():
        entry.message += rest
    return entry


def _from_fields(layout: str, fields: dict) -> Entry:
    best = (None, -1)
    for k in TIME_KEYS:
        if k in fields:
            got = any_ms(fields[k])
            if got[1] > best[1]:
                best = got
    level = next((x for k in LEVEL_KEYS if k in fields and (x := field_level(k, fields[k]))), None)
    comp = next((v for k in (*SERVICE_KEYS, *PROGRAM_KEYS) if isinstance(v := fields.get(k), str) and v), None)
    message = next((v for k in MESSAGE_KEYS if isinstance(v := fields.get(k), str)), None)
    return Entry(layout, best[0], level, comp, message)


def _flat(o: dict, fields: dict) -> dict:
    """Scalars by key, outer ones first; attribute lists and *Value wrappers are opened."""
    inner = []
    for k, v in o.items():
        if isinstance(v, dict):
            if len(v) == 1 and next(iter(v)).endswith("Value") and not isinstance(x := next(iter(v.values())), dict | list):
                fields.setdefault(k, x)
            else:
                inner.append(v)
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, dict) and isinstance(x.get("key"), str) and "value" in x:
                    inner.append({x["key"]: x["value"]})
        else:
            fields.setdefault(k, v)
    for v in inner:
        _flat(v, fields)
    return fields


_LOOSE = re.compile(r'"([\w.@-]+)"\s*:\s*(?:\{\s*"\w+Value"\s*:\s*)?("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?=\s*[,}\]]))', re.S)
_LOOSE_ATTR = re.compile(r'"key"\s*:\s*"([^"]+)"\s*,\s*"value"\s*:\s*\{\s*"\w+"\s*:\s*"([^"]*)"', re.S)


def _json(m, text, near):
    try:
        o = json.loads(text)
        fields = _flat(o, {}) if isinstance(o, dict) else None
    except (ValueError, RecursionError):  # cut off or broken: what it states completely still counts
        fields = {}
        for k, v in _LOOSE.findall(text):
            fields.setdefault(k, unescape(v[1:-1]) if v[0] == '"' else v)
        for k, v in _LOOSE_ATTR.findall(text):
            fields.setdefault(k, v)
        if not fields:
            return None
    if fields is None:
        return None
    entry = _from_fields("json", fields)
    if entry.message is None:
        tail = re.search(r'"(?:message|msg|stringValue)"\s*:\s*"(.*)', text, re.S)
        entry.message = tail[1] if tail else text
    return entry


_DECODER = json.JSONDecoder()


def json_end(text: str) -> int:
    """Where the JSON object a text begins with ends; 0 if it isn't complete."""
    try:
        return _DECODER.raw_decode(text)[1] if text.startswith("{") else 0
    except (ValueError, RecursionError):
        return 0


LAYOUTS = (
    # name, anchor literals (any of them), anchored expression, extraction
    ("json", ("{",), r"\{", _json),
    ("preamble", (" --- [",), rf"(?P<ts>{ISO})\s+(?P<level>{WORD})\s+(?:\[(?P<comp>[^\],\s]+)?(?:,[^\]]*)?\]\s+)?\d+\s+---\s+\[[^\]]*\]\s+(?P<logger>\S+)\s+:\s?", _spring),
    ("ras", (" RAS ",), rf"\S+\s+\d{{9,11}}\s+\d{{4}}\.\d\d\.\d\d\s+\S+\s+(?P<ts>\d{{4}}-\d\d-\d\d-\d\d\.\d\d\.\d\d\.\d+)\s+\S+\s+RAS\s+(?P<comp>\S+)\s+(?P<level>{WORD})(?:\s|$)", _bgl),
    ("syslog_new", (">1 ",), rf"<(?P<pri>\d{{1,3}})>1\s+(?P<ts>{ISO})\s+\S+\s+(?P<comp>\S+)\s+\S+\s+\S+\s+(?:-|(?:\[[^\]]*\])+)(?:\s|$)", _syslog_new),
    ("syslog_old", ("<", ":"), r"(?:<(?P<pri>\d{1,3})>)?(?P<mon>[A-Z][a-z]{2})\s+(?P<day>\d{1,2})\s+(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)\s+\S+\s+(?P<comp>[^\s\[:]+)(?:\[\d+\])?:(?:\s|$)", _syslog_old),
    ("pairs", ("=",), r'(?=[A-Za-z_@][\w.@-]*=)', _pairs),
    ("letter_head", ("] ",), rf"(?P<level>[A-Z])(?P<mon>\d\d)(?P<day>\d\d)\s+(?P<h>\d\d):(?P<mi>\d\d):(?P<s>\d\d)(?:\.(?P<f>\d+))?\s+\d+\s+(?P<comp>{NAME}):\d+\]\s?", _glog),
    ("trailing_logger", ("] ",), rf"\[(?P<ts>{ISO})\]\s+(?P<level>{WORD})\s+", _trailing_logger),
    ("bracketed_level", ("] ",), rf"(?P<ts>{ISO})\s+\[(?P<level>{WORD})\]\s+(?P<comp>{NAME}):(?:\s|$)", _simple("bracketed_level", iso_ms)),
    ("bracketed_service", ("] ",), rf"(?P<ts>{ISO})\s+(?P<level>{WORD})\s+\[(?P<comp>[^\],\s]+)\](?:\s|$)", _simple("bracketed_service", iso_ms)),
    ("bracket", ("] ",), rf"\[(?P<comp>[A-Za-z0-9._-]+)\]\s+(?P<level>{WORD}):(?:\s|$)", _bracket),
    ("module_path", (": ",), rf"(?P<ts>{ISO})\s+(?P<level>{WORD})\s+(?:ThreadId\(\d+\)\s+)?(?P<comp>[A-Za-z_][\w.]*(?:::\w+)*):(?:\s|$)", _simple("module_path", iso_ms)),
    ("colon_head", (":",), rf"(?P<level>{WORD}):(?P<comp>[\w.-]+):(?P<ts>{ISO}):", _simple("colon_head", iso_ms)),
    ("dashes", (" - ",), rf"(?P<ts>{ISO})\s+-\s+(?P<comp>{NAME})\s+-\s+(?P<level>{WORD})\s+-(?:\s|$)", _simple("dashes", iso_ms)),
    ("pipes", (" | ", " |"), rf"(?P<ts>{CLF}|{ISO})\s+\|\s*(?P<level>{WORD})\s*\|\s*(?P<comp>{NAME})\s*\|\s?", _simple("pipes", lambda t: clf_ms(t) if "/" in t else iso_ms(t))),
    ("epoch_head", (": ",), rf"(?P<ts>\d{{10}}(?:\.\d+)?)\s+(?P<level>{WORD})\s+(?P<comp>{NAME}):(?:\s|$)", _simple("epoch_head", epoch_ms)),
    ("access", (" /",), r"[A-Z]{3,7}\s+/\S*\s+\d{3}\s+\d+(?:\.\d+)?\s+ms\s+-\s+\d+", _access),
)


class Router:
    """Finds the layout of an entry. ``parse`` is its one use; building takes a millisecond."""

    def __init__(self):
        anchors: dict[str, int] = {}
        for i, (_, literals, _, _) in enumerate(LAYOUTS):
            for literal in literals:
                anchors[literal] = anchors.get(literal, 0) | 1 << i
        self.machine = ahocorasick.Automaton()
        for literal, bits in anchors.items():
            self.machine.add_word(literal, bits)
        self.machine.make_automaton()
        self.all = [(re.compile(expression, re.S), read) for _, _, expression, read in LAYOUTS]
        self.every = (1 << len(LAYOUTS)) - 1
        self.sets: dict[int, list] = {}

    def parse(self, text: str, near_ms: int | None = None) -> Entry | None:
        """The entry's fields, or None where no layout's head begins the text. Colour codes are ignored."""
        if "\x1b" in text:
            text = ANSI.sub("", text)
        end = text.find("\n")
        whole = len(text)
        entry, bits = self._among(text, 0, end if end >= 0 else whole, 0, near_ms)
        if entry is None and end >= 0:
            entry, _ = self._among(text, end, whole, bits, near_ms)
        return entry

    def _among(self, text: str, start: int, end: int, known: int, near_ms: int | None) -> tuple[Entry | None, int]:
        """The entry by one of the layouts whose anchors stand in a part of the text, the ones ``known`` before aside; and all anchors so far."""
        bits = known
        for _, found in self.machine.iter(text, start, end):
            bits |= found
            if bits == self.every:
                break
        new = bits & ~known
        candidates = self.sets.get(new)
        if candidates is None:
            candidates = self.sets[new] = [x for i, x in enumerate(self.all) if new >> i & 1]
        for expression, read in candidates:
            m = expression.match(text)
            if m:
                entry = read(m, text, near_ms)
                if entry is not None:
                    return entry, bits
        return None, bits


def line_count(text: str) -> int:
    """Lines of a text; a closing break opens no further line."""
    return text.count("\n") + (not text.endswith("\n"))
