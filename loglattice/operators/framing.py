"""Multi-line blocks (stack traces, panics, compiler and assertion output) from source lines.

A small automaton per family decides which lines go on from a start. Lanes are
cut into chunks at sure lines: those that can't go on from anything, and those
with no start among the ``MOST_LINES`` lines before them, as no block is longer.
So a chunk frames alike whatever stands before it, and a lane of any size
spreads over tasks. Only lines that go on from one another without any sure
line between them stay in one chunk, however many they are.

Cases: null text is an incomplete record, a block of its own. Lines with
control or non-ASCII characters join nothing. A gap in the lane's sequence, or
more than ``MOST_GAP_MS`` between two lines, ends a block; lines without a time
lower its confidence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 4096
MOST_LINES, MOST_BYTES, MOST_DEPTH, MOST_GAP_MS = 256, 1 << 20, 32, 30_000

# How lines of each family look.
HEAD = r"[^:\s]*"  # the word before a message
PY_START = r"Traceback \(most recent call last\):$"
PY_FRAME = r"  File [\"']"
PY_DETAIL = r"(?:    |\t)"
PY_END = rf"(?!\s)(?:{HEAD}(?:Error|Exception)|KeyboardInterrupt|SystemExit|GeneratorExit)(?=[:\s]|$)"
PY_CHAIN = r"(?:During handling of the above exception, another exception occurred:|The above exception was the direct cause of the following exception:)$"
JVM_START = r"Exception in thread \"|Unhandled exception\.|Unhandled Exception:"
JVM_HEAD = rf"(?!\s)(?={HEAD}\.){HEAD}(?:Exception|Error)(?=[:\s]|$)"
JS_HEAD = r"(?:Error|TypeError|ReferenceError|RangeError|SyntaxError|URIError|EvalError|AggregateError)(?=[:\s]|$)"
FRAME = r"[ \t]+at "
CAUSE = r"\s*(?:Caused by:|Suppressed:|Wrapped by:)"
ELIDED = r"\s*\.\.\. .*(?<= more)$"
INNER = r"\s*(?:---> |--- End of inner exception stack trace ---$)"
RUST_START = r"panicked at |thread '.*' panicked at |thread \".*\" panicked at "
RUST_MARK = r"\s*stack backtrace:$"
RUST_FRAME = r"\s*\d+:|\s+at .*[/\\:]"
RUST_NOTE = r"\s*(?:note: run with |left:|right:)"
GO_START = r"panic:|fatal error:"
GO_ROUTINE = r"\s*goroutine \d+ .*:$|\s*goroutine \d+ :$"
GO_FUNCTION = r"(?!\s)[^ ]*\([^ ]*\)$"
GO_PLACE = r"\s+.*\.go:"
GO_CREATED = r"\s*created by "
CC_START = r"error\[|warning\[|fatal error C"
CC_WEAK = r"error:|warning:"
CC_BODY = r"\s*(?:-->|:::|= note:|= help:|help:|note:|\^|\||\d+\s*\|)"
AS_START = r"AssertionError|AssertionFailedError|org\.opentest4j\.AssertionFailedError|assertion failed:|assertion .* failed$"
AS_DETAIL = r"\s*(?:left:|right:|[eE]xpected:|[aA]ctual:)"
DIFF_WANT, DIFF_GOT = r"--- [eE]xpected", r"\+\+\+ [aA]ctual"
DIFF = rf"{DIFF_WANT}|{DIFF_GOT}|@@ |\+ |- |>|<"
BLANK = r"\s*$"


@dataclass(frozen=True)
class Family:
    """starts: (line, next line or None). phases: per phase (line, next phase, deeper, what may follow a blank line)."""

    name: str
    starts: tuple[tuple[str, str | None], ...]
    phases: tuple[tuple[tuple[str, int, bool], ...], ...]
    after_blank: tuple[str, ...] = field(default=())


FAMILIES = (
    Family("python", ((PY_START, None),), (((PY_FRAME, 0, False), (PY_DETAIL, 0, False), (PY_END, 1, False), (PY_CHAIN, 2, True)), ((PY_CHAIN, 2, True),), ((PY_START, 0, False),)), (f"{PY_FRAME}|{PY_END}", PY_CHAIN, PY_START)),
    Family("rust", ((RUST_START, None),), (((RUST_MARK, 0, False), (RUST_FRAME, 0, False), (RUST_NOTE, 0, False)),), (f"{RUST_MARK}|{RUST_FRAME}",)),
    Family("go", ((GO_START, None),), (((GO_ROUTINE, 1, True),), ((GO_ROUTINE, 1, True), (GO_FUNCTION, 1, False), (GO_PLACE, 1, False), (GO_CREATED, 1, False))), (GO_ROUTINE, GO_ROUTINE)),
    Family("compiler", ((CC_START, None), (CC_WEAK, CC_BODY)), (((CC_BODY, 0, False),),), (CC_BODY,)),
    Family("assertion", ((AS_START, None), (DIFF_WANT, DIFF_GOT)), (((AS_DETAIL, 0, False), (DIFF, 0, False)),), (f"{AS_DETAIL}|{DIFF}",)),
    Family("jvm_dotnet", ((JVM_START, None), (JVM_HEAD, FRAME)), (((CAUSE, 0, True), (INNER, 0, True), (FRAME, 0, False), (ELIDED, 0, False)),), (f"{FRAME}|{CAUSE}|{INNER}",)),
    Family("javascript", ((JS_HEAD, FRAME),), (((CAUSE, 0, True), (FRAME, 0, False), (ELIDED, 0, False)),), (f"{FRAME}|{CAUSE}",)),
)
ORPHAN = "|".join(f"(?:{p})" for p in (PY_FRAME, PY_DETAIL, PY_CHAIN, FRAME, CAUSE, ELIDED, INNER, RUST_MARK, RUST_FRAME, GO_ROUTINE, GO_PLACE, CC_BODY, DIFF))
GOES_ON = "|".join(sorted({f"(?:{p})" for f in FAMILIES for phase in f.phases for p, _, _ in phase} | {f"(?:{BLANK})"}))
MAY_START = "|".join(sorted({f"(?:{p})" for f in FAMILIES for p, _ in f.starts}))
_PLAIN = re.compile(r"[\t\x20-\x7e]*\Z")
_MADE: dict[str, re.Pattern] = {}


def _is(pattern: str, line: str | None) -> bool:
    if line is None:
        return False
    made = _MADE.get(pattern)
    if made is None:
        made = _MADE[pattern] = re.compile(pattern)
    return made.match(line) is not None


def start_of(line: str, following: str | None) -> Family | None:
    for f in FAMILIES:
        for pattern, need in f.starts:
            if _is(pattern, line) and (need is None or _is(need, following)):
                return f
    return None


def step(family: Family, phase: int, line: str, following: str | None) -> tuple[int, bool] | None:
    """(next phase, deeper) if the line goes on, else None."""
    for pattern, to, deeper in family.phases[phase]:
        if _is(pattern, line):
            return to, deeper
    return (phase, False) if _is(BLANK, line) and _is(family.after_blank[phase], following) else None


def _joinable(line: str | None) -> bool:
    return line is not None and _PLAIN.match(line) is not None


def frame_lane(rows: list[tuple[int, str | None, int | None]]) -> list[tuple[int, int, str, str, str]]:
    """rows: (sequence, line, time) in order. Gives (first, last index + 1, family, state, confidence) of each block."""
    out, i, n = [], 0, len(rows)

    def near(a: int, b: int) -> bool | None:
        (s, _, t), (s2, _, t2) = rows[a], rows[b]
        if s + 1 != s2:
            return False
        return None if t is None or t2 is None else 0 <= t2 - t <= MOST_GAP_MS

    while i < n:
        line = rows[i][1]
        following = rows[i + 1][1] if i + 1 < n and _joinable(rows[i + 1][1]) else None
        family = start_of(line, following) if _joinable(line) else None
        end, unsure, capped = i + 1, False, False
        if family:
            phase, depth, size = 0, 0, len(line) + 1
            while end < n:
                close = near(end - 1, end)
                if close is False or not _joinable(rows[end][1]):
                    break
                ahead = None
                if end + 1 < n and end + 2 - i <= MOST_LINES and near(end, end + 1) is not False and _joinable(rows[end + 1][1]):
                    ahead = rows[end + 1][1]
                went = step(family, phase, rows[end][1], ahead)
                if went is None:
                    break
                if end + 1 - i > MOST_LINES or size + len(rows[end][1]) + 1 > MOST_BYTES or depth + went[1] > MOST_DEPTH:
                    capped = True
                    break
                unsure |= close is None
                phase, depth, size, end = went[0], depth + went[1], size + len(rows[end][1]) + 1, end + 1
        if end - i > 1:
            out.append((i, end, family.name, "reconstructed", "medium" if capped or unsure else "high"))
        else:
            out.append((i, end, "", *_single(line, family)))
        i = end
    return out


def _single(line: str | None, family: Family | None) -> tuple[str, str]:
    if line is None:
        return "ambiguous", "unknown"
    if "\n" in line or "\r" in line:
        return "provider_atomic", "certain"
    if family or (_joinable(line) and _is(ORPHAN, line)):
        return "ambiguous", "low"
    return "fallback", "certain" if _joinable(line) else "unknown"


SCHEMA = "lane {lane}, first_seq long, last_seq long, n_lines long, family string, state string, confidence string"


def frame(lines: DataFrame, lane: str, seq: str, text: str, time: str | None = None) -> DataFrame:
    """Blocks of each lane: lane, first_seq, last_seq, n_lines, family, state, confidence."""
    rows = lines.select(F.col(lane).alias("lane"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("line"), (F.col(time) if time else F.lit(None)).cast("long").alias("t"))
    goes_on = F.coalesce(F.col("line").rlike(f"^(?:{GOES_ON})"), F.lit(False))
    starts = F.coalesce(F.col("line").rlike(f"^(?:{MAY_START})"), F.lit(False))
    marked = rows.withColumns({"block": F.expr(f"seq div {BLOCK}"), "soft": goes_on, "starts": starts})
    order = Window.partitionBy("lane", "block").orderBy("seq")
    near = order.rowsBetween(-MOST_LINES, -1)
    quiet = (F.count(F.lit(1)).over(near) == MOST_LINES) & ~F.max("starts").over(near)
    sure = marked.withColumn("sure", ~F.col("soft") | F.coalesce(quiet, F.lit(False)))
    seen = sure.withColumn("seen", F.max("sure").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # one row per block: lines before a block's first sure line belong to the last block that has one
    blocks = seen.groupBy("lane", "block").agg(F.max("sure").alias("has"))
    before = F.last(F.when(F.col("has"), F.col("block")), ignorenulls=True).over(Window.partitionBy("lane").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    owner = blocks.select("lane", "block", F.coalesce(before, F.lit(-1)).alias("owner"))
    chunked = seen.join(owner, ["lane", "block"]).withColumn("chunk", F.when(F.col("seen"), F.col("block")).otherwise(F.col("owner")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        data = [(int(s), x, None if pd.isna(t) else int(t)) for s, x, t in zip(pdf["seq"], pdf["line"], pdf["t"])]
        found = [(pdf["lane"].iloc[0], data[a][0], data[b - 1][0], b - a, fam, state, conf) for a, b, fam, state, conf in frame_lane(data)]
        return pd.DataFrame(found, columns=["lane", "first_seq", "last_seq", "n_lines", "family", "state", "confidence"])

    kind = dict(rows.dtypes)["lane"]
    return chunked.select("lane", "chunk", "seq", "line", "t").groupBy("lane", "chunk").applyInPandas(run, SCHEMA.format(lane=kind))


def split_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Exact lines of a text: key, seq, payload, terminator. Splits on line feeds only; a carriage return before one joins the terminator; an unended tail has a null terminator.

    A null or empty text has no lines.
    """
    parts = F.regexp_extract_all(F.col(text), F.lit(r"([^\n]*\n|[^\n]+\z)"), F.lit(1))
    lines = rows.select(F.col(key), F.posexplode(parts).alias("seq", "raw"))
    end = F.when(F.col("raw").endswith("\r\n"), "\r\n").when(F.col("raw").endswith("\n"), "\n")
    cut = F.length("raw") - F.coalesce(F.length(end), F.lit(0))
    return lines.select(key, F.col("seq").cast("long").alias("seq"), F.substring("raw", F.lit(1), cut).alias("payload"), end.alias("terminator"))
