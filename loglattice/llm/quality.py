"""Per-document text statistics and a verdict whether a text is natural prose.

Lines come first. Neighbouring lines whose delimiters stand in the same number
or in the same columns are table rows; markers make list items; lines a log
layout begins (and what goes on from them) are log output. What is left is read as
paragraphs, and here structure and ratios decide together: a paragraph is
running text if its units (sentences, or lines where none are marked) have
enough words, and the more its lines look like a list (indentation that
repeats with a period, line lengths that correlate with those a few lines
before), the more words it takes. Its symbols, common words and words
made of letters must be in the range of prose as well. A text is natural prose
if at least ``PROSE_SHARE`` of its characters, white space at line ends aside,
belong to such paragraphs, and if its symbol ratio, mean word length and share
of common words (or of punctuated lines) are ones that prose has.

The constants were set on labelled documents with even doc_id and are reported
on those with odd doc_id (``tests/llm/test_quality.py``).

Cases: a null text has null statistics and a null verdict; an empty or blank
one has zeros and a null verdict, as it isn't a case. Very long texts are read
whole, line by line. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loglattice.functions.layouts import Router

PROSE_SHARE = 0.5
UNIT_WORDS = 6.3  # words of a paragraph's mean unit from which it's running text
COMMON = (0.09, 0.8)  # share of common words between which it's running text
CLEAN_WORDS = 0.62  # share of words made of letters
LIST_BAR = 12.0  # words a unit needs more where the list structure is perfect
LEAST_STRUCTURE = 0.35  # structure below this is chance
CHANCE = 2.5  # times 1 / sqrt(lines): correlation of lengths that independent lines may have
LEAST_LINES = 5  # lines it takes to tell a period
SYMBOLS_AT_MOST, WORD_LENGTH, COMMON_AT_LEAST = 0.3, (2.0, 12.0), 0.05  # of a text of prose
PUNCTUATED = 0.5  # share of punctuated lines from which a text may lack common words
WRAP_AT = 30  # a paragraph is wrapped if its lines but the last are about as long as one another, and at least so long

STATS = ["n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "alignment", "indent_period", "length_autocorrelation", "prose_share"]
_TYPES = {"n_words": "long", **dict.fromkeys(STATS[1:], "double")}

_MARK = re.compile(r"\s*(?:[-*+•‣◦·–—]\s+|\(?\d{1,4}[.)]\s+|\(?[a-zA-Z][.)]\s+|\[[ xX]\]\s*|(?:step|étape|schritt|paso)\s+\d+\s*[:.)])", re.I)
_FIELD = re.compile(r"\s*\S[^:=|]{0,60}?\s*(?:=\s|:\s|=>|->)\s*\S++(?:\s\S++){0,2}\s*$")
_GOES_ON = re.compile(r"\s|(?:Traceback \(|Caused by|goroutine \d+|main\.\w+\(|[\w.$]+(?:Exception|Error)\b)")
_GAP = re.compile(r"\S {2,}(?=\S)")
_DELIMITERS = "|│┃║\t;,"
_TERMINAL = re.compile(r"[.!?…。！？](?:(?<=[。！？])|[.!?…]*[\"'”’)»]*(?=\s|$))")
_WORD = re.compile(r"[^\W_]+(?:['’._:/-][^\W_]+|_)*")
_CLEAN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*$")
_GARBLED = re.compile(r"[�Ãâ¤¨œ¿½](?![a-zéèà]*\s)|(?<=\w)[?¤](?=\w)|[�¤¨]")
_HEX_DUMP = re.compile(r"[0-9a-fA-F]{4,16}[: ]\s*(?:[0-9a-fA-F]{2,4}\s+){4,}")
_VALUE_WORD = re.compile(r"\d")
_OTHER_SCRIPTS = re.compile(r"[^\x00-\x7f]+")
_NOT_ALNUM = bytes(b for b in range(256) if not chr(b).isalnum() or b > 127)
_LINE_END = re.compile(r"[.!?…][\"'”’)»]*\s*$")
_STOPS = re.compile(r"[.!?…:;][\"'”’)»]*$")
_MAY_BE_LOG = re.compile(r"[\[{<\d-]|[A-Z]\d{4}|[A-Z]{3,}[:\s]|[a-z@_]\w*=|[A-Z][a-z]{2}\s+\d")


def delimiter_alignment(lines: list[str], text: str) -> list[bool]:
    """Whether each line shares its delimiters' number, or its columns' places, with neighbours."""
    n = len(lines)
    aligned = [False] * n
    for d in _DELIMITERS:
        if d not in text:
            continue
        counts = [line.count(d) for line in lines]
        run = 0
        for i in range(1, n + 1):
            if i < n and counts[i] == counts[run] and counts[i]:
                continue
            if counts[run] and i - run >= (4 if d in ",;" and counts[run] < 3 else 2):
                rows = [d != "," or _cells(line) for line in lines[run:i]]
                if sum(rows) >= 0.6 * len(rows):
                    aligned[run:i] = [x or y for x, y in zip(aligned[run:i], rows)]
            run = i
    if "  " in text:
        starts = [frozenset(m.end() for m in _GAP.finditer(line)) if "  " in line else None for line in lines]
        for i, own in enumerate(starts):
            if own and any(0 <= j < n and starts[j] and 2 * len(own & starts[j]) >= min(len(own), len(starts[j])) for j in (i - 1, i + 1)):
                aligned[i] = True
    return aligned


def _cells(line: str) -> bool:
    """Commas between cells, not between clauses: no space after them, and few words between them."""
    cells = line.split(",")
    return sum(not c.startswith(" ") for c in cells[1:]) > 0.7 * (len(cells) - 1) and len(line.split()) <= 5 * len(cells)


def autocorrelation(values: list[float], lag: int) -> float:
    n = len(values)
    if n <= lag + 1:
        return 0.0
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if not spread:
        return 1.0
    return sum((values[i] - mean) * (values[i + lag] - mean) for i in range(n - lag)) / spread


def _periodic(values: list[float]) -> float:
    """Strongest autocorrelation at lags 1 to 4; 0 where nothing varies."""
    return max(autocorrelation(values, k) for k in range(1, 5)) if len(set(values)) > 1 else 0.0


def indent_period(lines: list[str]) -> float:
    """How strongly the indentation repeats; 0 where it doesn't vary."""
    if not any(map(str.isspace, map(itemgetter(0), filter(None, lines)))):
        return 0.0
    return _periodic([float(len(x) - len(x.lstrip())) for x in lines])


def list_structure(lines: list[str]) -> float:
    """0 to 1: how far unmarked lines look like the items of a list or the rows of a form.

    Indentation that repeats with a period says so whatever the lines hold; line lengths
    that do only where lines don't end as sentences do and aren't wrapped text.
    """
    if len(lines) < LEAST_LINES:
        return 0.0
    found = indent_period(lines)
    plain = [x.strip() for x in lines]
    if sum(map(bool, map(_LINE_END.search, plain))) < 0.3 * len(lines) and not _is_wrapped(plain):
        lengths = _periodic([float(len(x)) for x in plain])
        if lengths >= CHANCE / math.sqrt(len(lines)):
            found = max(found, lengths)
    return found if found >= LEAST_STRUCTURE else 0.0


def _is_wrapped(lines: list[str]) -> bool:
    body = [len(x) for x in lines[:-1]]
    return bool(body) and min(body) >= WRAP_AT and min(body) >= 0.6 * max(body) and len(lines[-1].strip()) <= max(body) + 2


def repetition(words: list[str]) -> float:
    """Largest share of words that stand again 1 to 24 words later: near 1 where a phrase is said over and over."""
    n = len(words)
    if 2 * len(set(words)) > n:  # half of them stand once: no phrase fills the text
        return 0.0
    return max((sum(a == b for a, b in zip(words, words[k:])) / (n - k) for k in range(1, min(25, n))), default=0.0) if n > 20 else 0.0


def alnum_chars(text: str) -> int:
    """Letters and digits of a text, of any script."""
    n = len(text.encode("ascii", "ignore").translate(None, _NOT_ALNUM))
    return n if text.isascii() else n + sum(map(str.isalnum, "".join(_OTHER_SCRIPTS.findall(text))))


def _running(lines: list[str], words_of: list[list[str]], common_of: list[int]) -> bool:
    """lines: of one paragraph, with their indentation; words_of and common_of: each line's words, and how many of them are common."""
    words = [w for line in words_of for w in line]
    n = len(words)
    if n < 4:
        return False
    plain = [x.strip() for x in lines]
    text = " ".join(plain)
    if text.count(",") > 0.28 * n:
        return False
    odd = [w for line in words_of if not "".join(line).isalpha() for w in line if not w.isalpha()]
    if n - len(odd) + sum(map(bool, map(_CLEAN.match, odd))) < CLEAN_WORDS * n:
        return False
    letters = n - sum(map(bool, map(_VALUE_WORD.search, odd)))
    shared = sum(common_of) / max(1, letters)
    ends = len(_TERMINAL.findall(text))
    sentence = ends and text[0].isupper() and _LINE_END.search(text)  # a marked sentence may lack common words if it's short
    if shared > COMMON[1] or (shared < COMMON[0] and not (sentence and n < 14)):
        return False
    if not (text.isascii() and "?" not in text) and len(_GARBLED.findall(text)) > 0.12 * n:
        return False
    solid = len(text) - text.count(" ")
    if alnum_chars(text) < 0.8 * solid or repetition(words) > 0.5:
        return False
    at_line_end = sum(map(bool, map(_LINE_END.search, plain)))
    if ends == 0 or (ends == at_line_end and ends >= 0.8 * len(lines)):
        units = len(lines) if not (ends == 0 and _is_wrapped(plain)) else max(1, round(n / 14))
    else:
        units = max(ends, 1)
    bar = LIST_BAR * list_structure(lines)
    if letters / units < 0.5 * UNIT_WORDS:
        return False
    return n / units >= bar + (UNIT_WORDS if not (sentence and len(lines) == 1) else 5.5)


def _mean(values: Iterable[float], n: int) -> float:
    return sum(values) / n if n else 0.0


def text_stats(text: str, common: frozenset[str], router: Router) -> list:
    """Values of STATS for a text that isn't null."""
    lines = [x.rstrip() for x in text.splitlines()]
    full = [x for x in lines if x]
    words_of = [_WORD.findall(x.lower()) for x in full]
    common_of = [sum(map(common.__contains__, ws)) for ws in words_of]
    n_words = sum(map(len, words_of))
    solid = len("".join(text.split()))
    n, prose = len(full), 0
    aligned = delimiter_alignment(full, text)
    at = -1
    in_log = False
    paragraph: list[int] = []
    for line in [*lines, ""]:
        # a paragraph is text lines without a blank line, table row, item or log line between them
        is_text = False
        if line:
            at += 1
            entry = router.parse(line) if _MAY_BE_LOG.match(line) else None
            if entry is not None and (entry.ts_ms is not None or entry.level is not None or entry.layout == "access"):
                in_log = True
            elif not (in_log and _GOES_ON.match(line)):
                in_log = False
                is_text = not (aligned[at] or _MARK.match(line) or _HEX_DUMP.match(line) or _FIELD.match(line))
        if is_text:
            paragraph.append(at)
        elif paragraph:
            its = slice(paragraph[0], paragraph[-1] + 1)
            prose += _prose_chars(full[its], words_of[its], common_of[its])
            paragraph = []
    total = sum(len(x.strip()) for x in full)
    return [
        n_words,
        _mean([len("".join(ws)) for ws in words_of], n_words),
        (solid - alnum_chars(text)) / solid if solid else 0.0,
        _mean(map(bool, map(_STOPS.search, full)), n),
        _mean(common_of, n_words),
        _mean(aligned, n),
        indent_period(full) if n > 2 else 0.0,
        autocorrelation([float(len(x)) for x in full], 1) if n > 2 else 0.0,
        prose / total if total else 0.0,
    ]


def _prose_chars(lines: list[str], words_of: list[list[str]], common_of: list[int]) -> int:
    """Characters of a paragraph's running text; a heading or stray line before or after it may be left out."""
    sizes = [len(x.strip()) for x in lines]
    if _running(lines, words_of, common_of):
        return sum(sizes)
    best = 0
    if len(lines) > 1:
        for part in (slice(1, None), slice(None, -1)):
            if _running(lines[part], words_of[part], common_of[part]):
                best = max(best, sum(sizes[part]))
        if not best and not list_structure(lines):  # text and list without a blank line between them: the long lines
            best = sum(size for x, ws, c, size in zip(lines, words_of, common_of, sizes) if len(ws) >= 8 and _running([x], [ws], [c]))
    return best


def is_prose(stats: list) -> bool:
    """Enough running text, and word, symbol and common-word ratios as prose has them."""
    of = dict(zip(STATS, stats))
    low, high = WORD_LENGTH
    return of["prose_share"] >= PROSE_SHARE and of["symbol_ratio"] <= SYMBOLS_AT_MOST and low <= of["mean_word_length"] <= high and (of["common_words"] >= COMMON_AT_LEAST or of["punctuated_lines"] >= PUNCTUATED)


def common_words(words: DataFrame) -> frozenset[str]:
    """The distinct words of a table of frequent words; the table is fixed, and more than 10,000 is refused."""
    rows = words.where("word is not null").select(F.lower("word")).distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("common_words is meant to hold a few frequent words of each language")
    return frozenset(r[0] for r in rows)


def quality(rows: DataFrame, text: str, keep: list[str], common: frozenset[str]) -> DataFrame:
    """``keep`` columns, STATS and ``is_prose`` (null where the text is null or blank); no shuffle."""
    source = rows.select(*keep, F.col(text).alias("_ll_text"))
    fields = [f for f in source.schema.fields if f.name in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + ", ".join(f"{c} {t}" for c, t in _TYPES.items()) + ", is_prose boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router()
        for batch in batches:
            texts = batch.column("_ll_text").to_pylist()
            stats = [text_stats(t, common, router) if t is not None else [None] * len(STATS) for t in texts]
            verdict = [is_prose(s) if t and not t.isspace() else None for t, s in zip(texts, stats)]
            columns = [pa.array(c, pa.int64() if name == "n_words" else pa.float64()) for name, c in zip(STATS, zip(*stats))] if stats else [pa.array([], pa.int64() if n == "n_words" else pa.float64()) for n in STATS]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + columns + [pa.array(verdict, pa.bool_())], names=[f.name for f in fields] + STATS + ["is_prose"])

    return source.mapInArrow(run, ddl)
