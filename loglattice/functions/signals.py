"""Compound tokens of a text, and the failure and onset signals among them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loglattice.functions.records import NEGATORS, ascii_lower, settled

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
# Words of each kind, lower case.
FAILURES = {
    "error": ["error"], "fatal": ["fatal"], "critical": ["critical"], "panic": ["panic", "panicked", "panicking"], "assertion": ["assert", "assertion", "assertionerror"],
    "exception": ["exception"], "crash": ["crash", "crashed", "crashing"], "failure": ["fail", "failed", "failure"],
}
ONSETS = {
    "deployment": ["deploy", "deployed", "deployment", "redeployed"], "restart": ["restart", "restarted", "restarting"], "migration": ["migration", "migrate", "migrated", "migrating"],
    "configuration_change": ["reconfigured", "configuration-change", "configuration_changed", "config-reload", "config_reloaded"],
    "feature_flag_change": [f"feature{s}flag{s}{w}" for s in "-_." for w in ("enabled", "disabled")],
}
MAY_SIGNAL = "(?i)" + "|".join([*sorted({w for side in (FAILURES, ONSETS) for words in side.values() for w in words}), "Exception", "Error", r"\be[0-9]{4}\b"])
QUERY_STOP_WORDS = frozenset("an and are did do does for from how in is it log logs of on the to was were what when where why with".split())
TRACE_LABELS = frozenset("trace trace_id trace-id trace.id traceid".split())
SPAN_LABELS = frozenset("span span_id span-id span.id spanid".split())


class QueryTooLarge(ValueError):
    """A question passes one of its bounds; it isn't cut short."""


def _trim(token: Column) -> Column:
    return F.regexp_replace(token, r"^[.-]+|[.-]+$", "")


def compound_tokens(text: Column) -> Column:
    """Each compound, then its parts between slashes, then their parts between dots and hyphens (those of a UUID aside), in order, with repetitions."""
    whole = F.filter(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_./-]+)")), _trim), lambda t: t != "")

    def parts(c: Column) -> Column:
        def inner(s: Column) -> Column:
            own = F.when(s != c, F.array(s)).otherwise(F.array().cast("array<string>"))
            small = F.filter(F.split(s, "[.-]"), lambda p: (p != "") & (p != s) & (p != c))
            return F.concat(own, F.when(s.rlike(UUID), F.array().cast("array<string>")).otherwise(small))

        between = F.filter(F.transform(F.split(c, "/"), _trim), lambda s: s != "")
        return F.concat(F.array(c), F.flatten(F.transform(between, inner)))

    return F.flatten(F.transform(whole, parts))


def compound_tokens_of(text: str) -> list[str]:
    """The same for one string on the driver."""
    out = []
    for c in (x.strip(".-") for x in re.findall(r"[A-Za-z0-9_./-]+", text)):
        if not c:
            continue
        out.append(c)
        for s in (x.strip(".-") for x in c.split("/")):
            if not s:
                continue
            if s != c:
                out.append(s)
            if not re.match(UUID, s):
                out += [p for p in re.split("[.-]", s) if p and p != s and p != c]
    return out


def failure_kind(token: Column) -> Column:
    low = ascii_lower(token)
    compiler = low.rlike("^e[0-9]{4}$") & (low != "e0000")
    classy = token.rlike("^(?=[A-Za-z0-9_]*[A-Z][A-Za-z0-9_]*(?:Exception|Error)$)[A-Za-z0-9_]+(?:Exception|Error)$")
    out = F.when(F.lit(False), "")
    for kind, words in FAILURES.items():
        out = out.when(low.isin(words), kind)
    return out.when(classy, "exception").when(compiler, "compiler_error")


def onset_kind(token: Column) -> Column:
    low = ascii_lower(token)
    out = F.when(F.lit(False), "")
    for kind, words in ONSETS.items():
        out = out.when(low.isin(words), kind)
    return out


def signals(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns, failures and onsets: the kinds found, in order. A failure word right after no, without or zero isn't one. A null text has none.

    Texts in which no signal's letters stand at all aren't split into tokens.
    """
    may = F.when(F.col(text).rlike(MAY_SIGNAL), compound_tokens(F.col(text)))
    toks = settled(rows, keep, [F.coalesce(may, F.array().cast("array<string>")).alias("_ll_t")])
    t = F.col("_ll_t")

    def failure(x: Column, i: Column) -> Column:
        before = ascii_lower(F.get(t, i - 1))
        return F.when(~F.coalesce(before.isin(NEGATORS), F.lit(False)), failure_kind(x))

    return settled(toks, keep, [F.array_compact(F.transform(t, failure)).alias("failures"), F.array_compact(F.transform(t, onset_kind)).alias("onsets")])


@dataclass(frozen=True)
class Question:
    terms: tuple[str, ...]
    identifiers: tuple[tuple[str, str], ...]  # (kind, token)


def question_of(text: str, most_tokens: int = 256, most_terms: int = 128, most_identifiers: int = 32) -> Question:
    """Search terms and validated identifiers (UUID, compiler code, labelled trace and span ids) of a question."""
    tokens = [t.lower() for t in compound_tokens_of(text)]
    if len(tokens) > most_tokens:
        raise QueryTooLarge("tokens")

    def labelled(i: int, labels: frozenset[str], word: str) -> bool:
        return (i > 0 and tokens[i - 1] in labels) or (i > 1 and tokens[i - 2] == word and tokens[i - 1] == "id")

    ids = set()
    for i, t in enumerate(tokens):
        if re.match(UUID, t):
            ids.add(("uuid", t))
        elif re.fullmatch(r"e(?!0000)\d{4}", t):
            ids.add(("compiler_code", t))
        elif labelled(i, TRACE_LABELS, "trace") and re.fullmatch(r"(?=.*[1-9a-f])[0-9a-f]{32}", t):
            ids.add(("trace_id", t))
        elif labelled(i, SPAN_LABELS, "span") and re.fullmatch(r"(?=.*[1-9a-f])[0-9a-f]{16}", t):
            ids.add(("span_id", t))
    known = {t for _, t in ids}
    terms = sorted({t for t in tokens if len(t) >= 2 and t not in known and t not in QUERY_STOP_WORDS and t not in TRACE_LABELS | SPAN_LABELS})
    if len(terms) > most_terms or len(ids) > most_identifiers:
        raise QueryTooLarge("terms or identifiers")
    return Question(tuple(terms), tuple(sorted(ids, key=lambda x: (x[1], x[0]))))


def question_lane(rows: DataFrame, block: str, text: str, question: Question) -> DataFrame:
    """Blocks that hold a term or identifier of the question as a whole token: block, facet_id, kind, tf, and mandatory for identifiers."""
    wanted = [("term", t) for t in question.terms] + [("identifier", t) for _, t in question.identifiers]
    toks = settled(rows.where(F.col(text).isNotNull()), [block], [compound_tokens(ascii_lower(F.col(text))).alias("_ll_t")])

    def times(word: str) -> Column:
        return F.size(F.filter("_ll_t", lambda t: t == word))

    made = F.array(*[F.struct(F.concat(F.lit(f"{k}:"), F.lit(w)).alias("facet_id"), F.lit(k).alias("kind"), times(w).alias("tf")) for k, w in wanted]) if wanted else F.array().cast("array<struct<facet_id:string,kind:string,tf:int>>")
    hits = settled(toks, [block], [made.alias("h")]).select(block, F.inline(F.filter("h", lambda x: x["tf"] > 0)))
    return hits.withColumn("mandatory", F.col("kind") == "identifier")
