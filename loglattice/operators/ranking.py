"""Lexical rankers in fixed-point arithmetic, rank fusion, and evaluation of rankings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loglattice.functions.records import ascii_lower, settled
from loglattice.operators.prefix import dense_ids, order_statistics
from loglattice.session import partitions_of

SCALE = 1_000_000
BODY_B, ID_B, K1 = 750_000, 250_000, 1_200_000
BODY_WEIGHT, ID_WEIGHT = 1_000_000, 2_000_000
MOST_TOKEN = 64
# Words a query may contain that say nothing.
QUERY_STOP_WORDS = frozenset("a an the is are was were what which who why how did does do to of for in on at by with from around cause caused".split())
FIELD_TOKEN = "[A-Za-z0-9_.-]+"
FEATURE_TOKEN = "[A-Za-z0-9_./:-]+"


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def div(a: Column, b: Column) -> Column:
    """Integral quotient of non-negative numbers."""
    return F.call_function("div", _big(a), _big(b))


def field_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(ascii_lower(text), F.lit(f"({FIELD_TOKEN})")), lambda t: F.length(t) <= MOST_TOKEN)


def query_tokens(query: str) -> list[str]:
    return sorted({t.lower() for t in re.findall(FIELD_TOKEN, query) if len(t) <= MOST_TOKEN})


def _is_identifier(token: str) -> bool:
    return any(c.isdigit() or c in "_-." for c in token)


def term_counts(docs: DataFrame, doc: str, text: str, terms: Sequence[str]) -> DataFrame:
    """doc, n_tokens, n_identifiers and ``tf`` (occurrences of each term, in the terms' order); one pass, no shuffle, no explode."""
    tokens = F.col("_ll_t")
    counted = settled(docs.where(F.col(text).isNotNull()), [doc], [field_tokens(F.col(text)).alias("_ll_t")])
    def occurrences(term: str) -> Column:
        return F.size(F.filter(tokens, lambda t: t == term))

    tf = F.array(*map(occurrences, terms)) if terms else F.array().cast("array<int>")
    ids = F.size(F.filter(tokens, lambda t: t.rlike("[0-9_.-]")))
    return settled(counted, [doc], [F.size(tokens).cast("long").alias("n_tokens"), ids.cast("long").alias("n_identifiers"), tf.alias("tf")])


def corpus_stats(counts: DataFrame, terms: Sequence[str]) -> dict:
    """Document count, field totals and document frequencies: one small row."""
    row = counts.agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.sum("n_identifiers").alias("ids"), *[F.count(F.when(F.col("tf")[i] > 0, 1)).alias(f"df_{i}") for i in range(len(terms))]
    ).first()
    return {"n": row["n"], "tokens": row["tokens"] or 0, "ids": row["ids"] or 0, "df": [row[f"df_{i}"] for i in range(len(terms))]}


def rarity_weight(n: int, df: int) -> int:
    return SCALE * (n - df + 1) // (n + 1)


def bm25_affinities(docs: DataFrame, doc: str, text: str, query: str) -> DataFrame:
    """Per document and term it holds: tf, affinity (fixed point) and the term's rarity weight."""
    terms = query_tokens(query)
    counts = term_counts(docs, doc, text, terms)
    stats = corpus_stats(counts, terms)
    hits = counts.select(doc, "n_tokens", F.posexplode("tf").alias("i", "f")).where("f > 0")
    base = _big(F.lit(10 * stats["tokens"])) * F.col("f")
    affinity = div(base * SCALE, base + 3 * stats["tokens"] + _big(F.col("n_tokens")) * 9 * stats["n"])
    weights = F.array(*[F.lit(rarity_weight(stats["n"], df)) for df in stats["df"]])
    return hits.select(doc, F.array(*map(F.lit, terms))[F.col("i")].alias("term"), F.col("f").cast("long").alias("tf"), affinity.cast("long").alias("affinity"), weights[F.col("i")].cast("long").alias("weight"))


def _weighted(tf: Column, length: Column, total: int, n: int, b: int, weight: int) -> Column:
    share = div(_big(length) * b * n, F.lit(total)) if total else F.lit(0)
    return F.when(tf > 0, div(_big(tf) * weight * SCALE, F.lit(SCALE - b) + share)).otherwise(F.lit(0).cast("decimal(38,0)"))


def bm25f_scores(docs: DataFrame, doc: str, text: str, query: str) -> DataFrame:
    """Body and identifier fields; an identifier token counts in both. doc, score, matched."""
    terms = query_tokens(query)
    counts = term_counts(docs, doc, text, terms)
    s = corpus_stats(counts, terms)
    score, matched = F.lit(0).cast("decimal(38,0)"), F.lit(0)
    for i, term in enumerate(terms):
        tf = F.col("tf")[i]
        w = _weighted(tf, F.col("n_tokens"), s["tokens"], s["n"], BODY_B, BODY_WEIGHT)
        if _is_identifier(term):
            w = w + _weighted(tf, F.col("n_identifiers"), s["ids"], s["n"], ID_B, ID_WEIGHT)
        idf = SCALE + (s["n"] - s["df"][i]) * SCALE // (s["df"][i] + 1)
        part = div(_big(div(w * (K1 + SCALE), w + K1)) * idf, F.lit(SCALE))
        score = (score + F.when(tf > 0, part).otherwise(0)).cast("decimal(38,0)")
        matched = matched + F.when(tf > 0, 1).otherwise(0)
    return settled(counts, [doc], [score.cast("long").alias("score"), matched.cast("long").alias("matched")]).where("score > 0")


def feature_terms(query: str) -> list[tuple[str, bool]]:
    """Lower-case query terms and whether each looks like an identifier, in order of first use."""
    out: dict[str, bool] = {}
    for raw in re.findall(FEATURE_TOKEN, query):
        letters = [c for c in raw if c.isalpha()]
        identifier = any(c.isdigit() or c in "_-./:" for c in raw) or (len(raw) >= 2 and bool(letters) and all(c.isupper() for c in letters))
        low = raw.lower()
        if low not in QUERY_STOP_WORDS and (len(low) >= 3 or identifier):
            out.setdefault(low, identifier)
    return list(out.items())


def query_features(docs: DataFrame, doc: str, text: str, query: str) -> DataFrame:
    """doc and the features by which a plain search ranks: full_match, identifier_exact, exact, matched, specificity (all descending)."""
    terms = feature_terms(query)
    low = ascii_lower(F.col(text))
    base = settled(docs.where(F.col(text).isNotNull()), [doc], [low.alias("_ll_low"), F.array_distinct(F.regexp_extract_all(low, F.lit(f"({FEATURE_TOKEN})"))).alias("_ll_t")])
    made = [
        F.col("_ll_low").contains(query.strip().lower()).alias("full_match") if query.strip() else F.lit(False).alias("full_match"),
        F.array(*[F.array_contains("_ll_t", t) for t, _ in terms]).alias("e"),
        F.array(*[F.col("_ll_low").contains(t) for t, _ in terms]).alias("m"),
    ]
    flags = settled(base, [doc], made)
    stats = flags.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("m")[i], 1)).alias(f"df_{i}") for i in range(len(terms))]).first()
    add = lambda items: sum(items, F.lit(0)).cast("long")
    one = lambda c: F.when(c, 1).otherwise(0)
    scored = flags.select(
        doc,
        "full_match",
        add(one(F.col("e")[i]) for i, (_, ident) in enumerate(terms) if ident).alias("identifier_exact"),
        add(one(F.col("e")[i]) for i in range(len(terms))).alias("exact"),
        add(one(F.col("m")[i]) for i in range(len(terms))).alias("matched"),
        add(F.when(F.col("m")[i], len(t) * max(1, stats["n"] + 1 - stats[f"df_{i}"])).otherwise(0) for i, (t, _) in enumerate(terms)).alias("specificity"),
    )
    return scored.where("full_match or matched > 0")


def full_ranks(rows: DataFrame, doc: str, order: Sequence[str]) -> DataFrame:
    """doc and its ``rank`` from 1 among all rows, by ``order`` (columns, all descending), then by doc (unique)."""
    return dense_ids(rows.select(doc, *order), "rank", [*[F.desc(c) for c in order], F.asc(doc)]).select(doc, "rank")


def reciprocal_ranks(lists: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Fused score of several ranked lists (``rank`` from 1): sum of scale div (k + rank)."""
    parts = [x.select(key, div(F.lit(SCALE), F.col("rank") + k).cast("long").alias("part")) for x in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.sum("part").alias("score"))


# --- evaluation ---


def recall(cases: DataFrame, selected: DataFrame) -> DataFrame:
    """Per case: required ids found. cases: case_id, required (array); selected: case_id, id."""
    got = selected.groupBy("case_id").agg(F.collect_set("id").alias("got"))
    both = cases.join(got, "case_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<bigint>")))
    found = F.size(F.array_intersect("required", "got"))
    n = F.size(F.array_distinct("required"))
    return both.select("case_id", n.cast("long").alias("n_required"), found.cast("long").alias("n_found"), (found == n).alias("complete"))


def weighted_requirements(requirements: DataFrame, selected: DataFrame) -> DataFrame:
    """Weighted recall per case. requirements: case_id, weight, alternatives (array of arrays): met if every id of some alternative was selected."""
    got = selected.groupBy("case_id").agg(F.collect_set("id").alias("got"))
    both = requirements.join(got, "case_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<bigint>")))
    met = F.exists("alternatives", lambda a: F.forall(a, lambda i: F.array_contains("got", i)))
    return both.groupBy("case_id").agg(F.sum("weight").alias("total_weight"), F.sum(F.when(met, F.col("weight")).otherwise(0.0)).alias("met_weight")).withColumn("weighted_recall", F.try_divide("met_weight", "total_weight"))


def paired_outcomes(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of cases both arms, only one, or neither passed. runs: case_id, arm, passed; one row per case and arm."""
    per = runs.where(F.col("arm").isin(a, b)).groupBy("case_id").agg(F.max(F.when(F.col("arm") == a, F.col("passed").cast("int"))).alias("a"), F.max(F.when(F.col("arm") == b, F.col("passed").cast("int"))).alias("b"))
    n = lambda x, y: F.count(F.when((F.col("a") == x) & (F.col("b") == y), 1))
    return per.where("a is not null and b is not null").agg(n(1, 1).alias("both"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither"))


def nearest_rank(values: DataFrame, key: str, value: str, percent: int = 95) -> DataFrame:
    """Exact nearest-rank percentile per key: the value of rank ceil(percent * n / 100)."""
    at = {"hit": lambda n: F.ceil(n * percent / 100) - 1}
    return order_statistics(values, [key], value, value, at).select(key, F.col("hit.value").alias(f"p{percent}"))


def binomial_tail(wins: int, losses: int) -> float:
    """One-sided exact probability of at least so many wins among the untied pairs."""
    n = wins + losses
    return sum(math.comb(n, k) for k in range(wins, n + 1)) / 2**n if n else 1.0


def _local_skyline(frame: pd.DataFrame, high: list[str], low: list[str]) -> pd.DataFrame:
    """Best rows first, so that a row needs comparing with those kept before it only."""
    values = np.column_stack([frame[high].to_numpy(dtype=float), -frame[low].to_numpy(dtype=float)])
    order = np.lexsort([-values[:, c] for c in reversed(range(values.shape[1]))])
    kept = np.empty_like(values)
    chosen: list[int] = []
    for i in order:
        best = kept[: len(chosen)]
        if not ((best >= values[i]).all(axis=1) & (best > values[i]).any(axis=1)).any():
            kept[len(chosen)] = values[i]
            chosen.append(i)
    return frame.iloc[sorted(chosen)]


def skyline(rows: DataFrame, high: list[str], low: list[str]) -> DataFrame:
    """Rows no other row dominates (as good everywhere, better somewhere); rows with a null in these columns take no part.

    Every task reduces its rows to its own skyline; survivors meet in an eighth
    as many tasks, and again, until one is left.
    """
    clean = rows.dropna(subset=high + low)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for f in frames:
            best = _local_skyline(f if best is None else pd.concat([best, f]), high, low)
        if best is not None:
            yield best

    local, tasks = clean.mapInPandas(run, clean.schema), partitions_of(rows.sparkSession)
    while tasks > 1:
        tasks = -(-tasks // 8)
        local = local.repartition(tasks).mapInPandas(run, clean.schema)
    return local if partitions_of(rows.sparkSession) > 1 else local.repartition(1).mapInPandas(run, clean.schema)
