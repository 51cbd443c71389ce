"""Queries of the problems for language-model training data, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglattice.llm import mixture, quality, runs, tokens
from loglattice.operators import dedup
from loglattice.plans.tables import table


def p3_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run, singles included, with its count and duration."""
    rows = table(spark, sf, "cloudwatch_messages").where("event_id is not null")
    keyed = runs.event_keys(rows, "message", ["delivery_id", "event_id", "log_stream", "event_timestamp_millis"])
    kept = dedup.first_copies(keyed, ["event_id"], "delivery_id", ["log_stream", "event_timestamp_millis", "same"])
    found = runs.collapse_runs(kept, "log_stream", "event_timestamp_millis", "event_id", "same")
    return found.select(
        F.col("entity").alias("log_stream"), F.col("first_id").alias("first_event_id"), F.col("last_id").alias("last_event_id"), "n_events", "first_ms", (F.col("last_ms") - F.col("first_ms")).alias("duration_ms")
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_runs(spark, sf).where("n_events > 1").select("log_stream", "first_event_id", "last_event_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"), "text", ["doc_id"])


def p6_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.sizes(table(spark, sf, "documents"), "text", ["doc_id"])


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mixture.shares(mixture.planned_uses(table(spark, sf, "documents"), targets), targets)


def p8_stats(spark: SparkSession, sf: str) -> DataFrame:
    common = quality.common_words(table(spark, sf, "common_words"))
    return quality.quality(table(spark, sf, "documents"), "text", ["doc_id"], common)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_stats(spark, sf).where("is_prose = false").select("doc_id")


QUERIES = {
    "p3_found": p3_found,
    "p3_runs": p3_runs,
    "p6_ids": p6_ids,
    "p6_sizes": p6_sizes,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
}
SQL: dict[str, str] = {}
