"""A run of provider pages taken as a whole: repetitions, conflicts, order and caps over all its pages.

A run reads pages one after the other and stops at the first thing that is
wrong or too much. Here each rule finds the first place at which it would stop
the run, all at once over the pages' records; the earliest place counts, and
what stands before it is what the run acquired. So a run of any length is a few
aggregates, and only running sums over pages are in order.

Rules, in the order in which they're asked at one place: ``missing_identity``
(an empty id), ``integrity_conflict`` (an id that came before with other bytes; it stops
at the record), ``record_too_large``, ``record_cap``, ``byte_cap``. At a page's
begin: ``page_cap``, ``pagination_incomplete`` (its token was empty or used before) and
``order_regressed`` (its first record lies before the last one of the pages before it).

Cases: exact repetitions count once, where they come first. A page without
records is a page. An empty run is finished.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loglattice.operators.prefix import running_sums
from loglattice.session import cut

#: Where a provider's page names the token of the next one.
NEXT = {"cloudwatch": "$.nextToken", "sentry": "$.next", "datadog": "$.meta.page.after", "kubernetes": "$.continue"}


@dataclass(frozen=True)
class Caps:
    pages: int = 256
    records: int = 1_000_000
    bytes: int = 1 << 30
    record_bytes: int = 8 << 20


@dataclass(frozen=True)
class Outcome:
    """``finished``, or the rule that stopped the run with its page and position (-1: before the page's first record)."""

    outcome: str
    page_no: int | None
    position: int | None
    pages: int
    records: int
    n_bytes: int


def acquire(records: DataFrame, pages: DataFrame, caps: Caps = Caps()) -> tuple[DataFrame, Outcome]:
    """records: page_no (from 0), position, native_id, ts_ms, raw, stream; pages: page_no and the ``token`` that led to it (null for the first).

    Gives the acquired records, each page's in (time, id) order by ``sequence`` within its stream, and the outcome.
    """
    at = F.struct("page_no", "position")
    sized = records.select("page_no", "position", "native_id", "ts_ms", "stream", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2(F.col("raw").cast("binary"), 256).alias("digest"))
    firsts = sized.groupBy("stream", "native_id").agg(F.min(F.struct("page_no", "position", "digest")).alias("f"))
    known = sized.join(firsts, ["stream", "native_id"]).withColumns({"again": F.struct("page_no", "position") > F.struct("f.page_no", "f.position"), "other": F.col("digest") != F.col("f.digest")}).drop("f", "digest")
    once = cut(known.where("not again or other"))  # narrow: no bytes of records
    summed = running_sums(once.where("not other").withColumns({"one": F.lit(1).cast("long"), "run": F.lit(0)}), ["run"], "page_no", ["position"], {"before": "one", "bytes_before": "n_bytes"})

    def first(rows: DataFrame, wrong: Column, rule: str, order: int) -> DataFrame:
        return rows.where(wrong).agg(F.min(at).alias("at")).where("at is not null").select("at.page_no", "at.position", F.lit(order).alias("turn"), F.lit(rule).alias("rule"))

    inside = Window.orderBy("page_no")  # one row per page, at most ``caps.pages`` and one count
    few = pages.where(F.col("page_no") <= caps.pages).withColumn("position", F.lit(-1))
    used = few.withColumn("seen", F.row_number().over(Window.partitionBy("token").orderBy("page_no")))
    spans = once.where((F.col("page_no") <= caps.pages) & ~F.col("other")).groupBy("page_no").agg(F.min(F.struct("ts_ms", "native_id")).alias("low"), F.max(F.struct("ts_ms", "native_id")).alias("high"))
    ordered = spans.withColumn("before", F.max("high").over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn("position", F.lit(-1))
    rules = [
        first(few, F.col("page_no") >= caps.pages, "page_cap", 0),
        first(used, F.col("token").isNotNull() & ((F.col("token") == "") | (F.col("seen") > 1)), "pagination_incomplete", 1),
        first(ordered, F.col("low") < F.col("before"), "order_regressed", 2),
        first(once, F.col("native_id").isNull() | (F.col("native_id") == ""), "missing_identity", 3),
        first(once, F.col("other"), "integrity_conflict", 4),
        first(once, F.col("n_bytes") > caps.record_bytes, "record_too_large", 5),
        first(summed, F.col("before") >= caps.records, "record_cap", 6),
        first(summed, F.col("bytes_before") + F.col("n_bytes") > caps.bytes, "byte_cap", 7),
    ]
    found = rules[0]
    for r in rules[1:]:
        found = found.unionByName(r)
    stop = found.orderBy("page_no", "position", "turn").first()
    kept = once.where("not other")
    read = pages
    if stop is not None:
        end = F.struct(F.lit(stop["page_no"]).alias("page_no"), F.lit(stop["position"]).alias("position"))
        kept = kept.where(F.struct("page_no", "position") < end)
        read = pages.where(F.col("page_no") < stop["page_no"] + (stop["position"] >= 0))
    n, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    outcome = Outcome(stop["rule"] if stop else "finished", stop and stop["page_no"], stop and stop["position"], read.count(), n, size)
    lanes = running_sums(kept.select("page_no", "position", "stream", "ts_ms", "native_id", F.lit(1).cast("long").alias("one")), ["stream"], "page_no", ["ts_ms", "native_id"], {"sequence": "one"})
    return records.join(lanes.select("page_no", "position", "sequence"), ["page_no", "position"]), outcome


def page_index(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """page, page_no (in file name order) and the ``token`` that led to it, of recorded pages; a first page has none."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("page"), F.get_json_object(F.col("content").cast("string"), NEXT[provider]).alias("next"))
    order = Window.orderBy("page")  # one row per page
    return named.select("page", (F.row_number().over(order) - 1).cast("int").alias("page_no"), F.lag("next").over(order).alias("token"))


def recorded_run(spark: SparkSession, path: str, provider: str, caps: Caps = Caps(), streams: Sequence[str] | None = None, contains: str | None = None) -> tuple[DataFrame, Outcome]:
    """A run over recorded pages, of some streams and of records that hold a text only, if asked; the data source must be registered."""
    pages = cut(page_index(spark, path, provider))
    records = spark.read.format("recorded_pages").option("provider", provider).load(path)
    if streams is not None:
        records = records.where(F.col("stream").isin(list(streams)))
    if contains is not None:
        records = records.where(F.col("raw").contains(contains))
    return acquire(records.join(F.broadcast(pages.select("page", "page_no")), "page").drop("page"), pages.select("page_no", "token"), caps)  # one row per page
