"""A stored index of a corpus: template groups, terms, service edges and a summary, kept up to date by batch.

Below ``path`` are ``records``, ``members``, ``terms`` and ``evidence``, to
which a batch adds a folder ``v=<n>``; ``groups``, ``edges`` and ``summary``,
which a batch merges into a new version; and ``_committed/<n>``. A batch counts
once its commit file exists, so that a search sees all of it or nothing; one
that failed midway is written anew, and one that is delivered again changes
nothing. Searches read what they ask for: terms are partitioned by a hash of
the term and sorted, and neither records nor fingerprints are parsed again.

Groups get their ids in order of arrival, within a batch by (first time, first
id, service, role, fingerprint), and keep them. Members of a group are found by
a digest of (service, role, fingerprint), never by the texts; the planner
splits a group that holds very many of them.

Cases: a record that comes again with the same time and bytes is left out; one
with other time or bytes is a conflict, and nothing of its batch is taken in.
Rows with a null id are refused. An empty batch commits and changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loglattice.functions import records as fn
from loglattice.operators import corpus
from loglattice.operators.prefix import dense_ids
from loglattice.session import created_alone, cut, listed, removed

TERM_PARTS = 64
KEY = ["service", "role", "fingerprint"]
GROUP = ["group_id", *KEY, "repeat_count", "first_timestamp_millis", "first_native_id", "last_timestamp_millis", "last_native_id"]


class Conflict(RuntimeError):
    """A record arrived again with another time or other bytes."""


def group_key() -> Column:
    return F.unhex(F.sha2(F.concat_ws("\x1f", *KEY), 256))


def flat_groups(members: DataFrame) -> DataFrame:
    """Template groups without ids, as they are merged over batches."""
    at = F.struct(F.col("ts_ms").alias("t"), F.col("native_id").alias("i"))
    g = members.groupBy(*KEY).agg(F.count(F.lit(1)).alias("repeat_count"), F.min(at).alias("f"), F.max(at).alias("l"))
    return g.select(
        *KEY, "repeat_count",
        F.col("f.t").alias("first_timestamp_millis"), F.col("f.i").alias("first_native_id"), F.col("l.t").alias("last_timestamp_millis"), F.col("l.i").alias("last_native_id"),
    )


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    first, last = F.struct("first_timestamp_millis", "first_native_id"), F.struct("last_timestamp_millis", "last_native_id")
    both = old.unionByName(new).groupBy("source_service", "target_service").agg(F.sum("evidence_count").alias("evidence_count"), F.min(first).alias("f"), F.max(last).alias("l"))
    return both.select("source_service", "target_service", "evidence_count", "f.*", "l.*")


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- versions ---

    def committed(self) -> list[int]:
        return sorted(int(n) for n in listed(self.spark, f"{self.path}/_committed") if n.isdigit())

    def generation(self) -> int:
        """The last version; what a search saw is current as long as it is this one."""
        return (self.committed() or [-1])[-1]

    def _added(self, what: str, upto: int | None, schema: str | None = None) -> DataFrame:
        """An appended table as of a version; at least one version must exist."""
        done = [v for v in self.committed() if upto is None or v <= upto]
        reader = self.spark.read.schema(f"{schema}, v int") if schema else self.spark.read
        return reader.option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/v={v}" for v in done]).drop("v")

    def _merged(self, what: str, version: int | None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{what}/v={self.generation() if version is None else version}")

    def records(self, version: int | None = None) -> DataFrame:
        """native_id, ts_ms, raw, digest."""
        return self._added("records", version)

    def members(self, version: int | None = None) -> DataFrame:
        """native_id, ts_ms, ts_seconds, service, role, peer, group_key."""
        return self._added("members", version)

    def terms(self, version: int | None = None) -> DataFrame:
        """group_id, term, part."""
        return self._added("terms", version, "group_id long, term string, part int")

    def evidence(self, version: int | None = None) -> DataFrame:
        return self._added("evidence", version)

    def groups(self, version: int | None = None) -> DataFrame:
        return self._merged("groups", version).select(*GROUP)

    def edges(self, version: int | None = None) -> DataFrame:
        return self._merged("edges", version)

    def summary(self, version: int | None = None) -> DataFrame:
        return self._merged("summary", version)

    def group_members(self) -> DataFrame:
        """native_id -> group_id."""
        keys = self._merged("groups", None).select("group_key", "group_id")
        return self.members().select("native_id", "group_key").join(keys, "group_key").select("native_id", "group_id")

    # --- taking in ---

    def _fresh(self, batch: DataFrame, done: Sequence[int]) -> DataFrame:
        """The batch's records that aren't stored yet, each once."""
        marked = batch.select("native_id", "ts_ms", "raw", F.sha2(F.col("raw").cast("binary"), 256).alias("digest"))
        seen = marked.groupBy("native_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts_ms", "digest")).alias("a"), F.max(F.struct("ts_ms", "digest")).alias("b"))
        if done:
            stored = self.records().select("native_id", F.struct("ts_ms", "digest").alias("old"))
            seen = seen.join(stored, "native_id", "left")
        else:
            seen = seen.withColumn("old", F.lit(None).cast("struct<ts_ms:bigint,digest:string>"))
        seen = cut(seen.select("native_id", "n", F.col("old").isNotNull().alias("known"), (F.col("native_id").isNull() | (F.col("a") != F.col("b")) | F.coalesce(F.col("old") != F.col("a"), F.lit(False))).alias("wrong")))
        wrong, again, known = seen.agg(F.count_if("wrong"), F.count_if(F.col("n") > 1), F.count_if("known")).first()
        if wrong:
            raise Conflict(f"{wrong} ids stand for more than one record")
        if known:
            marked = marked.join(seen.where("known").select("native_id"), "native_id", "left_anti")
        return marked.dropDuplicates(["native_id"]) if again else marked

    def add(self, batch: DataFrame, number: int) -> None:
        """Takes in records (native_id, ts_ms, raw) as version ``number``, which must be above those before."""
        done = self.committed()
        if number in done:
            return
        last = done[-1] if done else None

        def store(df: DataFrame, what: str, *parts: str) -> DataFrame:
            folder = f"{self.path}/{what}/v={number}"
            df.write.mode("overwrite").partitionBy(*parts).parquet(folder)
            return self.spark.read.schema(df.schema).parquet(folder)

        kept = store(self._fresh(batch, done), "records")
        parsed = fn.parse_records(kept.select("native_id", "ts_ms", F.col("raw").cast("string").alias("raw")), "raw")
        members = store(parsed.select("native_id", "ts_ms", "ts_seconds", *KEY, "peer", group_key().alias("group_key")), "members")
        new = flat_groups(members)
        edges = corpus.service_edges(store(corpus.edge_evidence(members), "evidence"))
        known = None if last is None else self.groups(last)
        if known is not None:
            edges = merge_edges(self.edges(last), edges)
            first, end = F.struct("first_timestamp_millis", "first_native_id"), F.struct("last_timestamp_millis", "last_native_id")
            both = known.unionByName(new.withColumn("group_id", F.lit(None).cast("long"))).groupBy(*KEY)
            new = both.agg(F.max("group_id").alias("group_id"), F.sum("repeat_count").alias("repeat_count"), F.min(first).alias("f"), F.max(end).alias("l")).select("group_id", *KEY, "repeat_count", "f.*", "l.*")
            new = cut(new)
            grown, fresh = new.where("group_id is not null"), new.where("group_id is null").drop("group_id")
            top = known.agg(F.max("group_id")).first()[0] or 0
        else:
            grown, fresh, top = None, new, 0
        numbered = dense_ids(fresh, "group_id", ["first_timestamp_millis", "first_native_id", *KEY]).withColumn("group_id", F.col("group_id") + F.lit(top)).select(*GROUP)
        numbered = numbered if grown is None else grown.select(*GROUP).unionByName(numbered)
        groups = store(numbered.withColumn("group_key", group_key()), "groups")
        terms = corpus.group_terms(groups.where(F.col("group_id") > top))
        store(terms.withColumn("part", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(TERM_PARTS)).cast("int")).repartition("part").sortWithinPartitions("part", "term"), "terms", "part")
        store(edges, "edges")
        store(corpus.severe_service_summary(groups), "summary")
        created_alone(self.spark, f"{self.path}/_committed/{number}", "")
        for old in done[:-1]:  # readers of the version before may go on
            for what in ("groups", "edges", "summary"):
                removed(self.spark, f"{self.path}/{what}/v={old}")

    # --- searching ---

    def holding(self, words: Sequence[str]) -> DataFrame:
        """Terms table of these words: only their parts are read, and in them only the row groups that hold them."""
        parts = sorted({zlib.crc32(w.encode()) % TERM_PARTS for w in words})
        return self.terms().where(F.col("part").isin(parts) & F.col("term").isin(list(words)))

    def lexical_candidates(self, task: str, limit: int = 256) -> DataFrame:
        return corpus.lexical_candidates(self.groups(), self.holding(fn.search_terms_of(task, corpus.QUERY_TERMS)), task, limit)

    def task_match_strength(self, task: str) -> DataFrame:
        return corpus.task_match_strength(self.holding(fn.search_terms_of(task, corpus.QUERY_TERMS)), task)

    def graph_neighbours(self, seeds: Sequence[str], limit: int = 64) -> DataFrame:
        return corpus.graph_neighbours(self.groups(), self.edges(), seeds, limit)
