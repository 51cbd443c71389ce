"""Messages delivered more than once: exactly one copy of each is kept.

Identifiers are dictionary-encoded exactly (string -> code within a shard);
what has been seen is a set of bitmaps over those codes, sharded, in buckets
of 32,768 bits, each compressed. A batch selects one arrival (the one with the
smallest row id) for each code whose bit is unset, then the batch's new codes
and bits are committed together as the store's next version. Only one writer
can create a version; one that finds its version taken reads the store again
and selects again.

The dictionary alone says nothing about what was seen: identifiers may be
registered ahead, and only a set bit keeps an arrival out.

Row ids are integers that rise in the order of delivery.

Cases: a row with a null in any identifier column is a copy of nothing and is
always kept. Empty strings are ordinary identifiers. Rows of one row id are one
delivery. A row without a row id is no delivery: it is never reported, and is
kept only where its identifier comes in no other way. An empty batch keeps
nothing. Extra columns are ignored unless they're asked for; the columns the
operator adds begin with ``_ll_``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loglattice.session import created_alone, listed, partitions_of, read_text, removed, work_folder

BITS = 32_768  # bits of one bucket: Spark's bitmap functions fix it
MOST_DICTIONARIES = 8  # from which a store puts them together
MOST_TRIES = 20
PACKING = "zstd"  # how bitmaps are compressed
CODED = "_ll_space long, _ll_shard int, _ll_code long, _ll_row long"
PACKED = "_ll_space long, _ll_shard int, _ll_bucket long, _ll_bits binary"
BATCHES = 3  # in which a whole table is taken in


def _present(ids: Sequence[str]) -> Column:
    ok = F.col(ids[0]).isNotNull()
    for c in ids[1:]:
        ok = ok & F.col(c).isNotNull()
    return ok


def first_copies(rows: DataFrame, ids: Sequence[str], row_id: str, carry: Sequence[str]) -> DataFrame:
    """One row per identifier, the one with the smallest row id, with its ``carry`` columns.

    Rows with a null identifier are each kept. One shuffle of the carried
    columns with map-side combine: an identifier that holds a third of all
    rows sends one row per map task.
    """
    own = F.when(~_present(ids), F.col(row_id))
    first = F.min(F.struct(F.col(row_id).isNull().alias("_ll_none"), F.col(row_id), *[F.col(c) for c in carry])).alias("_ll_first")
    return (
        rows.select(*[F.col(c).alias(f"_ll_id{i}") for i, c in enumerate(ids)], own.alias("_ll_own"), row_id, *[c for c in carry if c != row_id])
        .groupBy(*[f"_ll_id{i}" for i in range(len(ids))], "_ll_own")
        .agg(first)
        .select(*[F.col(f"_ll_id{i}").alias(c) for i, c in enumerate(ids) if c not in carry], F.col(f"_ll_first.{row_id}"), *[F.col(f"_ll_first.{c}").alias(c) for c in carry])
    )


def _bit(bits: Column, position: Column) -> Column:
    """Whether a bit of a bitmap_construct_agg bitmap is set: byte position div 8, lowest bit first."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) > 0


class Contended(RuntimeError):
    """Other writers were first, again and again; nothing of this batch is committed."""


@dataclass
class _State:
    """The store as of one version: parts of the dictionary, of the bitmaps, and each batch's part."""

    version: int = 0
    buckets: int = 0
    ids: list[str] = field(default_factory=list)
    bits: list[str] = field(default_factory=list)
    batches: dict[str, str] = field(default_factory=dict)


class SeenStore:
    """What has been delivered so far: dictionary and seen-bitmaps, in numbered versions.

    Layout below ``path``: parts ``ids/<part>``, ``bits/<part>`` and
    ``kept/<part>``, written under names of their own, and ``commits/<number>``,
    each naming the live parts. Parts no commit names don't count. The
    dictionary is bucketed by identifier, so that a batch meets it without
    moving it; no identifier stands in two parts.
    """

    def __init__(self, spark: SparkSession, path: str, ids: Sequence[str], buckets: int | None = None):
        self.spark, self.path, self.ids = spark, path.rstrip("/"), list(ids)
        self.names = [f"_ll_id{i}" for i in range(len(self.ids))]
        self.buckets = buckets or partitions_of(spark)
        self._seen_commits: dict[str, dict] = {}

    # --- versions ---

    def state(self) -> _State:
        names = [n for n in listed(self.spark, f"{self.path}/commits") if not n.startswith(".")]
        out = _State(buckets=self.buckets)
        for name in names:
            if name not in self._seen_commits:  # commits never change
                self._seen_commits[name] = json.loads(read_text(self.spark, f"{self.path}/commits/{name}"))
            said = self._seen_commits[name]
            out.version, out.buckets, out.ids, out.bits = int(name), said["buckets"], said["ids"], said["bits"]
            out.batches |= said["batches"]
        return out

    def committed(self) -> list[str]:
        """Names of the batches taken in."""
        return sorted(self.state().batches)

    def _commit(self, number: int, state: _State, batches: dict[str, str]) -> bool:
        said = {"buckets": state.buckets, "ids": state.ids, "bits": state.bits, "batches": batches}
        return created_alone(self.spark, f"{self.path}/commits/{number:012d}", json.dumps(said))

    def _discard(self, part: str) -> None:
        for what in ("ids", "bits", "kept"):
            removed(self.spark, f"{self.path}/{what}/{part}")

    # --- dictionary ---

    def _bucketed(self, rows: DataFrame, part: str, buckets: int) -> None:
        name = f"ll_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(buckets, *self.names).option("path", f"{self.path}/ids/{part}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def _dictionary(self, part: str, buckets: int) -> DataFrame:
        """A part's identifiers with their codes, known to the planner as bucketed."""
        name = f"ll_{part}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{n} STRING" for n in self.names) + ", _ll_row BIGINT, _ll_space BIGINT, _ll_shard INT, _ll_code BIGINT, _ll_known BOOLEAN"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(self.names)}) INTO {buckets} BUCKETS LOCATION '{self.path}/ids/{part}'")
        return self.spark.table(name).where("not _ll_known").select(*self.names, "_ll_space", "_ll_shard", "_ll_code")

    def _arrivals(self, rows: DataFrame, row_id: str) -> DataFrame:
        """One row per identifier of a batch, with its smallest row id; an identifier that holds a third of all rows sends one row per map task."""
        return (
            rows.where(_present(self.ids) & F.col(row_id).isNotNull())
            .select(*[F.col(c).cast("string").alias(n) for c, n in zip(self.ids, self.names)], F.col(row_id).cast("long").alias("_ll_row"))
            .groupBy(*self.names)
            .agg(F.min("_ll_row").alias("_ll_row"))
        )

    def _encode(self, arrivals: DataFrame, number: int, state: _State, part: str) -> None:
        """Writes the arrivals with their codes; new identifiers are numbered within their task (shard) of this version (space)."""
        code = ["_ll_space", "_ll_shard", "_ll_code"]
        coded = arrivals.withColumn("_ll_old", F.lit(None).cast("struct<_ll_space:bigint,_ll_shard:int,_ll_code:bigint>"))
        for older in state.ids:
            entries = self._dictionary(older, state.buckets).select(*self.names, F.struct(*code).alias("_ll_entry"))
            coded = coded.join(entries, self.names, "left").withColumn("_ll_old", F.coalesce("_ll_old", "_ll_entry")).drop("_ll_entry")
        new = F.struct(F.lit(number).cast("long").alias("_ll_space"), F.spark_partition_id().alias("_ll_shard"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_ll_code"))
        known = F.col("_ll_old").isNotNull()
        chosen = coded.select(*self.names, "_ll_row", F.coalesce("_ll_old", new).alias("_ll_c"), known.alias("_ll_known"))
        self._bucketed(chosen.select(*self.names, "_ll_row", *[F.col(f"_ll_c.{c}").alias(c) for c in code], "_ll_known"), part, state.buckets)

    def register(self, rows: DataFrame) -> None:
        """Gives identifiers their codes ahead of any arrival; they aren't seen by that."""
        for _ in range(MOST_TRIES):
            state, part = self.state(), uuid.uuid4().hex
            self._encode(self._arrivals(rows.withColumn("_ll_any", F.lit(0)), "_ll_any"), state.version + 1, state, part)
            if self._commit(state.version + 1, _State(0, state.buckets, [*state.ids, part], state.bits), {}):
                return
            self._discard(part)
        raise Contended

    # --- bitmaps ---

    def seen_bits(self, parts: Sequence[str] | None = None) -> DataFrame:
        """Union of the committed bitmaps: _ll_space, _ll_shard, _ll_bucket, _ll_bits."""
        parts = self.state().bits if parts is None else parts
        key = ["_ll_space", "_ll_shard", "_ll_bucket"]
        stored = self.spark.read.schema(PACKED).parquet(*[f"{self.path}/bits/{p}" for p in parts])
        return stored.groupBy(*key).agg(F.bitmap_or_agg("_ll_bits").alias("_ll_bits"))

    def _unseen(self, coded: DataFrame, bits: Sequence[str]) -> DataFrame:
        """Arrivals whose bit is unset."""
        if not bits:
            return coded
        marked = coded.withColumn("_ll_bucket", F.expr(f"_ll_code div {BITS}")).join(self.seen_bits(bits), ["_ll_space", "_ll_shard", "_ll_bucket"], "left")
        return marked.where(~F.coalesce(_bit(F.col("_ll_bits"), F.col("_ll_code") % BITS), F.lit(False))).select(*coded.columns)

    def _attempt(self, rows: DataFrame, row_id: str, number: int, state: _State, part: str) -> None:
        """Writes what version ``number`` would add, without committing it."""
        self._encode(self._arrivals(rows, row_id), number, state, part)
        coded = self.spark.read.schema(CODED).parquet(f"{self.path}/ids/{part}")
        self._unseen(coded, state.bits).write.parquet(f"{self.path}/kept/{part}")
        kept = self.spark.read.schema(CODED).parquet(f"{self.path}/kept/{part}")
        bits = kept.groupBy("_ll_space", "_ll_shard", F.expr(f"_ll_code div {BITS}").alias("_ll_bucket")).agg(F.bitmap_construct_agg(F.col("_ll_code") % BITS).alias("_ll_bits"))
        bits.write.option("compression", PACKING).parquet(f"{self.path}/bits/{part}")

    def apply(self, rows: DataFrame, row_id: str, batch: str) -> DataFrame:
        """Takes in a batch and gives the row ids it keeps of rows with an identifier, as ``row_id``.

        Applying a committed batch again gives the same answer and changes nothing.
        """
        for _ in range(MOST_TRIES):
            state = self.state()
            if batch in state.batches:
                kept = self.spark.read.schema(CODED).parquet(f"{self.path}/kept/{state.batches[batch]}")
                return kept.select(F.col("_ll_row").alias(row_id))
            part, number = uuid.uuid4().hex, state.version + 1
            self._attempt(rows, row_id, number, state, part)
            if not self._commit(number, _State(0, state.buckets, [*state.ids, part], [*state.bits, part]), {batch: part}):
                self._discard(part)
            elif len(state.ids) + 1 >= MOST_DICTIONARIES:
                self.compact()
        raise Contended(batch)

    def compact(self) -> bool:
        """Puts the parts of dictionary and bitmaps together, as a version of its own; False if another writer was first.

        Old parts stay readable for those who began before.
        """
        state = self.state()
        if len(state.ids) < 2 and len(state.bits) < 2:
            return True
        part = uuid.uuid4().hex
        whole: DataFrame | None = None
        for p in state.ids:
            d = self._dictionary(p, state.buckets)
            whole = d if whole is None else whole.unionByName(d)
        rows = whole.select(*self.names, F.lit(None).cast("long").alias("_ll_row"), "_ll_space", "_ll_shard", "_ll_code", F.lit(False).alias("_ll_known"))
        self._bucketed(rows.repartition(state.buckets, *self.names), part, state.buckets)
        self.seen_bits(state.bits).write.option("compression", PACKING).parquet(f"{self.path}/bits/{part}")
        if self._commit(state.version + 1, _State(0, state.buckets, [part], [part]), {}):
            return True
        self._discard(part)
        return False


def in_batches(rows: DataFrame, row_id: str, batches: int) -> list[DataFrame]:
    """The rows in order of delivery, cut into ranges of row ids; each range reads its own part of the files."""
    low, high = rows.agg(F.min(row_id), F.max(row_id)).first()
    if low is None:
        return []
    edges = [low + (high - low + 1) * i // batches for i in range(batches + 1)]
    return [rows.where((F.col(row_id) >= a) & (F.col(row_id) < b)) for a, b in zip(edges, edges[1:]) if a < b]


def repeated_deliveries(rows: DataFrame, ids: Sequence[str], row_id: str, store: SeenStore | None = None, batches: int = BATCHES) -> DataFrame:
    """Row ids of the deliveries that are not kept, as ``row_id``.

    The rows go through the store in ``batches``, in order of delivery; without
    a store through a new one in the shared folder. The anti-join is on the unique
    row id, never on the identifier, so an identifier with very many copies
    skews nothing.
    """
    store = store or SeenStore(rows.sparkSession, work_folder(rows.sparkSession, "seen"), ids)
    present = rows.where(_present(ids) & F.col(row_id).isNotNull())
    kept: DataFrame | None = None
    for i, part in enumerate(in_batches(present, row_id, batches)):
        took = store.apply(part, row_id, f"{i}")
        kept = took if kept is None else kept.unionByName(took)
    mine = present.select(F.col(row_id).cast("long").alias(row_id))
    return mine.join(kept, row_id, "left_anti") if kept is not None else mine
