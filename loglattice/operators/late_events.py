"""Event-time windows corrected by late records.

Each window (per key) is keyed state of associative counters. A record is on
time if it arrives before its window ends, a correction if it arrives before
the window's end plus the allowed lateness, and dropped if it arrives later;
dropped records are diverted to a report, not lost. Arrival is the record's
own ingestion time.

``WindowState`` takes batches in order of arrival. Its watermark is a time of
arrival that no later batch falls short of; a window whose end plus the
allowed lateness is behind it leaves the state, so the state holds open
windows only, however long the history is. Every batch emits the windows it
changed with their new counts, to be upserted by key and period. A record that
comes behind the watermark for a window that has left (its own arrival is in
time, but its batch isn't in order) is diverted too, as ``behind``.

Cases: a record with a null key, event time or arrival time is left out (and
diverted as ``incomplete``). Times before 1970 fall into windows that begin at
or before them. An empty batch changes nothing but may move the watermark.
Records are counted as they come: remove copies first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loglattice.session import removed, work_folder
from loglattice.streaming.versions import Versions

SLOTS = 3  # batches in which arrivals of a whole table are taken in
COUNTERS = ("n_on_time", "n_corrected", "n_dropped")


@dataclass(frozen=True)
class WindowSpec:
    """key columns, event and arrival time columns (epoch milliseconds), window width and allowed lateness."""

    keys: tuple[str, ...]
    event_ms: str
    arrival_ms: str
    width_ms: int = 3_600_000
    lateness_ms: int = 6 * 3_600_000

    def start(self):
        return F.col(self.event_ms) - F.pmod(F.col(self.event_ms), F.lit(self.width_ms))

    def complete(self):
        ok = F.col(self.event_ms).isNotNull() & F.col(self.arrival_ms).isNotNull()
        for k in self.keys:
            ok = ok & F.col(k).isNotNull()
        return ok


def _classified(events: DataFrame, spec: WindowSpec) -> DataFrame:
    end = F.col("period_start_millis") + spec.width_ms
    arrival = F.col(spec.arrival_ms)
    return events.where(spec.complete()).withColumn("period_start_millis", spec.start()).withColumn(
        "_ll_class", F.when(arrival < end, "on_time").when(arrival < end + spec.lateness_ms, "corrected").otherwise("dropped")
    )


def upsert(state: DataFrame | None, deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State after merging the deltas; counters add up."""
    both = deltas if state is None else state.select(*deltas.columns).unionByName(deltas)
    return both.groupBy(*keys, "period_start_millis").agg(*[F.sum(c).alias(c) for c in COUNTERS])


class WindowState:
    """Open windows, versioned by batch, below ``path``: ``open``, with ``updates/_ll_batch=<n>`` and ``diverted/_ll_batch=<n>``."""

    def __init__(self, spark: SparkSession, path: str, spec: WindowSpec, disorder_ms: int = 0):
        """disorder_ms: how far a batch may reach back behind the greatest arrival before it."""
        self.spark, self.path, self.spec, self.disorder_ms = spark, path.rstrip("/"), spec, disorder_ms
        self.state = Versions(spark, f"{self.path}/open")

    def watermark(self) -> int | None:
        said = self.state.note()
        return int(said) if said else None

    def advance(self, batch: DataFrame, number: int, reached_ms: int | None = None) -> None:
        """Takes in the next batch; one that was taken in before changes nothing.

        reached_ms: arrival time that all later batches reach at least; by
        default the batch's greatest arrival less the allowed disorder.
        """
        done = self.state.committed()
        if number in done:
            return
        spec, keys, window = self.spec, list(self.spec.keys), [*self.spec.keys, "period_start_millis"]
        last = max((v for v in done if v < number), default=None)
        open_windows = None if last is None else self.state.read(last)
        mark = int(said) if last is not None and (said := self.state.note(last)) else None
        if reached_ms is None:
            top = batch.where(spec.complete()).agg(F.max(spec.arrival_ms)).first()[0]
            reached_ms = None if top is None else top - self.disorder_ms
        after = max((m for m in (mark, reached_ms) if m is not None), default=None)

        behind = F.lit(False) if mark is None else F.col("period_start_millis") + spec.width_ms + spec.lateness_ms <= mark
        sided = _classified(batch, spec).withColumn("_ll_behind", behind)
        late = F.col("_ll_class") == "dropped"
        over = F.col(spec.arrival_ms) - F.col("period_start_millis") - spec.width_ms - spec.lateness_ms
        diverted = sided.where(late | F.col("_ll_behind")).withColumns({"reason": F.when(late, "late").otherwise("behind"), "over_cutoff_millis": over}).drop("_ll_class", "_ll_behind")
        nothing = {"period_start_millis": F.lit(None).cast("long"), "reason": F.lit("incomplete"), "over_cutoff_millis": F.lit(None).cast("long")}
        diverted.unionByName(batch.where(~spec.complete()).withColumns(nothing)).write.mode("overwrite").parquet(f"{self.path}/diverted/_ll_batch={number}")

        deltas = sided.where(~late & ~F.col("_ll_behind")).groupBy(*window).agg(*[F.count(F.when(F.col("_ll_class") == c.removeprefix("n_"), 1)).alias(c) for c in COUNTERS])
        changed = deltas if open_windows is None else upsert(open_windows.join(deltas.select(*window), window, "left_semi"), deltas, keys)
        changed.write.mode("overwrite").parquet(f"{self.path}/updates/_ll_batch={number}")
        now = self._part("updates", number, changed)
        held = now if open_windows is None else open_windows.join(now.select(*window), window, "left_anti").unionByName(now)
        if after is not None:
            held = held.where(F.col("period_start_millis") + spec.width_ms + spec.lateness_ms > after)
        self.state.write(held, number, "" if after is None else str(after))
        if last is not None:
            self.state.drop_before(last)

    def _part(self, what: str, number: int, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{what}/_ll_batch={number}")

    def updates(self, number: int | None = None) -> DataFrame:
        """Windows a batch changed with their counts after it; all batches' with ``_ll_batch`` where no number is given."""
        return self.spark.read.parquet(f"{self.path}/updates" if number is None else f"{self.path}/updates/_ll_batch={number}")

    def diverted(self, number: int | None = None) -> DataFrame:
        """Records that changed no window, with ``reason``, their window and how late they were beyond the cut-off."""
        return self.spark.read.parquet(f"{self.path}/diverted" if number is None else f"{self.path}/diverted/_ll_batch={number}")

    def windows(self) -> DataFrame:
        """Every window: the last update of each, with what was diverted from it. Windows all of whose records came too late count none."""
        window = [*self.spec.keys, "period_start_millis"]
        latest = self.updates().groupBy(*window).agg(F.max_by(F.struct(*COUNTERS), "_ll_batch").alias("c")).select(*window, "c.*")
        lost = self.diverted().where("reason <> 'incomplete'").groupBy(*window).agg(F.count(F.lit(1)).alias("n_dropped"))
        lost = lost.select(*window, F.lit(0).cast("long").alias("n_on_time"), F.lit(0).cast("long").alias("n_corrected"), "n_dropped")
        return upsert(latest, lost, self.spec.keys).withColumn("n_events", F.col("n_on_time") + F.col("n_corrected"))


def taken_in(events: DataFrame, spec: WindowSpec, carry: Sequence[str] = (), slots: int = SLOTS, like: DataFrame | None = None) -> WindowState:
    """A whole table through a new state: its rows are written once, by slot of arrival, and the slots follow one another.

    Slots are cut by quantiles of arrival, so they are about equally full;
    ``like`` may name a table cheaper to read whose arrivals are alike.
    """
    spark = events.sparkSession
    some = events.select(*dict.fromkeys([*spec.keys, spec.event_ms, spec.arrival_ms, *carry]))
    folder = work_folder(spark, "arrivals")
    times = (events if like is None else like).select(F.col(spec.arrival_ms).cast("double").alias("a")).dropna()
    edges = sorted({int(e) for e in times.approxQuantile("a", [i / slots for i in range(1, slots)], 0.01)}) if slots > 1 else []
    slot = sum((F.when(F.col(spec.arrival_ms) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    some.withColumn("_ll_slot", slot).write.partitionBy("_ll_slot").parquet(folder)
    stored = spark.read.schema(T.StructType([*some.schema.fields, T.StructField("_ll_slot", T.IntegerType())])).parquet(folder)
    state = WindowState(spark, work_folder(spark, "windows"), spec)
    for i, upto in enumerate([*edges, None]):
        state.advance(stored.where(F.col("_ll_slot") == i).drop("_ll_slot"), i, upto)
    removed(spark, folder)
    return state


def late_windows(windows: DataFrame) -> DataFrame:
    """Only windows to which at least one record came late, in time to correct it or not."""
    return windows.where((F.col("n_corrected") > 0) | (F.col("n_dropped") > 0))
