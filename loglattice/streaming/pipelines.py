"""Streaming forms of the operators: foreachBatch over versioned state.

A micro-batch's id is its version, so a batch that is delivered again after a
failure finds its work committed and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from loglattice.operators import dedup, late_events
from loglattice.operators.index import Index


def run(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream of micro-batches; by default it takes what is available and stops."""
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_once(ids: Sequence[str], row_id: str, store_path: str, out_path: str) -> Callable[[DataFrame, int], None]:
    """Appends each message's first arrival to ``out_path``, over all batches there ever were."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        store = dedup.SeenStore(batch.sparkSession, store_path, ids)
        batch.persist()
        try:
            kept = store.apply(batch, row_id, f"{batch_id:012d}")
            present = F.lit(True)
            for c in ids:
                present = present & F.col(c).isNotNull()
            with_id = batch.where(present).join(kept, row_id, "left_semi")
            with_id.unionByName(batch.where(~present)).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return on_batch


def correct_windows(spec: late_events.WindowSpec, path: str, disorder_ms: int = 0) -> Callable[[DataFrame, int], None]:
    """Keeps the open windows' counts, emits the windows a batch changed and diverts what it dropped; see ``late_events.WindowState``."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            late_events.WindowState(batch.sparkSession, path, spec, disorder_ms).advance(batch, batch_id)
        finally:
            batch.unpersist()

    return on_batch


def upsert_corpus(path: str) -> Callable[[DataFrame, int], None]:
    """Takes in records (native_id, ts_ms, raw) and keeps the index below ``path`` up to date; see ``operators.index``.

    A conflict anywhere fails the whole batch before anything is committed.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            Index(batch.sparkSession, path).add(batch, batch_id)
        finally:
            batch.unpersist()

    return on_batch
