"""Runs of the same event collapsed into one event with its count and duration.

Symbol-string regex: a message is reduced to what it says (component, level
and words, without values), canonical events become Unicode code points, the
code points of an entity's events are concatenated in order, and a
backreference expression finds repetitions whose spans map back to times.

Events are range-partitioned by (entity, time, id), so an entity of any size
is spread over tasks in order. Each task turns its own events into symbols (a
dictionary per piece of at most ``PIECE`` events, so code points always
suffice), and pieces and tasks are stitched where a run crosses their border:
per task only its first and last run are looked at again.

Cases: events with a null or empty message, a null entity, time or id are left
out. Equal times are ordered by id as text. A single event is a run of one.
Messages nothing can be masked in, blank ones included, compare by their
words; two blank messages say the same. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from loglattice.functions.layouts import Router
from loglattice.session import written

PIECE = 50_000  # events per symbol string
FIRST_SYMBOL = 0x10000  # code points above the surrogates: PIECE of them always fit

# Units that belong to a number.
UNITS = "ns us µs μs ms s sec secs second seconds min mins minute minutes m h hr hours hour d day days b kb mb gb tb kib mib gib tib bytes byte hz khz mhz ghz".split()
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
_RELATED_ID = re.compile(r"\b(?:x[-_])?(?:request|span|correlation|trace)[-_ ]?id\s*[=:]\s*\"?[\w.-]+\"?")
_VALUE = re.compile(
    rf"""
      '[^'\n]*'                                                               # a quoted name
    | \[[0-9a-f:]{{0,39}}:[0-9a-f:]{{1,39}}\](?::\d+)?                          # an address
    | [-+]\b\d+(?:[.,]\d+)*(?:\s?(?:{_UNIT})\b|%|(?!\w))                      # a signed number or quantity
    | \b(?=\w*\d|[0-9a-f]{{8}})(?:                                            # words that can hold a value, and only these, go on here
        \d{{4}}-\d\d-\d\d(?:[t\s]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?(?:z|[+-]\d\d:?\d\d)?)?  # a date or time
      | \d{{1,2}}:\d\d(?::\d\d(?:[.,]\d+)?)?\b
      | [0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\b
      | (?:\d{{1,3}}\.){{3}}\d{{1,3}}(?::\d+)?\b                                 # an address
      | (?:\d+(?:\.\d+)?(?:h|m|s|ms|µs|μs|us|ns|d))+(?![\w])                   # 19m51s
      | \d+(?:[.,]\d+)*(?:\s?(?:{_UNIT})\b|%|(?!\w))                            # a number or quantity
      | (?=[a-z_]*\d)[0-9a-z_]+\b                                             # an id: letters and digits mixed
      | [0-9a-f]{{8,}}\b
      )
    """,
    re.X,
)
_MIXED = re.compile(r"(?<!\w)(?=[^\W\d]*\d)\w+")  # begins at words only: linear on long ones


def words(text: str) -> str:
    """What a text says: letter case, white space and values removed."""
    text = text.lower()
    if "id" in text:
        text = _RELATED_ID.sub(" ", text)
    text = _VALUE.sub(" # ", text)
    text = _MIXED.sub("#", text)
    return " ".join(text.split())


def same_event_key(router: Router, text: str, near_ms: int | None = None) -> str:
    """Equal for two messages exactly if the same component says the same words at the same level."""
    entry = router.parse(text.lstrip(), near_ms)
    if entry is None:
        return f"\x1f\x1f{words(text)}"
    return f"{(entry.component or '').lower()}\x1f{entry.level or ''}\x1f{words(entry.message if entry.message is not None else text)}"


def event_keys(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``same`` (16-byte digest of the key; null for a null or empty text)."""
    source = rows.select(*keep, F.col(text).alias("_ll_text"))
    fields = [f for f in source.schema.fields if f.name in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", same binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router()
        for batch in batches:
            same = [hashlib.blake2b(same_event_key(router, t).encode("utf-8", "surrogatepass"), digest_size=16).digest() if t else None for t in batch.column("_ll_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [pa.array(same, pa.binary())], names=[f.name for f in fields] + ["same"])

    return source.mapInArrow(run, ddl)


_REPEATS = re.compile(r"(.)\1*", re.S)


def symbol_runs(keys: list) -> list[tuple[int, int]]:
    """(start, end) of each longest run of equal keys, by a backreference over their symbol string."""
    symbols: dict = {}
    text = "".join([chr(FIRST_SYMBOL + symbols.setdefault(k, len(symbols))) for k in keys])
    return [m.span() for m in _REPEATS.finditer(text)]


_RUN_COLUMNS = ["entity", "same", "first_id", "last_id", "first_ms", "last_ms", "n_events"]
_RUN_DDL = "entity string, same binary, first_id string, last_id string, first_ms long, last_ms long, n_events long"


def _merge(a: list, b: list) -> bool:
    """Adds run b to run a where it goes on with it."""
    if a[0] != b[0] or a[1] != b[1]:
        return False
    a[3], a[5], a[6] = b[3], b[5], a[6] + b[6]
    return True


def _task_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sorted partition; its first and last run are marked, all others are final."""
    part = TaskContext.get().partitionId()
    held: list | None = None  # the run that may go on
    first = True

    def out(runs: list[list], last: bool) -> pa.RecordBatch:
        nonlocal first
        ends = [False] * len(runs)
        if first and runs:
            ends[0], first = True, False
        if last and runs:
            ends[-1] = True
        columns = list(zip(*runs)) if runs else [()] * 7
        types = [pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(runs), pa.int32()), pa.array(ends, pa.bool_())], names=[*_RUN_COLUMNS, "part", "at_end"])

    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            piece = batch.slice(at, PIECE)
            entity, same, ids, ms = (piece.column(c).to_pylist() for c in ("entity", "same", "id", "ms"))
            runs = [[entity[i], same[i], ids[i], ids[j - 1], ms[i], ms[j - 1], j - i] for i, j in symbol_runs(list(zip(entity, same)))]
            if held is not None and _merge(held, runs[0]):
                runs.pop(0)
            if runs:
                if held is not None:
                    runs.insert(0, held)
                held = runs.pop()
                if runs:
                    yield out(runs, False)
    if held is not None:
        yield out([held], True)


def collapse_runs(events: DataFrame, entity: str, ms: str, event_id: str, same: str) -> DataFrame:
    """Longest runs: entity, same, first_id, last_id, first_ms, last_ms, n_events; singles included.

    Only the first and last run of each range partition can go on in the next
    one; those rows (two per task) are stitched in one window, the rest is
    final as it leaves its task.
    """
    narrow = events.select(F.col(entity).alias("entity"), F.col(ms).cast("long").alias("ms"), F.col(event_id).alias("id"), F.col(same).alias("same"))
    narrow = narrow.where("entity is not null and ms is not null and id is not null and same is not null")
    ordered = narrow.repartitionByRange("entity", "ms", "id").sortWithinPartitions("entity", "ms", "id")
    # written once: inner and border runs must come from the same range bounds
    runs = written(ordered.mapInArrow(_task_runs, _RUN_DDL + ", part int, at_end boolean"), "runs")
    ends = runs.where("at_end")
    along = Window.orderBy("entity", "first_ms", "first_id")  # two rows a task
    goes_on = (F.lag("entity").over(along) == F.col("entity")) & (F.lag("same").over(along) == F.col("same")) & (F.lag("part").over(along) < F.col("part"))
    numbered = ends.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run_no", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = numbered.groupBy("run_no").agg(
        F.first("entity").alias("entity"),
        F.first("same").alias("same"),
        F.min(F.struct("first_ms", "first_id")).alias("a"),
        F.max(F.struct("last_ms", "last_id")).alias("b"),
        F.sum("n_events").alias("n_events"),
    )
    stitched = stitched.select("entity", "same", F.col("a.first_id").alias("first_id"), F.col("b.last_id").alias("last_id"), F.col("a.first_ms").alias("first_ms"), F.col("b.last_ms").alias("last_ms"), "n_events")
    return runs.where("not at_end").select(*_RUN_COLUMNS).unionByName(stitched)


def runs_in_order(frame: pd.DataFrame) -> list[tuple]:
    """Brute force for tests: rows of (entity, ms, id, same), one after the other."""
    out: list[list] = []
    for e, m, i, s in sorted(frame[["entity", "ms", "id", "same"]].itertuples(index=False), key=lambda r: r[:3]):
        if out and out[-1][0] == e and out[-1][1] == s:
            out[-1][3], out[-1][5], out[-1][6] = i, m, out[-1][6] + 1
        else:
            out.append([e, s, i, i, m, m, 1])
    return [tuple(x) for x in out]
