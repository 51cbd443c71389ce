"""Checkpointed backfill of a paged history, re-reads for late arrivals, and the loop around them.

A page source gives pages of a time range: ``fetch(start, end, token) ->
(records, next token or None)``; a record is (native_id, ts_ms, raw).
Ranges include both ends.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession

from loglattice.session import created_alone, listed, read_text

Record = tuple[str, int, str]
Fetch = Callable[[int, int, str | None], tuple[Sequence[Record], str | None]]
Commit = Callable[[Sequence[Record]], None]
DAY_MS = 86_400_000
MOST_PAGES, MOST_RECORD_BYTES, FIRST_SPAN_MS, REPLAY_MS = 256, 8 << 20, 365 * DAY_MS, 7 * DAY_MS


class InvalidPage(ValueError):
    """A page repeats its token, leaves its range, or holds a record that can't be stored."""


class PageLimit(RuntimeError):
    """A range has more pages than allowed; what was committed stays, the checkpoint doesn't move."""


@dataclass
class Checkpoint:
    completed_ms: int | None = None
    cursor_ms: int | None = None  # of the sweep over old history


class StoredCheckpoint:
    """A checkpoint kept below a folder, so that a restart goes on where it stopped; each change is a numbered file that one writer creates."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.number, self._now = -1, Checkpoint()
        numbers = [int(n) for n in listed(spark, self.path) if n.isdigit()]
        if numbers:
            self.number = max(numbers)
            self._now = Checkpoint(**json.loads(read_text(spark, f"{self.path}/{self.number}")))

    def _change(self, **values: int | None) -> None:
        now = replace(self._now, **values)
        if not created_alone(self.spark, f"{self.path}/{self.number + 1}", json.dumps(asdict(now))):
            raise RuntimeError("another writer moved this checkpoint")
        self.number, self._now = self.number + 1, now

    @property
    def completed_ms(self) -> int | None:
        return self._now.completed_ms

    @completed_ms.setter
    def completed_ms(self, value: int) -> None:
        self._change(completed_ms=value)

    @property
    def cursor_ms(self) -> int | None:
        return self._now.cursor_ms

    @cursor_ms.setter
    def cursor_ms(self, value: int | None) -> None:
        self._change(cursor_ms=value)


def read_range(fetch: Fetch, commit: Commit, start: int, end: int, most_pages: int = MOST_PAGES) -> int:
    """Commits every page of a range; gives the number of pages."""
    token, seen, pages = None, set(), 0
    while True:
        if pages == most_pages:
            raise PageLimit
        records, following = fetch(start, end, token)
        pages += 1
        for native_id, ts, raw in records:
            if not native_id or ts < 0 or not start <= ts <= end or len(raw.encode("utf-8", "surrogatepass")) > MOST_RECORD_BYTES:
                raise InvalidPage(native_id)
        if following is not None and following in seen:
            raise InvalidPage(following)
        commit(records)
        if following is None:
            return pages
        seen.add(following)
        token = following


def backfill(fetch: Fetch, commit: Commit, checkpoint: Checkpoint, oldest: int, high_water: int, span: int = FIRST_SPAN_MS, most_pages: int = MOST_PAGES, most_ranges: int | None = None) -> str:
    """Moves the checkpoint towards the high-water mark, a range at a time.

    The checkpoint moves only after a range's last page, so a restart replays
    an unfinished range; committing is idempotent. A range with too many pages
    is halved. Gives scanned, backfilling (more ranges left) or partial (a
    single millisecond has too many pages).
    """
    done = 0
    while (checkpoint.completed_ms if checkpoint.completed_ms is not None else oldest - 1) < high_water:
        if most_ranges is not None and done == most_ranges:
            return "backfilling"
        start = oldest if checkpoint.completed_ms is None else checkpoint.completed_ms + 1
        end = min(start + span - 1, high_water)
        try:
            read_range(fetch, commit, start, end, most_pages)
        except PageLimit:
            if span == 1:
                return "partial"
            span = max(1, min(span, end - start + 1) // 2)
            continue
        checkpoint.completed_ms = end
        done += 1
    return "scanned"


def replay(fetch: Fetch, commit: Commit, checkpoint: Checkpoint, window: int = REPLAY_MS) -> int:
    """Reads the last window again for late arrivals, without moving the checkpoint."""
    if checkpoint.completed_ms is None:
        return 0
    return read_range(fetch, commit, max(0, checkpoint.completed_ms - window + 1), checkpoint.completed_ms)


def sweep(cursor: int | None, oldest: int, newest: int, span: int, most_ranges: int = 8) -> tuple[list[tuple[int, int]], int | None]:
    """Next ranges of a sweep over old history, and the cursor to go on from (None once it's through)."""
    at, ranges = oldest if cursor is None else cursor, []
    while at <= newest and len(ranges) < most_ranges:
        ranges.append((at, min(at + span - 1, newest)))
        at = ranges[-1][1] + 1
    return ranges, at if at <= newest else None


def backoff_seconds(base: int, errors: int, most: int = 3600) -> int:
    return min(base * 2 ** min(errors, 6), most)


def sweep_on(fetch: Fetch, commit: Commit, checkpoint: Checkpoint | StoredCheckpoint, oldest: int, newest: int, span: int, most_ranges: int = 8) -> bool:
    """Reads the next ranges of old history again and moves the stored cursor; True once it is through."""
    ranges, following = sweep(checkpoint.cursor_ms, oldest, newest, span, most_ranges)
    for start, end in ranges:
        read_range(fetch, commit, start, end)
    checkpoint.cursor_ms = following
    return following is None


def watch(round_: Callable[[], str], rounds: int, base: int = 60, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Runs sync rounds with a pause between them, longer after each error in a row; gives what each round said."""
    said, errors = [], 0
    for i in range(rounds):
        try:
            said.append(round_())
            errors = 0
        except (InvalidPage, PageLimit, OSError) as e:
            said.append(type(e).__name__)
            errors += 1
        if i + 1 < rounds:
            sleep(backoff_seconds(base, errors))
    return said
