"""Paged log histories as a data source: recorded provider pages of several providers, batch and streaming.

``spark.read.format("recorded_pages").option("provider", "cloudwatch").load(path)``
reads a folder of JSON page files, in any file system pyarrow or Python can
open. A page is what the provider's API returned; records come out as
native_id, ts_ms, raw, stream, page and position. Each page is read in a task of its own,
in streams too. Live providers are reached by putting their pages into such a
folder; credentials and HTTP stay outside. ``sources.runs`` checks a whole run.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "native_id string, ts_ms long, raw string, stream string, page string, position int"
Row = tuple[str, int, str, str]


class IntegrityError(ValueError):
    """The same identifier with different bytes within one page."""


def _iso_ms(text: str) -> int:
    from loglattice.functions.layouts import iso_ms

    ms = iso_ms(text)
    if ms is None:
        raise ValueError(f"not a time: {text}")
    return ms


def _cloudwatch(page: dict) -> Iterator[Row]:
    for e in page.get("events", []):
        yield e["eventId"], int(e["timestamp"]), e["message"], e.get("logStreamName", "")


def _sentry(page: dict | list) -> Iterator[Row]:
    for e in page if isinstance(page, list) else page.get("data", []):
        yield e["eventID"], _iso_ms(e["dateCreated"]), json.dumps(e, separators=(",", ":"), sort_keys=True), ""


def _datadog(page: dict) -> Iterator[Row]:
    for e in page.get("data", []):
        yield e["id"], _iso_ms(e["attributes"]["timestamp"]), json.dumps(e, separators=(",", ":"), sort_keys=True), ""


def _kubernetes(page: dict) -> Iterator[Row]:
    """Lines of one container instance: "<time> <stdout|stderr> <F|P> text"; the id is instance, stream and line number."""
    for i, line in enumerate(page.get("lines", [])):
        when, stream, _, text = (line.split(" ", 3) + ["", "", ""])[:4]
        yield f"{page['instance']}/{stream}/{i}", _iso_ms(when), text, f"{page['instance']}/{stream}"


PROVIDERS = {"cloudwatch": _cloudwatch, "sentry": _sentry, "datadog": _datadog, "kubernetes": _kubernetes}


def _system(path: str):
    """pyarrow's file system of a path with a scheme, else None."""
    if "://" not in path:
        return None, path.removeprefix("file:")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def read_page(provider: str, path: str) -> list[tuple[str, int, str, str, str, int]]:
    """A page's records as they stand in it; exact repetitions within the page are left out, conflicting ones are an error."""
    system, place = _system(path)
    if system is None:
        with open(place, encoding="utf-8") as f:
            page = json.load(f)
    else:
        with system.open_input_stream(place) as f:
            page = json.loads(f.read())
    seen: dict[str, tuple[int, str, str]] = {}
    out = []
    for position, (native_id, ts, raw, stream) in enumerate(PROVIDERS[provider](page)):
        if native_id not in seen:
            out.append((native_id, ts, raw, stream, os.path.basename(path), position))
        if seen.setdefault(native_id, (ts, raw, stream)) != (ts, raw, stream):
            raise IntegrityError(native_id)
    return out


def page_files(path: str) -> list[str]:
    system, place = _system(path)
    if system is None:
        return sorted(os.path.join(place, n) for n in os.listdir(place) if n.endswith(".json"))
    from pyarrow import fs

    scheme = path.split("://", 1)[0]
    return sorted(f"{scheme}://{f.path}" for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".json"))


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.provider, self.path = options.get("provider", "cloudwatch"), options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in page_files(self.path)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from read_page(self.provider, partition.path)


class PageStreamReader(DataSourceStreamReader):
    """Offsets count the pages, in file name order; the driver only lists them."""

    def __init__(self, options: dict):
        self.provider, self.path = options.get("provider", "cloudwatch"), options["path"]

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(page_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(p) for p in page_files(self.path)[start["pages"] : end["pages"]]]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from read_page(self.provider, partition.path)


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStreamReader(self.options)
