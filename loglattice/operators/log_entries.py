"""Semi-structured log lines into time, level, component and message.

Parsing runs on Arrow batches next to the scan, so the texts themselves never
cross a shuffle unless the caller asks for the message. Removing copies and
joining continuation lines then works on the narrow parsed rows.

Two kinds of input:

* messages: each text is one whole entry, of one line or many;
* numbered lines: each record is one line of a file. An entry is a head (a
  line some layout begins) and all lines up to the next head. Files are cut
  into blocks of ``BLOCK`` line numbers; heads and lines are counted within a
  block, and what runs over a block's end is carried by one row per block, so
  a file of any length is spread over tasks.

Cases: a null or empty text is no entry. Null bytes of a numbered line make it
no line at all; empty bytes make it a blank line. Lines before a file's first
head belong to no entry. Undecodable base64 counts as null. Bytes that aren't
UTF-8 are replaced by U+FFFD. A text whose head is cut off keeps what it does
state and null for the rest. A JSON object over several numbered lines, begun
at a line's start, is put together and is an entry if it states a time or a
level; else its lines stay what they are on their own. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loglattice.functions.layouts import ANSI, Entry, Router, json_end, line_count

BLOCK = 4096
PARSED = ["ts_millis", "level", "component", "n_lines"]
_PARSED_DDL = "ts_millis long, level string, component string, n_lines long"
_NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/]+")
_LINE_ID = re.compile(r"line-(\d{1,18})$")
_LINE_END = re.compile(r"\r?\n\Z")


def decode_base64(text: str | None) -> bytes | None:
    """Either alphabet, padded or not, broken into lines or not; None where it can't be base64."""
    if text is None:
        return None
    raw = _NOT_BASE64.sub(b"", text.encode("ascii", "ignore").replace(b"-", b"+").replace(b"_", b"/"))
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4))
    except binascii.Error:
        return None


def parse_messages(rows: DataFrame, text: str, near_ms: str | None, keep: list[str], message: bool = False) -> DataFrame:
    """Adds ts_millis, level, component, n_lines (and message) to the ``keep`` columns of each row.

    ``near_ms`` names the column that settles a missing year. Rows whose text
    is null or empty get nulls.
    """
    near = F.col(near_ms).cast("long") if near_ms else F.lit(None).cast("long")
    source = rows.select(*keep, F.col(text).alias("_ll_text"), near.alias("_ll_near"))
    fields = [f for f in source.schema.fields if f.name in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + _PARSED_DDL + ", message string" * message

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router()
        for batch in batches:
            ts, level, component, lines, said = [], [], [], [], []
            for value, near_to in zip(batch.column("_ll_text").to_pylist(), batch.column("_ll_near").to_pylist()):
                entry = router.parse(value.lstrip(), near_to) if value else None
                ts.append(entry and entry.ts_ms)
                level.append(entry and entry.level)
                component.append(entry and entry.component)
                lines.append(line_count(value) if value else None)
                if message:
                    said.append((entry.message if entry else value) if value else None)
            columns = [batch.column(f.name) for f in fields] + [pa.array(ts, pa.int64()), pa.array(level, pa.string()), pa.array(component, pa.string()), pa.array(lines, pa.int64())]
            names = [f.name for f in fields] + PARSED
            if message:
                columns.append(pa.array(said, pa.string()))
                names.append("message")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, ddl)


def parse_records(rows: DataFrame, raw_base64: str, native_id: str, keep: list[str], message: bool = False) -> DataFrame:
    """As parse_messages for base64 records; adds line_no (null if the native id isn't ``line-<number>``), has_bytes, is_head and is_open (the line begins a JSON object and doesn't end it).

    The message of a numbered line is without its line end and colour codes:
    what a head says after its fields, or the whole of any other line.
    """
    source = rows.select(*keep, F.col(raw_base64).alias("_ll_raw"), F.col(native_id).alias("_ll_native"))
    fields = [f for f in source.schema.fields if f.name in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + _PARSED_DDL + ", line_no long, has_bytes boolean, is_head boolean, is_open boolean" + ", message string" * message

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router()
        for batch in batches:
            ts, level, component, lines, numbers, have, heads, opens, said = [], [], [], [], [], [], [], [], []
            for coded, native in zip(batch.column("_ll_raw").to_pylist(), batch.column("_ll_native").to_pylist()):
                raw = decode_base64(coded)
                number = _LINE_ID.match(native) if native else None
                text = raw.decode("utf-8", "replace") if raw else ""
                entry = router.parse(text if number else text.lstrip(), None) if text else None
                ts.append(entry and entry.ts_ms)
                level.append(entry and entry.level)
                component.append(entry and entry.component)
                lines.append(line_count(text) if text else None)
                numbers.append(int(number[1]) if number else None)
                have.append(raw is not None)
                heads.append(entry is not None)
                opens.append(number is not None and text.startswith("{") and not json_end(text))
                if message:
                    said.append(_record_message(entry, text, number is not None) if raw is not None else None)
            columns = [batch.column(f.name) for f in fields]
            columns += [pa.array(ts, pa.int64()), pa.array(level, pa.string()), pa.array(component, pa.string()), pa.array(lines, pa.int64()), pa.array(numbers, pa.int64()), pa.array(have, pa.bool_()), pa.array(heads, pa.bool_()), pa.array(opens, pa.bool_())]
            names = [f.name for f in fields] + [*PARSED, "line_no", "has_bytes", "is_head", "is_open"]
            if message:
                columns.append(pa.array(said, pa.string()))
                names.append("message")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, ddl)


def _record_message(entry: Entry | None, text: str, numbered: bool) -> str | None:
    if not numbered:
        return (entry.message if entry else text) if text else None
    said = entry.message if entry else ANSI.sub("", text)
    return _LINE_END.sub("", said) if said is not None else None


def join_lines(lines: DataFrame, file_id: str, order: list[str], row_id: str, block: int = BLOCK, message: bool = False) -> DataFrame:
    """Entries of numbered lines: ``file_id``, row_id of the head, its fields, and n_lines (and message) of the whole entry.

    ``lines`` has one row per line with line_no, is_head and the parsed
    columns; ``order`` breaks ties of line_no. The message is that of the head
    and the lines after it, with a line feed between them.
    """
    fields = [row_id, "ts_millis", "level", "component"]
    blocks = lines.withColumn("_ll_block", F.expr(f"line_no div {block}"))
    in_block = Window.partitionBy(file_id, "_ll_block").orderBy("line_no", *order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = blocks.withColumn("_ll_head_no", F.sum(F.col("is_head").cast("long")).over(in_block))
    placed = F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("line_no", *order, "message")))) if message else None
    said = [F.transform(placed, lambda x: x["message"]).alias("_ll_said")] if message else []
    groups = numbered.groupBy(file_id, "_ll_block", "_ll_head_no").agg(
        F.count(F.lit(1)).alias("n_lines"), F.first(F.when(F.col("is_head"), F.struct(*fields)), ignorenulls=True).alias("_ll_head"), *said
    )
    # one row per block: how many lines stand before its first head, and how many heads it has
    edges = groups.groupBy(file_id, "_ll_block").agg(F.sum(F.when(F.col("_ll_head_no") == 0, F.col("n_lines"))).alias("_ll_lead"), F.max("_ll_head_no").alias("_ll_heads"))
    along = Window.partitionBy(file_id).orderBy("_ll_block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.max(F.when(F.col("_ll_heads") > 0, F.struct("_ll_block", F.col("_ll_heads").alias("_ll_head_no")))).over(along)
    at = [F.col("_ll_owner._ll_block").alias("_ll_block"), F.col("_ll_owner._ll_head_no").alias("_ll_head_no")]
    owned = edges.withColumn("_ll_owner", owner).where("_ll_lead > 0 and _ll_owner is not null")
    more = [F.sum("_ll_lead").alias("_ll_more")]
    if message:  # texts stay out of the window along a file
        owned = owned.join(groups.where("_ll_head_no = 0").select(file_id, "_ll_block", "_ll_said"), [file_id, "_ll_block"])
        in_order = F.array_sort(F.collect_list(F.struct("_ll_block", "_ll_said")))
        more.append(F.flatten(F.transform(in_order, lambda x: x["_ll_said"])).alias("_ll_more_said"))
    carried = owned.groupBy(file_id, *at).agg(*more)
    n_lines = (F.col("n_lines") + F.coalesce("_ll_more", F.lit(0))).alias("n_lines")
    whole = F.concat("_ll_said", F.coalesce("_ll_more_said", F.array().cast("array<string>"))) if message else None
    text = [F.when(F.size(whole) > 0, F.array_join(whole, "\n")).alias("message")] if message else []
    return groups.where("_ll_head_no > 0").join(carried, [file_id, "_ll_block", "_ll_head_no"], "left").select(file_id, "_ll_head.*", n_lines, *text)


def decoded_lines(rows: DataFrame, raw_base64: str, row_id: str) -> DataFrame:
    """row_id and ``message``: each record's text without its line end."""
    raw = F.unbase64(F.translate(F.regexp_replace(raw_base64, "[^A-Za-z0-9+/_-]", ""), "-_", "+/"))
    return rows.select(row_id, F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\r?\n\z", "").alias("message"))


def put_json_together(lines: DataFrame, rows: DataFrame, raw_base64: str, file_id: str, order: list[str], row_id: str, message: bool = False, block: int = BLOCK) -> DataFrame:
    """Lines whose JSON goes on over the lines after them get its fields and become heads.

    Only files that hold such a line are read again, with their texts; each
    object is then put together in one row.
    """
    opened = lines.where("is_open")
    if opened.limit(1).count() == 0:
        return lines
    theirs = lines.join(opened.select(file_id).distinct(), file_id, "left_semi").select(file_id, row_id, "line_no", *order, *PARSED, (F.col("is_head") | F.col("is_open")).alias("is_head"))
    texts = decoded_lines(rows.join(theirs.select(row_id), row_id, "left_semi"), raw_base64, row_id)
    entries = join_lines(theirs.join(texts, row_id), file_id, order, row_id, block, message=True).join(opened.select(row_id), row_id, "left_semi")
    whole = entries.select(row_id, F.col("message").alias("_ll_text"))
    ddl = f"`{row_id}` {dict(whole.dtypes)[row_id]}, ts_millis long, level string, component string, message string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router()
        for batch in batches:
            found = [router.parse(t[:end]) if t and (end := json_end(t)) else None for t in batch.column("_ll_text").to_pylist()]
            found = [e if e is not None and (e.ts_ms is not None or e.level is not None) else None for e in found]
            columns = [pa.array([e and getattr(e, c) for e in found], t) for c, t in (("ts_ms", pa.int64()), ("level", pa.string()), ("component", pa.string()), ("message", pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(row_id), *columns], names=[row_id, "ts_millis", "level", "component", "message"]).filter(pa.array([e is not None for e in found], pa.bool_()))

    fields = ["ts_millis", "level", "component", *(["message"] if message else [])]
    made = whole.mapInArrow(run, ddl).select(row_id, F.struct(*fields).alias("_ll_made"))
    has = F.col("_ll_made").isNotNull()
    return lines.join(made, row_id, "left").withColumns({**{c: F.when(has, F.col(f"_ll_made.{c}")).otherwise(F.col(c)) for c in fields}, "is_head": has | F.col("is_head")}).drop("_ll_made")


def complete(entries: DataFrame) -> DataFrame:
    """Entries that state a time, a level and a component."""
    return entries.where("ts_millis is not null and level is not null and component is not null")
