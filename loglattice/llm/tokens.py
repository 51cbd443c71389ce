"""Encoding of texts with a public byte-level BPE tokenizer.

Forced-boundary splitting: a pair of bytes that stands inside no vocabulary
token can never be joined by a merge, so between such bytes a cut is certain.
Of these the ones are used at which the pre-split pattern begins anew as well:
a printable ASCII character before ASCII white space, and two ASCII letters.
Every text is cut at all of them, every fragment is encoded on its own, and
the ids are concatenated; they equal those of the whole text. Fragments repeat
(they are mostly words), so each worker encodes a distinct fragment once and
looks it up from then on; the store of fragments is bounded.

Cases: null and empty texts have an empty list, never null. Strings that look
like special tokens are ordinary text. A text without any certain cut is one
fragment. Extra columns are ignored; repeated rows are encoded each time.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

#: Fragments held by a worker; full, it starts anew. Longer fragments than LONGEST aren't held. Neither changes any id.
HELD, LONGEST = 1 << 18, 256
SPACES = " \n\t\r"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKENIZERS = os.environ.get("LOGLATTICE_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pre-split pattern of this public tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def inner_pairs(ranks: dict[bytes, int]) -> set[tuple[int, int]]:
    """Byte pairs that stand inside some token."""
    return {pair for token in ranks for pair in zip(token, token[1:])}


def before_space(pairs: set[tuple[int, int]]) -> str:
    """Printable ASCII characters after which any ASCII white space begins a new fragment."""
    return "".join(chr(b) for b in range(0x21, 0x7F) if all((b, ord(s)) not in pairs for s in SPACES))


def between_spaces(certain: str) -> re.Pattern:
    """Matches the fragments of a text, cut before all white space that follows one of the ``certain`` characters."""
    inside = f"[^{SPACES}]"
    unsure = f"[^{SPACES}{re.escape(certain)}]"
    return re.compile(rf"[{SPACES}]*(?:{inside}*{unsure}[{SPACES}]+)*{inside}*")


def between_letters(pairs: set[tuple[int, int]]) -> tuple[re.Pattern, re.Pattern]:
    """Two letters that no token holds side by side: matched with both (quick to search), and without width between them."""
    both, between = [], []
    for a in LETTERS:
        after = "".join(b for b in LETTERS if (ord(a), ord(b)) not in pairs)
        if after:
            both.append(f"{a}[{after}]")
            between.append(f"(?<={a})(?=[{after}])")
    return re.compile("|".join(both) or r"(?!)"), re.compile("|".join(between) or r"(?!)")


class Encoder(dict):
    """Encodes by certain cuts, built from the raw rank file. Maps fragments to the bytes of their ids (native 32-bit integers)."""

    def __init__(self, raw: bytes, held: int = HELD):
        super().__init__()
        ranks = parse_ranks(raw)
        pairs = inner_pairs(ranks)
        self.held = held
        self.words, (self.apart, self.letters) = between_spaces(before_space(pairs)), between_letters(pairs)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def fragments(self, text: str) -> Iterator[str]:
        """All fragments of a text, at every certain cut."""
        for word in self.words.findall(text):
            if word:
                yield from self.letters.split(word)

    def __missing__(self, word: str) -> bytes:
        if self.apart.search(word):
            ids = b"".join([array("i", self.encoding.encode_ordinary(f)).tobytes() for f in self.letters.split(word)])
        else:
            ids = array("i", self.encoding.encode_ordinary(word)).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= self.held:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.words.findall(text))) if text else b""


_ENCODERS: dict[bytes, Encoder] = {}


def encoder_of(raw: bytes) -> Encoder:
    """The process's encoder for a rank file; built once per worker process."""
    digest = hashlib.sha256(raw).digest()
    if digest not in _ENCODERS:
        _ENCODERS[digest] = Encoder(raw)
    return _ENCODERS[digest]


def _map_texts(rows: DataFrame, text: str, keep: list[str], raw: bytes, column: str, kind: str, build):
    source = rows.select(*keep, F.col(text).alias("_ll_text"))
    fields = [f for f in source.schema.fields if f.name in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {column} {kind}"
    shared = rows.sparkSession.sparkContext.broadcast(raw)  # a vocabulary file: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            parts = [encoder.encode(t) for t in batch.column("_ll_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [build(parts)], names=[f.name for f in fields] + [column])

    return source.mapInArrow(run, ddl)


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32), pa.int32()))


def _sizes(parts: list[bytes]) -> pa.Array:
    return pa.array([len(p) // 4 for p in parts], pa.int64())


def encode(rows: DataFrame, text: str, keep: list[str], raw: bytes | None = None) -> DataFrame:
    """``keep`` columns and ``ids``; no shuffle."""
    return _map_texts(rows, text, keep, raw or vocabulary(), "ids", "array<int>", _lists)


def sizes(rows: DataFrame, text: str, keep: list[str], raw: bytes | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens``."""
    return _map_texts(rows, text, keep, raw or vocabulary(), "n_tokens", "long", _sizes)
