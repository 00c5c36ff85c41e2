"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last 16 bytes cuts a text where its low bits are all ones, so
equal passages are cut alike wherever they stand. A chunk's ids are computed once in a
Python worker and kept; what documents share is looked up. Chunk joins are then repaired:
the text from the last certain token boundary of the left chunk to the first one of the
right chunk is encoded again and replaces the ids on both sides. A boundary is certain
before white space that follows a visible ASCII character, as no match of the splitting
pattern and no special token crosses that point and none looks back. If a chunk has no
such boundary, the repair takes in the next chunk too, until both sides agree.

The memo is per worker and emptied beyond ``MEMO_CHARS``: a table of all chunks would
move every text through a shuffle, more than reuse saves.

Nulls: a null text is empty and has no ids. Texts of any length are encoded whole; extra
columns are kept. Repeated rows give repeated rows. Special tokens in a text are encoded as
the vocabulary file says.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks have 2**CHUNK_BITS bytes on average.
CHUNK_BITS = 9
#: Characters of chunks that a worker keeps the ids of.
MEMO_CHARS = 24_000_000
#: Bytes of text that are worked on at once.
SLICE_BYTES = 4_000_000
ROLL = 2654435761
SYNC = re.compile(r"(?<=[!-~])(?=[ \n])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, w)): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.memo: dict[str, tuple] = {}
        self.joins: dict[str, np.ndarray] = {}
        self.memo_chars = 0

    def encode_plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()) if text else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")

    def chunk(self, text: str) -> tuple[np.ndarray, int, int, str, str]:
        """Ids of ``text``; how many belong to what stands before the first and after the last certain boundary (-1: there is none); those texts."""
        found = self.memo.get(text)
        if found is None:
            if self.memo_chars > MEMO_CHARS:
                self.memo.clear()
                self.joins.clear()
                self.memo_chars = 0
            first = SYNC.search(text)
            if first is None:
                found = (self.encode_plain(text), -1, -1, text, text)
            else:
                head, last = text[: first.start()], max(text.rfind(" "), text.rfind("\n"))
                while not "!" <= text[last - 1] <= "~":
                    last = max(text.rfind(" ", 0, last), text.rfind("\n", 0, last))
                tail = text[last:]
                found = (self.encode_plain(text), len(self.encode_plain(head)), len(self.encode_plain(tail)), head, tail)
            self.memo[text] = found
            self.memo_chars += len(text) + 200
        return found

    def join(self, text: str) -> np.ndarray:
        found = self.joins.get(text)
        if found is None:
            found = self.encode_plain(text)
            if len(text) < 100:
                self.joins[text] = found
                self.memo_chars += 250
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text, from the ids of its chunks."""
        parts: list[np.ndarray] = []
        open_text: str | None = None  # what the next chunk's head is to be joined to
        held: np.ndarray | None = None  # ids up to there
        for piece in chunks(text):
            ids, n_head, n_tail, head, tail = self.chunk(piece)
            if open_text is None:
                body = ids
            elif n_head < 0:  # no certain boundary: take in the next chunk too
                open_text += piece
                continue
            else:
                parts.append(self.join(open_text + head))
                body = ids[n_head:]
            if n_head < 0:
                open_text = piece
                continue
            held = body[: len(body) - n_tail] if n_tail else body
            parts.append(held)
            open_text = tail
        if open_text is not None:
            parts.append(self.join(open_text))
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def chunks(text: str) -> list[str]:
    """``text`` cut by content into pieces of whole characters."""
    raw = text.encode()
    if len(raw) < 32:
        return [text] if text else []
    h = np.frombuffer(raw, np.uint8).astype(np.uint32)
    step, factor = 1, ROLL
    for _ in range(4):  # after each pass the hash spans twice as many bytes
        longer = h.copy()
        longer[step:] += h[:-step] * np.uint32(factor)
        h, step, factor = longer, step * 2, factor * factor % 2**32
    mask = np.uint32((1 << CHUNK_BITS) - 1)
    cuts = np.flatnonzero(((h >> np.uint32(13)) & mask) == mask) + 1
    out, at = [], 0
    for cut in cuts.tolist():
        while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
            cut += 1
        if cut > at:
            out.append(raw[at:cut].decode())
            at = cut
    if at < len(raw):
        out.append(raw[at:].decode())
    return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, a row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto


def map_texts(docs: DataFrame, text: str, schema: T.StructType, work: Callable[[pa.RecordBatch], dict[str, Any]], most: int = SLICE_BYTES) -> DataFrame:
    """``docs`` through ``work``, which gets batches of about ``most`` bytes of text and returns columns by name."""
    names, kinds = schema.names, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kinds
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = kinds or to_arrow_schema(schema)
        for batch in slices(batches, text, most):
            got = work(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kinds.field(n).type) for n, x in ((n, got[n]) for n in names)], schema=kinds)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ids (binary: little-endian unsigned 32-bit) in place of ``text``; with ``decoded``, also what they decode to."""
    path = vocabulary or default_vocabulary()
    kept = [f for f in docs.schema.fields if f.name not in (text, "ids", "decoded")]  # columns called so give way
    schema = T.StructType([*kept, T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded)

    def work(batch: pa.RecordBatch) -> dict[str, Any]:
        c = codec(path)
        ids = [c.encode(x or "") for x in batch.column(text).to_pylist()]
        out: dict[str, Any] = {f.name: batch.column(f.name) for f in kept}
        out["ids"] = [x.astype("<u4", copy=False).tobytes() for x in ids]
        if decoded:
            out["decoded"] = [c.decode(x) for x in ids]
        return out

    return map_texts(docs.select(*(f.name for f in kept), text), text, schema, work)


def decode(rows: DataFrame, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with the text that ``ids`` decode to, in place of them; null ids give an empty text."""
    path = vocabulary or default_vocabulary()
    kept = [f for f in rows.schema.fields if f.name != ids]
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])

    def work(batch: pa.RecordBatch) -> dict[str, Any]:
        c = codec(path)
        out: dict[str, Any] = {f.name: batch.column(f.name) for f in kept}
        out["text"] = [c.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(ids).to_pylist()]
        return out

    return map_texts(rows, ids, schema, work)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(store.table(spark, sf_dir, "documents", "doc_id", "text"), decoded=True)
    return out.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
