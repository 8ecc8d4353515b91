"""Blocks of documents: one row holds some megabytes of texts, compressed.

Operators that ask the whole corpus about pieces of a text (does this string
occur elsewhere, how often does this word pair occur) send one request for
each block and get one answer, whatever number of documents in the block ask.
A value that a third of all documents hold so costs a request a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordfold.llm import io

BLOCK_BYTES = 4 << 20
BLOCKS = "block long, kind int, ids binary, sizes binary, texts binary"
#: Stands for a null document id.
NO_ID = np.iinfo(np.int64).max


def packed(x: np.ndarray) -> bytes:
    """An integer array's bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8) if blob else np.zeros(0, np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def packed_sorted(x: np.ndarray) -> bytes:
    """Like ``packed`` for ascending values: their differences."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_sorted(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpacked(blob, dtype), dtype=dtype)


class Block:
    """Texts of a block as one byte array."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes):
        self.ids = unpacked(ids, np.int64)
        self.sizes = unpacked(sizes, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8) if texts else np.zeros(0, np.uint8)

    def parts(self, limit: int = io.SLICE_BYTES) -> Iterator[tuple[int, int]]:
        """Ranges of documents with about ``limit`` bytes each."""
        part = self.offsets[:-1] // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        yield from zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(self.sizes)].tolist(), strict=True)


def make_blocks(docs: DataFrame, size: int = BLOCK_BYTES, kind: Column | None = None) -> DataFrame:
    """Rows of ``BLOCKS`` from ``doc_id, text``, written once. A block holds
    documents of one ``kind`` (an int expression, 0 by default). Null texts
    are empty, null ids ``NO_ID``. A longer text makes a longer block."""
    schema = io.arrow_schema(BLOCKS)
    docs = docs.select("doc_id", "text", (F.lit(0) if kind is None else kind).cast("int").alias("kind"))

    def row(number: int, kind: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, sizes, texts = zip(*parts, strict=True)
        data = b"".join(t.tobytes() for t in texts)
        blob = zstandard.ZstdCompressor(level=3).compress(data) if data else b""
        values = (number, kind, packed(np.concatenate(ids)), packed(np.concatenate(sizes)), blob)
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = io.task_id() << 32
        waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
        held: dict[int, int] = {}
        for piece in io.slices(batches, "text"):
            kinds = piece.column(2).to_numpy()
            for kind in np.unique(kinds).tolist():
                of = piece.filter(pa.array(kinds == kind)) if (kinds != kind).any() else piece
                data, offsets = io.text_arrays(of.column(1))
                if held.get(kind) and held[kind] + len(data) > size:
                    yield row(number, kind, waiting.pop(kind))
                    number, held[kind] = number + 1, 0
                waiting.setdefault(kind, []).append((of.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(), np.diff(offsets), data))
                held[kind] = held.get(kind, 0) + len(data)
        for kind, parts in waiting.items():
            yield row(number, kind, parts)
            number += 1

    return io.written(docs.mapInArrow(run, BLOCKS), "blocks", "uncompressed")
