"""Vocabulary-sized columns by dense id, for cells that are many more.

A table of ids 0..n-1 that ``cut_lineage`` wrote is read by every Python worker
once, and cells take its values in place: they are neither shuffled nor joined,
and the table doesn't pass the driver. Callers check :func:`fits` first; beyond
it a shuffle join does the same.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wordfold.session import cut_lineage, row_bytes

#: Bytes of such tables that a worker may hold (by ``row_bytes``; in arrays about half).
WORKER_BYTES = 512 << 20
#: Strings hashed at once.
HASHED = 1 << 17
#: Rows given back at once.
ROWS = 1 << 16

_held: dict = {}


def fits(table: DataFrame) -> bool:
    """Whether a worker may hold the table (one job over it)."""
    from pyspark.sql import functions as F

    return table.agg(F.coalesce(F.sum(row_bytes(table)), F.lit(0))).first()[0] <= WORKER_BYTES


def freed() -> None:
    """Gives back what the process doesn't use: a worker that waits for its
    next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def held(path: str, key: str, names: tuple[str, ...]) -> pa.Table:
    """The written table's columns in order of id; the last few are kept."""
    at = (path, key, names)
    if at not in _held:
        files, place = _place(path)
        table = dataset.dataset(place, filesystem=files, format="parquet").to_table([key, *names])
        order = np.argsort(table[key].to_numpy())
        for old in list(_held)[:-7]:
            del _held[old]
        _held[at] = pa.table({n: table[n].combine_chunks().take(order) if table.num_rows else table[n] for n in names})
    return _held[at]


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    parts = [pd.util.hash_array(words.slice(lo, HASHED).to_numpy(zero_copy_only=False).astype(object), categorize=False)
             for lo in range(0, len(words), HASHED)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


class Ids:
    """Ids of words: found by hash, then compared as strings."""

    def __init__(self, words: pa.Array):
        found = hashes(words)
        self.id = np.argsort(found, kind="stable")
        self.hash, self.words = found[self.id], words
        self.unique = not (self.hash[1:] == self.hash[:-1]).any()

    def of(self, words: pa.Array) -> np.ndarray:
        """The id of every word, -1 for others."""
        if not len(self.id) or not len(words):
            return np.full(len(words), -1)
        if not self.unique:
            return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = self.id[np.minimum(np.searchsorted(self.hash, hashes(words)), len(self.id) - 1)]
        same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


class Named(int):
    """How many ids there are, 0..n-1, with the written table ``word, wid`` of
    their words, for cells that shall have these in the same pass."""

    names: DataFrame

    @staticmethod
    def of(n: int | None, names: DataFrame) -> Named | None:
        found = None if n is None else Named(n)
        if found is not None:
            found.names = names
        return found


def words_of(dense: int, row: str, col: str) -> list[tuple[str, DataFrame, str, dict[str, str]]]:
    """The entries of :func:`attach` for words of both keys, as ``_word`` and
    ``_context``, where ``dense`` is named."""
    return [(own, dense.names, "wid", {"word": out}) for own, out in ((row, "_word"), (col, "_context"))] if isinstance(dense, Named) else []


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def cells_of(blobs: DataFrame, unpack: Step, join: Step, schema: str) -> DataFrame:
    """Cells that lie in packed rows: :func:`attach` and :func:`sums` unpack
    these in their own pass, and :func:`cut_cells` writes them packed, by
    ``join`` to fewer rows of the same columns."""
    cells = blobs.mapInArrow(unpack, schema)
    cells.packed = (blobs, unpack, join, schema)
    return cells


def cut_cells(cells: DataFrame, name: str) -> DataFrame:
    """``cut_lineage`` for cells, packed ones as they are."""
    if not is_packed(cells) or cells.packed[2] is None:
        return cut_lineage(cells, name, "zstd")
    blobs, unpack, join, schema = cells.packed
    return cells_of(cut_lineage(blobs.mapInArrow(join, blobs.schema), name), unpack, join, schema)


def is_packed(cells: DataFrame) -> bool:
    return isinstance(getattr(cells, "packed", None), tuple)


def _pass(cells: DataFrame, run: Step, schema: T.StructType | str) -> DataFrame:
    """``run`` over the cells' batches, unpacked in the same pass; what comes
    of packed cells takes further steps in that pass as well."""
    if not is_packed(cells):
        return cells.mapInArrow(run, schema)
    blobs, unpack = cells.packed[:2]
    return cells_of(blobs, lambda batches: run(unpack(batches)), None, schema)


def computed(cells: DataFrame, fields: list[T.StructField], of: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Packed cells as columns ``fields``, which ``of`` makes of a batch."""
    schema = T.StructType(fields)
    names = schema.fieldNames()
    return _pass(cells, lambda batches: (pa.RecordBatch.from_arrays(of(b), names) for b in batches), schema)


def renamed(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """These columns by their new names, in the same pass where cells are packed."""
    from pyspark.sql import functions as F

    if not is_packed(cells):
        return cells.select([F.col(own).alias(out) for own, out in names.items()])
    at = [cells.columns.index(own) for own in names]
    return computed(cells, [T.StructField(out, cells.schema[own].dataType) for own, out in names.items()], lambda b: [b.column(k) for k in at])


def sums(cells: DataFrame, key: str, val: str, out: str, squares: bool = False) -> DataFrame:
    """(key, out): the sums by key of the values, or of their ``squares``.
    Packed cells have dense ids, and each task adds its values up first."""
    from pyspark.sql import functions as F

    if not is_packed(cells):
        return cells.groupBy(key).agg(F.sum(F.col(val) * F.col(val) if squares else val).alias(out))
    at = cells.columns.index(key), cells.columns.index(val)
    whole = cells.schema[val].dataType == T.LongType()
    kind = np.int64 if whole else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(0, kind), np.zeros(0, bool)
        for batch in batches:
            ids, values = (batch.column(c).to_numpy() for c in at)
            values = values * values if squares else values
            if len(ids) and int(ids.max()) >= len(total):
                more = max(int(ids.max()) + 1, 2 * len(total)) - len(total)
                total, seen = np.r_[total, np.zeros(more, kind)], np.r_[seen, np.zeros(more, bool)]
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][:len(ids)])
            if len(first):
                total[ids[first]] += np.add.reduceat(values[order], first)
                seen[ids[first]] = True
        ids = np.flatnonzero(seen)
        for lo in range(0, len(ids), ROWS):
            some = ids[lo:lo + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], [key, out])

    return _pass(cells, run, f"`{key}` long, `{out}` {'long' if whole else 'double'}").groupBy(key).agg(F.sum(out).alias(out))


def attach(cells: DataFrame, tables: list[tuple[str, DataFrame, str, dict[str, str]]]) -> DataFrame:
    """``cells`` with columns of written tables: each entry is (the cells' id
    column, table, its id column, {its column: name in the result})."""
    kinds, plan = [], []
    for own, table, key, names in tables:
        kinds += [T.StructField(out, table.schema[n].dataType) for n, out in names.items()]
        plan.append((cells.columns.index(own), table.written_at, key, tuple(names)))
    schema = T.StructType([*cells.schema.fields, *kinds])
    labels = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for own, path, key, names in plan:
                table = held(path, key, names)
                more += [table[n].combine_chunks().take(batch.column(own)) for n in names]
            more = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in more]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], labels)

    return _pass(cells, run, schema)
