"""Tables, shared folders and blocks of documents for the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.session import checkpoint_dir, shuffles_dropped

#: Bytes of text that numpy works on at once inside a task.
SLICE_BYTES = 2 << 20

_recorded: ContextVar[list | None] = ContextVar("recorded", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that are ``written`` inside, to be dropped (``discard``)
    once nothing reads them any more."""
    tables: list[DataFrame] = []
    token = _recorded.set(tables)
    try:
        yield tables
    finally:
        _recorded.reset(token)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back (survives lost
    executors; every later reader sees the same rows)."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path  # for session.discard
    if (tables := _recorded.get()) is not None:
        tables.append(out)
    return out


def numbered(docs: DataFrame, name: str, stored: bool = False) -> DataFrame:
    """``doc`` (the input row) and ``place``, a number of its own that every
    reader sees. ``stored``: ``docs`` are the rows of Parquet files, whose
    places in them serve; others are written first."""
    doc = F.struct("*").alias("doc")
    try:
        rows = docs.select(doc, "_metadata.file_path", "_metadata.row_index") if stored else None
    except AnalysisException:
        rows = None
    if rows is None:
        return written(docs.select(doc, F.monotonically_increasing_id().alias("place")), name)
    paths = sorted(r["file_path"] for r in rows.select("file_path").distinct().collect())
    files = docs.sparkSession.createDataFrame([(x, n << 40) for n, x in enumerate(paths)], "file_path string, file long")
    return rows.join(F.broadcast(files), "file_path").select("doc", (F.col("file") + F.col("row_index")).alias("place"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(path: str):
    """(pyarrow filesystem, path inside it) for a local path or any URI."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``limit`` bytes of the
    text column (a longer text is a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            yield batch.slice(int(lo), int(hi - lo))


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows again in pieces that hold about ``limit`` bytes of the text
    column, whatever the batches' sizes."""
    held, waiting = 0, []
    for piece in slices(batches, column, limit):
        held += int(pc.sum(pc.binary_length(piece.column(column))).as_py() or 0)
        waiting.append(piece)
        if held >= limit:
            yield pa.concat_batches(waiting)
            held, waiting = 0, []
    if waiting:
        yield pa.concat_batches(waiting)


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string made of the types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def spread(df: DataFrame) -> DataFrame:
    """A scan of one small file becomes a partition per core."""
    from wordfold.session import spread_input

    return spread_input(df)


def task_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0

