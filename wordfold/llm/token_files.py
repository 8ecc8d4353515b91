"""Token ids in Arrow files of equal-length sequences with masks.

A folder holds, for every shard of documents in ascending ``doc_id``:

* ``shard-NNNNN.arrow``: Arrow IPC file, uncompressed; ``input_ids`` is a
  fixed-size list of unsigned integers (two bytes for vocabularies up to
  65,536), ``mask`` a fixed-size list of booleans. Every record batch but the
  last has the same number of rows, so sequence ``i`` is row ``i % rows`` of
  batch ``i // rows``; a memory map gives it without copying. The last
  sequence of a shard is filled up with id 0 and mask false.
* ``shard-NNNNN.index.arrow``: ``doc_id``, ``start`` (ids of the shard before
  the document) and ``n_tokens``.

Null and empty texts have the end id alone. Rows with the same ``doc_id`` are
ordered by text; null ids come first. An empty table gives no shard. Other
columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordfold.llm import io, tokens

SEQUENCE_LENGTH = 1024
BATCH_ROWS = 1024
END_ID = 0

MANIFEST = "shard int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ShardWriter:
    """One shard; ids go to disk in batches of equal-length sequences."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int, rows: int):
        self.fs, base = io.filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{base}/shard-{shard:05d}"
        self.path = f"{folder}/shard-{shard:05d}"
        self.attempt = f"{base}/_attempt-{uuid.uuid4().hex}"
        self.length, self.rows, self.dtype = length, rows, dtype
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.kind = kind
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = self.fs.open_output_stream(self.attempt)
        self.file = pa.ipc.new_file(self.stream, self.schema)
        self.waiting, self.size = [], 0
        self.index: list[tuple[int | None, int, int]] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.index.append((doc_id, self.total, n))
        self.total += n
        self.waiting.append(ids)
        self.size += n
        if self.size >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.waiting), self.dtype)
        full = self.length * self.rows
        cut = len(values) if last else len(values) // full * full
        for lo in range(0, cut, full):
            part = values[lo : min(lo + full, cut)]
            pad = -len(part) % self.length
            ids = np.concatenate([part, np.zeros(pad, self.dtype)]) if pad else part
            mask = np.arange(len(ids)) < len(part)
            columns = [pa.array(ids, self.kind), pa.array(mask)]
            self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns], schema=self.schema))
        self.waiting, self.size = [values[cut:].tobytes()], len(values) - cut

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self.file.close()
        self.stream.close()
        ids, starts, sizes = zip(*self.index, strict=True)
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        with self.fs.open_output_stream(f"{self.attempt}.index") as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index)
        # a repeated attempt writes the same bytes, so the last move may win
        self.fs.move(self.attempt, f"{self.name}.arrow")
        self.fs.move(f"{self.attempt}.index", f"{self.name}.index.arrow")
        return self.path, len(ids), self.total


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, length: int = SEQUENCE_LENGTH, rows: int = BATCH_ROWS, end_id: int = END_ID) -> DataFrame:
    """Encode all texts into ``folder``; returns the shards (``MANIFEST``).

    The texts are range-partitioned by ``doc_id`` and each task writes the
    shard of its range as it encodes, so ids are never shuffled or held."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = io.arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        end = np.array([end_id], encoder.dtype).tobytes()
        shard, out = io.task_id(), None
        for piece in io.slices(batches, "text"):
            out = out or ShardWriter(folder, shard, encoder.dtype, length, rows)
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                out.add(doc_id, encoder.encode(text) + end)
        if out:
            yield pa.record_batch([[x] for x in (shard, *out.close())], schema=schema)

    return io.written(ordered.mapInArrow(write, MANIFEST), "token-shards")


class ShardReader:
    """Random access to the sequences and documents of one shard."""

    def __init__(self, path: str):
        self.fs, base = io.filesystem(path)
        local = self.fs.type_name == "local"
        self.source = pa.memory_map(f"{base}.arrow") if local else self.fs.open_input_file(f"{base}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("input_ids").type.list_size
        with self.fs.open_input_file(f"{base}.index.arrow") as index:
            self.index = pa.ipc.open_file(index).read_all()
        self.rows = self.file.get_batch(0).num_rows
        self._batch: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``i``; the ids are a view of the file."""
        batch = self.file.get_batch(i // self.rows)
        lo = i % self.rows * self.length
        ids = batch.column(0).flatten().to_numpy()
        mask = batch.column(1).flatten().slice(lo, self.length).to_numpy(zero_copy_only=False)
        return ids[lo : lo + self.length], mask

    def spans(self, start: int, size: int) -> Iterator[np.ndarray]:
        """Views of the ids [start, start + size) of the shard."""
        full = self.rows * self.length
        while size > 0:
            number, lo = divmod(start, full)
            if self._batch[0] != number:
                self._batch = (number, self.file.get_batch(number).column(0).flatten().to_numpy())
            part = self._batch[1][lo : lo + size]
            yield part
            start, size = start + len(part), size - len(part)

    def close(self) -> None:
        self._batch = (-1, np.zeros(0))
        self.source.close()


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of the shards as the files hold it: ``doc_id``, the ids
    before it, their number and the CRC of its ids as 32-bit integers."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    shards = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    shards = shards.select("shard", "path", "base").repartitionByRange(max(1, manifest.count()), "shard")
    schema = io.arrow_schema(DOCUMENTS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            shard = ShardReader(row["path"])
            starts, sizes = shard.index["start"].to_numpy(), shard.index["n_tokens"].to_numpy()
            crcs = np.zeros(len(starts), np.int64)
            for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
                crc = 0
                for part in shard.spans(start, size):
                    crc = zlib.crc32(part.astype("<u4"), crc)
                crcs[i] = crc
            ids = shard.index["doc_id"].combine_chunks()
            shard.close()
            yield pa.record_batch([ids, pa.array(starts + row["base"]), pa.array(sizes), pa.array(crcs)], schema=schema)

    return shards.mapInArrow(read, DOCUMENTS)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(io.documents(spark, sf_dir), io.shared_dir(spark, "token-files"))
    return read_documents(manifest)
