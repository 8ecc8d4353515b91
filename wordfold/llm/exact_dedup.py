"""Exact deduplication by recursive (Grace) hash partitioning.

1. Each task numbers its rows and keeps an open-addressing table of the texts
   it has met (cleared at a byte limit). A text's first row in the table is an
   *entry*; later copies refer to it. The rows are written once, so numbering
   is the same for every reader.
2. Only entries move: they are partitioned by hash into buckets. A bucket
   whose different texts exceed the limit is partitioned again by other bits
   of the hash, and so on; the parts are shuffle files, which Spark spills and
   restores.
3. A task streams a bucket through an open-addressing table that compares
   whole contents, so equal hashes of different texts stay apart.
4. Entries get the totals of their class and rows take them from their entry:
   every join key is (task, entry), so a text that a third of all rows share
   is no hot key and its copies never meet in one task.

Null text counts as empty. Of equal texts the row with the largest ``doc_id``
stays; null ids are smallest, and among rows with one ``doc_id`` the last read
stays. An empty table gives no rows. Other columns pass through in ``doc``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordfold.llm import io
from wordfold.session import discard, size_bounded_broadcast

#: Bytes of different texts that one table may hold.
TABLE_BYTES = 32 << 20
#: Parts into which a bucket that is too large is split.
FAN_OUT = 64
LEVELS = 8


def content_hash(content: bytes) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(content)
    return h - (1 << 64) if h >> 63 else h


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry's number,
    and a match needs the same hash and the same content."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _slot(self, h: int, content: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (n := self.slots[at]) >= 0:
            if content is not None and self.hashes[n] == h and self.contents[n] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, h: int, content: bytes) -> tuple[int, bool]:
        """(entry, whether it is new)."""
        at = self._slot(h, content)
        if self.slots[at] >= 0:
            return self.slots[at], False
        n = self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, other in enumerate(self.hashes):
                self.slots[self._slot(other, None)] = i
        return n, True


def number_rows(docs: DataFrame, hashed: Callable[[bytes], int] = content_hash, limit: int = TABLE_BYTES) -> DataFrame:
    """``doc`` (the input row) with ``part, row``, the ``entry`` it is a copy
    of in its task, the text's ``hash`` and whether it is the ``first``."""
    kinds = [("part", T.IntegerType()), ("row", T.LongType()), ("entry", T.LongType()), ("hash", T.LongType()), ("first", T.BooleanType()), ("doc", docs.schema)]
    numbers = io.arrow_schema("part int, row long, entry long, hash long, first boolean")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, table, entries = io.task_id(), 0, ContentTable(), []
        for batch in batches:
            out = []
            for text in batch.column(0).field("text"):
                content = text.as_buffer().to_pybytes() if text.is_valid else b""
                h = hashed(content)
                n, new = table.add(h, content)
                if new:
                    entries.append(row)
                out.append((part, row, entries[n], h, new))
                row += 1
                if table.bytes > limit:
                    table.clear()
                    entries = []
            columns = zip(*out, strict=True) if out else [[]] * 5
            arrays = [pa.array(c, f.type) for c, f in zip(columns, numbers, strict=True)]
            yield pa.record_batch([*arrays, batch.column(0)], names=[*numbers.names, "doc"])

    wrapped = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    return io.written(wrapped.mapInArrow(number, T.StructType([T.StructField(*k) for k in kinds])), "dedup-rows")


def bucketed(entries: DataFrame, limit: int) -> DataFrame:
    """``entries`` with ``bucket``, split until each bucket's different texts
    fit the limit (or all have one hash)."""
    sizes = io.written(entries.groupBy("hash").agg(F.max("bytes").alias("bytes")), "dedup-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    first = max(4 * io.shuffle_partitions(entries.sparkSession), 2 * total // limit)
    bucket = F.pmod("hash", F.lit(first))
    entries, sizes = entries.withColumn("bucket", bucket), sizes.withColumn("bucket", bucket)
    for level in range(1, LEVELS + 1):
        large = sizes.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).filter(f"b > {limit} and n > 1")
        large = io.written(large.select("bucket", F.lit(True).alias("large")), "dedup-large")
        if large.isEmpty():
            break
        part = F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(FAN_OUT)) + 1
        split = F.when(F.col("large"), F.col("bucket") * (FAN_OUT + 1) + part + first * level).otherwise(F.col("bucket"))
        entries = entries.join(size_bounded_broadcast(large, 100_000), "bucket", "left").withColumn("bucket", split).drop("large")
        sizes = sizes.join(size_bounded_broadcast(large, 100_000), "bucket", "left").withColumn("bucket", split).drop("large")
    return entries


CLASSES = "part int, entry long, class_part int, class_entry long, text_sha256 string"


def classes(rows: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """The class of every entry: the first entry with the same content."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    entries = rows.filter("first").select("part", "entry", "hash", text.alias("text"), F.octet_length(text).cast("long").alias("bytes"))
    schema = io.arrow_schema(CLASSES)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table, found = None, ContentTable(), []
        for batch in batches:
            out = []
            ids = (batch.column(c).to_pylist() for c in ("part", "entry", "hash", "bucket"))
            for part, entry, h, where, text in zip(*ids, batch.column("text"), strict=True):
                if where != bucket:
                    bucket, found = where, []
                    table.clear()
                content = text.as_buffer().to_pybytes()
                n, new = table.add(h, content)
                if new:
                    found.append((part, entry, hashlib.sha256(content).hexdigest()))
                out.append((part, entry, *found[n]))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ordered = bucketed(entries, limit).drop("bytes").repartition("bucket").sortWithinPartitions("bucket")
    return io.written(ordered.mapInArrow(match, CLASSES), "dedup-classes")


def dedup_rows(docs: DataFrame, hashed: Callable[[bytes], int] = content_hash, limit: int = TABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(numbered rows, decisions): a decision per row has ``part, row, doc_id,
    keep_id, group_size, kept, text_sha256``."""
    rows = number_rows(docs, hashed, limit)
    small = rows.select("part", "row", "entry", F.col("doc.doc_id").alias("doc_id"))
    of_entry = classes(rows, limit)
    last = F.max(F.struct("doc_id", "part", "row"))
    totals = small.groupBy("part", "entry").agg(F.count("*").alias("n"), last.alias("last")).join(of_entry, ["part", "entry"])
    of_class = totals.groupBy("class_part", "class_entry").agg(F.sum("n").alias("group_size"), F.max("last").alias("keep"))
    decided = of_entry.join(of_class, ["class_part", "class_entry"]).select("part", "entry", "keep", "group_size", "text_sha256")
    kept = (F.col("keep.part") == F.col("part")) & (F.col("keep.row") == F.col("row"))
    decisions = small.join(decided, ["part", "entry"]).select("part", "row", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
    return rows, decisions


def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    with io.recorded() as tables:
        rows, decisions = dedup_rows(docs)
        dropped = io.written(decisions.filter("not kept").select("part", "row"), "dedup-dropped")
    discard(*(t for t in tables if t is not rows and t is not dropped))
    return rows.join(size_bounded_broadcast(dropped, 500_000), ["part", "row"], "left_anti").select("doc.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.spread(io.documents(spark, sf_dir).select("doc_id", "text"))
    return dedup_rows(docs)[1].drop("part", "row")


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
