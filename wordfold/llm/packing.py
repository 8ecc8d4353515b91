"""Packing documents into fixed windows by non-negative least squares.

Every document is cut into full windows and one remainder. The remainders'
lengths form a histogram of at most ``window - 1`` counts. All combinations of
two or three lengths that fill a window exactly are enumerated; repeat counts
``x >= 0`` minimising ``|A x - histogram|`` come from cyclic coordinate descent
on the normal equations, are rounded to what the histogram holds, and what is
left over is combined greedily, largest first. Remainders that still have no
partner are laid end to end and cut at window borders. So only the last
sequence has padding.

Only the histogram and the plan (rows of ``length, ranks -> sequence, offset``,
at most a few per combination used) pass through the driver; both are bounded
by the window. Documents find their place from their rank among remainders of
the same length, counted within the task that encoded them plus an offset per
(task, length), so a length that a third of all documents share is no hot key.

Null and empty texts have the end id alone. Rows with equal ``doc_id`` are
documents of their own. An empty table gives no row. Other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordfold.llm import io, tokens
from wordfold.session import size_bounded_broadcast

WINDOW = 1024
END_ID = 0
#: Combinations of three lengths tried at most; wider windows take every
#: n-th smallest length instead of all of them.
TRIPLES = 200_000

TOKENS = "part int, row long, doc_id long, n_tokens long, n_full long, rem int, full_rank long, rem_rank long, crcs array<long>, ids binary"
PLAN = "rem int, from_rank long, to_rank long, first_sequence long, place int"


def encode_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Ids of every document with ranks inside its task; written once."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    schema = io.arrow_schema(TOKENS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        end = np.array([end_id], encoder.dtype).tobytes()
        part, row, fulls, seen = io.task_id(), 0, 0, Counter()
        for piece in io.slices(batches, "text"):
            out = []
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encoder.encode(text) + end, encoder.dtype).astype("<u4")
                n_full, rem = divmod(len(ids), window)
                crcs = [zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, len(ids), window)]
                out.append((part, row, doc_id, len(ids), n_full, rem, fulls, seen[rem], crcs, ids.astype(encoder.dtype).tobytes()))
                row, fulls = row + 1, fulls + n_full
                seen[rem] += 1
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return io.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, TOKENS), "packing-tokens")


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Two or three of the lengths (repeats allowed) that sum to the window."""
    there = set(lengths)
    pairs = [(a, window - a) for a in lengths if 2 * a <= window and window - a in there]
    low = [a for a in lengths if 3 * a <= window]
    stride = max(1, len(low) * len(lengths) // (2 * TRIPLES) + 1) if len(low) * len(lengths) > 2 * TRIPLES else 1
    triples = [(a, b, window - a - b) for a in low[::stride] for b in lengths if a <= b and 2 * b <= window - a and window - a - b in there]
    return pairs + triples


def repeat_counts(histogram: dict[int, int], window: int, sweeps: int = 25, least_change: float = 0.02) -> dict[tuple[int, ...], float]:
    """Non-negative least squares by coordinate descent over combinations."""
    left = {a: float(n) for a, n in histogram.items()}
    columns = [(c, list(Counter(c).items())) for c in combinations(sorted(histogram), window)]
    norms = [sum(m * m for _, m in parts) for _, parts in columns]
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        change = 0.0
        for j, (_, parts) in enumerate(columns):
            step = 0.0
            for a, m in parts:
                step += m * left[a]
            step /= norms[j]
            new = x[j] + step
            if new < 0.0:
                new, step = 0.0, -x[j]
            if step:
                x[j] = new
                for a, m in parts:
                    left[a] -= m * step
                change = max(change, abs(step))
        if change < least_change:
            break
    return {c: n for (c, _), n in zip(columns, x, strict=True) if n > 0}


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(rows of ``PLAN``, number of sequences) for a histogram of remainders.

    Ranks of a length that no row covers are left for ``end to end`` packing."""
    available = Counter(histogram)
    used: Counter = Counter()
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(combination: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        times = min(times, *(available[a] // m for a, m in Counter(combination).items()))
        if times <= 0:
            return
        place = 0
        for a in combination:
            rows.append((a, used[a], used[a] + times, sequences, place))
            used[a] += times
            available[a] -= times
            place += a
        sequences += times

    for combination, times in sorted(repeat_counts(histogram, window).items(), key=lambda c: (-c[1], c[0])):
        take(combination, int(times + 0.5))
    for a in sorted(histogram, reverse=True):  # greedily, the largest first
        if available[a]:
            take((a, window - a), available[a])
        for b in range(min(a, window - a - 1), 0, -1):
            if not available[a]:
                break
            if available[b] and available[window - a - b]:
                take((a, b, window - a - b), available[a])
    return rows, sequences


def pack(encoded: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and the key ``part, row`` of its document."""
    spark = encoded.sparkSession
    small = encoded.drop("ids")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that encoded
    fulls = encoded.groupBy("part").agg(F.sum("n_full").alias("n")).select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("full_base"), "n")
    n_full = encoded.agg(F.coalesce(F.sum("n_full"), F.lit(0))).first()[0]
    counts = io.written(encoded.filter("rem > 0").groupBy("rem", "part").count(), "packing-counts")
    histogram = {r["rem"]: r["n"] for r in counts.groupBy("rem").agg(F.sum("count").alias("n")).collect()}  # below `window` rows
    rows, n_planned = plan(histogram, window)

    before = Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("rem", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rem_base"))
    placed = (
        small.join(fulls.drop("n"), "part")
        .join(bases, ["part", "rem"], "left")
        .withColumn("rank", F.col("rem_base") + F.col("rem_rank"))
        .join(F.broadcast(spark.createDataFrame(rows, PLAN).withColumnRenamed("rem", "of")), (F.col("rem") == F.col("of")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")), "left")
    )
    placed = io.written(placed.select("part", "row", "doc_id", "n_tokens", "n_full", "rem", "crcs", F.expr("full_base + full_rank").alias("first_full"), F.expr(f"{n_full} + first_sequence + rank - from_rank").alias("sequence_id"), "place"), "packing-placed")

    whole = placed.select("part", "row", "doc_id", "n_tokens", "n_full", "rem", "first_full", "sequence_id", "place", F.posexplode("crcs").alias("i", "crc"))
    whole = whole.filter("i < n_full or sequence_id is not null").select(
        "part", "row", "doc_id",
        F.expr(f"cast(i as long) * {window}").alias("start"),
        F.expr(f"if(i < n_full, {window}L, cast(rem as long))").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("n_tokens").alias("doc_tokens"),
        F.expr("if(i < n_full, first_full + i, sequence_id)").alias("sequence_id"),
        F.expr("if(i < n_full, 0L, cast(place as long))").alias("offset"),
    )

    # the rest is laid end to end: a running sum in each part, after the parts before it
    rest = placed.filter("rem > 0 and sequence_id is null").select("part", "row", "doc_id", "n_tokens", F.col("rem").cast("long").alias("rem"), F.expr("n_full * %d" % window).alias("start"), F.element_at("crcs", -1).alias("crc"))
    parts = rest.groupBy("part").agg(F.sum("rem").alias("n")).select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("base"))
    running = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("at", F.coalesce(F.sum("rem").over(running), F.lit(0))).join(parts, "part").withColumn("at", F.col("at") + F.col("base"))
    room = F.least(F.col("rem"), F.expr(f"{window} - at % {window}"))
    rest = rest.withColumn("head", room).withColumn("piece", F.explode(F.expr("if(head < rem, array(0, 1), array(0))")))
    rest = rest.select(
        "part", "row", "doc_id",
        F.expr("start + piece * head").alias("start"),
        F.expr("if(piece = 0, head, rem - head)").alias("length"),
        F.expr("if(head = rem, crc, null)").alias("ids_crc32"),
        F.col("n_tokens").alias("doc_tokens"),
        F.expr(f"{n_full + n_planned} + (at + piece * head) div {window}").alias("sequence_id"),
        F.expr(f"(at + piece * head) % {window}").alias("offset"),
    )
    rest = io.written(rest, "packing-rest")
    cut = with_ids(rest.filter("ids_crc32 is null").drop("ids_crc32"), encoded).drop("ids")
    return whole.unionByName(rest.filter("ids_crc32 is not null")).unionByName(cut.select(whole.columns))


def with_ids(pieces: DataFrame, encoded: DataFrame) -> DataFrame:
    """The pieces with their ids (little-endian 32-bit binary) and CRC."""
    keyed = pieces.withColumnRenamed("doc_id", "piece_doc")
    joined = encoded.select("part", "row", "ids", "n_tokens").join(size_bounded_broadcast(keyed, 500_000), ["part", "row"])
    joined = joined.withColumnRenamed("piece_doc", "doc_id").drop("part_", "row_")
    ids_at = joined.schema.names.index("ids")
    out = "part int, row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    schema = io.arrow_schema(out)

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, crcs = [], []
            for ids, n, start, length in zip(batch.column(ids_at).to_pylist(), *(batch.column(c).to_pylist() for c in ("n_tokens", "start", "length")), strict=True):
                width = len(ids) // n
                part = np.frombuffer(ids, f"<u{width}")[start : start + length].astype("<u4").tobytes()
                cuts.append(part)
                crcs.append(zlib.crc32(part))
            made = {"ids": pa.array(cuts, pa.binary()), "ids_crc32": pa.array(crcs, pa.int64())}
            yield pa.record_batch([made[f.name] if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    return joined.mapInArrow(attach, out)


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with digests, as query and pipeline give them."""
    return pack(encode_documents(docs)).drop("part", "row")


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(io.spread(io.documents(spark, sf_dir)))
