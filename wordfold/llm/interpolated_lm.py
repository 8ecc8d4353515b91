"""N-gram language model by deleted interpolation.

``P_k(w | context) = L ML_k + (1 - L) P_(k-1)`` where ``ML_k`` is the relative
frequency of ``w`` after its last ``k - 1`` tokens in the training texts and
``L`` depends on the order and on the context's frequency (a bucket for every
power of two). The lowest order is the word's relative frequency with half a
count added to each word and to one unknown word. Contexts that training
never met leave the lower order.

The weights come from expectation-maximisation on held-out counts: a fold of
the training texts is deleted from the counts and its tokens are predicted by
the rest. A bucket's likelihood depends on a token only through the ratio
``ML_k / P_(k-1)``, so the fold is gathered as a histogram of ratios (16 bins
an octave, with their means), and the iterations run on that.

Counts stay in the cluster: blocks of texts ask for the counts of their
different n-grams, one request an n-gram and block, which also carries the
block's own count; the answer brings the sum. N-grams are identified by
64-bit hashes.

Null and empty texts are one end token. A token is a run without ASCII white
space, A-Z lower-cased; each text ends in one end token. Rows with null or
repeated ``doc_id`` are texts of their own (null ids train: they have no
remainder). An empty table gives no rows; without training rows all
probabilities are those of no counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import hashing, io
from wordfold.llm.blocks import NO_ID, Block, make_blocks, packed, packed_sorted, unpacked, unpacked_sorted
from wordfold.llm.hashing import U, mix

ORDER = 2
BLOCK_BYTES = 16 << 20
#: Kinds of texts: counted only, counted and in the deleted fold, not counted.
TRAIN, FOLD, HELD_OUT = 0, 1, 2

END, START = U(0x3C79AC492BA7B653), U(0x1C69B3F74AC4AE35)

#: Ratios: bins an octave, octaves below 1, all bins.
BINS, BELOW, N_BINS = 16, 24, 16 * 88
CONTEXTS = 64

REQUESTS = "bucket int, level int, block long, kind int, keys binary, counts binary"
ANSWERS = "level int, bucket int, block long, kind int, counts binary, fold binary, tokens long, types long, fold_tokens long, rest_types long"
RATIOS = "context int, bin int, n long, total double"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Grams:
    """Keys of the n-grams that end at each token of a block."""

    def __init__(self, block: Block, order: int):
        words, docs = [], []
        for lo, hi in block.parts():
            base = block.offsets[lo]
            data, offsets = block.data[base : block.offsets[hi]], block.offsets[lo : hi + 1] - base
            start, end, doc = hashing.word_bounds(data, offsets)
            words.append(hashing.span_hashes(data, start, end))
            docs.append(doc + lo)
        n = len(block.sizes)
        words, doc = np.concatenate([np.zeros(0, U), *words]), np.concatenate([np.zeros(0, np.int64), *docs])
        self.sizes = np.bincount(doc, minlength=n) + 1
        self.ends = np.cumsum(self.sizes) - 1
        self.begins = self.ends - self.sizes + 1
        tokens = np.full(len(words) + n, END)
        tokens[np.arange(len(words)) + doc] = words
        self.keys = [tokens]
        before = START
        for _ in range(1, order):
            self.keys.append(mix(self.shift(self.keys[-1], before) * U(3) + tokens))
            before = mix(np.array([before * U(3) + START]))[0]

    def shift(self, x: np.ndarray, at_start) -> np.ndarray:
        """The value of the token before, ``at_start`` for a text's first."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.begins] = at_start
        return out


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    where = ((keys >> U(32)) * U(buckets)) >> U(32)
    return np.searchsorted(where, np.arange(buckets + 1).astype(U))


def requests(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    schema = io.arrow_schema(REQUESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            grams = Grams(Block(row["ids"], row["sizes"], row["texts"]), order)
            for level, keys in enumerate(grams.keys, 1):
                keys, counts = np.unique(keys, return_counts=True)
                if row["kind"] == HELD_OUT:
                    counts = np.zeros(len(keys), np.int64)
                cuts = bucket_cuts(keys, buckets)
                rows = [(b, level, row["block"], row["kind"], packed_sorted(keys[cuts[b] : cuts[b + 1]]), packed(counts[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts)).tolist()]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, REQUESTS)


def answer(table: pa.Table) -> pa.Table:
    """The training counts that each request of a bucket asks for, those of
    the fold too if the request comes from it, and the bucket's totals."""
    rows = table.to_pylist()
    asked = [unpacked_sorted(r["keys"], U) for r in rows]
    every = np.concatenate(asked)
    own = np.concatenate([unpacked(r["counts"], np.int64) for r in rows])
    fold = np.repeat([r["kind"] == FOLD for r in rows], [len(a) for a in asked])
    order = np.argsort(every)
    ordered, own, fold = every[order], own[order], fold[order]
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    total, deleted = np.add.reduceat(own, head), np.add.reduceat(own * fold, head)
    number = np.empty(len(every), np.int64)
    number[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(every)]))
    out, lo = [], 0
    level, bucket = rows[0]["level"], rows[0]["bucket"]
    for r, a in zip(rows, asked, strict=True):
        mine = number[lo : lo + len(a)]
        lo += len(a)
        out.append((level, bucket, r["block"], r["kind"], packed(total[mine]), packed(deleted[mine]) if r["kind"] == FOLD else None, 0, 0, 0, 0))
    out.append((level, bucket, -1, -1, None, None, int(total.sum()), int((total > 0).sum()), int(deleted.sum()), int((total > deleted).sum())))
    return pa.table([pa.array([o[k] for o in out], f.type) for k, f in enumerate(io.arrow_schema(ANSWERS))], schema=io.arrow_schema(ANSWERS))


class Mixture:
    """Probabilities from counts: ``weights[k]`` for order ``k + 2``, by the
    power of two of the context's frequency."""

    def __init__(self, tokens: int, types: int, texts: int, weights: list[np.ndarray]):
        self.tokens, self.types, self.texts, self.weights = tokens, types, texts, weights

    def lowest(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def relative(self, grams: Grams, counts: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(relative frequency after the context, the context's frequency) for
        n-grams of ``k + 1`` tokens. A context is an n-gram of ``k`` tokens;
        every one that ends in a word has a token after it."""
        context = grams.shift(counts[k - 1], self.texts)
        return counts[k] / np.maximum(context, 1), context

    def probability(self, grams: Grams, counts: list[np.ndarray], orders: int) -> np.ndarray:
        p = self.lowest(counts[0])
        for k in range(1, orders):
            ml, context = self.relative(grams, counts, k)
            weight = np.where(context > 0, self.weights[k - 1][context_class(context)], 0.0)
            p = weight * ml + (1 - weight) * p
        return p


def context_class(frequency: np.ndarray) -> np.ndarray:
    """The power of two of a frequency."""
    return np.frexp(np.maximum(frequency, 1).astype(float))[1] - 1


def answered(row: dict, grams: Grams, column: str) -> list[np.ndarray]:
    """The counts of the n-grams at each token, by order."""
    out = []
    for level, keys in enumerate(grams.keys, 1):
        parts = sorted((a["bucket"], a[column]) for a in row["answers"] if a["level"] == level)
        counts = np.concatenate([np.zeros(0, np.int64), *[unpacked(p, np.int64) for _, p in parts]])
        out.append(counts[np.unique(keys, return_inverse=True)[1]])
    return out


def ratio_histogram(blocks: DataFrame, order: int, k: int, known: Mixture) -> DataFrame:
    """Rows of ``RATIOS``: tokens of the deleted fold by the class of their
    context and the ratio of order ``k + 1`` to the orders below."""
    schema = io.arrow_schema(RATIOS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            grams = Grams(Block(row["ids"], row["sizes"], row["texts"]), order)
            rest = [c - f for c, f in zip(answered(row, grams, "counts"), answered(row, grams, "fold"), strict=True)]
            ml, context = known.relative(grams, rest, k)
            ratio = ml / known.probability(grams, rest, k)
            seen = context > 0
            place = np.zeros(len(ratio), np.int64)
            more = ratio > 0
            place[more] = 1 + np.clip((np.log2(ratio[more]) + BELOW) * BINS, 0, N_BINS - 2).astype(np.int64)
            cell = (context_class(context) * N_BINS + place)[seen]
            n = np.bincount(cell, minlength=CONTEXTS * N_BINS)
            total = np.bincount(cell, ratio[seen], CONTEXTS * N_BINS)
            cells = np.flatnonzero(n)
            columns = [(cells // N_BINS).astype(np.int32), (cells % N_BINS).astype(np.int32), n[cells], total[cells]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, RATIOS).groupBy("context", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def learn_weights(cells: list[tuple[int, int, int, float]], iterations: int = 200) -> np.ndarray:
    """Expectation-maximisation by context class, from the ratio histogram
    (at most ``CONTEXTS * N_BINS`` cells). Classes that the fold never met
    take the weight of the nearest class below, or above."""

    def maximise(n: np.ndarray, ratio: np.ndarray) -> float:
        weight = 0.5
        for _ in range(iterations):
            new = float((n * (weight * ratio / (weight * ratio + 1 - weight))).sum() / n.sum())
            new = min(max(new, 1e-6), 1 - 1e-6)
            if abs(new - weight) < 1e-9:
                break
            weight = new
        return weight

    weights = np.full(CONTEXTS, np.nan)
    for context in {c for c, *_ in cells}:
        n, total = (np.array([float(x[i]) for x in cells if x[0] == context]) for i in (2, 3))
        weights[context] = maximise(n, total / n)
    met = np.flatnonzero(~np.isnan(weights))
    if not len(met):
        return np.zeros(CONTEXTS)
    below = np.searchsorted(met, np.arange(CONTEXTS), "right") - 1
    return weights[met[np.maximum(below, 0)]]


def score_blocks(blocks: DataFrame, order: int, model: Mixture) -> DataFrame:
    schema = io.arrow_schema(SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row["ids"], row["sizes"], row["texts"])
            grams = Grams(block, order)
            counts = answered(row, grams, "counts")
            base = np.add.reduceat(np.log10(model.lowest(counts[0])), grams.begins)
            score = np.add.reduceat(np.log10(model.probability(grams, counts, order)), grams.begins)
            known = np.add.reduceat((counts[0] > 0).astype(np.int64), grams.begins)
            n = len(block.ids)
            columns = [pa.array(block.ids, mask=block.ids == NO_ID), pa.array(np.full(n, row["kind"] == HELD_OUT)), pa.array(grams.sizes), pa.array(known), pa.array(np.full(n, model.tokens)), pa.array(base), pa.array(score)]
            yield pa.record_batch(columns, schema=schema)

    return blocks.mapInArrow(run, SCORES)


def score(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``SCORES`` from ``doc_id, text, kind``."""
    buckets = 4 * io.shuffle_partitions(docs.sparkSession)
    blocks = make_blocks(docs, block_bytes, F.col("kind"))
    answers = io.written(requests(blocks, order, buckets).groupBy("level", "bucket").applyInArrow(answer, ANSWERS), "lm-answers", "uncompressed")
    totals = answers.filter("block = -1 and level = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "fold_tokens", "rest_types")]).first()
    tokens, types, fold_tokens, rest_types = totals
    texts, fold_texts = docs.agg(F.count(F.when(F.col("kind") != HELD_OUT, 1)), F.count(F.when(F.col("kind") == FOLD, 1))).first()
    by_block = answers.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "counts", "fold")).alias("answers"))

    weights: list[np.ndarray] = []
    fold = answers.filter(f"kind = {FOLD}").groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "counts", "fold")).alias("answers"))
    fold = blocks.filter(f"kind = {FOLD}").join(fold, "block")
    for k in range(1, order):
        rest = Mixture(tokens - fold_tokens, rest_types, texts - fold_texts, list(weights))
        cells = ratio_histogram(fold, order, k, rest).collect()  # bounded by CONTEXTS * N_BINS
        weights.append(learn_weights([tuple(c) for c in cells]))
    return score_blocks(blocks.join(by_block, "block"), order, Mixture(tokens, types, texts, weights))


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.spread(io.documents(spark, sf_dir).select("doc_id", "text"))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    kind = F.when(remainder == 1, HELD_OUT).when(remainder == 0, FOLD).otherwise(TRAIN)
    return score(docs.withColumn("kind", kind.cast("int")))
