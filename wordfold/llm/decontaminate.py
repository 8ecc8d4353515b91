"""Benchmark decontamination by SimHash over windows of an item's length.

For every benchmark item of ``n`` words, documents are read in windows of
``n`` words; a document of fewer words is one window of all its words. A
window's 64-bit SimHash (over its shingles of five words, each
weighted by how often it occurs) is looked up in a multi-index: fingerprints
are cut into eight blocks of eight bits, and since ``RADIUS < 3 * 8``, two
fingerprints within the radius differ by at most two bits in some block; the
index lists all such block values, so none is missed. Candidates are verified
by the exact weighted Jaccard similarity of their shingles. Windows that
share no shingle with any item of their length can't be similar and get no
fingerprint.

At similarity 0.8 fingerprints differ by 10 bits on average; the radius of 23
leaves out fewer than one window in ten thousand.

Words are runs of ASCII letters and digits and of all other non-ASCII
characters, lower-cased (A-Z and Latin-1 letters). Items of fewer than five
words are one shingle of all their words; items without words match nothing.
Null texts count as empty. Repeated items and rows give a result each; equal
similarities: the first window. Empty tables give no rows. Other columns are
ignored.

The items are sent to the tasks in blocks of bounded size; each block reads
all documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import hashing, io
from wordfold.llm.hashing import U
from wordfold.session import size_bounded_broadcast

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
#: Bytes of item texts sent to the tasks at once.
ITEM_BYTES = 8 << 20
#: Windows that get fingerprints at once.
WINDOWS = 2048

LEAKS = "doc_id long, item_id long, similarity double, first_word long, n_words long"

SEPARATORS = np.ones(256, bool)
SEPARATORS[128:] = False
for _low, _high in ((b"0", b"9"), (b"A", b"Z"), (b"a", b"z")):
    SEPARATORS[_low[0] : _high[0] + 1] = False


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(word hashes, document of each, documents)."""
    data, offsets = io.text_arrays(column)
    if len(data) > 1:  # Latin-1 capitals are 0xC3 and 0x80 to 0x9E but for the multiplication sign
        data = data.copy()
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
    start, end, doc = hashing.word_bounds(data, offsets, SEPARATORS)
    return hashing.span_hashes(data, start, end), doc, len(offsets) - 1


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes, as eight bytes a row."""
    n, m = shingles.shape
    bits = np.unpackbits(np.ascontiguousarray(shingles.T).view(np.uint8).reshape(m, n, 8), axis=2)
    ones = np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(2 * ones >= m, axis=1)


#: Block values within two bits of each value, as a 256 x 256 table.
NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= RADIUS // 8


class Items:
    """Benchmark items by number of words, with their multi-index."""

    def __init__(self, items: tuple[tuple[int, str], ...]):
        found, doc, n = words(pa.array([t for _, t in items], pa.large_string()))
        self.by_length: dict[int, list[tuple[int, Counter, np.ndarray]]] = defaultdict(list)
        ends = np.cumsum(np.bincount(doc, minlength=n))
        for (item_id, _), hi, size in zip(items, ends, np.bincount(doc, minlength=n), strict=True):
            if size:
                grams = self.grams(found[hi - size : hi])
                self.by_length[int(size)].append((item_id, Counter(grams.tolist()), grams))
        self.index = {}
        for length, group in self.by_length.items():
            prints = np.concatenate([fingerprints(g[None]) for _, _, g in group])
            # near[block][value]: the items that have a block value within two bits
            near = np.stack([NEAR[:, prints[:, b]] for b in range(8)])
            self.index[length] = (prints, near)
        # shingle -> lengths, by size of shingle
        self.lengths: dict[int, tuple[np.ndarray, list[list[int]], np.ndarray]] = {}
        for k in {min(SHINGLE, length) for length in self.by_length}:
            of = defaultdict(set)
            for length, group in self.by_length.items():
                if min(SHINGLE, length) == k:
                    for g in {g for _, counts, _ in group for g in counts}:
                        of[g].add(length)
            known = np.array(sorted(of), U)
            some = np.zeros(1 << 20, bool)
            some[known >> U(44)] = True
            self.lengths[k] = (known, [sorted(of[g]) for g in known.tolist()], some)

    @staticmethod
    def grams(found: np.ndarray) -> np.ndarray:
        k = min(SHINGLE, len(found))
        return hashing.shingles(found, np.zeros(len(found), np.int64), k, 1, False)[0]

    def leaks(self, found: np.ndarray, doc: np.ndarray, n_docs: int) -> list[tuple[int, int, float, int, int]]:
        """(document, item, similarity, first word, words) for the best window
        of every item that a document of the slice holds."""
        best: dict[tuple[int, int, int, int], tuple[float, int, int]] = {}
        sizes = np.bincount(doc, minlength=n_docs)
        begin = np.cumsum(sizes) - sizes
        for k, (known, lengths, some) in self.lengths.items():
            if len(found) < k or not len(known):
                continue
            last = len(found) - k + 1
            whole = doc[:last] == doc[k - 1 :]
            grams = hashing.shingles(found, np.zeros(len(found), np.int64), k, 1, False)[0]
            hits = np.flatnonzero(some[grams >> U(44)] & whole)
            at = np.searchsorted(known, grams[hits])
            inside = known[np.minimum(at, len(known) - 1)] == grams[hits]
            by_length = defaultdict(list)
            for position, which in zip(hits[inside].tolist(), at[inside].tolist(), strict=True):
                for length in lengths[which]:
                    by_length[length].append(position)
            for length, positions in by_length.items():
                span = length - k + 1
                hit = np.array(positions)
                starts = np.unique((hit[:, None] - np.arange(span)).ravel())
                starts = starts[(starts >= 0) & (starts + length <= len(found))]
                starts = starts[doc[starts] == doc[starts + length - 1]]
                for lo in range(0, len(starts), WINDOWS):
                    self._verify(length, length, starts[lo : lo + WINDOWS], grams, doc, begin, best)
                # shorter documents, but for those whose shingles are too few
                short = np.unique(doc[hit])
                own = sizes[short]
                for size in np.unique(own[(own < length) & (own - k + 1 >= SIMILARITY * span)]).tolist():
                    starts = begin[short[own == size]]
                    for lo in range(0, len(starts), WINDOWS):
                        self._verify(length, size, starts[lo : lo + WINDOWS], grams, doc, begin, best)
        return [(d, item, s, w, n) for (d, item, *_), (s, w, n) in sorted(best.items())]

    def _verify(self, length: int, size: int, starts: np.ndarray, grams: np.ndarray, doc: np.ndarray, begin: np.ndarray, best: dict) -> None:
        """The windows of ``size`` words against the items of ``length`` words."""
        rest = min(SHINGLE, length) - 1
        span, of_item = size - rest, length - rest
        windows = grams[starts[:, None] + np.arange(span)]
        prints, near = self.index[length]
        mine = fingerprints(windows)
        close = np.zeros((len(starts), len(prints)), bool)
        for block in range(8):
            close |= near[block][mine[:, block]]
        row, item = np.nonzero(close)
        distance = np.bitwise_count(mine[row].view(U).ravel() ^ prints[item].view(U).ravel())
        within = distance <= RADIUS
        for r, i in zip(row[within].tolist(), item[within].tolist(), strict=True):
            item_id, counts, _ = self.by_length[length][i]
            own = Counter(windows[r].tolist())
            common = sum(min(n, counts[g]) for g, n in own.items() if g in counts)
            similarity = common / (span + of_item - common)
            if similarity >= SIMILARITY:
                d = int(doc[starts[r]])
                key, first = (d, item_id, length, i), int(starts[r] - begin[d])
                if key not in best or (similarity, -first) > (best[key][0], -best[key][1]):
                    best[key] = (similarity, first, size)


@lru_cache(maxsize=1)
def _items(items: tuple[tuple[int, str], ...]) -> Items:
    return Items(items)


def item_blocks(benchmark: DataFrame, limit: int = ITEM_BYTES) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in blocks of about ``limit`` bytes of text."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // limit + 1
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield tuple(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def leaks(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Rows of ``LEAKS``: the items each document holds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = io.arrow_schema(LEAKS)
    out = None
    for block in item_blocks(benchmark, item_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = _items(block)
            for piece in io.slices(batches, "text"):
                ids = piece.column(0).to_pylist()
                rows = [(ids[d], *rest) for d, *rest in items.leaks(*words(piece.column(1)))]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        found = texts.mapInArrow(run, LEAKS)
        out = found if out is None else out.union(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows are told apart by
    their place (:func:`io.numbered`), as doc_ids may be null or shared."""
    numbered = io.numbered(docs, "leak-rows", stored)
    found = leaks(numbered.select(F.col("place").alias("doc_id"), F.col("doc.text").alias("text")), benchmark)
    away = io.written(found.select(F.col("doc_id").alias("place")).distinct(), "leaking")
    return numbered.join(size_bounded_broadcast(away), "place", "left_anti").select("doc.*")


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.spread(io.documents(spark, sf_dir).select("doc_id", "text"))
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
