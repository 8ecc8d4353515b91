"""Top products of sparse rows (G15) and sparse by dense products (D8) on rows
in compressed form.

A matrix ``(word, context, v)`` becomes one record per word: its contexts, by
64-bit hash and ascending, and their values. A record is as long as the word
has contexts. Products are summed inside a task in the order of the contexts,
so equal rows get equal scores wherever they stand.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordfold.operators import lookup
from wordfold.operators.lookup import _place
from wordfold.session import checkpoint_dir, cut_lineage, size_bounded_broadcast

#: Bytes of query rows in a block.
QUERY_BYTES = 32 << 20
#: Cells of candidate rows scored together; products expanded and sums held at once.
BLOCK_CELLS, PRODUCTS, SUMS = 1 << 19, 1 << 20, 1 << 21
#: Bytes of a cell, and of a row beside its cells.
CELL_BYTES, ROW_BYTES = 16, 64
#: Rounding error of a sum, as a share of the sum of its terms' sizes, at most.
SLACK = 1e-9

RECORDS = "word string, contexts array<long>, values array<double>"
TOP = "query string, word string, score double"
_TOP = pa.schema([("query", pa.string()), ("word", pa.string()), ("score", pa.float64())])

QUERY_BLOCK = "block int, words array<string>, contexts array<long>, starts array<long>, query array<int>, value array<double>"
_QUERIES = [pa.field("words", pa.list_(pa.string())), pa.field("contexts", pa.list_(pa.int64())), pa.field("starts", pa.list_(pa.int64())),
            pa.field("query", pa.list_(pa.int32())), pa.field("value", pa.list_(pa.float64()))]
_kept: dict = {}


def records(m: DataFrame) -> DataFrame:
    """Rows of ``RECORDS`` from ``word, context, v`` (no cell twice); contexts
    that are ids stay what they are."""
    context = F.col("context") if m.schema["context"].dataType.typeName() == "long" else F.xxhash64("context")
    cells = m.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(context.alias("c"), F.col("v").cast("double").alias("v")))).alias("cells"))
    return cells.select("word", F.col("cells.c").alias("contexts"), F.col("cells.v").alias("values"))


class Rows:
    """Records as one array of contexts and one of values."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.words = np.array(table["word"].to_pylist(), object)
        lists = [table[c].combine_chunks() for c in ("contexts", "values")]
        self.contexts, self.values = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        self.starts = np.concatenate([[0], np.cumsum(np.diff(lists[0].offsets.to_numpy()))])

    def __len__(self) -> int:
        return len(self.words)

    def rows(self) -> np.ndarray:
        """The row of every cell."""
        return np.repeat(np.arange(len(self)), np.diff(self.starts))


class Queries:
    """Query rows by context: for each context the queries that have it."""

    def __init__(self, rows: Rows):
        self.words = rows.words
        self.contexts, at = np.unique(rows.contexts, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.query, self.value = rows.rows()[order], rows.values[order]
        self.starts = np.searchsorted(at[order], np.arange(len(self.contexts) + 1))
        self._bounds()

    def _bounds(self) -> None:
        self.high = np.maximum.reduceat(self.value, self.starts[:-1]) if len(self.contexts) else np.zeros(0)
        self.low = np.minimum.reduceat(self.value, self.starts[:-1]) if len(self.contexts) else np.zeros(0)

    def table(self, block: int) -> pa.Table:
        """One row of ``QUERY_BLOCK``."""
        lists = (self.words, self.contexts, self.starts.astype(np.int64), self.query.astype(np.int32), self.value)
        return pa.table({"block": pa.array([block], pa.int32())} | {f.name: pa.array([x], f.type) for f, x in zip(_QUERIES, lists, strict=True)})

    @classmethod
    def read(cls, table: pa.Table) -> Queries:
        out = cls.__new__(cls)
        lists = [table[f.name].combine_chunks().flatten() for f in _QUERIES]
        out.words = np.array(lists[0].to_pylist(), object)
        out.contexts, out.starts, out.query, out.value = (x.to_numpy() for x in lists[1:])
        out._bounds()
        return out


def best_words(q: Queries, c: Rows, n: int, met: list | None = None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the n best rows of ``c`` for every query, less
    those below ``least`` of a query.

    Rows are taken by what they could score with any query at most (each
    context with its highest value among the queries); once no query's n-th
    best is below that, the rest is skipped."""
    nq = len(q.words)
    at = np.minimum(np.searchsorted(q.contexts, c.contexts), max(len(q.contexts) - 1, 0))
    hit = q.contexts[at] == c.contexts if len(q.contexts) else np.zeros(len(c.contexts), bool)
    row, at, value = c.rows()[hit], at[hit], c.values[hit]
    bound = np.bincount(row, np.maximum(0.0, np.maximum(value * q.high[at], value * q.low[at])), len(c)).astype(float)  # whole numbers if empty
    size = np.bincount(row, np.abs(value) * np.maximum(np.abs(q.high[at]), np.abs(q.low[at])), len(c))
    bound += SLACK * size
    products = np.bincount(row, q.starts[at + 1] - q.starts[at], len(c)).astype(np.int64)
    order = np.argsort(-bound, kind="stable")
    order = order[products[order] > 0]
    cell_start = np.searchsorted(row, np.arange(len(c) + 1))
    least = np.full(nq, -np.inf) if least is None else least
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    # equal scores: word descending
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(c.words, kind="stable")] = np.arange(len(c))
    lo = 0
    while lo < len(order) and not bound[order[lo]] < least.min():
        some = order[lo : lo + max(1, SUMS // nq)]
        some = some[: max(1, int(np.searchsorted(np.cumsum(products[some]), PRODUCTS, "right")))]
        lo += len(some)
        sizes = cell_start[some + 1] - cell_start[some]
        cells = np.repeat(cell_start[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        local = np.repeat(np.arange(len(some)), sizes)
        first, many = q.starts[at[cells]], q.starts[at[cells] + 1] - q.starts[at[cells]]
        post = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = np.repeat(local * nq, many) + q.query[post]
        sums = np.bincount(key, np.repeat(value[cells], many) * q.value[post], len(some) * nq).reshape(len(some), nq)
        shared = np.zeros(len(some) * nq, bool)
        shared[key] = True
        mine, asked = np.nonzero(shared.reshape(len(some), nq) & (sums >= least))
        kept = [np.concatenate(x) for x in zip(kept, (asked, some[mine], sums[mine, asked]), strict=True)]
        by = np.lexsort((-rank[kept[1]], -kept[2], kept[0]))
        by = by[np.arange(len(by)) - np.searchsorted(kept[0][by], kept[0][by]) < n]
        kept = [x[by] for x in kept]
        full = np.bincount(kept[0], minlength=nq) >= n
        last = np.searchsorted(kept[0], np.arange(nq), "right") - 1
        least[full] = np.maximum(least[full], kept[2][last[full]])
    if met is not None:
        met += [int((products > 0).sum()), lo]
    return tuple(kept)


class Best:
    """The n best words so far of every query of a block."""

    def __init__(self, q: Queries, n: int):
        self.n, self.asked, self.score, self.words = n, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.least = np.full(len(q.words), -np.inf)

    def meet(self, q: Queries, c: Rows) -> None:
        asked, row, score = best_words(q, c, self.n, least=self.least.copy())
        if not len(asked):
            return
        asked, score, words = np.r_[self.asked, asked], np.r_[self.score, score], np.r_[self.words, c.words[row]]
        by = np.argsort(words, kind="stable")[::-1]  # equal scores: word descending
        by = by[np.lexsort((-score[by], asked[by]))]
        by = by[np.arange(len(by)) - np.searchsorted(asked[by], asked[by]) < self.n]
        self.asked, self.score, self.words = asked[by], score[by], words[by]
        full = np.bincount(self.asked, minlength=len(self.least)) >= self.n
        self.least[full] = self.score[np.searchsorted(self.asked, np.flatnonzero(full), "right") - 1]


def _queries(path: str, block: int, keep: bool) -> Queries:
    """A written block of query rows; the only one is kept."""
    if (path, block) in _kept:
        return _kept[path, block]
    files, place = _place(f"{path}/block={block}")
    found = Queries.read(dataset.dataset(place, filesystem=files, format="parquet").to_table())
    if keep:
        _kept.clear()
        _kept[path, block] = found
    return found


def _scored(path: str, blocks: list[int], batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Top rows of what a task reads. It meets the query blocks in turn with
    about ``BLOCK_CELLS`` cells."""
    waiting, held, best = [], 0, {}
    cells = BLOCK_CELLS

    def meet() -> None:
        c = Rows(waiting)
        for b in blocks:
            q = _queries(path, b, len(blocks) == 1)
            best.setdefault(b, Best(q, n)).meet(q, c)
            del q  # before the next one is read
        lookup.freed()

    for batch in batches:
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        cut = np.flatnonzero(np.diff(np.cumsum(lengths) // cells)) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, batch.num_rows], strict=True):
            waiting.append(batch.slice(lo, hi - lo))
            held += int(lengths[lo:hi].sum())
            if held >= cells:
                meet()
                waiting, held = [], 0
    if waiting:
        meet()
    for b, found in best.items():
        words = _queries(path, b, len(blocks) == 1).words[found.asked]
        yield pa.record_batch([pa.array(words, pa.string()), pa.array(found.words, pa.string()), pa.array(found.score)], schema=_TOP)


def together(m: DataFrame) -> DataFrame:
    """Rows of ``RECORDS`` on ids, from ``word, context, v`` where the cells of
    a word follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the last word may go on in the next batch

        def rows(word: np.ndarray, context: np.ndarray, v: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            stops = pa.array(np.r_[starts, len(word)].astype(np.int32))
            return pa.record_batch([pa.array(word[starts]), pa.ListArray.from_arrays(stops, pa.array(context)), pa.ListArray.from_arrays(stops, pa.array(v))], ["word", "contexts", "values"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [c.to_numpy() for c in batch.columns]
            if carried is not None and carried[0][0][0] == cells[0][0] == cells[0][-1]:
                carried.append(cells)
                continue
            if carried is not None:
                cells = [np.concatenate(x) for x in zip(*carried, cells, strict=True)]
            starts = np.flatnonzero(np.r_[True, cells[0][1:] != cells[0][:-1]])
            last = starts[-1]
            if len(starts) > 1:
                yield rows(*(c[:last] for c in cells), starts[:-1])
            carried = [[c[last:] for c in cells]]
        if carried is not None:
            cells = [np.concatenate(x) for x in zip(*carried, strict=True)]
            yield rows(*cells, np.zeros(1, np.int64))

    return lookup._pass(lookup.renamed(m, {c: c for c in ("word", "context", "v")}), run, "word long, contexts array<long>, values array<double>")


def most(m: DataFrame, n: int) -> DataFrame:
    """The cells of every word that are as high as its n-th highest, at least;
    ``m`` is packed and lies word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            row, v = np.repeat(np.arange(len(sizes)), sizes), batch.column(2).flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            least = v[np.lexsort((-v, row))][starts + np.minimum(sizes, n) - 1]
            some = np.flatnonzero(v >= least[row])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some])), batch.column(1).flatten().take(pa.array(some)), pa.array(v[some])], ["word", "context", "v"])

    return lookup._pass(together(m), run, "word long, context long, v double")


def listed(m: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """The cells whose ``word * words + context`` is in the written table
    ``key, cell`` (twice the same), which every worker reads; ``m`` is packed."""
    path = keys.written_at
    word, context = (m.columns.index(c) for c in ("word", "context"))

    def some(batch: pa.RecordBatch) -> list:
        known = lookup.held(path, "key", ("cell",))["cell"].to_numpy()
        key = batch.column(word).to_numpy() * words + batch.column(context).to_numpy()
        found = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)
        return [x.filter(pa.array(found)) for x in batch.columns]

    return lookup.computed(m, m.schema.fields, some)


#: Pairs of rows that meet in one task.
PAIRS_TOGETHER = 256


def row_products(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, sim): products of the rows ``word, contexts, values`` of listed
    ids, where both have one and they share a context. Pairs meet by ``at``,
    and a row goes to each meeting it has a pair in."""
    pairs = cut_lineage(pairs.select("a", "b", F.floor(F.col("at") / PAIRS_TOGETHER).alias("_at")), "row-pairs")
    needed = pairs.select(F.col("a").alias("word"), "_at").union(pairs.select("b", "_at")).distinct()
    moved = rows.join(size_bounded_broadcast(cut_lineage(needed.groupBy("word").agg(F.collect_set("_at").alias("_to")), "row-places")), "word").select("word", "contexts", "values", F.explode("_to").alias("_at"))

    def meet(asked: pa.Table, found: pa.Table) -> pa.Table:
        words = {w: k for k, w in enumerate(found["word"].to_pylist())}
        lists = [found[c].combine_chunks() for c in ("contexts", "values")]
        starts = lists[0].offsets.to_numpy() - lists[0].offsets.to_numpy()[0] if len(words) else np.zeros(1, np.int64)
        contexts, values = (x.flatten().to_numpy() for x in lists)
        out: list = []
        for a, b in zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True):
            if a in words and b in words:
                (x, y) = (slice(starts[words[w]], starts[words[w] + 1]) for w in (a, b))
                at = np.minimum(np.searchsorted(contexts[y], contexts[x]), max(y.stop - y.start - 1, 0))
                same = contexts[y][at] == contexts[x]
                if same.any():
                    out.append((a, b, float(np.sum(values[x][same] * values[y][at[same]]))))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64()), "sim": pa.array([o[2] for o in out], pa.float64())})

    return pairs.groupBy("_at").cogroup(moved.groupBy("_at")).applyInArrow(meet, "a long, b long, sim double")


def _asked(m: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cells of words that the written table ``wid, asked`` marks."""
    found = lookup.attach(m, [("word", wanted, "wid", {"asked": "asked"})])
    if not lookup.is_packed(found):
        return found.where(F.col("asked").isNotNull()).drop("asked")
    at = found.columns.index("asked")
    return lookup.computed(found, [f for f in found.schema.fields if f.name != "asked"],
                           lambda batch: [x.filter(batch.column(at).is_valid()) for c, x in enumerate(batch.columns) if c != at])


def top_products(words: DataFrame, m: DataFrame, n: int, report: dict | None = None, named=None, ids: DataFrame | None = None) -> DataFrame:
    """Rows of ``TOP`` that hold the n best words of every query word that has
    a row. Query rows are written in blocks of at most ``QUERY_BYTES``, which
    the tasks over the candidates read in turn, so no candidate moves. With
    ``ids`` (word, wid) the cells are on these and lie word by word: rows are
    made where they are read, and only those of queries are written."""
    spark = m.sparkSession
    words = words.select("word").distinct()
    if ids is None:
        rows = records(m.select("word", "context", "v"))
        rows = named(rows).select("word", "contexts", "values") if named else rows
        rows = cut_lineage(rows, "sparse-rows", "zstd")
        asked = rows.join(words, "word", "left_semi")
    else:
        rows = named(together(m))
        wanted = cut_lineage(ids.join(words.withColumn("asked", F.lit(True)), "word", "left").select("wid", "asked"), "query-ids")
        asked = cut_lineage(named(together(_asked(m, wanted))), "query-rows", "zstd")
    cost = F.size("contexts").cast("long") * CELL_BYTES + ROW_BYTES + F.octet_length("word")
    size, most = asked.agg(F.coalesce(F.sum(cost), F.lit(0)), F.count("*")).first()
    blocks = -(-size // QUERY_BYTES)
    if report is not None:
        report.update(queries=most, blocks=blocks)
    if not most:
        return spark.createDataFrame([], TOP)
    path = f"{checkpoint_dir(spark).rstrip('/')}/query-blocks-{uuid.uuid4().hex}"
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int"))
    dealt.groupBy("block").applyInArrow(lambda t: Queries(Rows(t.to_batches())).table(t["block"][0].as_py()), QUERY_BLOCK).write.partitionBy("block").parquet(path, compression="zstd")
    filled = sorted(r[0] for r in spark.read.schema("block int").parquet(path).select("block").distinct().collect())
    return lookup._pass(rows, lambda batches: _scored(path, filled, batches, n), TOP)
