"""Line deduplication by pairwise alignment with patience diff.

Documents become sequences of line hashes. A document is aligned with every
earlier document (by ``doc_id``) with which it shares a run of lines of
``MIN_CHARS`` characters, as far as that can delete more: its shared runs meet
their first holder; the runs that have lines left then meet the next two
holders, then four, and so on until none has lines left or holders before it.
So the rounds are as many as a run's holders have binary digits, and a line that a
third of all documents hold makes about one pair a document. A document with
the lines of an earlier one loses all that can be lost and is nobody's
partner. Each pair is aligned by patience diff: lines that are rare enough to
stand once on either side anchor the alignment (the longest ascending run of
them), equal lines before and after an anchor join it, and the parts between
are aligned in turn; a part without such lines is aligned by its longest
common block, and what is before and after it in turn. The aligned blocks of at least ``MIN_CHARS`` characters
are deleted from the later document. Pairs are judged on the input, not on
what is left.

Lines end at line feeds; lines of white space only are neither shared nor
deleted. Null texts are empty. A null ``doc_id`` counts as larger than all
others; rows with one ``doc_id`` are ordered as read. Empty tables give no
rows. Other columns are ignored. Lines are identified by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import io
from wordfold.operators.grouped import running_sums_before
from wordfold.session import discard, size_bounded_broadcast

MIN_CHARS = 20

#: Pairs left after a round that are aligned all at once.
FEW_PAIRS = 10_000
#: An odd number and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LAST = (1 << 63) - 1

DOCUMENTS = "part int, row long, doc_id long, text string, lines binary, chars binary, same binary"
CUTS = "part int, row long, cut array<int>"
RESULT = "doc_id long, n_lines long, n_removed long, kept_sha256 string"


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, characters) of each line; 0 for lines of white space only."""
    lines = text.split("\n")
    hashes = [0 if not x.strip() else xxhash.xxh3_64_intdigest(x.encode()) | 1 for x in lines]
    return np.array(hashes, np.uint64).view(np.int64), np.array([len(x) for x in lines], np.int32)


def number_lines(docs: DataFrame) -> DataFrame:
    """Rows of ``DOCUMENTS``, written once, so that numbering stays."""
    schema = io.arrow_schema(DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = io.task_id(), 0
        for piece in io.slices(batches, "text"):
            texts = [t or "" for t in piece.column(1).to_pylist()]
            found = [line_hashes(t) for t in texts]
            n = len(texts)
            columns = [np.full(n, part, np.int32), np.arange(row, row + n), piece.column(0), texts, [h.tobytes() for h, _ in found], [c.tobytes() for _, c in found], [xxhash.xxh3_128_digest(h.tobytes()) for h, _ in found]]
            row += n
            yield pa.record_batch([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    return io.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DOCUMENTS), "line-documents")


def short_runs(hashes: np.ndarray, chars: np.ndarray, least: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the shortest runs of lines that have ``least``
    characters and begin, or end, at some line; no run holds a 0. Every line
    of a common block of ``least`` characters is in such a run of the block:
    in the one that ends there, or else in the one that begins the block."""
    n = len(hashes)
    total = np.r_[0, np.cumsum(chars, dtype=np.int64)]
    blank = np.r_[0, np.cumsum(hashes == 0)]
    at = np.arange(n)
    ends = np.searchsorted(total, total[:-1] + least, "left")
    starts = np.searchsorted(total, total[1:] - least, "right") - 1
    lo, hi = np.r_[at, starts], np.r_[ends, at + 1]
    inside = (lo >= 0) & (hi <= n)
    lo, hi = lo[inside], hi[inside]
    whole = blank[hi] == blank[lo]
    lo, hi = lo[whole], hi[whole]
    # a polynomial in BASE, moved to the run's first line
    up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)
    down = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE_INVERSE)], dtype=np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(hashes.view(np.uint64) * up[:-1], dtype=np.uint64)]
    return lo, hi, ((sums[hi] - sums[lo]) * down[lo]).view(np.int64)


def runs_of(documents: DataFrame) -> DataFrame:
    """``run, own`` for the different short runs of each document that have a
    line not in its ``cut``; ``own`` is its place in the order of documents."""
    kinds = "run long, doc_id long, part int, row long"
    schema = io.arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # the documents one after another, a line of white space after each
            lines = [np.frombuffer(x, np.int64) for x in batch.column("lines").to_pylist()]
            ends = np.cumsum([len(x) + 1 for x in lines])
            hashes = np.concatenate([y for x in lines for y in (x, np.zeros(1, np.int64))])
            chars = np.concatenate([y for x in batch.column("chars").to_pylist() for y in (np.frombuffer(x, np.int32), np.zeros(1, np.int32))])
            there = np.ones(len(hashes), bool)
            for end, x, cut in zip(ends.tolist(), lines, batch.column("cut").to_pylist(), strict=True):
                if cut:
                    there[np.array(cut) + end - len(x) - 1] = False
            lo, hi, keys = short_runs(hashes, chars)
            kept = np.r_[0, np.cumsum(there)]
            some = kept[hi] > kept[lo]
            keys, of = keys[some], np.searchsorted(ends, lo[some], "right")
            order = np.lexsort((keys, of))
            keys, of = keys[order], of[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])][: len(keys)]
            keys, of = keys[new], of[new]
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()
            columns = [keys, ids[of], batch.column("part").to_numpy()[of], batch.column("row").to_numpy()[of]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    exploded = documents.select("part", "row", "doc_id", "lines", "chars", "cut").mapInArrow(run, kinds)
    return exploded.select("run", F.struct("doc_id", "part", "row").alias("own"))


def common_block(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """(place in ``a``, place in ``b``, lines) of the longest common block; of
    equal ones the first in ``a``, then in ``b``; 0 matches nothing."""
    n, m = len(a), len(b)
    both = np.r_[np.array(a, np.int64), np.array(b, np.int64)]
    names = np.unique(both, return_inverse=True)[1]
    blank = both == 0
    names[blank] = len(both) + np.arange(int(blank.sum()))

    def shared(names: np.ndarray, length: int) -> tuple[int, int] | None:
        left, right = names[: n - length + 1], names[n : n + m - length + 1]
        if not len(left) or not len(right):
            return None
        found = np.flatnonzero(np.isin(left, right))
        return (int(found[0]), int(np.flatnonzero(right == left[found[0]])[0])) if len(found) else None

    def longer(names: np.ndarray, by: int) -> np.ndarray:
        """Names of the blocks that two blocks with names make, ``by`` apart."""
        return np.unique(names[: len(names) - by] * (2 * len(both)) + names[by:], return_inverse=True)[1]

    at, length, levels = shared(names, 1), 1, [names]
    if at is None:
        return 0, 0, 0
    while 2 * length <= min(n, m) and (there := shared(twice := longer(names, length), 2 * length)):
        at, length, names = there, 2 * length, twice
        levels.append(names)
    top = length
    for step in [top >> k for k in range(1, len(levels))]:
        if there := shared(longer(names, length + step - top) if length + step <= min(n, m) else names[:0], length + step):
            at, length = there, length + step
    return *at, length


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places where ``a`` and ``b`` are aligned; 0 matches nothing."""
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        alo, ahi, blo, bhi = waiting.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo] != 0:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1] != 0:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        once_a, once_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        place = {x: j for j, x in enumerate(b[blo:bhi], blo) if x and once_b[x] == 1 and once_a.get(x) == 1}
        both = [(i, place[x]) for i, x in enumerate(a[alo:ahi], alo) if x in place]
        # the longest run that ascends on both sides
        tops: list[int] = []
        piles: list[int] = []
        before = [-1] * len(both)
        for n, (_, j) in enumerate(both):
            pile = bisect_left(tops, j)
            tops[pile : pile + 1] = [j]
            piles[pile : pile + 1] = [n]
            before[n] = piles[pile - 1] if pile else -1
        run, n = [], piles[-1] if piles else -1
        while n >= 0:
            run.append(both[n])
            n = before[n]
        if not run and any(x and x in once_b for x in once_a):
            i, j, size = common_block(a[alo:ahi], b[blo:bhi])
            i, j = i + alo, j + blo
            out.extend((i + n, j + n) for n in range(size))
            waiting += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
        if run:
            run.reverse()
            ends = [*run, (ahi, bhi)]
            lo = (alo, blo)
            for i, j in ends:  # each part begins with the anchor before it
                waiting.append((lo[0], i, lo[1], j))
                lo = (i, j)
    return sorted(set(out))


def cuts(later: np.ndarray, chars: np.ndarray, first: np.ndarray, least: int = MIN_CHARS) -> list[int]:
    """Lines of the later document in aligned blocks of enough characters."""
    pairs = patience(later.tolist(), first.tolist())
    out: list[int] = []
    block: list[int] = []
    for n, (i, j) in enumerate(pairs):
        if n and pairs[n - 1] != (i - 1, j - 1):
            block = []
        block.append(i)
        if n + 1 == len(pairs) or pairs[n + 1] != (i + 1, j + 1):
            if int(chars[block].sum()) >= least:
                out += block
    return out


def repeated(documents: DataFrame) -> DataFrame:
    """``part, row`` of the documents whose lines are those of an earlier one."""
    own = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "part", "row")
    rows = documents.select(own.alias("own"), "same")
    first = rows.groupBy("same").agg(F.min("own").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = size_bounded_broadcast(io.written(first, "line-firsts"))
    return io.written(rows.join(first, "same").filter("first < own").select("own.part", "own.row"), "line-copies")


def copied_cuts(copies: DataFrame) -> DataFrame:
    """Rows of ``CUTS`` for documents that are aligned with their like."""
    schema = io.arrow_schema(CUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cuts(x, np.frombuffer(c, np.int32), x) for x, c in ((np.frombuffer(a, np.int64), c) for a, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], schema=schema)

    return copies.select("part", "row", "lines", "chars").mapInArrow(run, CUTS).filter(F.size("cut") > 0)


def aligned_cuts(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``CUTS``: for each pair of ``own, earlier``, the lines to delete."""
    pairs = pairs.select(F.col("own.part").alias("own_part"), F.col("own.row").alias("own_row"), F.col("earlier.part").alias("first_part"), F.col("earlier.row").alias("first_row"))
    # only the lines of the pairs' documents are shuffled
    mine = documents.select(F.col("part").alias("own_part"), F.col("row").alias("own_row"), F.col("lines").alias("later"), "chars").join(size_bounded_broadcast(pairs), ["own_part", "own_row"])
    asked = size_bounded_broadcast(pairs.select("first_part", "first_row").distinct())
    theirs = documents.select(F.col("part").alias("first_part"), F.col("row").alias("first_row"), F.col("lines").alias("first")).join(asked, ["first_part", "first_row"], "left_semi")
    both = mine.join(theirs, ["first_part", "first_row"]).select("own_part", "own_row", "later", "chars", "first")
    schema = io.arrow_schema(CUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cuts(np.frombuffer(a, np.int64), np.frombuffer(c, np.int32), np.frombuffer(b, np.int64)) for a, c, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], schema=schema)

    return both.mapInArrow(run, CUTS).filter(F.size("cut") > 0)


def merged(found: DataFrame) -> DataFrame:
    return found.groupBy("part", "row").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))


def overlapping_cuts(documents: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """Rows of ``CUTS``, one a document, written: the lines that an alignment
    with some earlier document deletes. Of ``few`` pairs or less (or as many as the first
    round had) all that are left are aligned at once."""
    copies = repeated(documents)
    n_copies = copies.count()
    named = size_bounded_broadcast(copies, known_rows=n_copies)
    pieces = [io.written(copied_cuts(documents.join(named, ["part", "row"], "left_semi")), "line-cuts")]
    others = documents.join(named, ["part", "row"], "left_anti") if n_copies else documents
    runs = runs_of(others.withColumn("cut", F.lit(None).cast("array<int>")))
    shared = io.written(runs.groupBy("run").count().filter("count > 1").select("run"), "shared-runs")
    held = io.written(runs.join(size_bounded_broadcast(shared), "run").withColumn("one", F.lit(1).cast("long")), "run-holders")
    # a run's holders in order; a hot run is numbered by pieces
    ranked = running_sums_before(held, ["run"], [F.col("own")], ["one"])
    holders = io.written(ranked.select("run", "own", F.col("one_before").alias("rank")), "run-holders")
    discard(held)
    open_runs, tried, lo, width = holders.filter("rank > 0"), 0, 0, 1

    def finished(*tables: DataFrame) -> DataFrame:
        """All cuts, written; nothing else stays."""
        out = io.written(merged(reduce(DataFrame.unionByName, pieces)), "line-cuts")
        discard(*pieces, *tables, shared, holders, open_runs, copies)
        return out

    def partners(last: int | None) -> DataFrame:
        """Open runs' documents with the run's earlier holders from ``lo`` on."""
        some = holders.filter(F.col("rank") >= lo) if last is None else holders.filter((F.col("rank") >= lo) & (F.col("rank") < last))
        ahead = some.select("run", F.col("own").alias("earlier"), F.col("rank").alias("at"))
        return io.written(open_runs.join(ahead, "run").filter("at < rank").select("own", "earlier").distinct(), "line-pairs")

    while True:
        # every open run's next holders: one, two, four and so on
        pairs = partners(lo + width)
        n_pairs = pairs.count()
        if not n_pairs:
            return finished(pairs)
        tried = max(tried, n_pairs)
        pieces.append(io.written(aligned_cuts(documents, pairs), "line-cuts"))
        lo, width = lo + width, 2 * width
        # runs of those documents with lines that stay, and holders not yet met
        met = pairs.select("own.part", "own.row").distinct()
        so_far = merged(reduce(DataFrame.unionByName, pieces))
        rest = others.join(size_bounded_broadcast(met), ["part", "row"], "left_semi").join(so_far, ["part", "row"], "left")
        before = open_runs
        open_runs = io.written(runs_of(rest).join(holders.filter(F.col("rank") > lo), ["run", "own"]).select("run", "own", "rank"), "open-runs")
        discard(pairs, before)
        left = open_runs.agg(F.sum(F.col("rank") - lo)).first()[0] or 0
        if not left:
            return finished()
        if left <= max(few, tried):
            pairs = partners(None)
            pieces.append(io.written(aligned_cuts(documents, pairs), "line-cuts"))
            return finished(pairs)


def remove_lines(docs: DataFrame) -> DataFrame:
    """A row of ``RESULT`` for every document."""
    documents = number_lines(docs)
    found = overlapping_cuts(documents)
    joined = documents.select("part", "row", "doc_id", "text").join(size_bounded_broadcast(found), ["part", "row"], "left").select("doc_id", "text", "cut")
    schema = io.arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, gone = text.split("\n"), set(cut or [])
                kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                out.append((doc_id, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, RESULT)


def op6_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_lines(io.spread(io.documents(spark, sf_dir).select("doc_id", "text")))
