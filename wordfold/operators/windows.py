"""Masked tokens, windows and pair counts (B4-B9) of lines that stand in one row.

The tokens of such a line are at hand where the line is read, so none is
shuffled: a task masks its lines, cuts them into chunks with halos, and counts
the pairs of a few million at a time. What is shuffled are these counts, as
sorted keys in packed form, by buckets that follow from the vocabulary's total.
A pair and its mirror image share a key with a count for each direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordfold.operators.lookup import Ids, Step, cells_of, freed, held

#: Tokens masked at once, pairs counted at once, pairs of a bucket (about), rows given back at once.
TOKENS, PAIRS, BUCKET, ROWS = 1 << 18, 1 << 22, 1 << 21, 1 << 16
#: A word's pairs may lie in so many buckets.
SPREAD = 32
TWO_32 = 4294967296.0

COUNTED = "bucket int, n int, keys binary, there binary, back binary"
_COUNTED = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("there", pa.binary()), ("back", pa.binary())])
_ids: dict = {}


def packed(x: np.ndarray) -> bytes:
    """Non-negative integers, byte by byte of their places, compressed."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(x[1:], n * x[0], "zstd", asbytes=True), np.uint8).reshape(x[0], n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :x[0]] = planes.T
    return out.view("<i8").ravel()


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and their counts' sums."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
    return keys[first], *(np.add.reduceat(c[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for c in counts)


def uniform(purpose: str, seed: int, doc: list, line: list, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The draws of ``functions.rand.keyed_uniform`` for tokens of lines."""
    heads = {r: "|".join([purpose, str(seed), *(str(x) for x in (doc[r], line[r]) if x is not None), ""]).encode() for r in np.unique(row).tolist()}
    drawn = b"".join([md5(heads[r] + b"%d" % p).digest() for r, p in zip(row.tolist(), pos.tolist(), strict=True)])
    return np.frombuffer(drawn, ">u4")[::4] / TWO_32


class Windows:
    """Lines to keys ``(x * words + y) * (win + 1) + offset`` of pairs, y being
    ``offset`` (0 unless positional) after x, counted from x and from y."""

    def __init__(self, table: pa.Table, ids: Ids, win: int, dyn: bool, positional: bool, delete: bool, seed: int, chunk_tokens: int):
        self.drop, self.ids, self.n = table["p_drop"].to_numpy(), ids, table.num_rows
        self.win, self.dyn, self.positional, self.delete, self.seed, self.chunk = win, dyn, positional, delete, seed, chunk_tokens

    def kept(self, doc: list, line: list, toks: pa.ListArray, places: pa.ListArray) -> tuple[np.ndarray, ...]:
        """(row, position, id) of the tokens that stay."""
        sizes = np.diff(toks.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = places.is_valid().to_numpy(zero_copy_only=False)
        if at.any():  # lines with repeated keys tell their tokens' positions
            pos[at[row]] = places.flatten().to_numpy(zero_copy_only=False)
        words = toks.flatten().dictionary_encode()
        word = self.ids.of(words.dictionary)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        stay = np.flatnonzero(word >= 0)
        row, pos, word = row[stay], pos[stay], word[stay]
        ask = np.flatnonzero(self.drop[word] > 0)
        stay = np.ones(len(word), bool)
        stay[ask] = uniform("sub", self.seed, doc, line, row[ask], pos[ask]) > self.drop[word[ask]]
        return row[stay], pos[stay], word[stay]

    def chunks(self, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all chunks with their halos of ``win`` kept tokens on
        both sides: (token, whether it is the chunk's own, end of its chunk)."""
        new_row = np.r_[True, row[1:] != row[:-1]]
        chunk = pos // self.chunk
        starts = np.flatnonzero(new_row | np.r_[True, chunk[1:] != chunk[:-1]])
        ends = np.r_[starts[1:], len(row)]
        lines = np.r_[np.flatnonzero(new_row), len(row)]
        line = np.searchsorted(lines, starts, "right")
        lo, hi = np.maximum(starts - self.win, lines[line - 1]), np.minimum(ends + self.win, lines[line])
        sizes = hi - lo
        end = np.cumsum(sizes)
        token = np.arange(end[-1]) + np.repeat(lo - (end - sizes), sizes)
        own = (token >= np.repeat(starts, sizes)) & (token < np.repeat(ends, sizes))
        return token, own, np.repeat(end, sizes)

    def pairs(self, doc: list, line: list, toks: pa.ListArray, places: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(key, seen from x, seen from y) of pairs of kept tokens."""
        row, pos, word = self.kept(doc, line, toks, places)
        if not len(row):
            return
        reach = np.floor(uniform("dyn", self.seed, doc, line, row, pos) * self.win).astype(np.int64) + 1 if self.dyn else np.full(len(row), self.win)
        token, own, end = self.chunks(row, pos)
        pos, word, reach = pos[token], word[token], np.where(own, reach[token], 0)
        place = np.arange(len(token))
        for far in range(1, self.win + 1):
            i = np.flatnonzero(place + far < end)
            j = i + far
            # delete: distance counts kept tokens; else raw positions
            off = np.full(len(i), far) if self.delete else pos[j] - pos[i]
            there, back = ((reach[k] >= far) & (off <= reach[k]) for k in (i, j))
            some = there | back
            x, y, there, back, off = word[i][some], word[j][some], there[some], back[some], off[some] if self.positional else 0
            turn = (off == 0) & (x > y)  # one key for a pair and its mirror image
            x, y, there, back = np.where(turn, y, x), np.where(turn, x, y), np.where(turn, back, there), np.where(turn, there, back)
            yield (x * self.n + y) * (self.win + 1) + off, there, back


def kept_tokens(lines: DataFrame, voc: DataFrame, seed: int, chunk_tokens: int) -> DataFrame:
    """B4 (doc_id, line_no, pos, word, n_chunks) of lines ``doc_id, line_no,
    toks, places``, masked where they are read: a line's tokens follow each
    other in order (``by_line``). ``voc`` is the written vocabulary ``word,
    p_drop, wid`` with dense ids."""
    path = voc.written_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, words = None, None
        for batch in batches:
            if windows is None:
                windows = Windows(*_vocabulary(path), 1, False, False, True, seed, chunk_tokens)
                words = windows.ids.words
            upto = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            cut = np.r_[0, np.flatnonzero(np.diff(upto // TOKENS)) + 1, batch.num_rows]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                row, pos, word = windows.kept(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3))
                chunks = -(-np.diff(part.column(2).offsets.to_numpy()) // chunk_tokens)
                for at in range(0, len(row), ROWS):
                    some = slice(at, at + ROWS)
                    of = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(pos[some], pa.int32()), words.take(pa.array(word[some])),
                                                      pa.array(chunks[row[some]], pa.int32())], ["doc_id", "line_no", "pos", "word", "n_chunks"])

    out = lines.select("doc_id", "line_no", "toks", "places").mapInArrow(run, "doc_id long, line_no int, pos int, word string, n_chunks int")
    out.by_line = True
    return out


def numbered(kept: DataFrame) -> DataFrame:
    """B5 (doc_id, line_no, q, pos, word) of :func:`kept_tokens`: a token's
    place among its line's, counted where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0  # the line that may go on, and its tokens so far
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, line = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = np.where(none, 0, doc).astype(np.int64)
            new = np.r_[True, (doc[1:] != doc[:-1]) | (none[1:] != none[:-1]) | (line[1:] != line[:-1])]
            starts = np.flatnonzero(new)
            q = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.r_[starts, batch.num_rows]))
            first = doc[0], none[0], line[0]
            if first == last:
                q[:starts[1] if len(starts) > 1 else batch.num_rows] += done
            last, done = (doc[-1], none[-1], line[-1]), int(q[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q), batch.column(2), batch.column(3)], ["doc_id", "line_no", "q", "pos", "word"])

    return kept.mapInArrow(run, "doc_id long, line_no int, q long, pos int, word string")


def _vocabulary(path: str) -> tuple[pa.Table, Ids]:
    """The written vocabulary and its words' ids, as a worker holds them."""
    table = held(path, "wid", ("word", "p_drop"))
    if path not in _ids:
        _ids.clear()
        _ids[path] = Ids(table["word"].combine_chunks() if isinstance(table["word"], pa.ChunkedArray) else table["word"])
    return table, _ids[path]


def bucket_of(keys: np.ndarray, words: int, win: int, buckets: int) -> np.ndarray:
    pair = keys // (win + 1)
    mixed = ((pair // words * SPREAD + pair % SPREAD).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
    return (mixed % np.uint64(buckets)).astype(np.int32)


def _counted(found: list, words: int, win: int, buckets: int) -> pa.RecordBatch:
    keys, there, back = summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
    bucket = bucket_of(keys, words, win, buckets)
    by = np.argsort(bucket, kind="stable")
    keys, there, back, bucket = keys[by], there[by], back[by], bucket[by]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows = []
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
        a, b = there[lo:hi], back[lo:hi]
        rows.append((bucket[lo], hi - lo, packed(np.diff(keys[lo:hi], prepend=0)), packed(a), None if (a == b).all() else packed(b)))
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _COUNTED.types, strict=True)], schema=_COUNTED)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The rows of each bucket; a bucket's rows follow each other."""
    waiting = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if waiting and waiting[0][0] != row[0]:
                yield waiting
                waiting = []
            waiting.append(row)
    if waiting:
        yield waiting


def _joined(rows: list) -> tuple[np.ndarray, ...]:
    """(key, there, back): a bucket's pairs, each once."""
    keys, there, back = [], [], []
    for _, n, k, a, b in rows:
        keys.append(np.cumsum(unpacked(k, n)))
        there.append(unpacked(a, n))
        back.append(there[-1] if b is None else unpacked(b, n))
    return summed(np.concatenate(keys), np.concatenate(there), np.concatenate(back)) if len(rows) > 1 else (keys[0], there[0], back[0])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket."""
    for rows in _buckets(batches):
        keys, there, back = _joined(rows)
        row = rows[0][0], len(keys), packed(np.diff(keys, prepend=0)), packed(there), None if (there == back).all() else packed(back)
        yield pa.record_batch([pa.array([x], t) for x, t in zip(row, _COUNTED.types, strict=True)], schema=_COUNTED)


def _merged(rows: list, words: int, win: int) -> tuple[np.ndarray, ...]:
    """(x, y, offset, n): every direction of a bucket's pairs."""
    keys, there, back = _joined(rows)
    off, pair = keys % (win + 1), keys // (win + 1)
    x, y = pair // words, pair % words
    same = (x == y) & (off == 0)
    there, back = np.where(same, there + back, there), np.where(same, 0, back)
    one, two = there > 0, back > 0
    return tuple(np.concatenate(z) for z in ((x[one], y[two]), (y[one], x[two]), (off[one], -off[two]), (there[one], back[two])))


def _by_word(words: int, win: int, buckets: int) -> Step:
    """Buckets of pairs to both directions' keys ``word * words + context``,
    each with its count, by buckets of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            x, y, _, n = _merged(rows, words, win)
            bucket = ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) % np.uint64(buckets)
            order = np.argsort(x * words + y)
            order = order[np.argsort(bucket[order], kind="stable")]
            keys, n, bucket = (x * words + y)[order], n[order], bucket[order].astype(np.int32)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][:len(bucket)])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
                row = bucket[lo], hi - lo, packed(np.diff(keys[lo:hi], prepend=0)), packed(n[lo:hi]), None
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, _COUNTED.types, strict=True)], schema=_COUNTED)
            del x, y, n, order, keys, bucket
            freed()

    return run


def _word_cells(words: int) -> Step:
    """What :func:`_by_word` packed to its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            keys, n, _ = _joined(rows)
            for lo in range(0, len(keys), ROWS):
                some = keys[lo:lo + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(some // words), pa.array(some % words), pa.array(n[lo:lo + ROWS])], ["word", "context", "n"])
            del keys, n, some
        freed()

    return run


def line_pair_counts(lines: DataFrame, voc: DataFrame, n_vocab: int, pairs: float, win: int, dyn: bool, positional: bool, delete: bool,
                     seed: int, chunk_tokens: int, strings: bool, by_word: bool = False) -> DataFrame:
    """(word, context, n) of lines ``doc_id, line_no, toks, places``; ``voc``
    is the written vocabulary ``word, p_drop, wid`` with dense ids, ``pairs``
    about how many pairs there are. Words are strings or ids, contexts as in
    :func:`wordfold.operators.corpus.window_pairs`. With ``by_word`` (ids, not
    positional) the cells of a word follow each other, in order of context."""
    path = voc.written_at
    buckets = max(16, int(pairs) // BUCKET)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, found, many = None, [], 0
        for batch in batches:
            if windows is None:
                windows = Windows(*_vocabulary(path), win, dyn, positional, delete, seed, chunk_tokens)
            doc, line = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            upto = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            cut = np.r_[0, np.flatnonzero(np.diff(upto // TOKENS)) + 1, batch.num_rows]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                for some in windows.pairs(doc[lo:hi], line[lo:hi], part.column(2), part.column(3)):
                    found.append(some)
                    many += len(some[0])
                    if many >= PAIRS:
                        yield _counted(found, windows.n, win, buckets)
                        found, many = [], 0
        if many:
            yield _counted(found, windows.n, win, buckets)
            found.clear()
        freed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None

        def given(rows: list) -> Iterator[pa.RecordBatch]:
            x, y, off, n = _merged(rows, n_vocab, win)
            for lo in range(0, len(x), ROWS):
                a, b, o, m = (z[lo:lo + ROWS] for z in (x, y, off, n))
                if strings:
                    left, right = words.take(pa.array(a)), words.take(pa.array(b))
                    if positional:
                        right = pa.array([f"{w}_{d}" for w, d in zip(right.to_pylist(), o.tolist(), strict=True)], pa.string())
                else:
                    left, right = pa.array(a), pa.array(b * (2 * win + 1) + o + win if positional else b)
                yield pa.RecordBatch.from_arrays([left, right, pa.array(m)], ["word", "context", "n"])

        for rows in _buckets(batches):
            if strings and words is None:
                words = held(path, "wid", ("word",))["word"]
                words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            yield from given(rows)

    counted = lines.select("doc_id", "line_no", "toks", "places").mapInArrow(count, COUNTED)
    tasks = min(buckets, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = counted.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    if by_word and not strings and not positional:
        dealt = dealt.mapInArrow(_by_word(n_vocab, win, 2 * buckets), COUNTED).repartition(tasks, "bucket").sortWithinPartitions("bucket")
        return cells_of(dealt, _word_cells(n_vocab), _join, "word long, context long, n long")
    if strings:
        return dealt.mapInArrow(merge, "word string, context string, n long")
    return cells_of(dealt, merge, _join, "word long, context long, n long")


def whole_lines(lines: DataFrame) -> DataFrame:
    """Lines ``doc_id, line_no, toks, places``, one row each: rows that share
    their keys are one line, its tokens in order of position; ``places`` is
    null for other lines."""
    from wordfold.session import cut_lineage, size_bounded_broadcast

    none = F.lit(None).cast("array<int>")
    plain = lines.select("doc_id", "line_no", "toks", none.alias("places"))
    keys = lines.groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id", "line_no")
    keys = cut_lineage(keys, "repeated-lines")
    if keys.isEmpty():
        return plain
    keys = size_bounded_broadcast(keys.select(F.col("doc_id").alias("_d"), F.col("line_no").alias("_l")))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("line_no").eqNullSafe(F.col("_l"))
    cells = F.transform("toks", lambda x, i: F.struct(i.alias("pos"), x.alias("word")))
    merged = (lines.join(keys, same, "left_semi").groupBy("doc_id", "line_no")
              .agg(F.array_sort(F.flatten(F.collect_list(cells))).alias("cells"))
              .select("doc_id", "line_no", F.col("cells.word").alias("toks"), F.col("cells.pos").alias("places")))
    return plain.join(keys, same, "left_anti").unionByName(merged)
