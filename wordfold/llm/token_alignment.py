"""Two tokenizers' tokens aligned over the same bytes, with pair counts.

Side A reads a space and the text, side B the text, before which it adds that
space itself. Where both sides' bytes equal the text's, each overlap of an A
token with a B token is a link, and the offsets at which both end cut the
tokens into groups. A pair's count is the number of documents that hold it
linked.

Counting spills: a task aligns a block of documents and writes its pair and
document records as compressed runs, one for each radix of the A id, in order
of A id, B id and document (``spill_runs``). Runs of a radix are merged by a
heap over their frames, ``FAN`` at a time, until one is left, which has every
pair's count (``merged_counts``). As a run is in A order, an A id's pairs stand
together, so their highest count is known as they pass; ``contributions``
reads each block's records beside the counts and sends a block's sums back.
Radixes are dealt to tasks with a share of the blocks each, so no pair or A id
is ever in one task with all its documents, and a task holds some frames, a
radix's counts (bounded by the vocabularies) and a few blocks' records.

Null and empty texts, and texts whose bytes a side doesn't give back, have no
tokens: zeros and no groups. Rows keep their ``doc_id``, null and repeated ones
too, each counting as a document; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import io, tokens
from wordfold.llm.blocks import packed, packed_sorted, unpacked, unpacked_sorted

#: Bytes of texts in a block.
BLOCK_BYTES = 2 << 20
#: Runs of a block, by A id modulo this.
RADIX = 32
#: Runs that one task merges; blocks that share a copy of the counts.
FAN, SHARE = 32, 128
#: Pairs in a frame of a run.
FRAME = 1 << 15

RECORDS = "block long, part int, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, docs binary"
RUNS = "part int, block long, pairs binary"
SUMS = "block long, best binary, total binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
DOCUMENT = -1  # `part` of a document's own row


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# -- alignment of a block ---------------------------------------------------


class Aligner:
    """Both tokenizers; one per Python worker.

    Both cut before a single space or line feed between other characters, so
    a piece between such places is aligned once a block. Texts with other
    white space, or with a piece whose bytes don't come back, are aligned
    whole."""

    MARK = "\x01"

    def __init__(self, path_a: str, path_b: str):
        import regex
        import sentencepiece

        self.a = tokens.Encoder(path_a, remember=150_000, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: b for b, c in tokens._byte_letters().items()}
        vocabulary = self.a.library.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(n[1:-1], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.code = self.a.dtype.char
        # an id's name with what follows it: a token of its group, the other side, a group, the end
        self.names_a, self.names_b = (np.array([f"{i}{mark}" for mark in ",|;\n" for i in range(len(x))], object) for x in (self.bytes_a, self.bytes_b))
        self.sizes_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.sizes_b = np.fromiter(map(len, self.bytes_b), np.int64)
        self.n_b = len(names)
        # a vocabulary with pieces across such places is never cut there
        self.cuts = not any("▁" in n.lstrip("▁") or "\n" in n for i, n in enumerate(names) if not self.b.is_byte(i))
        self.plain = regex.compile(r"[ \n]\S+").fullmatch

    def _piece_ids(self, pieces: list[str]) -> tuple[list[list[int] | None], list[list[int]]]:
        of_a: list[list[int] | None] = [None] * len(pieces)
        of_b: list[list[int]] = [[]] * len(pieces)
        for lead in " \n":
            mine = [n for n, p in enumerate(pieces) if p[0] == lead]
            bodies = [pieces[n][1:] for n in mine]
            ids_a = self.a.pieces(bodies, lead)
            ids_b = self.b.encode(bodies if lead == " " else [pieces[n] for n in mine], num_threads=1)
            for n, a, b in zip(mine, ids_a, ids_b, strict=True):
                of_a[n] = None if a is None else memoryview(a).cast(self.code).tolist()
                of_b[n] = b if lead == " " else b[1:]  # after a line feed without the added space
        return of_a, of_b

    def block(self, texts: list[str | None]) -> Block:
        mark = self.MARK
        cut = [(" " + t).replace(" ", mark + " ").replace("\n", mark + "\n").split(mark)[1:] if t and self.cuts and mark not in t else None for t in texts]
        seen = sorted(set().union(*filter(None, cut)))
        pieces = list(filter(self.plain, seen))
        of_a, of_b = self._piece_ids(pieces)
        units = Units(self)
        number = units.add_all(pieces, of_a, of_b)
        bad = {p for p in seen if p not in number}
        rows: list[list[int]] = []
        for text, ps in zip(texts, cut, strict=True):
            if not text:
                rows.append([])
            elif ps and bad.isdisjoint(ps):
                rows.append(list(map(number.__getitem__, ps)))
            else:
                whole = units.add(" " + text, self.a.library.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))
                rows.append([] if whole is None else [whole])
        return Block(units, rows)


class Units:
    """Pieces and whole texts with both sides' ids, aligned together: laid end
    to end, both sides tile the same bytes."""

    def __init__(self, aligner: Aligner):
        self.of = aligner
        self.a: list[int] = []
        self.b: list[int] = []
        self.ends: list[tuple[int, int]] = []

    def add(self, text: str, a: list[int], b: list[int]) -> int | None:
        """The unit's number; None where a side gives other bytes."""
        data = text.encode()
        if b"".join(map(self.of.bytes_a.__getitem__, a)) != data or b"".join(map(self.of.bytes_b.__getitem__, b)) != data:
            return None
        self.a += a
        self.b += b
        self.ends.append((len(self.a), len(self.b)))
        return len(self.ends) - 1

    def add_all(self, pieces: list[str], of_a: list[list[int] | None], of_b: list[list[int]]) -> dict[str, int]:
        """The numbers of the pieces that can be added. All are compared at
        once; where that fails, one by one."""
        if None not in of_a:
            a, b = (list(chain.from_iterable(x)) for x in (of_a, of_b))
            data = [p.encode() for p in pieces]
            ends = [np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (of_a, of_b, data)]
            bytes_a, bytes_b = (np.cumsum(sizes[np.array(ids, np.int64)]) for sizes, ids in ((self.of.sizes_a, a), (self.of.sizes_b, b)))
            joined = b"".join(data)
            if all(map(len, of_a)) and all(map(len, of_b)) and np.array_equal(bytes_a[ends[0] - 1], ends[2]) and np.array_equal(bytes_b[ends[1] - 1], ends[2]) and b"".join(map(self.of.bytes_a.__getitem__, a)) == joined == b"".join(map(self.of.bytes_b.__getitem__, b)):
                self.a, self.b = a, b
                self.ends = list(zip(ends[0].tolist(), ends[1].tolist(), strict=True))
                return dict(zip(pieces, range(len(pieces)), strict=True))
        numbers = {p: self.add(p, a, b) for p, a, b in zip(pieces, of_a, of_b, strict=True) if a is not None}
        return {p: n for p, n in numbers.items() if n is not None}


def align(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of every overlap, and the numbers of A and B tokens
    up to the end of every group, of two sides that tile the same bytes."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    ends = np.union1d(ends_a, ends_b)  # no token ends between two of these, so each stretch is one overlap
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    at = [np.searchsorted(x, y) for x, y in ((ends_a, ends), (ends_b, ends), (ends_a, common), (ends_b, common))]
    return at[0], at[1], at[2] + 1, at[3] + 1


class Block:
    """What the documents of a block have, by document."""

    def __init__(self, units: Units, rows: list[list[int]]):
        a, b = np.array(units.a, np.int64), np.array(units.b, np.int64)
        of = units.of
        link_a, link_b, group_a, group_b = align(of.sizes_a[a], of.sizes_b[b])
        codes = a[link_a] * of.n_b + b[link_b]
        ends = np.array(units.ends, np.int64).reshape(-1, 2)
        link_ends = np.searchsorted(link_a, ends[:, 0])
        group_ends = np.searchsorted(group_a, ends[:, 0], "right")
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[group_a - 1] = 1
        last_b[group_b - 1] = 2
        last_b[ends[:, 1] - 1] = 3
        in_group = np.concatenate([np.repeat(np.arange(len(x)), np.diff(x, prepend=0)) * 2 + k for k, x in enumerate((group_a, group_b))])
        names = np.concatenate([of.names_a[a + last_a * len(of.bytes_a)], of.names_b[b + last_b * len(of.bytes_b)]])
        text = "".join(names[np.argsort(in_group, kind="stable")].tolist()).split("\n")
        self.groups = [";".join(map(text.__getitem__, r)) for r in rows]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        unit = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        per_unit = [np.diff(x, prepend=0) for x in (ends[:, 0], ends[:, 1], group_ends, link_ends)]
        self.counts = [np.bincount(owner, x[unit], len(rows)).astype(np.int64) for x in per_unit]
        links = per_unit[3][unit]
        first = np.repeat((link_ends - per_unit[3])[unit] - (np.cumsum(links) - links), links)
        self.codes = codes[first + np.arange(int(links.sum()))]
        self.owner = np.repeat(owner, links)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# -- runs --------------------------------------------------------------------


def run_bytes(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """A run: frames of ascending pair codes and their counts."""
    out = []
    for lo in range(0, len(codes), FRAME):
        for blob in (packed_sorted(codes[lo : lo + FRAME]), packed(counts[lo : lo + FRAME])):
            out += [struct.pack("<I", len(blob)), blob]
    return b"".join(out)


def frames(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at, blobs = 0, []
    while at < len(run):
        (size,) = struct.unpack_from("<I", run, at)
        blobs.append(run[at + 4 : at + 4 + size])
        at += 4 + size
        if len(blobs) == 2:
            yield unpacked_sorted(blobs[0], np.int64), unpacked(blobs[1], np.int64)
            blobs = []


def merge(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs into one, equal codes' counts added. The heap has each run's
    present frame by its last code: what is not above the least of these can
    come from present frames only."""
    heap: list[tuple[int, int]] = []
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def advance(n: int) -> None:
        frame = next(runs[n], None)
        if frame is None:
            held.pop(n, None)
        else:
            held[n] = frame
            heapq.heappush(heap, (int(frame[0][-1]), n))

    for n in range(len(runs)):
        advance(n)
    while heap:
        last, _ = heap[0]
        done, codes, counts = [], [], []
        while heap and heap[0][0] == last:
            done.append(heapq.heappop(heap)[1])
        for n, (c, k) in held.items():
            cut = int(np.searchsorted(c, last, "right"))
            if cut:
                codes.append(c[:cut])
                counts.append(k[:cut])
                held[n] = c[cut:], k[cut:]
        c, k = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(c, kind="stable")
        c, k = c[order], k[order]
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        yield c[starts], np.add.reduceat(k, starts)
        for n in done:
            advance(n)


def spill_runs(docs: DataFrame, path_a: str, path_b: str, groups: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Rows of ``RECORDS``, written once: one for each document (``part`` is
    ``DOCUMENT``) and one run for each radix of a block. ``groups`` says what
    is kept of the groups' text."""
    schema = io.arrow_schema(RECORDS)

    def batch(**columns) -> pa.RecordBatch:
        n = len(columns["block"])
        return pa.record_batch([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(path_a, path_b)
        number = io.task_id() << 32
        for piece in io.gathered(batches, "text", BLOCK_BYTES):
            n = piece.num_rows
            block = of.block(piece.column(1).to_pylist())
            n_a, n_b, n_groups, n_links = block.counts
            yield batch(block=[number] * n, part=[DOCUMENT] * n, row=np.arange(n), doc_id=piece.column(0), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups=block.groups)
            records, times = np.unique(block.codes * n + block.owner, return_counts=True)
            codes, rows = records // n, records % n
            radix = codes // of.n_b % RADIX
            for part in np.unique(radix).tolist():
                mine = radix == part
                pairs, held = np.unique(codes[mine], return_counts=True)
                held_by = packed(rows[mine].astype("<u4")), packed(times[mine].astype("<u4"))
                yield batch(block=[number], part=[part], pairs=[run_bytes(pairs, held)], docs=[struct.pack("<I", len(held_by[0])) + b"".join(held_by)])
            number += 1

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RECORDS)
    return io.written(raw.withColumn("groups", F.when(F.col("n_a") > 0, groups(F.col("groups"))).otherwise(F.when(F.col("part") == DOCUMENT, F.lit("")))), "alignment-runs")


def merged_counts(runs: DataFrame) -> DataFrame:
    """One run for each radix, of all pairs and the number of documents that
    hold each; ``FAN`` runs become one until no radix has more."""
    schema = io.arrow_schema(RUNS)

    def join(table: pa.Table) -> pa.Table:
        out = b"".join(run_bytes(c, k) for c, k in merge([frames(r) for r in table["pairs"].to_pylist()]))
        row = table["part"][0].as_py(), min(table["block"].to_pylist()), out
        return pa.table([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    while True:
        most = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
        groups = -(-most // FAN)
        runs = runs.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(max(1, groups)))).groupBy("part", "group").applyInArrow(join, RUNS)
        runs = io.written(runs, "alignment-counts", "uncompressed")
        if groups <= 1:
            return runs


def contributions(runs: DataFrame, counts: DataFrame, n_b: int) -> DataFrame:
    """For each block and radix its documents' links that are their A id's
    best and the sum of its links' counts, by row of the block."""
    schema = io.arrow_schema(SUMS)
    shares = max(1, -(-runs.select("block").distinct().count() // SHARE))

    def passing(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes, bytes]] = []
        if left.num_rows and right.num_rows:
            codes, counts = (np.concatenate(x) for x in zip(*frames(left["pairs"][0].as_py()), strict=True))
            side = codes // n_b  # ascending: an A id's pairs stand together
            starts = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
            best = counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.r_[starts, len(side)]))
            for block, run, docs in zip(*(right[c].to_pylist() for c in ("block", "pairs", "docs")), strict=True):
                pairs, held = (np.concatenate(x) for x in zip(*frames(run), strict=True))
                at = np.repeat(np.searchsorted(codes, pairs), held)
                (size,) = struct.unpack_from("<I", docs)
                rows, times = unpacked(docs[4 : 4 + size], "<u4").astype(np.int64), unpacked(docs[4 + size :], "<u4").astype(np.int64)
                n = int(rows.max()) + 1
                sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
                np.add.at(sums[0], rows, times * best[at])
                np.add.at(sums[1], rows, times * counts[at])
                out.append((block, packed(sums[0]), packed(sums[1])))
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    right = runs.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares))).groupBy("part", "share")
    left = counts.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))).groupBy("part", "share")
    return left.cogroup(right).applyInArrow(passing, SUMS)


def aligned_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Rows of ``ALIGNED`` for every document."""
    path_a, path_b = path_a or tokens.default_vocabulary(), path_b or default_pieces()
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    records = spill_runs(docs, path_a, path_b, groups)
    runs = records.filter(F.col("part") != DOCUMENT).select("part", "block", "pairs", "docs")
    sums = contributions(runs, merged_counts(runs.drop("docs")), n_b)
    schema = io.arrow_schema(ALIGNED)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        rows = left["row"].to_numpy()
        best, total = np.zeros(rows.max() + 1, np.int64), np.zeros(rows.max() + 1, np.int64)
        for b, t in zip(right["best"].to_pylist(), right["total"].to_pylist(), strict=True):
            b, t = unpacked(b, np.int64), unpacked(t, np.int64)
            best[: len(b)] += b
            total[: len(t)] += t
        own = {"n_best": pa.chunked_array([best[rows]]), "count_sum": pa.chunked_array([total[rows]])}
        return pa.table([own[f.name] if f.name in own else left[f.name] for f in schema], schema=schema)

    own = records.filter(F.col("part") == DOCUMENT).drop("part", "pairs", "docs")
    return own.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(finish, ALIGNED)


def op13_spill_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.spread(io.documents(spark, sf_dir))
    found = aligned_documents(docs, groups=lambda text: F.sha2(text, 256))
    return found.withColumnRenamed("groups", "groups_sha256")
