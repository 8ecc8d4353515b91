"""Removal of long byte strings that an earlier document has too.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller ``doc_id``. Suffix arrays by two-stage sorting find
the strings; anchors bring equal strings to one task first:

1. Texts are packed into blocks. Whole copies of an earlier text go at once
   (all their strings are in it), by a digest of the text.
2. Each window of ``LENGTH`` bytes has an anchor: the run of ``ANCHOR`` bytes
   in it with the smallest hash, the leftmost if tied. Equal windows have
   equal anchors. Blocks ask which of their anchors' hashes another document
   has as well, one request a hash and block.
3. Around each shared anchor a fragment holds all windows of that anchor.
   Fragments meet by hash. Those that are equal byte by byte are settled by
   their smallest document, first inside each block (so a passage in a third
   of all documents sends one fragment a block). For hashes with different
   fragments, a suffix array over the fragments and the common prefixes of
   neighbours give the windows that agree in ``LENGTH`` bytes, and for each
   the smallest document.
4. Blocks get their windows back; runs of covered bytes are removed.

Null texts are empty; texts shorter than ``LENGTH`` keep everything. A null
``doc_id`` counts as larger than all others. Rows with one ``doc_id`` don't
remove each other's bytes. Empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import hashing, io
from wordfold.llm.blocks import NO_ID, Block, make_blocks, packed, packed_sorted, unpacked, unpacked_sorted
from wordfold.llm.hashing import U, mix
from wordfold.llm.suffix_array import common_prefixes, join_strings, suffix_array

LENGTH = 50
ANCHOR = 20
#: Spans that are gathered at once, and bytes of one suffix array.
SPANS_AT_ONCE, ARRAY_BYTES = 8192, 1 << 20
#: Numbers of copied documents (four bytes each) that may be broadcast.
BROADCAST_COPIES = 1_000_000

DIGESTS = "block long, doc int, doc_id long, high long, low long"
REQUESTS = "bucket int, block long, hashes binary, twice binary"
ANSWERS = "block long, bucket int, shared binary"
FRAGMENTS = "kind int, bucket int, block long, hashes binary, ids binary, starts binary, sizes binary, places binary, texts binary"
SPANS = "block long, starts binary, ends binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(blocks: DataFrame) -> DataFrame:
    """The first document of every text in a block, by 128-bit digest; the
    smallest ``doc_id`` with it."""
    schema = io.arrow_schema(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row["ids"], row["sizes"], row["texts"])
            found = [hashlib.blake2b(block.data[lo:hi], digest_size=16).digest() for lo, hi in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            keep = np.flatnonzero(block.sizes >= LENGTH)
            columns = [np.full(len(keep), row["block"]), keep.astype(np.int32), block.ids[keep], both[keep, 0], both[keep, 1]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, DIGESTS)


def copies(blocks: DataFrame) -> DataFrame:
    """``block, copies``: documents whose whole text a smaller id has."""
    found = io.written(digests(blocks), "text-digests")
    # one row a block and text before the texts meet
    local = found.groupBy("block", "high", "low").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("doc_id").alias("most"))
    least = local.groupBy("high", "low").agg(F.min("least").alias("first"), F.sum("n").alias("all")).filter("all > 1")
    repeated = local.join(least, ["high", "low"]).filter("most > first").select("block", "high", "low", "first")
    away = found.join(repeated, ["block", "high", "low"]).filter("doc_id > first")
    return io.written(away.groupBy("block").agg(F.collect_list("doc").alias("copies")), "text-copies")


class Anchors:
    """Anchors of a range of a block's documents: hash, document, and the
    first and last start of the windows that have them (in the block)."""

    def __init__(self, block: Block, lo: int, hi: int, skip: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
        base = int(block.offsets[lo])
        data, offsets = block.data[base : int(block.offsets[hi])], block.offsets[lo : hi + 1] - base
        empty = np.zeros(0, np.int64)
        self.hashes, self.docs, self.first, self.last = np.zeros(0, U), empty, empty, empty
        if len(data) < length:
            return
        powers, inverses = hashing._power_table(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(hashing._BYTES[data] * powers[: len(data)], out=sums[1:])
        hashes = mix((sums[anchor:] - sums[:-anchor]) * inverses[: len(data) - anchor + 1])
        bits = U(max(1, (len(hashes) - 1).bit_length()))
        least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=U)
        span, width = length - anchor + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & ((U(1) << bits) - U(1))).astype(np.int64)
        crossing = np.zeros(len(data) + 1, np.int32)
        ends = offsets[1:]
        np.add.at(crossing, np.where(skip[lo:hi], offsets[:-1], np.maximum(offsets[:-1], ends - length + 1)), 1)
        np.add.at(crossing, ends, -1)
        inside = np.cumsum(crossing)[: len(at)] == 0
        begins = inside.copy()
        begins[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
        first = np.flatnonzero(begins)
        self.hashes, self.first, self.last = hashes[at[first]], first + base, np.flatnonzero(stops) + base
        self.docs = np.searchsorted(block.offsets, self.first, "right") - 1


def anchors(block: Block, copies_of: list[int] | None) -> tuple[np.ndarray, ...]:
    skip = np.zeros(len(block.sizes), bool)
    skip[copies_of or []] = True
    parts = [Anchors(block, lo, hi, skip) for lo, hi in block.parts()]
    if not parts:
        return np.zeros(0, U), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate([getattr(p, name) for p in parts]) for name in ("hashes", "docs", "first", "last"))


def distinct(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, whether documents of several ids have each)."""
    order = np.argsort(hashes)
    hashes, ids = hashes[order], ids[order]
    head = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    if not len(head):
        return hashes, np.zeros(0, bool)
    return hashes[head], np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)


def bucket_cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in ascending hashes."""
    where = ((hashes >> U(32)) * U(buckets)) >> U(32)
    return np.searchsorted(where, np.arange(buckets + 1).astype(U))


def requests(blocks: DataFrame, buckets: int) -> DataFrame:
    schema = io.arrow_schema(REQUESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row["ids"], row["sizes"], row["texts"])
            hashes, docs, _, _ = anchors(block, row["copies"])
            hashes, twice = distinct(hashes, block.ids[docs])
            cuts = bucket_cuts(hashes, buckets)
            rows = [(b, row["block"], packed_sorted(hashes[cuts[b] : cuts[b + 1]]), np.packbits(twice[cuts[b] : cuts[b + 1]]).tobytes()) for b in np.flatnonzero(np.diff(cuts)).tolist()]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, REQUESTS)


def answer(table: pa.Table) -> pa.Table:
    """Which hashes of a bucket documents of several ids have."""
    rows = table.select(["block", "hashes", "twice"]).to_pylist()
    asked = [unpacked_sorted(r["hashes"], U) for r in rows]
    twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(a)).astype(bool) for r, a in zip(rows, asked, strict=True)]
    every = np.concatenate(asked)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    shared = np.concatenate(twice)[order]
    same = ordered[1:] == ordered[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    back = np.empty(len(every), bool)
    back[order] = shared
    parts = np.split(back, np.cumsum([len(a) for a in asked])[:-1])
    return pa.table([pa.array([r["block"] for r in rows], pa.int64()), table["bucket"].combine_chunks(), pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())], schema=io.arrow_schema(ANSWERS))


def take_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after the other."""
    begin = np.cumsum(sizes) - sizes
    return data[np.arange(int(sizes.sum())) - np.repeat(begin - starts, sizes)]


def content_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans as rows of 64-bit numbers, filled up with zeros, and their
    sizes: two spans are equal if their rows are."""
    width = -(-int(sizes.max(initial=1)) // 8) * 8
    out = np.zeros((len(starts), width + 8), np.uint8)
    column = np.arange(width)
    for lo in range(0, len(starts), SPANS_AT_ONCE):
        part = slice(lo, lo + SPANS_AT_ONCE)
        at = starts[part, None] + column
        np.minimum(at, len(data) - 1, out=at)
        out[part, :width] = np.where(column < sizes[part, None], data[at], 0)
    numbers = out.view(U)
    numbers[:, -1] = sizes
    return numbers


def equal_spans(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number for each span; spans with equal hash and bytes share it. The
    numbers ascend with the hash."""
    digest = hashes.copy()
    for column in keys.T:
        digest = mix(digest * U(3) + column)
    order = np.lexsort((digest, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    for column in keys.T:  # the bytes decide, the digest only brings equals together
        ordered = column[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(new) - 1
    return number


def fragments(blocks: DataFrame, buckets: int) -> DataFrame:
    """Kind 0: fragments by bucket; kind 1: spans settled inside the block."""
    schema = io.arrow_schema(FRAGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row["ids"], row["sizes"], row["texts"])
            hashes, docs, first, last = anchors(block, row["copies"])
            known, _ = distinct(hashes, block.ids[docs])
            cuts = bucket_cuts(known, buckets)
            shared = np.zeros(len(known), bool)
            for a in row["answers"] or []:
                lo, hi = cuts[a["bucket"]], cuts[a["bucket"] + 1]
                shared[lo:hi] = np.unpackbits(np.frombuffer(a["shared"], np.uint8), count=hi - lo)
            use = shared[np.searchsorted(known, hashes)] if len(hashes) else np.zeros(0, bool)
            hashes, ids, first = hashes[use], block.ids[docs[use]], first[use]
            sizes = last[use] + LENGTH - first
            if not len(hashes):
                continue
            # equal fragments of the block: those of the smallest id go on, once
            number = equal_spans(hashes, content_keys(block.data, first, sizes))
            by = np.lexsort((first, ids, number))
            head = np.r_[True, number[by][1:] != number[by][:-1]]
            least = ids[by][head][np.cumsum(head) - 1]
            settled = np.sort(by[ids[by] > least])
            rows = [(1, int(row["block"] % buckets), row["block"], None, None, packed(first[settled]), packed(first[settled] + sizes[settled]), None, None)]
            # the others of the smallest id share the fate of the first
            fate = by[ids[by] == least]
            lead = by[head][np.cumsum(head)[ids[by] == least] - 1]
            sent = by[head]
            sent = sent[np.argsort(hashes[sent], kind="stable")]
            cuts = bucket_cuts(hashes[sent], buckets)
            of_lead = np.empty(len(hashes), np.int64)
            of_lead[sent] = np.arange(len(sent))
            group = of_lead[lead]
            order = np.argsort(group, kind="stable")
            group, places = group[order], first[fate[order]]
            place_cuts = np.searchsorted(group, cuts)
            squeeze = zstandard.ZstdCompressor(level=1).compress
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = sent[cuts[b] : cuts[b + 1]]
                where = slice(place_cuts[b], place_cuts[b + 1])
                rows.append((0, b, row["block"], packed_sorted(hashes[part]), packed(ids[part]), packed(group[where] - cuts[b]), packed(sizes[part].astype(np.uint8)), packed(places[where]), squeeze(take_spans(block.data, first[part], sizes[part]).tobytes())))
            for lo in range(0, len(rows), 64):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 64], strict=True), schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, FRAGMENTS)


def agreeing_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(span, start in it) of the windows of ``length`` bytes that a span with
    a smaller id has too, by the suffix array of all spans."""
    symbols, owner = join_strings(data, starts, sizes)
    order = suffix_array(symbols)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    inside = order - begin[owner[order]]
    order = order[inside + length <= sizes[owner[order]]]  # suffixes that hold a window
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    common = common_prefixes(symbols, order, length)
    head = common < length
    heads = np.flatnonzero(head)
    of = ids[owner[order]]
    least = np.minimum.reduceat(of, heads)[np.cumsum(head) - 1]
    covered = order[of > least]
    return owner[covered], covered - begin[owner[covered]]


def settle(table: pa.Table) -> pa.Table:
    """Spans to remove, by block, from the fragments of a bucket."""
    rows = table.to_pylist()
    out = [(r["block"], r["starts"], r["sizes"]) for r in rows if r["kind"] == 1]
    rows = [r for r in rows if r["kind"] == 0]
    if rows:
        hashes = [unpacked_sorted(r["hashes"], U) for r in rows]
        counts = [len(h) for h in hashes]
        hashes = np.concatenate(hashes)
        ids = np.concatenate([unpacked(r["ids"], np.int64) for r in rows])
        sizes = np.concatenate([unpacked(r["sizes"], np.uint8) for r in rows]).astype(np.int64)
        open_text = zstandard.ZstdDecompressor().decompress
        data = np.frombuffer(b"".join(open_text(r["texts"]) for r in rows), np.uint8)
        starts = np.cumsum(sizes) - sizes
        first_of = np.cumsum(counts) - counts
        group = np.concatenate([unpacked(r["starts"], np.int64) + f for r, f in zip(rows, first_of, strict=True)])
        places = np.concatenate([unpacked(r["places"], np.int64) for r in rows])
        of_row = np.repeat(np.arange(len(rows)), [len(unpacked(r["places"], np.int64)) for r in rows])

        number = equal_spans(hashes, content_keys(data, starts, sizes))
        by = np.lexsort((ids, number))
        head = np.r_[True, number[by][1:] != number[by][:-1]]
        lead = np.empty(len(ids), np.int64)
        lead[by] = by[head][np.cumsum(head) - 1]
        whole = ids > ids[lead]  # an equal fragment has a smaller id
        # different fragments of one hash: the suffix array of one of each kind
        kinds = np.sort(by[head])
        kind_hash = hashes[kinds]
        _, inverse, times = np.unique(kind_hash, return_inverse=True, return_counts=True)
        kinds = kinds[times[inverse] > 1]
        covered: list[tuple[np.ndarray, np.ndarray]] = []
        if len(kinds):
            # kinds of one hash side by side; equal windows have one hash, so
            # the arrays may be cut between hashes
            kinds = kinds[np.argsort(hashes[kinds], kind="stable")]
            ends = np.flatnonzero(np.r_[hashes[kinds][1:] != hashes[kinds][:-1], True]) + 1
            part = np.cumsum(sizes[kinds])[ends - 1] // ARRAY_BYTES
            cuts = np.r_[0, ends[np.r_[part[1:] != part[:-1], True]]]
            found = []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some, inside = agreeing_windows(data, starts[kinds[lo:hi]], sizes[kinds[lo:hi]], ids[kinds[lo:hi]])
                found.append((some + lo, inside))
            span, inside = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            # to all fragments of the kind that are not whole
            kind_of = np.full(len(ids), -1)
            kind_of[kinds] = np.arange(len(kinds))
            mine = np.flatnonzero(~whole & (kind_of[lead] >= 0))
            slot = np.argsort(span, kind="stable")
            span, inside = span[slot], inside[slot]
            lo, hi = np.searchsorted(span, kind_of[lead[mine]], "left"), np.searchsorted(span, kind_of[lead[mine]], "right")
            n = hi - lo
            take = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
            covered.append((np.repeat(mine, n), inside[take]))
        frag = np.concatenate([np.flatnonzero(whole), *[c[0] for c in covered]])
        offset = np.concatenate([np.zeros(int(whole.sum()), np.int64), *[c[1] for c in covered]])
        size = np.concatenate([sizes[whole], *[np.full(len(c[0]), LENGTH) for c in covered]])
        # to every place of the fragment
        by = np.argsort(group, kind="stable")
        lo, hi = np.searchsorted(group[by], frag, "left"), np.searchsorted(group[by], frag, "right")
        n = hi - lo
        take = by[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)]
        start = places[take] + np.repeat(offset, n)
        end = start + np.repeat(size, n)
        where = of_row[take]
        order = np.lexsort((start, where))
        start, end, where = start[order], end[order], where[order]
        if len(start):  # overlapping spans of a block become one
            reach = np.maximum.accumulate(end + where * (1 << 40)) - where * (1 << 40)
            new = np.r_[True, (start[1:] > reach[:-1]) | (where[1:] != where[:-1])]
            heads = np.flatnonzero(new)
            ends, where, start = np.maximum.reduceat(end, heads), where[heads], start[heads]
            for r in np.unique(where).tolist():
                mine = where == r
                out.append((rows[r]["block"], packed(start[mine]), packed(ends[mine])))
    return pa.table([pa.array([o[k] for o in out], f.type) for k, f in enumerate(io.arrow_schema(SPANS))], schema=io.arrow_schema(SPANS))


def remove(block: Block, copies_of: list[int], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(removed bytes, removed runs, digest of the rest) of each document."""
    cover = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, ends, -1)
    gone = np.cumsum(cover)[:-1] > 0
    for d in copies_of:
        gone[block.offsets[d] : block.offsets[d + 1]] = True
    removed, runs, rest = np.zeros(len(block.sizes), np.int64), np.zeros(len(block.sizes), np.int64), []
    for d, (lo, hi) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)):
        mask = gone[lo:hi]
        removed[d] = mask.sum()
        kept = block.data[lo:hi]
        if removed[d]:
            runs[d] = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            kept = kept[~mask]
        rest.append(hashlib.sha256(kept.tobytes()).hexdigest())
    return removed, runs, rest


def results(blocks: DataFrame) -> DataFrame:
    schema = io.arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row["ids"], row["sizes"], row["texts"])
            spans = row["spans"] or []
            starts, ends = (np.concatenate([np.zeros(0, np.int64), *[unpacked(s[c], np.int64) for s in spans]]) for c in ("starts", "ends"))
            removed, runs, rest = remove(block, row["copies"] or [], starts, ends)
            ids = pa.array(block.ids, mask=block.ids == NO_ID)
            yield pa.record_batch([ids, pa.array(block.sizes), pa.array(removed), pa.array(runs), pa.array(rest, pa.string())], schema=schema)

    return blocks.mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row of ``RESULT`` for every document."""
    buckets = 4 * io.shuffle_partitions(docs.sparkSession)
    blocks = make_blocks(docs)
    away = copies(blocks)
    n_away = away.agg(F.sum(F.size("copies"))).first()[0] or 0
    whole = blocks.join(F.broadcast(away) if n_away <= BROADCAST_COPIES else away, "block", "left")
    asked = requests(whole, buckets).groupBy("bucket").applyInArrow(answer, ANSWERS)
    answers = asked.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared")).alias("answers"))
    found = fragments(whole.join(answers, "block"), buckets)
    spans = found.groupBy("bucket").applyInArrow(settle, SPANS)
    spans = io.written(spans.groupBy("block").agg(F.collect_list(F.struct("starts", "ends")).alias("spans")), "repeat-spans")
    return results(whole.join(spans, "block", "left"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(io.spread(io.documents(spark, sf_dir).select("doc_id", "text")))
