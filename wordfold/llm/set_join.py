"""Jaccard join of n-gram sets by a prefix tree, with components.

1. Each document's words are hashed into its set of distinct n-grams, ordered
   by 64-bit hash (the global order). Equal sets are one set from here on.
2. Candidates by exact signatures: sets within the threshold differ in at most
   ``k`` elements, so if the hash space is dealt into more than ``k`` pieces,
   some hold the same elements in both. ``k`` follows from a class of set
   sizes; a set signs for its class and the next, which covers all sizes it
   can link with. The few sets with many empty pieces also sign by the first
   elements of the global order. No pair within the threshold is missed, and
   texts that share only a passage rarely agree in a whole piece. At lower
   thresholds pieces get too small for that, so there (``rarest``) a set signs
   by its rarest n-grams, as many as a set that links may lack and one more:
   the global order is by frequency, counted over all documents in a table of
   fixed size with one cell for many hashes, then by hash. What follows is
   exact whatever the counts.
3. A piece's sets are joined with the smallest of them (first inside each
   task, so that a piece shared by a third of all sets sends one row a task).
   The sets of each smallest one are stored in a prefix tree, which it
   traverses: sets with a common prefix share the overlap counted so far, and
   a subtree ends where the remaining lengths can't reach the overlap needed.
   The tree is kept in levels of some elements each, so that numpy takes all
   living nodes of a level at once. Large groups are dealt to several tasks.
   Pairs whose sizes or sketches (a row of bits a set, one for each element's
   hash cell, at least two bits an element) rule a link out are left away
   before, so only sets that may link are computed again and sent.
4. Sets of a piece that this leaves in different components are compared with
   each other, so no link is lost: pair by pair, as in 3, where a piece has few
   sets (the pair of a piece of two is settled); through trees of all of them
   where it has many.
5. Components by star contraction; each gets its smallest ``doc_id``.

A text without words has an empty set and links with nothing. Null text
counts as empty; rows with null ``doc_id`` get a null component and link with
nothing. Rows with one ``doc_id`` and different texts count as different
documents of one number. An empty table gives no rows. Sets and n-grams are
identified by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import graph, hashing, io
from wordfold.llm.blocks import packed, packed_sorted, unpacked, unpacked_sorted
from wordfold.llm.hashing import U, mix
from wordfold.session import discard, shuffles_dropped, size_bounded_broadcast

N_GRAM = 3
PERCENT = 90
#: Signatures gathered in a task before they are combined and sent.
GATHER = 1_500_000
#: Sets in one prefix tree at most; elements, where keys are rare n-grams.
TREE_SETS, TREE_GRAMS = 2048, 500_000
#: Bits of a set's sketch at least (a power of two); sets of a piece, at most, that are compared pair by pair.
BITS, FEW = 1024, 32
#: Cells of sketches at work at once.
SKETCHED = 1 << 24
#: Hash cells whose n-grams are counted, and cells in one row of the table.
CELLS, CHUNK = 1 << 24, 1 << 16

BLOBS = "kind int, bucket int, a binary, b binary, c binary"
FOUND = "kind int, x long, y long, z long"


# -- sets ------------------------------------------------------------------


class Sets:
    """The n-gram sets of a slice of texts, one after the other, sorted."""

    def __init__(self, column: pa.Array, n_gram: int):
        data, offsets = io.text_arrays(column)
        n = len(offsets) - 1
        start, end, doc = hashing.word_bounds(data, offsets)
        grams, owner = hashing.shingles(hashing.span_hashes(data, start, end), doc, n_gram, n)
        order = np.argsort(grams)
        order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
        grams, owner = grams[order], owner[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        self.grams, self.owner = grams[fresh], owner[fresh]
        self.sizes = np.bincount(self.owner, minlength=n)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = np.zeros(n, U)
        full = self.sizes > 0
        if full.any():
            self.ids[full] = mix(np.add.reduceat(mix(self.grams ^ U(0xA5A5A5A5A5A5A5A5)), self.first[full]) + self.sizes[full].astype(U))


def size_classes(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest size, pieces, spare pieces) of each class up to the class
    after that of ``largest``.

    Sizes that may link lie in one class or two neighbours. Two sets of at
    most ``top`` elements differ in at most ``k = 2 * top * (100 - percent) /
    (100 + percent)`` elements, so of ``k + 1 + spare`` pieces at least
    ``1 + spare`` agree. The spare ones keep it unlikely that all those are
    empty: sets with more than ``spare`` empty pieces should be rare."""
    tops, pieces, spares, top, extra = [], [], [], 0, 0
    while extra < 2:
        extra += top >= largest
        low = top * percent // 100 + 1
        top = max(top + 1, (top + 1) * 100 // percent)
        k = 2 * top * (100 - percent) // (100 + percent)
        chances = []
        for spare in range(1, 13):
            empty = (k + 1 + spare) * math.exp(-low / (k + 1 + spare))  # expected, about Poisson
            term = kept = math.exp(-empty)
            for i in range(1, spare + 1):
                term *= empty / i
                kept += term
            chances.append(1 - kept)
        few = [i for i, c in enumerate(chances) if c < 1e-4]
        spare = 1 + (few[0] if few else chances.index(min(chances)))
        tops.append(top)
        pieces.append(k + 1 + spare)
        spares.append(spare)
    return np.array(tops), np.array(pieces), np.array(spares)


def signatures(sets: Sets, chosen: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set id) of the chosen sets' pieces."""
    member = chosen[sets.owner]
    grams, owner = sets.grams[member], np.cumsum(chosen)[sets.owner[member]] - 1
    sizes, ids = sets.sizes[chosen], sets.ids[chosen]
    if not len(sizes):
        return np.zeros(0, U), np.zeros(0, U)
    tops, pieces, spares = size_classes(int(sizes.max()), percent)
    scattered = mix(grams ^ U(0x5851F42D4C957F2D))
    low, high = (scattered & U(0xFFFFFFFF)).astype(float), (scattered >> U(32)).astype(float)
    where = mix(scattered) >> U(32)
    out, of = [], []
    hollow = np.zeros(len(sizes), bool)
    for step in (0, 1):
        cls = np.searchsorted(tops, sizes) + step
        m = pieces[cls]
        base = np.cumsum(m) - m
        at = base[owner] + ((where * m[owner].astype(U)) >> U(32)).astype(np.int64)
        total = int(m.sum())
        count = np.bincount(at, minlength=total)
        value = np.bincount(at, low, total).astype(U) + (np.bincount(at, high, total).astype(U) << U(32))
        set_of = np.repeat(np.arange(len(m)), m)
        number = np.arange(total) - base[set_of]
        key = mix((cls[set_of].astype(U) << U(32)) + number.astype(U))
        full = count > 0
        out.append(mix(mix(value + count.astype(U)) + key)[full])
        of.append(ids[set_of[full]])
        hollow |= np.bincount(set_of[~full], minlength=len(m)) > spares[cls]
    # if all agreeing pieces may be empty: one of the first elements in the
    # global order is common, as many as may be missing and one more
    first = np.cumsum(sizes) - sizes
    rank = np.arange(len(grams)) - first[owner]
    prefix = hollow[owner] & (rank <= (sizes - -(-percent * sizes // 100))[owner])
    out.append(mix(grams[prefix] ^ U(0x0F0F0F0F0F0F0F0F)))
    of.append(ids[owner[prefix]])
    return np.concatenate(out), np.concatenate(of)


def count_grams(docs: DataFrame, n_gram: int) -> np.ndarray:
    """The order of rarity: how often the n-grams of each of ``CELLS`` hash cells occur in all
    documents, as a byte: eight steps to a power of two. The table's size is
    fixed, so it may be sent to the driver and the tasks."""
    kinds = "chunk int, counts binary"
    schema = io.arrow_schema(kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.uint32)
        for piece in io.slices(batches, "text"):
            data, offsets = io.text_arrays(piece.column(0))
            start, end, doc = hashing.word_bounds(data, offsets)
            grams, _ = hashing.shingles(hashing.span_hashes(data, start, end), doc, n_gram, len(offsets) - 1)
            np.add.at(table, cell(grams), np.uint32(1))
        for n, part in enumerate(np.split(table, CELLS // CHUNK)):
            if part.any():
                yield pa.record_batch([pa.array([n], pa.int32()), pa.array([packed(part)], pa.binary())], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint64)
        for blob in table["counts"].to_pylist():
            total += unpacked(blob, np.uint32)
        steps = np.minimum(255, np.ceil(8 * np.log2(1 + total.astype(float)))).astype(np.uint8)
        return pa.table([table["chunk"].slice(0, 1).combine_chunks(), pa.array([steps.tobytes()], pa.binary())], schema=schema)

    steps = np.zeros(CELLS, np.uint8)
    with shuffles_dropped(docs.sparkSession):
        rows = docs.select("text").mapInArrow(count, kinds).groupBy("chunk").applyInArrow(add, kinds).collect()
    for r in rows:
        steps[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.uint8)
    return steps


def cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def rare_signatures(sets: Sets, chosen: np.ndarray, percent: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, set id) of the chosen sets' first elements in the order of
    frequency and hash: as many as a set that links may lack, and one more."""
    member = np.flatnonzero(chosen[sets.owner])
    grams, owner = sets.grams[member], sets.owner[member]
    order = np.argsort(steps[cell(grams)], kind="stable")  # equal steps stay in order of hash
    order = order[np.argsort(owner[order].astype(np.uint16 if len(chosen) < 1 << 16 else np.int64), kind="stable")]
    grams, owner = grams[order], owner[order]
    sizes = np.where(chosen, sets.sizes, 0)
    rank = np.arange(len(grams)) - (np.cumsum(sizes) - sizes)[owner]
    first = rank <= (sizes - -(-percent * sizes // 100))[owner]
    return grams[first], sets.ids[owner[first]]


def star(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, smallest set) of each key and (key, set, smallest set) of the
    other sets of a key."""
    order = np.argsort(sets)
    order = order[np.argsort(keys[order], kind="stable")]
    keys, sets = keys[order], sets[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    other = ~head
    other[1:] &= sets[1:] != sets[:-1]
    smallest = sets[head][np.cumsum(head) - 1]
    return keys[head], sets[head], keys[other], sets[other], smallest[other]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sign_documents(docs: DataFrame, buckets: int, n_gram: int, percent: int, rarest: bool = False) -> DataFrame:
    """Rows of ``BLOBS``. Kind 0: documents (ids, set ids, sizes); kind 1:
    signatures with their smallest set, by bucket; kind 2: (signature, set,
    smallest set) for the others of a signature in this task."""
    schema = io.arrow_schema(BLOBS)
    steps = docs.sparkSession.sparkContext.broadcast(count_grams(docs, n_gram)) if rarest else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, waiting = [], [], 0

        def combined() -> Iterator[tuple]:
            k, s, *others = star(np.concatenate(keys), np.concatenate(sets))
            where = ((k >> U(32)) * U(buckets)) >> U(32)  # ascending, as the keys are
            cuts = np.searchsorted(where, np.arange(buckets + 1).astype(U))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                lo, hi = cuts[b], cuts[b + 1]
                yield 1, b, packed_sorted(k[lo:hi]), s[lo:hi].tobytes(), None
            if len(others[0]):
                yield 2, int(others[0][0] % U(buckets)), *(x.tobytes() for x in others)

        number = io.task_id()
        for piece in io.slices(batches, "text"):
            found = Sets(piece.column(1), n_gram)
            ids = piece.column(0)
            valid = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            _, first = np.unique(found.ids[valid], return_index=True)
            chosen = np.zeros(len(ids), bool)
            chosen[valid[first]] = True
            chosen &= found.sizes > 0
            k, s = rare_signatures(found, chosen, percent, steps.value) if rarest else signatures(found, chosen, percent)
            keys.append(k)
            sets.append(s)
            waiting += len(k)
            number += 1
            doc_ids = np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), np.iinfo(np.int64).min)
            rows = [(0, number % buckets, doc_ids.tobytes(), found.ids.tobytes(), found.sizes.astype(np.int64).tobytes())]
            if waiting > GATHER:
                rows += combined()
                keys, sets, waiting = [], [], 0
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if waiting:
            rows = list(combined())
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOBS)


def gather(blobs: DataFrame) -> DataFrame:
    """Rows of ``FOUND``. Kind 0: doc_id, set, size; kind 2: signature, set,
    smallest set of the signature."""
    schema = io.arrow_schema(FOUND)

    def joined(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), U)

    def keys(column: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([np.zeros(0, U), *[unpacked_sorted(x, U) for x in column.to_pylist()]])

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        out = []
        for kind in (0, 2):
            part = table.filter(pa.array(kinds == kind))
            out.append((kind, *(joined(part[c]) for c in "abc")))
        part = table.filter(pa.array(kinds == 1))
        _, _, *others = star(keys(part["a"]), joined(part["b"]))
        out.append((2, *others))
        return pa.concat_tables([pa.table([pa.array(np.full(len(x), k, np.int32)), as_long(x), as_long(y), as_long(z)], schema=schema) for k, x, y, z in out])

    return io.written(blobs.groupBy("bucket").applyInArrow(run, FOUND), "set-join-found")


# -- the prefix tree -------------------------------------------------------


def overlap_needed(a: int, b, percent: int):
    """Least intersection of sets of ``a`` and ``b`` elements that link."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """Sets as paths of a tree, ``STEP`` elements an edge.

    A node stands for a prefix; sets that share it share the overlap counted
    so far. ``levels[d]`` holds the edges of depth ``d``: the parent of each,
    its elements (numbered in the global order; ``absent`` beyond a set's
    end), and the smallest and largest size of the sets below it."""

    STEP = 32

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([np.zeros(0, U), *sets])
        self.known, numbers = np.unique(every, return_inverse=True)
        self.absent = len(self.known)
        width = -(-int(self.sizes.max(initial=1)) // self.STEP) * self.STEP
        table = np.full((len(sets), width), self.absent, np.int32)
        table[np.arange(width) < self.sizes[:, None]] = numbers
        self.levels, self.leaves = [], []
        node = np.zeros(len(sets), np.int64)
        for lo in range(0, width, self.STEP):
            here = np.flatnonzero(self.sizes > lo)
            edge = np.ascontiguousarray(table[here, lo : lo + self.STEP])
            key = np.concatenate([node[here, None].astype(np.int32), edge], axis=1)
            key = np.ascontiguousarray(key).view(f"V{key.shape[1] * 4}").ravel()
            _, first, child = np.unique(key, return_index=True, return_inverse=True)
            small, large = np.full(len(first), width + 1), np.zeros(len(first), np.int64)
            np.minimum.at(small, child, self.sizes[here])
            np.maximum.at(large, child, self.sizes[here])
            last = np.max(np.where(edge[first] < self.absent, edge[first], -1), axis=1)
            self.levels.append((node[here][first], edge[first], small, large, last))
            node[here] = child
            end = self.sizes[here] <= lo + self.STEP
            self.leaves.append((child[end], here[end]))

    def search(self, probe: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the stored sets that link with ``probe``."""
        n = len(probe)
        at = np.searchsorted(self.known, probe)
        at = at[(at < self.absent) & (self.known[np.minimum(at, self.absent - 1)] == probe)] if self.absent else at[:0]
        mine = np.zeros(self.absent + 1, np.int32)
        mine[at] = 1
        # a probe's element beyond the last one of a path can still be met
        passed = np.searchsorted(probe, self.known, "right")
        found = []
        counts = np.zeros(1, np.int64)
        alive = np.ones(1, bool)
        for depth, (parent, edge, small, large, last) in enumerate(self.levels):
            some = np.flatnonzero(alive[parent] & (100 * large >= percent * n) & (100 * n >= percent * small))
            total = np.zeros(len(parent), np.int64)
            total[some] = counts[parent[some]] + mine[edge[some]].sum(axis=1)
            done = (depth + 1) * self.STEP
            left = np.minimum(np.maximum(large[some] - done, 0), n - passed[last[some]])
            # the smallest set below that can link at all needs least
            least = np.maximum(small[some], -(-percent * n // 100))
            live = total[some] + left >= overlap_needed(n, least, percent)
            alive = np.zeros(len(parent), bool)
            alive[some[live]] = True
            counts = total
            nodes, sets = self.leaves[depth]
            size = self.sizes[sets]
            fits = alive[nodes] & (counts[nodes] >= overlap_needed(n, size, percent))
            found.append(sets[fits & (100 * np.minimum(size, n) >= percent * np.maximum(size, n))])
            if not alive.any():
                break
        return np.concatenate([np.zeros(0, np.int64), *found])


LINKS = "u long, v long"


def link_star(table: pa.Table, percent: int) -> pa.Table:
    """Links of the group's probe (``set`` = ``pivot``) with its other sets."""
    ids, pivot = table["set"].to_pylist(), table["pivot"][0].as_py()
    sets = [np.frombuffer(x, U) for x in table["grams"].to_pylist()]
    if pivot not in ids:
        raise ValueError("a pivot without its set")
    others = [i for i, x in enumerate(ids) if x != pivot]
    found = PrefixTree([sets[i] for i in others]).search(sets[ids.index(pivot)], percent).tolist() if others else []
    return pa.table([pa.array([ids[others[i]] for i in found], pa.int64()), pa.array([pivot] * len(found), pa.int64())], schema=io.arrow_schema(LINKS))


def link_groups(table: pa.Table, percent: int) -> pa.Table:
    """Links between sets with different labels, until they agree."""
    ids, labels = table["set"].to_pylist(), table["label"].to_pylist()
    sets = [np.frombuffer(x, U) for x in table["grams"].to_pylist()]
    root = {x: x for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree, links = PrefixTree(sets), []
    for i, probe in enumerate(sets):
        for j in tree.search(probe, percent).tolist():
            if find(labels[j]) != find(labels[i]):
                root[find(labels[j])] = find(labels[i])
                links.append((ids[i], ids[j]))
    return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=io.arrow_schema(LINKS))


# -- sketches --------------------------------------------------------------


def sketch(sets: Sets, bits: int = BITS) -> np.ndarray:
    """``bits`` bits for each set: which cells its elements' hashes fall into."""
    cells = np.zeros((len(sets.sizes), bits), bool)
    cells[sets.owner, (mix(sets.grams ^ U(0x3C3C3C3C3C3C3C3C)) % U(bits)).astype(np.int64)] = True
    return np.packbits(cells, axis=1)


def sketches_of(sets: Sets) -> list[bytes]:
    """A sketch for each set, of two bits an element or more: fewer than its
    elements would fill all cells and rule nothing out."""
    widths = np.maximum(BITS, 2 ** np.ceil(np.log2(np.maximum(2 * sets.sizes, 1))).astype(np.int64))
    out: list = [None] * len(widths)
    for width in np.unique(widths).tolist():
        same = np.flatnonzero(widths == width)
        for at in np.array_split(same, -(-len(same) * width // SKETCHED)):
            chosen = np.zeros(len(widths), bool)
            chosen[at] = True
            part = Sets.__new__(Sets)
            member = chosen[sets.owner]
            part.grams, part.owner, part.sizes = sets.grams[member], (np.cumsum(chosen) - 1)[sets.owner[member]], sets.sizes[at]
            for i, bits in zip(at.tolist(), sketch(part, width), strict=True):
                out[i] = bits.tobytes()
    return out


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The sketches of so many bytes, for wider ones: widths are powers of two."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, width), axis=1)


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with sketches ``a``, ``b`` and ``n``, ``m`` elements may
    link: a cell that only one of them has holds an element the other lacks."""
    shared = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return shared >= overlap_needed(n, m, percent)


def fitting(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``set, pivot`` those that sizes and sketches let link."""
    schema = io.arrow_schema("set long, pivot long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = [batch.column(c).to_pylist() for c in ("bits", "pivot_bits")]
                widths = np.array([[len(x) for x in c] for c in bits])
                size, pivot_size = (batch.column(c).to_numpy() for c in ("size", "pivot_size"))
                keep = np.zeros(batch.num_rows, bool)
                for kind in np.unique(widths, axis=1).T:
                    at = np.flatnonzero((widths == kind[:, None]).all(axis=0))
                    a, b = (folded(np.frombuffer(b"".join([c[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1), int(kind.min())) for c in bits)
                    keep[at] = may_link(a, b, size[at], pivot_size[at], percent)
                yield pa.record_batch([batch.column(c).filter(pa.array(keep)) for c in ("set", "pivot")], schema=schema)

    sizes = sketches.select("set", "size")
    sized = pairs.join(sizes, "set").join(sizes.select(F.col("set").alias("pivot"), F.col("size").alias("pivot_size")), "pivot")
    sized = sized.filter(100 * F.least("size", "pivot_size") >= percent * F.greatest("size", "pivot_size"))
    both = sized.join(sketches.select("set", "bits"), "set").join(sketches.select(F.col("set").alias("pivot"), F.col("bits").alias("pivot_bits")), "pivot")
    return both.select("set", "pivot", "size", "pivot_size", "bits", "pivot_bits").mapInArrow(run, "set long, pivot long")


# -- the join --------------------------------------------------------------

SETS = "set long, grams binary"
SKETCHES = "set long, size long, bits binary"


def fetch_sets(docs: DataFrame, wanted: DataFrame, n_gram: int, placed: bool = False, sketches: bool = False) -> DataFrame:
    """``set, grams`` (or ``set, size, bits``, their ``sketches``) for the sets
    ``wanted`` (``set, doc_id`` of one holder, written), computed where it is
    read. Where rows are ``placed``, no two share a doc_id, so a set comes
    once."""
    kinds = SKETCHES if sketches else SETS
    schema = io.arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in io.slices(batches, "text"):
            found = Sets(piece.column("text"), n_gram)
            if sketches:
                columns = [as_long(found.ids), pa.array(found.sizes.astype(np.int64)), pa.array(sketches_of(found), pa.binary())]
            else:
                columns = [as_long(found.ids), pa.array([found.grams[f : f + n].tobytes() for f, n in zip(found.first, found.sizes, strict=True)], pa.binary())]
            yield pa.record_batch(columns, schema=schema)

    holders = size_bounded_broadcast(wanted.select("doc_id"), 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(holders, "doc_id", "left_semi")
    found = texts.mapInArrow(run, kinds)
    return found if placed else found.dropDuplicates(["set"])


def _wanted(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the sets ``wanted`` those in ``nodes``, which are to be fetched."""
    return io.written(wanted.join(nodes, "set", "left_semi"), "set-join-sets")


def _dealt(rows: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """``key, parts``: tasks for each key, so that each has few sets, and few
    elements if the sets' ``sizes`` are given."""
    if sizes is None:
        return rows.groupBy(key).agg(F.ceil(F.count("*") / TREE_SETS).cast("int").alias("parts"))
    sized = rows.join(sizes.select("set", "size"), "set")
    return sized.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / TREE_SETS, F.sum("size") / TREE_GRAMS)).cast("int").alias("parts"))


def _part() -> Column:
    return F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select("set").union(edges.select("pivot")).distinct()


def link_pairs(docs: DataFrame, pairs: DataFrame, wanted: DataFrame, sketches: DataFrame, n_gram: int, percent: int, rarest: bool, placed: bool) -> DataFrame:
    """Links ``u, v`` among the pairs ``set, pivot`` of sets in ``wanted``."""
    edges = io.written(fitting(pairs, sketches, percent), "set-join-fitting")
    sets = fetch_sets(docs, _wanted(wanted, _nodes(edges)), n_gram, placed)
    dealt = io.written(_dealt(edges, "pivot", sketches if rarest else None), "set-join-dealt")
    members = edges.join(dealt, "pivot").select("pivot", "set", _part().alias("part"))
    probes = dealt.select("pivot", F.col("pivot").alias("set"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    places = size_bounded_broadcast(members.union(probes))  # few beside the sets, which are sent to their groups at once
    groups = sets.join(places, "set").select("pivot", "part", "set", "grams")
    return io.written(groups.groupBy("pivot", "part").applyInArrow(lambda t: link_star(t, percent), LINKS), "set-join-links")


def join_components(docs: DataFrame, n_gram: int = N_GRAM, percent: int = PERCENT, rarest: bool = False, placed: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document (``placed``: no
    two rows share a doc_id that isn't null)."""
    spark = docs.sparkSession
    buckets = 4 * io.shuffle_partitions(spark)
    found = gather(sign_documents(docs, buckets, n_gram, percent, rarest))
    none = np.iinfo(np.int64).min
    documents = found.filter("kind = 0").select(F.nullif("x", F.lit(none)).alias("doc_id"), F.col("y").alias("set"), F.col("z").alias("n_shingles"))
    holders = documents.filter("doc_id is not null and n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"))

    stars = found.filter("kind = 2").select(F.col("x").alias("key"), F.col("y").alias("set"), F.col("z").alias("pivot"))
    edges = io.written(stars.select("set", "pivot").distinct(), "set-join-edges")
    wanted = io.written(holders.join(_nodes(edges), "set"), "set-join-wanted")
    sketches = io.written(fetch_sets(docs, wanted, n_gram, placed, sketches=True), "set-join-sketches")
    links = link_pairs(docs, edges, wanted, sketches, n_gram, percent, rarest, placed)
    labels = io.written(graph.components(links), "set-join-labels")

    # pieces whose sets are still apart
    inside = stars.select("key", "set").union(stars.select("key", F.col("pivot").alias("set"))).distinct()
    inside = inside.join(labels, inside["set"] == labels["node"], "left").select("key", "set", F.coalesce("component", "set").alias("label"))
    inside = io.written(inside, "set-join-inside")
    apart = inside.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("sets")).filter("least <> most and sets > 2")  # a piece's only pair is settled
    apart = io.written(inside.join(apart.select("key", "least", "sets"), "key"), "set-join-apart")
    few = apart.filter(F.col("sets") <= FEW).select("key", "set", "label")
    others = few.select("key", F.col("set").alias("pivot"), F.col("label").alias("pivot_label"))
    pairs = few.join(others, "key").filter("pivot < set and pivot_label <> label").select("set", "pivot").distinct()
    links = links.union(link_pairs(docs, pairs, wanted, sketches, n_gram, percent, rarest, placed))

    many = apart.filter(F.col("sets") > FEW).select("set", "label", "least").distinct()
    areas = graph.components(many.select(F.col("label").alias("u"), F.col("least").alias("v")))
    open_sets = many.select("set", "label").distinct()
    open_sets = io.written(open_sets.join(areas, open_sets["label"] == areas["node"]).select(F.col("component").alias("area"), "set", "label"), "set-join-open")
    sets = fetch_sets(docs, _wanted(wanted, open_sets.select("set")), n_gram, placed)
    # an area of many sets is dealt into blocks, and a task joins two of them
    block = open_sets.join(_dealt(open_sets, "area", sketches if rarest else None), "area").withColumn("own", _part())
    block = block.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    places = size_bounded_broadcast(block.select("area", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set", "label"))
    block = sets.join(places, "set").select("area", "i", "j", "set", "label", "grams")
    more = block.groupBy("area", "i", "j").applyInArrow(lambda t: link_groups(t, percent), LINKS)
    links = io.written(links.union(more), "set-join-all-links")
    labels = io.written(graph.components(links), "set-join-components")

    joined = holders.join(labels, holders["set"] == labels["node"], "left").select("set", "doc_id", F.coalesce("component", "set").alias("component"))
    joined = io.written(joined, "set-join-joined")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = joined.join(least, "component").select("set", "component_id")
    filled = documents.filter("n_shingles > 0").join(of_set, "set", "left")
    filled = filled.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return filled.union(documents.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def first_documents(docs: DataFrame, n_gram: int, percent: int, stored: bool = False) -> DataFrame:
    """One row of each component of ``docs``: the first of those with the
    smallest doc_id. Rows are told apart by place (:func:`io.numbered`), so of
    rows that share a doc_id only those of other components stay; rows without
    one stay."""
    with io.recorded() as tables:
        numbered = io.numbered(docs, "set-join-rows", stored)
        texts = numbered.select(F.when(F.col("doc.doc_id").isNotNull(), F.col("place")).alias("doc_id"), F.col("doc.text").alias("text"))
        placed = join_components(texts, n_gram, percent, rarest=True, placed=True).select(F.col("doc_id").alias("place"), "component_id")
        placed = io.written(placed.filter("place is not null"), "set-join-placed")
        # a component's row: the smallest doc_id, then the first place
        ids = numbered.select("place", F.col("doc.doc_id").cast("long").alias("id"))
        linked = placed.groupBy("component_id").count().filter("count > 1").select("component_id")
        rows = placed.join(linked, "component_id").join(ids, "place")
        first = rows.groupBy("component_id").agg(F.min(F.struct("id", "place")).alias("first"))
        away = io.written(rows.join(first, "component_id").filter(F.col("place") != F.col("first.place")).select("place"), "set-join-away")
    discard(*(t for t in tables if t is not numbered and t is not away))
    return numbered.join(size_bounded_broadcast(away), "place", "left_anti").select("doc.*")


def op10_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(io.spread(io.documents(spark, sf_dir).select("doc_id", "text")))
