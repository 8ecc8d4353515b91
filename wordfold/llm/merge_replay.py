"""Byte-level BPE by replaying the merges over all words of a slice at once.

A task holds a slice of the corpus (``SLICE_BYTES`` of texts). Its different
words that no earlier slice of the worker had are laid out as one array of
symbols, a byte each. An inverted index gives for every rank the positions of
the pairs that it merges. The ranks are replayed in ascending order, each over
all of its positions together, and only the neighbours of a merged pair are
looked up and filed again. The words' ids then stand for all places of the
words. Texts never leave their task: nothing is shuffled and a lost task is
simply run again.

The ids are those of tiktoken: a word of the vocabulary is its own id; in any
other the pair of lowest rank, the leftmost of equal ones, is merged first. A
rank file may allow a new pair of a lower rank than the merge that made it;
words in which that happens are encoded one by one (``encode_word``).

Null and empty texts have no ids. Rows keep their ``doc_id``, null and repeated
ones too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordfold.llm import io

#: Texts whose words are replayed together.
SLICE_BYTES = 6 << 20
#: Symbols of one replay; more words make another one.
REPLAY_BYTES = 8 << 20
#: Words that a worker remembers, and pieces.
REMEMBER = 500_000
#: Bytes of ids or decoded texts in a batch sent on.
BATCH_BYTES = 2 << 20

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, bytes binary"
_NONE = np.int64(1 << 40)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a file with lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain merging of one word, the lowest rank first."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Merges:
    """All pairs of tokens whose joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        pairs = sorted((ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.keys = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.made = np.array([p[1] for p in pairs] or [_NONE], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, ``_NONE`` where it doesn't."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], _NONE)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word (none of them empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(words) else 0
        symbol = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 1)
        after[ends - 1] = n  # a word's last symbol has none after it
        before = np.arange(-1, n - 1)
        before[ends - sizes] = n
        merges = np.full(n + 1, _NONE)  # what the pair that starts here merges into
        inner = np.flatnonzero(after < n)
        merges[inner] = self.of(symbol[inner], symbol[inner + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []
        lowered: list[np.ndarray] = []

        def file(at: np.ndarray) -> None:
            """Into the index, by rank."""
            ranks = merges[at]
            at, ranks = at[ranks < _NONE], ranks[ranks < _NONE]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(waiting, rank)
                index[rank].append(part)

        file(inner)
        while waiting:
            rank = heapq.heappop(waiting)
            parts = index.pop(rank)
            at = np.sort(np.concatenate(parts))
            at = at[(merges[at] == rank) & np.r_[True, at[1:] != at[:-1]]]  # filed twice at most
            if not len(at):
                continue
            if len(at) > 1:  # of pairs in a row that overlap, every other one from the left
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                if chained.any():
                    run = np.arange(len(at))
                    run -= np.maximum.accumulate(np.where(chained, 0, run))
                    at = at[run % 2 == 0]
            gone = after[at]
            beside = np.flatnonzero(after[gone[:-1]] == at[1:]) if len(at) > 1 else at[:0]
            if len(beside):  # merged one by one, the left would first stand before the right's old symbol
                low = self.of(np.full(len(beside), rank), symbol[at[beside + 1]]) < rank
                if low.any():
                    lowered.append(at[beside[low]])
            symbol[at] = rank
            alive[gone] = False
            merges[gone] = _NONE
            then = after[gone]
            after[at] = then
            inside = then < n
            before[then[inside]] = at[inside]
            merges[at] = _NONE
            right = at[inside]
            merges[right] = self.of(symbol[right], symbol[after[right]])
            left = before[at]
            left = left[left < n]
            merges[left] = self.of(symbol[left], symbol[after[left]])
            touched = np.concatenate([left, right])
            low = touched[merges[touched] < rank]
            if len(low):
                lowered.append(low)
            file(touched)
        words_of = np.searchsorted(ends, np.flatnonzero(alive), "right")
        counts = np.bincount(words_of, minlength=len(words))
        flat = symbol[alive].tolist()
        cuts = np.cumsum(counts).tolist()
        out = [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        for w in np.unique(np.searchsorted(ends, np.concatenate(lowered), "right")).tolist() if lowered else []:
            out[w] = encode_word(words[w], self.ranks)
        return out


class Replayer:
    """Ids of texts; one per Python worker.

    The pattern always cuts before a single space or line feed between other
    characters, so texts are first cut there, and only pieces not met before
    are cut by the pattern. Texts with other white space are cut by it whole.
    ``words`` and ``pieces`` have ids as little-endian 32-bit integers; a piece
    that the rule doesn't hold for has None."""

    MARK = "\x01"

    def __init__(self, path: str, pattern: str, remember: int = REMEMBER):
        import regex

        self.ranks = read_ranks(path)
        self.merges = Merges(self.ranks)
        self.cut = regex.compile(pattern).findall
        self.plain = regex.compile(r"[ \n]?\S+").fullmatch
        self.remember = remember
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}

    def _learn(self, words: Iterable[str]) -> None:
        batch: list[str] = []
        raw: list[bytes] = []
        held = 0

        def replay() -> None:
            for word, ids in zip(batch, self.merges.replay(raw), strict=True):
                self.words[word] = np.array(ids, "<i4").tobytes()
            batch.clear()
            raw.clear()

        for word in words:
            data = word.encode()
            if data in self.ranks:
                self.words[word] = np.array([self.ranks[data]], "<i4").tobytes()
                continue
            batch.append(word)
            raw.append(data)
            held += len(data)
            if held > REPLAY_BYTES:
                replay()
                held = 0
        if batch:
            replay()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes."""
        for memory in (self.words, self.pieces):
            if len(memory) > self.remember:
                memory.clear()
        mark, words, pieces = self.MARK, self.words, self.pieces
        cut = [t.replace(" ", mark + " ").replace("\n", mark + "\n").split(mark) if t and mark not in t else None for t in texts]
        seen = set().union(*filter(None, cut))
        new = {p: self.cut(p) if self.plain(p) else None for p in seen.difference(pieces)}
        odd = {p for p in seen if new.get(p, pieces.get(p, b"")) is None}
        whole = [n for n, (t, ps) in enumerate(zip(texts, cut, strict=True)) if t and (not ps or odd and not odd.isdisjoint(ps))]
        for n in whole:
            cut[n] = self.cut(texts[n])
        self._learn(set().union(*filter(None, new.values()), *(cut[n] for n in whole)).difference(words))
        for p, ws in new.items():
            pieces[p] = None if ws is None else b"".join(map(words.__getitem__, ws))
        of = dict.fromkeys(whole, words)
        return [b"".join(map(of.get(n, pieces).__getitem__, ps)) if ps else b"" for n, ps in enumerate(cut)]


@lru_cache(maxsize=1)
def replayer(path: str, pattern: str) -> Replayer:
    return Replayer(path, pattern)


@lru_cache(maxsize=1)
def token_bytes(path: str) -> tuple[bytes, ...]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tuple(table)


def _lists(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def _bounded(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each."""
    part = np.cumsum(np.fromiter(sizes, np.int64)) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    if len(part):
        yield from zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(part)].tolist(), strict=True)


def encoding(ranks: str, pattern: str):
    """A step from batches ``doc_id, text`` to batches of ``ENCODED``."""
    schema = io.arrow_schema(ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replayer(ranks, pattern)
        for piece in io.gathered(batches, "text", SLICE_BYTES):
            ids = encoder.encode(piece.column(1).to_pylist())
            for a, b in _bounded(map(len, ids), BATCH_BYTES):
                yield pa.record_batch([piece.column(0).slice(a, b - a), _lists(ids[a:b])], schema=schema)

    return run


def decoding(ranks: str):
    """A step from batches of ``ENCODED`` to batches of ``DECODED``."""
    schema = io.arrow_schema(DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks)
        known = frozenset(i for i, t in enumerate(table) if t)
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_pylist()
            if bad := set(flat) - known:
                raise ValueError(f"no token has the id {min(bad, key=str)}")
            stops = np.cumsum(np.diff(column.offsets.to_numpy())).tolist()
            texts = [b"".join(map(table.__getitem__, flat[a:b])) for a, b in zip([0, *stops], stops, strict=False)]
            for a, b in _bounded(map(len, texts), BATCH_BYTES):
                yield pa.record_batch([batch.column(0).slice(a, b - a), column.slice(a, b - a), pa.array(texts[a:b], pa.binary())], schema=schema)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every row's text."""
    return _texts(docs).mapInArrow(encoding(ranks or default_ranks(), pattern or default_pattern()), ENCODED)


def decode_documents(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Rows of ``doc_id, ids`` with the ``bytes`` that the ids stand for. An id
    without a token is an error; null ids are none."""
    given = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return given.mapInArrow(decoding(ranks or default_ranks()), DECODED)


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``decode_documents(encode_documents(docs))`` in one pass of a worker."""
    ranks = ranks or default_ranks()
    encode, decode = encoding(ranks, pattern or default_pattern()), decoding(ranks)
    return _texts(docs).mapInArrow(lambda batches: decode(encode(batches)), DECODED)


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = round_trip(io.spread(io.documents(spark, sf_dir)))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
