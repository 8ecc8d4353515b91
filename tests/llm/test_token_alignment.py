"""Alignment and spill counting against plain loops over all tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wordfold.llm import token_alignment as t
from wordfold.llm import tokens
from wordfold.llm.catalog import QUERIES

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(tokens.default_vocabulary())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=t.default_pieces())
        letters = {c: b for b, c in tokens._byte_letters().items()}
        self.bytes_a = {i: bytes(letters.get(c, 0) for c in e) for e, i in self.a.get_vocab().items()}

    def spans(self, parts):
        end = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *end], end, strict=False))

    def piece(self, i):
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    def aligned(self, text):
        """(n_a, n_b, n_groups, n_links, groups) and the links."""
        data = (" " + (text or "")).encode()
        a, b = self.a.encode(data.decode(), add_special_tokens=False).ids, self.b.encode(text or "")
        parts_a, parts_b = [self.bytes_a[i] for i in a], [self.piece(i) for i in b]
        if not text or b"".join(parts_a) != data or b"".join(parts_b) != data:
            return (0, 0, 0, 0, ""), []
        spans_a, spans_b = self.spans(parts_a), self.spans(parts_b)
        starts = {}
        for j, (lo, hi) in enumerate(spans_b):
            starts.update(dict.fromkeys(range(lo, hi), j))
        links = [(a[i], b[j]) for i, (lo, hi) in enumerate(spans_a) for j in sorted({starts[x] for x in range(lo, hi)})]
        ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        of = {e: n for n, e in enumerate(ends)}
        groups = [([], []) for _ in ends]
        for side, (ids, spans) in enumerate(((a, spans_a), (b, spans_b))):
            n = 0
            for i, (_, end) in zip(ids, spans, strict=True):
                groups[n][side].append(str(i))
                n = of.get(end, n - 1) + 1
        return (len(a), len(b), len(ends), len(links), ";".join("|".join(map(",".join, g)) for g in groups)), links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, rows):
    found = [(d, *plain.aligned(text)) for d, text in rows]
    count = Counter(p for _, _, links in found for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    return Counter((d, *own[:4], sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), own[4]) for d, own, links in found)


def hashed(rows):
    return Counter({(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else ""): n for r, n in rows.items()})


def test_the_table(spark, sf, documents, plain):
    found = Counter(tuple(r) for r in QUERIES["op13_spill_alignment"](spark, sf).select(*COLUMNS).collect())
    assert found == hashed(expected(plain, documents.items()))


def test_odd_rows_in_many_runs(spark, odd, odd_rows, nothing, plain, monkeypatch):
    for name, value in (("BLOCK_BYTES", 2000), ("FAN", 2), ("SHARE", 2), ("FRAME", 7), ("RADIX", 3)):
        monkeypatch.setattr(t, name, value)
    special = [(90, "<|endoftext|> a<|endoftext|>"), (91, "<s> </s> <unk> <0x0A>"), (92, "a▁b"), (93, "▁"), (94, "x\x01y"), (95, "\nfirst line\nnext  one \n")]
    rows = [*odd_rows, *special]
    table = odd.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id long, text string")).repartition(3)
    found = Counter(tuple(r) for r in t.aligned_documents(table).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect())
    assert found == expected(plain, rows)
    assert t.aligned_documents(nothing).count() == 0
    assert t.aligned_documents(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).count() == 2


def test_blocks_of_random_texts(plain):
    rng = random.Random(2)
    aligner = t.aligner(tokens.default_vocabulary(), t.default_pieces())
    letters = " \n\t\r'aabbc1.,é日\x00\x1c\x85 　ſ\U0001f600st▁<s>"
    for _ in range(15):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(30)]
        block = aligner.block(texts)
        for n, text in enumerate(texts):
            own, links = plain.aligned(text)
            assert (*(int(c[n]) for c in block.counts), block.groups[n]) == own
            assert sorted(block.codes[block.owner == n].tolist()) == sorted(a * aligner.n_b + b for a, b in links)


def test_runs_merge_by_frames(monkeypatch):
    monkeypatch.setattr(t, "FRAME", 3)
    rng = random.Random(4)
    for _ in range(50):
        runs = [{rng.randrange(30): rng.randrange(1, 9) for _ in range(rng.randrange(12))} for _ in range(rng.randrange(6))]
        blobs = [t.run_bytes(np.array(sorted(r), np.int64), np.array([r[c] for c in sorted(r)], np.int64)) for r in runs]
        merged = list(t.merge([t.frames(b) for b in blobs]))
        codes = [c for f in merged for c in f[0].tolist()]
        assert codes == sorted(set().union(*runs)) and all(len(f[0]) <= 3 * len(runs) for f in merged)
        assert dict(zip(codes, [n for f in merged for n in f[1].tolist()], strict=True)) == dict(sum((Counter(r) for r in runs), Counter()))
