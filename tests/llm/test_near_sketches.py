"""Only sets that may link are fetched and sent; many sets of a piece find their links as few do."""

import random

import numpy as np
import pytest
from wordfold.llm import io, set_join

WORDS = [f"w{i}" for i in range(400)]


def grams(text, n=5):
    words = text.split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def components(texts, percent=80):
    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def corpus(seed):
    """Chains of texts that drift apart, and a passage that unlinked texts share."""
    rng = random.Random(seed)
    passage, texts = rng.choices(WORDS, k=12), []
    for _ in range(6):
        text = rng.choices(WORDS, k=60)
        for _ in range(5):
            text = [*text[rng.randint(1, 6):], *rng.choices(WORDS, k=rng.randint(1, 4))]
            texts.append(" ".join(text))
    return texts + [" ".join([*passage, *rng.choices(WORDS, k=14)]) for _ in range(12)]


@pytest.mark.parametrize("few", [0, 3, 32])
def test_components_however_pieces_are_compared(spark, monkeypatch, few):
    monkeypatch.setattr(set_join, "FEW", few)
    texts = corpus(7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in set_join.join_components(docs, 5, 80, rarest=True).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)


def test_sets_that_cannot_link_are_not_fetched(spark, monkeypatch):
    fetched, write = [], io.written

    def written(df, name, *more):
        out = write(df, name, *more)
        if name == "set-join-sets":
            fetched.append(out.count())
        return out

    monkeypatch.setattr(io, "written", written)
    rng = random.Random(3)
    shared = " ".join(rng.choices(WORDS, k=6))
    texts = [shared + " " + " ".join(rng.choices(WORDS, k=9)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in set_join.join_components(docs, 5, 80, rarest=True).collect()} == set(range(20))
    assert sum(fetched) == 0


def test_sketches_never_rule_a_link_out():
    rng = np.random.default_rng(1)
    for n in (1, 4, 60, 3000):
        whole = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for drop in range(0, n // 5 + 1, max(1, n // 40)):
            sets = set_join.Sets.__new__(set_join.Sets)
            part = whole[drop:]
            sets.grams, sets.owner = np.concatenate([whole, part]), np.repeat([0, 1], [len(whole), len(part)])
            sets.sizes = np.array([len(whole), len(part)])
            bits, (a, b) = set_join.sketch(sets), sets.sizes
            if 100 * b >= 80 * a:
                assert set_join.may_link(bits[:1], bits[1:], np.array([a]), np.array([b]), 80).all()
