"""Parts without Spark: hashing, suffix arrays, packing plans, trees, ids."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wordfold.llm import hashing, io, packing, suffix_array
from wordfold.llm.blocks import packed, packed_sorted, unpacked, unpacked_sorted
from wordfold.llm.exact_dedup import ContentTable
from wordfold.llm.interpolated_lm import learn_weights
from wordfold.llm.langid import Classifier
from wordfold.llm.set_join import PrefixTree, Sets, signatures
from wordfold.llm.tokens import Encoder, default_vocabulary

TEXT = st.text(alphabet="aAbB é½日 \n\t'.,1\x00\x1c", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 4))
def test_words_and_shingles_are_those_of_each_text(texts, k):
    data, offsets = io.text_arrays(pa.array(texts, pa.string()))
    start, end, doc = hashing.word_bounds(data, offsets)
    found = [[] for _ in texts]
    for a, b, d in zip(start, end, doc, strict=True):
        found[d].append(data[a:b].tobytes())
    plain = [[w for w in bytes(c if c not in b" \t\n\x0b\x0c\r" else 32 for c in t.encode()).split(b" ") if w] for t in texts]
    assert found == plain
    hashes, owner = hashing.shingles(hashing.span_hashes(data, start, end), doc, k, len(texts))
    grams = {}
    for n, ws in enumerate(plain):
        ws = [w.lower() for w in ws]
        keys = list(zip(*[ws[i:] for i in range(k)], strict=False)) if len(ws) >= k else ([tuple(ws)] if ws else [])
        mine = hashes[owner == n].tolist()
        assert len(mine) == len(keys)
        for key, h in zip(keys, mine, strict=True):
            assert grams.setdefault(key, h) == h
    assert len(set(grams.values())) == len(grams)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=14), min_size=1, max_size=6), st.integers(1, 4))
def test_suffix_array_and_common_prefixes(strings, kinds):
    strings = [bytes(97 + b % kinds for b in s) if kinds < 4 else s for s in strings]
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    symbols, owner = suffix_array.join_strings(data, np.cumsum(sizes) - sizes, sizes)
    order = suffix_array.suffix_array(symbols)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    suffixes = [strings[owner[i]][i - begin[owner[i]] :] for i in order]
    assert sorted(order.tolist()) == list(range(len(symbols)))
    assert suffixes == sorted(suffixes)
    common = suffix_array.common_prefixes(symbols, order, 5)
    for a, b, n in zip(suffixes, suffixes[1:], common[1:], strict=False):
        same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert n == min(same, 5)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30))
def test_packed_arrays_come_back(values):
    x = np.array(values, np.uint64)
    assert unpacked(packed(x), np.uint64).tolist() == values
    assert unpacked_sorted(packed_sorted(np.sort(x)), np.uint64).tolist() == sorted(values)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_ids_are_the_librarys(texts):
    encoder = test_ids_are_the_librarys.__dict__.setdefault("encoder", Encoder(default_vocabulary()))
    for text in texts:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", None, "I'm it's 'tis we'll", "a  b", " a", "a ", "x1y2 3.14, <|endoftext|>", "<|endoftext|>", "é naïve  café", "'s 't", "a\x85b"])
def test_ids_of_odd_texts(text):
    """Against a tokenizer of its own: special strings have their own ids,
    unless they are to be plain text."""
    for plain in (False, True):
        library = Tokenizer.from_file(default_vocabulary())
        library.encode_special_tokens = plain
        encoder = Encoder(default_vocabulary(), remember=3, plain=plain)
        for _ in range(2):
            assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert text != "<|endoftext|>" or Encoder(default_vocabulary()).encode(text) == b"\x50\xc4"


def test_plan_fills_windows_and_uses_each_length_once():
    rng = np.random.default_rng(1)
    for window, top in ((64, 40), (64, 3), (100, 200)):
        histogram = {a: int(rng.integers(0, top)) + 1 for a in rng.choice(np.arange(1, window), window // 2, replace=False).tolist()}
        rows, n = packing.plan(histogram, window)
        fill = Counter()
        used = Counter()
        for length, lo, hi, first, place in sorted(rows, key=lambda r: (r[0], r[1])):
            assert used[length] == lo  # ranks are taken without gaps
            used[length] = hi
            for s in range(first, first + hi - lo):
                fill[s] += length
        assert all(fill[s] == window for s in range(n)) and len(fill) == n
        assert all(used[a] <= histogram[a] for a in used)


def test_least_squares_is_at_its_optimum():
    histogram = {30: 100, 70: 100, 20: 60, 50: 30, 10: 500}
    x = packing.repeat_counts(histogram, 100, sweeps=500, least_change=1e-6)
    left = dict(histogram)
    for combination, n in x.items():
        for a in combination:
            left[a] -= n
    for combination in packing.combinations(sorted(histogram), 100):
        slope = sum(left[a] for a in combination)
        assert abs(slope) < 1e-3 if x.get(combination) else slope < 1e-3
    assert all(n > 0 for n in x.values())


def test_contents_decide_not_hashes():
    table = ContentTable()
    entries = [table.add(7, c) for c in (b"a", b"b", b"a", b"c")]
    assert entries == [(0, True), (1, True), (0, False), (2, True)]
    for i in range(3000):
        assert table.add(i % 5, str(i).encode())[1]
    assert all(not table.add(i % 5, str(i).encode())[1] for i in range(3000))


def test_tree_finds_all_similar_sets():
    rng = random.Random(2)
    base = [sorted(rng.sample(range(10**6), rng.randrange(1, 60))) for _ in range(25)]
    sets = base + [sorted({*rng.sample(b, max(1, len(b) - rng.randrange(0, 4))), *rng.sample(range(10**6), rng.randrange(0, 3))}) for b in base * 3]
    arrays = [np.array(s, np.uint64) for s in sets]
    for percent in (80, 90):
        tree = PrefixTree(arrays)
        for i, probe in enumerate(arrays):
            near = [j for j, s in enumerate(sets) if 100 * len({*s} & {*sets[i]}) >= percent * len({*s} | {*sets[i]})]
            assert sorted(tree.search(probe, percent).tolist()) == near


def test_similar_sets_share_a_signature():
    rng = random.Random(3)
    for percent in (80, 90):
        texts = []
        for _ in range(60):
            words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 90))]
            other = [w if rng.random() > 0.03 else "z" for w in words][rng.randrange(0, 2) :]
            texts += [" ".join(words), " ".join(other)]
        sets = Sets(pa.array(texts), 1)
        every = [set(sets.grams[sets.owner == n].tolist()) for n in range(len(texts))]
        signs = {int(i): set() for i in sets.ids}
        for key, i in zip(*signatures(sets, sets.sizes > 0, percent), strict=True):
            signs[int(i)].add(int(key))
        for a in range(0, len(texts), 2):
            x, y = every[a], every[a + 1]
            if y and 100 * len(x & y) >= percent * len(x | y):
                assert signs[int(sets.ids[a])] & signs[int(sets.ids[a + 1])]


def test_weights_maximise_the_held_out_likelihood():
    rng = np.random.default_rng(4)
    ratio = np.exp(rng.normal(0, 2, 400))
    weights = learn_weights([(3, i, 1, float(r)) for i, r in enumerate(ratio)])
    likelihood = lambda w: np.log(w * ratio + 1 - w).sum()
    best = max(np.linspace(0.001, 0.999, 999), key=likelihood)
    assert abs(weights[3] - best) < 0.002 and weights[0] == weights[3] == weights[60]


def test_classifier_without_training_and_without_letters():
    assert Classifier({}).predict("text")[0] == "und"
    one = Classifier({"aa": b"some words of a language " * 20})
    assert one.predict("12 ½ !")[0] == "und" and one.predict(None)[0] == "und"
    assert one.predict("words")[0] == "aa"


def test_crc_of_split_ids_is_that_of_the_whole():
    ids = np.arange(100, dtype="<u4")
    assert zlib.crc32(ids[40:].tobytes(), zlib.crc32(ids[:40].tobytes())) == zlib.crc32(ids.tobytes())
