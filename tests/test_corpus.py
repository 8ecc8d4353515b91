"""Corpus -> pairs -> counts: hand-made cases and properties."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_lines import lines_df
from wordfold.operators import corpus
from wordfold.plans.ppmi import CorpusParams, counts_from_lines


def pairs_of(spark, texts, thr=1, win=2, delete=True, positional=False, dyn=False, sub=0.0, chunk=16384):
    lines = lines_df(spark, texts)
    p = CorpusParams(thr=thr, win=win, delete=delete, positional=positional, dyn=dyn, sub=sub, chunk_tokens=chunk)
    c = counts_from_lines(lines, p, materialize=False)
    return Counter({(r.word, r.context): r.n for r in c.collect()})


def brute_pairs(texts, vocab, win, delete, positional=False):
    """Straight restatement of the windowing rule (no subsampling)."""
    out = Counter()
    for t in texts:
        for line in t.split("\n"):
            toks = [x if x in vocab else None for x in line.split()]
            if delete:
                toks = [x for x in toks if x is not None]
            for i, tok in enumerate(toks):
                if tok is None:
                    continue
                for j in range(max(0, i - win), min(len(toks), i + win + 1)):
                    if j != i and toks[j] is not None:
                        out[(tok, f"{toks[j]}_{j - i}" if positional else toks[j])] += 1
    return out


def test_window_one_and_two(spark):
    got1 = pairs_of(spark, ["a b a c"], win=1)
    assert got1 == Counter({("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1})
    got2 = pairs_of(spark, ["a b a c"], win=2)
    assert got2 == brute_pairs(["a b a c"], {"a", "b", "c"}, 2, True)
    assert got2[("a", "a")] == 2 and got2[("b", "c")] == 1


def test_positional_contexts(spark):
    got = pairs_of(spark, ["a b a c"], win=1, positional=True)
    assert got[("a", "b_1")] == 1 and got[("b", "a_-1")] == 1 and got[("b", "a_1")] == 1


def test_oov_deletion_makes_neighbours(spark):
    # b appears once, threshold 2 makes it out of vocabulary
    texts = ["a b a c", "c"]
    with_del = pairs_of(spark, texts, thr=2, win=1, delete=True)
    without = pairs_of(spark, texts, thr=2, win=1, delete=False)
    assert with_del[("a", "a")] == 2
    assert without[("a", "a")] == 0


def test_degenerate_lines(spark):
    assert pairs_of(spark, ["", "   ", "x", "\n\n"], thr=1, win=2) == Counter()
    assert pairs_of(spark, ["zz yy", "a a a"], thr=3, win=2) == Counter({("a", "a"): 6})


@pytest.mark.parametrize("chunk", [2, 3, 5])
@pytest.mark.parametrize("delete", [True, False])
def test_chunked_matches_brute_force(spark, chunk, delete):
    rnd = random.Random(chunk * 10 + delete)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) + "\n" +
             " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(15)]
    tok = Counter(x for t in texts for x in t.split())
    vocab = {w for w, n in tok.items() if n >= 20}
    got = pairs_of(spark, texts, thr=20, win=3, delete=delete, chunk=chunk)
    assert got == brute_pairs(texts, vocab, 3, delete)
    got_pos = pairs_of(spark, texts, thr=20, win=2, delete=delete, positional=True, chunk=chunk)
    assert got_pos == brute_pairs(texts, vocab, 2, delete, positional=True)


def test_dynamic_window_mean(spark):
    lines = lines_df(spark, [" ".join(["t"] * 4000)])
    voc = corpus.subsample_prob(corpus.vocab(lines, 1), 0.0)
    kept = corpus.mask_tokens(lines, voc)
    n_pairs = corpus.window_pairs(kept, win=4, dyn=True).count()
    # interior centres see 2 * w contexts with w uniform on 1..4 -> mean 5 per centre
    assert abs(n_pairs / 4000 - 5.0) < 0.25


def test_subsample_keep_rate(spark):
    lines = lines_df(spark, [" ".join(["f"] * 9000 + ["r"] * 1000)])
    voc = corpus.subsample_prob(corpus.vocab(lines, 1), 0.01)
    p = {r.word: r.p_drop for r in voc.collect()}
    # T = 0.01 * 10000 = 100 -> p_drop(f) = 1 - sqrt(100/9000), p_drop(r) = 1 - sqrt(100/1000)
    assert abs(p["f"] - (1 - (100 / 9000) ** 0.5)) < 1e-12
    kept = corpus.mask_tokens(lines, voc).groupBy("word").count().collect()
    rate = {r.word: r["count"] for r in kept}
    assert abs(rate["f"] / 9000 - (100 / 9000) ** 0.5) < 0.03
    assert abs(rate["r"] / 1000 - (100 / 1000) ** 0.5) < 0.05


def test_partition_count_invariance(spark, sf):
    from wordfold.plans import fixtures as fx

    lines = fx.corpus_lines(spark, sf)
    p = CorpusParams(thr=5, win=2, sub=1e-3, delete=True, dyn=True)
    a = counts_from_lines(lines.repartition(1), p, materialize=False)
    b = counts_from_lines(lines.repartition(7), p, materialize=False)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_delete_placeholders_dense(spark):
    lines = lines_df(spark, ["a x b x x c a"])
    voc = corpus.subsample_prob(corpus.vocab(lines, 2), 0.0)  # keeps a, x
    kept = corpus.mask_tokens(lines, voc, chunk_tokens=2)
    q = [(r.q, r.word) for r in corpus.delete_placeholders(kept, chunk_tokens=2).orderBy("q").collect()]
    assert q == [(0, "a"), (1, "x"), (2, "x"), (3, "x"), (4, "a")]


def test_assign_ids_dense_sorted(spark):
    df = spark.createDataFrame([(w,) for w in ["d", "b", "a", "c", "b"]], "word string").repartition(3)
    ids = {r.word: r.id for r in corpus.assign_ids(df, "word", "id").collect()}
    assert ids == {"a": 0, "b": 1, "c": 2, "d": 3}
