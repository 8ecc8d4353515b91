"""Similarity, lookups and top contexts on packed ids equal those on words."""

import random

import pytest

from wordfold.operators import corpus, lookup, sparse, vectors, windows
from wordfold.plans.ppmi import CorpusParams, epmi_ids
from wordfold.sources.text import read_corpus

P = CorpusParams(thr=2, win=2, cds=0.75, delete=True)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    texts = [(d, " ".join(f"w{int(rng.paretovariate(0.8)) % 40:02}" for _ in range(rng.randrange(5, 50)))) for d in range(50)]
    before, windows.BUCKET = windows.BUCKET, 40
    ep, voc, n, dense = epmi_ids(read_corpus(spark.createDataFrame(texts, "doc_id long, text string")), P, by_word=True)
    windows.BUCKET = before
    m = vectors.representation("PPMI", epmi=ep, neg=1.2, dense=dense)
    named = lambda cells: corpus.decode_counts(cells, voc, P.win, False)
    return m, voc, n, named, named(m).cache()


def found(df, *columns):
    return sorted((*r[:-1], round(r[-1], 9)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("together", [3, 256])
def test_similarity(spark, model, monkeypatch, together):
    monkeypatch.setattr(sparse, "PAIRS_TOGETHER", together)
    m, voc, _, _, plain = model
    pairs = spark.createDataFrame([(f"w{a:02}", f"w{b:02}") for a in range(0, 41, 3) for b in range(1, 41, 4)] + [("w03", "w05"), ("none", "w01")], "w1 string, w2 string")
    got = vectors.explicit_similarity(pairs, m, ids=voc)
    assert found(got, "w1", "w2", "sim") == found(vectors.explicit_similarity(pairs, plain), "w1", "w2", "sim")


def test_first_order(spark, model):
    m, voc, n, named, plain = model
    pairs = spark.createDataFrame([(f"w{a:02}", f"w{b:02}") for a in range(0, 41, 3) for b in range(0, 41, 2)] + [("none", "w01"), ("w01", None)], "word string, context string")
    got = vectors.explicit_first_order(pairs, m, voc, n, named)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert found(got.na.fill(""), "word", "context", "sim") == found(vectors.explicit_first_order(pairs, plain).na.fill(""), "word", "context", "sim")
    assert plan.count("MapInArrow") == 1  # cells are picked and named where they are unpacked


def test_top_contexts(model):
    m, _, _, named, plain = model
    assert lookup.is_packed(sparse.most(m, 3))
    assert sparse.most(m, 3).count() < m.count()
    got = vectors.explicit_closest_contexts(None, m, 3, named)
    assert found(got, "query", "rank", "word", "score") == found(vectors.explicit_closest_contexts(plain.select("word"), plain, 3), "query", "rank", "word", "score")
