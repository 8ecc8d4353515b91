"""Packed cells: steps in one pass, cells by word, query blocks that tasks read."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wordfold.operators import corpus, lookup, sparse, vectors, windows
from wordfold.plans.ppmi import CorpusParams, epmi_ids
from wordfold.sources.text import read_corpus


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(5)
    texts = [(d, " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(5, 60)))) for d in range(60)]
    return read_corpus(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).cache()


P = CorpusParams(thr=2, win=2, cds=0.75, delete=True)


def rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("by_word", [False, True])
def test_steps_on_packed_cells_stay_packed(spark, lines, monkeypatch, by_word):
    monkeypatch.setattr(windows, "BUCKET", 50)
    ep, voc, n, dense = epmi_ids(lines, P, by_word=by_word)
    plain = ep.select("word", "context", "n", "epmi")  # a plain frame of the same cells
    for of in (lambda e, k: vectors.representation("PPMI", epmi=e, neg=1.5, dense=k), lambda e, k: vectors.explicit_vectors(e, True, dense=k)):
        found, wanted = of(ep, lookup.Named.of(dense, voc)), of(plain, None)
        assert lookup.is_packed(found) and not lookup.is_packed(wanted)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        both = [rows(corpus.decode_counts(x, voc, P.win, False), "word", "context", "v") for x in (found, wanted)]
        assert both[0] == both[1] and both[0]


def test_cells_by_word_follow_each_other(lines, monkeypatch):
    monkeypatch.setattr(windows, "BUCKET", 50)
    monkeypatch.setattr(windows, "ROWS", 7)
    ep, voc, n, _ = epmi_ids(lines, P, by_word=True)
    other = epmi_ids(lines, P)[0]
    assert ep.agg(F.sum("n"), F.count("*"), F.round(F.sum("epmi"), 6)).first() == other.agg(F.sum("n"), F.count("*"), F.round(F.sum("epmi"), 6)).first()
    seen = ep.select("word", "context", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("k")).orderBy("k").collect()
    runs = [a.word for a, b in zip(seen, [None, *seen], strict=False) if b is None or (a.p, a.word) != (b.p, b.word)]
    assert len(runs) == len(set(runs)) and all(a.context < b.context for a, b in zip(seen, seen[1:], strict=False) if (a.p, a.word) == (b.p, b.word))


@pytest.mark.parametrize("limit", [400, 1 << 20])
def test_neighbours_on_ids_move_no_candidate(spark, lines, monkeypatch, limit):
    monkeypatch.setattr(sparse, "QUERY_BYTES", limit)
    ep, voc, n, dense = epmi_ids(lines, P, by_word=True)
    m = vectors.representation("PPMI", epmi=ep, neg=1.0, dense=dense)
    asked = spark.createDataFrame([(f"w{k}",) for k in range(0, 60, 2)] + [("unknown",)], "word string")
    report = {}
    found = vectors.explicit_closest(asked, m, 4, report, lambda r: corpus.decode_counts(r, voc, P.win, False), voc)
    assert (report["blocks"] > 1) == (limit == 400)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroups" not in plan
    cells = defaultdict(dict)
    for r in corpus.decode_counts(m, voc, P.win, False).collect():
        cells[r.word][r.context] = r.v
    got = defaultdict(dict)
    for r in found.collect():
        got[r.query][r.rank] = r.score
    for q in (f"w{k}" for k in range(0, 60, 2)):
        best = sorted((sum(v * o[c] for c, v in cells[q].items() if c in o) for o in cells.values() if q in cells and set(cells[q]) & set(o)), reverse=True)[:4]
        assert [got[q][k] for k in sorted(got[q])] == pytest.approx(best)


def test_rows_that_share_nothing_with_the_queries():
    import numpy as np

    def rows(word, contexts):
        out = sparse.Rows.__new__(sparse.Rows)
        out.words, out.contexts, out.values = np.array([word], object), np.array(contexts), np.ones(len(contexts))
        out.starts = np.array([0, len(contexts)])
        return out

    q = sparse.Queries(rows("q", [1, 2]))
    best = sparse.Best(q, 3)
    best.meet(q, rows("a", [5, 6]))
    best.meet(q, rows("b", [2, 6]))
    assert best.words.tolist() == ["b"] and best.score.tolist() == [1.0]
