"""Queries stream over written blocks: nothing is copied, and single precision only picks."""

import random

import numpy as np
import pytest

from wordfold.operators import blocks, evaluate, ranking, vectors
from wordfold.operators.blocks import Marked, Top

RNG = np.random.default_rng(9)


@pytest.fixture(scope="module")
def words(spark):
    vecs = RNG.normal(size=(300, 8))
    vecs[100:200] = vecs[:100] + RNG.normal(size=(100, 8)) * 1e-10  # equal in single precision
    vecs[200:] *= 1e-3
    vecs[250] = 0.0
    return [(f"w{k:03}", v.tolist()) for k, v in enumerate(vecs)]


def dot(a, b):
    return sum((x * y for x, y in zip(a, b, strict=True)), 0.0)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("drop_self", [False, True])
def test_near_ties_and_no_copies(spark, words, drop_self, monkeypatch):
    monkeypatch.setattr(blocks, "QUERY_ROWS", 64)
    frame = spark.createDataFrame(words, "word string, vec array<double>")
    found = vectors.closest(frame.select("word"), frame, 5, 40, drop_self)
    assert "CoGroup" not in plan(found) and "Generate" not in plan(found) and "Join" not in plan(found)
    got = {(r.query, r.rank): r.word for r in found.collect()}
    for w, v in words:
        best = sorted(((dot(v, c), o) for o, c in words if not (drop_self and o == w)), reverse=True)[:5]
        assert [got[w, k] for k in range(1, 6)] == [o for _, o in best]


def test_ranks_with_near_ties(spark, words, monkeypatch):
    monkeypatch.setattr(ranking, "TILE_ROWS", 3)
    rng = random.Random(4)
    w = [(i, words[i * 3][1]) for i in range(40)] + [(40, [0.0] * 8)]
    h = [(j, v) for j, (_, v) in enumerate(words)]
    truth = [(i, j, 1.0) for i in range(42) for j in rng.sample(range(300), 25)]
    ignored = [(i, j) for i in range(42) for j in rng.sample(range(300), 30)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, vec array<double>")
    got = {(r.i, r.j): r["rank"] for r in ranking.rank_positives(
        spark.createDataFrame(truth, "i long, j long, v double"), frame(w), frame(h), spark.createDataFrame(ignored, "i long, j long"), 37).collect()}
    away, vec = set(ignored), dict(w)
    for i in range(42):
        order = [j for _, j in sorted((-dot(vec.get(i, [0.0] * 8), v), j) for j, v in h if (i, j) not in away)]
        want = {(i, j): order.index(j) + 1 for a, j, _ in truth if a == i and (i, j) not in away}
        assert {k: r for k, r in got.items() if k[0] == i} == want


def test_one_method_alone(spark, words):
    frame = vectors.normalize_vectors(spark.createDataFrame(words, "word string, vec array<double>"))
    q = spark.createDataFrame([(k, f"w{k:03}", f"w{k + 7:03}", "nosuch" if k % 9 == 0 else f"w{k + 40:03}") for k in range(0, 200, 3)], "qid long, a string, a_ string, b string")
    both = {(r.qid, r.method): r.guess for r in evaluate.analogy_guesses(q, frame, True, 64).collect()}
    for method in evaluate.METHODS:
        alone = evaluate.analogy_guesses(q, frame, True, 50, (method,))
        assert "CoGroup" not in plan(alone)
        assert {(r.qid, r.method): r.guess for r in alone.collect()} == {k: g for k, g in both.items() if k[1] == method}


def test_first_keys_run_out(spark, monkeypatch):
    """A row without factors whose first columns are all ignored."""
    monkeypatch.setattr(blocks, "FIRST_KEYS", 2)
    h = spark.createDataFrame([(j, [1.0 + j, -1.0]) for j in range(20)], "id long, vec array<double>")
    w = h.limit(0)
    ignored = spark.createDataFrame([(5, j) for j in range(9)] + [(6, j) for j in range(0, 19)] + [(8, 3)], "i long, j long")
    got = {}
    for r in ranking.recommend_topk(spark.range(5, 9), w, h, 3, ignored, 6).collect():
        got.setdefault(r.i, {})[r["rank"]] = (r.j, r.score)
    assert {i: [v[k][0] for k in sorted(v)] for i, v in got.items()} == {5: [9, 10, 11], 6: [19], 7: [0, 1, 2], 8: [0, 1, 2]}


def test_top_keeps_the_order_of_equal_scores():
    top = Top(2, 2, True)
    top.add(np.array([0, 0, 0]), np.array(["a", "c", "b"], object), np.array([1.0, 1.0, 1.0]))
    top.add(np.array([0, 1]), np.array(["z", "q"], object), np.array([1.0, -2.0]))
    assert top.key.tolist() == [["z", "c"], ["q", None]] and top.many.tolist() == [2, 1]
    import pyarrow as pa

    row, col = Marked(pa.array([[3, 5], [], [5]], pa.list_(pa.int64()))).cells(np.array([9, 5, 3]))
    assert sorted(zip(row.tolist(), col.tolist(), strict=True)) == [(0, 1), (0, 2), (2, 1)]
