"""Neighbours and products by blocks against plain loops, with ties."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordfold.functions import vec as V
from wordfold.operators import blocks, coo, evaluate, ranking, sparse, vectors
from wordfold.session import row_bytes, size_bounded_broadcast

RNG = random.Random(8)
DISTINCT = [[RNG.uniform(-1, 1) * 2.0 ** -(n % 5) for _ in range(6)] for n in range(40)]
WORDS = [(f"w{n}", DISTINCT[n % 40]) for n in range(400)]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(WORDS, "word string, vec array<double>").repartition(5)


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def closest_plain(query, n):
    vec = dict(WORDS).get(query, [0.0] * 6)
    return sorted(((dot(vec, v), w) for w, v in WORDS), reverse=True)[:n]


@pytest.mark.parametrize("block_rows", [33, 4096])
def test_closest_with_equal_vectors(spark, words, block_rows):
    asked = spark.createDataFrame([(w,) for w, _ in WORDS] + [("unknown",)], "word string")
    report = {}
    rows = vectors.closest(asked, words, 7, block_rows, report=report).collect()
    found = defaultdict(dict)
    for r in rows:
        found[r.query][r.rank] = (r.score, r.word)
    assert {q: [by[k] for k in sorted(by)] for q, by in found.items()} == {q: closest_plain(q, 7) for q in [*dict(WORDS), "unknown"]}
    if block_rows == 33:
        assert report["met"] < report["pairs"] == 401 * 13  # norms fall by powers of two: blocks are skipped
    own = vectors.closest_contexts(asked.limit(5), words, words, 3, block_rows).count()
    assert own == 15


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_topk_skips_short_columns_but_no_result(spark, block_rows):
    rng = random.Random(2)
    w = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)]
    h = [(j, [rng.uniform(-1, 1) * 2.0 ** -(j % 6) for _ in range(4)]) for j in range(90)]
    h += [(j + 90, v) for j, v in h[:20]]  # equal columns
    ignored = [(i, j) for i in range(30) for j in rng.sample(range(110), 40)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, vec array<double>")
    report = {}
    rows = ranking.recommend_topk(spark.range(31), frame(w), frame(h), 5, spark.createDataFrame(ignored, "i long, j long"), block_rows, report).collect()
    found = defaultdict(dict)
    for r in rows:
        found[r.i][r.rank] = (r.j, r.score)
    away = set(ignored)
    for i in range(31):
        vec = dict(w).get(i, [0.0] * 4)
        best = sorted(((-dot(vec, v), j) for j, v in h if (i, j) not in away))[:5]
        assert [found[i][k] for k in range(1, 6)] == [(j, -s) for s, j in best]
    assert block_rows != 7 or report["met"] < report["pairs"]


def test_scores_do_not_depend_on_the_block():
    a, b = np.random.default_rng(1).normal(size=(70, 9)), np.random.default_rng(2).normal(size=(50, 9))
    assert np.array_equal(blocks.block_scores(a, b)[40:41, 7:9], blocks.block_scores(a[40:41], b[7:9]))
    row, col = blocks.best_of(np.array([[1.0, 3.0, 3.0, -np.inf], [-np.inf] * 4, [2.0, 2.0, 2.0, 2.0]]), 2)
    assert list(zip(row, col, strict=True)) == [(0, 1), (0, 2), (2, 0), (2, 1)]


CELLS = sorted({(f"w{RNG.randrange(60)}", f"c{int(RNG.paretovariate(0.6)) % 50}"): RNG.choice([0.25, 0.5, 1.5, -0.5]) for _ in range(900)}.items())


@pytest.mark.parametrize("limits", [{}, {"QUERY_BYTES": 1500}])
def test_sparse_neighbours(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(sparse, name, value)
    m = spark.createDataFrame([(w, c, v) for (w, c), v in CELLS], "word string, context string, v double").repartition(4)
    asked = [f"w{n}" for n in range(0, 60, 3)] + ["unknown"]
    rows = vectors.explicit_closest(spark.createDataFrame([(w,) for w in asked], "word string"), m, 6).collect()
    by_word = defaultdict(dict)
    for (w, c), v in CELLS:
        by_word[w][c] = v
    found = defaultdict(dict)
    for r in rows:
        found[r.query][r.rank] = (r.score, r.word)  # the values are exact in binary
    for q in asked:
        scores = [(sum(v * other[c] for c, v in by_word[q].items() if c in other), w) for w, other in by_word.items() if q in by_word and set(by_word[q]) & set(other)]
        assert [found[q][k] for k in sorted(found[q])] == sorted(scores, reverse=True)[:6]


def test_bounds_skip_rows_but_no_neighbour(monkeypatch):
    monkeypatch.setattr(sparse, "PRODUCTS", 20)
    monkeypatch.setattr(sparse, "SUMS", 64)
    rng = np.random.default_rng(4)

    def rows(n, size):
        out = sparse.Rows.__new__(sparse.Rows)
        lists = [np.sort(rng.choice(30, rng.integers(1, size), replace=False)) for _ in range(n)]
        out.words = np.array([f"r{k:03d}" for k in rng.permutation(n)], object)
        out.contexts = np.concatenate(lists).astype(np.int64)
        out.values = np.concatenate([rng.choice([1.0, 0.5, 2.0], len(x)) * 2.0 ** -(k % 9) for k, x in enumerate(lists)])
        out.starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return out

    q, c = rows(5, 12), rows(200, 9)
    met = []
    asked, row, score = sparse.best_words(sparse.Queries(q), c, 4, met)
    dense = [np.zeros((len(x), 30)) for x in (q, c)]
    for x, d in zip((q, c), dense, strict=True):
        d[x.rows(), x.contexts] = x.values
    for k in range(5):
        want = sorted(((float(s), c.words[n]) for n, s in enumerate(dense[1] @ dense[0][k]) if s), reverse=True)[:4]
        assert [(float(s), c.words[n]) for a, n, s in zip(asked, row, score, strict=True) if a == k] == want
    assert met[1] < met[0]


@pytest.mark.parametrize("fill", [64, 32 << 20])
def test_products_with_a_hot_row(spark, monkeypatch, fill):
    monkeypatch.setattr(coo, "SUM_BYTES", fill)
    rng = random.Random(3)
    cells = [(5, j, float(rng.randrange(1, 9))) for j in range(200)] + [(i, rng.randrange(200), float(rng.randrange(1, 9))) for i in range(20) for _ in range(6)]
    vecs = [(j, [float(rng.randrange(-4, 5)) for _ in range(3)]) for j in range(190)]
    m, f = spark.createDataFrame(cells, "i long, j long, v double").repartition(6), spark.createDataFrame(vecs, "id long, vec array<double>")
    want = defaultdict(lambda: [0.0] * 3)
    for i, j, v in cells:
        if j < 190:
            want[i] = [a + 2 * v * b for a, b in zip(want[i], vecs[j][1], strict=True)]
    got = {r.i: list(r.vec) for r in coo.spmm(m, f, 2.0, rows=spark.range(25)).collect()}
    assert got == {i: want[i] for i in range(25)}
    h0 = {r.i: list(r.vec) for r in coo.spmm(m, f, 2.0, h0=f.limit(0).unionByName(spark.createDataFrame([(5, [1.0, 1.0, 1.0]), (99, [7.0, 7.0, 7.0])], f.schema))).collect()}
    assert h0[99] == [7.0] * 3 and h0[5] == [x + 1 for x in want[5]]
    assert "Generate" not in coo.spmm(m, f)._jdf.queryExecution().executedPlan().toString()


def test_analogies_tie_to_the_smaller_word(spark, words):
    test = [(n, f"w{n}", f"w{n + 3}", f"w{n + 9}", "x") for n in range(0, 60, 2)] + [(99, "none", "w1", "w2", "x")]
    q = spark.createDataFrame(test, "qid long, a string, a_ string, b string, b_ string")
    for block_rows in (37, 4096):
        got = {(r.qid, r.method): r.guess for r in evaluate.analogy_guesses(q, words, True, block_rows).collect()}
        for n, a, a_, b, _ in test:
            s = [{w: (dot(dict(WORDS).get(x, [0.0] * 6), v) + 1.0) / 2.0 for w, v in WORDS if w not in (a, a_, b)} for x in (a, a_, b)]
            for method, of in (("add", lambda w, s=s: -s[0][w] + s[1][w] + s[2][w]), ("mul", lambda w, s=s: s[1][w] * s[2][w] / (s[0][w] + 0.01))):
                best = max(map(of, s[0]))
                assert got[n, method] == min(w for w in s[0] if of(w) == best)


def test_wide_small_tables_are_not_broadcast(spark):
    wide = spark.range(50).select("id", F.array_repeat(F.lit("x" * 100), 1000).alias("a"), F.create_map(F.lit("k"), F.lit("v" * 500)).alias("m"))
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert wide.agg(F.sum(row_bytes(wide))).first()[0] > 50 * 100_000
    assert not hinted(size_bounded_broadcast(wide, max_bytes=1 << 20)) and hinted(size_bounded_broadcast(wide, max_bytes=1 << 24))
    assert hinted(size_bounded_broadcast(spark.range(10), known_rows=10)) and not hinted(size_bounded_broadcast(spark.range(10), known_rows=10**9))
    assert spark.range(3).select(V.zeros(4).alias("v")).count() == 3
