"""Association matrix, vectors and evaluation: hand-made cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from wordfold.operators import assoc, evaluate, vectors
from wordfold.sources.text import parse_wordsim


def test_pmi_two_by_two(spark):
    c = spark.createDataFrame([("x", "x", 4), ("x", "y", 1), ("y", "x", 1), ("y", "y", 4)], "word string, context string, n long")
    got = {(r.word, r.context): r.pmi for r in assoc.pmi(assoc.exp_pmi(c, 1.0)).collect()}
    assert abs(got[("x", "x")] - math.log(1.6)) < 1e-12
    assert abs(got[("x", "y")] - math.log(0.4)) < 1e-12
    assert assoc.ppmi(assoc.exp_pmi(c, 1.0)).count() == 2


def test_context_smoothing(spark):
    c = spark.createDataFrame([("x", "x", 4), ("x", "y", 1), ("y", "y", 4)], "word string, context string, n long")
    got = {(r.word, r.context): r.epmi for r in assoc.exp_pmi(c, 0.75).collect()}
    s = 4 ** 0.75 + 5 ** 0.75
    assert abs(got[("x", "x")] - 4 * s / (5 * 4 ** 0.75)) < 1e-12


def test_zero_vector_and_unknown_word(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0])], "word string, vec array<double>")
    n = {r.word: r.vec for r in vectors.normalize_vectors(v).collect()}
    assert n["a"] == [0.0, 0.0] and np.allclose(n["b"], [0.6, 0.8])
    pairs = spark.createDataFrame([("a", "b"), ("b", "b"), ("b", "zz")], "w1 string, w2 string")
    s = {(r.w1, r.w2): r.sim for r in vectors.similarity(pairs, vectors.normalize_vectors(v)).collect()}
    assert s[("a", "b")] == 0.0 and abs(s[("b", "b")] - 1.0) < 1e-12 and s[("b", "zz")] == 0.0


def test_closest_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5))
    words = [f"w{i:02d}" for i in range(60)]
    v = vectors.normalize_vectors(spark.createDataFrame([(w, m[i].tolist()) for i, w in enumerate(words)], "word string, vec array<double>"))
    got = vectors.closest(spark.createDataFrame([("w03",), ("nope",)], "word string"), v, n=4, block_rows=7)
    got = {(r.query, r.rank): r.word for r in got.collect()}
    mn = m / np.linalg.norm(m, axis=1, keepdims=True)
    order = sorted(range(60), key=lambda j: (mn[j] @ mn[3], words[j]), reverse=True)[:4]
    assert [got[("w03", r)] for r in range(1, 5)] == [words[j] for j in order]
    # unknown query: all scores 0 -> ties by word descending
    assert [got[("nope", r)] for r in range(1, 5)] == sorted(words, reverse=True)[:4]


def test_spearman_ties_and_numeric_gold(spark):
    lines = spark.createDataFrame([("A\tB\t10.00\r",), ("c d 6.77",), ("e f 1.5",)], "value string")
    g = parse_wordsim(lines)
    rows = {r.w1: r.gold for r in g.collect()}
    assert rows == {"a": 10.0, "c": 6.77, "e": 1.5}
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (3.0, 3.0), (4.0, 4.0)], "sim double, gold double")
    got = evaluate.spearman(df).first()["spearman"]
    # ranks of sim with ties: 1.5, 1.5, 3, 4 against 1, 2, 3, 4
    rx, ry = np.array([1.5, 1.5, 3, 4]), np.array([1, 2, 3, 4.0])
    assert abs(got - np.corrcoef(rx, ry)[0, 1]) < 1e-12


def test_explicit_similarity_and_first_order(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 3.0)], "word string, context string, v double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "zz")], "w1 string, w2 string")
    s = {(r.w1, r.w2): r.sim for r in vectors.explicit_similarity(pairs, m).collect()}
    assert s == {("a", "b"): 6.0, ("a", "zz"): 0.0}
    fo = vectors.explicit_first_order(spark.createDataFrame([("a", "y"), ("b", "x")], "word string, context string"), m)
    assert {(r.word, r.context): r.sim for r in fo.collect()} == {("a", "y"): 2.0, ("b", "x"): 0.0}


def test_analogy_excludes_question_words(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.7071, 0.7071]), ("d", [-1.0, 0.0])],
                              "word string, vec array<double>")
    q = spark.createDataFrame([(0, "a", "b", "c", "d")], "qid long, a string, a_ string, b string, b_ string")
    g = {r.method: r.guess for r in evaluate.analogy_guesses(q, vectors.normalize_vectors(v)).collect()}
    assert g["add"] == "d" and g["mul"] == "d"
