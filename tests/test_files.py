"""File formats: written, read back, and refused where they don't fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordfold.operators import assoc, vectors
from wordfold.sources import matrix as A
from wordfold.sources import text as S


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_coo_directory(spark, folder):
    cells = [(0, 1, 2.5), (3, 0, -1.0), (2, 2, 0.125)]
    coo = spark.createDataFrame(cells, "i long, j long, v double")
    A.write_coo(coo, f"{folder}/train")
    A.write_coo(coo.limit(1), f"{folder}/test")
    A.write_meta(spark, folder, A.MatrixMeta(4, 3, 3, "train", 1, "test"))
    train, test, meta = A.read_coo(spark, folder)
    assert sorted(map(tuple, train.collect())) == sorted(cells) and test.count() == 1
    assert (meta.rows, meta.cols, meta.nnz_train, meta.nnz_test) == (4, 3, 3, 1)
    for wrong in (A.MatrixMeta(4, 3, 2, "train"), A.MatrixMeta(4, 3, 3, "train", 2, "test"), A.MatrixMeta(3, 3, 3, "train"), A.MatrixMeta(4, 2, 3, "train")):
        A.write_meta(spark, folder, wrong)
        with pytest.raises(ValueError):
            A.read_coo(spark, folder)


def test_vocabularies_and_association(spark, folder):
    words = spark.createDataFrame([("a", 0), ("b", 1)], "word string, id long")
    A.write_vocab(words, f"{folder}/vocab")
    assert sorted(map(tuple, A.read_vocab(spark, f"{folder}/vocab").collect())) == [("a", 0), ("b", 1)]
    counts = spark.createDataFrame([("a", 7), ("b", 3)], "word string, n long")
    A.write_count_vocab(counts, f"{folder}/counts")
    assert sorted(map(tuple, A.read_count_vocab(spark, f"{folder}/counts").collect())) == [("a", 7), ("b", 3)]
    epmi = assoc.exp_pmi(spark.createDataFrame([("a", "x", 4), ("a", "y", 1), ("b", "x", 1), ("b", "y", 4)], "word string, context string, n long"), 1.0)
    A.save_assoc(epmi, f"{folder}/assoc")
    assert sorted(map(str, A.load_assoc(spark, f"{folder}/assoc").collect())) == sorted(map(str, epmi.collect()))


def test_vectors_snapshots_and_svd(spark, folder):
    f = spark.createDataFrame([(1, [0.5, -1.0, 9.0, 9.0]), (0, [2.0, 0.25, 9.0, 9.0])], "id long, vec array<double>")
    A.write_vectors(f, f"{folder}/v", 1, "text")
    assert [r.value for r in spark.read.text(f"{folder}/v").collect()] == ["2.000000 0.250000", "0.500000 -1.000000"]
    for it in (1, 2):
        w, h = A.snapshot_factors(f, f.limit(1), f"{folder}/snap", it)
        assert w.count() == 2 and h.count() == 1
    assert spark.read.parquet(f"{folder}/snap/side=W").where("iter = 2").count() == 2
    f.select(F.col("id").cast("string").alias("word"), "vec").write.parquet(f"{folder}/svd/ut")
    f.select(F.col("id").cast("string").alias("word"), "vec").write.parquet(f"{folder}/svd/vt")
    spark.createDataFrame([(0, 4.0)], "d int, s double").write.parquet(f"{folder}/svd/s")
    for transpose in (False, True):
        u, s = A.read_svd(spark, f"{folder}/svd", transpose)
        assert u.count() == 2 and s.first().s == 4.0


def test_text_readers_refuse_what_they_cannot_read(spark, folder):
    spark.createDataFrame([("  3 a b",), ("",), ("x a b",)], "value string").write.text(f"{folder}/counts")
    with pytest.raises(ValueError, match="1 lines"):
        S.read_counts(spark, f"{folder}/counts")
    spark.createDataFrame([("Cat\tdog\t3.5\r",), ("one two",)], "value string").write.text(f"{folder}/sim")
    with pytest.raises(ValueError):
        S.read_wordsim(spark, f"{folder}/sim")
    lines = spark.createDataFrame([(": capital",), ("a b c d",), ("  ",)], "value string")
    assert [r.value for r in S.rejected_lines(lines, *S.FORMATS["analogies"]).collect()] == [": capital"]


def test_corpus_files_are_read_by_lines(spark, folder):
    spark.createDataFrame([("B a\tc",), ("",), (" d ",)], "value string").coalesce(1).write.text(f"{folder}/corpus")
    got = S.read_corpus_text(spark, f"{folder}/corpus", lower=True).orderBy("line_no").collect()
    assert [r.toks for r in got] == [["b", "a", "c"], ["d"]]
    assert len({r.doc_id for r in got}) == 1 and got[0].line_no < got[1].line_no


@pytest.mark.parametrize("options, expected", [
    ({"kind": "PMF"}, "words"), ({"kind": "emb"}, "words"), ({"kind": "emb", "use_contexts": True}, "contexts"),
    ({"kind": "emb", "w_c": True}, "sum"), ({"kind": "emb", "concat": True}, "both"), ({"kind": "SVD"}, "svd"), ({"kind": "SVD", "w_c": True}, "svd sum")])
def test_representations(spark, options, expected):
    a, b = np.array([[3.0, 4.0], [1.0, 0.0]]), np.array([[0.0, 2.0], [1.0, 1.0]])
    frame = lambda m: spark.createDataFrame([(f"w{i}", r.tolist()) for i, r in enumerate(m)], "word string, vec array<double>")
    sv = spark.createDataFrame([(0, 4.0), (1, 1.0)], "d int, s double")
    got = vectors.representation(**options, words=frame(a), contexts=frame(b),
                                 u=frame(a).withColumnRenamed("vec", "u"), v=frame(b).withColumnRenamed("vec", "u"), s=sv)
    got = np.stack([r.vec for r in got.orderBy("word").collect()])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scaled = np.array([2.0, 1.0])  # singular values to the power one half
    want = {"words": unit(a), "contexts": unit(b), "sum": None, "both": None, "svd": unit(a * scaled), "svd sum": None}[expected]
    assert np.allclose(np.linalg.norm(got, axis=1), 1.0)
    if want is not None:
        assert np.allclose(got, want)
    if expected == "both":
        assert got.shape == (2, 4)


def test_sum_of_words_and_contexts_is_not_defined_for_cells(spark):
    with pytest.raises(ValueError):
        vectors.representation("PPMI", w_c=True)
