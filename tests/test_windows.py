"""Pair counts where lines are read: no token is shuffled; repeated keys, draws, chunks and hash collisions."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_lines import lines_df
from wordfold.operators import assoc, corpus, lookup, windows
from wordfold.plans.ppmi import CorpusParams, build_counts, encoded_counts, epmi_ids

TEXTS = ["a b a c d a\nb b c", "d c b a a b", "a", "c c c c c d d b a x"] * 5


def by_tokens(lines, voc, p):
    """Counts by shuffled tokens."""
    kept = corpus.mask_tokens(lines, voc, p.seed, p.chunk_tokens, token_col="wid")
    pairs = corpus.window_pairs(kept, p.win, p.dyn, p.positional, p.delete, p.seed, p.chunk_tokens, encoded=True)
    return sorted(tuple(r) for r in corpus.pair_counts(pairs).collect())


@pytest.mark.parametrize("p", [CorpusParams(thr=2, win=3, dyn=True, sub=0.05, delete=True),
                               CorpusParams(thr=2, win=2, dyn=True, positional=True, sub=0.05),
                               CorpusParams(thr=2, win=2, sub=0.05, delete=True, chunk_tokens=2)])
def test_same_as_by_tokens(spark, p):
    lines = lines_df(spark, TEXTS)
    enc, voc, _ = encoded_counts(lines, p)
    assert sorted(tuple(r) for r in enc.collect()) == by_tokens(lines, voc, p)


def test_tokens_are_not_shuffled(spark):
    lines = lines_df(spark, TEXTS)
    enc, _, _ = encoded_counts(lines, CorpusParams(thr=2, delete=True))
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert "line_no" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


def test_repeated_keys_are_one_line(spark):
    lines = lines_df(spark, TEXTS[:4])
    twice = lines.unionByName(lines.where("doc_id = 1"))
    for delete in (True, False):
        p = CorpusParams(thr=1, win=2, delete=delete)
        enc, voc, _ = encoded_counts(twice, p)
        assert sorted(tuple(r) for r in enc.collect()) == by_tokens(twice, voc, p)


def test_packed_integers():
    for x in (np.zeros(3, np.int64), np.array([0, 255, 256, 1 << 40]), np.arange(1000) * 77):
        assert (windows.unpacked(windows.packed(x), len(x)) == x).all()


def test_uniform_is_the_keyed_draw():
    (u,) = windows.uniform("sub", 17, [None], [3], np.array([0]), np.array([5]))
    assert u == int(hashlib.md5(b"sub|17|3|5").hexdigest()[:8], 16) / 2**32


def test_words_with_one_hash(monkeypatch):
    monkeypatch.setattr(lookup, "hashes", lambda words: np.ones(len(words), np.uint64))
    ids = lookup.Ids(pa.array(["x", "y", "z"]))
    assert ids.of(pa.array(["z", "n", "x"])).tolist() == [2, -1, 0]


def test_marginals_looked_up_in_place(spark):
    lines = lines_df(spark, TEXTS)
    p = CorpusParams(thr=2, win=2, delete=True, cds=0.75)
    ep, voc, n, dense = epmi_ids(lines, p)
    assert dense == n
    plan = ep._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    want = assoc.exp_pmi(build_counts(lines, p)[0], 0.75)
    got = corpus.decode_counts(ep, voc, 2, False)
    key = lambda r: (r.word, r.context, r.n, round(r.epmi, 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert got.where(F.col("word").isNull()).count() == 0


def test_cells_stay_packed(spark):
    """Written counts are packed rows, joined by bucket; cells take values and words in one pass, sums are those of the cells."""
    lines = lines_df(spark, TEXTS).repartition(3)  # buckets of several rows
    p = CorpusParams(thr=2, win=2, delete=True)
    enc, voc, n = encoded_counts(lines, p)
    cells = lookup.cut_cells(enc, "counts-ids")
    stored = spark.read.parquet(cells.packed[0].written_at)
    assert "keys" in stored.columns and stored.groupBy("bucket").count().where("count > 1").count() == 0
    want = sorted(tuple(r) for r in enc.collect())
    assert sorted(tuple(r) for r in cells.collect()) == want
    for key, at in (("word", 0), ("context", 1)):
        sums = {}
        for r in want:
            sums[r[at]] = sums.get(r[at], 0) + r[2]
        for source in (enc, cells, cells.select("word", "context", "n")):
            assert {r[0]: r[1] for r in lookup.sums(source, key, "n", "total").collect()} == sums
    words = {r.wid: r.word for r in voc.collect()}
    coefs = assoc.row_sums(cells).selectExpr("word", "1D / row_sum as coef")
    scaled = corpus.decode_counts(assoc.scale_rows(cells, coefs, "word", "n", dense=lookup.Named.of(n, voc)), voc, 2, False)
    plan = scaled._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("MapInArrow") == 1
    total = {r[0]: 0 for r in want}
    for r in want:
        total[r[0]] += r[2]
    assert sorted((r.word, r.context, round(r.n, 9)) for r in scaled.collect()) == sorted((words[a], words[b], round(m / total[a], 9)) for a, b, m in want)


def test_pairs_of_a_task_are_packed_together(spark):
    """Millions of pairs make one packed row a bucket, not one for every two million."""
    lines = spark.range(0, 1300, 1, 1).select(F.col("id").alias("doc_id"), F.lit(0).alias("line_no"), F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: (x * x % 53).cast("string")).alias("toks"))
    counts, _, _ = encoded_counts(lines, CorpusParams(thr=1, win=2))
    blobs = counts.packed[0]
    assert blobs.count() == blobs.select("bucket").distinct().count()
    assert counts.agg(F.sum("n")).first()[0] == 1300 * (2 * 999 + 2 * 998)


def test_vocabularies_of_millions_of_words_fit_a_worker(spark):
    voc = spark.range(5_000_000).select(F.format_string("w%07d", "id").alias("word"), F.col("id").alias("n"), F.rand().alias("p_drop"), F.col("id").alias("wid"))
    assert lookup.fits(voc)
