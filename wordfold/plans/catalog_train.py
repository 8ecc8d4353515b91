"""Registered training jobs (T1-T11, with the library defaults) and the
evaluation catalog (A16)."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from wordfold.functions.rand import keyed_uniform, lit_key, sql_uniform
from wordfold.operators import assoc, evaluate, factor as E, vectors
from wordfold.plans import fixtures as fx
from wordfold.operators.solve import settled
from wordfold.plans.catalog_corpus import P, SQL as CORPUS_SQL, _lines, _with
from wordfold.plans.catalog_vectors import SLICES, WVN, _slices, _svd, _wv, sql_norm
from wordfold.plans.ppmi import epmi_ids
from wordfold.plans.sql_fixtures import event_matrix_cte, interactions_cte, word_vectors_cte, wordsim_cte
from wordfold.session import checkpoint_dir, cut_lineage
from wordfold.sources.matrix import snapshot_factors
from wordfold.plans.train import SgdParams, TrainParams, rank_settled, train_als, train_ccd, train_pu, train_pu_als_unit, train_sgd

QUERIES = {}
SQL = {}
EVM = event_matrix_cte()


def r6(c):
    return F.round(c, 6)


def _ev(s, sf):
    return fx.event_matrix(s, sf)


# T3 flagship: PU factorization of the corpus PPMI matrix with GloVe weights and bias dims.
# The matrix stays on vocabulary ids from the pair aggregate on (rows i = word
# ids, columns j = context word ids); words are attached once to the result.
def _ppmi_coo(s, sf):
    ep, voc, _, _ = epmi_ids(_lines(s, sf), P)
    coo = assoc.ppmi(ep).select(F.col("word").alias("i"), F.col("context").alias("j"), F.col("pmi").alias("v"),
                                E.glove_weight(F.col("n").cast("double"), 10.0).alias("w"))
    return cut_lineage(coo, "ppmi-ids", "zstd"), voc.select("word", F.col("wid").alias("id"))


def ppmi_factors(s, sf, p=TrainParams(k=10, lam=2 ** -11, rho=0.0625, bias=True, log=False)):  # noqa: B008
    """(coo, words, result) of the flagship job."""
    coo, words = _ppmi_coo(s, sf)
    return coo, words, train_pu(coo, p)


# A trained model can't be compared number by number; what is compared is
# whether every id is there and its vector solves its normal equations (W is
# solved last), or whether the loss fell.
def _train_pu_weighted(s, sf):
    coo, words, res = ppmi_factors(s, sf)
    return settled(coo, "i", "j", res.w, res.h, 12, 0.0625, 2 ** -11, {10: 1.0}).join(words, "id").select("word", "settled")


QUERIES["train_pu_weighted"] = _train_pu_weighted
SQL["train_pu_weighted"] = f"SELECT DISTINCT word, true AS settled FROM ({CORPUS_SQL['ppmi']}) cells"

# T2 unweighted PU on the event matrix; T11 its training log
PU = TrainParams(lam=0.1, rho=0.01, log=False)


def _train_pu(s, sf):
    coo = cut_lineage(_ev(s, sf), "events")
    res = train_pu(coo, PU)
    return settled(coo, "i", "j", res.w, res.h, PU.k, PU.rho, PU.lam)


QUERIES["train_pu"] = _train_pu
SQL["train_pu"] = _with(EVM) + "SELECT DISTINCT i AS id, true AS settled FROM evm"
QUERIES["training_log"] = lambda s, sf: (lambda tr, te: train_pu(tr, replace(PU, log=True), test=te).log)(*fx.train_test(_ev(s, sf)))


def _report(coo, res, fell):
    """One row: ids of both sides with a full vector, entries, whether the loss fell."""
    full = lambda f: f.where(F.size("vec") == F.lit(10)).count()
    return coo.sparkSession.createDataFrame([(full(res.w), full(res.h), coo.count(), bool(fell))],
                                            "rows long, cols long, entries long, fell boolean")


def _fell(res):
    return res.history[-1]["loss"] < res.history[0]["loss"]


def _beats_zero(coo, res):
    """The model's squared error is below that of its mean alone."""
    sums = E.stored_sums(coo.withColumn("v", F.col("v") - res.mean), res.w, res.h).select("loss")
    zero = coo.agg(F.sum((F.col("v") - res.mean) ** 2).alias("z"))
    return sums.first()["loss"] < zero.first()["z"]


def _job(matrix, train, check=None):
    def run(s, sf):
        coo = cut_lineage(matrix(s, sf), "entries")
        res = train(coo)
        return _report(coo, res, check(coo, res) if check else _fell(res))

    return run


REPORT = "SELECT count(DISTINCT i) AS rows, count(DISTINCT j) AS cols, count(*) AS entries, true AS fell FROM "
TRAIN = TrainParams(center=True)

# T1 explicit ALS on the customer x part matrix, T2 by MLlib for unit values
QUERIES["train_als"] = _job(fx.interactions, lambda coo: train_als(coo, TRAIN), _beats_zero)
SQL["train_als"] = _with(interactions_cte()) + REPORT + "inter"
QUERIES["train_pu_als_unit"] = _job(_ev, lambda coo: train_pu_als_unit(coo, TrainParams(rho=0.1)),
                                    lambda coo, res: _beats_zero(coo.withColumn("v", F.lit(1.0)), res))
SQL["train_pu_als_unit"] = _with(EVM) + REPORT + "evm"

# T4 / T5 cyclic rank-one descent; T5 up to a pass of all ranks. The factor
# column fitted last has to be the best for all others; the model must beat
# the mean alone.
def _descent(growing):
    def run(s, sf):
        coo = cut_lineage(_ev(s, sf), "entries")
        res = train_ccd(coo, TRAIN, growing)
        last = res.history[-1]
        if not _beats_zero(coo, res) or growing and last["active"] != TRAIN.k:
            raise ValueError(f"no better than the mean after {last}")
        return rank_settled(coo, res, last["last"], TRAIN.lam)

    return run


QUERIES["train_ccd"] = _descent(False)
QUERIES["train_ccd_growing"] = _descent(True)
for _name in ("train_ccd", "train_ccd_growing"):
    SQL[_name] = _with(EVM) + "SELECT DISTINCT i AS id, true AS settled FROM evm"

# T6 stratified SGD with the rank split and T10's step sizes
QUERIES["train_sgd"] = _job(_ev, lambda coo: train_sgd(coo, TRAIN, SgdParams(split=True, bold=True)))
SQL["train_sgd"] = _with(EVM) + REPORT + "evm"


def _with_zeros(s, sf, lam=0.1, mode="row_frac"):
    """Stored cells and as many drawn zero cells, with a lambda for each side."""
    ev = cut_lineage(_ev(s, sf), "events")
    d = E.dims_of(ev).first()
    m, n = int(d["m"]), int(d["n"])
    cells = E.sample_negatives(ev, m, n, "pu1", 1.0, seed=3).select("i", "j", "v")
    cells = E.entry_regularization(cells, ev, n, lam, mode, "i", "lam_i")
    return E.entry_regularization(cells, ev, m, lam, mode, "j", "lam_j")


# T7 weighted SGD on sampled zeros, lambda by the share of stored cells of each
# side; T8 the shifted PU form, the zero cells' pull in one dense step
QUERIES["train_sgd_weighted"] = _job(lambda s, sf: _with_zeros(s, sf, mode="stored_only"),
                                     lambda coo: train_sgd(coo, TrainParams(), SgdParams(rho=0.1)))
QUERIES["train_pu_sgd"] = _job(lambda s, sf: _with_zeros(s, sf, mode="row_share").where(F.col("v") > 0),
                               lambda coo: train_sgd(coo, TrainParams(), SgdParams(rho=0.1, shifted=True)))
SQL["train_sgd_weighted"] = _with(EVM) + f""",
dm AS (SELECT max(i) + 1 AS m, max(j) + 1 AS n, count(*) AS nnz FROM evm),
cells AS (SELECT i, j FROM evm UNION ALL
          SELECT CAST(floor({sql_uniform("'negi'", "'3'", 'r.range')} * dm.m) AS BIGINT),
                 CAST(floor({sql_uniform("'negj'", "'3'", 'r.range')} * dm.n) AS BIGINT)
          FROM dm, range(0, (SELECT nnz FROM dm)) r)
""" + REPORT + "cells"
SQL["train_pu_sgd"] = _with(EVM) + REPORT + "evm WHERE v > 0"

# A16 evaluation catalog: every model against every task, one grouped job
def _models(s, sf):
    emb = _wv(s, sf).select(F.lit("emb").alias("model"), "word", "vec")
    svd = _svd(s, sf).select(F.lit("svd").alias("model"), "word", "vec")
    ens = vectors.ensemble(*_slices(s, sf)).select(F.lit("ens").alias("model"), "word", "vec")
    return emb.unionByName(svd).unionByName(ens)


def _tasks(s, sf):
    g = fx.wordsim_gold(s, sf)
    return g.select(F.when(keyed_uniform(lit_key("task"), "w1") < 0.5, "t1").otherwise("t2").alias("task"), "w1", "w2", "gold")


QUERIES["evaluation_catalog"] = lambda s, sf: evaluate.evaluation_catalog(_models(s, sf), _tasks(s, sf)).select(
    "model", "task", r6(F.col("spearman")).alias("spearman"))

SQL_SCORES = f"""
tasks AS (SELECT CASE WHEN {sql_uniform("'task'", 'w1')} < 0.5 THEN 't1' ELSE 't2' END AS task, w1, w2, gold FROM gold),
sims AS (
  SELECT m.model, t.task, t.gold, coalesce(list_dot_product(a.vec, b.vec), 0.0) AS sim
  FROM tasks t CROSS JOIN (SELECT DISTINCT model FROM models) m
  LEFT JOIN models a ON a.model = m.model AND a.word = t.w1
  LEFT JOIN models b ON b.model = m.model AND b.word = t.w2)
SELECT model, task, round(corr(rx, ry), 6) AS spearman FROM (
  SELECT model, task,
         rank() OVER (PARTITION BY model, task ORDER BY sim) + (count(*) OVER (PARTITION BY model, task, sim) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY model, task ORDER BY gold) + (count(*) OVER (PARTITION BY model, task, gold) - 1) / 2.0 AS ry
  FROM sims) GROUP BY model, task"""
SQL["evaluation_catalog"] = _with(WVN, wordsim_cte()) + "," + SLICES.replace(word_vectors_cte() + ",", "") + f""",
sv0 AS (SELECT word, list_transform(list_zip(vec, generate_series(0, len(vec) - 1)), lambda p: p[1] * pow(1.0 / (p[2] + 1), 0.5)) AS vec FROM wv),
ens0 AS (SELECT coalesce(s1.word, s2.word) AS word,
                CASE WHEN s1.vec IS NULL THEN s2.vec WHEN s2.vec IS NULL THEN s1.vec
                     ELSE list_transform(list_zip(s1.vec, s2.vec), lambda p: p[1] + p[2]) END AS vec
         FROM s1 FULL OUTER JOIN s2 USING (word)),
models AS (
  SELECT 'emb' AS model, word, vec FROM wvn
  UNION ALL SELECT 'svd', word, {sql_norm('vec')} FROM sv0
  UNION ALL SELECT 'ens', word, {sql_norm('vec')} FROM ens0),""" + SQL_SCORES


# A16 over saved models: factors of three iterations are written, found again by their folders and scored
ITERATIONS = {1: 16, 2: 32, 3: 64}  # dimensions known by each


def _snapshot_catalog(s, sf):
    path = f"{checkpoint_dir(s).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    emb = fx.table(s, sf, "embeddings").select(F.col("vec_id").alias("id"), fx.to_double_array("embedding").alias("vec"))
    for it, size in ITERATIONS.items():
        known = emb.select("id", F.slice("vec", 1, size).alias("vec"))
        snapshot_factors(known, known, path, it)
    words = emb.select("id", F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    return evaluate.evaluation_catalog(evaluate.snapshot_models(s, path, words, "W", [1, 2, 3]), _tasks(s, sf))


QUERIES["snapshot_catalog"] = lambda s, sf: _snapshot_catalog(s, sf).select("model", "task", r6(F.col("spearman")).alias("spearman"))
SQL["snapshot_catalog"] = _with(word_vectors_cte(), wordsim_cte()) + """,
models AS (""" + " UNION ALL ".join(
    f"SELECT 'iter{it}' AS model, word, {sql_norm(f'list_slice(vec, 1, {size})')} AS vec FROM wv" for it, size in ITERATIONS.items()) + "),\n" + SQL_SCORES
