"""Factorization data operators, training properties and ranking metrics."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordfold.operators import coo as D
from wordfold.operators import factor as E
from wordfold.operators import ranking as R
from wordfold.operators.solve import settled
from wordfold.plans.train import SgdParams, TrainParams, train_ccd, train_pu, train_sgd
from wordfold.session import require_local


def small(spark, seed=0, m=12, n=9, k=3, density=0.4):
    rng = np.random.default_rng(seed)
    cells = [(i, j, float(rng.integers(1, 5))) for i in range(m) for j in range(n) if rng.random() < density]
    coo = spark.createDataFrame(cells, "i long, j long, v double")
    w = spark.createDataFrame([(i, rng.normal(size=k).tolist()) for i in range(m)], "id long, vec array<double>")
    h = spark.createDataFrame([(j, rng.normal(size=k).tolist()) for j in range(n)], "id long, vec array<double>")
    return coo, w, h, cells


def test_glove_weights(spark):
    v = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0)], "i long, j long, v double")
    c = spark.createDataFrame([(0, 0, 10.0), (0, 1, 10.0 / 16), (1, 1, 50.0)], "i long, j long, v double")
    got = {(r.i, r.j): r.w for r in E.glove_weights(v, c, 10.0).collect()}
    assert got[(0, 0)] == 1.0 and abs(got[(0, 1)] - 0.125) < 1e-12 and got[(1, 1)] == 1.0


def dense(w, h):
    return np.array([r.vec for r in w.orderBy("id").collect()]) @ np.array([r.vec for r in h.orderBy("id").collect()]).T


def test_pu_loss_gram_equals_enumeration(spark):
    coo, w, h, cells = small(spark)
    rho = 0.3
    gram = E.pu_loss(coo, w, h, rho).first()
    p, a = dense(w, h), np.full((12, 9), np.nan)
    for i, j, v in cells:
        a[i, j] = v
    omega, zero = np.nansum((a - p) ** 2), rho * (p[np.isnan(a)] ** 2).sum()
    assert abs(gram["omega"] - omega) < 1e-8 and abs(gram["zero"] - zero) < 1e-8
    weighted = E.weighted_zero_loss(coo, w, h, rho).first()["loss"]
    assert abs(weighted - omega - zero) < 1e-8


def test_losses_keep_cells_without_factors(spark):
    coo, w, h, cells = small(spark)
    known = w.where("id < 6")
    p = dense(w, h)
    p[6:] = 0.0
    loss = sum((v - p[i, j]) ** 2 for i, j, v in cells)
    got = E.loss_rmse(coo, known, h).first()
    assert abs(got["loss"] - loss) < 1e-8 and abs(got["rmse"] - np.sqrt(loss / len(cells))) < 1e-8
    row = E.objective(coo, known, h, 0.2, 0.1).first()
    x = {r.id: np.array(r.vec) for r in known.collect()}
    y = {r.id: np.array(r.vec) for r in h.collect()}
    reg = sum((x[i] ** 2).sum() if i in x else 0.0 for i, _, _ in cells) + sum((y[j] ** 2).sum() for _, j, _ in cells)
    assert abs(row["omega"] - loss) < 1e-8 and abs(row["reg"] - reg) < 1e-8


def test_gram_matrix_two_level(spark):
    _, w, _, _ = small(spark, k=4)
    g = D.gram_matrix(w.repartition(5), k=4)
    x = np.stack([r.vec for r in w.orderBy("id").collect()])
    assert np.allclose(g, x.T @ x)


@pytest.mark.parametrize("heavy", [1000, 3])
def test_train_pu_objective_decreases(spark, heavy):
    coo, _, _, _ = small(spark, seed=3, m=20, n=15)
    res = train_pu(coo, TrainParams(k=4, lam=0.05, rho=0.05, iters=4, heavy_rows=heavy, eps=0.0))
    objs = [h["obj"] for h in res.history]
    assert all(b <= a + 1e-9 for a, b in zip(objs, objs[1:]))


def test_heavy_split_equals_plain_solve(spark):
    coo, _, _, _ = small(spark, seed=4, m=20, n=15)
    a = train_pu(coo, TrainParams(k=3, iters=2, heavy_rows=10**6, log=False, rho=0.1))
    b = train_pu(coo, TrainParams(k=3, iters=2, heavy_rows=2, log=False, rho=0.1))
    wa = {r.id: r.vec for r in a.w.collect()}
    wb = {r.id: r.vec for r in b.w.collect()}
    assert all(np.allclose(wa[i], wb[i], atol=1e-9) for i in wa)


def test_bias_dims_stay_frozen(spark):
    coo, _, _, _ = small(spark, seed=5)
    res = train_pu(coo, TrainParams(k=3, iters=2, bias=True, log=False))
    assert all(abs(r.vec[-2] - 1.0) < 1e-12 for r in res.w.collect())
    assert all(abs(r.vec[-1] - 1.0) < 1e-12 for r in res.h.collect())


def test_predict_out_of_range_gets_bias(spark):
    _, w, h, _ = small(spark)
    pairs = spark.createDataFrame([(0, 0), (999, 0), (0, 999)], "i long, j long")
    got = {(r.i, r.j): r.pred for r in R.predict(pairs, w, h, 0.5).collect()}
    assert got[(999, 0)] == 0.5 and got[(0, 999)] == 0.5


def test_ranking_hand_case(spark):
    # one row, 5 candidates; scores make columns 0..4 rank 1..5; positives at ranks 1 and 4
    w = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    h = spark.createDataFrame([(j, [5.0 - j]) for j in range(5)], "id long, vec array<double>")
    truth = spark.createDataFrame([(0, 0, 1.0), (0, 3, 1.0)], "i long, j long, v double")
    ranks = R.rank_positives(truth, w, h, None, block_rows=2)
    got = sorted((r.j, r.rank, r.nr_pos) for r in ranks.collect())
    assert got == [(0, 1, 1), (3, 4, 2)]
    m = R.rank_metrics(ranks, R.row_candidates(truth, h, None)).first()
    assert abs(m["map"] - 75.0) < 1e-12 and abs(m["auc"] - 4 / 6) < 1e-12


def test_ranking_no_negatives_auc_one(spark):
    w = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    h = spark.createDataFrame([(j, [1.0 + j]) for j in range(2)], "id long, vec array<double>")
    truth = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "i long, j long, v double")
    ranks = R.rank_positives(truth, w, h)
    assert R.rank_metrics(ranks, R.row_candidates(truth, h, None)).first()["auc"] == 1.0


def test_ranks_and_topk_match_brute_force(spark):
    coo, w, h, cells = small(spark, seed=7, m=15, n=30, k=4, density=0.3)
    truth, ign = coo.where(F.col("j") % 3 == 0), coo.where(F.col("j") % 3 != 0)
    W = {r.id: np.array(r.vec) for r in w.collect()}
    H = {r.id: np.array(r.vec) for r in h.collect()}
    ign_set = {(r.i, r.j) for r in ign.collect()}
    ranks = {(r.i, r.j): (r.rank, r.nr_pos) for r in R.rank_positives(truth, w, h, ign, block_rows=4).collect()}
    top = {(r.i, r.rank): r.j for r in R.recommend_topk(truth.select(F.col("i").alias("id")), w, h, 3, ign, block_rows=4).collect()}
    for i in {r.i for r in truth.collect()}:
        cand = sorted((j for j in H if (i, j) not in ign_set), key=lambda j: (-(W[i] @ H[j]), j))
        pos = [j for j in cand if (i, j) in {(r.i, r.j) for r in truth.collect()}]
        for n, j in enumerate(pos, 1):
            assert ranks[(i, j)] == (cand.index(j) + 1, n)
        assert [top[(i, r)] for r in range(1, 4)] == cand[:3]


def test_dcg_levels_pad_with_last_value(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.0)], "i long, pos long, rel double")
    got = {r.level: r.dcg for r in R.dcg_at_levels(df, ["i"], "pos", "rel", 4).collect()}
    assert got[1] == 1.0 and got[4] == 1.0 and got[2] == got[3] == 1.0


def test_ranks_with_equal_vectors_missing_factors_and_repeated_cells(spark):
    rng = np.random.default_rng(11)
    kinds = rng.normal(size=(7, 5))
    cols = [(j, kinds[j % 7].tolist()) for j in range(60)]
    h = spark.createDataFrame(cols, "id long, vec array<double>")
    w = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(4)], "id long, vec array<double>")  # row 4 has none
    cells = [(i, int(j), 1.0) for i in range(5) for j in rng.choice(60, 12, replace=False)]
    cells += [(0, 59, 2.0), (0, 59, -3.0)]  # together no positive
    cells = [c for c in cells if c[:2] != (0, 59) or c[2] != 1.0]
    ign = [(i, int(j)) for i in range(5) for j in rng.choice(60, 15, replace=False)]
    truth = spark.createDataFrame(cells, "i long, j long, v double")
    ignored = spark.createDataFrame([(*c, 1.0) for c in ign], "i long, j long, v double")
    W = {r.id: r.vec for r in w.collect()}
    ranks = {(r.i, r.j): (r.rank, r.nr_pos) for r in R.rank_positives(truth, w, h, ignored, block_rows=16).collect()}
    expected = {}
    for i in range(5):
        score = {j: sum(a * b for a, b in zip(W[i], v)) if i in W else 0.0 for j, v in cols}
        order = sorted((j for j, _ in cols if (i, j) not in set(ign)), key=lambda j: (-score[j], j))
        total = {}
        for a, j, v in cells:
            if a == i:
                total[j] = total.get(j, 0.0) + v
        for n, j in enumerate([j for j in order if total.get(j, 0.0) > 0], 1):
            expected[(i, j)] = (order.index(j) + 1, n)
    assert ranks == expected
    top = R.recommend_topk(truth.select(F.col("i").alias("id")), w, h, 2, ignored, block_rows=16)
    assert {r.i for r in top.collect()} == set(range(5))


def test_trainers_reach_their_optimum(spark):
    coo, _, _, _ = small(spark, seed=9, m=25, n=18)
    p = TrainParams(k=4, lam=0.1, rho=0.05, iters=3)
    res = train_pu(coo, p)
    assert all(r.settled for r in settled(coo, "i", "j", res.w, res.h, 4, 0.05, 0.1).collect())
    ccd = train_ccd(coo, TrainParams(k=2, lam=0.1, iters=3, inner=2, center=True))
    assert all(h["gain"] >= 0 for h in ccd.history) and ccd.history[-1]["loss"] < ccd.history[0]["loss"] + 1e-9
    assert ccd.mean > 0 and ccd.w.count() == 25
    nmf = train_ccd(coo, TrainParams(k=2, lam=0.1, iters=2, inner=2, nmf=True))
    assert all(min(r.vec) >= 0 for r in nmf.h.collect())
    for q in (SgdParams(split=True, bold=True), SgdParams(rho=0.1, shifted=True)):
        sgd = train_sgd(coo, TrainParams(k=4, lam=0.01, iters=3), q)
        assert sgd.history[-1]["loss"] < sgd.history[0]["loss"]


def test_early_stop_does_not_depend_on_the_log(spark):
    coo, _, _, _ = small(spark, seed=10)
    a, b = (train_pu(coo, TrainParams(k=3, rho=0.1, iters=6, eps=0.05, log=log)) for log in (True, False))
    assert len(a.history) == len(b.history) < 6 and b.log is None


def test_demo_rank_fits_in_bounded_blocks(spark, monkeypatch):
    from wordfold.operators import solve

    coo, _, _, _ = small(spark, seed=12, m=30, n=8)
    monkeypatch.setattr(solve, "FLUSH_BYTES", 3 * 302 * 302 * 8)
    kernel = solve._segment_kernel(np.eye(302), 0.0, 0.1, 302, {})
    x = np.random.default_rng(0).normal(size=(240, 302))
    pdf = pd.DataFrame(x, columns=[f"x{d}" for d in range(302)])
    pdf["t"], pdf["salt"], pdf["w"], pdf["a"] = np.repeat(np.arange(30), 8), -1, 1.0, 1.0
    tracemalloc.start()
    out = pd.concat(list(kernel(iter([pdf]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(out["t"]) == list(range(30)) and peak < 60e6
    g = np.eye(302) + x[:8].T @ x[:8] + 0.8 * np.eye(302)
    assert np.allclose(np.stack(out[out["t"] == 0]["vec"])[0], np.linalg.solve(g, x[:8].sum(axis=0)))


def test_ids_are_unique_without_a_cache(spark):
    ids = D.dense_ids(spark.range(1000).withColumn("x", F.rand(3)).select("x"), ["x"])
    spark.catalog.clearCache()
    assert sorted(r.id for r in ids.collect()) == list(range(1000))


def test_cluster_needs_a_shared_folder():
    require_local("local[4]")
    require_local("local")
    with pytest.raises(ValueError):
        require_local("yarn")
    with pytest.raises(ValueError):
        require_local("local-cluster[2,1,1024]")


def test_matrix_multiplication_keeps_empty_rows(spark):
    coo = spark.createDataFrame([(0, 0, 2.0)], "i long, j long, v double")
    f = spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<double>")
    rows = spark.createDataFrame([(0,), (1,)], "id long")
    assert {r.i: r.vec for r in D.spmm(coo, f, rows=rows).collect()} == {0: [2.0, 4.0], 1: [0.0, 0.0]}
