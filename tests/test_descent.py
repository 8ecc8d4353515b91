"""Rank-one descent: both layouts, stop rules and what is left behind."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordfold.operators import residual
from wordfold.plans import train
from wordfold.plans.train import TrainParams, init_model, rank_settled, train_ccd
from wordfold.session import checkpoint_dir, cut_lineage, discard


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(1)
    hot = [(7, j, rng.uniform(-1, 3), 1.0) for j in range(40)]  # a row with every column
    rest = [(i * 1000003, j, rng.uniform(-1, 3), rng.choice([0.5, 1.0, 2.0])) for i in range(30) for j in range(40) if rng.random() < 0.25]
    return cut_lineage(spark.createDataFrame(hot + rest, "i long, j long, v double, w double"))


def plain(cells, w, h, lam, ranks, sweeps):
    """The same steps over a dense matrix."""
    rows = cells.collect()
    a, weight = {}, {}
    for r in rows:
        a[r.i, r.j], weight[r.i, r.j] = r.v, r.w
    gains = []
    for t in ranks:
        for _ in range(sweeps):
            gain = 0.0
            for side in "ji":
                target, other = (h, w) if side == "j" else (w, h)
                for x in sorted({k[1] if side == "j" else k[0] for k in a}):
                    slope = curve = 0.0
                    for (i, j), v in a.items():
                        if x == (j if side == "j" else i):
                            u = other[i if side == "j" else j][t]
                            left = v - sum(w[i][s] * h[j][s] for s in range(len(w[i])) if s != t)
                            slope, curve = slope + weight[i, j] * u * left, curve + weight[i, j] * u * u + lam
                    new = slope / curve
                    old = target[x][t]
                    gain += curve * (old * old - new * new) - 2 * slope * (old - new)
                    target[x][t] = new
            gains.append(gain)
    return gains


@pytest.mark.parametrize("layout", [residual.Held, residual.Residuals])
def test_layouts_take_the_plain_steps(spark, cells, layout, monkeypatch):
    monkeypatch.setattr(residual, "CELLS_PER_ID", 9)  # the hot row over several tasks
    p = TrainParams(k=3, seed=4)
    w, h, _, _ = init_model(cells, p)
    start = [{r.id: list(r.vec) for r in f.collect()} for f in (w, h)]
    model = layout(cells, w, h)
    gains = []
    for t in (0, 1, 2, 0):
        model.open(t)
        gains += [model.sweep(0.3, False) for _ in range(2)]
        model.close()
    assert np.allclose(gains, plain(cells, *start, 0.3, (0, 1, 2, 0), 2), rtol=1e-8, atol=1e-9)
    found = [{r.id: list(r.vec) for r in f.collect()} for f in model.factors()]
    for got, want in zip(found, start, strict=True):
        assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], atol=1e-8) for x in got)
    error = sum(r.w * (r.v - np.dot(start[0][r.i], start[1][r.j])) ** 2 for r in cells.collect())
    assert model.loss() == pytest.approx(error, rel=1e-8)
    model.drop()


def test_bucketed_sweeps_move_no_cells(spark, cells):
    """Beyond the bound each half sweep joins bucket by bucket."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        w, h, _, _ = init_model(cells, TrainParams(k=2))
        model = residual.Residuals(cells, w, h)
        step = residual.rank_one_update(model.by["i"], model.x["i"][0], model.x["j"][0], 0.1)
        plan = step._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("\n") if "Exchange" in line]
        assert "SortMergeJoin" in plan and all("hashpartitioning(id" in m or "hashpartitioning(j" in m for m in moved) and len(moved) == 1
        model.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_weak_sweeps_end_ranks_and_passes(cells):
    res = train_ccd(cells, TrainParams(k=8, iters=2, inner=5, eps=0.9))
    first = res.history[0]
    assert first["sweeps"] < 8 * 5 and first["fitted"] < 8 and first["last"] == first["fitted"] - 1
    res = train_ccd(cells, TrainParams(k=3, iters=4, inner=3, eps=0.0, lam=0.01, center=True))
    assert [h["sweeps"] for h in res.history] == [9] * 4 and all(a["loss"] > b["loss"] for a, b in zip(res.history, res.history[1:], strict=False))
    assert rank_settled(cells, res, res.history[-1]["last"], 0.01).where(~F.col("settled")).count() == 0


def test_a_trainer_leaves_its_factors_alone(spark, cells):
    def folders():
        return set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))

    before = folders()
    res = train_ccd(cells, TrainParams(k=2, iters=2, inner=2))
    left = folders() - before
    assert len([f for f in left if f.startswith("factors")]) == 2 and not [f for f in left if f.startswith(("ccd", "residual", "numbered", "W-", "H-"))]
    discard(res.w, res.h, None, res.w, spark.range(1))
    assert not [f for f in folders() - before if f.startswith("factors")]


def test_growing_keeps_its_schedule(spark, cells, monkeypatch):
    lams = []
    real = residual.Held.sweep
    monkeypatch.setattr(residual.Held, "sweep", lambda self, lam, nmf: lams.append((self.rank, round(lam, 6))) or real(self, lam, nmf))
    train.train_ccd(cells, TrainParams(k=4, iters=1, inner=1, lam=0.1, eps=0.0), growing=True)
    assert lams == [(0, 0.2), (0, 0.1), (1, 0.1), (0, 0.1), (1, 0.1), (2, 0.1), (3, 0.1)]
