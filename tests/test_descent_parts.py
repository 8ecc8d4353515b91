"""Rank-one descent keeps its cells with the workers: few jobs, same steps."""

import random

import numpy as np
import pytest

from wordfold.operators import residual
from wordfold.plans.train import TrainParams, train_ccd


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(6)
    rows = [(i * 11, j, rng.uniform(0, 3), rng.choice([0.5, 1.0])) for i in range(40) for j in range(30) if i == 3 or rng.random() < 0.3]
    return spark.createDataFrame(rows, "i long, j long, v double, w double")


def vectors(res):
    return [{r.id: r.vec for r in f.collect()} for f in (res.w, res.h)]


def test_ranks_sweeps_are_one_job(cells, monkeypatch):
    """A job for each half sweep made 80 of them."""
    asked, run = [], residual.Held._run
    monkeypatch.setattr(residual.Held, "_run", lambda self, step: asked.append(1) or run(self, step))
    res = train_ccd(cells, TrainParams(k=4, iters=1, inner=10, eps=0.0))
    assert res.history[0]["sweeps"] == 40 and len(asked) == 4 + 1  # and the loss


def test_parts_take_the_same_steps(cells, monkeypatch):
    p = TrainParams(k=3, iters=2, inner=3, lam=0.05, center=True)
    whole = train_ccd(cells, p)
    monkeypatch.setattr(residual, "PART_CELLS", 60)
    monkeypatch.setattr(residual, "CELLS_PER_ID", 9)
    parts = train_ccd(cells, p)
    assert [h["sweeps"] for h in whole.history] == [h["sweeps"] for h in parts.history]
    for a, b in zip(vectors(whole), vectors(parts), strict=True):
        assert a.keys() == b.keys() and all(np.allclose(a[x], b[x], rtol=1e-7, atol=1e-9) for x in a)
