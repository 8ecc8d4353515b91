"""Strata cut by histogram: block sizes, hot rows and the loss of a plain SGD."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordfold.plans import train
from wordfold.plans.train import SgdParams, TrainParams, balanced_blocks, train_sgd
from wordfold.session import cut_lineage


@pytest.fixture(scope="module")
def cells(spark):
    """A third of the entries in row 3; values of rank one and noise."""
    rng = random.Random(6)
    a, b = [rng.uniform(0.5, 2) for _ in range(60)], [rng.uniform(0.5, 2) for _ in range(400)]
    pairs = {(3, j) for j in range(400)} | {(rng.randrange(60), rng.randrange(400)) for _ in range(900)}
    return cut_lineage(spark.createDataFrame([(i, j, a[i] * b[j] + rng.gauss(0, 0.05)) for i, j in sorted(pairs)], "i long, j long, v double"))


@pytest.mark.parametrize("blocks", [2, 5, 8])
def test_blocks_hold_twice_the_mean_at_most(cells, blocks):
    n = cells.count()
    for side, other in (("i", "j"), ("j", "i")):
        places = balanced_blocks(cells, side, blocks, n, 1)
        rows = places.collect()
        assert sorted(r.key for r in rows) == list(range(len(rows)))
        assert {r.id for r in rows} == {r[0] for r in cells.select(side).distinct().collect()}
        held = train._keyed(cells, side, other, places, 1).groupBy("rb" if side == "i" else "cb").count().collect()
        # copies share an id's entries by hash, so theirs are about the same
        assert sum(r["count"] for r in held) == n and max(r["count"] for r in held) <= 2.2 * n / blocks
        if side == "i" and blocks == 8:
            hot = [r for r in rows if r.id == 3]
            assert len(hot) == hot[0].copies == math.ceil(400 / math.ceil(n / blocks)) > 1 and len({r.blk for r in hot}) > 1


def plain_sgd(cells, k, lam, lr, iters, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(r.i, r.j, r.v) for r in cells.collect()]
    w, h = ({x: rng.uniform(0, 1 / math.sqrt(k), k) for x in {r[s] for r in rows}} for s in (0, 1))
    gw, gh = ({x: np.zeros(k) for x in f} for f in (w, h))
    for _ in range(iters):
        for n in rng.permutation(len(rows)):
            i, j, v = rows[n]
            e = float(w[i] @ h[j]) - v
            for x, f, g, grad in ((i, w, gw, e * h[j] + lam * w[i]), (j, h, gh, e * w[i] + lam * h[j])):
                g[x] = g[x] + grad * grad
                f[x] = f[x] - lr * grad / np.sqrt(1e-8 + g[x])
    return sum((float(w[i] @ h[j]) - v) ** 2 for i, j, v in rows)


@pytest.mark.parametrize("blocks", [2, 6])
def test_loss_of_a_plain_sgd(cells, blocks):
    res = train_sgd(cells, TrainParams(k=4, lam=0.01, iters=6), SgdParams(blocks=blocks))
    plain = plain_sgd(cells, 4, 0.01, 0.1, 6)
    losses = [h["loss"] for h in res.history]
    assert losses[-1] < 2 * plain + 0.02 * losses[0]
    assert res.w.count() == cells.select("i").distinct().count() and res.h.count() == cells.select("j").distinct().count()
    assert res.w.where(F.size("vec") != 4).count() == 0
    error = cells.join(res.w.withColumnRenamed("id", "i").withColumnRenamed("vec", "a"), "i").join(res.h.withColumnRenamed("id", "j").withColumnRenamed("vec", "b"), "j")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    assert error.agg(F.sum((dot - F.col("v")) ** 2)).first()[0] == pytest.approx(losses[-1], rel=1e-6)


def test_an_eighth_of_the_ranks_first_and_steps_from_the_fourth(cells, monkeypatch):
    seen = []
    real = train._sgd_kernel
    monkeypatch.setattr(train, "_sgd_kernel", lambda lr, nmf, q, active: seen.append((round(lr, 6), active)) or real(lr, nmf, q, active))
    train_sgd(cells, TrainParams(k=16, lam=0.01, iters=5), SgdParams(blocks=1, split=True, bold=True))
    assert [a for _, a in seen] == [2, 16, 16, 16, 16]
    assert [r for r, _ in seen[:4]] == [0.1] * 4 and seen[4][0] in (0.105, 0.05)
