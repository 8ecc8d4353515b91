"""Training jobs (T1-T11): iterative driver loops whose every step is a
distributed Spark job. Factor tables are written to the shared checkpoint
folder after every half-iteration (a reliable lineage cut that survives
executor loss); optional ``snapshot_path`` keeps them as ``iter=N``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordfold.functions import vec as V
from wordfold.operators import factor as E
from wordfold.operators.coo import dense_ids, transpose
from wordfold.operators.grouped import running_sums_before
from wordfold.operators.residual import rank_one_cells
from wordfold.operators.solve import DEFAULT_HEAVY, plan_side, solve_side
from wordfold.session import cut_lineage, discard
from wordfold.sources.matrix import snapshot_factors


@dataclass
class TrainParams:
    """Defaults follow the reference library: k 10, 5 outer / 5 inner
    iterations, lambda 0.1, rho 1e-3, eps 1e-3."""
    k: int = 10
    lam: float = 0.1
    rho: float = 1e-3
    iters: int = 5
    inner: int = 5
    eps: float = 1e-3
    bias: bool = False
    seed: int = 0
    nmf: bool = False
    heavy_rows: int = DEFAULT_HEAVY
    log: bool = True  # keep the metrics of every iteration; never changes the model
    center: bool = False  # subtract the mean of the values and keep it in the result
    snapshot_path: str | None = None


@dataclass
class TrainResult:
    w: DataFrame
    h: DataFrame
    log: DataFrame | None = None
    history: list = field(default_factory=list)
    mean: float = 0.0  # to be added to every prediction


def centered(coo: DataFrame, p: TrainParams, test: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, float]:
    """The entries (and test entries) less the training mean, if asked."""
    if not p.center:
        return coo, test, 0.0
    mean = float(E.center_values(coo)[2].first()["mean"] or 0.0)
    less = lambda df: df.withColumn("v", F.col("v") - mean)
    return less(coo), less(test) if test is not None else None, mean


def _metrics_row(coo: DataFrame, w: DataFrame, h: DataFrame, p: TrainParams, test: DataFrame | None) -> dict:
    out = E.objective(coo, w, h, p.rho, p.lam).first().asDict()
    out["train_rmse"] = out.pop("rmse")
    if test is not None:
        out["test_rmse"] = E.loss_rmse(test, w, h).first()["rmse"]
    return {k: float(v) for k, v in out.items() if v is not None}


def _log_frame(spark, history: list) -> DataFrame:
    rows = [(int(h["iter"]), k, float(v)) for h in history for k, v in h.items() if k != "iter" and v is not None]
    return spark.createDataFrame(rows, "iter int, metric string, value double")


def init_model(coo: DataFrame, p: TrainParams, w0: DataFrame | None = None, h0: DataFrame | None = None):
    """Random W (seed), H zero where columns have entries (cold start),
    bias dims appended when asked; warm start takes given W, H."""
    rows = coo.select(F.col("i").alias("id")).distinct()
    cols = coo.select(F.col("j").alias("id")).distinct()
    k = p.k
    if w0 is not None and h0 is not None:
        return w0, h0, rows, cols
    w = E.init_factors(rows, k, p.seed)
    h = E.zero_where_entries(E.init_factors(cols, k, p.seed + k), coo, "j")
    if p.bias:
        w, h = E.init_bias_dims(w, h)
    return w, h, rows, cols


def train_pu(coo: DataFrame, p: TrainParams, test: DataFrame | None = None,
             w0: DataFrame | None = None, h0: DataFrame | None = None) -> TrainResult:
    """T2/T3. Weighted PU factorization by exact alternating row solves.

    Minimizes sum_Omega w (a - p)^2 + rho sum_{not Omega} p^2
    + lam (sum_i n_i |w_i|^2 + sum_j n_j |h_j|^2); ``w`` comes from a ``w``
    column (E1 weights) or is 1. With ``bias`` two extra dims hold row / column
    biases (W[k-2] = 1 and H[k-1] = 1 frozen). H is solved first, then W.
    T9: stops when the relative objective decrease falls below eps."""
    spark = coo.sparkSession
    coo, test, mean = centered(coo, p, test)
    coo = cut_lineage(coo.select("i", "j", "v", *(["w"] if "w" in coo.columns else [])), "train-entries")
    w, h, rows, cols = init_model(coo, p, w0, h0)
    # id lists are read by every half-iteration: written once, not re-derived
    # from the entries (a shuffle) each time
    rows, cols = cut_lineage(rows, "row-ids"), cut_lineage(cols, "col-ids")
    # every solve returns one vector per listed id, so the fixed side's size
    # is the id count (not counted again each half-iteration); warm starts
    # may bring other ids, so they are counted
    n_rows, n_cols = (None, None) if w0 is not None else (rows.count(), cols.count())
    kk = p.k + 2 if (p.bias and w0 is None) else p.k
    fix_h = {kk - 1: 1.0} if p.bias else {}
    fix_w = {kk - 2: 1.0} if p.bias else {}
    w = cut_lineage(w, "W")
    plan_h, plan_w = plan_side(coo, "j", p.heavy_rows, "i"), plan_side(coo, "i", p.heavy_rows, "j")
    history, prev = [], None
    for it in range(1, p.iters + 1):
        h = cut_lineage(solve_side(coo, "j", "i", w, kk, p.rho, p.lam, fix_h, cols, p.heavy_rows, plan_h,
                                   n_x=n_rows), "H")
        w = cut_lineage(solve_side(coo, "i", "j", h, kk, p.rho, p.lam, fix_w, rows, p.heavy_rows, plan_w,
                                   n_x=n_cols), "W")
        if p.snapshot_path:
            w, h = snapshot_factors(w, h, p.snapshot_path, it)
        if p.log or p.eps > 0:
            m = _metrics_row(coo, w, h, p, test)
            m["iter"] = it
            history.append(m)
            if prev is not None and prev > 0 and (prev - m["obj"]) / prev < p.eps:
                break
            prev = m["obj"]
    for pl in (plan_h, plan_w):
        if pl.layout is not None:
            pl.layout.unpersist()
        if pl.heavy is not None:
            pl.heavy.unpersist()
    return TrainResult(w, h, _log_frame(spark, history) if p.log else None, history, mean)


def train_als(coo: DataFrame, p: TrainParams, implicit: bool = False, alpha: float = 1.0) -> TrainResult:
    """T1. Explicit ALS with n_i-scaled regularization (MLlib's ALS-WR);
    ``implicit`` gives the confidence-weighted variant used for T2 with unit
    values. MLlib wants 32-bit ids, so any long ids are numbered first."""
    from pyspark.ml.recommendation import ALS

    coo, _, mean = centered(coo, p)
    ids = {c: cut_lineage(dense_ids(coo.select(c).distinct(), [c], f"_{c}"), f"als-{c}") for c in ("i", "j")}
    numbered = coo.join(ids["i"], "i").join(ids["j"], "j")
    als = ALS(rank=p.k, maxIter=p.iters, regParam=p.lam, userCol="_i", itemCol="_j", ratingCol="v",
              implicitPrefs=implicit, alpha=alpha, nonnegative=p.nmf, seed=p.seed,
              coldStartStrategy="nan", checkpointInterval=2)
    model = als.fit(numbered.select(F.col("_i").cast("int"), F.col("_j").cast("int"), F.col("v").cast("float")))

    def named(factors: DataFrame, c: str) -> DataFrame:
        back = ids[c].select(F.col(f"_{c}").alias("id"), F.col(c).cast("long").alias("key"))
        return factors.join(back, "id").select(F.col("key").alias("id"), F.transform("features", lambda x: x.cast("double")).alias("vec"))

    return TrainResult(named(model.userFactors, "i"), named(model.itemFactors, "j"), mean=mean)


def train_pu_als_unit(coo: DataFrame, p: TrainParams) -> TrainResult:
    """T2 with all values 1: MLlib implicit ALS with alpha = (1 - rho) / rho and
    regParam = lam / rho minimizes the same objective up to the factor rho."""
    q = TrainParams(**{**p.__dict__, "lam": p.lam / p.rho})
    return train_als(coo.withColumn("v", F.lit(1.0)), q, implicit=True, alpha=(1 - p.rho) / p.rho)


# ---------------------------------------------------------------- T4 / T5 cyclic rank-one descent
def _dim(f: DataFrame, t: int) -> DataFrame:
    return f.select("id", F.element_at("vec", t + 1).alias("x"))


def train_ccd(coo: DataFrame, p: TrainParams, growing: bool = False) -> TrainResult:
    """T4 (and T5 with ``growing``). Cyclic rank-one descent on the squared
    loss with n-scaled lambda, on the cells laid out by
    :mod:`wordfold.operators.residual`.

    A pass takes the ranks in turn, with the other ranks' products taken out
    of the cells, in up to ``inner`` sweeps (E6 for columns, then rows).

    T9: a sweep that lowers the objective by less than ``eps`` of the pass's
    best one is its rank's last, and a pass ends after five ranks whose first
    sweep did (the very first sweep, from a cold start, is no measure).
    Training ends after ``iters`` passes, or when a pass lowers the objective
    by less than ``eps`` of it. Growing mode activates 1, 2, 4, ... k ranks
    pass by pass, with lambda falling linearly from lam * log2(k) to lam; it
    goes on after ``iters`` passes until all ranks were active in one. The
    history tells a pass's ``active`` ranks, how many were ``fitted`` and in
    how many ``sweeps``, and the rank fitted ``last``."""
    spark = coo.sparkSession
    coo, _, mean = centered(coo, p)
    entries = cut_lineage(coo.select("i", "j", "v", *(["w"] if "w" in coo.columns else [])), "ccd-entries")
    w, h, _, _ = init_model(entries, p)
    w, h = cut_lineage(w, "W"), cut_lineage(h, "H")
    cells = rank_one_cells(entries, w, h, p.k)
    history = []
    grown = math.ceil(math.log2(max(p.k, 1))) + 1 if growing else 0  # the first pass of all ranks
    for it in range(1, max(p.iters, grown) + 1):
        active = min(p.k, 2 ** (it - 1)) if growing else p.k
        lam = p.lam * max(1.0, math.log2(max(p.k, 2)) - (it - 1)) if growing else p.lam
        best, weak, gained, sweeps, fitted = 0.0, 0, 0.0, 0, 0
        for t in range(active):
            if weak == 5:
                break
            cells.open(t, p.inner)
            for n in range(p.inner):
                gain = cells.sweep(lam, p.nmf)
                gained, sweeps = gained + gain, sweeps + 1
                if gain < p.eps * best:
                    weak += n == 0
                    break
                if (it, t, n) != (1, 0, 0):
                    best = max(best, gain)
            cells.close()
            fitted, last = fitted + 1, t
        left = cells.loss()
        history.append({"iter": it, "loss": left, "gain": gained, "active": active, "fitted": fitted, "sweeps": sweeps, "last": last})
        if active == p.k and gained < p.eps * (left + gained):
            break
    factors = cells.factors()
    cells.drop()
    discard(entries, w, h)
    return TrainResult(*factors, _log_frame(spark, history) if p.log else None, history, mean)


def rank_settled(coo: DataFrame, res: TrainResult, t: int, lam: float, tolerance: float = 1e-6) -> DataFrame:
    """(id, settled): whether the row factor of the rank fitted last is the
    best one for its column factor and all other ranks (E6 finds no better)."""
    p = E.predictions(coo.withColumn("v", F.col("v") - res.mean), res.w, res.h)
    u, v = _dim(res.w, t), _dim(res.h, t)
    cells = E.residuals(p.withColumn("v", F.col("v") - F.col("p")).drop("p"), u, v, add=True)
    best = E.rank_one_update(transpose(cells), v, u, lam).select("id", F.col("x").alias("best"))
    return u.join(best, "id").select("id", (F.abs(F.col("x") - F.col("best")) <= tolerance * (1 + F.abs("best"))).alias("settled"))


# ---------------------------------------------------------------- T6 - T8 stratified SGD
#: Entries of a block whose gradients are taken together.
MINI_BATCH = 64


@dataclass
class SgdParams:
    """``lr`` step size; ``adagrad`` scales it per dimension; ``bold`` adapts
    it by the loss of each iteration (T10). ``rho`` weighs zero cells (T7);
    with ``shifted`` (T8) the zero cells' pull of rho p on every pair comes
    from one dense step an iteration (E15), and a stored cell only adds what
    it differs by, (1 - rho) p - v. ``split``: of the k dimensions the first
    eighth (one at least) learns alone in the first iteration, the others from
    the second on. ``entries``: entries of a block, about; ``blocks``: the
    grid's width, if it shouldn't follow from them."""
    lr: float = 0.1
    adagrad: bool = True
    bold: bool = False
    rho: float | None = None
    shifted: bool = False
    split: bool = False
    entries: int = 200_000
    blocks: int | None = None


def _sgd_kernel(lr: float, nmf: bool, q: SgdParams, active: int):
    """One block: SGD over its entries in the order of their keys, in
    mini-batches; each step uses the vectors as the batch found them and adds
    up the gradients of entries that share an id."""

    def step(x: np.ndarray, g2: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        ids, where = np.unique(at, return_inverse=True)
        total = np.zeros((len(ids), x.shape[1]))
        np.add.at(total, where, grad)
        if q.adagrad:
            g2[ids] += total * total
            total /= np.sqrt(g2[ids] + 1e-8)
        x[ids] -= lr * total
        if nmf:
            x[ids] = np.maximum(x[ids], 0)

    def places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, wanted)
        if len(wanted) and (not len(known) or (known[np.minimum(at, len(known) - 1)] != wanted).any()):
            raise ValueError("an entry's id has no factors in its block")
        return at

    def run(ents: pd.DataFrame, fac: pd.DataFrame) -> pd.DataFrame:
        if len(fac) == 0:
            return pd.DataFrame({"side": [], "id": [], "vec": [], "g2": []})
        fac = fac.sort_values(["side", "id"], kind="stable")
        side, ids = fac["side"].to_numpy(), fac["id"].to_numpy().astype(np.int64)
        x, g2 = (np.stack(fac[c].to_numpy()).astype(float) for c in ("vec", "g2"))
        n_h = int((side == "H").sum())  # H sorts before W
        xh, xw, gh, gw = x[:n_h], x[n_h:], g2[:n_h], g2[n_h:]
        ents = ents.sort_values("key", kind="stable")
        i, j = (ents[c].to_numpy().astype(np.int64) for c in ("i", "j"))
        v, li, lj = (ents[c].to_numpy(dtype=float) for c in ("v", "lam_i", "lam_j"))
        ri, cj = places(ids[n_h:], i), places(ids[:n_h], j)
        for lo in range(0, len(v), MINI_BATCH):
            b = slice(lo, lo + MINI_BATCH)
            a, c = xw[ri[b]], xh[cj[b]]
            p = (a * c).sum(axis=1)
            if q.shifted:
                err = np.where(v[b] > 0, (1 - q.rho) * p - v[b], q.rho * p)
            else:
                err = p - v[b]
                if q.rho is not None:
                    err = np.where(v[b] > 0, err, q.rho * err)
            grad_w, grad_h = err[:, None] * c + li[b, None] * a, err[:, None] * a + lj[b, None] * c
            grad_w[:, active:] = 0.0
            grad_h[:, active:] = 0.0
            step(xw, gw, ri[b], grad_w)
            step(xh, gh, cj[b], grad_h)
        return pd.DataFrame({"side": side, "id": ids, "vec": list(x), "g2": list(g2)})

    return run


def balanced_blocks(ent: DataFrame, side: str, blocks: int, total: int, seed: int) -> DataFrame:
    """(id, copy, copies, key, blk) of one side's ids, written: blocks of about
    as many entries each, cut from the entries' histogram in a keyed order. An
    id with more entries than a block's mean is split into copies with a share
    of them each. A block has the mean and less than one id or copy more, so
    twice the mean at most. ``key`` numbers ids and copies."""
    mean = max(1, -(-total // blocks))
    counts = ent.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    sized = counts.withColumn("copies", F.ceil(F.col("n") / mean).cast("long"))
    each = sized.select("id", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), (F.col("n") / F.col("copies")).alias("size"))
    each = each.select("*", F.lit(0).alias("all"), F.lit(1).cast("long").alias("one"), F.xxhash64(F.lit(seed), "id", "copy").alias("place"))
    placed = running_sums_before(each, ["all"], [F.col("place"), F.col("id"), F.col("copy")], ["size", "one"])
    blk = F.least(F.floor(F.col("size_before") * F.lit(blocks) / F.lit(max(total, 1))).cast("long"), F.lit(blocks - 1))
    return cut_lineage(placed.select("id", "copy", "copies", F.col("one_before").alias("key"), blk.alias("blk")), f"sgd-blocks-{side}")


def _keyed(ent: DataFrame, side: str, other: str, places: DataFrame, seed: int) -> DataFrame:
    """Entries with ``key`` and block of their id, or of its copy, on a side."""
    copies = places.where(F.col("copy") == 0).select(F.col("id").alias(side), "copies")
    at = places.select(F.col("id").alias(side), "copy", F.col("key").alias(f"k{side}"), F.col("blk").alias("rb" if side == "i" else "cb"))
    with_copy = ent.join(copies, side).withColumn("copy", F.pmod(F.xxhash64(F.lit(seed), other), F.col("copies"))).drop("copies")
    return with_copy.join(at, [side, "copy"]).drop("copy")


def train_sgd(coo: DataFrame, p: TrainParams, q: SgdParams | None = None) -> TrainResult:
    """T6 (T7 with ``rho``, T8 with ``shifted``). Stratified SGD on a B x B
    grid of id blocks: a stratum's blocks share no row or column, so its B
    jobs run in parallel, each with just the factors it touches (cogrouped by
    block). Every iteration takes the strata in another order. B follows from
    the number of entries, so that a block holds about ``q.entries``; the cuts
    follow their histogram, and a hot row or column is split into copies that
    are trained in their own blocks and averaged after each iteration.
    ``coo`` may bring lambdas per entry and side (``lam_i``, ``lam_j``, E16);
    the default is ``p.lam`` for both. Repeated cells stay separate entries."""
    q = q or SgdParams()
    spark = coo.sparkSession
    coo, _, mean = centered(coo, p)
    lams = [F.col(c) if c in coo.columns else F.lit(p.lam).alias(c) for c in ("lam_i", "lam_j")]
    raw = cut_lineage(coo.select("i", "j", "v", *lams), "sgd-raw")
    n = raw.count()
    blocks = q.blocks or max(2, math.ceil(math.sqrt(n / q.entries)))
    places = {c: balanced_blocks(raw, c, blocks, n, p.seed + k) for k, c in enumerate("ij")}
    ent = cut_lineage(_keyed(_keyed(raw, "i", "j", places["i"], p.seed), "j", "i", places["j"], p.seed), "sgd-entries")
    zeros = F.array_repeat(F.lit(0.0), p.k)
    # every copy of an id starts with its vector; `key` stands for the copy
    fac = reduce(DataFrame.unionByName, [
        E.init_factors(places[c].where(F.col("copy") == 0).select("id"), p.k, seed).join(places[c].select("id", "key", "blk"), "id").select(
            F.lit(side).alias("side"), F.col("key").alias("id"), "vec", zeros.alias("g2"), F.col("blk").cast("long").alias("blk"))
        for side, c, seed in (("W", "i", p.seed), ("H", "j", p.seed + p.k))])
    fac = cut_lineage(fac, "sgd-factors")
    names = reduce(DataFrame.unionByName, [places[c].select(F.lit(side).alias("side"), F.col("key").alias("id"), F.col("id").alias("name"), "copies", "blk")
                                           for side, c in (("W", "i"), ("H", "j"))])
    names = cut_lineage(names, "sgd-names")
    split = names.where(F.col("copies") > 1).limit(1).count() > 0
    schema = "side string, id long, vec array<double>, g2 array<double>"
    history, lr, rng = [], q.lr, np.random.default_rng(p.seed)

    def sides() -> tuple[DataFrame, DataFrame]:
        """(id, vec) of both sides: an id's copies as their mean."""
        whole = fac.join(names.select("side", "id", "name"), ["side", "id"]).groupBy("side", "name").agg(
            F.array(*[F.avg(F.get("vec", F.lit(t))) for t in range(p.k)]).alias("vec"))
        return tuple(whole.where(F.col("side") == s).select(F.col("name").alias("id"), "vec") for s in "WH")

    def renewed(new: DataFrame) -> DataFrame:
        """All copies with the vectors of ``side, name, new``."""
        of = fac.join(names.select("side", "id", "name"), ["side", "id"]).join(new, ["side", "name"])
        return cut_lineage(of.select("side", "id", F.col("new").alias("vec"), "g2", "blk"), "sgd-factors")

    def named(w_: DataFrame, h_: DataFrame) -> DataFrame:
        both = w_.withColumn("side", F.lit("W")).unionByName(h_.withColumn("side", F.lit("H")))
        return both.select("side", F.col("id").alias("name"), F.col("vec").alias("new"))

    def loss() -> float:
        w_, h_ = sides()
        if q.shifted:
            return float(E.pu_loss(raw.where(F.col("v") > 0), w_, h_, q.rho).first()["loss"])
        cells = raw.withColumn("w", F.when(F.col("v") > 0, 1.0).otherwise(1.0 if q.rho is None else q.rho))
        return float(E.stored_sums(cells, w_, h_).first()["omega"])

    if p.log or q.bold:
        history.append({"iter": 0, "loss": loss()})
    for it in range(1, p.iters + 1):
        active = max(1, p.k // 8) if q.split and it == 1 else p.k
        for s in rng.permutation(blocks).tolist():
            keyed = ent.where(F.pmod(F.col("cb") - F.col("rb"), F.lit(blocks)) == s).select(
                F.col("rb").alias("task"), F.col("ki").alias("i"), F.col("kj").alias("j"), "v", "lam_i", "lam_j", F.xxhash64("i", "j", F.lit(it)).alias("key"))
            task = F.when(F.col("side") == "W", F.col("blk")).otherwise(F.pmod(F.col("blk") - F.lit(s), F.lit(blocks)))
            moved = keyed.groupBy("task").cogroup(fac.withColumn("task", task).groupBy("task")).applyInPandas(
                _sgd_kernel(lr, p.nmf, q, active), schema)
            old, fac = fac, cut_lineage(moved.join(names.select("side", "id", "blk"), ["side", "id"]), "sgd-factors")
            discard(old)
        if q.shifted:
            w_, h_ = sides()
            # at most the share lr of a vector: no eigenvalue of a Gram matrix exceeds its trace
            trace = max(f.agg(F.sum(V.sq_norm("vec"))).first()[0] or 0.0 for f in (w_, h_))
            fac = renewed(named(*E.pu_zero_gradient_step(w_, h_, q.rho, lr / (q.rho * max(trace, 1.0)))))
        elif split:
            fac = renewed(named(*sides()))
        if p.log or q.bold:
            history.append({"iter": it, "loss": loss()})
            if q.bold and it >= BOLD_FROM:
                lr = bold_driver(history, lr)
    w, h = (cut_lineage(f, "factors") for f in sides())
    discard(raw, ent, fac, names, *places.values())
    return TrainResult(w, h, _log_frame(spark, history) if p.log else None, history, mean)


#: The first iteration that changes the step size.
BOLD_FROM = 4


def bold_driver(history: list, lr: float) -> float:
    """T10. The next step size: 5 % more after a fall of the loss, half after
    a rise."""
    return lr * (1.05 if history[-1]["loss"] <= history[-2]["loss"] else 0.5)
