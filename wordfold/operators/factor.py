"""Factorization data operators.

Conventions: a rating / association table is COO (i, j, v[, w]); factor tables
are (id, vec array<double>) for rows (W) and columns (H). Every operator is a
single pass of joins and aggregates; products over all m x n cells are never
enumerated: the zero part of PU losses goes through k x k Gram matrices.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordfold.functions import vec as V
from wordfold.functions.rand import TWO_32, keyed_hash32, keyed_uniform, lit_key
from wordfold.operators.coo import gram_matrix, nnz_by_row
from wordfold.session import size_bounded_broadcast

# GloVe-style weight exponent and default cap.
GLOVE_ALPHA = 0.75
GLOVE_X_MAX = 10.0


def _wcol(coo: DataFrame) -> F.Column:
    return F.col("w") if "w" in coo.columns else F.lit(1.0)


def _side(f: DataFrame, key: str, name: str) -> DataFrame:
    return f.select(F.col("id").alias(key), F.col("vec").alias(name))


def with_factors(coo: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """Attach wi / hj vectors to every stored cell; null where an id has none."""
    return coo.join(_side(w, "i", "wi"), "i", "left").join(_side(h, "j", "hj"), "j", "left")


# ---------------------------------------------------------------- E1 - E4
def glove_weight(n: F.Column, x_max: float = GLOVE_X_MAX, alpha: float = GLOVE_ALPHA) -> F.Column:
    """E1 as an expression: 1 if n > x_max else (n / x_max) ** alpha."""
    return F.when(n > x_max, F.lit(1.0)).otherwise(F.pow(n / F.lit(float(x_max)), F.lit(float(alpha))))


def glove_weights(values: DataFrame, counts: DataFrame, x_max: float = GLOVE_X_MAX, alpha: float = GLOVE_ALPHA) -> DataFrame:
    """E1. Adds w from the count table keyed by (i, j) (cells without a count get 1)."""
    c = counts.select("i", "j", F.col("v").alias("_n"))
    return values.join(c, ["i", "j"], "left").withColumn(
        "w", F.coalesce(glove_weight(F.col("_n"), x_max, alpha), F.lit(1.0))).drop("_n")


def init_factors(ids: DataFrame, k: int, seed: int = 0, key: str = "id") -> DataFrame:
    """E2. (id, vec): each value uniform in [0, 1/sqrt(k)), keyed by (seed, id, t)."""
    scale = 1.0 / np.sqrt(k)
    vec = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda t: keyed_uniform(lit_key("init"), lit_key(seed), F.col("id"), t) * F.lit(scale),
    )
    return ids.select(F.col(key).alias("id")).distinct().select("id", vec.alias("vec"))


def zero_where_entries(factors: DataFrame, coo: DataFrame, key: str = "j") -> DataFrame:
    """E2. Zero the vectors of ids that have stored entries (cold start of H)."""
    has = coo.select(F.col(key).alias("id")).distinct().withColumn("_has", F.lit(True))
    return factors.join(has, "id", "left").select(
        "id", F.when(F.col("_has"), F.transform("vec", lambda x: x * 0.0)).otherwise(F.col("vec")).alias("vec")
    )


def init_bias_dims(w: DataFrame, h: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E3. Append two bias dimensions: W gets [1, 0] (fixed 1, then the row bias
    starting at 0); H gets [0, 1] (the column bias, then a fixed 1). The
    trainer keeps W[k-2] and H[k-1] frozen at 1."""
    wb = w.select("id", F.concat("vec", F.array(F.lit(1.0), F.lit(0.0))).alias("vec"))
    hb = h.select("id", F.concat("vec", F.array(F.lit(0.0), F.lit(1.0))).alias("vec"))
    return wb, hb


def center_values(train: DataFrame, test: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """E4. Subtract the train mean from train (and test); returns the one-row mean."""
    mean = train.agg(F.avg("v").alias("mean"))
    b = F.broadcast(mean.select(F.col("mean").alias("_b")))
    tr = train.crossJoin(b).withColumn("v", F.col("v") - F.col("_b")).drop("_b")
    te = test.crossJoin(b).withColumn("v", F.col("v") - F.col("_b")).drop("_b") if test is not None else None
    return tr, te, mean


def zero_empty_ids(factors: DataFrame, coo: DataFrame, key: str) -> DataFrame:
    """E4. Factors of ids without stored entries (key 'i' or 'j') become zero vectors."""
    has = coo.select(F.col(key).alias("id")).distinct().withColumn("_has", F.lit(True))
    return factors.join(has, "id", "left").select(
        "id", F.when(F.col("_has").isNull(), F.transform("vec", lambda x: x * 0.0)).otherwise(F.col("vec")).alias("vec")
    )


# ---------------------------------------------------------------- E5 - E7 rank-one pieces
def residuals(coo: DataFrame, u: DataFrame, v: DataFrame, add: bool = False) -> DataFrame:
    """E5. R = A - u_i v_j (or A + u_i v_j with add) per stored cell.

    ``u`` and ``v`` are scalar factor columns (id, x). Missing ids count as 0."""
    uj = coo.join(u.select(F.col("id").alias("i"), F.col("x").alias("_u")), "i", "left").join(
        v.select(F.col("id").alias("j"), F.col("x").alias("_v")), "j", "left")
    p = F.coalesce(F.col("_u"), F.lit(0.0)) * F.coalesce(F.col("_v"), F.lit(0.0))
    return uj.withColumn("v", F.col("v") + p if add else F.col("v") - p).drop("_u", "_v")


def residual_loss(r: DataFrame) -> DataFrame:
    """E5. One row: sum of squared residuals (unweighted)."""
    return r.agg(F.sum(F.col("v") * F.col("v")).alias("loss"))


def rank_one_update(cells: DataFrame, u: DataFrame, v: DataFrame, lam: float, nmf: bool = False) -> DataFrame:
    """E6. The best x_j for sum_i w_ij (r_ij - u_i x_j)^2 + lam n_j x_j^2 with u
    fixed: where the derivative vanishes, x_j = (sum w u r) / (sum w u^2 + lam n_j),
    not below 0 with ``nmf``. Columns without cells keep their value. Ids
    without an entry in ``u`` count as 0. Returns (id, x, gain), where gain is
    by how much the objective falls."""
    weight, at = _wcol(cells), F.coalesce(F.col("at"), F.lit(0.0))
    known = cells.join(u.select(F.col("id").alias("i"), F.col("x").alias("at")), "i", "left").groupBy(F.col("j").alias("id")).agg(
        F.sum(weight * at * F.col("v")).alias("slope"),
        (F.sum(weight * at * at) + lam * F.count(F.lit(1))).alias("curve"))
    best = F.when(F.col("curve") > 0, F.col("slope") / F.col("curve")).otherwise(0.0)
    best = F.greatest(best, F.lit(0.0)) if nmf else best

    def value(x: F.Column) -> F.Column:  # the objective as a function of x_j, without its constant
        return F.col("curve") * x * x - 2 * F.col("slope") * x

    there = v.select("id", F.col("x").alias("old")).join(known, "id", "left")
    moved = there.withColumn("x", F.when(F.col("slope").isNull(), F.col("old")).otherwise(best))
    return moved.select("id", "x", F.coalesce(value(F.col("old")) - value(F.col("x")), F.lit(0.0)).alias("gain"))


def pu_rank_one_update(coo: DataFrame, w: DataFrame, h: DataFrame, t: int, rho: float, lam: float) -> DataFrame:
    """E7. The best value of dimension t of every column vector for the PU
    objective, the other dimensions fixed.

    With p' the product without dimension t, the derivative vanishes where
    x (sum_stored (w - rho) u^2 + rho <u, u> + lam n) =
    sum_stored (w v - (w - rho) p') u - rho sum_{s<>t} <u, W_s> h_s: all pairs
    count with rho through one Gram row, and stored cells with the rest of
    their weight. Ids without factors count as zeros. Returns (id, x)."""
    gram_row = gram_matrix(w)[t]
    others = gram_row.copy()
    others[t] = 0.0
    weight, u = _wcol(coo), F.element_at("wi", t + 1)
    rest = V.dot("wi", "hj") - u * F.element_at("hj", t + 1)
    cells = with_factors(coo, w, h).where(F.col("wi").isNotNull() & F.col("hj").isNotNull())
    stored = cells.groupBy(F.col("j").alias("id")).agg(
        F.sum((weight * F.col("v") - (weight - rho) * rest) * u).alias("pull"),
        F.sum((weight - rho) * u * u).alias("curve"))
    n = nnz_by_row(coo, "j").select(F.col("j").alias("id"), "nnz")
    every = h.join(stored, "id", "left").join(n, "id", "left").na.fill(0, ["pull", "curve", "nnz"])
    push = V.dot("vec", F.array(*[F.lit(float(x)) for x in others]))
    curve = F.col("curve") + rho * float(gram_row[t]) + lam * F.col("nnz")
    return every.select("id", F.when(curve != 0, (F.col("pull") - rho * push) / curve).otherwise(0.0).alias("x"))


# ---------------------------------------------------------------- E8 - E11 losses
def predictions(coo: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """Stored cells with p = <w_i, h_j>; 0 where an id has no factors."""
    return with_factors(coo, w, h).withColumn("p", F.coalesce(V.dot("wi", "hj"), F.lit(0.0))).drop("wi", "hj")


def loss_rmse(coo: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """E8. One row: loss = sum (p - v)^2 over stored cells, rmse = sqrt(loss / nnz)."""
    p = predictions(coo, w, h)
    return p.agg(F.sum((F.col("p") - F.col("v")) ** 2).alias("loss"), F.count(F.lit(1)).alias("nnz")).select(
        "loss", F.sqrt(F.col("loss") / F.col("nnz")).alias("rmse"))


def gram_inner(w: DataFrame, h: DataFrame) -> float:
    """<W^T W, H^T H>: the sum of squared products over all row-column pairs,
    from two k x k Gram matrices."""
    return float((gram_matrix(w) * gram_matrix(h)).sum())


def stored_sums(coo: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """One row of what the losses need from the stored cells, in one pass:
    omega = sum w (v - p)^2, loss = sum (v - p)^2, pp = sum p^2, nnz, and
    reg = sum_i n_i |w_i|^2 + sum_j n_j |h_j|^2. Ids without factors count as
    zero vectors."""
    p, none = F.coalesce(V.dot("wi", "hj"), F.lit(0.0)), F.lit(0.0)
    cells = with_factors(coo, w, h).withColumn("p", p)
    norms = F.coalesce(V.sq_norm("wi"), none) + F.coalesce(V.sq_norm("hj"), none)
    error = (F.col("v") - F.col("p")) ** 2
    total = lambda c: F.coalesce(F.sum(c), none)
    return cells.agg(total(_wcol(coo) * error).alias("omega"), total(error).alias("loss"), total(F.col("p") * F.col("p")).alias("pp"),
                     F.count(F.lit(1)).alias("nnz"), total(norms).alias("reg"))


def pu_loss(coo: DataFrame, w: DataFrame, h: DataFrame, rho: float) -> DataFrame:
    """E9. One row (omega, zero, loss): omega = sum_Omega w (v - p)^2,
    zero = rho (<W^T W, H^T H> - sum_Omega p^2); m x n never enumerated."""
    zero = F.lit(rho) * (F.lit(gram_inner(w, h)) - F.col("pp"))
    return stored_sums(coo, w, h).select("omega", zero.alias("zero"), (F.col("omega") + zero).alias("loss"))


def weighted_zero_loss(coo: DataFrame, w: DataFrame, h: DataFrame, rho: float) -> DataFrame:
    """E10. (p - v)^2 over the stored cells with v > 0, rho p^2 over all other
    pairs of a row of ``w`` and a column of ``h``. The zero cells are never
    listed: their sum is that over all pairs (Gram) less the stored ones.
    One row (loss)."""
    p = predictions(coo.where(F.col("v") > 0), w, h)
    known = p.agg(F.coalesce(F.sum((F.col("p") - F.col("v")) ** 2), F.lit(0.0)).alias("positive"),
                  F.coalesce(F.sum(F.col("p") * F.col("p")), F.lit(0.0)).alias("pp"))
    return known.select((F.col("positive") + F.lit(rho) * (F.lit(gram_inner(w, h)) - F.col("pp"))).alias("loss"))


def regularizer(coo: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """E11. One row: reg = sum_i n_i |w_i|^2 + sum_j n_j |h_j|^2."""
    return stored_sums(coo, w, h).select("reg")


def objective(coo: DataFrame, w: DataFrame, h: DataFrame, rho: float, lam: float) -> DataFrame:
    """E11. One row (omega, zero, loss, reg, rmse, obj) with obj = omega + zero +
    lam * reg; one pass over the stored cells and two Gram matrices."""
    inner = gram_inner(w, h) if rho else 0.0
    zero = F.lit(rho) * (F.lit(inner) - F.col("pp"))
    return stored_sums(coo, w, h).select(
        "omega", zero.alias("zero"), (F.col("omega") + zero).alias("loss"), "reg",
        F.sqrt(F.col("loss") / F.col("nnz")).alias("rmse"), (F.col("omega") + zero + F.lit(lam) * F.col("reg")).alias("obj"))


# ---------------------------------------------------------------- E12 - E16 sampling
def _draw_cells(n_draws: DataFrame, m: int, n: int, seed: int, tag: str) -> DataFrame:
    """Uniform cells (i, j) in [0, m) x [0, n), one per row of ``n_draws``
    (column ``draw``), keyed by the draw id."""
    return n_draws.select(
        F.floor(keyed_uniform(lit_key(tag + "i"), lit_key(seed), "draw") * F.lit(float(m))).cast("long").alias("i"),
        F.floor(keyed_uniform(lit_key(tag + "j"), lit_key(seed), "draw") * F.lit(float(n))).cast("long").alias("j"),
    )


def dims_of(coo: DataFrame) -> DataFrame:
    """One row (m, n) = (max i + 1, max j + 1)."""
    return coo.agg((F.max("i") + 1).alias("m"), (F.max("j") + 1).alias("n"))


def sample_negatives(coo: DataFrame, m: int, n: int, strategy: str = "pu1", ratio: float = 1.0,
                     rho: float = 0.01, seed: int = 0) -> DataFrame:
    """E12. Mix of stored cells and uniformly drawn cells (value 0).

    * pu0: each stored cell is kept with prob nnz/(nnz+rho*m*n) and
      rho*m*n*(that share) cells are drawn;
    * pu1: all stored cells plus ratio*nnz drawn cells.
    Drawn cells may coincide with stored ones (as in the reference).
    Columns: (i, j, v, stored)."""
    spark = coo.sparkSession
    nnz = coo.count()
    mn = float(m) * float(n)
    if strategy == "pu0":
        keep_p = nnz / (nnz + rho * mn)
        n_draw = int(round(rho * mn * keep_p))
    elif strategy == "pu1":
        keep_p, n_draw = 1.0, int(round(ratio * nnz))
    else:
        raise ValueError(strategy)
    stored = coo.where(keyed_uniform(lit_key("keep"), lit_key(seed), "i", "j") < keep_p) if keep_p < 1 else coo
    stored = stored.select("i", "j", "v", F.lit(True).alias("stored"))
    drawn = _draw_cells(spark.range(n_draw).withColumnRenamed("id", "draw"), m, n, seed, "neg").select(
        "i", "j", F.lit(0.0).alias("v"), F.lit(False).alias("stored"))
    return stored.unionByName(drawn)


#: Cells drawn from a block of cell numbers, about.
DRAWS = 4096


def _gaps(cells: int, block: int, rate: float, seed: int):
    """Blocks of cell numbers -> the numbers drawn: from one to the next the
    gap is geometric, so the work goes with the draws, not with the cells."""
    log_rest = math.log1p(-rate) if rate < 1 else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for number in batch["id"]:
                at, end = int(number) * block - 1, min((int(number) + 1) * block, cells)
                for k in itertools.count():
                    u = int(hashlib.md5(f"gap|{seed}|{number}|{k}".encode()).hexdigest()[:8], 16) / TWO_32
                    at += 1 + (math.floor(math.log1p(-u) / log_rest) if log_rest else 0)
                    if at >= end:
                        break
                    out.append(at)
            yield pd.DataFrame({"cell": np.array(out, np.int64)})

    return run


def sample_zero_cells(coo: DataFrame, m: int, n: int, rate: float, seed: int = 0) -> DataFrame:
    """E12 by rate: every cell of the m x n grid that isn't stored is drawn
    once with probability ``rate``, independently. (i, j, v = 0).

    Cells are numbered row by row and drawn by gaps within blocks of numbers,
    as many blocks as there are draws by ``DRAWS``; drawn cells that are stored
    are rejected by an anti join. Nothing of the size of the grid is made."""
    if not 0 <= rate <= 1:
        raise ValueError(f"{rate} is no probability")
    cells = int(m) * int(n)
    if not cells or not rate:
        return coo.select("i", "j", F.lit(0.0).alias("v")).limit(0)
    block = max(1, min(cells, int(DRAWS / rate)))
    blocks = coo.sparkSession.range(-(-cells // block))
    drawn = blocks.mapInPandas(_gaps(cells, block, rate, seed), "cell long")
    placed = drawn.select(F.expr(f"cell div {int(n)}L").alias("i"), (F.col("cell") % F.lit(int(n))).alias("j"))
    return placed.join(coo.select("i", "j"), ["i", "j"], "left_anti").select("i", "j", F.lit(0.0).alias("v"))


def sample_cells_lookup(coo: DataFrame, m: int, n: int, n_draw: int, rho: float = 1.0, seed: int = 0) -> DataFrame:
    """E13. Uniform cells with their stored value (0 if absent) and weight 1
    for stored cells, rho for absent ones. (i, j, v, w)."""
    spark = coo.sparkSession
    cells = _draw_cells(spark.range(n_draw).withColumnRenamed("id", "draw"), m, n, seed, "look")
    look = cells.join(coo.select("i", "j", F.col("v").alias("_v")), ["i", "j"], "left")
    return look.select("i", "j", F.coalesce("_v", F.lit(0.0)).alias("v"),
                       F.when(F.col("_v").isNull(), F.lit(rho)).otherwise(F.lit(1.0)).alias("w"))


def pu_zero_gradient_step(w: DataFrame, h: DataFrame, rho: float, eta: float) -> tuple[DataFrame, DataFrame]:
    """E15. W <- W - eta rho W (H^T H); then H <- H - eta rho H (W^T W) with the new W.

    The k x k Gram is reduced to the driver (bounded by k, not data) and
    shipped with the task closure; each Arrow batch of factor rows is updated
    by one numpy product (no per-element expressions, so the plan does not
    grow with k^2)."""
    def step(x: DataFrame, g: np.ndarray) -> DataFrame:
        m = float(eta * rho) * np.asarray(g, dtype=float)
        x = x.select("id", "vec")

        def run(batches):
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                v = np.stack(pdf["vec"].to_numpy()).astype(float)
                yield pd.DataFrame({"id": pdf["id"], "vec": list(v - v @ m)})

        return x.mapInPandas(run, x.schema)

    w2 = step(w, gram_matrix(h))
    h2 = step(h, gram_matrix(w2))
    return w2, h2


def entry_regularization(entries: DataFrame, coo: DataFrame, n_cols: int, lam: float, mode: str = "row_share",
                         side: str = "i", name: str = "lam") -> DataFrame:
    """E16. Per-entry lambda from the entry count n of its row (``side`` 'j':
    of its column, with ``n_cols`` the number of rows then):
    'row_share' -> lam n / (n_cols + n); 'row_frac' -> lam n / n_cols;
    'stored_only' / 'zero_only' -> row_frac on stored (v > 0) / zero cells, 0
    elsewhere. Adds column ``name``; a trainer takes one per side."""
    counts = size_bounded_broadcast(nnz_by_row(coo, side))
    n = F.coalesce(F.col("nnz"), F.lit(0))
    share = F.lit(float(lam)) * n / (F.lit(float(n_cols)) + n)
    frac = F.lit(float(lam)) * n / F.lit(float(n_cols))
    modes = {"row_share": share, "row_frac": frac, "stored_only": F.when(F.col("v") > 0, frac).otherwise(0.0),
             "zero_only": F.when(F.col("v") <= 0, frac).otherwise(0.0)}
    return entries.join(counts, side, "left").withColumn(name, modes[mode]).drop("nnz")


def block_of(ids: F.Column, n_blocks: int, seed: int = 0) -> F.Column:
    """Block index of an id (stratified SGD grids)."""
    return F.pmod(keyed_hash32(lit_key("blk"), lit_key(seed), ids), F.lit(n_blocks)).cast("int")
