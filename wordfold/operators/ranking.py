"""Prediction, recommendation and ranking metrics.

Factor tables are (id, vec); truth / ignore tables are COO (i, j, v).
Full-candidate work (top-k, rank of every positive among all candidates) runs
in blocked numpy kernels (see :mod:`wordfold.operators.blocks`): a block pair
emits only per-query summaries (local top-k rows, "how many candidates beat
this positive"), never the m x n score matrix.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordfold.functions import vec as V
from wordfold.operators.grouped import running_sums_before
from wordfold.operators.blocks import DEFAULT_BLOCK_ROWS, Blocks, exact_scores, finite, matrix, near, streamed, top_candidates, where
from wordfold.session import cut_lineage

#: Query rows scored against a block at once.
TILE_ROWS = 1024
# Fixed values of the half-life utility: neutral relevance 0, half-life 5.
HLU_NEUTRAL = 0.0
HLU_HALFLIFE = 5.0


# ---------------------------------------------------------------- F1 / F2 / F4
def predict(pairs: DataFrame, w: DataFrame, h: DataFrame, bias: float = 0.0) -> DataFrame:
    """F1. Adds ``pred`` = bias + <w_i, h_j>; ids without factors get the bias only."""
    j = pairs.join(w.select(F.col("id").alias("i"), F.col("vec").alias("_w")), "i", "left").join(
        h.select(F.col("id").alias("j"), F.col("vec").alias("_h")), "j", "left")
    return j.withColumn("pred", F.lit(float(bias)) + F.coalesce(V.dot("_w", "_h"), F.lit(0.0))).drop("_w", "_h")


def predict_row(w: DataFrame, h: DataFrame, row: int, bias: float = 0.0) -> DataFrame:
    """F2. (j, pred) for every column of one row (the row vector is one
    broadcast row)."""
    wi = w.where(F.col("id") == row).select(F.col("vec").alias("_w"))
    return h.crossJoin(F.broadcast(wi)).select(F.col("id").alias("j"), (F.lit(float(bias)) + V.dot("vec", "_w")).alias("pred"))


def predict_col(w: DataFrame, h: DataFrame, col: int, bias: float = 0.0) -> DataFrame:
    """F2. (i, pred) for every row of one column."""
    return predict_row(h, w, col, bias).withColumnRenamed("j", "i")


def prediction_rmse(scored: DataFrame, truth: str = "v", pred: str = "pred") -> DataFrame:
    """F4. One row: sqrt(mean((v - p)^2))."""
    return scored.agg(F.sqrt(F.avg((F.col(truth) - F.col(pred)) ** 2)).alias("rmse"))


def row_vectors(rows: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """(i, vec) of every distinct row; rows without factors get zeros, so all
    their candidates tie, as :func:`predict` has it."""
    return rows.select("i").distinct().join(w.select(F.col("id").alias("i"), "vec"), "i", "left").select(
        "i", F.coalesce("vec", V.zeros(k)).alias("vec"))


def width(h: DataFrame) -> int:
    """Number of factor dimensions (0 for an empty table)."""
    first = h.select(F.size("vec").alias("k")).first()
    return first["k"] if first else 0


# ---------------------------------------------------------------- F3 top-k
def recommend_topk(rows: DataFrame, w: DataFrame, h: DataFrame, k: int = 10, ignored: DataFrame | None = None,
                   block_rows: int = DEFAULT_BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """F3. (i, rank, j, score): per requested row the k best columns by
    <w_i, h_j>, ignored cells excluded, ties by column id; rows with fewer
    valid candidates return fewer rows, rows without factors score 0.
    Column-wise top-k: swap w and h and transpose ``ignored``. Blocks of
    columns too short to enter are skipped (``report``: pairs and pairs met)."""
    k_dims = width(h)
    q = row_vectors(rows.select(F.col("id").alias("i")), w, k_dims)
    if ignored is not None:
        own = ignored.where(F.col("j").isNotNull()).groupBy(F.col("i").alias("_i")).agg(F.collect_set(F.col("j").cast("long")).alias("_away"))
        q = q.join(own, F.col("i") == F.col("_i"), "left").select("i", "vec", F.coalesce("_away", F.array().cast("array<long>")).alias("_away"))
    cand = h.select(F.col("id").cast("long").alias("j"), "vec")
    return top_candidates(q, cand, "i", "j", "vec", k, False, block_rows, "_away" if ignored is not None else None, report=report).select(
        "i", "j", "score", "rank")


# ---------------------------------------------------------------- F5 - F7 DCG
def gain(rel: F.Column) -> F.Column:
    return F.pow(F.lit(2.0), rel) - 1.0


def discount(pos1: F.Column) -> F.Column:
    """1 / log2(position + 1) for a 1-based position."""
    return F.lit(1.0) / F.log2(pos1 + 1.0)


def dcg_at_levels(ranked: DataFrame, group: list, pos: str, rel: str, k: int) -> DataFrame:
    """F5. (group..., level, dcg): cumulative DCG for levels 1..k of 1-based
    positions; lists shorter than a level repeat their last value."""
    contrib = ranked.where(F.col(pos) <= k).select(*group, F.col(pos).alias("_p"), (gain(F.col(rel)) * discount(F.col(pos))).alias("_g"))
    per_level = contrib.select(*group, F.explode(F.sequence(F.col("_p"), F.lit(k))).alias("level"), "_g")
    groups = ranked.select(*group).distinct()
    levels = groups.select(*group, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("level"))
    sums = per_level.groupBy(*group, "level").agg(F.sum("_g").alias("dcg"))
    return levels.join(sums, [*group, "level"], "left").withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))


def _ndcg_average(dcg: DataFrame, ideal: DataFrame, group: list) -> DataFrame:
    j = dcg.join(ideal.withColumnRenamed("dcg", "maxdcg"), [*group, "level"])
    ok = F.col("maxdcg") > 0
    return j.groupBy("level").agg(
        F.avg(F.when(ok, 100.0 * F.col("dcg") / F.col("maxdcg"))).alias("ndcg"),
        F.avg(F.when(ok, F.col("dcg"))).alias("dcg"),
    )


def ndcg_rated(scored: DataFrame, k: int = 10, by: str = "i", truth: str = "v", pred: str = "pred") -> DataFrame:
    """F6. (level, ndcg, dcg): per group (row 'i' or column 'j') the rated cells
    are ranked by prediction (ties by the other id) and by truth for the ideal;
    groups with maxDCG > 0 are averaged. NaN cells drop; k <= 0 means 3."""
    k = 3 if k <= 0 else k
    other = "j" if by == "i" else "i"
    c = scored.where(~F.isnan(truth) & ~F.isnan(pred) & F.col(truth).isNotNull() & F.col(pred).isNotNull())
    # only positions <= k enter the DCG: the filter right after row_number lets
    # Spark keep a per-task top-k (WindowGroupLimit) before the group shuffle
    by_pred = c.withColumn("_pos", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(pred), F.asc(other)))).where(
        F.col("_pos") <= k)
    by_true = c.withColumn("_pos", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(truth), F.asc(other)))).where(
        F.col("_pos") <= k)
    return _ndcg_average(dcg_at_levels(by_pred, [by], "_pos", truth, k), dcg_at_levels(by_true, [by], "_pos", truth, k), [by])


def ndcg_topk_lists(truth: DataFrame, lists: DataFrame, k: int, by: str = "i") -> DataFrame:
    """F7. (level, ndcg, dcg) of given top-k lists (by, rank, item) against a
    truth table; duplicate truth cells add up; items < 0 are skipped."""
    other = "j" if by == "i" else "i"
    rel = truth.groupBy(by, other).agg(F.sum("v").alias("rel"))
    lst = lists.where(F.col(other) >= 0)
    lst = lst.withColumn("_pos", F.row_number().over(Window.partitionBy(by).orderBy("rank"))).where(F.col("_pos") <= k)
    lst = lst.join(rel, [by, other], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    ideal = rel.withColumn("_pos", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rel"), F.asc(other)))).where(
        F.col("_pos") <= k)
    groups = rel.select(by).distinct()
    got = dcg_at_levels(lst.join(groups, by, "left_semi"), [by], "_pos", "rel", k)
    # groups whose list is empty still count with dcg 0
    lv = groups.select(by, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("level"))
    got = lv.join(got, [by, "level"], "left").withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))
    return _ndcg_average(got, dcg_at_levels(ideal, [by], "_pos", "rel", k), [by])


# ---------------------------------------------------------------- F8 ranks of positives
#: Marked cells of a row that one query row carries.
CELLS_PER_QUERY = 1024


def _beaten(q: np.ndarray, of: np.ndarray, js: np.ndarray, ss: np.ndarray, c: np.ndarray, ids: np.ndarray, most: float) -> np.ndarray:
    """For marked cells (row ``of`` of ``q`` in order, column id, score): how
    many candidates of a block score higher, or equal with a smaller id."""
    beat = np.zeros(len(js), np.int64)
    norm = np.sqrt(np.square(q).sum(axis=1))
    zero = ~q.any(axis=1)[of]
    beat[zero] = np.searchsorted(np.sort(ids), js[zero])  # all tie
    off = near(q.shape[1])
    columns = np.ascontiguousarray((c / (most or 1.0)).T, np.float32)
    usable = np.isfinite(norm) & (norm * (most or 1.0) > 1e-250) & (norm * (most or 1.0) < 1e250)
    for lo in range(0, len(q), TILE_ROWS):
        hi = min(lo + TILE_ROWS, len(q))
        cells = np.arange(*np.searchsorted(of, (lo, hi)))
        cells = cells[~zero[cells]]
        if not len(cells):
            continue
        if not usable[of[cells]].all():
            row, col = np.repeat(cells, len(ids)), np.tile(np.arange(len(ids)), len(cells))
            score = exact_scores(q, c, of[row], col)
            better = (score > ss[row]) | (score == ss[row]) & (ids[col] < js[row])
            beat[cells] = np.bincount(row - cells[0], better, cells[-1] - cells[0] + 1)[cells - cells[0]]
            continue
        scale = np.where(usable[lo:hi], norm[lo:hi], 1.0)
        scores = (q[lo:hi] / scale[:, None]).astype(np.float32) @ columns
        # rows side by side: one search over all of them
        rows = np.sort(scores, axis=1).astype(float) + 4.0 * np.arange(hi - lo)[:, None]
        own = of[cells] - lo
        want = ss[cells] / (scale[own] * (most or 1.0))
        want = np.clip(np.nan_to_num(want, nan=-1.5), -1.5, 1.5)
        least, most_at = (np.searchsorted(rows.ravel(), want + d + 4.0 * own) for d in (-off, off))
        beat[cells] = (own + 1) * len(ids) - most_at
        unsure = np.flatnonzero(most_at > least)
        for some in np.array_split(unsure, -(-len(unsure) // 256)) if len(unsure) else ():
            at, col = where(np.abs(scores[own[some]] - want[some, None].astype(np.float32)) <= np.float32(1.1 * off))
            cell = cells[some][at]
            score = exact_scores(q, c, of[cell], col)
            better = (score > ss[cell]) | (score == ss[cell]) & (ids[col] < js[cell])
            # those that single precision counted already
            place = scores[of[cell] - lo, col].astype(float) + 4.0 * own[some][at]
            counted = place >= (want[some][at] + off + 4.0 * own[some][at])
            inside = place >= (want[some][at] - off + 4.0 * own[some][at])
            beat[cells[some]] += np.bincount(at, (better & ~counted & inside).astype(np.int64), len(some)).astype(np.int64)
    return beat


def rank_positives(truth: DataFrame, w: DataFrame, h: DataFrame, ignored: DataFrame | None = None,
                   block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """F8. (i, j, rel, rank, nr_pos): for every truth cell with v > 0 that is a
    valid candidate, its 1-based rank among all non-ignored columns of its row
    (score desc, column id asc) and the 1-based count of positives up to it.
    Repeated truth cells are added up first; rows without factors score 0.

    rank = 1 + (#columns beating it) - (#ignored columns beating it). For the
    first term a row is scored once per candidate block and its positives are
    placed by binary search; a row with many positives is cut into query rows
    of ``CELLS_PER_QUERY`` cells. The second is a running count over the row's
    ignored and positive cells only, on range pieces of the rows
    (:mod:`wordfold.operators.grouped`). All scores sum the dimensions in the
    same order, so equal vectors tie exactly."""
    k = width(h)
    cols = h.select(F.col("id").alias("j"))
    pos = truth.groupBy("i", "j").agg(F.sum("v").alias("rel")).where(F.col("rel") > 0).join(cols, "j", "left_semi")
    if ignored is not None:
        ignored = ignored.select("i", "j").distinct()
        pos = pos.join(ignored, ["i", "j"], "left_anti")
    pos = cut_lineage(pos, "positives")
    wv = cut_lineage(row_vectors(pos, w, k), "positive-rows")
    cells = pos.select("i", "j", F.lit(0).alias("is_ign"))
    if ignored is not None:
        cells = cells.unionByName(ignored.join(cols, "j", "left_semi").join(wv.select("i"), "i", "left_semi").select(
            "i", "j", F.lit(1).alias("is_ign")))
    hv = h.select(F.col("id").alias("j"), F.col("vec").alias("hj"))
    scored = cells.join(wv, "i").join(hv, "j").select("i", "j", "is_ign", V.dot("vec", "hj").alias("s"))
    scored = cut_lineage(scored, "positive-scores")
    chunks = pos.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / CELLS_PER_QUERY).alias("chunks"))
    asked = scored.where(F.col("is_ign") == 0).join(chunks, "i").groupBy(
        "i", F.pmod(F.xxhash64("j"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct("j", "s")).alias("c"))
    asked = asked.join(wv, "i").select("i", "vec", F.col("c.j").alias("js"), F.col("c.s").alias("ss"), F.xxhash64("i", "chunk").alias("_deal"))
    blocks = Blocks(h.where(finite("vec")).select(F.col("id").cast("long").alias("id"), "vec"), "id", "vec", block_rows)

    def beaten(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        i, vec, js, ss = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows[c] for c in ("i", "vec", "js", "ss")))
        of = np.repeat(np.arange(len(js)), np.diff(js.offsets.to_numpy()))
        q, j, s = matrix(vec), js.flatten().to_numpy(), ss.flatten().to_numpy()
        beat = np.zeros(len(j), np.int64)
        for b, most in enumerate(blocks.tops):
            ids, c, _ = blocks.read(b)
            beat += _beaten(q, of, j, s, c, ids.to_numpy(), most)
        yield pa.RecordBatch.from_arrays([i.take(pa.array(of)), pa.array(j), pa.array(beat)], ["i", "j", "beat"])

    beat = streamed(asked, "_deal", beaten, "i long, j long, beat long").groupBy("i", "j").agg(F.sum("beat").alias("beat"))
    # range-partitioned running sums: a hot row is split over many tasks
    ev = running_sums_before(scored.withColumn("is_pos", 1 - F.col("is_ign")), ["i"], [F.desc("s"), F.asc("j")],
                             ["is_ign", "is_pos"]).where(F.col("is_ign") == 0)
    out = ev.join(beat, ["i", "j"]).join(pos, ["i", "j"])
    return cut_lineage(out.select("i", "j", "rel", (F.col("beat") - F.col("is_ign_before") + 1).cast("long").alias("rank"),
                                  (F.col("is_pos_before") + 1).cast("long").alias("nr_pos")), "ranks")


# ---------------------------------------------------------------- F9 - F12 from ranks
def row_candidates(truth: DataFrame, h: DataFrame, ignored: DataFrame | None) -> DataFrame:
    """(i, n_cand): non-ignored candidate count of every row that has truth."""
    n_cols = h.count()
    rows = truth.select("i").distinct()
    if ignored is None:
        return rows.withColumn("n_cand", F.lit(n_cols))
    ign = ignored.select("i", "j").distinct().join(h.select(F.col("id").alias("j")), "j", "left_semi").groupBy("i").agg(
        F.count(F.lit(1)).alias("_ni"))
    return rows.join(ign, "i", "left").select("i", (F.lit(n_cols) - F.coalesce("_ni", F.lit(0))).alias("n_cand"))


def half_life(place: F.Column) -> F.Column:
    """The half-life utility's weight of a 1-based place."""
    return F.pow(F.lit(0.5), (place - 1) / (HLU_HALFLIFE - 1.0))


def row_sums(ranks: DataFrame, relevance: F.Column) -> DataFrame:
    """Per row: the number of positives, the sum of their precisions (in
    percent), the (negative, positive) pairs in wrong order, and the half-life
    utility reached and at best."""
    rank, place = F.col("rank"), F.col("nr_pos")
    return ranks.groupBy("i").agg(
        F.count(F.lit(1)).alias("pos"), F.sum(100.0 * place / rank).alias("precisions"), F.sum(rank - place).alias("wrong"),
        F.sum(relevance * half_life(rank)).alias("utility"), F.sum(relevance * half_life(place)).alias("best_utility"))


def per_row_scores(ranks: DataFrame, cand: DataFrame) -> DataFrame:
    """(i, map, auc, hlu) per row from F8 ranks; rows without valid positives
    score 0 (MAP, HLU) and 1 (AUC)."""
    sums = row_sums(ranks, F.col("rel") - HLU_NEUTRAL)
    j = cand.where(F.col("n_cand") > 0).join(sums, "i", "left").na.fill(0)
    pairs = F.col("pos") * (F.col("n_cand") - F.col("pos"))
    return j.select(
        "i",
        F.when(F.col("pos") > 0, F.col("precisions") / F.col("pos")).otherwise(0.0).alias("map"),
        F.when(pairs > 0, (pairs - F.col("wrong")) / pairs).otherwise(1.0).alias("auc"),
        F.when(F.col("best_utility") > 0, 100.0 * F.col("utility") / F.col("best_utility")).otherwise(0.0).alias("hlu"),
    )


def rank_metrics(ranks: DataFrame, cand: DataFrame) -> DataFrame:
    """F9-F11. One row: MAP, AUC (not x100), HLU averaged over rows with candidates."""
    return per_row_scores(ranks, cand).agg(F.avg("map").alias("map"), F.avg("auc").alias("auc"), F.avg("hlu").alias("hlu"))


def ndcg_full(ranks: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """F12. (level, ndcg): DCG of the full candidate ranking (positives at
    their ranks) against the ideal order of the row's truth by relevance."""
    rel = truth.groupBy("i", "j").agg(F.sum("v").alias("rel"))
    got = dcg_at_levels(ranks, ["i"], "rank", "rel", k)
    ideal = rel.withColumn("_pos", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("rel"), F.asc("j")))).where(
        F.col("_pos") <= k)
    ideal = dcg_at_levels(ideal, ["i"], "_pos", "rel", k)
    lv = ideal.select("i", "level")
    got = lv.join(got, ["i", "level"], "left").withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))
    return _ndcg_average(got, ideal, ["i"]).select("level", "ndcg")


def weighted_rank_metrics(ranks: DataFrame, k: int, n_cols: int, ignored: DataFrame | None = None,
                          weight: DataFrame | None = None) -> DataFrame:
    """F13. From (i, j, rank, nr_pos) rows and optional row weights (i, weight):
    weighted MAP, AUC (negatives: columns neither ignored nor positive), HLU
    and NDCG@1..k with unit relevance, each over the rows whose value (NDCG,
    HLU: best value) is positive. Rows (metric, level, value); level is 0
    except for ndcg."""
    rows = row_sums(ranks, F.lit(1.0))
    ignored_cells = ranks.select("i").limit(0).withColumn("n", F.lit(0)) if ignored is None else \
        ignored.select("i", "j").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    weights = ranks.select("i").limit(0).withColumn("weight", F.lit(1.0)) if weight is None else weight.select("i", "weight")
    rows = rows.join(ignored_cells, "i", "left").join(weights, "i", "left").na.fill({"n": 0, "weight": 1.0})
    pairs = F.col("pos") * (n_cols - F.col("n") - F.col("pos"))
    values = {"map": F.col("precisions") / F.col("pos"), "auc": F.when(pairs != 0, 1.0 - F.col("wrong") / pairs),
              "hlu": F.when(F.col("best_utility") > 0, 100.0 * F.col("utility") / F.col("best_utility"))}
    used = {"map": values["map"] > 0, "auc": values["auc"] > 0, "hlu": F.col("best_utility") > 0}
    each = rows.select("i", "weight", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(0).alias("level"), F.when(used[m], v).alias("value")) for m, v in values.items()])).alias("m"))
    each = each.select("weight", "m.*")

    unit = ranks.select("i", "rank", "nr_pos", F.lit(1.0).alias("rel"))
    got = dcg_at_levels(unit, ["i"], "rank", "rel", k)
    best = dcg_at_levels(unit, ["i"], "nr_pos", "rel", k).withColumnRenamed("dcg", "best")
    ndcg = got.join(best, ["i", "level"]).join(rows.select("i", "weight"), "i").select(
        "weight", F.lit("ndcg").alias("metric"), "level", F.when(F.col("best") > 0, 100.0 * F.col("dcg") / F.col("best")).alias("value"))
    both = each.unionByName(ndcg).where(F.col("value").isNotNull())
    averaged = both.groupBy("metric", "level").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))
    # a metric that no row has stays in the result, with null
    names = averaged.sparkSession.createDataFrame([(m, 0) for m in values], "metric string, level int")
    scalars = names.join(averaged, ["metric", "level"], "left")
    return scalars.unionByName(averaged.where(F.col("metric") == "ndcg"))
