"""Evaluation (H1-H7): word-similarity correlation and analogies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordfold.operators.blocks import DEFAULT_BLOCK_ROWS, Blocks, block_scores, exact_scores, matrix, streamed, where
from wordfold.operators.corpus import assign_ids
from wordfold.operators.grouped import running_sums_before
from wordfold.operators.vectors import _dim, normalize_vectors, represent, similarity


def with_avg_rank(df: DataFrame, col: str, out: str, group: list | None = None) -> DataFrame:
    """Adds ``out``: the 1-based rank of ``col`` (ascending, per group) with
    ties sharing the average of their ranks.

    Ranks come from value multiplicities: rank = (#rows below the value) +
    (multiplicity + 1) / 2, where the running count runs on range pieces of the
    distinct values, so neither a large group nor an ungrouped set is ranked
    by one task."""
    part = group or []
    vals = df.groupBy(*part, col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums_before(vals, part, [F.asc(col)], ["_c"]).select(
        *[F.col(g).alias(f"_k_{g}") for g in (*part, col)], (F.col("_c_before") + (F.col("_c") + 1) / 2.0).alias(out))
    cond = [df[g].eqNullSafe(ranked[f"_k_{g}"]) for g in (*part, col)]
    return df.join(ranked, cond).drop(*[f"_k_{g}" for g in (*part, col)])


def spearman(df: DataFrame, x: str = "sim", y: str = "gold", group: list | None = None) -> DataFrame:
    """H1. Spearman correlation per group: Pearson correlation of tie-averaged ranks."""
    group = group or []
    base = df.select(*group, x, y)
    ranked = with_avg_rank(with_avg_rank(base, x, "_rx", group), y, "_ry", group)
    if group:
        return ranked.groupBy(*group).agg(F.corr("_rx", "_ry").alias("spearman"))
    return ranked.agg(F.corr("_rx", "_ry").alias("spearman"))


def wordsim_eval(vecs: DataFrame, test: DataFrame, group: list | None = None) -> DataFrame:
    """H2. Similarity of every test pair (unknown words score 0), then Spearman."""
    return spearman(similarity(test, vecs), "sim", "gold", group)


def test_vocab(test: DataFrame) -> DataFrame:
    """H3. Sorted distinct words of an analogy set with 0-based ids."""
    words = test.select(F.explode(F.array("a", "a_", "b", "b_")).alias("word")).distinct()
    return assign_ids(words, "word", "id")


#: Scores of questions against a block that are held at once: a cache full.
QUESTION_SCORES = 1 << 18
#: Rows of a block at most.
QUESTION_ROWS = 1 << 15
#: How far single-precision scores of unit vectors may be off, for each method:
#: what comes so near the best is scored again.
NEAR_ADD, NEAR_MUL = 1e-4, 2e-3


METHODS = ("add", "mul")


def _best_words(asked: list[np.ndarray], hide: np.ndarray, vecs: np.ndarray, dense: bool, methods: tuple[str, ...],
                least: dict[str, np.ndarray] | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(method, question, row of ``vecs``, score) of the best row for every
    question, the first one of equals, less those below ``least`` so far;
    ``asked`` are the vectors of a, a_ and b, ``hide`` the rows that stand for
    these (or -1)."""
    half = (lambda x: (x + 1.0) / 2.0) if dense else (lambda x: x)
    # single precision finds what is near the best of unit vectors; others are scored exactly throughout
    unit = dense and all(np.square(x).sum(axis=1).max() <= 1.0 + 1e-6 for x in (vecs, *asked))
    columns, singles = np.ascontiguousarray(vecs.T, np.float32), [x.astype(np.float32) for x in asked]
    added = (asked[1] + asked[2] - asked[0]).astype(np.float32) / np.float32(2)
    step = max(1, QUESTION_SCORES // len(vecs))
    for lo in range(0, len(asked[0]), step):
        some = slice(lo, lo + step)
        parts = [half(x[some] @ columns) if unit else half(block_scores(y[some], vecs))
                 for x, y in zip(singles, asked, strict=True)] if not unit or "mul" in methods else None
        which, hidden = np.nonzero(hide[:, some].T >= 0)[0], hide[:, some].T
        hidden = hidden[hidden >= 0]
        for name in methods:
            if name == "add":
                total = added[some] @ columns + np.float32(0.5) if unit else -parts[0] + parts[1] + parts[2]
            else:
                total = parts[1] * parts[2] / (parts[0] + (np.float32(0.01) if unit else 0.01))
            total[which, hidden] = -np.inf
            best = total.max(axis=1)
            best = best if least is None else np.maximum(best, least[name][some])
            near = (NEAR_ADD if name == "add" else NEAR_MUL * (1 + np.abs(best))) if unit else 0.0
            row, col = where(total >= (best - near)[:, None])
            good = np.isfinite(total[row, col])
            row, col = row[good], col[good]
            if unit:
                x, x_, y = (half(exact_scores(z[some], vecs, row, col)) for z in asked)
                score = -x + x_ + y if name == "add" else x_ * y / (x + 0.01)
            else:
                score = total[row, col]
            order = np.lexsort((col, -score, row))
            first = order[np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]][:len(order)])]
            yield name, lo + row[first], col[first], score[first]


def _analogy_kernel(dense: bool, methods: tuple[str, ...] = METHODS):
    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = {"qid": [np.zeros(0, np.int64)], "method": [np.zeros(0, object)], "word": [np.zeros(0, object)], "score": [np.zeros(0)]}
        if len(q) and len(c):
            c = c.sort_values("word")  # the first best is the smallest word
            words = c["word"].to_numpy().astype(object)
            place = {w: n for n, w in enumerate(words)}
            hide = np.array([[place.get(w, -1) for w in q[x]] for x in ("a", "a_", "b")])
            asked = [np.stack(q[x].to_numpy()).astype(float) for x in ("va", "va_", "vb")]
            qid = q["qid"].to_numpy().astype(np.int64)
            for name, row, col, score in _best_words(asked, hide, np.stack(c["vec"].to_numpy()).astype(float), dense, methods):
                found["qid"].append(qid[row])
                found["method"].append(np.full(len(row), name, object))
                found["word"].append(words[col])
                found["score"].append(score)
        return pd.DataFrame({k: np.concatenate(v) for k, v in found.items()})

    return kernel


def _guessed(blocks: Blocks, dense: bool, methods: tuple[str, ...]):
    """Questions ``qid, a, a_, b, va, va_, vb`` meet the blocks of words in
    turn and keep the best one so far."""

    def run(questions: pa.Table) -> Iterator[pa.RecordBatch]:
        one = {c: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for c, x in zip(questions.column_names, questions.columns, strict=True)}
        asked, names = [matrix(one[c]) for c in ("va", "va_", "vb")], [one[c].to_pylist() for c in ("a", "a_", "b")]
        score = {m: np.full(len(questions), -np.inf) for m in methods}
        guess = {m: np.full(len(questions), None, object) for m in methods}
        for b in range(len(blocks.tops)):
            words, vecs, _ = blocks.read(b)
            words = np.array(words.to_pylist(), object)
            order = np.argsort(words, kind="stable")  # the first best is the smallest word
            words, vecs = words[order], vecs[order]
            place = {w: n for n, w in enumerate(words)}
            hide = np.array([[place.get(w, -1) for w in x] for x in names])
            for m, row, col, found in _best_words(asked, hide, vecs, dense, methods, score):
                word = words[col]
                new = (found > score[m][row]) | (found == score[m][row]) & (word < np.where(guess[m][row] == None, "", guess[m][row]))  # noqa: E711
                score[m][row[new]], guess[m][row[new]] = found[new], word[new]
        for m in methods:
            have = np.flatnonzero(score[m] > -np.inf)
            yield pa.RecordBatch.from_arrays([one["qid"].take(pa.array(have)), pa.array([m] * len(have), pa.string()), pa.array(guess[m][have].tolist(), pa.string()), pa.array(score[m][have])],
                                             ["qid", "method", "word", "score"])

    return run


def _question_rows(test: DataFrame, vecs: DataFrame) -> int:
    """Rows of a block: as many blocks as keep the cores busy, no more, for
    each side is sent once to every block of the other."""
    cores = test.sparkSession.sparkContext.defaultParallelism
    rows = max(test.count(), vecs.count())
    return min(QUESTION_ROWS, max(256, -(-rows // math.ceil(math.sqrt(4 * cores)))))


def analogy_guesses(test: DataFrame, vecs: DataFrame, dense: bool = True,
                    block_rows: int | None = None, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """H5/H6. (qid, method, guess): argmax of -s(a)+s(a_)+s(b) ('add') and of
    s(a_)*s(b)/(s(a)+0.01) ('mul') over the vocabulary, question words excluded,
    ties to the smaller word. Unknown question words use the zero vector. Each
    task's questions meet the written blocks of words in turn."""
    k = _dim(vecs)

    def vec_of(col: str, out: str) -> DataFrame:
        return represent(test.select(F.col(col).alias("word")).distinct(), vecs, k).select(
            F.col("word").alias(col), F.col("vec").alias(out))

    q = (test.select("qid", "a", "a_", "b")
         .join(vec_of("a", "va"), "a", "left").join(vec_of("a_", "va_"), "a_", "left").join(vec_of("b", "vb"), "b", "left"))
    blocks = Blocks(vecs.where(F.col("vec").isNotNull()), "word", "vec", block_rows or min(DEFAULT_BLOCK_ROWS, _question_rows(test, vecs)))
    local = streamed(q, "qid", _guessed(blocks, dense, methods), "qid long, method string, word string, score double")
    w = Window.partitionBy("qid", "method").orderBy(F.desc("score"), F.asc("word"))
    return local.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        "qid", "method", F.col("word").alias("guess"))


def analogy_accuracy(test: DataFrame, vecs: DataFrame, dense: bool = True) -> DataFrame:
    """H7. (method, accuracy): share of questions answered with b_; the
    denominator is every question."""
    g = analogy_guesses(test, vecs, dense)
    allq = test.select("qid", "b_", F.explode(F.array(F.lit("add"), F.lit("mul"))).alias("method"))
    return allq.join(g, ["qid", "method"], "left").groupBy("method").agg(
        F.avg(F.when(F.col("guess") == F.col("b_"), 1.0).otherwise(0.0)).alias("accuracy"))


def evaluation_catalog(models: DataFrame, tasks: DataFrame) -> DataFrame:
    """A16. (model, task, spearman) for every saved model against every task
    in one grouped job. ``models``: (model, word, vec) normalized vectors;
    ``tasks``: (task, w1, w2, gold). Unknown words score 0."""
    # every task row for every model: both sides of the equality are constant
    pairs = tasks.withColumn("_one", F.lit(1)).join(models.select("model", F.lit(1).alias("_one")).distinct(), "_one").drop("_one")
    va = models.select("model", F.col("word").alias("w1"), F.col("vec").alias("_a"))
    vb = models.select("model", F.col("word").alias("w2"), F.col("vec").alias("_b"))
    from wordfold.functions.vec import dot

    sims = pairs.join(va, ["model", "w1"], "left").join(vb, ["model", "w2"], "left").withColumn(
        "sim", F.coalesce(dot("_a", "_b"), F.lit(0.0)))
    return spearman(sims, "sim", "gold", ["model", "task"])


def read_snapshots(spark, path: str, side: str = "W", iterations: list[int] | None = None) -> DataFrame:
    """A16 source: factor snapshots written as side=S/iter=N -> (model, id,
    vec). Side and iterations prune the folders that are read."""
    df = spark.read.parquet(path).where(F.col("side") == side)
    if iterations is not None:
        df = df.where(F.col("iter").isin(iterations))
    return df.select(F.concat(F.lit("iter"), F.col("iter").cast("string")).alias("model"), "id", "vec")


def snapshot_models(spark, path: str, words: DataFrame, side: str = "W", iterations: list[int] | None = None) -> DataFrame:
    """Saved factors as models (model, word, vec) with unit vectors;
    ``words`` is (id, word), ids without a word drop."""
    return normalize_vectors(read_snapshots(spark, path, side, iterations).join(words, "id").select("model", "word", "vec"))
