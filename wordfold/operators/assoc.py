"""Association matrix on COO tables.

Counts stay a long table (row key, column key, value); marginals are
vocabulary-sized and are joined back broadcast when their measured size allows.
Column names are parameters so the same code serves word/context tables and
integer (i, j) tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordfold.operators import lookup
from wordfold.session import cut_lineage, size_bounded_broadcast


def _by_id(values: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Values of the ids 0..n-1 (null without one), written, for lookups."""
    ids = values.sparkSession.range(n).withColumnRenamed("id", "_id")
    return cut_lineage(ids.join(values, F.col("_id") == F.col(key), "left").drop(key), name)


def row_sums(coo: DataFrame, row: str = "word", val: str = "n", out: str = "row_sum") -> DataFrame:
    """C1. Sum of values per row key."""
    return lookup.sums(coo, row, val, out)


def col_sums(coo: DataFrame, col: str = "context", val: str = "n", out: str = "col_sum") -> DataFrame:
    """C1. Sum of values per column key."""
    return lookup.sums(coo, col, val, out)


def smooth_contexts(sums: DataFrame, cds: float = 1.0, val: str = "col_sum", out: str = "col_smooth") -> DataFrame:
    """C2. c' = c ** cds (identity when cds == 1) plus the total S of c' as a column."""
    sm = F.col(val).cast("double") if cds == 1 else F.pow(F.col(val).cast("double"), F.lit(float(cds)))
    s = sums.withColumn(out, sm)
    total = s.agg(F.sum(out).alias("smooth_total"))
    return s.crossJoin(F.broadcast(total))


def exp_pmi(
    counts: DataFrame, cds: float = 1.0, row: str = "word", col: str = "context", val: str = "n",
    max_rows: int | None = None, max_cols: int | None = None, dense: int | None = None,
) -> DataFrame:
    """C3. Adds ``epmi`` = n * S / (row_sum * col_sum**cds) for every stored cell.

    ``max_rows`` / ``max_cols`` are known upper bounds of the marginal sizes
    (e.g. the vocabulary size); without them the marginals are counted. With
    ``dense`` both keys are ids below it, whose marginals are looked up in
    place, so the cells are not shuffled; where it is named
    (:class:`lookup.Named`) cells get their words in the same pass."""
    if dense is not None:
        rs = _by_id(row_sums(counts, row, val), row, dense, "row-sums")
        sums = cut_lineage(col_sums(counts, col, val), "col-sums")
        cs = _by_id(smooth_contexts(sums, cds).select(col, "col_smooth", "smooth_total"), col, dense, "smooth-contexts")
        counts = counts if counts.columns == [row, col, val] else counts.select(row, col, val)
        named = lookup.words_of(dense, row, col)
        cells = lookup.attach(counts, [(row, rs, "_id", {"row_sum": "row_sum"}), (col, cs, "_id", {c: c for c in ("col_smooth", "smooth_total")}), *named])
        if lookup.is_packed(cells):
            kept = [cells.columns.index(c) for c in (row, col, val, *(["_word", "_context"] if named else []))]
            used = [cells.columns.index(c) for c in (val, "smooth_total", "row_sum", "col_smooth")]

            def epmi(batch: pa.RecordBatch) -> list:
                n, total, rows, smooth = (batch.column(c).to_numpy() for c in used)
                return [*(batch.column(c) for c in kept), pa.array(n * total / (rows * smooth))]

            return lookup.computed(cells, [*(cells.schema.fields[c] for c in kept), T.StructField("epmi", T.DoubleType())], epmi)
        return cells.select(row, col, val, *(["_word", "_context"] if named else []), (F.col(val) * F.col("smooth_total") / (F.col("row_sum") * F.col("col_smooth"))).alias("epmi"))
    rs = size_bounded_broadcast(row_sums(counts, row, val), known_rows=max_rows)
    cs = smooth_contexts(col_sums(counts, col, val), cds)
    cs = size_bounded_broadcast(cs.select(col, "col_smooth", "smooth_total"), known_rows=max_cols)
    return counts.join(rs, row).join(cs, col).select(
        row,
        col,
        val,
        (F.col(val) * F.col("smooth_total") / (F.col("row_sum") * F.col("col_smooth"))).alias("epmi"),
    )


def pmi(assoc: DataFrame) -> DataFrame:
    """C4. ln(epmi) on stored cells."""
    return assoc.withColumn("pmi", F.log(F.col("epmi")))


def logs(assoc: DataFrame) -> DataFrame:
    """C4 as cells ``word, context, v``."""
    if not lookup.is_packed(assoc):
        return assoc.select("word", "context", F.log("epmi").alias("v"))
    word, context, at = (assoc.columns.index(c) for c in ("word", "context", "epmi"))
    return lookup.computed(assoc, [assoc.schema["word"], assoc.schema["context"], T.StructField("v", T.DoubleType())],
                           lambda batch: [batch.column(word), batch.column(context), pa.array(np.log(batch.column(at).to_numpy()))])


def ppmi(assoc: DataFrame) -> DataFrame:
    """C5. Cells with pmi > 0 (the PPMI matrix)."""
    return pmi(assoc).where(F.col("epmi") > 1.0)


def ppmi_counts(assoc: DataFrame, val: str = "n") -> DataFrame:
    """C6. The counts of exactly the PPMI cells (same row, same predicate)."""
    return assoc.where(F.col("epmi") > 1.0).drop("epmi")


def shifted_ppmi(assoc: DataFrame, neg: float = 1.0) -> DataFrame:
    """C7. max(ln(epmi) - ln(neg), 0), stored only where positive."""
    if lookup.is_packed(assoc):
        at, less = assoc.columns.index("epmi"), math.log(neg)

        def above(batch: pa.RecordBatch) -> list:
            spmi = np.log(batch.column(at).to_numpy()) - less
            some = pa.array(spmi > 0)
            return [*(x.filter(some) for x in batch.columns), pa.array(spmi[spmi > 0])]

        return lookup.computed(assoc, [*assoc.schema.fields, T.StructField("spmi", T.DoubleType())], above)
    shifted = F.log(F.col("epmi")) - F.lit(math.log(neg))
    return assoc.withColumn("spmi", shifted).where(F.col("spmi") > 0)


def scale_rows(coo: DataFrame, coefs: DataFrame, row: str = "i", val: str = "v", coef: str = "coef", dense: int | None = None) -> DataFrame:
    """C8. Multiply each row by its coefficient; rows without one drop (x0).
    With ``dense`` rows are ids below it and the coefficients are looked up,
    and where it is named (:class:`lookup.Named`) the words of the cells
    ``word, context``."""
    if dense is not None:
        cells = lookup.attach(coo, [(row, _by_id(coefs.select(row, coef), row, dense, "coefs"), "_id", {coef: coef}), *lookup.words_of(dense, "word", "context")])
        return cells.where(F.col(coef).isNotNull()).withColumn(val, F.col(val) * F.col(coef)).drop(coef)
    c = size_bounded_broadcast(coefs.select(row, coef))
    return coo.join(c, row).withColumn(val, F.col(val) * F.col(coef)).drop(coef)


def scale_cols(coo: DataFrame, coefs: DataFrame, col: str = "j", val: str = "v", coef: str = "coef", dense: int | None = None) -> DataFrame:
    """C8. Multiply each column by its coefficient."""
    return scale_rows(coo, coefs, col, val, coef, dense)


def l2_normalize_rows(coo: DataFrame, row: str = "i", val: str = "v", max_rows: int | None = None, dense: int | None = None) -> DataFrame:
    """C9. Divide every row by its L2 norm; empty rows stay empty.

    The norms table has one row per row key: with a known bound (e.g. the
    vocabulary size) it is broadcast when under the limit; without one the
    join is left to AQE, which switches to a broadcast from the measured
    shuffle size (no extra counting pass over the matrix). With ``dense`` rows
    are ids below it and their norms are looked up in place, and where it is
    named (:class:`lookup.Named`) the words of the cells ``word, context``."""
    norms = lookup.sums(coo, row, val, "_norm", squares=True).withColumn("_norm", F.sqrt("_norm"))
    if dense is not None:
        coo = lookup.attach(coo, [(row, _by_id(norms, row, dense, "norms"), "_id", {"_norm": "_norm"}), *lookup.words_of(dense, "word", "context")])
        if lookup.is_packed(coo):
            at, by = coo.columns.index(val), coo.columns.index("_norm")

            def unit(batch: pa.RecordBatch) -> list:
                v, norm = batch.column(at).to_numpy(), batch.column(by).to_numpy()
                shares = pa.array(np.divide(v, norm, out=np.zeros(len(v)), where=norm > 0))
                return [shares if c == at else x for c, x in enumerate(batch.columns) if c != by]

            return lookup.computed(coo, [f for f in coo.schema.fields if f.name != "_norm"], unit)
        return coo.withColumn(val, F.when(F.col("_norm") > 0, F.col(val) / F.col("_norm")).otherwise(F.lit(0.0))).drop("_norm")
    if max_rows is not None:
        norms = size_bounded_broadcast(norms, known_rows=max_rows)
    return coo.join(norms, row).withColumn(
        val, F.when(F.col("_norm") > 0, F.col(val) / F.col("_norm")).otherwise(F.lit(0.0))).drop("_norm")


def matrix_meta(coo: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None,
                row: str = "i", col: str = "j") -> DataFrame:
    """C10. One row (n_rows, n_cols, nnz). Dimensions come from the vocabularies
    when given, else from the distinct keys present."""
    stats = coo.agg(
        F.count(F.lit(1)).alias("nnz"),
        F.countDistinct(row).alias("_r"),
        F.countDistinct(col).alias("_c"),
    )
    n_rows = rows.agg(F.count(F.lit(1)).alias("n_rows")) if rows is not None else stats.select(F.col("_r").alias("n_rows"))
    n_cols = cols.agg(F.count(F.lit(1)).alias("n_cols")) if cols is not None else stats.select(F.col("_c").alias("n_cols"))
    return n_rows.crossJoin(n_cols).crossJoin(stats.select("nnz"))
