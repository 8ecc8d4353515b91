"""Sparse-matrix algebra on COO tables.

A sparse matrix is a DataFrame (i long, j long, v double); a dense factor matrix
is (id long, vec array<double>), one row per id. Products are joins plus
aggregates; k x k results (Gram matrices) are reduced in two levels so that no
single task or the driver sees more than a few k x k partials.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordfold.functions.rand import keyed_hash32, lit_key
from wordfold.session import cut_lineage, size_bounded_broadcast


def transpose(coo: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """D1. Swap row and column keys."""
    rest = [c for c in coo.columns if c not in (i, j)]
    return coo.select(F.col(j).alias(i), F.col(i).alias(j), *rest)


def nnz_by_row(coo: DataFrame, key: str = "i") -> DataFrame:
    """D2. (key, nnz) entry count per row (or per column with key='j')."""
    return coo.groupBy(key).agg(F.count(F.lit(1)).alias("nnz"))


def max_nnz(coo: DataFrame, key: str = "i") -> DataFrame:
    """D2. One row: the largest row (column) entry count."""
    return nnz_by_row(coo, key).agg(F.max("nnz").alias("max_nnz"))


def dense_ids(df: DataFrame, order_cols: list, id_col: str = "id") -> DataFrame:
    """0-based consecutive ids in the order of ``order_cols`` without a
    single-partition window: range-partitioned sort, then per-partition
    offsets from one small row per partition."""
    srt = df.orderBy(*order_cols)
    # written, not cached: a lost cache block would be cut and numbered anew
    srt = cut_lineage(srt.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "ids")
    sizes = srt.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_m0"))
    offs = sizes.select("_p", "_m0", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_off"))
    return srt.join(F.broadcast(offs), "_p").withColumn(id_col, F.col("_off") + F.col("_m") - F.col("_m0")).drop(
        "_p", "_m", "_m0", "_off"
    )


def row_subset(coo: DataFrame, ids: DataFrame, key: str = "i", remap: bool = False) -> DataFrame:
    """D3. Keep rows (key='i') or columns (key='j') listed in ``ids`` (column ``id``).
    With ``remap`` the kept keys become 0..n-1 in sorted order of the subset."""
    sel = ids.select(F.col("id").alias(key)).distinct()
    kept = coo.join(size_bounded_broadcast(sel), key, "left_semi")
    if not remap:
        return kept
    new = dense_ids(sel, [key], "_new")
    return kept.join(size_bounded_broadcast(new), key).drop(key).withColumnRenamed("_new", key).select(*coo.columns)


def global_mean(coo: DataFrame, val: str = "v") -> DataFrame:
    """D4. One row: mean of stored values."""
    return coo.agg(F.avg(val).alias("mean"))


def remove_bias(coo: DataFrame, bias, val: str = "v") -> DataFrame:
    """D5. Subtract a scalar (or a one-row frame's ``mean``) from stored values."""
    if isinstance(bias, DataFrame):
        return coo.crossJoin(F.broadcast(bias.select(F.col("mean").alias("_b")))).withColumn(
            val, F.col(val) - F.col("_b")
        ).drop("_b")
    return coo.withColumn(val, F.col(val) - F.lit(float(bias)))


def spmv(coo: DataFrame, x: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """D6. y = X x with x as (id, x). Rows listed in ``rows`` (column id) but
    without entries get 0."""
    xv = size_bounded_broadcast(x.select(F.col("id").alias("j"), F.col("x")))
    y = coo.join(xv, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    if rows is not None:
        y = rows.select(F.col("id").alias("i")).join(y, "i", "left").select("i", F.coalesce("y", F.lit(0.0)).alias("y"))
    return y


def spmv_t(coo: DataFrame, u: DataFrame, cols: DataFrame | None = None) -> DataFrame:
    """D7. y = X^T u."""
    return spmv(transpose(coo), u, cols).withColumnRenamed("i", "j")


#: Bytes of row sums that a task gathers before it sends them on.
SUM_BYTES = 32 << 20

ROW_SUMS = "i long, vec array<double>"


def _row_sums(scaled: bool):
    """Batches ``i, vec`` (``scaled``: and ``v``) to sums of ``v * vec`` by
    ``i``: rows of a batch by sorted segments, batches in memory until they
    fill ``SUM_BYTES``. So a row that many tasks hold leaves each but once a
    fill."""
    schema = pa.schema([("i", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def by_row(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return ids[starts], np.add.reduceat(x[order], starts, axis=0)

    def sent(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        stops = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1])
        return pa.record_batch([pa.array(ids), pa.ListArray.from_arrays(stops, pa.array(x.ravel()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            x = x * batch.column(2).to_numpy()[:, None] if scaled else x
            held.append(by_row(batch.column(0).to_numpy(), x))
            size += held[-1][1].nbytes
            if size > SUM_BYTES:
                held = [by_row(*(np.concatenate(y) for y in zip(*held, strict=True)))]
                size = held[0][1].nbytes
                if size > SUM_BYTES // 2:
                    yield sent(*held[0])
                    held, size = [], 0
        if held:
            yield sent(*by_row(*(np.concatenate(y) for y in zip(*held, strict=True))))

    return run


def spmm(coo: DataFrame, factors: DataFrame, a: float = 1.0, h0: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """D8. (i, vec) = a * X W (+ H0). W is (id, vec) keyed by column id. Rows
    listed in ``rows`` (column id) but without entries get zeros.

    Entries meet their vectors (broadcast when small, measured) and are summed
    by row inside their task, a vector at a time; one vector per row and task
    is shuffled and summed again. A hot row so sends a vector per task."""
    f = size_bounded_broadcast(factors.select(F.col("id").alias("j"), F.col("vec")))
    met = coo.join(f, "j").select(F.col("i").cast("long").alias("i"), "vec", (F.col("v") * F.lit(float(a))).alias("v"))
    parts = met.mapInArrow(_row_sums(True), ROW_SUMS)
    if h0 is not None:
        parts = parts.unionByName(h0.select(F.col("id").cast("long").alias("i"), "vec"))
    width = factors.select(F.size("vec").alias("k")).first()
    k = width["k"] if width else 0
    out = parts.groupBy("i").agg(F.array(*[F.sum(F.get("vec", F.lit(t))) for t in range(k)]).alias("vec"))
    if rows is not None:
        zeros = F.array_repeat(F.lit(0.0), k)
        out = rows.select(F.col("id").alias("i")).distinct().join(out, "i", "left").select("i", F.coalesce("vec", zeros).alias("vec"))
    return out


def _partial_gram(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((k, k))
        seen = False
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_numpy())
                y = np.stack(b["vec2"].to_numpy())
                acc += x.T @ y
                seen = True
        if seen:
            yield pd.DataFrame({"g": [acc.ravel()]})

    return run


def _sum_partials(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(k * k)
        seen = False
        for b in batches:
            for g in b["g"]:
                acc += np.asarray(g)
                seen = True
        if seen:
            yield pd.DataFrame({"g": [acc]})

    return run


def gram_matrix(a: DataFrame, b: DataFrame | None = None, k: int | None = None) -> np.ndarray:
    """D9. A^T B (k x k numpy) for factor tables keyed by id (B defaults to A).

    Level 1: one k*k partial per partition (numpy in ``mapInPandas``).
    Level 2: the partials are spread over ~sqrt(#partitions) tasks and summed
    there, so the driver receives only a handful of k*k arrays."""
    if k is None:
        k = len(a.select("vec").first()[0])
    if b is None:
        pairs = a.select("vec", F.col("vec").alias("vec2"))
    else:
        pairs = a.select("id", "vec").join(b.select("id", F.col("vec").alias("vec2")), "id").select("vec", "vec2")
    schema = T.StructType([T.StructField("g", T.ArrayType(T.DoubleType()))])
    partials = pairs.mapInPandas(_partial_gram(k), schema)
    n_part = max(1, int(np.sqrt(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    summed = partials.repartition(n_part).mapInPandas(_sum_partials(k), schema)
    total = np.zeros(k * k)
    for row in summed.collect():
        total += np.asarray(row["g"])
    return total.reshape(k, k)


def gram_table(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """D9 as a table (t1, t2, g) = sum over ids of a[t1] * b[t2] (SQL-checkable form).

    Every id contributes k*k products that are partial-aggregated per task."""
    b = a if b is None else b
    x = a.select("id", F.posexplode("vec").alias("t1", "x"))
    y = b.select("id", F.posexplode("vec").alias("t2", "y"))
    return x.join(y, "id").groupBy("t1", "t2").agg(F.sum(F.col("x") * F.col("y")).alias("g"))


def factor_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """D10. (id, dot) = <a_id, b_id> for ids on both sides."""
    from wordfold.functions.vec import dot

    return a.select("id", F.col("vec").alias("va")).join(b.select("id", F.col("vec").alias("vb")), "id").select(
        "id", dot("va", "vb").alias("dot")
    )


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """D10. (id, vec) = a * x + y; ids on one side only keep a*x or y."""
    from wordfold.functions.vec import scale

    j = x.select("id", F.col("vec").alias("vx")).join(y.select("id", F.col("vec").alias("vy")), "id", "full")
    return j.select(
        "id",
        F.when(F.col("vx").isNull(), F.col("vy"))
        .when(F.col("vy").isNull(), scale("vx", a))
        .otherwise(F.zip_with("vx", "vy", lambda p, q: p * a + q))
        .alias("vec"),
    )


def shuffle_ids(ids: DataFrame, seed: int = 0, key: str = "id") -> DataFrame:
    """D11. Seeded permutation (id, new_id); the inverse is the swapped columns."""
    h = ids.select(F.col(key).alias("id")).distinct().withColumn("_h", keyed_hash32(lit_key("perm"), lit_key(seed), "id"))
    return dense_ids(h, ["_h", "id"], "new_id").select("id", "new_id")


def apply_permutation(coo: DataFrame, row_perm: DataFrame | None, col_perm: DataFrame | None) -> DataFrame:
    """D11. Rename ids of a COO table through (id, new_id) maps."""
    out = coo
    if row_perm is not None:
        out = out.join(row_perm.select(F.col("id").alias("i"), F.col("new_id").alias("_ni")), "i").drop("i").withColumnRenamed("_ni", "i")
    if col_perm is not None:
        out = out.join(col_perm.select(F.col("id").alias("j"), F.col("new_id").alias("_nj")), "j").drop("j").withColumnRenamed("_nj", "j")
    return out.select(*coo.columns)
