"""Ordered running sums inside groups without one task per group.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task; a
hot group (a user or word holding a large share of all rows) then runs
serially. Here the rows are range-partitioned on ``(g, o)`` instead, so a hot
group is cut into contiguous pieces on many tasks. Each piece computes its
local running sums; a small table with one row per (piece, group) gives the
sum of the group's earlier pieces, which is added back. The result equals the
single-window answer for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordfold.session import cut_lineage


def running_sums_before(df: DataFrame, group: list[str], order: list[Column], cols: list[str],
                        parts: int | None = None) -> DataFrame:
    """Adds ``<c>_before`` for each ``c`` in ``cols``: the sum of ``c`` over the
    rows of the same group strictly before this row in ``order`` (which must be
    a total order inside each group); 0 for the first row."""
    spark = df.sparkSession
    n = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # piece ids are written once, so every consumer sees the same cut
    base = cut_lineage(
        df.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("_piece", F.spark_partition_id()),
        "ranged")
    local = Window.partitionBy("_piece", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    with_local = base.select(
        "*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"_l_{c}") for c in cols])
    totals = base.groupBy("_piece", *group).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_piece", *group, *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in cols])
    out = with_local.join(offsets, ["_piece", *group])
    return out.select(*df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in cols])
