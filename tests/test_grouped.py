"""Range-piece running sums equal the single-window answer."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordfold.operators.grouped import running_sums_before


def test_running_sums_hot_group_split(spark):
    # group 0 holds most rows, so range pieces cut it many times
    rows = [(0 if r % 5 else r % 3, r, float((r * 37) % 11), r % 2) for r in range(400)]
    df = spark.createDataFrame(rows, "g long, j long, s double, x long")
    got = running_sums_before(df, ["g"], [F.desc("s"), F.asc("j")], ["x"], parts=16)
    w = Window.partitionBy("g").orderBy(F.desc("s"), F.asc("j")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("x_before", F.coalesce(F.sum("x").over(w), F.lit(0)))
    assert got.count() == 400
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
