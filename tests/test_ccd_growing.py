from pyspark.sql import functions as F

from wordfold.plans.train import TrainParams, train_ccd


def test_growing_trains_all_ranks(spark):
    cells = [(i, j, float((i * 7 + j * 3) % 5)) for i in range(6) for j in range(5)]
    coo = spark.createDataFrame(cells, "i long, j long, v double")
    res = train_ccd(coo, TrainParams(k=3, iters=1, inner=1, lam=0.01), growing=True)
    assert [h["active"] for h in res.history] == [1, 2, 3]
    sizes = res.h.select(*[F.sum(F.abs(F.get("vec", F.lit(t)))).alias(str(t)) for t in range(3)]).first()
    assert all(x > 0 for x in sizes)
