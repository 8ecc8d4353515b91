"""Drawn zero cells: rates, counts and no stored cell among them."""

import pytest
from pyspark.sql import functions as F

from wordfold.operators import factor as E


@pytest.fixture(scope="module")
def stored(spark):
    return spark.range(400).select((F.col("id") % 20).alias("i"), (F.col("id") * 7 % 1000).alias("j"), F.lit(1.0).alias("v")).distinct()


def test_every_zero_cell_has_the_rate(spark, stored, monkeypatch):
    monkeypatch.setattr(E, "DRAWS", 64)
    stored = stored.cache()
    nnz = stored.count()
    drawn = E.sample_zero_cells(stored, 20, 1000, 0.1, seed=3).cache()
    n = drawn.count()
    expected = (20_000 - nnz) * 0.1
    assert abs(n - expected) < 6 * (expected * 0.9) ** 0.5
    assert drawn.distinct().count() == n and drawn.join(stored, ["i", "j"]).count() == 0
    seen = drawn.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    assert tuple(seen)[:2] == (0, 19) and 0 <= seen[2] < 100 and 900 < seen[3] < 1000
    per_row = [r["count"] for r in drawn.groupBy("i").count().collect()]
    assert len(per_row) == 20 and min(per_row) > 50 and max(per_row) < 150
    # the same cells however Spark deals the blocks
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, E.sample_zero_cells(stored.repartition(7), 20, 1000, 0.1, seed=3).collect()))
    assert sorted(map(tuple, E.sample_zero_cells(stored, 20, 1000, 0.1, seed=4).collect())) != sorted(map(tuple, drawn.collect()))


def test_rates_at_the_ends(spark, stored):
    assert E.sample_zero_cells(stored, 20, 1000, 1.0).count() == 20_000 - stored.count()
    assert E.sample_zero_cells(stored, 20, 1000, 0.0).count() == 0 == E.sample_zero_cells(stored.limit(0), 0, 5, 0.5).count()
    with pytest.raises(ValueError, match="no probability"):
        E.sample_zero_cells(stored, 20, 1000, 1.5)


def test_a_grid_too_large_to_list(spark, stored):
    """10^14 cells at 10^-11: about a thousand draws, whatever the grid."""
    n = E.sample_zero_cells(stored, 10**7, 10**7, 1e-11, seed=1).count()
    assert abs(n - 1000) < 200


def test_pu0_keeps_a_share_and_draws_the_rest(spark, stored):
    nnz = stored.count()
    rho = 0.05
    found = E.sample_negatives(stored, 20, 1000, "pu0", rho=rho, seed=2)
    share = nnz / (nnz + rho * 20_000)
    kept = found.where("stored").count()
    assert found.where("not stored").count() == round(rho * 20_000 * share)
    assert abs(kept - nnz * share) < 6 * (nnz * share * (1 - share)) ** 0.5
