import pytest
from pyspark.sql import functions as F

from stagewise.functions.ratios import change, direction, share


def one(spark, expr, **values):
    schema = ", ".join(f"{k} double" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("part, whole, want", [
    (0.0, 0.0, None), (5.0, 0.0, None), (0.0, 10.0, 0.0), (1.0, 3.0, 33.33), (1.0, 8.0, 12.5),
    (None, 4.0, None), (2.0, 1.0, 200.0), (-1.0, 3.0, -33.33)])
def test_share(spark, part, whole, want):
    assert one(spark, share(F.col("a"), F.col("b")), a=part, b=whole) == want


@pytest.mark.parametrize("now, base, want", [
    (0.0, 10.0, -100.0), (10.0, 0.0, None), (10.0, None, None), (None, 10.0, None),
    (41.67, 60.0, -30.6), (12.0, 12.0, 0.0), (80.1, 100.0, -19.9)])
def test_change(spark, now, base, want):
    assert one(spark, change(F.col("a"), F.col("b")), a=now, b=base) == want


@pytest.mark.parametrize("pct, want", [(None, "unknown"), (0.0, "flat"), (0.1, "up"), (-3.0, "down")])
def test_direction(spark, pct, want):
    assert one(spark, direction(F.col("a")), a=pct) == want
