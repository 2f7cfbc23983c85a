import math

import pytest
from pyspark.sql import functions as F

import gridfold as g

NAN = math.nan


def frame(spark):
    values, labels = [1.0, NAN, 3, 4, NAN, 6, 7, NAN], [0, 0, 0, 1, 1, 1, None, None]
    return spark.createDataFrame([(i, float(v), b) for i, (v, b) in enumerate(zip(values, labels, strict=True))], "i long, v double, b int").repartition(3)


def scan(df, **how):
    return [r["out"] for r in g.group_scan(df, "v", "b", order="i", name="out", **how).orderBy("i").collect()]


@pytest.mark.parametrize("partitioned", [False, True])
def test_scans(spark, partitioned):
    df = frame(spark)
    assert scan(df, func="ffill", partitioned=partitioned) == [1, 1, 3, 4, 4, 6, 7, 7]
    assert scan(df, func="bfill", partitioned=partitioned) == [1, 3, 3, 4, 6, 6, 7, None]
    assert scan(df, func="nancumsum", partitioned=partitioned) == [1, 1, 4, 4, 4, 10, 7, 7]
    assert scan(df, func="cumsum", partitioned=partitioned) == [1, None, None, 4, None, None, 7, None]


def test_one_group_over_many_ranges(spark):
    df = spark.range(5000).select(F.col("id").alias("i"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v"), F.lit(1).alias("b"))
    for func in ("cumsum", "nancumsum", "ffill", "bfill"):
        assert scan(df, func=func) == scan(df, func=func, partitioned=True)


def test_custom_and_bad_scans(spark):
    df = frame(spark)
    assert scan(df, func=g.GroupScan("n", lambda m, w: F.count(m.valid).over(w))) == [1, 1, 2, 1, 1, 2, 1, 1]
    assert scan(df, func=g.PandasScan("n", lambda s: s.notna().cumsum().astype(float))) == [1, 1, 2, 1, 1, 2, 1, 1]
    with pytest.raises(ValueError):
        scan(df, func="cumprod")


@pytest.mark.parametrize("partitioned", [False, True])
def test_sums_keep_the_type_of_times(spark, partitioned):
    df = spark.sql("SELECT * FROM VALUES (0, 1, timestamp_seconds(10), INTERVAL '2' SECOND, true), (1, 1, NULL, NULL, false), (2, 1, timestamp_seconds(5), INTERVAL '3' SECOND, true) t(i, b, t, d, y)")
    sums = {c: g.group_scan(df, c, "b", func="nancumsum", order="i", name="out", partitioned=partitioned).orderBy("i") for c in ("t", "d", "y")}
    assert dict(sums["t"].dtypes)["out"] == "timestamp" and [r[0] for r in sums["t"].select(F.unix_seconds("out")).collect()] == [10, 10, 15]
    assert [r["out"].total_seconds() for r in sums["d"].collect()] == [2, 2, 5]
    assert [r["out"] for r in sums["y"].collect()] == [1, 1, 2]
    cut = g.group_scan(df, "t", "b", func="cumsum", order="i", name="out", partitioned=partitioned).orderBy("i").select(F.unix_seconds("out")).collect()
    assert [r[0] for r in cut] == [10, None, None]
