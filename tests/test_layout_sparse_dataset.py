import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

import gridfold as g
from gridfold.plans import contained, layout
from gridfold.streaming.incremental import stream_reduce


def chunked(spark, labels, chunks):
    at = [n for n, k in enumerate(chunks) for _ in range(k)]
    return spark.createDataFrame(list(enumerate(zip(labels, at, strict=True))), "i long, x struct<label:int,chunk:int>").select("i", "x.*")


@pytest.mark.parametrize(("chunks", "expect"), [((3, 4), [[0, 1, 2], [3]]), ((2, 2, 2, 1), [[0], [1], [2], [3]]), ((3, 3, 1), [[0, 1, 2], [3]])])
def test_cohorts(spark, chunks, expect):
    found = layout.cohorts(chunked(spark, [0, 1, 2, 0, 1, 2, 3], chunks), "label", "chunk").collect()
    assert sorted(r["labels"] for r in found) == expect


def test_merged_cohorts_and_strategy(spark):
    merged = layout.merged_cohorts(chunked(spark, [0, 1, 2, 0, 1, 2, 3], (3, 4)), "label", "chunk").collect()
    assert sorted(r["labels"] for r in merged) == [[0, 1, 2, 3]]
    assert layout.strategy(chunked(spark, [0, 0, 1, 1], (2, 2)), "label", "chunk").first()["strategy"] == "blockwise"


def test_chunk_starts(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(30)], "i long, label int")
    found = [r["chunk"] for r in layout.chunk_starts(df, "i", "label", [1]).orderBy("i").collect()]
    assert found == [sum(k % 7 == 1 for k in range(i + 1)) for i in range(30)]


@pytest.mark.parametrize("func", ["sum", "nansum", "mean", "nanmean", "max", "nanmax", "min", "nanmin", "nanlen"])
@pytest.mark.parametrize("implicit", [0.0, math.nan, 2.5])
def test_sparse_like_dense(spark, func, implicit):
    dense = [(i, [3.0, implicit, -1.0, implicit, 7.0, 2.0][i % 6], i % 2) for i in range(12)]
    df = spark.createDataFrame(dense, "i long, v double, b int")
    stored = df.filter(~F.isnan("v") & (F.col("v") != (99 if math.isnan(implicit) else implicit)))
    sizes = df.groupBy("b").agg(F.count(F.lit(1)).alias("size"))
    found = {r["b"]: r[f"v_{func}"] for r in g.sparse_reduce(stored, "v", ["b"], sizes, func, implicit).collect()}
    want = {r["b"]: r[f"v_{func}"] for r in g.group_reduce(df, "v", "b", func=func).collect()}
    assert found == pytest.approx(want)


def test_arrays(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "b int, a array<double>")
    found = {(r["b"], r["pos"]): r["value_nanmean"] for r in g.reduce_elementwise(df, "a", "b", func="nanmean").collect()}
    assert found == {(0, 0): 2, (0, 1): 3, (1, 0): 5, (1, 1): 6}
    back = g.to_array(g.to_long(df.filter("b = 1"), "a"), ["b"]).first()
    assert back["array"] == [5, 6]


def test_dataset(spark):
    df = spark.createDataFrame([(x, t, float(x * 10 + t), x + t) for x in range(3) for t in range(4)], "x int, t int, v double, w int")
    labels = spark.createDataFrame([(t, t // 2) for t in range(4)], "t int, season int")
    data = g.Dataset(df, ["x", "t"], ["v", "w"]).align(labels, ["t"])
    found = {(r["x"], r["season"]): (r["v_nanmean"], r["w_nanmean"]) for r in data.reduce("season", func="mean", dim="t", skipna=True).collect()}
    assert found[(1, 0)] == (10.5, 1.5) and len(found) == 6
    assert data.reduce(func="nansum", dim="t").count() == 3 and data.reduce(func="count").first()["v_count"] == 12
    with pytest.raises(ValueError):
        g.Dataset(df, ["x", "t"]).align(labels.filter("t < 3"), ["t"])
    with pytest.raises(ValueError):
        data.reduce(func="count", dim="y")


def test_resample_fills_gaps(spark):
    rows = [("2018-06-13 03:40:36", 1.0), ("2018-06-13 05:50:37", 2.0), ("2018-06-15 03:02:34", 3.0)]
    df = spark.createDataFrame(rows, "t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    found = g.group_reduce(df, "v", g.Resample("t", every="day"), func="nanmean", sort=True).collect()
    assert [r["v_nanmean"] for r in found] == [1.5, None, 3]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(10)], "i long, v double, b int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream_reduce(stream, "v", "b", func=["nansum", "count"]).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    query.processAllAvailable()
    query.stop()
    assert {r["b"]: (r["v_nansum"], r["v_count"]) for r in spark.table("sums").collect()} == {0: (20, 5), 1: (25, 5)}
    with pytest.raises(ValueError):
        stream_reduce(stream, "v", "b", func="median")


def test_dataset_reduces_all_but_the_keys_own_dimension(spark):
    df = spark.createDataFrame([(x, t, float(x * 10 + t)) for x in range(3) for t in range(4)], "x int, t int, v double")
    weights = spark.createDataFrame([(x, x + 0.5) for x in range(3)], "x int, weight double")
    data = g.Dataset(df, ["x", "t"], ["v"], {"weight": (weights, ["x"])})
    found = data.reduce("x", func="nansum", dim=...)
    assert sorted(map(tuple, found.collect())) == [(0, 6.0, 0.5), (1, 46.0, 1.5), (2, 86.0, 2.5)]
    with pytest.raises(ValueError):
        data.reduce("x", func="nansum")  # every dimension goes, also that of the weight
    with pytest.raises(NotImplementedError):
        data.reduce("x", "t", func="nansum", dim=...)
    binned = g.Dataset(df, ["x", "t"], ["v"]).reduce(g.Bins("x", [-1, 0, 2]), func="count", dim=...)
    assert sorted(r["v_count"] for r in binned.collect()) == [4, 8]


def test_merged_cohorts_settle_ties_by_the_least_label(spark):
    rows = [(3, 0), *[(k, c) for k in (1, 2) for c in (0, 1)]]
    df = spark.createDataFrame(rows, "label int, chunk int")
    found = [tuple(r) for r in layout.merged_cohorts(df, "label", "chunk").collect()]
    assert found == [(1, [1, 2, 3])]


def shuffled(spark):
    """Bytes that all stages so far wrote for exchanges."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_containment_moves_no_row_for_each_pair_that_shares_a_chunk(spark):
    rows = [(k, c) for k in range(800) for c in range(40) if (k * 7 + c * c * 31 + k * c) % 4]
    df = spark.createDataFrame(rows, "label int, chunk long").repartition(8)
    before = shuffled(spark)
    found = {(r["label"], r["within"]): r["containment"] for r in layout.containment(df, "label", "chunk", 0.9).collect()}
    assert shuffled(spark) - before < 2_000_000
    sets = [frozenset(c for _, c in g) for _, g in itertools.groupby(rows, lambda r: r[0])]
    assert found == {(a, b): n / len(x) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b and (n := len(x & y)) / len(x) >= 0.9}


TIME = datetime.datetime(2020, 1, 1)
CHUNKS = [("long", lambda c: c), ("string", lambda c: f"c{c}"), ("double", lambda c: math.nan if c == 3 else c / 3), ("struct<start:long,nth:int>", lambda c: (c // 5, c % 5)), ("timestamp", lambda c: TIME + datetime.timedelta(hours=c))]


@pytest.mark.parametrize(("kind", "as_chunk"), CHUNKS)
@pytest.mark.parametrize("least", [0, 0.4, 0.75, 1])
def test_containment_in_many_blocks_like_all_pairs(spark, monkeypatch, kind, as_chunk, least):
    for name, n in (("LEAST", 40), ("MOST", 60), ("ASKED", 30)):
        monkeypatch.setattr(contained, name, n)
    rng, sets = random.Random(5), {}
    for k in range(90):  # near in time, spread, one chunk that most have, one label of many chunks, null chunks, no chunk but null
        near = rng.randrange(60)
        sets[f"k{k}"] = {*(near + rng.randrange(4) for _ in range(3)), *([3] if k % 3 else []), *(rng.sample(range(64), 20) if k % 9 == 0 else []), *([None] if k % 7 == 0 else [])}
    sets |= {"all": set(range(64)), "null": {None}}
    rows = [(k, None if c is None else as_chunk(c)) for k, s in sets.items() for c in s for _ in range(2)] + [(None, as_chunk(1))]
    rng.shuffle(rows)
    found = [tuple(r) for r in layout.containment(spark.createDataFrame(rows, f"label string, chunk {kind}"), "label", "chunk", least).collect()]
    want = [(a, b, n / len(x)) for a, x in sets.items() for b, y in sets.items() if a != b and (n := len((x & y) - {None})) and n / len(x) >= least]
    assert sorted(found) == sorted(want)


def test_containment_of_nothing_and_of_a_chunk_that_all_labels_share(spark):
    empty = layout.containment(spark.createDataFrame([], "label date, chunk int"), "label", "chunk")
    assert empty.collect() == [] and empty.dtypes == [("label", "date"), ("within", "date"), ("containment", "double")]
    df = spark.range(20_000).selectExpr("id AS label", "explode(array(-1, id div 2)) AS chunk")
    found = layout.containment(df, "label", "chunk")
    assert found.count() == 20_000 and found.filter("within <> label ^ 1 OR containment <> 1").count() == 0
