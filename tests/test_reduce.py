"""Golden cases of grouped reductions, and properties against NumPy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import gridfold as g

NAN = math.nan


def frame(spark, values, labels, kind="double", label_kind="double"):
    if kind in ("double", "float"):
        values = [float(v) for v in values]
    rows = [(i, v, b) for i, (v, b) in enumerate(zip(values, labels, strict=True))]
    return spark.createDataFrame(rows, f"i long, v {kind}, b {label_kind}").repartition(3)


def result(df, key="b", value=None):
    value = value or df.columns[-1]
    return {r[key]: r[value] for r in df.collect()}


BY = [0.0, 0, 2, 2, 2, 1, 1, 2, 2, 1, 1, 0]


def test_counts_and_sums(spark):
    df = frame(spark, [1.0] * 12, [float(b) for b in BY])
    assert result(g.group_reduce(df, "v", "b", func="sum")) == {0: 3, 1: 4, 2: 5}
    assert result(g.group_reduce(df, "v", "b", func="count")) == {0: 3, 1: 4, 2: 5}
    assert result(g.group_reduce(df, "v", "b", func="nanmean")) == {0: 1, 1: 1, 2: 1}


def test_missing_labels_are_dropped(spark):
    df = frame(spark, [1.0] * 12, [NAN] * 5 + [float(b) for b in BY[5:]])
    assert result(g.group_reduce(df, "v", "b", func="count")) == {0: 1, 1: 4, 2: 2}


def test_bins_closed_on_the_right(spark):
    df = frame(spark, [1.0] * 7, [0.2, 1.5, 1.9, 2.0, 3.0, 20.0, NAN])
    found = g.group_reduce(df, "v", g.Bins("b", [1.0, 2.0, 4.0, 5.0]), func="count", fill_value=0)
    assert result(found, "b_left") == {1: 3, 2: 1, 4: 0}


def test_bins_closed_on_the_left_and_bad_bins(spark):
    df = frame(spark, [1.0] * 6, [0.2, 1.5, 1.9, 2.0, 3.0, 20.0])
    assert result(g.group_reduce(df, "v", g.Bins("b", [1.0, 2.0, 4.0, 5.0], closed="left"), func="count"), "b_left") == {1: 2, 2: 2, 4: 0}
    with pytest.raises(NotImplementedError):
        g.Bins("b", [1, 2], closed="both")
    with pytest.raises(ValueError):
        g.Bins("b", 4)


@pytest.mark.parametrize("fill", [123.0, None])
def test_fill_value_turns_on_min_count(spark, fill):
    df = frame(spark, [NAN, 1.0, 1.0, NAN, 1.0, 1.0], [1, 2, 3, 1, 2, 3], label_kind="int")
    for func, expect in (("nansum", 2), ("nanprod", 1), ("nanmax", 1), ("nanmean", 1), ("count", 2)):
        found = result(g.group_reduce(df, "v", g.Labels("b", [0, 1, 2, 3]), func=func, fill_value=fill))
        assert found == {0: fill, 1: fill, 2: expect, 3: expect}, func


def test_all_missing_groups_sum_to_zero_without_fill(spark):
    df = frame(spark, [1.0, 2, 3, NAN, NAN, NAN, 4, 5, NAN, NAN], list(range(0, 20, 2)), label_kind="int")
    found = result(g.group_reduce(df, "v", g.Labels("b", list(range(19))), func="nansum"))
    assert found[6] == 0 and found[1] is None and found[4] == 3


def test_propagation_and_skipping(spark):
    df = frame(spark, [1.0, NAN, 3.0, 5.0], [0, 0, 1, 1], label_kind="int")
    for func in ("sum", "mean", "max", "min", "var", "std", "prod", "median", "mode"):
        assert result(g.group_reduce(df, "v", "b", func=func))[0] is None, func
    assert result(g.group_reduce(df, "v", "b", func="min"))[1] == 3
    assert result(g.group_reduce(df, "v", "b", func="nanmin"))[0] == 1


def test_positions(spark):
    df = frame(spark, [5.0, NAN, 5.0, 1.0, 2.0, 1.0], [0, 0, 0, 1, 1, 1], label_kind="int")
    found = g.group_reduce(df, "v", "b", func=["argmax", "nanargmax", "argmin", "nanargmin", "first", "last", "nanfirst", "nanlast"], order="i")
    rows = {r["b"]: r.asDict() for r in found.collect()}
    assert rows[0]["v_argmax"] == 1 and rows[0]["v_nanargmax"] == 0 and rows[1]["v_argmin"] == 3 and rows[1]["v_nanargmin"] == 3
    assert rows[0]["v_first"] == 5 and rows[0]["v_last"] == 5 and rows[1]["v_nanlast"] == 1
    with pytest.raises(ValueError):
        g.group_reduce(df, "v", "b", func="first")


def test_large_groups_like_built_in(spark):
    df = frame(spark, [float((7 * i) % 31) for i in range(300)] + [NAN, 5.0], [i % 3 for i in range(300)] + [2, 3], label_kind="int").withColumn("i", F.col("i"))
    for q in (0.0, 0.3, 0.5, 1.0):
        assert result(g.group_quantile(df, "v", "b", q=q)) == pytest.approx(result(g.group_reduce(df, "v", "b", func="nanquantile", q=q)))
    assert result(g.group_quantile(df, "v", "b", q=0.5, skipna=False))[2] is None
    assert result(g.group_mode(df, "v", "b")) == result(g.group_reduce(df, "v", "b", func="nanmode"))
    assert result(g.group_mode(df, "v", "b", skipna=False)) == result(g.group_reduce(df, "v", "b", func="mode"))


def test_quantiles(spark):
    rows = [(i, d, v, b) for d, vs in enumerate([[1.0, -1, NAN, 3, 4, 10, 5], [1, NAN, NAN, 3, 4, NAN, NAN]]) for i, (v, b) in enumerate(zip(vs, [0, 0, 0, 1, 0, 1, 1], strict=True))]
    df = spark.createDataFrame([(i, d, float(v), b) for i, d, v, b in rows], "i long, d int, v double, b int")
    skipping = {(r["d"], r["b"]): r["v_nanquantile"] for r in g.group_reduce(df, "v", "b", func="nanquantile", q=0.5, keep_dims=["d"]).collect()}
    assert skipping == {(0, 0): 1, (0, 1): 5, (1, 0): 2.5, (1, 1): 3}
    strict = {(r["d"], r["b"]): r["v_quantile"] for r in g.group_reduce(df, "v", "b", func="quantile", q=0.5, keep_dims=["d"]).collect()}
    assert strict == {(0, 0): None, (0, 1): 5, (1, 0): None, (1, 1): None}
    assert g.group_reduce(df, "v", "b", func="nanquantile", q=[0.5, 0.9]).count() == 4
    with pytest.raises(ValueError):
        g.group_reduce(df, "v", "b", func="quantile")


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e8, 1e12])
def test_variance_keeps_its_precision(spark, offset):
    values = np.linspace(-1, 1, 1000) + offset
    df = spark.createDataFrame([(i, float(v), i % 2) for i, v in enumerate(values)], "i long, v double, b int")
    found = result(g.group_reduce(df, "v", "b", func="nanvar"))
    for b in (0, 1):
        np.testing.assert_allclose(found[b], np.var(values[b::2]), rtol=3e-8, atol=1e-9)


def test_ddof_beyond_the_group(spark):
    df = frame(spark, [1.0, 2.0, 3.0], [0, 1, 1], label_kind="int")
    assert result(g.group_reduce(df, "v", "b", func="var", ddof=1)) == {0: None, 1: 0.5}


def test_dense_product_and_limit(spark):
    df = frame(spark, [1.0] * 4, ["a", "a", "b", "c"], label_kind="string").withColumn("c", F.col("i") % 2)
    found = {(r["b"], r["c"]): r["v_count"] for r in g.group_reduce(df, "v", "b", "c", func="count").collect()}
    assert found == {("a", 0): 1, ("a", 1): 1, ("b", 0): 1, ("b", 1): 0, ("c", 0): 0, ("c", 1): 1}
    with g.set_options(max_dense_cells=5):
        assert g.group_reduce(df, "v", "b", "c", func="count", dense=False).count() == 4
        for dense in ("auto", True):  # never silently sparse
            with pytest.raises(ValueError):
                g.group_reduce(df, "v", "b", "c", func="count", dense=dense)
    with g.set_options(max_dense_cells=11), pytest.raises(ValueError):  # 6 cells in each of 4 places
        g.group_reduce(df, "v", "b", "c", func="count", keep_dims=["i"])
    assert g.OPTIONS.max_dense_cells > 5


def test_unexpected_labels_are_dropped_before_the_scan(spark, tmp_path):
    df = frame(spark, [1.0] * 4, ["a", "a", "b", "c"], label_kind="string")
    key = g.Labels("b", expected=["a", "z"])
    assert result(g.group_reduce(df, "v", key, func="count")) == {"a": 2, "z": 0}
    assert result(g.group_reduce(df, "v", key, func="count", dense=False)) == {"a": 2}
    assert result(g.group_reduce(df, "v", g.Labels("b", expected=df.select("b").filter("b < 'c'")), func="count")) == {"a": 2, "b": 1}
    df.write.parquet(str(tmp_path / "t"))
    plan = g.group_reduce(spark.read.parquet(str(tmp_path / "t")), "v", key, func="count")._jdf.queryExecution().executedPlan().toString()
    assert "In(b, [a,z])" in plan and "ReadSchema: struct<v:double,b:string>" in plan


def test_types(spark):
    df = spark.createDataFrame([(0, True, 1), (1, False, 1), (2, True, 2)], "i long, v boolean, b int")
    assert result(g.group_reduce(df, "v", "b", func="sum")) == {1: 1, 2: 1}
    assert result(g.group_reduce(df, "v", "b", func="max")) == {1: True, 2: True}
    strings = frame(spark, ["x", None, "z"], [0, 0, 1], kind="string", label_kind="int")
    assert result(g.group_reduce(strings, "v", "b", func="count")) == {0: 1, 1: 1}
    with pytest.raises(TypeError):
        g.group_reduce(strings, "v", "b", func="mean")
    with pytest.raises(ValueError):
        g.group_reduce(df, "v", "b", func="count", skipna=True)
    single = frame(spark, [1.0, 2.0], [0, 0], kind="float", label_kind="int")
    assert dict(g.group_reduce(single, "v", "b", func=["mean", "sum"]).dtypes)["v_mean"] == "float"
    empty = single.filter("false")
    assert g.group_reduce(empty, "v", "b", func="sum").count() == 0
    assert result(g.group_reduce(empty, "v", g.Labels("b", [7]), func="count")) == {7: 0}


def test_user_defined(spark):
    df = frame(spark, [float(x) for x in range(10)], [x % 2 for x in range(10)], label_kind="int")
    mean = g.GroupAgg("mean", {"s": lambda m: F.sum(m.valid), "n": lambda m: F.count(m.valid)}, lambda p: p["s"] / p["n"])
    assert result(g.group_reduce(df, "v", "b", func=mean)) == result(g.group_reduce(df, "v", "b", func="nanmean"))
    median = g.HolisticAgg("median", lambda s: float(s.median()))
    assert result(g.group_reduce(df, "v", "b", func=median)) == {0: 4, 1: 5}


def test_overlapping_groups(spark):
    labels = [1, 2, 3, 1, 2, 3, 0, 0, 0]
    df = frame(spark, [1.0] * 9, labels, label_kind="int")
    df = g.overlapping(df, "b", F.when(F.col("b").isin(1, 2), 4).otherwise(-1))
    assert result(g.group_reduce(df, "v", "label", func="sum"), "label") == {0: 3, 1: 2, 2: 2, 3: 2, 4: 4, -1: 5}


def test_partial_aggregation_before_one_exchange(spark):
    df = spark.range(1000).withColumns({"b": F.col("id") % 7, "v": F.rand()})
    plan = g.group_reduce(df, "v", "b", func=["nansum", "count", "nanmax"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange") == 1
    from gridfold.plans import layout

    placed = g.group_reduce(layout.blockwise(df, "b"), "v", "b", func="nansum")._jdf.queryExecution().executedPlan().toString()
    assert placed.count("Exchange") == 1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(-1e3, 1e3)), st.integers(0, 3)), min_size=1, max_size=40), st.sampled_from(["nansum", "nanmean", "nanmax", "nanmin", "nanvar", "count", "nanmedian"]))
def test_like_numpy(spark, rows, func):
    df = spark.createDataFrame([(i, v, b) for i, (v, b) in enumerate(rows)], "i long, v double, b int").repartition(3)
    found = result(g.group_reduce(df, "v", "b", func=func))
    for b in {b for _, b in rows}:
        valid = np.array([v for v, x in rows if x == b and v is not None])
        if func == "count":
            assert found[b] == len(valid)
        elif not len(valid):
            assert found[b] == (0 if func == "nansum" else None)
        else:
            np.testing.assert_allclose(found[b], getattr(np, func.removeprefix("nan"))(valid), rtol=1e-9, atol=1e-9)


def test_several_values_in_one_pass(spark):
    df = spark.createDataFrame([(i, float(i) + 1e8, i % 3, i % 2) for i in range(30)], "i long, v double, w int, b int")
    found = g.group_reduce(df, ["v", "w"], "b", func=["nanvar", "count"])
    assert found.columns == ["b", "v_nanvar", "v_count", "w_nanvar", "w_count"]
    for value in ("v", "w"):
        alone = {r["b"]: r[f"{value}_nanvar"] for r in g.group_reduce(df, value, "b", func="nanvar").collect()}
        assert {r["b"]: r[f"{value}_nanvar"] for r in found.collect()} == pytest.approx(alone)
    plan = g.group_reduce(df, ["v", "w"], "b", func="nanmean")._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange ") == 1 and "Join" not in plan
    spread = g.HolisticAgg("spread", lambda s: float(s.max() - s.min()))
    assert {tuple(r) for r in g.group_reduce(df, ["v", "w"], "b", func=spread).collect()} == {(0, 28.0, 2.0), (1, 28.0, 2.0)}
    least = g.group_reduce(df.withColumn("w", F.when(F.col("b") == 0, F.col("w"))), ["v", "w"], "b", func="nansum", min_count=1)
    assert {r["b"]: r["w_nansum"] is None for r in least.collect()} == {0: False, 1: True}


def test_products_beyond_doubles_raise(spark):
    whole = spark.createDataFrame([(0, 3)] * 33, "b int, v long")
    assert g.group_reduce(whole, "v", "b", func="prod").first()["v_prod"] == 3**33
    with pytest.raises(Exception, match="beyond 2"):
        g.group_reduce(whole.union(whole), "v", "b", func="prod").collect()
    assert g.group_reduce(whole.union(whole), "v", "b", func="prod", dtype="double").first()["v_prod"] == pytest.approx(3.0**66)
