"""The registered queries of the engine's own operators, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gridfold as g
from gridfold.plans import layout
from gridfold.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Values with gaps: every seventh click and view has none, so some groups have missing values and some do not.
GAPS = "CASE WHEN event_type IN ('click', 'view') AND event_id % 7 = 0 THEN NULL ELSE value END"
KINDS = ["click", "error", "purchase", "refund", "signup", "view"]  # refund never occurs
DOMAIN = "(VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) d(event_type)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("v", F.expr(GAPS))


def by_kind() -> g.Labels:
    return g.Labels("event_type", expected=KINDS)


# Reductions ---------------------------------------------------------------------------------------------------------

_P = "CASE WHEN count(*) = count(v) THEN {} END"
_FIRST = "{}(CASE WHEN {} THEN v END, event_id)"
#: name: the SQL of the aggregate over v, of an absent group, and whether it is rounded
_REDUCTIONS: dict[str, tuple[str, str, bool]] = {
    "count": ("count(v)", "0", False),
    "sum": (_P.format("sum(v)"), "NULL", True),
    "nansum": ("coalesce(sum(v), 0)", "NULL", True),
    "prod": (_P.format("product(v)"), "1", True),
    "nanprod": ("coalesce(product(v), 1)", "1", True),
    "mean": (_P.format("avg(v)"), "NULL", True),
    "nanmean": ("avg(v)", "NULL", True),
    "var": (_P.format("var_pop(v)"), "NULL", True),
    "nanvar": ("var_pop(v)", "NULL", True),
    "std": (_P.format("stddev_pop(v)"), "NULL", True),
    "nanstd": ("stddev_pop(v)", "NULL", True),
    "max": (_P.format("max(v)"), "NULL", False),
    "nanmax": ("max(v)", "NULL", False),
    "min": (_P.format("min(v)"), "NULL", False),
    "nanmin": ("min(v)", "NULL", False),
    "argmax": ("CASE WHEN count(*) = count(v) THEN min(CASE WHEN v = hi THEN event_id END) ELSE min(CASE WHEN v IS NULL THEN event_id END) END", "-1", False),
    "nanargmax": ("min(CASE WHEN v = hi THEN event_id END)", "-1", False),
    "argmin": ("CASE WHEN count(*) = count(v) THEN min(CASE WHEN v = lo THEN event_id END) ELSE min(CASE WHEN v IS NULL THEN event_id END) END", "-1", False),
    "nanargmin": ("min(CASE WHEN v = lo THEN event_id END)", "-1", False),
    "first": ("max(CASE WHEN event_id = first_id THEN v END)", "NULL", False),
    "nanfirst": ("max(CASE WHEN event_id = first_valid THEN v END)", "NULL", False),
    "last": ("max(CASE WHEN event_id = last_id THEN v END)", "NULL", False),
    "nanlast": ("max(CASE WHEN event_id = last_valid THEN v END)", "NULL", False),
    "any": ("coalesce(bool_or(v > 480), false)", "false", False),
    "all": ("coalesce(bool_and(v > 0.02), false)", "false", False),
    "median": (_P.format("quantile_cont(v, 0.5)"), "NULL", True),
    "nanmedian": ("quantile_cont(v, 0.5)", "NULL", True),
    "quantile": (_P.format("quantile_cont(v, 0.9)"), "NULL", True),
    "nanquantile": ("quantile_cont(v, 0.9)", "NULL", True),
}
_TYPES = {"count": "BIGINT", "argmax": "BIGINT", "nanargmax": "BIGINT", "argmin": "BIGINT", "nanargmin": "BIGINT", "any": "BOOLEAN", "all": "BOOLEAN"}


def _reduction(name: str) -> None:
    aggregate, absent, is_rounded = _REDUCTIONS[name]
    kind = _TYPES.get(name, "DOUBLE")
    small = "prod" in name  # values near 1, or the products overflow
    found = f"CASE WHEN count(e.event_id) = 0 THEN {absent} ELSE {'round(' + aggregate + ', 6)' if is_rounded else aggregate} END"
    v = "1 + v / 1e6" if small else "v"
    sql = f"""
WITH s AS (SELECT event_id, event_type, {v} AS v FROM (SELECT *, {GAPS} AS v FROM events)),
w AS (SELECT *, max(v) OVER p AS hi, min(v) OVER p AS lo, min(event_id) OVER p AS first_id, max(event_id) OVER p AS last_id,
  min(CASE WHEN v IS NOT NULL THEN event_id END) OVER p AS first_valid, max(CASE WHEN v IS NOT NULL THEN event_id END) OVER p AS last_valid
  FROM s WINDOW p AS (PARTITION BY event_type)),
e AS (SELECT * FROM w)
SELECT d.event_type, CAST({found.replace("count(*)", "count(e.event_id)")} AS {kind}) AS result FROM {DOMAIN} LEFT JOIN e ON e.event_type = d.event_type GROUP BY d.event_type"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir)
        if small:
            df = df.withColumn("v", 1 + F.col("v") / 1e6)
        if name in ("any", "all"):
            df = df.withColumn("v", F.col("v") > (480 if name == "any" else 0.02))
        found = g.group_reduce(df, "v", by_kind(), func=name, order="event_id", q=0.9 if "quantile" in name else None, names=["result"])
        return rounded(found, "result") if is_rounded else found

    query(sql, f"reduce_{name}")(run)


for _name in _REDUCTIONS:
    _reduction(_name)

_MODE = """
WITH e AS (SELECT event_type, CASE WHEN event_type IN ('click', 'view') AND event_id % 7 = 0 THEN NULL ELSE user_id END AS v FROM events),
c AS (SELECT event_type, v, count(*) AS n FROM e WHERE v IS NOT NULL GROUP BY 1, 2),
m AS (SELECT event_type, v FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, v) = 1),
b AS (SELECT event_type, count(*) - count(v) AS bad FROM e GROUP BY 1)
SELECT d.event_type, {} AS result FROM """ + DOMAIN + " LEFT JOIN m USING (event_type) LEFT JOIN b USING (event_type)"


def _mode(spark: SparkSession, sf_dir: str, func: str) -> DataFrame:
    df = load(spark, sf_dir, "events").withColumn("v", F.expr(GAPS.replace("ELSE value", "ELSE user_id")))
    return g.group_reduce(df, "v", by_kind(), func=func, names=["result"])


query(_MODE.format("CASE WHEN b.bad = 0 THEN m.v END"), "reduce_mode")(lambda spark, sf_dir: _mode(spark, sf_dir, "mode"))
query(_MODE.format("m.v"), "reduce_nanmode")(lambda spark, sf_dir: _mode(spark, sf_dir, "nanmode"))


@query(f"""WITH e AS (SELECT event_type, {GAPS} AS v FROM events)
SELECT event_type, round(sum(v * v), 4) AS result FROM e GROUP BY 1""")
def reduce_nansum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "v", "event_type", func="nansum_of_squares", names=["result"]), "result", places=4)


@query(f"""WITH e AS (SELECT event_type, {GAPS} AS v FROM events)
SELECT event_type, CASE WHEN count(*) = count(v) THEN round(sum(v * v), 4) END AS v_sum_of_squares, count(*) AS v_len, count(v) AS v_nanlen FROM e GROUP BY 1""")
def reduce_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "v", "event_type", func=["sum_of_squares", "len", "nanlen"]), "v_sum_of_squares", places=4)


@query(f"""WITH e AS (SELECT event_type, {GAPS} AS v, user_id FROM events)
SELECT event_type, round(avg(v), 6) AS v_nanmean, max(v) AS v_nanmax, round(avg(user_id), 6) AS user_id_nanmean, max(user_id) AS user_id_nanmax FROM e GROUP BY 1""")
def reduce_several_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = g.group_reduce(events(spark, sf_dir), ["v", "user_id"], "event_type", func=["nanmean", "nanmax"])
    return rounded(found, "v_nanmean", "user_id_nanmean")


@query(f"""WITH e AS (SELECT event_type, {GAPS} AS v FROM events), q AS (SELECT event_type, unnest([0.1, 0.5, 0.99])::DOUBLE AS quantile, unnest(quantile_cont(v, [0.1, 0.5, 0.99])) AS x FROM e GROUP BY event_type)
SELECT event_type, quantile, round(x, 6) AS result FROM q""")
def reduce_quantile_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "v", "event_type", func="nanquantile", q=[0.1, 0.5, 0.99], names=["result"]), "result")


@query(f"""WITH e AS (SELECT event_type, {GAPS} AS v FROM events), q AS (SELECT event_type, unnest([0.0, 0.25, 0.9])::DOUBLE AS quantile, unnest(quantile_cont(v, [0.0, 0.25, 0.9])) AS x FROM e GROUP BY event_type)
SELECT event_type, quantile, round(x, 6) AS result FROM q""")
def reduce_quantile_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_quantile(events(spark, sf_dir), "v", "event_type", q=[0.0, 0.25, 0.9], name="result"), "result")


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, user_id AS result FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) = 1""")
def reduce_mode_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.group_mode(load(spark, sf_dir, "events"), "user_id", "event_type", name="result")


@query(f"""WITH e AS (SELECT event_type, {GAPS} + 1e9 AS v FROM events), m AS (SELECT *, v - min(v) OVER (PARTITION BY event_type) AS s FROM e)
SELECT event_type, round(var_samp(s), 4) AS v_nanvar, round(stddev_samp(s), 4) AS v_nanstd FROM m GROUP BY 1""")
def reduce_var_ddof_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("v", F.col("v") + 1e9)
    return rounded(g.group_reduce(df, "v", "event_type", func=["nanvar", "nanstd"], ddof=1), "v_nanvar", "v_nanstd", places=4)


@query("""SELECT o_orderpriority, min(o_orderdate) AS o_orderdate_nanmin, max(o_orderdate) AS o_orderdate_nanmax, count(o_orderdate) AS o_orderdate_count FROM orders GROUP BY 1""")
def reduce_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.group_reduce(load(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", func=["nanmin", "nanmax", "count"])


@query("""SELECT lang, count(text) AS text_count, min_by(text, doc_id) AS text_first FROM documents GROUP BY 1""")
def reduce_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.group_reduce(load(spark, sf_dir, "documents"), "text", "lang", func=["count", "first"], order="doc_id")


@query("""SELECT quality, sum(toxic)::BIGINT AS bad_sum, bool_or(toxic = 1) AS bad_any, bool_and(toxic = 1) AS bad_all, max(toxic = 1) AS bad_max FROM labels GROUP BY 1""")
def reduce_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "labels").withColumn("bad", F.col("toxic") == 1)
    return g.group_reduce(df, "bad", "quality", func=["sum", "any", "all", "max"])


@query("""SELECT l_returnflag, round(sum(l_quantity::FLOAT), 0)::FLOAT AS q_sum, round(avg(l_quantity::FLOAT), 3)::FLOAT AS q_mean FROM lineitem GROUP BY 1""")
def reduce_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("float"))
    found = g.group_reduce(df, "q", "l_returnflag", func=["sum", "mean"])
    return found.withColumns({"q_sum": F.round("q_sum", 0).cast("float"), "q_mean": F.round("q_mean", 3).cast("float")})


# Keys ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, round(sum(value), 6) AS value_nansum FROM events GROUP BY 1")
def key_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "value", "event_type", func="nansum"), "value_nansum")


@query("""SELECT d.k AS event_type, coalesce(round(sum(e.value), 6), 0) AS value_nansum
FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) d(k) LEFT JOIN events e ON e.event_type = d.k GROUP BY 1""")
def key_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "value", by_kind(), func="nansum", fill_value=0), "value_nansum")


@query("SELECT r.range AS user_id, count(e.value) AS value_count FROM range(100) r LEFT JOIN events e ON e.user_id = r.range GROUP BY 1")
def key_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.group_reduce(events(spark, sf_dir), "value", g.Codes("user_id", 100), func="count")


EDGES = [0.0, 1.0, 5.0, 25.0, 100.0, 400.0, 1000.0]
_EDGES = "(VALUES (0.0::DOUBLE, 1.0::DOUBLE), (1, 5), (5, 25), (25, 100), (100, 400), (400, 1000)) b(value_left, value_right)"


@query(f"SELECT value_left, value_right, count(e.value) AS value_count, round(avg(e.value), 6) AS value_mean FROM {_EDGES} LEFT JOIN events e ON e.value > value_left AND e.value <= value_right GROUP BY 1, 2")
def key_bins_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "value", g.Bins("value", EDGES), func=["count", "mean"]), "value_mean")


@query("""SELECT b.l AS l_quantity_left, b.r AS l_quantity_right, count(i.l_quantity) AS l_quantity_count
FROM (VALUES (1.0::DOUBLE, 10.0::DOUBLE), (10, 20), (20, 50)) b(l, r) LEFT JOIN lineitem i ON l_quantity >= b.l AND l_quantity < b.r GROUP BY 1, 2""")
def key_bins_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.group_reduce(load(spark, sf_dir, "lineitem"), "l_quantity", g.Bins("l_quantity", [1.0, 10.0, 20.0, 50.0], closed="left"), func="count")


@query("""SELECT b.l AS ts_left, b.r AS ts_right, round(sum(e.value), 6) AS value_nansum
FROM (VALUES (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10'), (TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20'), (TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-01')) b(l, r)
LEFT JOIN events e ON e.ts > b.l AND e.ts <= b.r GROUP BY 1, 2""")
def key_bins_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = g.group_reduce(events(spark, sf_dir), "value", g.Bins("ts", ["2024-01-01", "2024-01-10", "2024-01-20", "2024-02-01"]), func="nansum")
    return rounded(found, "value_nansum").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts_left", "ts_right")})


@query("""WITH f AS (SELECT DISTINCT l_returnflag FROM lineitem), s AS (SELECT DISTINCT l_linestatus FROM lineitem)
SELECT f.l_returnflag, s.l_linestatus, count(i.l_quantity) AS l_quantity_count, round(sum(i.l_quantity), 6) AS l_quantity_nansum
FROM f CROSS JOIN s LEFT JOIN lineitem i ON i.l_returnflag = f.l_returnflag AND i.l_linestatus = s.l_linestatus GROUP BY 1, 2""")
def key_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(load(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus", func=["count", "nansum"]), "l_quantity_nansum")


@query(f"""SELECT d.event_type, value_left, value_right, coalesce(round(sum(e.value), 6), 0) AS value_nansum FROM {DOMAIN} CROSS JOIN {_EDGES}
LEFT JOIN events e ON e.event_type = d.event_type AND e.value > value_left AND e.value <= value_right GROUP BY 1, 2, 3""")
def key_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "value", by_kind(), g.Bins("value", EDGES), func="nansum", fill_value=0), "value_nansum")


@query("""WITH a AS (SELECT range AS i FROM range(5)), b AS (SELECT range AS j FROM range(4))
SELECT (i * 10)::DOUBLE AS l_quantity_left, (i * 10 + 10)::DOUBLE AS l_quantity_right, j * 0.025 AS l_discount_left, (j + 1) * 0.025 AS l_discount_right, count(l.l_orderkey) AS l_orderkey_count
FROM a CROSS JOIN b LEFT JOIN lineitem l ON l_quantity > i * 10 AND l_quantity <= i * 10 + 10 AND l_discount > j * 0.025 AND l_discount <= (j + 1) * 0.025 GROUP BY i, j""".replace("j * 0.025 AS", "(j * 0.025)::DOUBLE AS").replace("(j + 1) * 0.025 AS", "((j + 1) * 0.025)::DOUBLE AS"))
def key_histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = g.Bins("l_quantity", [10.0 * i for i in range(6)]), g.Bins("l_discount", [0.0, 0.025, 0.05, 0.075, 0.1])
    return g.group_reduce(load(spark, sf_dir, "lineitem"), "l_orderkey", *bins, func="count")


@query("""WITH p AS (SELECT DISTINCT o_orderpriority FROM orders), s AS (SELECT DISTINCT o_orderstatus FROM orders)
SELECT p.o_orderpriority, s.o_orderstatus, round(max(o.o_totalprice), 6) AS o_totalprice_nanmax FROM p CROSS JOIN s LEFT JOIN orders o USING (o_orderpriority, o_orderstatus) GROUP BY 1, 2""")
def key_kept_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(load(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", func="nanmax", keep_dims=["o_orderpriority"], dense=True), "o_totalprice_nanmax")


@query("""SELECT n_name, count(o_totalprice) AS o_totalprice_count, round(avg(o_totalprice), 6) AS o_totalprice_nanmean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def key_broadcast_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = g.with_labels(load(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), load(spark, sf_dir, "nation"), ["n_nationkey"])
    df = g.with_labels(load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), labels.select("c_custkey", "n_name"), ["c_custkey"])
    return rounded(g.group_reduce(df, "o_totalprice", "n_name", func=["count", "nanmean"]), "o_totalprice_nanmean")


@query("""SELECT label, round(sum(value), 6) AS value_nansum FROM (SELECT event_type AS label, value FROM events UNION ALL SELECT 'engaged', value FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY 1""")
def key_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = g.overlapping(events(spark, sf_dir), "event_type", F.when(F.col("event_type").isin("click", "purchase"), "engaged"))
    return rounded(g.group_reduce(df, "value", "label", func="nansum"), "value_nansum")


@query("""WITH e AS (SELECT event_type, value, CASE WHEN event_type = 'view' THEN 10 ELSE 50 END AS w FROM events)
SELECT event_type, (CASE WHEN value <= w THEN 0 WHEN value <= 2 * w THEN 1 ELSE 2 END)::INTEGER AS value, count(value) AS value_count FROM e WHERE value > 0 AND value <= 10 * w GROUP BY 1, 2""")
def key_row_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.col("event_type") == "view", 10.0).otherwise(50.0)
    df = events(spark, sf_dir).withColumn("edges", F.array(F.lit(0.0), w, 2 * w, 10 * w))
    return g.group_reduce(df, "value", g.RowBins("value"), func="count", keep_dims=["event_type"])


@query("""WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS ts)
SELECT d.ts, round(avg(e.value), 6) AS value_nanmean, count(e.value) AS value_count FROM d LEFT JOIN events e ON date_trunc('day', e.ts) = d.ts GROUP BY 1""")
def key_resample_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "value", g.Resample("ts", every="day", start="2023-12-30", end="2024-02-01"), func=["nanmean", "count"]), "value_nanmean")


@query("""SELECT TIMESTAMP '2024-01-01' + to_days((date_diff('day', DATE '2024-01-01', ts::DATE) // 5 * 5)::INTEGER) AS ts, round(sum(value), 6) AS value_nansum FROM events GROUP BY 1""")
def key_resample_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "value", g.Resample("ts", every="5 days", start="2024-01-01"), func="nansum"), "value_nansum")


@query("""SELECT r.range::INTEGER AS ts, round(avg(value), 6) AS value_nanmean FROM range(24) r LEFT JOIN events e ON hour(e.ts) = r.range GROUP BY 1""")
def key_climatology_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "value", g.DatePart("ts", part="hour", full=True), func="nanmean"), "value_nanmean")


@query("""SELECT month(o_orderdate)::INTEGER AS month, round(avg(o_totalprice), 6) AS o_totalprice_nanmean FROM orders GROUP BY 1""")
def key_climatology_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(load(spark, sf_dir, "orders"), "o_totalprice", g.DatePart("o_orderdate", part="month", name="month"), func="nanmean"), "o_totalprice_nanmean")


@query("SELECT l_returnflag, l_linestatus, count(*) AS l_tax_count FROM lineitem GROUP BY 1, 2")
def key_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.group_reduce(load(spark, sf_dir, "lineitem"), "l_tax", g.Tuples("both", parts=["l_returnflag", "l_linestatus"]), func="count")


@query("SELECT event_type, count(*) AS value_count, (row_number() OVER (ORDER BY min(event_id)))::BIGINT AS place FROM events GROUP BY 1")
def key_appearance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = g.group_reduce(events(spark, sf_dir), "value", "event_type", func="count", order="event_id", sort="appearance")
    return found.withColumn("place", F.monotonically_increasing_id() + 1)


@query("SELECT round(sum(value), 4) AS value_nansum, count(value) AS value_count, round(var_pop(value), 4) AS value_nanvar FROM events")
def key_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "value", func=["nansum", "count", "nanvar"]), "value_nansum", "value_nanvar", places=4)


@query("""SELECT l_returnflag, max(l_quantity) AS l_quantity_nanmax, any_value(length(l_returnflag) + 3) AS weight FROM lineitem GROUP BY 1""")
def dataset_all_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    weights = rows.select("l_returnflag").distinct().withColumn("weight", (F.char_length("l_returnflag") + 3).cast("bigint"))
    data = g.Dataset(rows, ["l_returnflag", "l_orderkey", "l_linenumber"], ["l_quantity"], {"weight": (weights, ["l_returnflag"])})
    return data.reduce("l_returnflag", func="nanmax", dim=...)


@query("SELECT n_regionkey, count(c_acctbal) AS c_acctbal_count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def dataset_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    labels = load(spark, sf_dir, "nation").join(rows.select("n_nationkey").distinct(), "n_nationkey", "left_semi").select("n_nationkey", "n_regionkey")
    return g.Dataset(rows, ["c_custkey", "n_nationkey"], ["c_acctbal"]).align(labels, ["n_nationkey"]).reduce("n_regionkey", func="count")


@query("""SELECT o_orderstatus, max(o_totalprice) AS o_totalprice_nanmax, 'euro' AS unit FROM orders GROUP BY 1""")
def reduce_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").alias("o_totalprice", metadata={"unit": "euro"}))
    found = g.group_reduce(df, "o_totalprice", "o_orderstatus", func="nanmax")
    return found.withColumn("unit", F.lit(found.schema["o_totalprice_nanmax"].metadata["unit"]))


# Dense results, fill values, types ------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)
SELECT d.event_type, CASE WHEN count(v) >= 1 THEN round(sum(v), 6) ELSE -9 END AS v_nansum, CASE WHEN count(v) >= 1 THEN max(v) ELSE -9 END AS v_nanmax FROM {DOMAIN} LEFT JOIN e USING (event_type) GROUP BY 1""")
def dense_fill_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(g.group_reduce(df, "v", by_kind(), func=["nansum", "nanmax"], fill_value=-9.0), "v_nansum")


@query("SELECT user_id, CASE WHEN count(value) >= 70 THEN round(sum(value), 6) END AS value_nansum FROM events GROUP BY 1")
def dense_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "value", "user_id", func="nansum", min_count=70), "value_nansum")


@query("SELECT l_returnflag, l_linestatus, count(*) AS l_tax_count FROM lineitem GROUP BY 1, 2")
def dense_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.group_reduce(load(spark, sf_dir, "lineitem"), "l_tax", "l_returnflag", "l_linestatus", func="count", dense=False)


@query("SELECT o_orderpriority, sum(trunc(o_totalprice)::BIGINT)::BIGINT AS o_totalprice_nansum, max(trunc(o_totalprice)::BIGINT) AS o_totalprice_nanmax FROM orders GROUP BY 1")
def dense_dtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.group_reduce(load(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", func=["nansum", "nanmax"], dtype="bigint")


@query(f"SELECT event_type, round(avg(v), 6) AS v_nanmean FROM (SELECT event_type, {GAPS} AS v FROM events) GROUP BY 1")
def dense_skipna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.group_reduce(events(spark, sf_dir), "v", "event_type", func="mean", skipna=True), "v_nanmean")


# Scans --------------------------------------------------------------------------------------------------------------

_SCANS = {
    "cumsum": "CASE WHEN count(*) OVER w = count(v) OVER w THEN round(sum(v) OVER w, 4) END",
    "nancumsum": "round(coalesce(sum(v) OVER w, 0), 4)",
    "ffill": "last_value(v IGNORE NULLS) OVER w",
    "bfill": "first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}


def _scan(name: str, partitioned: bool) -> None:
    sql = f"SELECT event_id, {_SCANS[name]} AS result FROM (SELECT event_id, event_type, {GAPS} AS v FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir).select("event_id", "event_type", "v")
        found = g.group_scan(df, "v", "event_type", func=name, order="event_id", name="result", partitioned=partitioned).select("event_id", "result")
        return rounded(found, "result", places=4) if "cumsum" in name else found

    query(sql, f"scan_{name}{'_partitioned' * partitioned}")(run)


for _name in _SCANS:
    _scan(_name, False)
    _scan(_name, True)


def _scan_of_times(partitioned: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, "events").select("event_id", "user_id", (F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) % 86400)).alias("t"))
        found = g.group_scan(df, "t", "user_id", func="nancumsum", order="event_id", name="result", partitioned=partitioned)
        return found.select("event_id", F.unix_seconds("result").alias("result"))

    sql = "SELECT event_id, (sum(epoch(ts)::BIGINT % 86400) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS result FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)"
    query(sql, f"scan_times{'_partitioned' * partitioned}")(run)


_scan_of_times(False)
_scan_of_times(True)


@query("SELECT event_id, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value_cummax FROM events")
def scan_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    cummax = g.GroupScan("cummax", lambda m, w: F.max(m.valid).over(w))
    return g.group_scan(events(spark, sf_dir), "value", "event_type", func=cummax, order="event_id").select("event_id", "value_cummax")


@query("SELECT event_id, round(value - first_value(value) OVER (PARTITION BY event_type ORDER BY event_id), 6) AS value_rise FROM events")
def scan_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rise = g.PandasScan("rise", lambda s: s - s.iloc[0])
    df = events(spark, sf_dir).select("event_id", "event_type", "value")
    return rounded(g.group_scan(df, "value", "event_type", func=rise, order="event_id").select("event_id", "value_rise"), "value_rise")


# User-defined aggregations --------------------------------------------------------------------------------------------


@query("SELECT event_type, round(sum(value * value) / sum(value), 6) AS value_weighted FROM events GROUP BY 1")
def udaf_algebraic(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = g.GroupAgg("weighted", {"s": lambda m: F.sum(m.valid), "ss": lambda m: F.sum(m.valid * m.valid)}, lambda p: p["ss"] / p["s"])
    return rounded(g.group_reduce(events(spark, sf_dir), "value", "event_type", func=weighted), "value_weighted")


@query(f"SELECT event_type, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS v_iqr FROM (SELECT event_type, {GAPS} AS v FROM events) GROUP BY 1")
def udaf_holistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    iqr = g.HolisticAgg("iqr", lambda s: float(s.quantile(0.75) - s.quantile(0.25)) if len(s) else math.nan)
    return rounded(g.group_reduce(events(spark, sf_dir).select("event_type", "v"), "v", "event_type", func=iqr), "v_iqr")


# Arrays, datasets, sparse arrays ----------------------------------------------------------------------------------------


@query("""SELECT label, (i - 1)::INTEGER AS pos, round(avg(embedding[i]::DOUBLE), 5) AS value_nanmean, count(embedding[i]) AS value_count FROM embeddings, generate_series(1, 64) s(i) GROUP BY 1, 2""")
def array_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return rounded(g.reduce_elementwise(df, "embedding", "label", func=["nanmean", "count"]), "value_nanmean", places=5)


@query("""SELECT event_type, round(avg(value), 6) AS value_nanmean, max(user_id) AS user_id_nanmax_check FROM events GROUP BY 1""".replace("max(user_id) AS user_id_nanmax_check", "round(avg(user_id), 6) AS user_id_nanmean"))
def dataset_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    return rounded(g.Dataset(df, ["event_id"], ["value", "user_id"]).reduce("event_type", func="mean", skipna=True), "value_nanmean", "user_id_nanmean")


@query("""SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice_nansum FROM lineitem GROUP BY 1""")
def dataset_plain_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = g.Dataset(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_extendedprice"])
    return rounded(data.reduce(func="nansum", dim="l_orderkey"), "l_extendedprice_nansum", places=2)


@query("""WITH s AS (SELECT DISTINCT o_orderstatus FROM orders), p AS (SELECT DISTINCT o_orderpriority FROM orders)
SELECT p.o_orderpriority, s.o_orderstatus, count(o.o_totalprice) AS o_totalprice_count, length(p.o_orderpriority) AS weight FROM s CROSS JOIN p LEFT JOIN orders o USING (o_orderstatus, o_orderpriority) GROUP BY 1, 2""")
def dataset_lacking_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    weights = orders.select("o_orderpriority").distinct().withColumn("weight", F.char_length("o_orderpriority").cast("bigint"))
    data = g.Dataset(orders, ["o_orderkey", "o_orderpriority"], ["o_totalprice"], {"weight": (weights, ["o_orderpriority"])})
    return data.reduce("o_orderstatus", func="count", dim="o_orderkey", dense=True, min_count=0)


def _sparse(name: str, implicit: float, result: str) -> None:
    sql = f"""WITH c AS (SELECT event_type, value FROM events WHERE event_id % 3 = 0), z AS (SELECT event_type, count(*) AS size FROM events GROUP BY 1),
s AS (SELECT event_type, sum(value) AS s, min(value) AS lo, max(value) AS hi, count(*) AS n FROM c GROUP BY 1)
SELECT event_type, {result} AS value_{name} FROM z LEFT JOIN s USING (event_type)"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        every = load(spark, sf_dir, "events")
        sizes = every.groupBy("event_type").agg(F.count(F.lit(1)).alias("size"))
        found = g.sparse_reduce(every.filter("event_id % 3 = 0"), "value", ["event_type"], sizes, name, implicit)
        return found if name == "nanlen" else rounded(found, f"value_{name}")

    query(sql, f"sparse_{name}")(run)


for _name, _implicit, _result in (
    ("sum", 2.5, "round(s + (size - n) * 2.5, 6)"), ("nansum", 2.5, "round(s + (size - n) * 2.5, 6)"), ("mean", 2.5, "round((s + (size - n) * 2.5) / size, 6)"), ("nanmean", math.nan, "round(s / n, 6)"),
    ("max", 0.0, "round(greatest(hi, 0.0), 6)"), ("nanmax", math.nan, "round(hi, 6)"), ("min", 0.0, "round(least(lo, 0.0), 6)"), ("nanmin", math.nan, "round(lo, 6)"), ("nanlen", math.nan, "n"),
):
    _sparse(_name, _implicit, _result)


# Layouts ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_nansum FROM orders GROUP BY 1")
def layout_blockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.blockwise(load(spark, sf_dir, "orders"), "o_orderpriority")
    return rounded(g.group_reduce(placed, "o_totalprice", "o_orderpriority", func="nansum"), "o_totalprice_nansum", places=2)


@query("SELECT event_id, (sum(CASE WHEN event_id % 100 IN (0, 30) THEN 1 ELSE 0 END) OVER (ORDER BY event_id))::BIGINT AS chunk FROM events")
def layout_chunk_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).alias("phase"))
    return layout.chunk_starts(df, "event_id", "phase", [0, 30]).select("event_id", "chunk")


@query("""WITH c AS (SELECT event_id, sum(CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS start FROM events)
SELECT event_id, start::BIGINT AS start, ((row_number() OVER (PARTITION BY start ORDER BY event_id) - 1) // 40)::BIGINT AS nth FROM c""")
def layout_chunk_starts_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).alias("phase"))
    return layout.chunk_starts(df, "event_id", "phase", [0], every=40).select("event_id", "chunk.start", "chunk.nth")


_COHORT = "WITH h AS (SELECT user_id, list_sort(list(DISTINCT event_id // 500)) AS chunks FROM events GROUP BY 1)"


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 500).alias("chunk"))


@query(_COHORT + " SELECT array_to_string(list_sort(list(user_id)), ',') AS labels, array_to_string(chunks, ',') AS chunks FROM h GROUP BY chunks")
def layout_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.cohorts(_chunked(spark, sf_dir), "user_id", "chunk")
    return found.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("labels", "chunks")])


@query("""WITH p AS (SELECT DISTINCT o_custkey AS label, o_orderkey // 100 AS c FROM orders), z AS (SELECT label, count(*) AS n FROM p GROUP BY 1),
m AS (SELECT a.label, b.label AS "within", count(*) / any_value(z.n) AS share FROM p a JOIN p b ON a.c = b.c AND a.label <> b.label JOIN z ON z.label = a.label GROUP BY 1, 2 HAVING count(*) / any_value(z.n) >= 0.4),
u AS (SELECT m.label, m."within" FROM m JOIN z l ON l.label = m.label JOIN z w ON w.label = m."within" WHERE w.n > l.n OR (w.n = l.n AND m."within" < m.label)
  QUALIFY row_number() OVER (PARTITION BY m.label ORDER BY w.n DESC, m.share DESC, m."within") = 1),
t AS (SELECT z.label, coalesce(u."within", z.label) AS cohort FROM z LEFT JOIN u USING (label)),
f AS (SELECT t.label, coalesce(a.cohort, t.cohort) AS cohort FROM t LEFT JOIN t a ON a.label = t.cohort)
SELECT cohort, array_to_string(list_sort(list(label)), ',') AS labels FROM f GROUP BY 1""")
def layout_merged_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 100).alias("chunk"))
    found = layout.merged_cohorts(df, "o_custkey", "chunk", least=0.4)
    return found.select("cohort", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query("""WITH p AS (SELECT DISTINCT user_id, event_id // 500 AS c FROM events), z AS (SELECT user_id, count(*) AS n FROM p GROUP BY 1)
SELECT a.user_id AS label, b.user_id AS "within", round(count(*) / any_value(z.n), 6) AS containment FROM p a JOIN p b ON a.c = b.c AND a.user_id <> b.user_id JOIN z ON z.user_id = a.user_id
GROUP BY 1, 2 HAVING count(*) / any_value(z.n) >= 0.75""")
def layout_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layout.containment(_chunked(spark, sf_dir), "user_id", "chunk"), "containment")


@query("""WITH p AS (SELECT DISTINCT user_id, event_id // 500 AS c FROM events), z AS (SELECT user_id, count(*) AS n FROM p GROUP BY 1), t AS (SELECT count(*) AS n_labels, max(n) AS most_chunks, sum(n) AS n_pairs, (SELECT count(DISTINCT c) FROM p) AS n_chunks FROM z)
SELECT n_labels, n_chunks, most_chunks, round((n_pairs / (n_labels * n_chunks))::DOUBLE, 6) AS density, CASE WHEN most_chunks <= 1 THEN 'blockwise' WHEN n_chunks > 1 AND n_pairs / (n_labels * n_chunks) < 0.4 THEN 'cohorts' ELSE 'map-reduce' END AS strategy FROM t""")
def layout_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layout.strategy(_chunked(spark, sf_dir), "user_id", "chunk"), "density")
