"""Registered queries of the analytics operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrowick.functions import datetimes as dt
from ferrowick.functions import math as m
from ferrowick.functions import strings as st
from ferrowick.operators import relational as rel
from ferrowick.operators.indexed import set_index
from ferrowick.operators.scan import Ordered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of a directory by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


def column(name: str, table: str, keys: str, value: Callable[[], Column], sql: str) -> None:
    """A query of key columns and one computed column ``v``."""
    ks = keys.split()
    add(name, lambda t: getattr(t, table).select(*ks, value().alias("v")), f"SELECT {', '.join(ks)}, {sql} AS v FROM {table}")


# ---------------------------------------------------------------- flagship

FLAGSHIP_SQL = """SELECT c_mktsegment, round(sum(o_totalprice * 0.9 + c_acctbal), 2) AS sum_net, round(avg(o_totalprice - c_acctbal), 4) AS mean_gap,
min(o_totalprice) AS min_price, max(o_totalprice) AS max_price, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    orders = t.orders.where(F.col("o_totalprice") > 1000).select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    j = rel.merge(orders, t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), on="c_custkey", null_equal=False)
    j = j.withColumns({"net": F.col("o_totalprice") * 0.9 + F.col("c_acctbal"), "gap": F.col("o_totalprice") - F.col("c_acctbal")})
    out = rel.group_by(j, "c_mktsegment").agg(sum_net=("sum", "net"), mean_gap=("mean", "gap"), min_price=("min", "o_totalprice"), max_price=("max", "o_totalprice"), n=("size", "net"))
    return out.withColumns({"sum_net": F.round("sum_net", 2), "mean_gap": F.round("mean_gap", 4)})


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = FLAGSHIP_SQL

# ---------------------------------------------------------------- elementwise

for name, f, sql in (
    ("add", lambda: m.add("l_extendedprice", "l_tax"), "l_extendedprice + l_tax"),
    ("sub", lambda: m.sub("l_extendedprice", "l_discount"), "l_extendedprice - l_discount"),
    ("mul", lambda: m.mul("l_extendedprice", "l_discount"), "l_extendedprice * l_discount"),
    ("div", lambda: m.fdiv("l_extendedprice", "l_quantity"), "l_extendedprice / l_quantity"),
    ("reverse_sub", lambda: m.sub(1, "l_discount"), "1 - l_discount"),
    ("chained_expr", lambda: F.round((F.col("l_extendedprice") + F.col("l_tax")) * F.col("l_quantity") - F.col("l_discount"), 6), "round((l_extendedprice + l_tax) * l_quantity - l_discount, 6)"),
    ("neg", lambda: m.UNARY["neg"]("l_extendedprice"), "-l_extendedprice"),
    ("floordiv", lambda: m.floordiv("l_extendedprice", 7), "floor(l_extendedprice / 7)"),
    ("mod", lambda: F.round(m.mod("l_extendedprice", 7.0), 6), "round(l_extendedprice % 7, 6)"),
    ("int_div", lambda: m.int_div("l_partkey", 7), "l_partkey // 7"),
    ("python_mod", lambda: m.pmod(F.col("l_partkey") - 100, 7), "((l_partkey - 100) % 7 + 7) % 7"),
    ("pow", lambda: F.round(m.power("l_quantity", 2), 6), "round(pow(l_quantity, 2), 6)"),
):
    column(f"elementwise_{name}", "lineitem", "l_orderkey l_partkey l_linenumber", f, sql)
add("elementwise_div_zero", lambda t: t.events.select("event_id", m.fdiv(F.col("value"), F.col("event_id") % 3).alias("v")),
    "SELECT event_id, value::DOUBLE / (event_id % 3)::DOUBLE AS v FROM events")
add("elementwise_frame_scalar", lambda t: rel.apply_columns(t.events.select("event_id", "user_id", "value"), lambda c: c + 1, ["user_id", "value"]),
    "SELECT event_id, user_id + 1 AS user_id, value + 1 AS value FROM events")
add("multi_column_fusion", lambda t: t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount", "l_tax").withColumns({
        "net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6), "gross": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6)}).drop("l_discount", "l_tax"),
    "SELECT l_orderkey, l_extendedprice, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem")
E8 = "((a + b) * c - d) / (b + 1) + a * 0.5 - c * d"
add("fused_8_op", lambda t: t.lineitem.selectExpr("l_orderkey", "l_quantity a", "l_tax b", "l_discount c", "l_extendedprice d").select("l_orderkey", F.round(F.expr(E8), 6).alias("v")),
    f"SELECT l_orderkey, round({E8}, 6) AS v FROM (SELECT l_orderkey, l_quantity AS a, l_tax AS b, l_discount AS c, l_extendedprice AS d FROM lineitem)")

DOMAIN = {"asin": "value / 1000", "acos": "value / 1000", "exp": "value / 100", "sinh": "value / 100", "cosh": "value / 100"}
SQL_UNARY = {"log": "ln({})", "round": "round_even({}, 0)", "neg": "-({})", "trunc": "trunc({})"}
for name, f in m.UNARY.items():
    x = DOMAIN.get(name, "value - 250" if name in ("abs", "neg", "ceil", "floor", "trunc", "cbrt", "round") else "value")
    column(f"math_{name}", "events", "event_id", lambda f=f, x=x: F.round(f(F.expr(x)), 6) + F.lit(0.0), f"round({SQL_UNARY.get(name, name + '({})').format(x)}, 6) + 0.0::DOUBLE")
column("math_round_digits", "events", "event_id", lambda: m.rint(F.floor(F.col("value")) / 8, 2), "round_even(floor(value) / 8, 2)")

# ---------------------------------------------------------------- comparison, logic, selection

HOLES = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"
for name, sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    column(f"compare_{name}", "events", "event_id", lambda name=name: getattr(m, name)(F.round(F.expr(HOLES), 0), 100.0), f"coalesce(round({HOLES}, 0) {sign} 100, {'true' if name == 'ne' else 'false'})")
for name, f, sql in (
    ("logical_and", lambda: (F.col("value") > 100) & (F.col("user_id") < 50), "value > 100 AND user_id < 50"),
    ("logical_or", lambda: (F.col("value") > 100) | (F.col("user_id") < 50), "value > 100 OR user_id < 50"),
    ("logical_not", lambda: ~(F.col("value") > 100), "NOT value > 100"),
    ("isin", lambda: m.isin("user_id", [1, 5, 7, 11]), "user_id IN (1, 5, 7, 11)"),
    ("between", lambda: m.between(F.expr(HOLES), 50.0, 150.0), f"coalesce({HOLES} BETWEEN 50 AND 150, false)"),
    ("where", lambda: m.where("value", F.col("value") > 100, -1.0), "CASE WHEN value > 100 THEN value ELSE -1.0::DOUBLE END"),
    ("mask", lambda: m.mask("value", F.col("value") > 100), "CASE WHEN value > 100 THEN NULL ELSE value END"),
    ("clip", lambda: m.clip(F.expr(HOLES), 20.0, 300.0), f"CASE WHEN {HOLES} IS NOT NULL THEN least(greatest({HOLES}, 20.0::DOUBLE), 300.0::DOUBLE) END"),
    ("fillna", lambda: m.fillna(F.expr(HOLES), -1.0), f"coalesce({HOLES}, -1.0::DOUBLE)"),
    ("isna", lambda: F.expr(HOLES).isNull(), f"{HOLES} IS NULL"),
    ("notna", lambda: F.expr(HOLES).isNotNull(), f"{HOLES} IS NOT NULL"),
    ("astype", lambda: F.col("user_id").cast("string"), "CAST(user_id AS VARCHAR)"),
):
    column(f"select_{name}", "events", "event_id", f, sql)
add("select_columns", lambda t: t.orders.select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders")
add("bool_filter", lambda t: t.lineitem.where((F.col("l_quantity") > 40) & (F.col("l_discount") < 0.03)), "SELECT * FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.03")
add("bool_filter_null_mask", lambda t: t.events.where(F.expr(HOLES) > 100).select("event_id", "value"), f"SELECT event_id, value FROM events WHERE {HOLES} > 100")
add("multi_predicate", lambda t: t.orders.where("o_orderstatus = 'O' and o_totalprice between 1000 and 90000 and o_orderpriority like '1%'").select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority LIKE '1%'")
add("query_expr", lambda t: t.events.where("value > 200 and event_type in ('click', 'view')").select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE value > 200 AND event_type IN ('click', 'view')")
add("take_positions", lambda t: rel.take(t.events.select("event_id", "value"), "event_id", [3, 0, 77, 4999]), "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p IN (3, 0, 77, 4999)")
add("slice_rows", lambda t: rel.slice_rows(t.events.select("event_id", "value"), "event_id", 100, 150), "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p >= 100 AND p < 150")

# ---------------------------------------------------------------- reductions

for name, op, c, sql in (
    ("sum", "sum", "value", "round(sum(value), 4)"), ("min", "min", "value", "min(value)"), ("max", "max", "value", "max(value)"), ("mean", "mean", "value", "round(avg(value), 6)"),
    ("count", "count", "value", "count(value)"), ("nunique", "nunique", "user_id", "count(DISTINCT user_id)"), ("std", "std", "value", "round(stddev_samp(value), 6)"), ("var", "var", "value", "round(var_samp(value), 4)"),
    ("median", "median", "value", "round(median(value), 6)"), ("sum_int", "sum", "user_id", "CAST(sum(user_id) AS BIGINT)"), ("mean_int", "mean", "user_id", "round(avg(user_id), 6)"),
    ("min_string", "min", "event_type", "min(event_type)"), ("max_datetime", "max", "ts", "max(ts)"), ("min_datetime", "min", "ts", "min(ts)"),
):
    digits = {"sum": 4, "var": 4}.get(name, 6)
    rounded = sql.startswith("round")
    add(f"reduce_{name}", lambda t, op=op, c=c, d=digits, r=rounded: (lambda x: x.withColumn("v", F.round("v", d)) if r else x)(rel.reduce(t.events, v=(op, c))), f"SELECT {sql} AS v FROM events")
add("reduce_with_nulls", lambda t: rel.reduce(t.events.withColumn("h", F.expr(HOLES)), s=("sum", "h"), a=("mean", "h"), n=("count", "h"), lo=("min", "h"), hi=("max", "h")).withColumns({"s": F.round("s", 4), "a": F.round("a", 6)}),
    f"SELECT round(sum(h), 4) AS s, round(avg(h), 6) AS a, count(h) AS n, min(h) AS lo, max(h) AS hi FROM (SELECT {HOLES} AS h FROM events)")
add("reduce_all_null", lambda t: rel.reduce(t.events.where("value < 0"), s=("sum", "value"), lo=("min", "value"), n=("count", "value")), "SELECT sum(value) AS s, min(value) AS lo, count(value) AS n FROM events WHERE value < 0")
add("reduce_min_count_0", lambda t: rel.reduce(t.events.where("value < 0"), min_count=0, s=("sum", "value")), "SELECT coalesce(sum(value), 0.0::DOUBLE) AS s FROM events WHERE value < 0")
add("fused_sum_expr", lambda t: rel.reduce(t.lineitem, v=("sum", (F.col("l_extendedprice") + F.col("l_tax")) * F.col("l_quantity") - F.col("l_discount"))).select(F.round("v", 1).alias("v")),
    "SELECT round(sum((l_extendedprice + l_tax) * l_quantity - l_discount), 1) AS v FROM lineitem")
add("fused_mean_expr", lambda t: rel.reduce(t.lineitem, v=("mean", F.col("l_extendedprice") * (1 - F.col("l_discount")))).select(F.round("v", 6).alias("v")), "SELECT round(avg(l_extendedprice * (1 - l_discount)), 6) AS v FROM lineitem")
add("fused_minmax_expr", lambda t: rel.reduce(t.lineitem, lo=("min", F.col("l_extendedprice") * F.col("l_tax")), hi=("max", F.col("l_extendedprice") * F.col("l_tax"))), "SELECT min(l_extendedprice * l_tax) AS lo, max(l_extendedprice * l_tax) AS hi FROM lineitem")
for q in (0.1, 0.25, 0.9):
    add(f"quantile_{int(q * 100)}", lambda t, q=q: rel.quantile(t.events, "value", q, "v").select(F.round("v", 6).alias("v")), f"SELECT round(quantile_cont(value, {q}), 6) AS v FROM events")
add("describe", lambda t: (lambda d: d.select("count", *[F.round(c, 5).alias(c) for c in d.columns[1:]]))(rel.describe(t.events, "value")),
    "SELECT count(value) AS count, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(min(value), 5) AS min, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.5), 5) AS q50, round(quantile_cont(value, 0.75), 5) AS q75, round(max(value), 5) AS max FROM events")
add("corr", lambda t: rel.corr(t.lineitem, "l_extendedprice", "l_quantity", "v").select(F.round("v", 6).alias("v")), "SELECT round(corr(l_extendedprice, l_quantity), 6) AS v FROM lineitem")
add("cov", lambda t: rel.cov(t.lineitem, "l_extendedprice", "l_quantity", "v").select(F.round("v", 3).alias("v")), "SELECT round(covar_samp(l_extendedprice, l_quantity), 3) AS v FROM lineitem")
add("idxmin", lambda t: rel.idxmin(t.events, "event_id", "user_id", "v"), "SELECT min(event_id) AS v FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
add("idxmax", lambda t: rel.idxmax(t.events, "event_id", "user_id", "v"), "SELECT min(event_id) AS v FROM events WHERE user_id = (SELECT max(user_id) FROM events)")
add("value_counts", lambda t: rel.value_counts(t.events, "event_type"), "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
add("unique", lambda t: t.events.select("user_id").distinct(), "SELECT DISTINCT user_id FROM events")
add("timedelta_sum", lambda t: dt.total_micros(t.events, dt.difference("ts", F.lit("2020-01-01").cast("timestamp_ntz"))), "SELECT CAST(sum(epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) AS BIGINT) AS v FROM events")

# ---------------------------------------------------------------- group-by

GROUPS = {"int_key": ("part", "p_size", "p_retailprice"), "string_key": ("events", "event_type", "value"), "float_key": ("lineitem", "l_discount", "l_quantity"), "high_cardinality": ("orders", "o_custkey", "o_totalprice")}
for label, (table, k, v) in GROUPS.items():
    for op, sql in (("sum", "round(sum({v}), 3)"), ("mean", "round(avg({v}), 6)"), ("min", "min({v})"), ("max", "max({v})"), ("count", "count({v})")):
        d = {"sum": 3, "mean": 6}.get(op)
        add(f"groupby_{op}_{label}", lambda t, table=table, k=k, v=v, op=op, d=d: (lambda g: g.withColumn("v", F.round("v", d)) if d else g)(rel.group_by(getattr(t, table), k).agg(v=(op, v))),
            f"SELECT {k}, {sql.format(v=v)} AS v FROM {table} GROUP BY {k}")
NULLKEY = "CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END"
add("groupby_null_keys", lambda t: rel.group_by(t.events.withColumn("k", F.expr(NULLKEY)), "k").agg(v=("count", "value")), f"SELECT k, count(value) AS v FROM (SELECT {NULLKEY} AS k, value FROM events) WHERE k IS NOT NULL GROUP BY k")
add("groupby_keep_null_keys", lambda t: rel.group_by(t.events.withColumn("k", F.expr(NULLKEY)), "k", dropna=False).agg(v=("count", "value")), f"SELECT k, count(value) AS v FROM (SELECT {NULLKEY} AS k, value FROM events) GROUP BY k")
NULLVAL = "CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END"
add("groupby_null_values", lambda t: rel.group_by(t.events.withColumn("h", F.expr(NULLVAL)), "user_id").agg(s=("sum", "h"), n=("count", "h"), lo=("min", "h")).withColumn("s", F.round("s", 4)), f"SELECT user_id, round(sum(h), 4) AS s, count(h) AS n, min(h) AS lo FROM (SELECT user_id, {NULLVAL} AS h FROM events) GROUP BY user_id")
add("groupby_multi_agg", lambda t: rel.group_by(t.lineitem, "l_returnflag").agg(s=("sum", "l_quantity"), a=("mean", "l_extendedprice"), lo=("min", "l_tax"), hi=("max", "l_tax"), n=("count", "l_tax"), d=("std", "l_quantity"), u=("nunique", "l_partkey")).withColumns({"a": F.round("a", 5), "d": F.round("d", 6)}),
    "SELECT l_returnflag, sum(l_quantity) AS s, round(avg(l_extendedprice), 5) AS a, min(l_tax) AS lo, max(l_tax) AS hi, count(l_tax) AS n, round(stddev_samp(l_quantity), 6) AS d, count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY l_returnflag")
add("groupby_multi_key", lambda t: rel.group_by(t.lineitem, ["l_returnflag", "l_linestatus"]).agg(s=("sum", "l_quantity"), n=("size", "l_tax")), "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
add("groupby_all_columns", lambda t: rel.group_by(t.part.select("p_brand", "p_size", "p_retailprice"), "p_brand").all("max"), "SELECT p_brand, max(p_size) AS p_size, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand")
add("groupby_transform", lambda t: rel.group_by(t.events.select("event_id", "user_id", "value"), "user_id").transform("total", "sum", "value").withColumn("total", F.round("total", 4)), "SELECT event_id, user_id, value, round(sum(value) OVER (PARTITION BY user_id), 4) AS total FROM events")
add("groupby_transform_dropna", lambda t: rel.group_by(t.events.select("event_id", F.expr(NULLKEY).alias("k"), "value"), "k").transform("total", "max", "value"), f"SELECT event_id, k, value, CASE WHEN k IS NOT NULL THEN max(value) OVER (PARTITION BY k) END AS total FROM (SELECT event_id, {NULLKEY} AS k, value FROM events)")
add("groupby_transform_null_keys", lambda t: rel.group_by(t.events.select("event_id", F.expr(NULLKEY).alias("k"), "value"), "k", dropna=False).transform("total", "max", "value"), f"SELECT event_id, k, value, max(value) OVER (PARTITION BY k) AS total FROM (SELECT event_id, {NULLKEY} AS k, value FROM events)")
for op, agg in (("std", "round(stddev_samp(value), 6)"), ("var", "round(var_samp(value), 4)"), ("nunique", "count(DISTINCT value)"), ("first", "arg_min(value, event_id)"), ("last", "arg_max(value, event_id)"), ("size", "count(*)")):
    d = {"std": 6, "var": 4}.get(op)
    add(f"groupby_{op}", lambda t, op=op, d=d: (lambda g: g.withColumn("v", F.round("v", d)) if d else g)(rel.group_by(t.events, "user_id", order="event_id").agg(v=(op, "value"))), f"SELECT user_id, {agg} AS v FROM events GROUP BY user_id")
add("groupby_sorted", lambda t: rel.group_by(t.events, "user_id", sort=True).agg(v=("max", "value")), "SELECT user_id, max(value) AS v FROM events GROUP BY user_id ORDER BY user_id")
add("groupby_agg_list", lambda t: rel.group_by(t.part.select("p_brand", "p_size", "p_retailprice"), "p_brand").agg(["min", "max", "count"]), "SELECT p_brand, min(p_size) AS p_size_min, max(p_size) AS p_size_max, count(p_size) AS p_size_count, min(p_retailprice) AS p_retailprice_min, max(p_retailprice) AS p_retailprice_max, count(p_retailprice) AS p_retailprice_count FROM part GROUP BY p_brand")
add("groupby_agg_dict", lambda t: rel.group_by(t.part, "p_brand").agg({"p_size": ["min", "nunique"], "p_retailprice": "max"}), "SELECT p_brand, min(p_size) AS p_size_min, count(DISTINCT p_size) AS p_size_nunique, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand")
add("groupby_level", lambda t: set_index(t.events.select("user_id", "event_type", "value"), ["user_id", "event_type"]).group_by([0, "event_type"]).agg(v=("max", "value")), "SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL")
add("groupby_median", lambda t: rel.group_by(t.events, "event_type").agg(v=("median", "value")).withColumn("v", F.round("v", 6)), "SELECT event_type, round(median(value), 6) AS v FROM events GROUP BY event_type")
add("groupby_min_datetime", lambda t: rel.group_by(t.events, "event_type").agg(lo=("min", "ts"), hi=("max", "ts")), "SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY event_type")

# ---------------------------------------------------------------- joins

# keys are doubled, and made odd for some rows of either side, so that part of them has no match
ODD = "2 * {0} + CASE WHEN {0} % {1} = 0 THEN 1 ELSE 0 END"
odd = lambda key, n: F.expr(ODD.format(key, n))
CUST = lambda t: t.customer.select(odd("c_custkey", 5).alias("k"), "c_name", "c_acctbal")
ORD = lambda t: t.orders.select(odd("o_custkey", 7).alias("k"), "o_orderkey", "o_totalprice")
C_SQL, O_SQL = f"(SELECT {ODD.format('c_custkey', 5)} AS k, c_name, c_acctbal FROM customer) c", f"(SELECT {ODD.format('o_custkey', 7)} AS k, o_orderkey, o_totalprice FROM orders) o"
for how, sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    add(f"merge_{how}", lambda t, how=how: rel.merge(CUST(t), ORD(t), how, "k"), f"SELECT coalesce(c.k, o.k) AS k, c_name, c_acctbal, o_orderkey, o_totalprice FROM {C_SQL} {sql} {O_SQL} ON c.k = o.k")
add("merge_semi", lambda t: rel.merge(CUST(t), ORD(t), "semi", "k"), f"SELECT * FROM {C_SQL} WHERE EXISTS (SELECT 1 FROM {O_SQL} WHERE o.k = c.k)")
add("merge_anti", lambda t: rel.merge(CUST(t), ORD(t), "anti", "k"), f"SELECT * FROM {C_SQL} WHERE NOT EXISTS (SELECT 1 FROM {O_SQL} WHERE o.k = c.k)")
add("merge_left_on_right_on", lambda t: rel.merge(t.customer.select("c_custkey", "c_name"), t.orders.select("o_custkey", "o_orderkey"), left_on="c_custkey", right_on="o_custkey"), "SELECT c_custkey, c_name, o_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
add("merge_suffixes", lambda t: rel.merge(t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name")), t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), on="k"), "SELECT n_regionkey AS k, n_name AS name_x, r_name AS name_y FROM nation JOIN region ON n_regionkey = r_regionkey")
add("merge_many_to_many", lambda t: rel.merge(t.supplier.select(F.col("s_nationkey").alias("n"), "s_suppkey"), t.customer.select(F.col("c_nationkey").alias("n"), "c_custkey"), on="n"), "SELECT s_nationkey AS n, s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
add("merge_multi_key", lambda t: rel.merge(t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_quantity"), t.lineitem.groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.count("*").alias("n")), on=["a", "b"]), "SELECT l_partkey AS a, l_suppkey AS b, l_quantity, n FROM lineitem JOIN (SELECT l_partkey AS pa, l_suppkey AS sb, count(*) AS n FROM lineitem GROUP BY ALL) ON l_partkey = pa AND l_suppkey = sb")
add("merge_string_key", lambda t: rel.merge(t.part.select(F.col("p_brand").alias("b"), "p_partkey"), t.part.groupBy(F.col("p_brand").alias("b")).agg(F.max("p_size").alias("hi")), on="b"), "SELECT p_brand AS b, p_partkey, hi FROM part JOIN (SELECT p_brand AS bb, max(p_size) AS hi FROM part GROUP BY p_brand) ON p_brand = bb")
add("merge_inferred_columns", lambda t: rel.merge(CUST(t), ORD(t)), f"SELECT c.k, c_name, c_acctbal, o_orderkey, o_totalprice FROM {C_SQL} JOIN {O_SQL} ON c.k = o.k")
NK = "CASE WHEN {0} % 3 = 0 THEN NULL ELSE {0} END"
add("merge_null_safe", lambda t: rel.merge(t.nation.select(F.expr(NK.format("n_nationkey")).alias("k"), "n_name"), t.region.select(F.expr(NK.format("r_regionkey")).alias("k"), "r_name"), on="k"),
    f"SELECT a.k, n_name, r_name FROM (SELECT {NK.format('n_nationkey')} AS k, n_name FROM nation) a JOIN (SELECT {NK.format('r_regionkey')} AS k, r_name FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
add("merge_cross", lambda t: rel.merge(t.nation.select("n_name"), t.region.select("r_name"), "cross"), "SELECT n_name, r_name FROM nation CROSS JOIN region")
add("combine_first", lambda t: rel.combine_first(t.events.select(odd("event_id", 5).alias("k"), F.expr(HOLES).alias("value")), t.events.select(odd("event_id", 7).alias("k"), (F.col("value") * 2).alias("value")), "k"),
    f"SELECT coalesce(a.k, b.k) AS k, coalesce(a.value, b.value) AS value FROM (SELECT {ODD.format('event_id', 5)} AS k, {HOLES} AS value FROM events) a FULL JOIN (SELECT {ODD.format('event_id', 7)} AS k, value * 2 AS value FROM events) b ON a.k = b.k")
add("elementwise_frame_frame", lambda t: rel.align(t.orders.select(odd("o_orderkey", 5).alias("k"), "o_totalprice"), t.orders.select(odd("o_orderkey", 7).alias("k"), "o_totalprice"), "k", lambda a, b: a + b, ["o_totalprice"]),
    f"SELECT coalesce(a.k, b.k) AS k, a.o_totalprice + b.o_totalprice AS o_totalprice FROM (SELECT {ODD.format('o_orderkey', 5)} AS k, o_totalprice FROM orders) a FULL JOIN (SELECT {ODD.format('o_orderkey', 7)} AS k, o_totalprice FROM orders) b ON a.k = b.k")

# ---------------------------------------------------------------- ordered operators

ev = lambda t: Ordered(t.events.select("event_id", F.expr(HOLES).alias("h")), "event_id")
E_SQL = f"(SELECT event_id, {HOLES} AS h FROM events)"
H = lambda: F.col("h")


def ordered(name: str, f: Callable[[Ordered], DataFrame], sql: str, digits: int | None = None, out: str = "v") -> None:
    r = (lambda d: d.withColumn(out, m.round_away(out, digits))) if digits is not None else (lambda d: d)
    s = f"round({sql}, {digits})" if digits is not None else sql
    add(name, lambda t: r(f(ev(t))), f"SELECT event_id, h, {s} AS v FROM {E_SQL}")


UP = "OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
for name, agg, digits in (("cumsum", "sum", 3), ("cummin", "min", None), ("cummax", "max", None)):
    ordered(name, lambda o, name=name: getattr(o, name)(H(), "v"), f"CASE WHEN h IS NOT NULL THEN {agg}(h) {UP} END", digits)
add("cumprod", lambda t: Ordered(t.events.select("event_id", (1 + F.col("value") / 1e6).alias("h")), "event_id").cumprod(H(), "v").select("event_id", F.round("v", 6).alias("v")),
    f"SELECT event_id, round(exp(sum(ln(1 + value / 1e6)) {UP}), 6) AS v FROM events")
ordered("ffill", lambda o: o.ffill(H(), "v"), f"last_value(h IGNORE NULLS) {UP}")
ordered("bfill", lambda o: o.bfill(H(), "v"), "first_value(h IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
ordered("ffill_limit", lambda o: o.ffill(H(), "v", limit=1), "last_value(h IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
ordered("shift_1", lambda o: o.shift(H(), 1, "v"), "lag(h, 1) OVER (ORDER BY event_id)")
ordered("shift_neg", lambda o: o.shift(H(), -2, "v"), "lead(h, 2) OVER (ORDER BY event_id)")
ordered("shift_fill", lambda o: o.shift(H(), 3, "v", fill=0.0), "lag(h, 3, 0.0::DOUBLE) OVER (ORDER BY event_id)")
ordered("diff", lambda o: o.diff(H(), 2, "v"), "h - lag(h, 2) OVER (ORDER BY event_id)", 6)
ordered("pct_change", lambda o: o.pct_change(H(), 1, "v"), "(h - lag(h) OVER (ORDER BY event_id)) / lag(h) OVER (ORDER BY event_id)", 6)
for how, agg in (("sum", "sum(h)"), ("mean", "avg(h)"), ("min", "min(h)"), ("max", "max(h)"), ("count", "count(h)"), ("std", "stddev_samp(h)"), ("var", "var_samp(h)"), ("median", "median(h)")):
    R = "OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    gate = f"count(*) {R} >= 3" if how == "count" else f"count(h) {R} >= 3"
    ordered(f"rolling_{how}", lambda o, how=how: o.rolling(H(), 5, how, 3, name="v"), f"CASE WHEN {gate} THEN {agg} {R} END", None if how in ("min", "max", "count") else 7)
ordered("rolling_min_periods_1", lambda o: o.rolling(H(), 4, "sum", 1, name="v"), "sum(h) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", 6)
ordered("rolling_center", lambda o: o.rolling(H(), 4, "max", 1, center=True, name="v"), "max(h) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
add("rank_average", lambda t: Ordered(t.events.select("event_id", "user_id"), "event_id").rank("user_id", "v"), "SELECT event_id, user_id, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0::DOUBLE AS v FROM events")
for name, up in (("argsort", True), ("argsort_desc", False)):
    add(name, lambda t, up=up: Ordered(t.events.select("event_id", F.expr(NULLKEY).alias("u")), "event_id").argsort("u", up),
        f"SELECT row_number() OVER (ORDER BY u {'ASC' if up else 'DESC'} NULLS LAST, p) - 1 AS rank, p AS position FROM (SELECT {NULLKEY} AS u, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events)")
for n in (-1, -3, 2):
    ordered(f"pct_change_{n}".replace("-", "neg_"), lambda o, n=n: o.pct_change(H(), n, "v"), f"(h - {'lag' if n > 0 else 'lead'}(h, {abs(n)}) OVER (ORDER BY event_id)) / {'lag' if n > 0 else 'lead'}(h, {abs(n)}) OVER (ORDER BY event_id)", 6)
ordered("diff_neg", lambda o: o.diff(H(), -2, "v"), "h - lead(h, 2) OVER (ORDER BY event_id)", 6)
ordered("rolling_apply", lambda o: o.rolling_apply(H(), 5, lambda a: F.array_max(a) - F.array_min(a), 2, "v"), "CASE WHEN count(h) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 2 THEN max(h) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - min(h) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END", 6)
FR = lambda t: Ordered(t.events.select("event_id", F.expr(HOLES).alias("h"), F.col("user_id").cast("double").alias("u")), "event_id")
FR_SQL = f"(SELECT event_id, {HOLES} AS h, user_id::DOUBLE AS u FROM events)"
for op, agg in (("sum", "sum"), ("min", "min"), ("max", "max")):
    add(f"frame_cum{op}", lambda t, op=op: FR(t).cumulative(op, ["h", "u"]).select("event_id", F.round("h", 3).alias("h"), "u"), f"SELECT event_id, round(CASE WHEN h IS NOT NULL THEN {agg}(h) {UP} END, 3) AS h, {agg}(u) {UP} AS u FROM {FR_SQL}")
for how, agg in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    W3 = "OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    add(f"frame_rolling_{how}", lambda t, how=how: FR(t).rolling_frame(["h", "u"], 3, how, 2).select("event_id", F.round("h", 6).alias("h"), F.round("u", 6).alias("u")),
        f"SELECT event_id, round(CASE WHEN count(h) {W3} >= 2 THEN {agg}(h) {W3} END, 6) AS h, round(CASE WHEN count(u) {W3} >= 2 THEN {agg}(u) {W3} END, 6) AS u FROM {FR_SQL}")

# ---------------------------------------------------------------- datetime

for name in ("year", "month", "day", "hour", "minute", "second", "dayofweek", "quarter", "dayofyear"):
    sql = {"dayofweek": "isodow(ts) - 1", "second": "CAST(floor(second(ts)) AS BIGINT)"}.get(name, f"{name}(ts)")
    column(f"dt_{name}", "events", "event_id", lambda name=name: dt.part(name, "ts"), sql)
BASE = lambda: F.lit("2020-01-01").cast("timestamp_ntz")
for name, f, sql in (
    ("dt_sub_dt", lambda: dt.micros(dt.difference("ts", BASE())), "epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')"),
    ("dt_add_delta", lambda: dt.shift_time("ts", F.expr("interval 36 hours")), "ts + INTERVAL 36 HOUR"),
    ("dt_sub_delta", lambda: dt.shift_time("ts", F.expr("interval 5 days"), -1), "ts - INTERVAL 5 DAY"),
    ("delta_add_delta", lambda: dt.micros((F.col("ts") - BASE()) + F.expr("interval 1 days")), "epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01') + 86400000000"),
    ("dt_compare", lambda: F.col("ts") > F.lit("2024-03-01").cast("timestamp_ntz"), "ts > TIMESTAMP '2024-03-01'"),
    ("dt_is_month_start", lambda: dt.is_month_start("ts"), "day(ts) = 1"),
    ("dt_is_month_end", lambda: dt.is_month_end("ts"), "ts::DATE = last_day(ts)"),
    ("dt_floor_hour", lambda: F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"), "date_trunc('hour', ts)"),
    ("dt_format", lambda: F.date_format("ts", "yyyy-MM-dd"), "strftime(ts, '%Y-%m-%d')"),
):
    column(name, "events", "event_id", f, sql)
add("dt_shift", lambda t: Ordered(t.events.select("event_id", "ts"), "event_id").shift(F.col("ts"), 1, "v"), "SELECT event_id, ts, lag(ts) OVER (ORDER BY event_id) AS v FROM events")

# ---------------------------------------------------------------- strings

SD = ("documents", "doc_id")
WSQ = "[ \\t\\n\\r\\v\\f]"
for name, table, key, f, sql in (
    ("contains", *SD, lambda: st.contains("text", "the"), "contains(text, 'the')"),
    ("contains_regex", *SD, lambda: st.contains("text", "[0-9]{3}", regex=True), "regexp_matches(text, '[0-9]{3}')"),
    ("startswith", *SD, lambda: st.startswith("text", "The"), "starts_with(text, 'The')"),
    ("endswith", *SD, lambda: st.endswith("text", "."), "suffix(text, '.')"),
    ("find", *SD, lambda: st.find("text", "en"), "instr(text, 'en') - 1"),
    ("lower", *SD, lambda: st.lower("text"), "lower(text)"),
    ("upper", "part", "p_partkey", lambda: st.upper("p_name"), "upper(p_name)"),
    ("casefold", "part", "p_partkey", lambda: st.casefold("p_type"), "lower(p_type)"),
    ("capitalize", "part", "p_partkey", lambda: st.capitalize("p_type"), "upper(left(p_type, 1)) || lower(substr(p_type, 2))"),
    ("strip", "part", "p_partkey", lambda: st.strip(F.concat(F.lit(" \t\n"), "p_name", F.lit(" \n"))), "p_name"),
    ("lstrip", "part", "p_partkey", lambda: st.lstrip(F.concat(F.lit(" \t\n"), "p_name", F.lit(" "))), "p_name || ' '"),
    ("rstrip", "part", "p_partkey", lambda: st.rstrip(F.concat(F.lit(" "), "p_name", F.lit(" \t\n"))), "' ' || p_name"),
    ("replace", *SD, lambda: st.replace("text", "the", "THE"), "replace(text, 'the', 'THE')"),
    ("replace_regex", *SD, lambda: st.replace("text", "[aeiou]+", "_", regex=True), "regexp_replace(text, '[aeiou]+', '_', 'g')"),
    ("len", *SD, lambda: st.length("text"), "length(text)"),
    ("count", *SD, lambda: st.count("text", "an"), "(length(text) - length(replace(text, 'an', ''))) // 2"),
    ("isalpha", "part", "p_partkey", lambda: st.is_class("isalpha", "p_brand"), "regexp_full_match(p_brand, '\\p{L}+')"),
    ("isdigit", "part", "p_partkey", lambda: st.is_class("isdigit", F.right("p_brand", F.lit(1))), "regexp_full_match(right(p_brand, 1), '[0-9]+')"),
    ("isspace", "part", "p_partkey", lambda: st.is_class("isspace", F.substring("p_name", 5, 1)), f"regexp_full_match(substr(p_name, 5, 1), '{WSQ}+')"),
    ("isalnum", "part", "p_partkey", lambda: st.is_class("isalnum", F.replace("p_brand", F.lit("#"), F.lit(""))), "regexp_full_match(replace(p_brand, '#', ''), '[\\p{L}\\p{N}]+')"),
    ("isupper", "part", "p_partkey", lambda: st.is_class("isupper", "p_type"), "regexp_matches(p_type, '\\p{Lu}') AND NOT regexp_matches(p_type, '[\\p{Ll}\\p{Lt}]')"),
    ("islower", "part", "p_partkey", lambda: st.is_class("islower", "p_name"), "regexp_matches(p_name, '\\p{Ll}') AND NOT regexp_matches(p_name, '[\\p{Lu}\\p{Lt}]')"),
    ("istitle", "part", "p_partkey", lambda: st.is_class("istitle", "p_brand"), "regexp_matches(p_brand, '\\p{L}') AND NOT regexp_matches(p_brand, '(^|[^\\p{L}])\\p{Ll}|\\p{L}\\p{Lu}')"),
    ("isnumeric", "part", "p_partkey", lambda: st.is_class("isnumeric", F.col("p_size").cast("string")), "regexp_full_match(p_size::VARCHAR, '\\p{N}+')"),
    ("isdecimal", "part", "p_partkey", lambda: st.is_class("isdecimal", "p_name"), "regexp_full_match(p_name, '\\p{Nd}+')"),
    ("slice", *SD, lambda: st.slice_("text", 3, 20), "text[4:20]"),
    ("slice_negative", *SD, lambda: st.slice_("text", -9, -2), "substr(text, greatest(length(text) - 9, 0) + 1, greatest(greatest(length(text) - 2, 0) - greatest(length(text) - 9, 0), 0))"),
    ("get", *SD, lambda: st.get("text", 40), "nullif(substr(text, 41, 1), '')"),
    ("get_negative", *SD, lambda: st.get("text", -1), "nullif(right(text, 1), '')"),
    ("repeat", "part", "p_partkey", lambda: st.repeat("p_name", 3), "repeat(p_name, 3)"),
    ("pad", "part", "p_partkey", lambda: st.pad("p_name", 30, "left", "*"), "lpad(p_name, greatest(30, length(p_name))::INT, '*')"),
    ("ljust", "part", "p_partkey", lambda: st.ljust("p_brand", 12, "-"), "rpad(p_brand, greatest(12, length(p_brand))::INT, '-')"),
    ("rjust", "part", "p_partkey", lambda: st.rjust("p_brand", 12), "lpad(p_brand, greatest(12, length(p_brand))::INT, ' ')"),
    ("center", "part", "p_partkey", lambda: st.center("p_brand", 13, "-"), "rpad(lpad(p_brand, (length(p_brand) + greatest(13 - length(p_brand), 0) // 2 + (greatest(13 - length(p_brand), 0) & 13 & 1))::INT, '-'), greatest(13, length(p_brand))::INT, '-')"),
    ("zfill", "part", "p_partkey", lambda: st.zfill(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")), 6), "CASE WHEN p_partkey % 2 = 0 THEN '-' || lpad(p_size::VARCHAR, 5, '0') ELSE lpad(p_size::VARCHAR, 6, '0') END"),
    ("removeprefix", "part", "p_partkey", lambda: st.removeprefix("p_brand", "Brand"), "CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) ELSE p_brand END"),
    ("removesuffix", "part", "p_partkey", lambda: st.removesuffix("p_brand", "1"), "CASE WHEN suffix(p_brand, '1') THEN left(p_brand, length(p_brand) - 1) ELSE p_brand END"),
    ("split", "part", "p_partkey", lambda: st.split_part("p_name", " ", 1), "string_split(p_name, ' ')[2]"),
    ("cat", "part", "p_partkey", lambda: st.cat("p_brand", "p_type", sep="/"), "p_brand || '/' || p_type"),
    ("compare", "part", "p_partkey", lambda: F.col("p_brand") < F.col("p_name"), "p_brand < p_name"),
    ("eq_scalar", "part", "p_partkey", lambda: m.eq("p_brand", F.lit("Brand#1")), "p_brand = 'Brand#1'"),
    ("swapcase", "part", "p_partkey", lambda: st.swapcase("p_brand"), "list_aggregate(list_transform(string_split(p_brand, ''), lambda x: CASE WHEN x = upper(x) THEN lower(x) ELSE upper(x) END), 'string_agg', '')"),
):
    column(f"str_{name}", table, key, f, sql)
column("str_title", "part", "p_partkey", lambda: st.title("p_name"), "list_aggregate(list_transform(regexp_extract_all(p_name, '\\p{L}+|\\P{L}+'), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), 'string_agg', '')")
add("str_groupby", lambda t: rel.group_by(t.documents, "lang").agg(n=("count", "text"), longest=("max", "n_chars")), "SELECT lang, count(text) AS n, max(n_chars) AS longest FROM documents GROUP BY lang")

# ---------------------------------------------------------------- order, limits, reshaping

# a result's rows are compared without their order, so each has its place in it beside it
for name, table, key, v, up in (
    ("sort_asc", "orders", "o_orderkey", "o_totalprice", True), ("sort_desc", "orders", "o_orderkey", "o_totalprice", False), ("str_sort", "customer", "c_custkey", "c_name", True), ("str_sort_ties", "part", "p_partkey", "p_brand", False),
    ("dt_sort", "events", "event_id", "ts", False), ("sort_nulls_last", "events", "event_id", HOLES, True), ("sort_nulls_last_desc", "events", "event_id", HOLES, False), ("sort_expr", "events", "event_id", "value * -1 + 3", True),
):
    add(name, lambda t, table=table, key=key, v=v, up=up: rel.sort_values(Ordered(getattr(t, table).select(key, F.expr(v).alias("v")), key).sorted_positions("v", up), ["v", key], [up, True]),
        f"SELECT {key}, v, row_number() OVER (ORDER BY v {'ASC' if up else 'DESC'} NULLS LAST, {key}) - 1 AS position FROM (SELECT {key}, {v} AS v FROM {table})")
# the bare sorts, without places: what the benchmark times
add("sort_rows", lambda t: rel.sort_values(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2, 1")
add("str_sort_rows", lambda t: rel.sort_values(t.customer.select("c_name"), "c_name"), "SELECT c_name FROM customer ORDER BY c_name")
add("head", lambda t: rel.head(t.events.select("event_id", "value"), "event_id", 20), "SELECT event_id, value FROM events ORDER BY event_id LIMIT 20")
add("tail", lambda t: rel.tail(t.events.select("event_id", "value"), "event_id", 20), "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 20")
add("sample", lambda t: rel.sample(t.events.select("event_id", "value"), "event_id", 50, 3), "SELECT event_id, value FROM events ORDER BY md5('3:' || event_id), event_id LIMIT 50")
add("concat_rows", lambda t: rel.concat(t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("a")), t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("b"))), "SELECT n_name AS name, n_nationkey AS a, NULL::INT AS b FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")
add("melt", lambda t: rel.melt(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_discount"), ["l_orderkey", "l_partkey", "l_linenumber"], ["l_tax", "l_discount"]), "SELECT l_orderkey, l_partkey, l_linenumber, 'l_tax' AS variable, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
add("pivot", lambda t: rel.pivot(t.events, "user_id", "event_type", "value", ["click", "view"], "count"), "SELECT user_id, count(value) FILTER (event_type = 'click') AS click, count(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
add("transpose", lambda t: rel.transpose(t.region.select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey") * 2).alias("a"), (F.col("r_regionkey") + 5).alias("b")), "k", [0, 1, 2], ["a", "b"]), "SELECT 'a' AS variable, 0 AS \"0\", 2 AS \"1\", 4 AS \"2\" UNION ALL SELECT 'b', 5, 6, 7")
add("drop_duplicates", lambda t: rel.drop_duplicates(t.events.select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id"), "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
add("duplicated", lambda t: rel.duplicated(t.events.select("event_id", "user_id"), ["user_id"], "event_id", "v"), "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS v FROM events")
add("dropna", lambda t: t.events.select("event_id", F.expr(HOLES).alias("h")).dropna(), f"SELECT event_id, {HOLES} AS h FROM events WHERE event_id % 3 <> 0")
add("drop_columns", lambda t: t.nation.drop("n_regionkey"), "SELECT n_nationkey, n_name FROM nation")
add("replace_values", lambda t: rel.replace_values(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open", "F": "done"}), "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
add("rename", lambda t: rel.rename(t.region, {"r_name": "name"}), "SELECT r_regionkey, r_name AS name FROM region")
add("select_dtypes", lambda t: rel.select_dtypes(t.customer, ["double", "bigint"]), "SELECT c_custkey, c_acctbal FROM customer")
add("insert_column", lambda t: rel.insert(t.nation, 1, "twice", F.col("n_nationkey") * 2), "SELECT n_nationkey, n_nationkey * 2 AS twice, n_name, n_regionkey FROM nation")
add("cat_codes", lambda t: rel.cat_codes(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "v"), "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS v FROM orders")
add("map_rows", lambda t: rel.map_rows(t.nation.select("n_nationkey", "n_name"), lambda p: p.assign(n_name=p.n_name.str[::-1]), "n_nationkey int, n_name string"), "SELECT n_nationkey, reverse(n_name) AS n_name FROM nation")
add("group_apply", lambda t: rel.group_by(t.events.select("event_type", "value"), "event_type").apply(lambda p: p.groupby("event_type", as_index=False).agg(v=("value", "max")), "event_type string, v double"), "SELECT event_type, max(value) AS v FROM events GROUP BY event_type")
add("stack", lambda t: rel.stack(t.events.select("event_id", F.expr(HOLES).alias("h"), F.col("value").alias("w")), "event_id"), f"SELECT event_id, 'h' AS variable, {HOLES} AS value FROM events WHERE {HOLES} IS NOT NULL UNION ALL SELECT event_id, 'w', value FROM events WHERE value IS NOT NULL")
add("categories", lambda t: rel.categories(t.orders, "o_orderpriority"), "SELECT dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code, o_orderpriority AS category FROM (SELECT DISTINCT o_orderpriority FROM orders)")
add("rename_categories", lambda t: rel.rename_categories(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open", "F": "filled"}), "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus FROM orders")
add("frame_fillna", lambda t: rel.fillna(t.events.select("event_id", F.expr(HOLES).alias("h"), F.expr(NULLKEY).alias("k")), {"h": -1.5, "k": 0}), f"SELECT event_id, coalesce({HOLES}, -1.5) AS h, coalesce({NULLKEY}, 0) AS k FROM events")
add("frame_round", lambda t: rel.round_columns(t.events.select("event_id", (F.floor("value") / 8).alias("a"), (F.floor("value") / 16).alias("b")), {"a": 1, "b": 2}), "SELECT event_id, round_even(floor(value) / 8, 1) AS a, round_even(floor(value) / 16, 2) AS b FROM events")
add("drop_rows", lambda t: rel.drop_rows(t.nation, "n_nationkey", [3, 5, 24]), "SELECT * FROM nation WHERE n_nationkey NOT IN (3, 5, 24)")
add("shape", lambda t: rel.shape(t.events.select("event_id", "user_id", "value")), "SELECT count(*) AS rows, 3 AS columns, count(*) * 3 AS size, count(*) = 0 AS empty FROM events")
add("dtypes", lambda t: rel.dtypes(t.events.select("event_id", "event_type", "value")), "SELECT * FROM (VALUES ('event_id', 'bigint'), ('event_type', 'string'), ('value', 'double')) AS v(\"column\", type)")
add("join_positions", lambda t: rel.join_positions(t.nation.select("n_nationkey", F.col("n_regionkey").alias("k")), t.region.select("r_regionkey", F.col("r_regionkey").alias("k")), "k", "n_nationkey", "r_regionkey"),
    "SELECT a.p AS \"left\", b.p AS \"right\" FROM (SELECT n_regionkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) a JOIN (SELECT r_regionkey AS k, row_number() OVER (ORDER BY r_regionkey) - 1 AS p FROM region) b ON a.k = b.k")
add("index_join", lambda t: set_index(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "k").join(set_index(t.orders.groupBy(F.col("o_custkey").alias("i")).agg(F.max("o_totalprice").alias("v")), "i"), "left", "_l", "_r").reset_index(),
    "SELECT c_custkey AS k, c_acctbal AS v_l, m AS v_r FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
add("loc_labels", lambda t: set_index(t.events, "event_id").loc([3, 5, 4000], ["value", "user_id"]), "SELECT event_id, value, user_id FROM events WHERE event_id IN (3, 5, 4000)")
add("loc_slice", lambda t: set_index(t.events, "event_id").loc(slice(10, 90), "value"), "SELECT event_id, value FROM events WHERE event_id BETWEEN 10 AND 90")
add("loc_mask", lambda t: set_index(t.events, "event_id").loc(F.col("value") > 100, "value"), "SELECT event_id, value FROM events WHERE value > 100")
add("iloc_slice", lambda t: set_index(t.events.select("event_id", "value"), "event_id").iloc(100, 120), "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p BETWEEN 100 AND 119")
add("sort_index", lambda t: set_index(t.nation, "n_nationkey").sort_index(False), "SELECT * FROM nation ORDER BY n_nationkey DESC")
add("reset_index_drop", lambda t: set_index(t.nation, "n_nationkey").reset_index(drop=True), "SELECT n_name, n_regionkey FROM nation")
add("int_div_large", lambda t: t.events.select("event_id", m.int_div(F.col("event_id") + 9007199254740993, 3).alias("v")), "SELECT event_id, (event_id + 9007199254740993) // 3 AS v FROM events")
add("floordiv_zero", lambda t: t.events.select("event_id", m.floordiv(F.col("event_id") % 5 - 2, F.col("event_id") % 3).alias("v")), "SELECT event_id, floor((event_id % 5 - 2)::DOUBLE / (event_id % 3)::DOUBLE) AS v FROM events")
