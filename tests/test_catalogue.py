"""Every registered query with SQL gives DuckDB's rows (a sample of the suite at sf0.001; the driver runs all)."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest

from ferrowick.functions import math as m
from ferrowick.plans.catalogue import ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE_SQL if not n.startswith(("str_", "math_", "dt_", "groupby_"))) + ["str_center", "str_title", "math_trunc", "dt_dayofweek", "groupby_transform"])
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    res = duck.execute(ORACLE_SQL[name])
    want = rows([d[0] for d in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in res.description)
    assert got == want


def test_flagship_runs(spark):
    assert flagship(spark, SF).count() == 5


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["multi_predicate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan
    scan = plan.split("ReadSchema:")[1]
    assert "o_custkey" not in scan and "o_orderdate" not in scan


@pytest.mark.parametrize("name", ["cumsum", "ffill", "shift_1", "rolling_sum", "rank_average", "take_positions"])
def test_ordered_plans_use_no_single_task_window(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # only the table of ranges may be ordered in one task
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "Aggregate" in part[:600]


def test_whole_joins_keep_every_row_and_leave_some_unmatched(spark):
    run = lambda name: QUERIES[name](spark, SF)
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("customer", "orders", "events")}
    outer = run("merge_outer")
    assert outer.select("c_name").distinct().where("c_name is not null").count() == run("merge_left").select("c_name").distinct().count() == n["customer"]
    assert outer.where("o_orderkey is not null").count() == run("merge_right").count() == n["orders"]
    assert outer.where("c_name is null").count() > 0 and outer.where("o_orderkey is null").count() > 0
    semi, anti = run("merge_semi").count(), run("merge_anti").count()
    assert semi + anti == n["customer"] and semi > 0 and anti > 0
    assert 0 < run("merge_inner").count() == run("merge_inferred_columns").count() < n["orders"]
    for name, table in (("combine_first", "events"), ("elementwise_frame_frame", "orders")):
        keys = run(name)
        assert keys.count() > n[table] == keys.selectExpr("k div 2").distinct().count()


def on_events(spark, duck, path, name, events):
    """The query's frame over a table of events, and its SQL's rows."""
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    return QUERIES[name](spark, str(path)), lambda: duck.execute(f"WITH events AS (FROM '{path}/events.parquet/*.parquet') {ORACLE_SQL[name]}").fetchall()


def test_timedelta_sum_is_exact_beyond_bigint(spark, duck, tmp_path):
    us = lambda d: (d - datetime(2020, 1, 1)) // timedelta(microseconds=1)
    late, early = datetime(9999, 12, 31, 23, 59, 59, 999999), datetime(1600, 1, 1, 0, 0, 0, 1)
    for k, (times, kind) in enumerate([([late] * 40 + [early] * 300 + [None], "bigint"), ([late] * 40, "decimal(38,0)"), ([early] * 700, "decimal(38,0)"), ([None], "bigint")]):
        df, sql = on_events(spark, duck, tmp_path / str(k), "timedelta_sum", spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz"))
        assert df.dtypes == [("v", kind)]
        assert [r[0] for r in df.collect()] == [sum(us(t) for t in times if t) if any(times) else None]
        if kind == "bigint":
            assert [r[0] for r in sql()] == [r[0] for r in df.collect()]


#: (118.66 - 12.8) / 12.8 is a double below 8.2703125 that is printed as 8.2703125.
TIES = {
    "pct_change_neg_3": {1: 118.66, 2: 5.0, 4: 12.8, 5: 0.0, 7: None, 8: 3.0},
    "pct_change": {1: 12.8, 2: 118.66, 4: 0.0, 5: 3.0},
    "pct_change_2": {2: 12.8, 4: 118.66, 5: 0.0, 7: 3.0},
    "pct_change_neg_1": {1: 118.66, 2: 12.8, 4: 3.0, 5: 0.0},
}


@pytest.mark.parametrize("name", TIES)
def test_ties_round_as_in_sql(spark, duck, tmp_path, name):
    events = spark.createDataFrame([(k, TIES[name].get(k, 1.0)) for k in range(12)], "event_id long, value double")
    df, sql = on_events(spark, duck, tmp_path, name, events)
    got = rows(["event_id", "h", "v"], df.select("event_id", "h", "v").collect())
    assert got == rows(["event_id", "h", "v"], sql()) and {8.270312, math.inf} <= {r[2] for r in got}


def test_round_away_is_sqls_round(spark, duck):
    rng = random.Random(3)
    vals = [None, 0.0, math.inf, -math.inf, math.nan, 1e300, 1e305, 4503599627370497.5, 0.5, -0.5, 2.5, 0.49999999999999994, -8.2703124999999993] + [rng.randint(-40000, 40000) / rng.choice([8, 64, 160, 320, 1600]) / rng.choice([1, 10, 1000]) for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(vals)), "k long, v double").select("k", m.round_away("v", 6), m.round_away("v")).orderBy("k")
    want = duck.execute("SELECT round(v, 6), round(v) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [vals]).fetchall()
    assert [tuple(map(norm, r[1:])) for r in df.collect()] == [tuple(map(norm, r)) for r in want]
