"""Operators against pandas on small frames with nulls, ties, NaN and non-ASCII text."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ferrowick.functions import datetimes as dt
from ferrowick.functions import math as m
from ferrowick.functions import strings as st
from ferrowick.operators import relational as rel
from ferrowick.operators.indexed import set_index
from ferrowick.operators.scan import Ordered
from ferrowick.sources import io


def same(a, b):
    a = [None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in a]
    b = [None if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else x for x in b]
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or x == y or (isinstance(x, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12))), (a, b)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    v = np.round(rng.uniform(-100, 100, 500), 3)
    v[rng.random(500) < 0.25] = np.nan
    v[:4] = np.nan
    return pd.Series(v, index=np.sort(rng.choice(100_000, 500, replace=False)))


def ordered(spark, s, strategy, ranges=7):
    return Ordered(io.from_dict(spark, {"k": s.index.tolist(), "v": s.tolist()}, "k long, v double"), "k", ranges, strategy)




@pytest.mark.parametrize("strategy", ["single", "distributed"])
def test_running_shift_and_rolling_match_pandas(spark, series, strategy):
    V = F.col("v")
    o, s = ordered(spark, series, strategy), series
    cases = [
        (o.cumsum(V, "x"), s.cumsum()), (o.cummin(V, "x"), s.cummin()), (o.cummax(V, "x"), s.cummax()), (o.cumprod(V / 50, "x"), (s / 50).cumprod()), (o.ffill(V, "x"), s.ffill()), (o.bfill(V, "x"), s.bfill()),
        (o.ffill(V, "x", limit=1), s.ffill(limit=1)), (o.shift(V, 3, "x"), s.shift(3)), (o.shift(V, -1, "x"), s.shift(-1)), (o.shift(V, 999, "x"), s.shift(999)), (o.diff(V, 1, "x"), s.diff()),
        (o.rolling(V, 5, "sum", 1, name="x"), s.rolling(5, min_periods=1).sum()), (o.rolling(V, 3, "mean", name="x"), s.rolling(3).mean()), (o.rolling(V, 4, "max", 1, center=True, name="x"), s.rolling(4, min_periods=1, center=True).max()),
        (o.rolling(V, 6, "median", 2, name="x"), s.rolling(6, min_periods=2).median()), (o.rank("v", "x"), s.rank()),
    ]
    for got, want in cases:
        same([r[0] for r in got.orderBy("k").select("x").collect()], want.tolist())
    assert [r[0] for r in o.positions("x").orderBy("k").select("x").collect()] == list(range(500))


def test_order_by_strings_and_times(spark):
    V = F.col("v")
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcé", k=4)) for _ in range(200)})
    o = Ordered(io.from_dict(spark, {"k": words, "v": list(range(len(words)))}, "k string, v long"), "k", 5)
    assert [r[0] for r in o.cumsum(V, "x").orderBy("v").select("x").collect()] == list(np.cumsum(range(len(words))))
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 7777 - 300000).cast("timestamp_ntz").alias("k"), F.col("id").alias("v"))
    assert [r[0] for r in Ordered(df, "k", 5).shift(V, 1, "x").orderBy("v").select("x").collect()] == [None, *range(99)]


def test_ordered_edge_tables(spark):
    V = F.col("v")
    for rows in ([], [(1, None)], [(1, 2.0)]):
        df = spark.createDataFrame(rows, "k long, v double")
        o = Ordered(df, "k", 3)
        assert o.cumsum(V, "x").count() == len(rows) == o.rolling(V, 2, "sum", name="x").count() == o.rank("v", "x").count()
    with pytest.raises(ValueError):
        o.rolling(V, 0)


def test_division_and_logs_are_ieee(spark):
    vals = [0.0, -0.0, None, math.inf, -math.inf, -1.0, 2.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = df.select(m.fdiv("v", 0.0), m.ln("v"), m.rint("v"), m.UNARY["cbrt"]("v")).collect()
    with np.errstate(all="ignore"):
        for v, r in zip(vals, got):
            if v is None:
                assert r[0] is None and r[1] is None
                continue
            for x, y in ((r[0], np.float64(v) / np.float64(0)), (r[1], np.log(np.float64(v))), (r[2], np.rint(v))):
                assert x == y or (math.isnan(x) and math.isnan(y))
    ints = spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (5, 0), (None, 1)], "a long, b long")
    assert [tuple(r) for r in ints.select(m.int_div("a", "b"), m.mod("a", "b"), m.pmod("a", "b"), m.floordiv("a", "b")).collect()] == [(3, 1, 1, 3.0), (-3, -1, 1, -4.0), (-3, 1, -1, -4.0), (None, None, None, math.inf), (None, None, None, None)]


def test_comparisons_are_two_valued(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, None)], "a long, b long")
    assert [tuple(r) for r in df.select(m.eq("a", "b"), m.ne("a", "b"), m.lt("a", "b"), m.ge("a", "b")).collect()] == [(True, False, False, True), (False, True, True, False), (False, True, False, False), (False, True, False, False)]
    assert [r[0] for r in df.select(m.isin("a", [1, None])).collect()] == [True, True, True, True]


STRINGS = ["", "a", "hello world", "Hello World", "HELLO", "Café au lait", "straße", "  pad\t\n", "42", "-42", "+5", "a1b2", "½", "²", "x.y.z", "ab ab ab", "éÉ", "tail\n", None]


@pytest.mark.parametrize("name,f,p", [
    ("lower", lambda: st.lower("s"), lambda s: s.lower()), ("upper", lambda: st.upper("s"), lambda s: s.upper()), ("casefold", lambda: st.casefold("s"), lambda s: s.casefold()),
    ("swapcase", lambda: st.swapcase("s"), lambda s: s.swapcase()), ("title", lambda: st.title("s"), lambda s: s.title()), ("capitalize", lambda: st.capitalize("s"), lambda s: s.capitalize()),
    ("strip", lambda: st.strip("s"), lambda s: s.strip()), ("lstrip", lambda: st.lstrip("s"), lambda s: s.lstrip()), ("rstrip", lambda: st.rstrip("s"), lambda s: s.rstrip()),
    ("len", lambda: st.length("s"), len), ("count", lambda: st.count("s", "ab"), lambda s: s.count("ab")), ("count_dot", lambda: st.count("s", "."), lambda s: s.count(".")), ("count_empty", lambda: st.count("s", ""), lambda s: s.count("")),
    ("find", lambda: st.find("s", "l"), lambda s: s.find("l")), ("find_empty", lambda: st.find("s", ""), lambda s: 0),
    ("slice", lambda: st.slice_("s", 1, 4), lambda s: s[1:4]), ("slice_neg", lambda: st.slice_("s", -5, -1), lambda s: s[-5:-1]), ("slice_open", lambda: st.slice_("s", -3), lambda s: s[-3:]), ("slice_cross", lambda: st.slice_("s", 4, 2), lambda s: s[4:2]),
    ("get", lambda: st.get("s", 1), lambda s: s[1] if len(s) > 1 else None), ("get_neg", lambda: st.get("s", -2), lambda s: s[-2] if len(s) > 1 else None),
    ("center", lambda: st.center("s", 8, "*"), lambda s: s.center(8, "*")), ("center_odd", lambda: st.center("s", 9, "*"), lambda s: s.center(9, "*")), ("zfill", lambda: st.zfill("s", 5), lambda s: s.zfill(5)),
    ("ljust", lambda: st.ljust("s", 7, "-"), lambda s: s.ljust(7, "-")), ("rjust", lambda: st.rjust("s", 7, "-"), lambda s: s.rjust(7, "-")), ("repeat", lambda: st.repeat("s", 2), lambda s: s * 2),
    ("removeprefix", lambda: st.removeprefix("s", "He"), lambda s: s.removeprefix("He")), ("removesuffix", lambda: st.removesuffix("s", "ld"), lambda s: s.removesuffix("ld")), ("replace", lambda: st.replace("s", ".", "!"), lambda s: s.replace(".", "!")),
    ("isalpha", lambda: st.is_class("isalpha", "s"), lambda s: s.isalpha()), ("isspace", lambda: st.is_class("isspace", "s"), lambda s: s.isspace()), ("isalnum", lambda: st.is_class("isalnum", "s"), lambda s: s.isalnum()),
    ("isupper", lambda: st.is_class("isupper", "s"), lambda s: s.isupper()), ("islower", lambda: st.is_class("islower", "s"), lambda s: s.islower()), ("istitle", lambda: st.is_class("istitle", "s"), lambda s: s.istitle()),
    ("isnumeric", lambda: st.is_class("isnumeric", "s"), lambda s: s.isnumeric()), ("isdecimal", lambda: st.is_class("isdecimal", "s"), lambda s: s.isdecimal()), ("split", lambda: st.split_part("s", ".", 1), lambda s: s.split(".")[1] if s.count(".") else None),
])
def test_strings_match_python(spark, name, f, p):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "i int, s string").coalesce(1)
    got = [r[0] for r in df.orderBy("i").select("i", f().alias("v")).select("v").collect()]
    assert got == [None if s is None else p(s) for s in STRINGS]


def test_joins_match_pandas(spark):
    l = pd.DataFrame({"k": [1, 1, 2, 3, None], "v": [1, 2, 3, 4, 5]})
    r = pd.DataFrame({"k": [1, 2, 2, 4, None], "v": [10, 20, 30, 40, 50]})
    sl, sr = (spark.createDataFrame([(None if pd.isna(a) else int(a), int(b)) for a, b in d.itertuples(index=False)], "k long, v long") for d in (l, r))
    for how in ("inner", "left", "right", "outer"):
        want = l.merge(r, on="k", how=how)
        got = rel.merge(sl, sr, how, "k")
        assert got.columns == list(want.columns)
        clean = lambda rows: sorted((tuple(None if x is None or pd.isna(x) else int(x) for x in row) for row in rows), key=repr)
        assert clean(got.collect()) == clean(want.itertuples(index=False))
    with pytest.raises(ValueError):
        rel.merge(sl.select(F.col("k").alias("a")), sr)


def test_group_by_null_rules(spark):
    df = spark.createDataFrame([(1, 10.0), (None, 20.0), (1, None), (2, None), (None, 5.0)], "k long, v double")
    assert sorted(map(tuple, rel.group_by(df, "k").agg(s=("sum", "v"), n=("count", "v")).collect())) == [(1, 10.0, 1), (2, None, 0)]
    assert rel.group_by(df, "k", dropna=False).agg(n=("count", "v")).count() == 3


def test_reshape_and_ties(spark):
    df = spark.createDataFrame([(1, "b", 5), (2, "a", 5), (3, "b", None), (4, None, 1)], "k long, c string, v int")
    assert [r.code for r in rel.cat_codes(df, "c").orderBy("k").collect()] == [1, 0, 1, -1]
    assert [r.duplicated for r in rel.duplicated(df, ["c"], "k").orderBy("k").collect()] == [False, False, True, False]
    assert rel.idxmax(df, "k", "v").first()[0] == 1 and rel.idxmin(df, "k", "v").first()[0] == 4
    assert [r.position for r in Ordered(df, "k").argsort("v").collect()] == [3, 0, 1, 2]
    assert rel.insert(df, 1, "z", F.lit(1)).columns == ["k", "z", "c", "v"]
    assert len(rel.sample(df, "k", 2).collect()) == 2


def test_datetimes(spark):
    ts = ["2020-01-15 10:30:45", "1969-12-31 23:59:59", "1900-01-01 06:30:15", "2024-02-29 00:00:00", "1970-01-05 00:00:00"]
    df = spark.createDataFrame([(t,) for t in ts], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    p = pd.to_datetime(pd.Series(ts)).dt
    for name in ("year", "month", "day", "hour", "minute", "second", "dayofweek", "quarter", "dayofyear"):
        assert [r[0] for r in df.select(dt.part(name, "t")).collect()] == getattr(p, name).tolist()
    with pytest.raises(TypeError):
        dt.checked("+", "datetime", "datetime")
    dt.checked("-", "datetime", "datetime")


def test_sources(spark, tmp_path):
    df = io.from_dict(spark, {"a": [1.0, float("nan"), None], "b": ["x", "y", None]}, "a double, b string", key="i")
    assert df.where("a is null").count() == 2
    for fmt, read in (("parquet", io.read_parquet), ("json", io.read_json), ("orc", io.read_orc)):
        io.write(df, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, read(spark, str(tmp_path / fmt)).select("a", "b", "i").collect()), key=repr) == sorted(map(tuple, df.select("a", "b", "i").collect()), key=repr)
    io.write(df, str(tmp_path / "csv"), "csv", header=True)
    assert dict(io.read_csv(spark, str(tmp_path / "csv")).dtypes) == {"i": "int", "a": "double", "b": "string"}
    assert io.to_list(io.column(spark, [3, 1], "v", "int"), "v", "i") == [3, 1]
    nan = io.from_pandas(spark, pd.DataFrame({"a": [1.0, np.nan]}))
    assert nan.where("a is null").count() == 1


def test_sorts_collect_in_order(spark):
    data = [(i, v) for i, v in enumerate([3.0, None, 1.0, 2.0, None, 1.0])]
    df = spark.createDataFrame(data, "k long, v double").repartition(3)
    assert [r.k for r in rel.sort_values(df, ["v", "k"]).collect()] == [2, 5, 3, 0, 1, 4]
    assert [r.k for r in rel.sort_values(df, ["v", "k"], [False, True]).collect()] == [0, 3, 2, 5, 1, 4]
    assert [r.v for r in rel.group_by(df, "v", sort=True).agg(n=("size", "k")).collect()] == [1.0, 2.0, 3.0]
    for up in (True, False):
        placed = Ordered(df, "k", ranges=3).sorted_positions("v", up).collect()
        want = sorted(data, key=lambda r: (r[1] is None, (r[1] or 0) * (1 if up else -1), r[0]))
        assert [r.k for r in sorted(placed, key=lambda r: r.position)] == [k for k, _ in want]
    same = spark.range(500).selectExpr("id as k", "1.0 as v")
    assert [r.position for r in sorted(Ordered(same, "k", ranges=7).sorted_positions("v").collect(), key=lambda r: r.k)] == list(range(500))
    assert Ordered(df.where("false"), "k").sorted_positions("v").count() == 0


def test_groups_need_an_order_for_first_and_keep_null_keys(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5.0), (3, None, 7.0), (4, "b", None), (5, None, 1.0)], "k long, g string, v double")
    with pytest.raises(ValueError):
        rel.group_by(df, "g").agg(v=("first", "v"))
    got = {r.g: (r.f, r.l) for r in rel.group_by(df, "g", dropna=False, order="k").agg(f=("first", "v"), l=("last", "v")).collect()}
    assert got == {"a": (5.0, 5.0), "b": (None, None), None: (7.0, 1.0)}
    assert {r.k: r.t for r in rel.group_by(df, "g").transform("t", "sum", "v").collect()} == {1: 5.0, 2: 5.0, 3: None, 4: None, 5: None}
    assert {r.k: r.t for r in rel.group_by(df, "g", dropna=False).transform("t", "sum", "v").collect()} == {1: 5.0, 2: 5.0, 3: 8.0, 4: None, 5: 8.0}


def test_integer_division_is_exact_and_floors_follow_ieee(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1), (-big, 2), (2**63 - 1, 3), (7, 0), (-7, 2), (None, 1)], "a long, b long")
    assert [r[0] for r in df.select(m.int_div("a", "b")).collect()] == [big, -(big // 2), (2**63 - 1) // 3, None, -3, None]
    inf = float("inf")
    f = spark.createDataFrame([(7.0, 2.0), (-7.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (1e300, 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in f.select(m.floordiv("a", "b")).collect()] == [3.0, -4.0, inf, -inf, 1e300, None]
    assert np.isnan(f.select(m.floordiv(F.lit(0.0), F.lit(0.0))).first()[0])
    assert [r[0] for r in f.select(m.ceil(m.fdiv("a", "b"))).collect()][2:5] == [inf, -inf, 1e300]


@pytest.mark.parametrize("n", [-5, -1, 0, 1, 4])
def test_shifts_of_either_sign_equal_the_single_window(spark, n):
    df = spark.range(20).selectExpr("id as k", "cast(id * id + 1 as double) as v")
    for op in ("shift", "diff", "pct_change"):
        many, one = (sorted(map(tuple, getattr(Ordered(df, "k", ranges=4, strategy=s), op)(F.col("v"), n, "x").collect())) for s in ("distributed", "single"))
        assert str(many) == str(one), op


def test_indexed_frames(spark):
    x = set_index(spark.createDataFrame([(3, "c", 1.0), (1, "a", None), (2, "b", 5.0)], "i long, s string, v double"), "i")
    assert x.at(2, "s") == "b" and x.iat(0, "s") == "a" and x.at(1, "v") is None
    for call in (lambda: x.at(9, "s"), lambda: set_index(x.df, "nope")):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(IndexError):
        x.iat(3, "s")
    assert [r.i for r in x.sort_index(False).collect()] == [3, 2, 1]
    assert {r.i for r in x.loc(slice(2, None)).collect()} == {2, 3} and x.loc([1, 7], "v").columns == ["i", "v"]
    assert x.reset_index(drop=True).columns == ["s", "v"]
    with pytest.raises(ValueError):
        x.join(x)
    assert x.join(x, lsuffix="_a", rsuffix="_b").reset_index().columns == ["i", "s_a", "v_a", "s_b", "v_b"]


def test_reshaping_edges(spark):
    df = spark.createDataFrame([(1, 2, "x"), (2, None, None)], "k long, a int, b string")
    assert sorted(map(tuple, rel.stack(df, "k").collect())) == [(1, "a", "2"), (1, "b", "x")]
    assert tuple(rel.shape(df.where("false")).first()) == (0, 3, 0, True)
    with pytest.raises(ValueError):
        rel.rename_categories(df, "b", {"x": "y", "z": "y"})
    assert rel.drop_rows(df, "a", [2]).count() == 1
