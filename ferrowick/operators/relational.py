"""Selection, reduction, grouping, joining, sorting and reshaping, each a thin declarative plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowick.operators.scan import Ordered

# ---------------------------------------------------------------- reductions

#: Whole-column reductions by name; NULLs are skipped, an empty or all-NULL column gives NULL.
REDUCE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count, "nunique": F.count_distinct, "std": F.stddev_samp, "var": F.var_samp,
    "median": lambda c: F.percentile(c, F.lit(0.5)), "size": lambda c: F.count(F.lit(1)),
    "prod": F.product, "any": F.bool_or, "all": F.bool_and,
}


def reduce(df: DataFrame, min_count: int = 1, **columns: tuple[str, Column | str]) -> DataFrame:
    """One row of name=(op, column). ``min_count=0`` makes the sum of nothing 0."""
    out = []
    for name, (op, c) in columns.items():
        value = REDUCE[op](F.col(c) if isinstance(c, str) else c)
        out.append((F.coalesce(value, F.lit(0)) if op == "sum" and min_count == 0 else value).alias(name))
    return df.agg(*out)


def quantile(df: DataFrame, c: str, q: float, name: str = "quantile", approximate: bool = False) -> DataFrame:
    """Linear interpolation, exact unless ``approximate``."""
    return df.agg((F.percentile_approx(c, q, 10000) if approximate else F.percentile(c, F.lit(q))).alias(name))


def describe(df: DataFrame, c: str) -> DataFrame:
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q.alias("q"), F.max(c).alias("max"))
    return d.select("count", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def idxmin(df: DataFrame, key: str, c: str, name: str = "idxmin") -> DataFrame:
    """The least key among the rows with the least value."""
    return df.where(F.col(c).isNotNull()).agg(F.min_by(key, F.struct(F.col(c), F.col(key))).alias(name))


def idxmax(df: DataFrame, key: str, c: str, name: str = "idxmax") -> DataFrame:
    """The least key among the rows with the greatest value."""
    per = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(key).alias(name))
    return per.agg(F.max_by(name, c).alias(name))


def value_counts(df: DataFrame, c: str, dropna: bool = True) -> DataFrame:
    return (df.where(F.col(c).isNotNull()) if dropna else df).groupBy(c).agg(F.count("*").alias("count"))


def corr(df: DataFrame, a: str, b: str, name: str = "corr") -> DataFrame:
    return df.agg(F.corr(a, b).alias(name))


def cov(df: DataFrame, a: str, b: str, name: str = "cov") -> DataFrame:
    return df.agg(F.covar_samp(a, b).alias(name))


# ---------------------------------------------------------------- grouping


class Grouped:
    """Groups of equal keys. Rows with a NULL key are left out unless ``dropna`` is off; a group whose
    values are all NULL stays. ``order`` is a unique column that first and last go by."""

    def __init__(self, df: DataFrame, keys: str | Sequence[str], sort: bool = False, dropna: bool = True, order: str | None = None):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.whole, self.dropna = df, dropna
        self.df = df.dropna(subset=self.keys) if dropna else df
        self.sort, self.order = sort, order

    def _value(self, op: str, c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        if op in ("first", "last"):
            if self.order is None:
                raise ValueError("first and last need an order column")
            return (F.min_by if op == "first" else F.max_by)(c, F.when(c.isNotNull(), F.col(self.order)))
        return REDUCE[op](c)

    def agg(self, spec: str | Sequence[str] | Mapping[str, str | Sequence[str]] | None = None, **columns: tuple[str, Column | str]) -> DataFrame:
        """name=(op, column), or one operator or a list of them over all other columns, or a dict of these by
        column; several operators of a column are named column_operator. Partial sums run before the shuffle."""
        if spec is not None:
            rest = [c for c in self.df.columns if c not in self.keys and c != self.order]
            by = spec if isinstance(spec, Mapping) else dict.fromkeys(rest, spec)
            for c, ops in by.items():
                columns |= {c: (ops, c)} if isinstance(ops, str) else {f"{c}_{op}": (op, c) for op in ops}
        out = self.df.groupBy(*self.keys).agg(*[self._value(op, c).alias(n) for n, (op, c) in columns.items()])
        return out.orderBy(*self.keys) if self.sort else out

    def all(self, op: str) -> DataFrame:
        """The operator over every other column, under its own name."""
        return self.agg(op)

    def transform(self, name: str, op: str, c: str) -> DataFrame:
        """The group's aggregate beside each row; NULL where the key is NULL and ``dropna`` is on.

        Aggregated first and joined back, so a huge group is no single task."""
        agg = self.df.groupBy(*[F.col(k).alias(f"__{k}") for k in self.keys]).agg(self._value(op, c).alias(name))
        cond = F.lit(True)
        for k in self.keys:
            cond = cond & (F.col(k) == F.col(f"__{k}") if self.dropna else F.col(k).eqNullSafe(F.col(f"__{k}")))
        return self.whole.join(agg, cond, "left").drop(*[f"__{k}" for k in self.keys])

    def apply(self, f: Callable, schema: str) -> DataFrame:
        """A pandas function of each group's rows; a group must fit one task's memory."""
        return self.df.groupBy(*self.keys).applyInPandas(f, schema)


def group_by(df: DataFrame, keys: str | Sequence[str], sort: bool = False, dropna: bool = True, order: str | None = None) -> Grouped:
    return Grouped(df, keys, sort, dropna, order)


# ---------------------------------------------------------------- joins


def merge(left: DataFrame, right: DataFrame, how: str = "inner", on: str | Sequence[str] | None = None, left_on: str | Sequence[str] | None = None, right_on: str | Sequence[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y"), null_equal: bool = True) -> DataFrame:
    """Equi-join of two frames; ``how``: inner, left, right, outer, cross, semi or anti.

    Without keys, the common columns are the keys. Keys of one name appear once (coalesced in an
    outer join), keys of two names both stay; other common columns get the suffixes. NULL keys
    match each other unless ``null_equal`` is off.
    """
    if how == "cross":
        lk = rk = []
    elif left_on is not None or right_on is not None:
        lk, rk = ([x] if isinstance(x, str) else list(x or ()) for x in (left_on, right_on))
    else:
        lk = rk = [on] if isinstance(on, str) else list(on) if on is not None else [c for c in left.columns if c in right.columns]
    if len(lk) != len(rk) or (how != "cross" and not lk):
        raise ValueError("no common keys to join on, or keys that do not pair up")
    shared = [a for a, b in zip(lk, rk, strict=True) if a == b]
    clash = {c for c in left.columns if c in right.columns} - set(shared)
    l = left.select(*[F.col(f"`{c}`").alias(f"l__{c}") for c in left.columns])  # noqa: E741
    r = right.select(*[F.col(f"`{c}`").alias(f"r__{c}") for c in right.columns])
    if how == "cross":
        joined = l.crossJoin(r)
    else:
        cond = None
        for a, b in zip(lk, rk, strict=True):
            x, y = F.col(f"`l__{a}`"), F.col(f"`r__{b}`")
            c = x.eqNullSafe(y) if null_equal else x == y
            cond = c if cond is None else cond & c
        joined = l.join(r, cond, {"outer": "full", "semi": "left_semi", "anti": "left_anti"}.get(how, how))
    out = []
    for c in left.columns:
        v = F.col(f"`l__{c}`")
        if c in shared and how in ("right", "outer"):
            v = F.coalesce(v, F.col(f"`r__{c}`"))
        out.append(v.alias(c + suffixes[0] if c in clash and how not in ("semi", "anti") else c))
    if how not in ("semi", "anti"):
        out += [F.col(f"`r__{c}`").alias(c + suffixes[1] if c in clash else c) for c in right.columns if c not in shared]
    return joined.select(*out)


def combine_first(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left's values, and right's where they are NULL or missing, by key."""
    names = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    l = left.select(*[F.col(f"`{c}`").alias(f"l__{c}") for c in left.columns])  # noqa: E741
    r = right.select(*[F.col(f"`{c}`").alias(f"r__{c}") for c in right.columns])
    j = l.join(r, F.col(f"l__{key}") == F.col(f"r__{key}"), "full")
    both = lambda c: F.coalesce(*[F.col(f"`{s}__{c}`") for s, d in (("l", left), ("r", right)) if c in d.columns])
    return j.select(*[both(c).alias(c) for c in names])


def align(left: DataFrame, right: DataFrame, key: str, op: Callable[[Column, Column], Column], columns: Sequence[str]) -> DataFrame:
    """Arithmetic of two frames by key: NULL where a key is on one side only."""
    j = merge(left.select(key, *columns), right.select(key, *columns), "outer", key)
    return j.select(key, *[op(F.col(f"{c}_x"), F.col(f"{c}_y")).alias(c) for c in columns])


def join_positions(left: DataFrame, right: DataFrame, on: str, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """(left, right): the places, in the order of each side's key, of the rows that an equi-join pairs."""
    l = Ordered(left.select(left_key, on), left_key).positions("left").select("left", F.col(on).alias("__a"))  # noqa: E741
    r = Ordered(right.select(right_key, on), right_key).positions("right").select("right", F.col(on).alias("__b"))
    return l.join(r, F.col("__a").eqNullSafe(F.col("__b")), how).select("left", "right")


# ---------------------------------------------------------------- order and position


def sort_values(df: DataFrame, by: str | Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """NULLs last either way."""
    by = [by] if isinstance(by, str) else list(by)
    up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    return df.orderBy(*[F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last() for c, a in zip(by, up, strict=True)])


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows by key: each task keeps n."""
    return df.orderBy(key).limit(n)


def tail(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.col(key).desc()).limit(n)


def take(df: DataFrame, key: str, places: Sequence[int]) -> DataFrame:
    """The rows at the given places (from 0) in the order of the key."""
    placed = Ordered(df, key).positions("__p")
    return placed.where(F.col("__p").isin(list(places))).drop("__p")


def slice_rows(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    placed = Ordered(df, key).positions("__p")
    return placed.where((F.col("__p") >= start) & (F.col("__p") < stop)).drop("__p")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same at every run and in every engine: the least MD5 sums of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


# ---------------------------------------------------------------- reshaping


def concat(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def stack(df: DataFrame, key: str, variable: str = "variable", value: str = "value") -> DataFrame:
    """(key, variable, value): every value that is not NULL of the other columns, as text where their types differ."""
    rest = [c for c in df.columns if c != key]
    kinds = {t for c, t in df.dtypes if c != key}
    if len(kinds) > 1:
        df = df.select(key, *[F.col(c).cast("string").alias(c) for c in rest])
    return melt(df, [key], rest, variable, value).where(F.col(value).isNotNull())


def pivot(df: DataFrame, index: str, columns: str, values: str, names: Sequence, op: str = "min") -> DataFrame:
    return df.groupBy(index).pivot(columns, list(names)).agg(REDUCE[op](F.col(values)))


def transpose(df: DataFrame, key: str, labels: Sequence, values: Sequence[str]) -> DataFrame:
    """Columns become rows and the rows of the given labels become columns; for small frames."""
    return pivot(melt(df, [key], values), "variable", key, "value", labels)


def drop_duplicates(df: DataFrame, subset: Sequence[str], key: str) -> DataFrame:
    """The row of the least key for each combination."""
    rest = [c for c in df.columns if c not in subset]
    kept = df.groupBy(*subset).agg(F.min_by(F.struct(*rest), key).alias("__r"))
    return kept.select(*[F.col(c) if c in subset else F.col(f"__r.{c}").alias(c) for c in df.columns])


def duplicated(df: DataFrame, subset: Sequence[str], key: str, name: str = "duplicated") -> DataFrame:
    """Whether a row of a lesser key has the same values; NULLs are equal."""
    first = df.groupBy(*[F.col(c).alias(f"__{c}") for c in subset]).agg(F.min(key).alias("__first"))
    cond = None
    for c in subset:
        e = F.col(c).eqNullSafe(F.col(f"__{c}"))
        cond = e if cond is None else cond & e
    return df.join(first, cond).select(*df.columns, (F.col(key) != F.col("__first")).alias(name))


def cat_codes(df: DataFrame, c: str, name: str = "code") -> DataFrame:
    """Codes from 0 of the sorted distinct values, -1 for NULL."""
    codes = Ordered(df.where(F.col(c).isNotNull()).select(F.col(c).alias("__v")).distinct(), "__v").positions(name)
    return df.join(codes, F.col(c) == F.col("__v"), "left").drop("__v").withColumn(name, F.coalesce(name, F.lit(-1)).cast("bigint"))


def categories(df: DataFrame, c: str) -> DataFrame:
    """(code, category): the sorted distinct values and their codes from 0."""
    return Ordered(df.where(F.col(c).isNotNull()).select(F.col(c).alias("category")).distinct(), "category").positions("code").select("code", "category")


def rename_categories(df: DataFrame, c: str, names: Mapping) -> DataFrame:
    """Other values for some of a column's; two of them may not become one."""
    if len(set(names.values())) < len(names):
        raise ValueError("categories must stay different")
    return replace_values(df, c, names)


def fillna(df: DataFrame, value) -> DataFrame:
    """A value, or a dict of values by column, for NULL; a value that a column's type cannot hold leaves it as it is."""
    return df.fillna(value)


def round_columns(df: DataFrame, digits: int | Mapping[str, int]) -> DataFrame:
    """Float and double columns rounded half to even, to as many digits each."""
    by = digits if isinstance(digits, Mapping) else {c: digits for c, t in df.dtypes if t in ("float", "double")}
    return df.select(*[F.bround(F.col(f"`{c}`"), by[c]).alias(c) if c in by else F.col(f"`{c}`") for c in df.columns])


def drop_rows(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """All rows but those of the given keys; a NULL key stays."""
    return df.where(~F.coalesce(F.col(key).isin(list(values)), F.lit(False)))


def shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, size and whether the frame is empty."""
    n = len(df.columns)
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(n).alias("columns"), (F.col("rows") * n).alias("size"), (F.col("rows") == 0).alias("empty"))


def dtypes(df: DataFrame) -> DataFrame:
    """(column, type) of each column."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def replace_values(df: DataFrame, c: str, to: Mapping) -> DataFrame:
    v = F.col(c)
    out = v
    for old, new in to.items():
        out = F.when(v == F.lit(old), F.lit(new)).otherwise(out)
    return df.withColumn(c, out)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def select_dtypes(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return df.select(*[c for c, t in df.dtypes if t in kinds])


def insert(df: DataFrame, place: int, name: str, value: Column) -> DataFrame:
    """A new column at a place among the others."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*cols[:place], value.alias(name), *cols[place:])


def map_rows(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """A pandas function of batches of rows, for what no column function can say."""
    return df.mapInPandas(lambda it: (f(p) for p in it), schema)


def apply_columns(df: DataFrame, f: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """f over each of the columns, in one projection."""
    chosen = set(columns or df.columns)
    return df.select(*[f(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])
