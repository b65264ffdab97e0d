"""Ordered operators over a whole table without a single-task window.

A table is cut into ranges of its order key by a deterministic expression (a piecewise linear
estimate of the key's distribution), so that recomputed tasks put every row in the same range.
Running operators work within each range and add what the earlier ranges carry: one row a range,
combined in a table as small as the number of ranges. Shifts and rolling windows number the rows,
cut them into blocks and copy each block's edge to its neighbour.

``strategy="single"`` is the plain window over one partition, for small tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Cuts of a key's distribution: as many as there are ranges, between these two.
QUANTILES, MOST_QUANTILES = 64, 1024


def _as_number(key: Column, kind: T.DataType) -> Column | None:
    if isinstance(kind, T.NumericType):
        return key.cast("double")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.unix_micros(key.cast("timestamp")).cast("double")
    return None


def _tree(value: Column, cuts: Sequence, lo: int, hi: int) -> Column:
    """The number of cuts at or below value, as a balanced tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value < F.lit(cuts[mid]), _tree(value, cuts, lo, mid)).otherwise(_tree(value, cuts, mid + 1, hi))


ROLLING = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "median": lambda c: F.percentile(c, F.lit(0.5))}


class Ordered:
    """A frame with a declared total order: a unique, non-null ``key`` column."""

    def __init__(self, df: DataFrame, key: str, ranges: int | None = None, strategy: str = "distributed"):
        if strategy not in ("distributed", "single"):
            raise ValueError("strategy is distributed or single")
        self.df, self.key, self.strategy = df, key, strategy
        conf = df.sparkSession.conf
        self.ranges = ranges or max(2, int(conf.get("spark.sql.shuffle.partitions")))
        self.on = Window.orderBy(key)

    @cached_property
    def _range(self) -> Column:
        key, kind = F.col(self.key), self.df.schema[self.key].dataType
        x = _as_number(key, kind)
        cuts_of = min(MOST_QUANTILES, max(QUANTILES, self.ranges))
        shares = [i / cuts_of for i in range(cuts_of + 1)]
        if x is None:
            few = self.df.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(40 * cuts_of)  # an even sample, for the cuts only
            keys = sorted(r[0] for r in few.toLocalIterator())
            cuts = sorted({keys[i * len(keys) // cuts_of] for i in range(1, cuts_of)}) if keys else []
            return _tree(key, cuts, 0, len(cuts))
        q = self.df.agg(F.percentile_approx(x, shares, 20 * cuts_of)).first()[0] or [0.0, 1.0]
        q = sorted(set(q))
        if len(q) < 2:
            return F.lit(0)
        steps = [(a, b) for a, b in zip(q, q[1:], strict=False)]
        at = _tree(x, q[1:-1], 0, len(q) - 2)
        low, wide = F.array(*[F.lit(a) for a, _ in steps]), F.array(*[F.lit(b - a) for a, b in steps])
        share = (at + (x - F.get(low, at)) / F.get(wide, at)) / len(steps)
        return F.least(F.greatest(F.floor(share * self.ranges), F.lit(-1)), F.lit(self.ranges)).cast("int")

    # ------------------------------------------------------------ running

    def running(self, **columns: tuple[str, Column]) -> DataFrame:
        """name=(op, value) adds columns; op: sum, min, max, product, count, last (fill forward), first (fill backward).

        sum, min, max and product are NULL where the value is, and skip NULLs before.
        """
        ops = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product, "count": F.count}

        def local(op: str, v: Column, w) -> Column:
            up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            if op == "last":
                return F.last(v, True).over(up)
            if op == "first":
                return F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            return ops[op](v).over(up)

        key = F.col(self.key)

        def where(op: str, v: Column, c: Column) -> Column:
            return c if op in ("last", "first", "count") else F.when(v.isNotNull(), c)

        if self.strategy == "single":
            back = Window.orderBy(key.desc())
            return self.df.select("*", *[where(op, v, local(op, v, back if op == "first" else self.on)).alias(n) for n, (op, v) in columns.items()])

        df = self.df.withColumn("__r", self._range)
        edge = []
        for n, (op, v) in columns.items():
            edge.append((F.max_by(v, F.when(v.isNotNull(), key)) if op == "last" else F.min_by(v, F.when(v.isNotNull(), key)) if op == "first" else ops[op](v)).alias(f"__c_{n}"))
        per = df.groupBy("__r").agg(*edge)
        before, after = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("__r"), F.col("__r").desc()))
        carry = []
        for n, (op, _) in columns.items():
            c = F.col(f"__c_{n}")
            carry.append((F.last(c, True).over(before) if op == "last" else F.last(c, True).over(after) if op == "first" else ops["sum" if op == "count" else op](c).over(before)).alias(f"__k_{n}"))
        # a row for each range, so small that one task may order them and all tasks may have them
        joined = df.join(F.broadcast(per.select("__r", *carry)), "__r")
        w, back = Window.partitionBy("__r").orderBy(key), Window.partitionBy("__r").orderBy(key.desc())
        out = []
        for n, (op, v) in columns.items():
            own, k = local(op, v, back if op == "first" else w), F.col(f"__k_{n}")
            both = {
                "sum": F.coalesce(own + k, own, k), "count": own + F.coalesce(k, F.lit(0)), "min": F.least(own, k), "max": F.greatest(own, k),
                "product": own * F.coalesce(k, F.lit(1.0)), "last": F.coalesce(own, k), "first": F.coalesce(own, k),
            }[op]
            out.append(where(op, v, both).alias(n))
        return joined.select(*[F.col(f"`{c}`") for c in self.df.columns], *out)

    def cumsum(self, v: Column, name: str = "cumsum") -> DataFrame:
        return self.running(**{name: ("sum", v)})

    def cummin(self, v: Column, name: str = "cummin") -> DataFrame:
        return self.running(**{name: ("min", v)})

    def cummax(self, v: Column, name: str = "cummax") -> DataFrame:
        return self.running(**{name: ("max", v)})

    def cumprod(self, v: Column, name: str = "cumprod") -> DataFrame:
        return self.running(**{name: ("product", v)})

    def ffill(self, v: Column, name: str = "ffill", limit: int | None = None) -> DataFrame:
        return self.running(**{name: ("last", v)}) if limit is None else self._limited(v, name, limit, -1)

    def bfill(self, v: Column, name: str = "bfill", limit: int | None = None) -> DataFrame:
        return self.running(**{name: ("first", v)}) if limit is None else self._limited(v, name, limit, 1)

    def _limited(self, v: Column, name: str, limit: int, way: int) -> DataFrame:
        span = (-limit, 0) if way < 0 else (0, limit)
        take = F.last if way < 0 else F.first
        return self.framed({name: lambda w: take(v, True).over(w.rowsBetween(*span))}, *(abs(s) for s in span))

    # ------------------------------------------------------------ positions

    def positions(self, name: str = "position") -> DataFrame:
        """Places from 0 in the order of the key."""
        return self.running(**{name: ("count", F.lit(1))}).withColumn(name, F.col(name) - 1)

    def framed(self, columns: dict, back: int, ahead: int) -> DataFrame:
        """Adds name: f(window) columns whose frames reach at most ``back`` rows back and ``ahead`` rows on."""
        if self.strategy == "single":
            return self.df.select("*", *[f(self.on).alias(n) for n, f in columns.items()])
        placed = self.positions("__p")
        rows = self.df.count()
        size = max(1, back, ahead, -(-rows // self.ranges))
        p = F.col("__p")
        block = F.floor(p / size)
        at = p % size
        copies = F.array_compact(F.array(block, F.when(at >= size - back, block + 1) if back else F.lit(None).cast("long"), F.when((at < ahead) & (block > 0), block - 1) if ahead else F.lit(None).cast("long")))
        spread = placed.withColumn("__own", block).withColumn("__b", F.explode(copies))
        w = Window.partitionBy("__b").orderBy("__p")
        out = spread.select("*", *[f(w).alias(n) for n, f in columns.items()]).where("__b = __own")
        return out.select(*[F.col(f"`{c}`") for c in self.df.columns], *columns)

    def shift(self, v: Column, n: int = 1, name: str = "shift", fill=None) -> DataFrame:
        """The value n rows before (after, if negative); ``fill`` where there is no such row."""
        f = (lambda w: F.lag(v, n, fill).over(w)) if n >= 0 else (lambda w: F.lead(v, -n, fill).over(w))
        return self.framed({name: f}, max(n, 0), max(-n, 0))

    def diff(self, v: Column, n: int = 1, name: str = "diff") -> DataFrame:
        f = (lambda w: v - F.lag(v, n).over(w)) if n >= 0 else (lambda w: v - F.lead(v, -n).over(w))
        return self.framed({name: f}, max(n, 0), max(-n, 0))

    def pct_change(self, v: Column, n: int = 1, name: str = "pct_change") -> DataFrame:
        from ferrowick.functions.math import fdiv

        def f(w) -> Column:
            old = (F.lag(v, n) if n >= 0 else F.lead(v, -n)).over(w)
            return fdiv(v - old, old)

        return self.framed({name: f}, max(n, 0), max(-n, 0))

    def rolling(self, v: Column, window: int, how: str = "sum", min_periods: int | None = None, center: bool = False, name: str | None = None) -> DataFrame:
        """sum, mean, min, max, count, std, var or median over ``window`` rows up to (or around) each row.

        NULL where fewer than min_periods (default: window) values, or for count rows, are there.
        """
        if window < 1:
            raise ValueError("window must be positive")
        need = window if min_periods is None else min_periods
        back, ahead = (window // 2, (window - 1) // 2) if center else (window - 1, 0)

        def f(w) -> Column:
            r = w.rowsBetween(-back, ahead)
            have = F.count(F.lit(1)).over(r) if how == "count" else F.count(v).over(r)
            return F.when(have >= need, ROLLING[how](v).over(r))

        return self.framed({name or f"rolling_{how}": f}, back, ahead)

    def rolling_apply(self, v: Column, window: int, f: Callable[[Column], Column], min_periods: int | None = None, name: str = "rolling_apply") -> DataFrame:
        """f of the array of the window's values that are not NULL, oldest first."""
        need = window if min_periods is None else min_periods
        r = lambda w: w.rowsBetween(-(window - 1), 0)
        held = self.framed({name: lambda w: F.when(F.count(v).over(r(w)) >= need, F.collect_list(v).over(r(w)))}, window - 1, 0)
        return held.withColumn(name, F.when(F.col(name).isNotNull(), f(F.col(name))))

    # ------------------------------------------------------------ frames

    def cumulative(self, op: str, columns: Sequence[str]) -> DataFrame:
        """The key and the running sum, min, max or product of each of the columns, in one pass."""
        out = self.running(**{f"__o_{c}": (op, F.col(c)) for c in columns})
        return out.select(self.key, *[F.col(f"__o_{c}").alias(c) for c in columns])

    def rolling_frame(self, columns: Sequence[str], window: int, how: str = "sum", min_periods: int | None = None) -> DataFrame:
        """The key and the rolling aggregate of each of the columns, in one pass."""
        if window < 1:
            raise ValueError("window must be positive")
        need = window if min_periods is None else min_periods

        def one(c: str) -> Callable:
            def f(w) -> Column:
                r = w.rowsBetween(-(window - 1), 0)
                return F.when(F.count(c).over(r) >= need, ROLLING[how](F.col(c)).over(r))

            return f

        out = self.framed({f"__o_{c}": one(c) for c in columns}, window - 1, 0)
        return out.select(self.key, *[F.col(f"__o_{c}").alias(c) for c in columns])

    # ------------------------------------------------------------ rank and order

    def rank(self, value: str, name: str = "rank") -> DataFrame:
        """Average rank of a column's values; NULLs are unranked. Counts per distinct value are ranked, then joined back."""
        if self.strategy == "single":
            v = F.col(value)
            r = F.rank().over(Window.orderBy(v.asc_nulls_last())) + (F.count(v).over(Window.partitionBy(v)) - 1) / 2
            return self.df.select("*", F.when(v.isNotNull(), r).alias(name))
        counts = self.df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
        up = Ordered(counts, "__v", self.ranges).running(__up=("sum", F.col("__n")))
        ranks = up.select("__v", (F.col("__up") - (F.col("__n") - 1) / 2).alias(name))
        return self.df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")

    def sorted_positions(self, value: str, ascending: bool = True, name: str = "position") -> DataFrame:
        """Each row's place from 0 in the order of a column's values, NULLs last either way, ties in the order of the key.

        A row's place is the count of rows with lesser values, of rows of its value in earlier ranges
        of the key, and of those before it in its range; so a value that fills the table is no single task.
        """
        df = self.df.withColumn("__r", self._range)
        per = df.groupBy(F.col(value).alias("__v"), F.col("__r").alias("__s")).agg(F.count("*").alias("__n"))
        before = Window.partitionBy("__v").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
        part = per.withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        counts = per.where("__v is not null").groupBy("__v").agg(F.sum("__n").alias("__n"))
        up = Ordered(counts, "__v", self.ranges).running(__up=("sum", F.col("__n")))
        total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__t"))  # one row
        lesser = up.crossJoin(F.broadcast(total)).select(F.col("__v").alias("__w"), (F.col("__up") - F.col("__n") if ascending else F.col("__t") - F.col("__up")).alias("__l"))
        part = part.join(lesser, F.col("__v") == F.col("__w"), "left").crossJoin(F.broadcast(total))
        part = part.select("__v", "__s", (F.coalesce("__l", "__t") + F.col("__b")).alias("__o"))
        joined = df.join(part, F.col(value).eqNullSafe(F.col("__v")) & (F.col("__r") == F.col("__s")))
        at = F.row_number().over(Window.partitionBy("__v", "__r").orderBy(self.key)) - 1
        return joined.select(*[F.col(f"`{c}`") for c in self.df.columns], (F.col("__o") + at).alias(name))

    def argsort(self, value: str, ascending: bool = True) -> DataFrame:
        """(rank, position), sorted: for each place in the order of the value, the row's place in the order of the key."""
        placed = Ordered(self.positions("position").select(self.key, value, "position"), self.key, self.ranges)
        return placed.sorted_positions(value, ascending, "rank").select("rank", "position").orderBy("rank")
