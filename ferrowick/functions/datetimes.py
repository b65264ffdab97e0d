"""Parts of, and arithmetic on, timestamps without zone and day-time intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .math import C, col

#: Parts by name; weeks start on Monday = 0.
PARTS = {
    "year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second, "dayofweek": F.weekday,
    "weekday": F.weekday, "quarter": F.quarter, "dayofyear": F.dayofyear,
}


def part(name: str, ts: C) -> Column:
    return PARTS[name](col(ts)).cast("bigint")


def difference(a: C, b: C) -> Column:
    """The day-time interval between two timestamps, or two intervals."""
    return col(a) - col(b)


def shift_time(ts: C, delta: C, sign: int = 1) -> Column:
    return col(ts) + col(delta) if sign > 0 else col(ts) - col(delta)


def micros(interval: C) -> Column:
    """An interval's length in microseconds."""
    d = col(interval)
    seconds = F.extract(F.lit("DAY"), d).cast("decimal(38,6)") * 86400 + F.extract(F.lit("HOUR"), d) * 3600 + F.extract(F.lit("MINUTE"), d) * 60 + F.extract(F.lit("SECOND"), d)
    return (seconds * 1000000).cast("bigint")


def total_micros(df: DataFrame, interval: C, name: str = "v") -> DataFrame:
    """One row, read when called: the exact total of intervals in microseconds; a decimal(38,0) where no bigint holds it. NULL without intervals."""
    total = df.agg(F.sum(micros(interval).cast("decimal(28,0)"))).first()[0]  # summed as intervals, parts of the total overflow
    if total is None or -(2**63) <= total < 2**63:
        return df.sparkSession.createDataFrame([(total if total is None else int(total),)], f"`{name}` bigint")
    return df.sparkSession.createDataFrame([(total,)], f"`{name}` decimal(38,0)")


def is_month_start(ts: C) -> Column:
    return F.day(col(ts)) == 1


def is_month_end(ts: C) -> Column:
    return F.to_date(col(ts)) == F.last_day(col(ts))


def checked(op: str, left: str, right: str) -> None:
    """TypeError for operand kinds that have no meaning; kinds are 'datetime' and 'timedelta'."""
    if (op, left, right) not in {("-", "datetime", "datetime"), ("+", "datetime", "timedelta"), ("-", "datetime", "timedelta"), ("+", "timedelta", "datetime"), ("+", "timedelta", "timedelta"), ("-", "timedelta", "timedelta")}:
        raise TypeError(f"unsupported operands: {left} {op} {right}")
