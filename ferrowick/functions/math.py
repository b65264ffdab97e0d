"""Elementwise arithmetic, math and logic as Column functions with IEEE and two-valued semantics."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
C = Column | str | int | float


def col(x: Any) -> Column:
    """A name is a column, a Column itself, anything else a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def widen(x: C) -> Column:
    """Integers as bigint, so that ANSI arithmetic on narrow columns does not overflow."""
    return col(x).cast("bigint")


def add(a: C, b: C) -> Column:
    return col(a) + col(b)


def sub(a: C, b: C) -> Column:
    return col(a) - col(b)


def mul(a: C, b: C) -> Column:
    return col(a) * col(b)


def fdiv(a: C, b: C) -> Column:
    """True division on doubles: x/0 is an infinity of x's sign, 0/0 NaN, NULL where either side is."""
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = F.when(a == 0, NAN).when(a > 0, INF).when(a < 0, -INF)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def int_div(a: C, b: C) -> Column:
    """Integer division towards zero, exact over all of bigint; NULL for a zero divisor."""
    return F.call_function("div", widen(a), F.nullif(widen(b), F.lit(0)))


def mod(a: C, b: C) -> Column:
    """Remainder with the dividend's sign; NULL for a zero divisor."""
    return F.try_mod(col(a), col(b))


def _whole(f, x: Column) -> Column:
    """f (floor or ceil, which give a bigint) as a double; infinities, NaN and doubles too large to have a fraction stay."""
    return F.when(F.abs(x) < 2.0**53, f(x).cast("double")).otherwise(x)


def floordiv(a: C, b: C) -> Column:
    """The floor of the true division: x/0 is an infinity of x's sign, 0/0 NaN."""
    return _whole(F.floor, fdiv(a, b))


def pmod(a: C, b: C) -> Column:
    """Remainder with the divisor's sign, as in Python; NULL for a zero divisor."""
    a, b = col(a), F.nullif(col(b), F.lit(0))
    return ((a % b) + b) % b


def power(a: C, b: C) -> Column:
    return F.pow(col(a), col(b))


def _guarded(f, x: C) -> Column:
    x = col(x).cast("double")
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(f(x))


def ln(x: C) -> Column:
    """Natural logarithm: -inf at 0, NaN below."""
    return _guarded(F.ln, x)


def log2(x: C) -> Column:
    return _guarded(F.log2, x)


def log10(x: C) -> Column:
    return _guarded(F.log10, x)


def ceil(x: C) -> Column:
    return _whole(F.ceil, col(x).cast("double"))


def floor(x: C) -> Column:
    return _whole(F.floor, col(x).cast("double"))


def trunc(x: C) -> Column:
    x = col(x).cast("double")
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def rint(x: C, digits: int = 0) -> Column:
    """Round half to even."""
    return F.rint(col(x)) if not digits else F.bround(col(x), digits)


def round_away(x: C, digits: int = 0) -> Column:
    """Round half away from zero, on the double x * 10**digits as SQL does; ``F.round`` goes by the shortest decimal that reads as x. Infinities and NaN stay."""
    x, unit = col(x).cast("double"), 10.0**digits
    y = F.round(x * unit) / unit
    return F.when(F.abs(y) < INF, y).otherwise(x)


#: Functions of one column by name.
UNARY = {
    "abs": lambda x: F.abs(col(x)), "neg": lambda x: -col(x), "sqrt": lambda x: F.sqrt(col(x)), "exp": lambda x: F.exp(col(x)), "log": ln,
    "ceil": ceil, "floor": floor, "sin": lambda x: F.sin(col(x)), "cos": lambda x: F.cos(col(x)), "tan": lambda x: F.tan(col(x)),
    "asin": lambda x: F.asin(col(x)), "acos": lambda x: F.acos(col(x)), "atan": lambda x: F.atan(col(x)), "sinh": lambda x: F.sinh(col(x)),
    "cosh": lambda x: F.cosh(col(x)), "tanh": lambda x: F.tanh(col(x)), "log2": log2, "log10": log10, "round": rint, "trunc": trunc, "cbrt": lambda x: F.cbrt(col(x)),
}


def eq(a: C, b: C) -> Column:
    """Comparisons are two-valued: a NULL operand compares False, and True for ``ne``."""
    return F.coalesce(col(a) == col(b), F.lit(False))


def ne(a: C, b: C) -> Column:
    return F.coalesce(col(a) != col(b), F.lit(True))


def lt(a: C, b: C) -> Column:
    return F.coalesce(col(a) < col(b), F.lit(False))


def le(a: C, b: C) -> Column:
    return F.coalesce(col(a) <= col(b), F.lit(False))


def gt(a: C, b: C) -> Column:
    return F.coalesce(col(a) > col(b), F.lit(False))


def ge(a: C, b: C) -> Column:
    return F.coalesce(col(a) >= col(b), F.lit(False))


def isin(a: C, values: list) -> Column:
    """Whether the value is in the list; NULL is where the list has None."""
    some = [v for v in values if v is not None]
    hit = F.coalesce(col(a).isin(some), F.lit(False)) if some else F.lit(False)
    return hit | col(a).isNull() if len(some) < len(values) else hit


def between(a: C, low: C, high: C) -> Column:
    return ge(a, low) & le(a, high)


def clip(a: C, low: C | None = None, high: C | None = None) -> Column:
    x = y = col(a)
    if low is not None:
        y = F.greatest(y, col(low))
    if high is not None:
        y = F.least(y, col(high))
    return F.when(x.isNotNull(), y)


def where(a: C, cond: Column, other: C | None = None) -> Column:
    """The value where the condition holds, else ``other``."""
    return F.when(cond, col(a)).otherwise(F.lit(None) if other is None else col(other))


def mask(a: C, cond: Column, other: C | None = None) -> Column:
    return where(a, ~F.coalesce(cond, F.lit(False)), other)


def fillna(a: C, value: C) -> Column:
    return F.coalesce(col(a), col(value))
