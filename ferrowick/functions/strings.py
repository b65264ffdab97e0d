"""String functions over code points, null-aware: NULL in, NULL out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .math import C, col

WS = r"[ \t\n\r\x0B\f]"


def contains(s: C, pattern: str, regex: bool = False) -> Column:
    return col(s).rlike(pattern) if regex else col(s).contains(pattern)


def startswith(s: C, p: str) -> Column:
    return col(s).startswith(p)


def endswith(s: C, p: str) -> Column:
    return col(s).endswith(p)


def find(s: C, p: str) -> Column:
    """First place from 0, -1 where absent; 0 for an empty pattern."""
    return (F.instr(col(s), p) - 1).cast("bigint") if p else F.when(col(s).isNotNull(), F.lit(0).cast("bigint"))


def lower(s: C) -> Column:
    return F.lower(col(s))


def upper(s: C) -> Column:
    return F.upper(col(s))


def casefold(s: C) -> Column:
    """Lower case, and ß as ss."""
    return F.replace(F.lower(col(s)), F.lit("ß"), F.lit("ss"))


def swapcase(s: C) -> Column:
    s = col(s)
    flip = F.transform(F.split(s, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x)))
    return F.when(s == "", s).otherwise(F.array_join(flip, ""))


def title(s: C) -> Column:
    """Every run of letters capitalised; any other character is a boundary."""
    s = col(s)
    runs = F.transform(F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), capitalize)
    return F.when(s.isNotNull(), F.array_join(runs, ""))


def capitalize(s: C) -> Column:
    s = col(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def strip(s: C) -> Column:
    return F.regexp_replace(col(s), rf"^{WS}+|{WS}+\z", "")


def lstrip(s: C) -> Column:
    return F.regexp_replace(col(s), rf"^{WS}+", "")


def rstrip(s: C) -> Column:
    return F.regexp_replace(col(s), rf"{WS}+\z", "")


def replace(s: C, pattern: str, to: str, regex: bool = False) -> Column:
    if regex:
        return F.regexp_replace(col(s), pattern, to)
    return F.replace(col(s), F.lit(pattern), F.lit(to)) if pattern else col(s)


def length(s: C) -> Column:
    return F.length(col(s)).cast("bigint")


def count(s: C, p: str, regex: bool = False) -> Column:
    """Occurrences without overlap; an empty pattern stands before and after every character."""
    s = col(s)
    if not p:
        return length(s) + 1
    parts = F.size(F.split(s, p if regex else re.escape(p), -1)) - 1
    return F.when(s.isNotNull(), parts).cast("bigint")


#: Whole-string tests by name.
CLASSES = {
    "isalpha": lambda s: s.rlike(r"\A\p{L}+\z"), "isdigit": lambda s: s.rlike(r"\A[0-9]+\z"), "isspace": lambda s: s.rlike(rf"\A{WS}+\z"),
    "isalnum": lambda s: s.rlike(r"\A[\p{L}\p{N}]+\z"), "isupper": lambda s: s.rlike(r"\p{Lu}") & ~s.rlike(r"[\p{Ll}\p{Lt}]"),
    "islower": lambda s: s.rlike(r"\p{Ll}") & ~s.rlike(r"[\p{Lu}\p{Lt}]"), "istitle": lambda s: s.rlike(r"\p{L}") & ~s.rlike(r"(?<!\p{L})\p{Ll}|\p{L}\p{Lu}"),
    "isnumeric": lambda s: s.rlike(r"\A\p{N}+\z"), "isdecimal": lambda s: s.rlike(r"\A\p{Nd}+\z"),
}


def is_class(name: str, s: C) -> Column:
    return CLASSES[name](col(s))


def slice_(s: C, start: int | None = None, stop: int | None = None) -> Column:
    """Characters from start to before stop; negative places count from the end."""
    s = col(s)
    n = F.length(s)

    def place(k: int | None, default: Column) -> Column:
        return default if k is None else F.greatest(n + k, F.lit(0)) if k < 0 else F.least(F.lit(k), n)

    a, b = place(start, F.lit(0)), place(stop, n)
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def get(s: C, i: int) -> Column:
    """The character at place i; NULL out of range."""
    s = col(s)
    at = F.lit(i) if i >= 0 else F.length(s) + i
    return F.when(at >= 0, F.nullif(F.substring(s, at + 1, F.lit(1)), F.lit("")))


def repeat(s: C, n: int) -> Column:
    return F.repeat(col(s), n)


def pad(s: C, width: int, side: str = "left", fill: str = " ") -> Column:
    """Never truncates; ``both`` gives the odd character to the left where width is odd."""
    s = col(s)
    to = F.greatest(F.lit(width), F.length(s))
    if side == "left":
        return F.lpad(s, to, F.lit(fill))
    if side == "right":
        return F.rpad(s, to, F.lit(fill))
    if side != "both":
        raise ValueError("side is left, right or both")
    p = F.greatest(F.lit(width) - F.length(s), F.lit(0))
    left = F.floor(p / 2).cast("int") + p.bitwiseAND(F.lit(width)).bitwiseAND(F.lit(1))
    return F.rpad(F.lpad(s, F.length(s) + left, F.lit(fill)), to, F.lit(fill))


def center(s: C, width: int, fill: str = " ") -> Column:
    return pad(s, width, "both", fill)


def ljust(s: C, width: int, fill: str = " ") -> Column:
    return pad(s, width, "right", fill)


def rjust(s: C, width: int, fill: str = " ") -> Column:
    return pad(s, width, "left", fill)


def zfill(s: C, width: int) -> Column:
    """Zeros from the left, behind a sign."""
    s = col(s)
    head, rest = F.substring(s, 1, 1), F.substring(s, F.lit(2), F.length(s))
    return F.when(head.isin("+", "-"), F.concat(head, F.lpad(rest, F.greatest(F.lit(width - 1), F.length(rest)), F.lit("0")))).otherwise(pad(s, width, "left", "0"))


def removeprefix(s: C, p: str) -> Column:
    s = col(s)
    return F.when(s.startswith(p), F.substring(s, F.lit(len(p) + 1), F.length(s))).otherwise(s)


def removesuffix(s: C, p: str) -> Column:
    s = col(s)
    return F.when(s.endswith(p), F.substring(s, F.lit(1), F.length(s) - len(p))).otherwise(s)


def split_part(s: C, sep: str, i: int) -> Column:
    """The i-th part (from 0) between literal separators; NULL past the last."""
    return F.get(F.split(col(s), re.escape(sep), -1), F.lit(i))


def cat(*parts: C, sep: str = "") -> Column:
    """Joined; NULL where any part is."""
    cols = [col(p) for p in parts]
    return F.concat(*[x for c in cols for x in (F.lit(sep), c)][1:])


def extract(s: C, pattern: str, group: int = 1) -> Column:
    return F.when(col(s).rlike(pattern), F.regexp_extract(col(s), pattern, group))
