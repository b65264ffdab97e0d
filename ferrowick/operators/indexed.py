"""Frames with named index columns: label and position access, index joins, grouping by level."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowick.operators import relational as rel


class Indexed:
    """A frame and the columns that index it. The index is data like any other; nothing is numbered or ordered by it
    until an operator asks for that."""

    def __init__(self, df: DataFrame, index: str | Sequence[str]):
        self.df = df
        self.index = [index] if isinstance(index, str) else list(index)
        if missing := [c for c in self.index if c not in df.columns]:
            raise KeyError(missing)
        self.columns = [c for c in df.columns if c not in self.index]

    def reset_index(self, drop: bool = False) -> DataFrame:
        """A plain frame, the index among its columns or dropped."""
        return self.df.select(*self.columns) if drop else self.df.select(*self.index, *self.columns)

    def sort_index(self, ascending: bool = True) -> DataFrame:
        return rel.sort_values(self.df, self.index, ascending)

    def _level(self, level: int | str) -> str:
        return self.index[level] if isinstance(level, int) else level

    def group_by(self, level: int | str | Sequence[int | str], **options: Any) -> rel.Grouped:
        """Groups of equal values of one or several index levels, by number or name."""
        levels = [level] if isinstance(level, (int, str)) else list(level)
        return rel.group_by(self.df, [self._level(x) for x in levels], **options)

    def loc(self, labels: Any, columns: str | Sequence[str] | None = None) -> DataFrame:
        """Rows by label: a value, a list of values, a slice of values (both ends included) or a boolean Column."""
        key = F.col(self.index[0])
        if isinstance(labels, Column):
            rows = labels
        elif isinstance(labels, slice):
            rows = F.lit(True)
            rows = rows & (key >= labels.start) if labels.start is not None else rows
            rows = rows & (key <= labels.stop) if labels.stop is not None else rows
        else:
            rows = key.isin(list(labels) if isinstance(labels, (list, tuple, set)) else [labels])
        chosen = self.columns if columns is None else [columns] if isinstance(columns, str) else list(columns)
        return self.df.where(rows).select(*self.index, *chosen)

    def iloc(self, start: int, stop: int | None = None) -> DataFrame:
        """Rows by place in the order of the index, which must then be one unique column."""
        return rel.slice_rows(self.df, self.index[0], start, start + 1 if stop is None else stop)

    def at(self, label: Any, column: str) -> Any:
        """One cell; KeyError without such a row."""
        got = self.loc(label, column).select(column).head(1)
        if not got:
            raise KeyError(label)
        return got[0][0]

    def iat(self, place: int, column: str) -> Any:
        """One cell by place; IndexError beyond the rows."""
        got = self.iloc(place).select(column).head(1)
        if not got:
            raise IndexError(place)
        return got[0][0]

    def join(self, other: Indexed, how: str = "left", lsuffix: str = "", rsuffix: str = "") -> Indexed:
        """A join on the indexes; columns of both sides need suffixes."""
        both = set(self.columns) & set(other.columns)
        if both and lsuffix == rsuffix:
            raise ValueError(f"columns of both sides need different suffixes: {sorted(both)}")
        right = other.df.select(*[F.col(b).alias(a) for a, b in zip(self.index, other.index, strict=True)], *other.columns)
        return Indexed(rel.merge(self.df, right, how, self.index, suffixes=(lsuffix, rsuffix)), self.index)


def set_index(df: DataFrame, index: str | Sequence[str]) -> Indexed:
    return Indexed(df, index)
