"""Readers, writers and constructors. NULL is the only missing value: NaN becomes NULL on the way in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL for NaN in every float and double column; other columns as they are."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]) if floats else df


def read_parquet(spark: SparkSession, path: str, nan: bool = False) -> DataFrame:
    """``nan``: turn NaN into NULL. Off by default, as a computed column hides the filter from the scan."""
    df = spark.read.parquet(path)
    return nan_to_null(df) if nan else df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, header: bool = True, **options: Any) -> DataFrame:
    """Types are inferred in a pass of their own only where no schema is given."""
    r = spark.read.options(header=header, **options)
    return nan_to_null((r.schema(schema) if schema else r.option("inferSchema", True)).csv(path))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options: Any) -> DataFrame:
    r = spark.read.options(**options)
    return nan_to_null((r.schema(schema) if schema else r).json(path))


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.orc(path))


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", by: Sequence[str] = (), **options: Any) -> None:
    df.write.mode(mode).options(**options).partitionBy(*by).format(format).save(path)


def from_dict(spark: SparkSession, data: Mapping[str, Sequence[Any]], schema: str | None = None, key: str | None = None) -> DataFrame:
    """A frame from equally long columns; ``key`` adds their positions as a column of that name."""
    names = list(data)
    sizes = {len(data[n]) for n in names}
    if len(sizes) > 1:
        raise ValueError("columns differ in length")
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in zip(*data.values(), strict=True)]
    if key:
        rows = [(i, *r) for i, r in enumerate(rows)]
        schema = f"`{key}` long, {schema}" if schema else None
        names = [key, *names]
    return spark.createDataFrame(rows, schema or names)


def from_pandas(spark: SparkSession, pdf: Any, schema: str | None = None) -> DataFrame:
    """Arrow-backed; NaN in float columns becomes NULL."""
    return nan_to_null(spark.createDataFrame(pdf, schema) if schema else spark.createDataFrame(pdf))


def column(spark: SparkSession, values: Sequence[Any], name: str = "value", type: str | None = None, key: str = "i") -> DataFrame:
    """One named column beside its positions."""
    return from_dict(spark, {name: values}, f"`{name}` {type}" if type else None, key)


def to_list(df: DataFrame, name: str, order: str | None = None) -> list:
    """The column's values on the driver, one partition at a time."""
    return [r[0] for r in (df.orderBy(order) if order else df).select(name).toLocalIterator()]
