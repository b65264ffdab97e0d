"""Shared helpers: a workspace in the cluster's shared folder, row ids, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_MARK = "ferrowick.workspaces"  # of a column's metadata
_MADE: ContextVar[list[Workspace] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one of our own, on one machine only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="ferrowick-")
    return _OWN_DIRS[app]


class Workspace:
    """Intermediate tables, written as Parquet where every executor can read them.

    Writing cuts the lineage: a lost executor costs the tasks of the current step only. Results are
    lazy and read these tables, so they stay until whoever has used the result releases it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ferrowick/{name}-{uuid.uuid4().hex[:12]}"
        if (made := _MADE.get()) is not None:
            made.append(self)

    @staticmethod
    @contextmanager
    def collecting() -> Iterator[list[Workspace]]:
        """The workspaces that are made within, by this thread."""
        token = _MADE.set([])
        try:
            yield _MADE.get()
        finally:
            _MADE.reset(token)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def marked(df: DataFrame, made: list[Workspace]) -> DataFrame:
    """df with the names of the workspaces that it reads in a column's metadata, which Parquet files keep."""
    first, *rest = df.schema.fields
    meta = {k: v for k, v in first.metadata.items() if k != _MARK} | ({_MARK: [ws.root for ws in made]} if made else {})
    return df.select(F.col(f"`{first.name}`").alias(first.name, metadata=meta), *[F.col(f"`{f.name}`") for f in rest])


def release(df: DataFrame) -> DataFrame:
    """Removes the workspaces that df is marked with, unless df itself reads them; gives df without the mark."""
    found = [(f.name, root) for f in df.schema.fields for root in f.metadata.get(_MARK, ())]
    if not found:
        return df
    files = df.inputFiles()
    own = shared_dir(df.sparkSession) + "/ferrowick/"
    for _, root in found:
        name = root.rpartition("/")[2]
        # only folders of this library's naming in the session's own shared folder
        if root == own + name and re.fullmatch(r"\w+-[0-9a-f]{12}", name) and not any(f"/{name}/" in f for f in files):
            _delete(df.sparkSession, root)
    return marked(df, [])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not use yet (names are compared without case)."""
    used, name = {c.lower() for c in df.columns}, base
    while name.lower() in used:
        name = "_" + name
    return name


def components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: (node, root), root the smallest node reachable.

    Alternates the large-star and small-star steps, so the number of rounds grows with the
    logarithm of the diameter and no step gathers a component in one task: each only takes the
    minimum of a node's neighbours (aggregated before the shuffle) and joins it back.
    Nodes without an edge do not appear.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = ws.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0")
    step, before = 0, None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ws.save(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"low{step}")
        # large star: neighbours above u hang on the least of u's neighbourhood
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.save(large.distinct(), f"large{step}")
        # small star: neighbours below u and u itself hang on the least of them
        least = ws.save(large.groupBy("u").agg(F.min("v").alias("m")), f"least{step}")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e2 = ws.save(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"cc{step + 1}")
        mark = tuple(e2.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        ws.drop(f"low{step}", f"large{step}", f"least{step}", f"cc{step}")
        e, step = e2, step + 1
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark

