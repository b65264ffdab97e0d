import random

import pytest
from pyspark.sql import functions as F

from ferrowick.llm.caches import worker_cache
from ferrowick.llm.common import Workspace, components, free_name, marked, release, shared_dir


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000), (None, 7), (2**62, -(2**62))]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    for v in root:
        assert got.get(v, v) == find(v)
    assert all(find(v) == r for v, r in got.items())


def test_a_result_names_its_workspaces_until_it_is_released(spark, tmp_path):
    def result(name):
        with Workspace.collecting() as made:
            return marked(Workspace(spark, name).save(spark.range(3).toDF("x"), "a"), made), made

    (one, made), (two, _) = result("one"), result("two")
    assert len(made) == 1 and one.columns == ["x"]
    assert release(one).count() == 3 == one.count()  # it still reads them
    one.write.parquet(f"{tmp_path}/one")
    again = spark.read.parquet(f"{tmp_path}/one")
    clean = release(again)
    assert clean.count() == 3 == two.count() and not clean.schema["x"].metadata and again.schema["x"].metadata
    try:
        left = spark.read.parquet(made[0].path("a")).count()
    except Exception:
        left = 0
    assert left == 0
    assert release(clean).count() == 3
    odd = spark.range(1).select(F.col("id").alias("id", metadata={"ferrowick.workspaces": [f"file://{tmp_path}", "/"]}))
    assert release(odd).count() == 1 and (tmp_path / "one").is_dir()


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            applicationId, master = "a", "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared_dir(Fake)


def test_small_helpers(spark):
    assert free_name(spark.range(1).toDF("_X"), "_x") == "__x"
    made = []
    make = lambda n: lambda: made.append(n) or n
    assert [worker_cache(n, make(n)) for n in ("a", "a", "b", "a")] == ["a", "a", "b", "a"] and made == ["a", "b", "a"]
