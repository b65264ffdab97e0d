from pyspark.sql import functions as F

from ferrowick.functions import math as m
from ferrowick.streaming import each_batch, windowed


def test_windows_and_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, t string, k int").selectExpr("i", "cast(t as timestamp) t", "k")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = each_batch(stream.withColumn("v", m.fdiv("i", 2)), lambda b: b.groupBy("k").agg(F.sum("v").alias("v")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 45.0), (1, 50.0)]
    w = windowed(stream, "t", ["k"], "10 minutes", "1 minute", n=F.count("*"), s=F.sum("i"))
    q = w.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n, r.s) for r in spark.table("w").collect()) == [(0, 5, 20), (0, 5, 70), (1, 5, 25), (1, 5, 75)]
