"""Streams over files against the same operator on the bounded table."""

import datetime

from pyspark.sql import functions as F

from quillmark.streaming import jobs

SCHEMA = "doc_id long, text string, at timestamp"


def streamed(spark, tmp_path, build):
    rows = [(i, ["a b c d", "A  b c, d!", "x y z", None][i % 4], datetime.datetime(2024, 1, 1, i % 3, i)) for i in range(40)]
    batch = spark.createDataFrame(rows, SCHEMA)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
    query.format("parquet").outputMode("append").start(str(tmp_path / "out")).awaitTermination()
    return batch, spark.read.parquet(str(tmp_path / "out"))


def test_first_copies(spark, tmp_path):
    _, out = streamed(spark, tmp_path, lambda s: jobs.first_copies(s, "at", "1 day"))
    assert out.count() == out.select("text_hash").distinct().count() == 3


def test_windowed_counts(spark, tmp_path):
    batch, out = streamed(spark, tmp_path, lambda s: jobs.windowed_counts(s.withColumn("k", F.col("doc_id") % 2), "at", "k"))
    want = {(r[0], r[1]): r[2] for r in batch.groupBy(F.date_trunc("hour", "at"), F.col("doc_id") % 2).count().collect()}
    got = {(r[0], r[1]): r[2] for r in out.collect()}
    assert got and all(want[k] == n for k, n in got.items())  # the last windows stay open


def test_contaminated(spark, tmp_path):
    known = spark.createDataFrame([("b c d",)], "text string")
    _, out = streamed(spark, tmp_path, lambda s: jobs.contaminated(s, known, 3))
    assert out.count() == 20 and {r.shingle for r in out.collect()} == {"b c d"}
