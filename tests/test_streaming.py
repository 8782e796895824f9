"""Streams give what the batch forms give."""

from __future__ import annotations

from pyspark.sql import functions as F

from treelake.operators import states
from treelake.plans.registry import Tables
from treelake.streaming import streams


def run(df, spark, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def streamed(spark, rows, folder, files=1):
    rows.repartition(files).write.parquet(str(folder))
    return spark.readStream.schema(rows.schema).parquet(str(folder))


def test_recorder(spark, sf_dir, tmp_path):
    ticks = Tables(spark, sf_dir).ticks.withColumn("ts", F.timestamp_seconds("t"))
    wanted = ticks.groupBy("user_id", F.expr("t div 3600").alias("bin")).agg(F.count("*").alias("n"))
    found = run(streams.recorder(streamed(spark, ticks, tmp_path / "in"), 3600, 7200), spark, "recorded", "complete")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_published(spark, sf_dir, tmp_path):
    rows = Tables(spark, sf_dir).ticks.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("message"))
    found = run(streams.published(streamed(spark, rows, tmp_path / "in")), spark, "published", "append")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, states.published(rows, "key", "seq", "message").collect()))


def test_trace(spark, sf_dir, tmp_path):
    ticks = Tables(spark, sf_dir).ticks.select("t", "event_id", "event_type")
    streams.trace_to_csv(streamed(spark, ticks, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.schema(ticks.schema).csv(str(tmp_path / "out")).collect())) == sorted(map(tuple, ticks.collect()))
