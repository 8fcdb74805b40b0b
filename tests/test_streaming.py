from pyspark.sql import functions as F

from myospark.streaming.windows import windowed_stats


def test_stream_agrees_with_table(spark, tmp_path):
    rows = spark.range(1000).select(
        F.lit("r").alias("recording_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("channel"), F.timestamp_seconds(F.col("id") / 100).alias("ts"), F.sin("id").alias("value")
    )
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_stats(stream, "ts").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r["channel"], r["start"])
    got = sorted(spark.table("win").collect(), key=key)
    want = sorted(windowed_stats(rows, "ts").collect(), key=key)
    assert len(got) == 20 and [(r["n"], r["v_min"], r["v_max"]) for r in got] == [(r["n"], r["v_min"], r["v_max"]) for r in want]
