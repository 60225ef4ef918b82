"""The hourly stream against the same groups of a batch, with files in any order."""

from pyspark.sql import functions as F

from lapwing.streaming import events as streaming


def test_hourly_is_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/events"
    schema = "event_id long, ts timestamp, event_type string, value double"
    for day in (5, 1, 3):  # later files bring events that are days late
        rows = spark.range(day * 100, day * 100 + 60).select(F.col("id").alias("event_id"), F.expr(f"timestamp'2024-01-0{day} 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7 % 300)").alias("ts"), F.expr("if(id % 3 = 0, 'a', 'b')").alias("event_type"), F.expr("id / 4.0").cast("double").alias("value"))
        rows.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = streaming.run_to_table(streaming.hourly(stream), "hourly", f"file://{tmp_path}/out", "complete")
    want = spark.read.parquet(folder).groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and sum(r.events for r in got.collect()) == 180
