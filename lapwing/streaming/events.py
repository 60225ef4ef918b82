"""Structured Streaming over an event table that files are added to."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Reads the Parquet files of a path, or of its folder if it is one file, as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if _is_folder(spark, path):
        rows = reader.parquet(path)
    else:
        folder, _, name = path.rpartition("/")
        rows = reader.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each user once, at the first event that arrives of it within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id"]).select("user_id", "ts")


def hourly(events: DataFrame) -> DataFrame:
    """Count and sum of each hour and event type. For ``complete`` mode: no hour is held back, and no event is too late."""
    own = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return own.select(F.col("window.start").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


def run_to_table(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote; in ``complete`` mode, what it wrote last."""
    out, state = os.path.join(folder, name, "out"), os.path.join(folder, name, "state")
    spark = stream.sparkSession
    if mode == "complete":
        last = []

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{out}/{batch}")
            last[:] = [f"{out}/{batch}"]

        stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
