"""Whole fields from draws, and the hours around a race."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def draws(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, draw, value`` of each component of each vector."""
    return vectors.select("vec_id", "label", F.posexplode("embedding").alias("draw", "x")).select("vec_id", "label", "draw", F.col("x").cast("double").alias("value"))


def places(rows: DataFrame) -> DataFrame:
    """Place of each runner in each draw of its field; ties share the better place."""
    return rows.withColumn("place", F.rank().over(Window.partitionBy("label", "draw").orderBy("value")))


def place_summary(rows: DataFrame) -> DataFrame:
    """Median place, its 10 to 90 % range, and the share of draws in the first ten."""
    q = lambda p: F.percentile("place", F.lit(p))
    return places(rows).groupBy("vec_id").agg(F.round(q(0.5), 6).alias("median_place"), F.round(q(0.1), 6).alias("low_place"), F.round(q(0.9), 6).alias("high_place"), F.round(F.avg((F.col("place") <= 10).cast("double")), 6).alias("top_ten"))


def expected_in_top(rows: DataFrame, top: int = 10) -> DataFrame:
    """How many of the odd ids are among the first of each field: mean and 10 to 90 % over draws."""
    counts = places(rows).groupBy("label", "draw").agg(F.sum(F.when((F.col("place") <= top) & (F.col("vec_id") % 2 == 1), 1).otherwise(0)).alias("n"))
    return counts.groupBy("label").agg(F.round(F.avg("n"), 6).alias("expected"), F.round(F.percentile("n", F.lit(0.1)), 6).alias("low"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("high"))


def quantiles(rows: DataFrame) -> DataFrame:
    """The seven quantiles of each vector's draws."""
    out = rows.groupBy("vec_id").agg(F.percentile("value", F.array(*[F.lit(q) for q in QUANTILES])).alias("q"))
    return out.select("vec_id", *[F.round(F.col("q")[k], 5).alias(f"q{int(100 * q):02d}") for k, q in enumerate(QUANTILES)])


def hourly_wind(events: DataFrame) -> DataFrame:
    """Mean value and vector mean of wind for each hour: readings (value, direction it comes from) as components, then back."""
    direction = F.get_json_object("props", "$.k").cast("int") % 36 * 10
    rad = F.radians(direction.cast("double"))
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("readings"), F.avg("value").alias("v"), F.avg(-F.col("value") * F.sin(rad)).alias("u"), F.avg(-F.col("value") * F.cos(rad)).alias("w"))
    return hours.select("hour", "readings", F.round("v", 6).alias("mean_value"), F.round(F.sqrt(F.col("u") * F.col("u") + F.col("w") * F.col("w")), 6).alias("wind"))


def forecast_error(events: DataFrame, least: int = 3) -> DataFrame:
    """Bias and sample deviation of each user's reading against the hour's mean, by event type, from ``least`` pairs on."""
    hour = F.date_trunc("hour", "ts")
    means = events.groupBy(hour.alias("hour")).agg(F.avg("value").alias("mean"))
    gaps = events.withColumn("hour", hour).join(means, "hour").withColumn("gap", F.col("value") - F.col("mean"))
    return gaps.groupBy("event_type").agg(F.count("*").alias("pairs"), F.round(F.avg("gap"), 6).alias("bias"), F.round(F.stddev_samp("gap"), 6).alias("deviation")).where(F.col("pairs") >= least)


def bounds_for(level: float) -> tuple[int, int]:
    """Places among ``QUANTILES`` of the edges of a central interval."""
    carried = [round(q, 4) for q in QUANTILES]
    edges = [round((1 - level) / 2, 4), round((1 + level) / 2, 4)]
    if missing := set(edges) - set(carried):
        raise ValueError(f"quantiles not carried: {sorted(missing)}")
    return carried.index(edges[0]), carried.index(edges[1])
