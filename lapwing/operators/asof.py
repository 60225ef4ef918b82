"""Strictly earlier history. A frame is a range of days, so rows of one day never see each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT_DAYS = 548


def strict(key: str = "runner_id", day: str = "day", back: int | None = None):
    """The window of rows of one key on earlier days, at most ``back`` days earlier."""
    return Window.partitionBy(key).orderBy(day).rangeBetween(Window.unboundedPreceding if back is None else -back, -1)


def finish() -> Column:
    """A finish as a struct in the total order of dates, races and entries; null if there was none."""
    return F.when(F.col("seconds").isNotNull(), F.struct("race_date", "race_id", "entry_id", "seconds", "distance_m", "hometown", "age_band", "day"))


def with_history(results: DataFrame) -> DataFrame:
    """Adds ``depth``, ``recent``, ``first_date`` and ``latest`` of the finishes before each entry's date."""
    return results.withColumns({
        "depth": F.count("seconds").over(strict()),
        "recent": F.count("seconds").over(strict(back=RECENT_DAYS)),
        "first_date": F.min(F.when(F.col("seconds").isNotNull(), F.col("race_date"))).over(strict()),
        "latest": F.max(finish()).over(strict()),
    })


def previous_editions(results: DataFrame) -> DataFrame:
    """``race_id, course_id, race_date, finishers, median, previous_id, previous_finishers, previous_median`` of each edition with a finisher. Editions are few, their finishers are not: they are aggregated first."""
    editions = results.where("seconds is not null").groupBy("course_id", "race_date", "race_id").agg(F.count("*").alias("finishers"), F.percentile("seconds", F.lit(0.5)).alias("median"))
    before = F.lag(F.struct("race_id", "finishers", "median")).over(Window.partitionBy("course_id").orderBy("race_date", "race_id"))
    return editions.withColumn("previous", before).select("race_id", "course_id", "race_date", "finishers", "median", F.col("previous.race_id").alias("previous_id"), F.col("previous.finishers").alias("previous_finishers"), F.col("previous.median").alias("previous_median"))


def leaks(history: DataFrame) -> DataFrame:
    """Entries whose history holds their own day or a later one: none."""
    return history.where("latest.race_date >= race_date or first_date >= race_date").groupBy().agg(F.count("*").alias("leaks"))


def category_medians(results: DataFrame, least: int = 3) -> DataFrame:
    """``entry_id, predicted, used``: the median of the previous edition in the entry's sex and band, else its sex, else all of it; the first with ``least`` finishers."""
    fin = results.where("seconds is not null")
    middle = lambda *by: fin.groupBy("race_id", *by).agg(F.count("*").alias("n"), F.percentile("seconds", F.lit(0.5)).alias("m"))
    editions = previous_editions(results).select("race_id", "previous_id")
    out = results.select("entry_id", "race_id", "sex", "age_band").join(editions, "race_id", "left")
    for name, by in (("both", ["sex", "age_band"]), ("sex", ["sex"]), ("field", [])):
        own = middle(*by).withColumnRenamed("race_id", "previous_id")
        least_here = least if by else 1
        out = out.join(own.where(F.col("n") >= least_here).select("previous_id", *by, F.col("m").alias(f"m_{name}")), ["previous_id", *by], "left")
    used = F.when(F.col("m_both").isNotNull(), "category").when(F.col("m_sex").isNotNull(), "sex").when(F.col("m_field").isNotNull(), "field").otherwise("none")
    return out.select("entry_id", F.coalesce("m_both", "m_sex", "m_field").alias("predicted"), used.alias("used"))
