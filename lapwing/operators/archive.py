"""What an archive of results holds, and who comes to it for the first time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions.running import depth_stratum
from lapwing.operators.asof import strict

STRATA = ("0", "1", "2-3", "4+")


def by_year(results: DataFrame) -> DataFrame:
    """``year, editions, courses, entries, finishes, runners`` of each year."""
    own = results.groupBy(F.year("race_date").alias("year"))
    return own.agg(F.countDistinct("race_id").alias("editions"), F.countDistinct("course_id").alias("courses"), F.count("*").alias("entries"), F.count("seconds").alias("finishes"), F.countDistinct("runner_id").alias("runners"))


def depth_counts(results: DataFrame) -> DataFrame:
    """Runners by their number of finishes, every stratum present."""
    runners = results.groupBy("runner_id").agg(F.count("seconds").alias("depth"))
    counts = runners.groupBy(depth_stratum(F.col("depth")).alias("stratum")).agg(F.count("*").alias("runners"))
    every = results.sparkSession.createDataFrame([(s,) for s in STRATA], "stratum string")
    return every.join(counts, "stratum", "left").select("stratum", F.coalesce("runners", F.lit(0)).alias("runners"))


def edition_digests(results: DataFrame) -> DataFrame:
    """``race_id, finishes, digest``: a hash of each edition's finishes that their order does not change. An edition's lines are one group, as its field is."""
    line = F.concat_ws("|", "entry_id", "runner_id", F.bround(F.col("seconds") * 1000).cast("long"))
    own = results.where("seconds is not null").groupBy("race_id").agg(F.count("*").alias("finishes"), F.sort_array(F.collect_list(line)).alias("lines"))
    return own.select("race_id", "finishes", F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))


def newcomer_offsets(results: DataFrame, least: int = 30) -> DataFrame:
    """``race_id, entry_id, sex, age_band, offset`` of each first-time finisher: log of the time over the median of those who came back, in editions with ``least`` of these."""
    rows = results.withColumn("depth", F.count("seconds").over(strict())).where("seconds is not null")
    back = rows.where("depth > 0").groupBy("race_id").agg(F.count("*").alias("back"), F.percentile("seconds", F.lit(0.5)).alias("median"))
    return rows.where("depth = 0").join(back.where(F.col("back") >= least), "race_id").select("race_id", "entry_id", "sex", "age_band", F.log(F.col("seconds") / F.col("median")).alias("offset"))


def newcomer_pool(results: DataFrame, least: int = 30) -> DataFrame:
    """The offsets by sex: how many, their mean, and their 10 to 90 % range."""
    q = lambda p, name: F.round(F.percentile("offset", F.lit(p)), 6).alias(name)
    return newcomer_offsets(results, least).groupBy("sex").agg(F.count("*").alias("n"), F.round(F.avg("offset"), 6).alias("mean"), q(0.1, "low"), q(0.5, "middle"), q(0.9, "high"))


def newcomer_shares(results: DataFrame) -> DataFrame:
    """The share of each age band among first-time finishers of either sex."""
    first = results.withColumn("depth", F.count("seconds").over(strict())).where("seconds is not null and depth = 0")
    counts = first.groupBy("sex", "age_band").agg(F.count("*").alias("n"))
    totals = counts.groupBy("sex").agg(F.sum("n").alias("total"))
    return counts.join(totals, "sex").select("sex", "age_band", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
