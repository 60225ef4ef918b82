"""Scores of predictions against results, with coverage and resampled intervals."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions.running import depth_stratum, riegel
from lapwing.operators.asof import category_medians, with_history

#: Edges of the distance bands, half open.
BANDS = (0.0, 3000.0, 6000.0, 9000.0, 12000.0, 18000.0, 30000.0, 1e9)
LEVEL, CALIBRATION = 0.8, 50
#: Resamples of published intervals; numbers of 64 bits from which on a unit is drawn once, twice and so on.
DRAWS = 2000
CUTS = np.array([int(exp(-1) * sum(1 / factorial(i) for i in range(k + 1)) * 2**53) << 11 for k in range(17)], np.uint64)


def carried(results: DataFrame) -> DataFrame:
    """Finishes with ``carry`` (the latest finish, carried over) and ``stratum``."""
    rows = with_history(results).where("seconds is not null")
    rows = rows.withColumn("carry", riegel(F.col("latest.seconds"), F.col("latest.distance_m"), F.col("distance_m")))
    return rows.withColumn("stratum", depth_stratum(F.col("depth"))).drop("latest")


def scored(results: DataFrame) -> DataFrame:
    """Finishes with ``carry``, ``stratum`` and ``median`` (of the category)."""
    return carried(results).join(category_medians(results).select("entry_id", F.col("predicted").alias("median")), "entry_id")


def summary(rows: DataFrame, predicted: str, by: str) -> DataFrame:
    """Runners, answered, coverage, mae (minutes), mape and bias, for each value of ``by`` and for all."""
    gap = F.col(predicted) - F.col("seconds")
    out = rows.rollup(by).agg(F.count("*").alias("runners"), F.count(predicted).alias("answered"), F.avg(F.abs(gap) / 60).alias("mae"), F.avg(F.abs(gap) / F.col("seconds")).alias("mape"), F.avg(gap / 60).alias("bias"))
    return out.select(F.coalesce(by, F.lit("all")).alias(by), "runners", "answered", F.round(F.col("answered") / F.col("runners"), 6).alias("coverage"), *[F.round(c, 6).alias(c) for c in ("mae", "mape", "bias")])


def tie_rank(value: str, *by: str) -> Column:
    """Ranks that share their average among ties."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def place_errors(rows: DataFrame, predicted: str, least: int = 3) -> DataFrame:
    """Mean gap of places and Spearman's correlation in each race of ``least`` answered runners."""
    own = rows.where(F.col(predicted).isNotNull()).select("race_id", "entry_id", predicted, "seconds")
    own = own.withColumns({"p": tie_rank(predicted, "race_id"), "a": tie_rank("seconds", "race_id")})
    out = own.groupBy("race_id").agg(F.count("*").alias("runners"), F.avg(F.abs(F.col("p") - F.col("a"))).alias("gap"), F.try_divide(F.covar_pop("p", "a"), F.stddev_pop("p") * F.stddev_pop("a")).alias("rho"))
    return out.where(F.col("runners") >= least).select("race_id", "runners", F.round("gap", 6).alias("place_gap"), F.round("rho", 6).alias("spearman"))


def band_of(distance: Column) -> Column:
    out = F.lit(None).cast("int")
    for k in range(len(BANDS) - 1):
        out = F.when((distance >= BANDS[k]) & (distance < BANDS[k + 1]), k).otherwise(out)
    return out


def order_statistics(rows: DataFrame, by: str, value: str, ranks: dict[str, Column], buckets: int = 1024) -> DataFrame:
    """``by, n`` and, for each name in ``ranks``, the value of that rank from below (1-based; an expression of ``n``).

    Values are counted in buckets between each group's limits; running counts
    tell the bucket of each rank, and only that bucket's values are ordered, so no
    task sees a group. Of a bucket, equal values count as one row.
    """
    rows = rows.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).where("v is not null")
    limits = rows.groupBy("by").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    step = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets), F.lit(buckets - 1))).otherwise(0).cast("int")
    rows = rows.join(limits.select(F.col("by").alias("b"), "low", "high"), F.col("by").eqNullSafe(F.col("b"))).select("by", "v", step.alias("bucket"))
    upto = F.sum("c").over(Window.partitionBy("by").orderBy("bucket"))
    counts = rows.groupBy("by", "bucket").agg(F.count("*").alias("c")).withColumn("upto", upto)
    wanted = limits.select(F.col("by").alias("b"), "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("long").alias("rank")) for k, v in ranks.items()])).alias("w")).select("b", "n", "w.*")
    where = counts.join(wanted, F.col("by").eqNullSafe(F.col("b"))).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
    where = where.select("b", F.col("bucket").alias("at"), "name", "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("inside"))
    few = rows.groupBy("by", "bucket", "v").agg(F.count("*").alias("m")).join(where.select("b", "at").distinct(), F.col("by").eqNullSafe(F.col("b")) & (F.col("bucket") == F.col("at")), "left_semi")
    few = few.withColumn("last", F.sum("m").over(Window.partitionBy("by", "bucket").orderBy("v")))
    found = few.join(where, F.col("by").eqNullSafe(F.col("b")) & (F.col("bucket") == F.col("at"))).where((F.col("inside") <= F.col("last")) & (F.col("inside") > F.col("last") - F.col("m")))
    return found.groupBy(F.col("by").alias(by)).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])


def spread(rows: DataFrame, predicted: str, by: Column) -> DataFrame:
    """Median miss and the floor(0.9 n)-th one from below (an order statistic, not interpolated)."""
    own = rows.where(F.col(predicted).isNotNull()).select(by.alias("band"), (F.abs(F.col(predicted) - F.col("seconds")) / 60).alias("miss"))
    n = F.col("n")
    found = order_statistics(own, "band", "miss", {"one": F.floor((n + 1) / 2), "two": F.floor(n / 2) + 1, "p90": F.least(F.floor(n * F.lit(0.9)), n - 1) + 1})
    return found.select("band", n.alias("runners"), F.round((F.col("one") + F.col("two")) / 2, 6).alias("median_miss"), F.round("p90", 6).alias("p90_miss"))


def field_position(rows: DataFrame) -> DataFrame:
    """Adds ``position``: front, mid or back of the race, by the share of its finishers that are faster."""
    share = (F.rank().over(Window.partitionBy("race_id").orderBy("seconds")) - 0.5) / F.count("*").over(Window.partitionBy("race_id"))
    return rows.withColumn("position", F.when(share < 0.25, "front").when(share < 0.75, "mid").otherwise("back"))


def paired(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Both models on the runners that both answer, as shares of the finish time."""
    own = rows.where(F.col(one).isNotNull() & F.col(other).isNotNull())
    miss = lambda c: F.abs(F.col(c) - F.col("seconds")) / F.col("seconds")
    return own.groupBy("stratum").agg(F.count("*").alias("runners"), F.round(F.avg(miss(one) - miss(other)) * 100, 6).alias("gap_points"), F.round(F.avg((miss(one) < miss(other)).cast("double")), 6).alias("won"))


def drawn_counts(seeds: np.ndarray, draws: int) -> np.ndarray:
    """How often each unit is in each resample, as Poisson numbers of mean 1 that its seed and the draw alone decide."""
    x = seeds.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(CUTS, x ^ (x >> np.uint64(31)), "right")


def _resample(batches: Iterator[pa.RecordBatch], draws: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str | None, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * draws, pa.string()), pa.array(np.arange(1, draws + 1)), pa.array(v[0]), pa.array(v[1])], names=["by", "draw", "total", "n"])
        sums.clear()

    for batch in batches:
        by = np.array(batch.column("by").to_pylist(), object)
        seeds, *values = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "total", "n"))
        own = np.stack(values).astype(np.float64)
        for at in range(0, len(by), 512):
            counts = drawn_counts(seeds[at : at + 512], draws).astype(np.float64)
            piece = by[at : at + 512]
            for k in set(piece):
                mine = np.array([x == k for x in piece])
                sums[k] = sums.get(k, 0) + own[:, at : at + 512][:, mine] @ counts[mine]
            if len(sums) > 256:
                yield from flush()
    yield from flush()


def bootstrap_whole(rows: DataFrame, unit: str, value: Column, by: str, draws: int = DRAWS, seed: Column | None = None) -> DataFrame:
    """Mean of ``value`` for each ``by``, with the 2.5 and 97.5 % points over resamples of whole units.

    Units are summed up first, and a task sums up its units for all draws at
    once, so what is shuffled is one row a task, group and draw. ``seed`` (of a
    unit; by default a hash of it) decides how often the unit is in each draw.
    """
    seed = F.xxhash64(unit) if seed is None else seed
    units = rows.groupBy(F.col(by).cast("string").alias("by"), unit).agg(F.sum(value).cast("double").alias("total"), F.count(value).alias("n")).where("n > 0")
    sums = units.select("by", seed.alias("seed"), "total", "n").mapInArrow(lambda batches: _resample(batches, draws), "by string, draw long, total double, n double")
    means = sums.groupBy("by", "draw").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("mean"))
    limits = means.groupBy("by").agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))
    points = units.groupBy("by").agg(F.round(F.sum("total") / F.sum("n"), 6).alias("point"), F.sum("n").alias("n")).alias("p")
    return points.join(limits.alias("l"), F.col("p.by").eqNullSafe(F.col("l.by"))).select(F.col("p.by").alias(by), "point", "n", "low", "high")


def paired_interval(rows: DataFrame, one: str, other: str, draws: int = DRAWS, seed: Column | None = None) -> DataFrame:
    """Both models on the runners that both answer: races, runners, mean errors in seconds, and how much larger the first one's error is, in points of a hundredth on the log scale, with its interval over resampled races."""
    own = rows.where(F.col(one).isNotNull() & F.col(other).isNotNull())
    miss = lambda c: F.abs(F.log(F.col(c) / F.col("seconds")))
    own = own.withColumn("gap", miss(one) - miss(other))
    error = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col("seconds"))), 6)
    sums = own.groupBy("stratum").agg(F.countDistinct("race_id").alias("races"), F.count("*").alias("runners"), error(one).alias("model_mae"), error(other).alias("other_mae"), F.round(F.avg("gap") * 100, 6).alias("difference"))
    return sums.join(bootstrap_whole(own, "race_id", F.col("gap") * 100, "stratum", draws, seed).select("stratum", "low", "high"), "stratum")


def intervals(rows: DataFrame, width: float = 0.1) -> DataFrame:
    """Raw intervals around ``carry`` and the conformity score of each: how far, in logs, the result lies outside."""
    low, high = F.col("carry") * F.lit(1 - width), F.col("carry") * F.lit(1 + width)
    out = rows.where("carry is not null").withColumns({"low": low, "high": high})
    return out.withColumn("score", F.greatest(F.log("low") - F.log("seconds"), F.log("seconds") - F.log("high")))


def rolling_thresholds(own: DataFrame, level: float = LEVEL, least: int = CALIBRATION, buckets: int = 512) -> DataFrame:
    """``stratum, race_date, pool, threshold``: for each date the ceil((n + 1) level)-th smallest score of strictly earlier dates; null under ``least`` scores, infinite beyond them.

    Scores are counted by date and bucket (of ``buckets`` or more between a stratum's
    limits), and the counts summed up over earlier dates and then over buckets,
    which gives the bucket that holds each date's order statistic. Only the scores
    of that bucket are joined with the date, so dates never meet whole pools. Buckets grow in number with
    the root of a stratum's scores, as do those that a bucket holds. Tables of a row a stratum, or a stratum and date, are
    broadcast, so that no task gets a whole stratum.
    """
    own = own.select("stratum", "race_date", "score")
    limits = own.groupBy("stratum").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.greatest(F.lit(buckets), F.ceil(4 * F.sqrt(F.count("*")))).alias("buckets"))
    step = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("buckets")), F.col("buckets") - 1)).otherwise(0).cast("int")
    scores = own.join(F.broadcast(limits), "stratum").select("stratum", "race_date", step.alias("bucket"), "score").groupBy("stratum", "race_date", "bucket", "score").agg(F.count("*").alias("c"))
    counts = scores.groupBy("stratum", "race_date", "bucket").agg(F.sum("c").alias("c"))
    dates, places = counts.select("stratum", "race_date").distinct(), counts.select("stratum", "bucket").distinct()
    grid = dates.join(places, "stratum").join(counts, ["stratum", "race_date", "bucket"], "left")
    earlier = F.coalesce(F.sum("c").over(Window.partitionBy("stratum", "bucket").orderBy("race_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = Window.partitionBy("stratum", "race_date")
    grid = grid.select("stratum", "race_date", "bucket", earlier.alias("e")).withColumns({"upto": F.sum("e").over(key.orderBy("bucket")), "pool": F.sum("e").over(key)})
    wanted = F.ceil((F.col("pool") + 1) * F.lit(level))
    pools = grid.groupBy("stratum", "race_date").agg(F.max("pool").alias("pool"), F.min(F.when((F.col("upto") >= wanted) & (F.col("pool") >= least), F.struct("bucket", (wanted - F.col("upto") + F.col("e")).alias("inside")))).alias("at"))
    asked = pools.where("at is not null").select("stratum", F.col("race_date").alias("date"), "at.bucket", "at.inside")
    inside = scores.join(F.broadcast(asked), ["stratum", "bucket"]).where("race_date < date")
    inside = inside.groupBy("stratum", "date", "inside", "score").agg(F.sum("c").alias("c"))
    inside = inside.withColumn("upto", F.sum("c").over(Window.partitionBy("stratum", "date").orderBy("score"))).where("upto >= inside")
    found = inside.groupBy("stratum", F.col("date").alias("race_date")).agg(F.min("score").alias("score"))
    cut = F.when(F.col("pool") >= least, F.coalesce("score", F.lit(float("inf"))))
    return pools.join(found, ["stratum", "race_date"], "left").select("stratum", "race_date", "pool", cut.alias("threshold"))


def coverage(own: DataFrame) -> DataFrame:
    """Share of results inside raw and adjusted intervals, on rows that could be adjusted."""
    rows = own.join(F.broadcast(rolling_thresholds(own)), ["stratum", "race_date"]).where("threshold is not null")
    inside = lambda a, b: F.avg(F.col("seconds").between(a, b).cast("double"))
    return rows.groupBy("stratum").agg(F.count("*").alias("runners"), F.round(inside(F.col("low"), F.col("high")), 6).alias("raw"), F.round(inside(F.col("low") * F.exp(-F.col("threshold")), F.col("high") * F.exp("threshold")), 6).alias("adjusted"))
