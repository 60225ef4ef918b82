"""A sample of decisions for people to look at, and what it says of all decisions.

Of each stratum the pairs with the smallest hashes are drawn, so that the same archive and
seed give the same sheet, and rows may be lost and read again. Every partition keeps its
smallest before they meet, and a stratum meets in two steps, so none is one task.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_STRATUM, SEED, DRAWS = 60, "review-1", 2000
#: Parts of a stratum in which the smallest hashes are found first.
PARTS = 64
LOW, HIGH = 0.025, 0.975

_CUTS = [exp(-1) * sum(1 / factorial(i) for i in range(k + 1)) for k in range(13)]


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def draw(pairs: DataFrame, per_stratum: int = PER_STRATUM, seed: str = SEED) -> DataFrame:
    """The columns of ``pairs`` (stratum, pair: string, and more) with ``turn`` (1, 2 ... in its stratum), ``population`` and ``sampled`` of the stratum.

    Pairs of equal names are one decision each and may be drawn each. A null stratum is a stratum; a null pair is never drawn, nor counted.
    """
    rows = pairs.where("pair is not null").withColumns({"_key": F.struct("stratum"), "_hash": _hash(F.lit(seed), F.coalesce("stratum", F.lit("")), "pair")})
    part = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") % PARTS
    first = Window.partitionBy("_key", "_part").orderBy("_hash", "pair")
    few = rows.withColumn("_part", part).withColumn("_turn", F.row_number().over(first)).where(F.col("_turn") <= per_stratum).drop("_turn", "_part")
    drawn = few.withColumn("turn", F.row_number().over(Window.partitionBy("_key").orderBy("_hash", "pair"))).where(F.col("turn") <= per_stratum)
    counts = rows.groupBy("_key").agg(F.count("*").alias("population"))
    return drawn.join(counts, "_key").withColumn("sampled", F.least("population", F.lit(per_stratum))).drop("_key", "_hash")


def _luck(pair: Column, draw: Column, seed: str) -> Column:
    """A number in [0, 1) of a pair in a draw, which their hash decides; in draw 0 one that counts once."""
    return F.when(draw == 0, F.lit(0.5)).otherwise(F.conv(F.substring(_hash(F.lit(seed), pair, draw.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0))


def score(labelled: DataFrame, draws: int = DRAWS, seed: str = SEED) -> DataFrame:
    """``measure, point, low, high, labelled, unsure, unlabelled``: precision and recall of decisions, weighted to all decisions.

    From rows (stratum, pair, population, joined: boolean, label: same, different, unsure or null). Each stratum's share is found
    from its sample and counts as much as the stratum has decisions; strata in which nobody joined (for
    recall: nothing was the same) say nothing. Intervals hold 95 % of the draws that have a value. Samples are small: draws are rows.
    """
    rows = labelled.select(F.struct("stratum").alias("key"), "pair", "population", F.col("joined").cast("int").alias("joined"), F.lower(F.trim("label")).alias("label"))
    counts = rows.agg(F.count(F.when(F.col("label").isin("same", "different"), 1)).alias("labelled"), F.count(F.when(F.col("label") == "unsure", 1)).alias("unsure"), F.count(F.when(F.coalesce("label", F.lit("")) == "", 1)).alias("unlabelled"))
    sure = rows.where("label in ('same', 'different') and joined is not null").withColumn("same", (F.col("label") == "same").cast("int"))
    sure = sure.repartition(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = sure.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("luck", _luck(F.col("pair"), F.col("draw"), seed))
    drawn = drawn.where(F.col("luck") >= _CUTS[0]).withColumn("times", sum(((F.col("luck") >= c).cast("int") for c in _CUTS), F.lit(0)))
    total = lambda c: F.sum(F.col("times") * c)
    sums = drawn.groupBy("key", "draw").agg(F.max("population").alias("population"), total(F.col("joined") * F.col("same")).alias("both"), total(F.col("joined")).alias("joined"), total(F.col("same")).alias("same"))
    sides = F.explode(F.array(F.struct(F.lit("precision").alias("measure"), F.col("joined").alias("of")), F.struct(F.lit("recall").alias("measure"), F.col("same").alias("of"))))
    parts = sums.select("draw", "population", "both", sides.alias("side")).where("side.of > 0")
    values = parts.groupBy("side.measure", "draw").agg((F.sum(F.col("population") * F.col("both") / F.col("side.of")) / F.sum("population")).alias("value"))
    among = lambda p: F.percentile(F.when(F.col("draw") > 0, F.col("value")), F.lit(p))
    found = values.groupBy("measure").agg(F.max(F.when(F.col("draw") == 0, F.col("value"))).alias("point"), among(LOW).alias("low"), among(HIGH).alias("high"))
    return found.where("point is not null").join(counts)  # a row each


def decisions(resolved: DataFrame, results: DataFrame, seed: str = SEED) -> DataFrame:
    """``stratum, pair, joined, one, other``: pairs of entries that a resolver joined or kept apart, from what it said (entry_id, runner, ambiguous) and results (entry_id, race_date, town).

    ``merged, one town`` and ``merged, two towns``: two results of one person, who printed one town or several, in the latter case of two towns.
    ``split by age``: a result of each of two people of one name, every person beside the next in a hashed order, so that a name of many people
    has as many pairs as people. ``held back``: a result that was refused with one of a person of its name.
    """
    rows = resolved.join(results.select("entry_id", "race_date", "town"), "entry_id").withColumn("h", _hash(F.lit(seed), F.col("entry_id").cast("string")))
    rows = rows.withColumn("name", F.substring_index("runner", "#", 1))
    kept = rows.where("not ambiguous")
    town = F.nullif("town", F.lit(""))
    people = kept.groupBy("name", "runner").agg(F.count("*").alias("n"), F.countDistinct(town).alias("towns"), F.min(F.struct("h", "entry_id")).alias("a"), F.max(F.struct("h", "entry_id")).alias("b"), F.min(F.when(town.isNotNull(), F.struct("race_date", "entry_id", "town"))).alias("early"))
    pair = lambda one, other: F.concat_ws("-", one.cast("string"), other.cast("string"))
    out = lambda d, stratum, joined, one, other: d.select(F.lit(stratum).alias("stratum"), pair(one, other).alias("pair"), F.lit(joined).alias("joined"), one.alias("one"), other.alias("other"))
    single = out(people.where("n > 1 and towns <= 1"), "merged, one town", True, F.col("a.entry_id"), F.col("b.entry_id"))
    moved = kept.join(people.where("n > 1 and towns > 1").select("runner", "early"), "runner").where(town.isNotNull() & (town != F.col("early.town")))
    moved = moved.groupBy("runner").agg(F.first("early.entry_id").alias("one"), F.min(F.struct("h", "entry_id")).alias("other"))
    two = out(moved, "merged, two towns", True, F.col("one"), F.col("other.entry_id"))
    beside = people.withColumn("next", F.lead("a").over(Window.partitionBy("name").orderBy("a"))).where("next is not null")
    split = out(beside, "split by age", False, F.col("a.entry_id"), F.col("next.entry_id"))
    someone = people.groupBy("name").agg(F.min("b").alias("person"))
    held = out(rows.where("ambiguous").join(someone, "name"), "held back", False, F.col("entry_id"), F.col("person.entry_id"))
    return single.unionByName(two).unionByName(split).unionByName(held)
