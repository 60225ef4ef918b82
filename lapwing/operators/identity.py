"""Linking people without guessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def link(entrants: DataFrame, runners: DataFrame) -> DataFrame:
    """``entrant_id, status, runner_id`` from entrants and runners (id, key, sex, hometown).

    No runner of the key and a compatible sex: new. One: linked. Several: linked
    if exactly one has the entrant's town, else ambiguous. A runner claimed by
    several entrants makes all of these ambiguous. Both sides are summed up by
    key, sex and town before they meet, so a common name costs its rows only.
    """
    same = ["key", "sex", "hometown"]
    e, r = entrants.select(*same).distinct().alias("e"), runners.groupBy(*same).agg(F.count("id").alias("ids"), F.min("id").alias("least")).alias("r")
    fits = F.col("r.sex").isNull() | F.col("e.sex").isNull() | (F.col("r.sex") == F.col("e.sex"))
    both = e.join(r, (F.col("e.key") == F.col("r.key")) & fits, "left")
    here = F.col("e.hometown") == F.col("r.hometown")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    groups = both.groupBy(*[F.col(f"e.{c}").alias(c) for c in same]).agg(total("ids").alias("n"), total(F.when(here, F.col("ids"))).alias("near"), F.min("least").alias("only"), F.min(F.when(here, F.col("least"))).alias("only_near")).alias("g")
    back = entrants.alias("e").join(groups, [F.col(f"e.{c}").eqNullSafe(F.col(f"g.{c}")) for c in same])
    counts = back.select(F.col("e.id").alias("entrant_id"), "n", "near", "only", "only_near")
    found = F.when(F.col("n") == 1, F.col("only")).when((F.col("n") > 1) & (F.col("near") == 1), F.col("only_near"))
    status = F.when(F.col("n") == 0, "new").when(found.isNull(), "ambiguous").otherwise("linked")
    rows = counts.select("entrant_id", status.alias("status"), found.alias("runner_id"))
    claims = F.count("*").over(Window.partitionBy("runner_id"))
    twice = rows.where("runner_id is not null").withColumn("claims", claims)
    return rows.where("runner_id is null").unionByName(
        twice.select("entrant_id", F.when(F.col("claims") > 1, "ambiguous").otherwise("linked").alias("status"), F.when(F.col("claims") == 1, F.col("runner_id")).alias("runner_id"))
    )


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Consecutive equal values of a key as one run: ``key, run, value, rows``. Blanks neither end nor make a run."""
    w = Window.partitionBy(key).orderBy(*order)
    own = rows.where(F.col(value).isNotNull() & (F.trim(value) != ""))
    own = own.withColumn("new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1)))
    own = own.withColumn("run", F.sum("new").over(w))
    return own.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("rows"))


def standing(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last line of each key, at the place of its first one (later lines supersede)."""
    w = Window.partitionBy(key).orderBy(*order)
    places = lines.withColumns({"last": F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])), "first": F.first(order[-1]).over(w), "lines": F.count("*").over(Window.partitionBy(key))})
    return places.where("last = 1").drop("last")


def occurrences(earlier: DataFrame, later: DataFrame, key: str, order: str) -> DataFrame:
    """The k-th row of a key in ``later`` with the k-th of it in ``earlier``: ``key, k, earlier, later``; one is null where the other has no partner."""
    numbered = lambda d, name: d.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("k"), F.col(order).alias(name))
    return numbered(earlier, "earlier").join(numbered(later, "later"), [key, "k"], "full")


def precision_recall(pairs: DataFrame, stratum: str, said: str, truth: str) -> DataFrame:
    """Precision and recall of a decision by stratum and over all, from counts alone."""
    one = lambda *c: F.sum(F.when(F.expr(" and ".join(c)), 1).otherwise(0))
    counts = pairs.rollup(stratum).agg(F.count("*").alias("pairs"), one(f"{said} = 1", f"{truth} = 1").alias("hit"), one(f"{said} = 1").alias("claimed"), one(f"{truth} = 1").alias("real"))
    return counts.select(F.coalesce(stratum, F.lit("all")).alias(stratum), "pairs", F.round(F.try_divide("hit", "claimed"), 6).alias("precision"), F.round(F.try_divide("hit", "real"), 6).alias("recall"))
