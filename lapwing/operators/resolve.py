"""Who is who among results of one name, and what courses cost once runners are held level."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions import printed
from lapwing.sources.shared import drop, save

ROUNDS = 30
MAX_TREND = 0.05


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by key and in time order; of a key only its people's birth years and towns are held."""
    key, people = None, []
    for rows in batches:
        who, fitting = [], []
        for k, first, last, town in zip(rows["key"], rows["first"], rows["last"], rows["town"], strict=True):
            if k != key:
                key, people = k, []
            known = first == first and first is not None
            fits = [p for p in people if not known or p["first"] is None or (first <= p["last"] and p["first"] <= last)]
            if len(fits) > 1 and town:
                here = [p for p in fits if town in p["towns"]]
                fits = here if len(here) == 1 else fits
            fitting.append(len(fits))
            if len(fits) > 1:
                who.append(None)
                continue
            if not fits:
                fits = [{"number": len(people), "first": None, "last": None, "towns": set()}]
                people += fits
            p = fits[0]
            if known:
                p["first"], p["last"] = (first, last) if p["first"] is None else (max(first, p["first"]), min(last, p["last"]))
            p["towns"].add(town)
            who.append(p["number"])
        yield pd.DataFrame({"entry_id": rows["entry_id"], "key": rows["key"], "number": pd.array(who, "Int32"), "candidates": fitting})


def resolve(results: DataFrame) -> DataFrame:
    """``entry_id, runner, ambiguous, candidates`` from results (entry_id, name, race_date, race_id, sex, age_band, hometown).

    Down the dates of one name a result joins the person whose birth years it
    fits, starts a new one if it fits none, and where several fit goes by a town
    that only one of them ever gave; else it is held back, never guessed. A
    person whose results disagree about sex is ambiguous. Names are dealt out and
    sorted by Spark and swept as a stream, so one name of any number of results
    needs room for its people only. A null name has the empty key.
    """
    window = printed.birth_window(F.col("age_band"), F.col("race_date"))
    keyed = results.select("entry_id", F.coalesce(printed.name_key(F.col("name")), F.lit("")).alias("key"), "race_date", "race_id", "sex", window["first"].alias("first"), window["last"].alias("last"), printed.town_key(F.col("hometown")).alias("town"))
    swept = keyed.repartition("key").sortWithinPartitions("key", "race_date", "race_id", "entry_id")
    swept = swept.select("entry_id", "key", "first", "last", "town").mapInPandas(_sweep, "entry_id long, key string, number int, candidates int")
    people = swept.join(keyed.select("entry_id", "sex"), "entry_id")
    sexes = people.where("number is not null").groupBy("key", "number").agg((F.min("sex") != F.max("sex")).alias("torn"))
    runner = F.when(F.col("number").isNull(), F.concat("key", F.lit("#held#"), F.col("entry_id").cast("string"))).when(F.col("number") == 0, F.col("key")).otherwise(F.concat("key", F.lit("#"), F.col("number").cast("string")))
    return people.join(sexes, ["key", "number"], "left").select("entry_id", runner.alias("runner"), (F.col("number").isNull() | F.coalesce("torn", F.lit(False))).alias("ambiguous"), "candidates")


def town_switches(resolved: DataFrame, results: DataFrame) -> DataFrame:
    """``runner, finishes, switches``: how often a person's printed town changed; more than one change hints at two people."""
    w = Window.partitionBy("runner").orderBy("race_date", "race_id", "entry_id")
    rows = resolved.join(results.select("entry_id", "race_date", "race_id", "seconds", printed.town_key(F.col("hometown")).alias("town")), "entry_id")
    last = F.last(F.nullif("town", F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("moved", ((F.col("town") != "") & (F.col("town") != last)).cast("int")).groupBy("runner").agg(F.count("seconds").alias("finishes"), F.coalesce(F.sum("moved"), F.lit(0)).alias("switches"))


def two_way(rows: DataFrame, group: str, rounds: int = ROUNDS) -> DataFrame:
    """``group, finishes, effect`` from rows (runner_id, <group>, year, y).

    Alternates, ``rounds`` times: a level and a clipped yearly slope for every
    runner given the groups' effects, then the groups' mean residuals; at the end
    they are centred on all rows. Rows are summed up by runner and group once, and
    the rounds read these sums; effects are a table of any size. Runners need two
    rows or more.
    """
    rows = rows.select("runner_id", F.col(group).cast("string").alias("g"), "year", "y").where("y is not null and runner_id is not null and g is not null")
    stats = rows.groupBy("runner_id").agg(F.min("year").alias("start"), F.count("*").alias("n")).where("n >= 2")
    rows = rows.join(stats.drop("n"), "runner_id").withColumn("x", (F.col("year") - F.col("start")).cast("double"))
    cells = rows.groupBy("runner_id", "g").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    cells = cells.repartition("runner_id").persist()
    effects = save(cells.groupBy("g").agg(F.sum("n").alias("finishes"), F.lit(0.0).alias("effect")), "effects")
    over = lambda c: F.sum(c).over(Window.partitionBy("runner_id"))
    e = F.col("effect")
    for _ in range(rounds):
        now = cells.join(effects.drop("finishes"), "g").select("g", "n", "sx", "sy", over(F.col("n")).alias("k"), over(F.col("sx")).alias("x"), over(F.col("sxx")).alias("xx"), over(F.col("sy") - F.col("n") * e).alias("r"), over(F.col("sxy") - F.col("sx") * e).alias("xr"))
        spread = F.col("k") * F.col("xx") - F.col("x") * F.col("x")
        now = now.withColumn("slope", F.when(spread > 1e-9, F.greatest(F.least((F.col("k") * F.col("xr") - F.col("x") * F.col("r")) / spread, F.lit(MAX_TREND)), F.lit(-MAX_TREND))).otherwise(0.0))
        level = (F.col("r") - F.col("slope") * F.col("x")) / F.col("k")
        means = now.groupBy("g").agg(F.sum("n").alias("finishes"), (F.sum(F.col("sy") - F.col("n") * level - F.col("slope") * F.col("sx")) / F.sum("n")).alias("effect"))
        means = save(means, "effects")
        drop(effects)
        effects = means
    cells.unpersist()
    centre = effects.agg(F.sum(F.col("effect") * F.col("finishes")) / F.sum("finishes")).first()[0]
    return effects.select(F.col("g").alias(group), "finishes", (F.col("effect") - F.lit(centre)).alias("effect"))
