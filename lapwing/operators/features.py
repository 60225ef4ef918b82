"""Features and fits on strictly earlier history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.operators.asof import RECENT_DAYS, strict

#: Weight that a finish loses in this many days is a half.
HALF_LIFE = 365.0


def ratio(results: DataFrame) -> DataFrame:
    """Adds ``r``: the log of the time over the course distance's own pace (0.3 s a metre)."""
    return results.withColumn("r", F.log(F.col("seconds") / (F.col("distance_m") * F.lit(0.3))))


def form(results: DataFrame) -> DataFrame:
    """Level, trend and decay of each entry's earlier finishes.

    Sums of decaying weights run forward: with weights 2^(day / half-life), one
    range frame gives them for every date, without listing any history.
    """
    rows = ratio(results)
    years = F.col("day") / F.lit(365.25)
    seen = F.col("r").isNotNull()
    w, recent = strict(), strict(back=RECENT_DAYS)
    weight = F.when(seen, F.pow(F.lit(2.0), (F.col("day") - 10000) / F.lit(HALF_LIFE)))
    first = F.min(F.when(seen, F.col("day"))).over(w)
    last = F.max(F.when(seen, F.col("day"))).over(w)
    rows = rows.withColumns({"w": weight, "wr": weight * F.col("r"), "years": F.when(seen, years)})
    rows = rows.withColumns({
        "results": F.count("r").over(w), "best_ever": F.min("r").over(w), "best_recent": F.min("r").over(recent), "latest": F.max(F.when(seen, F.struct("day", "entry_id", "r"))).over(w)["r"],
        "spread": F.stddev_pop("r").over(w), "span": (last - first) / F.lit(365.25), "slope": F.regr_slope("r", "years").over(w), "days_since": F.col("day") - last, "decayed": F.sum("wr").over(w) / F.sum("w").over(w),
        "courses": F.size(F.collect_set(F.when(seen, F.col("course_id"))).over(w)),
        "last_year": F.avg("r").over(strict(back=365)), "year_before": F.avg("r").over(Window.partitionBy("runner_id").orderBy("day").rangeBetween(-730, -366)),
    })
    trend = F.when((F.col("results") >= 3) & (F.col("span") >= 0.5), F.col("slope"))
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return rows.select("entry_id", "results", r6(F.col("latest"), "last_ratio"), r6(F.col("best_ever"), "best_ever"), r6(F.col("best_recent"), "best_recent"), r6(F.col("latest") - F.col("best_ever"), "gap_to_best"), r6(F.when(F.col("results") >= 2, F.col("spread")), "consistency"), r6(trend, "trend_per_year"), "days_since", r6(F.col("decayed"), "form_weighted"), "courses", r6(F.col("last_year") - F.col("year_before"), "improvement"), r6(F.col("results") / F.greatest(F.col("span"), F.lit(0.5)), "races_per_year"))


def participation(results: DataFrame) -> DataFrame:
    """Counts that tell who turns up, from strictly earlier finishes: on the course, in the last 61 and 183 days, this year, a year ago within 30 days."""
    seen = F.col("seconds").isNotNull()
    count = lambda w, c=None: F.count(F.when(seen if c is None else seen & c, 1)).over(w)
    course = Window.partitionBy("runner_id", "course_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    calendar = Window.partitionBy("runner_id", F.year("race_date")).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    season = Window.partitionBy("runner_id").orderBy("day").rangeBetween(-395, -335)
    return results.select("entry_id", F.round(F.log1p(count(course)), 6).alias("on_course"), F.round(F.log1p(count(strict(back=61))), 6).alias("in_61"), F.round(F.log1p(count(strict(back=183))), 6).alias("in_183"), F.round(F.log1p(count(calendar)), 6).alias("this_year"), (count(season) > 0).cast("int").alias("year_ago"), F.round(F.log1p(count(strict())), 6).alias("ever"))


def turnout_topk(results: DataFrame) -> DataFrame:
    """Recall of the likeliest: of each edition's finishers, how many are among as many runners with the most finishes in the window before it.

    Candidates are the runners with a finish in the window; an edition takes as
    many as it had finishers, by finishes and then by id.
    """
    fin = results.where("seconds is not null")
    editions = fin.groupBy("race_id").agg(F.min("day").alias("at"), F.countDistinct("runner_id").alias("field"))
    # A window meets the spans of its own length that it begins and ends in: two of them, joined by number, then cut exactly.
    span = lambda day: F.floor(day / F.lit(RECENT_DAYS))
    days = editions.select("at").distinct().withColumn("span", F.explode(F.array_distinct(F.array(span(F.col("at") - RECENT_DAYS), span(F.col("at") - 1)))))
    finishes = fin.groupBy("runner_id", "day").agg(F.count("*").alias("c")).withColumn("span", span(F.col("day")))
    pool = days.join(finishes, "span").where((F.col("day") < F.col("at")) & (F.col("day") >= F.col("at") - RECENT_DAYS)).groupBy("at", "runner_id").agg(F.sum("c").alias("c"))
    ranked = pool.withColumn("k", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("c"), "runner_id")))
    there = fin.select("race_id", "runner_id").distinct()
    named = editions.join(ranked, "at").where("k <= field").select("race_id", "runner_id", F.lit(1).alias("named"))
    out = there.join(named, ["race_id", "runner_id"], "left").groupBy("race_id").agg(F.count("*").alias("field"), F.count("named").alias("hits"))
    return out.select("race_id", "field", "hits", F.round(F.col("hits") / F.col("field"), 6).alias("recall"))


def edition_effects(results: DataFrame) -> DataFrame:
    """Mean log ratio of each edition against its course's, in percent, with the weight of its finishers (1 to 2000)."""
    editions = ratio(results).where("r is not null").groupBy("course_id", "race_id", "race_date").agg(F.avg("r").alias("mean"), F.count("*").alias("n"))
    editions = editions.withColumn("weight", F.least(F.greatest("n", F.lit(1)), F.lit(2000)))
    w = Window.partitionBy("course_id")
    base = F.sum(F.col("weight") * F.col("mean")).over(w) / F.sum("weight").over(w)
    return editions.select("course_id", "race_id", "race_date", "n", "weight", (F.col("mean") - base).alias("effect"))


def conditions_fit(results: DataFrame) -> DataFrame:
    """Weighted least squares within courses of the edition effect on a month's mean-zero season term: slope, explained share, editions."""
    rows = edition_effects(results).withColumn("x", F.cos(F.month("race_date") * F.lit(3.141592653589793 / 6)))
    w = Window.partitionBy("course_id")
    rows = rows.withColumn("x", F.col("x") - F.sum(F.col("weight") * F.col("x")).over(w) / F.sum("weight").over(w))
    s = lambda a, b: F.sum(F.col("weight") * F.col(a) * F.col(b))
    sums = rows.groupBy().agg(s("x", "x").alias("xx"), s("x", "effect").alias("xy"), s("effect", "effect").alias("yy"), F.count("*").alias("editions"))
    return sums.select("editions", F.round(F.col("xy") / F.col("xx") * 100, 6).alias("slope_pct"), F.round(F.col("xy") * F.col("xy") / F.col("xx") / F.col("yy"), 6).alias("explained"))


def blend_weights(rows: DataFrame) -> DataFrame:
    """Mean absolute log error of blends of ``carry`` and ``median`` by weight, 0 to 1 by 0.05, in one pass."""
    own = rows.where("carry is not null and median is not null").withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(20))))
    logs = F.log("carry") * (1 - F.col("w") / 20) + F.log("median") * F.col("w") / 20
    return own.groupBy("w").agg(F.count("*").alias("runners"), F.round(F.avg(F.abs(logs - F.log("seconds"))) * 100, 6).alias("log_error")).select((F.col("w") / 20).alias("weight"), "runners", "log_error")
