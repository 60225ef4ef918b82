"""Queries on features of form, scored races and turnout models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import boosting, features, hierarchy, models
from lapwing.plans.registry import query
from lapwing.sources.results import results

INPUTS = ["on_course", "in_61", "in_183", "this_year", "year_ago", "ever"]


@query(""" hr AS (SELECT target, target_day, day, race_id, entry_id, distance_m, age_band, ln(seconds / (distance_m * 0.3::DOUBLE)) AS r FROM past
), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY day DESC, race_id DESC, entry_id DESC) AS back FROM hr
), f AS (SELECT target, avg(r) FILTER (WHERE back <= 3) AS three, min(day) AS first, max_by(age_band, (day, race_id, entry_id)) AS band, max(day) AS latest_day, max_by(distance_m, (day, race_id, entry_id)) AS d FROM k GROUP BY target
), b AS (SELECT target, min(h.r) AS best FROM hr h JOIN results t ON t.entry_id = h.target WHERE abs(ln(t.distance_m / h.distance_m)) < 0.2 GROUP BY target)
SELECT r.entry_id, round(three, 6) AS last_three, round(best, 6) AS best_at_distance, round((r.day - first) / 365.25::DOUBLE, 6) AS years_racing,
  round((substr(band, 1, 2)::INT + least(substr(band, 4, 2)::INT, substr(band, 1, 2)::INT + 10)) / 2.0::DOUBLE + (r.day - latest_day) / 365.25::DOUBLE, 6) AS age, CASE sex WHEN 'F' THEN 1 WHEN 'M' THEN 0 END AS sex,
  round(ln(r.distance_m / 10000), 6) AS log_distance, round(ln(r.distance_m / d), 6) AS step_from_last, month(race_date)::INT AS month
FROM results r LEFT JOIN f ON f.target = r.entry_id LEFT JOIN b ON b.target = r.entry_id""")
def gbm_more_features(spark, sf_dir):
    return models.more_form(results(spark, sf_dir))


@query(""" o AS (SELECT race_id, race_date, count(*) AS finishers FROM results WHERE seconds IS NOT NULL AND year(race_date) >= 1996 GROUP BY ALL) SELECT * FROM o""")
def backtest_origins(spark, sf_dir):
    return models.origins(results(spark, sf_dir), 1996)


@query()
def finish_probability(spark, sf_dir):
    """How likely each entry is to finish, by the counts of who turns up and a fit on earlier years; null in the first year."""
    own = results(spark, sf_dir).select("entry_id", F.year("race_date").alias("year"), F.col("seconds").isNotNull().cast("int").alias("finished"))
    rows = features.participation(results(spark, sf_dir)).join(own, "entry_id")
    years = sorted(r.year for r in own.select("year").distinct().collect())[1:]  # a row a year
    betas = models.fit_logistic_before(rows, INPUTS, "finished", "year", years)
    chances = [F.when(F.col("year") == y, models.probability(b, INPUTS)) for y, b in zip(years, betas, strict=True)]
    return rows.select("entry_id", "finished", F.round(F.coalesce(F.lit(None).cast("double"), *chances), 5).alias("probability"))


FORM = ["results", "last_ratio", "best_ever", "best_recent", "gap_to_best", "consistency", "trend_per_year", "days_since", "form_weighted", "courses", "improvement", "races_per_year"]
MORE = ["last_three", "best_at_distance", "years_racing", "age", "sex", "log_distance", "step_from_last", "month"]
#: Trees a model of the registered query.
ROUNDS = 10


@query()
def boosted_quantiles(spark, sf_dir):
    """Seconds of every entry at seven quantiles, by trees fitted on the finishes of earlier years; null in years without enough before them."""
    rows = results(spark, sf_dir)
    own = features.ratio(rows).select("entry_id", "r", F.year("race_date").alias("block"), "distance_m")
    table = own.join(features.form(rows), "entry_id").join(models.more_form(rows), "entry_id").withColumnsRenamed({"entry_id": "id", "r": "y"})
    found = boosting.boosted_quantiles(table, [*FORM, *MORE], rounds=ROUNDS, rate=0.3)
    seconds = lambda k, q: F.round(F.exp(f"q{k}") * F.col("distance_m") * F.lit(0.3), 6).alias(f"q{round(100 * q):02d}")
    return own.join(found.withColumnRenamed("id", "entry_id"), "entry_id").select("entry_id", *[seconds(k, q) for k, q in enumerate(boosting.QUANTILES)])


def _leveled(spark, sf_dir):
    rows = features.ratio(results(spark, sf_dir))
    return rows.select("entry_id", "runner_id", F.concat_ws(" ", "sex", "age_band").alias("grp"), "race_id", "course_id", F.year("race_date").alias("year"), F.log(F.col("distance_m") / F.lit(10_000.0)).alias("x"), F.col("r").alias("y"), "distance_m")


@query()
def hierarchical_levels(spark, sf_dir):
    """Every runner's level in their last season and fade over distance, with how sure these are, from a fit of all finishes."""
    found = hierarchy.fit(_leveled(spark, sf_dir), rounds=8).levels.where("last")
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return found.select("runner_id", "year", r6(F.col("level"), "level"), r6(F.sqrt("var_level"), "level_sd"), r6(F.col("fade"), "fade"), r6(F.sqrt("var_fade"), "fade_sd"))


@query()
def hierarchical_predictions(spark, sf_dir):
    """Seconds of every entry of the last year at 10, 50 and 90 %, from a fit of all years before."""
    rows = _leveled(spark, sf_dir)
    last = rows.agg(F.max("year")).first()[0]
    asked = rows.where(F.col("year") == last).withColumnRenamed("entry_id", "id")
    said = hierarchy.predict(hierarchy.fit(rows.where(F.col("year") < last), rounds=8), asked)
    at = lambda z, name: F.round(F.exp(F.col("mean") + F.lit(z) * F.col("sd")) * F.col("distance_m") * F.lit(0.3), 6).alias(name)
    return asked.select("id", "distance_m").join(said, "id").select(F.col("id").alias("entry_id"), at(-1.2816, "q10"), at(0.0, "q50"), at(1.2816, "q90"))
