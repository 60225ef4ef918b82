"""Typed results: one row for each entry of a runner in an edition of a course."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metres of each course.
DISTANCES = {"1-URGENT": 5000.0, "2-HIGH": 8000.0, "3-MEDIUM": 10000.0, "4-NOT SPECIFIED": 16093.44, "5-LOW": 20000.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entry_id, runner_id, course_id, distance_m, race_date, day, race_id, seconds, sex, age_band, hometown, name``.

    ``seconds`` is null for those who did not finish. ``day`` numbers the dates,
    for frames that are ranges of days.
    """
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    priority = F.substring("o_orderpriority", 1, 1)
    distance = F.when(priority == "1", 5000.0).when(priority == "2", 8000.0).when(priority == "3", 10000.0).when(priority == "4", 16093.44).otherwise(20000.0)
    date = F.to_date(F.date_trunc("month", "o_orderdate"))
    missing = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0)
    band = F.element_at(F.array(*[F.lit(f"{k}-{k + 9}") for k in range(20, 70, 10)]), F.col("c_nationkey") % 5 + 1)
    return rows.select(
        F.col("o_orderkey").alias("entry_id"),
        F.col("o_custkey").alias("runner_id"),
        F.col("o_orderpriority").alias("course_id"),
        distance.alias("distance_m"),
        date.alias("race_date"),
        F.datediff(date, F.lit("1970-01-01").cast("date")).alias("day"),
        F.concat("o_orderpriority", F.lit("@"), date.cast("string")).alias("race_id"),
        F.when(~missing, distance * (F.lit(0.18) + F.lit(0.42) * F.col("o_totalprice") / F.lit(500000.0))).alias("seconds"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex"),
        band.alias("age_band"),
        F.col("n_name").alias("hometown"),
        F.col("c_name").alias("name"),
    )


#: The same view for a second engine, as common table expressions: ``results``, and ``past`` with every earlier finish of an entry's runner.
RESULTS_SQL = """
results AS (
  SELECT o_orderkey AS entry_id, o_custkey AS runner_id, o_orderpriority AS course_id, distance_m, race_date,
    datediff('day', DATE '1970-01-01', race_date)::INT AS day, o_orderpriority || '@' || race_date::VARCHAR AS race_id,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN NULL ELSE distance_m * (0.18::DOUBLE + 0.42::DOUBLE * o_totalprice / 500000.0::DOUBLE) END AS seconds,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    ['20-29', '30-39', '40-49', '50-59', '60-69'][c_nationkey % 5 + 1] AS age_band, n_name AS hometown, c_name AS name
  FROM (SELECT *, (CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 5000 WHEN '2' THEN 8000 WHEN '3' THEN 10000 WHEN '4' THEN 16093.44 ELSE 20000 END)::DOUBLE AS distance_m,
      date_trunc('month', o_orderdate)::DATE AS race_date FROM orders)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), past AS (
  SELECT t.entry_id AS target, t.day AS target_day, p.* FROM results t JOIN results p ON p.runner_id = t.runner_id AND p.race_date < t.race_date AND p.seconds IS NOT NULL
)"""
