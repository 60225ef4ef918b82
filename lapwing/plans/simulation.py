"""Queries on places of whole fields, drawn many times."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions.running import riegel
from lapwing.operators import simulation
from lapwing.operators.asof import with_history
from lapwing.plans.registry import query
from lapwing.sources.results import results


def _entrants(spark, sf_dir):
    """Every finisher as they stood before the race: the latest time carried over, less certain with less history; newcomers around 0.36 s a metre."""
    rows = with_history(results(spark, sf_dir)).where("seconds is not null")
    carry = riegel(F.col("latest.seconds"), F.col("latest.distance_m"), F.col("distance_m"))
    sd = F.when(F.col("depth") == 0, 0.2).when(F.col("depth") == 1, 0.12).when(F.col("depth") <= 3, 0.09).otherwise(0.07)
    presence = F.least(F.lit(0.95), F.lit(0.4) + F.lit(0.1) * F.col("depth"))
    return rows.select("race_id", "entry_id", F.log(F.coalesce(carry, F.col("distance_m") * F.lit(0.36))).alias("mean"), sd.alias("sd"), presence.alias("presence"))


def _uniform(number: str, salt: int) -> str:
    return f"((list_reduce(list_prepend(({number} % 2147483647 * 48271 + draw * 69621 + {salt * 16807 + 1}) % 2147483647, [0, 0, 0]), lambda a, b: xor(a, a >> 15) * 48271 % 2147483647) + 0.5::DOUBLE) / 2147483647)"


def _normal(number: str, salt: int) -> str:
    return f"sqrt(-2 * ln({_uniform(number, salt)})) * cos(2 * pi() * {_uniform(number, salt + 1)})"


def _places(presence: str) -> str:
    return f""" latest AS (
  SELECT target, max_by(struct_pack(s := seconds, d := distance_m), struct_pack(a := race_date, b := race_id, c := entry_id)) AS l, count(*) AS depth FROM past GROUP BY target
), entrants AS (
  SELECT race_id, entry_id, ('0x' || substr(md5(race_id), 1, 8))::BIGINT AS number, coalesce(depth, 0) AS depth,
    ln(coalesce(l.s * pow(distance_m / l.d, CASE WHEN distance_m < 2000 THEN 1.08 WHEN distance_m < 3000 THEN 1.075 WHEN distance_m < 4828.032 THEN 1.07 ELSE 1.06 END::DOUBLE), distance_m * 0.36::DOUBLE)) AS mean
  FROM results LEFT JOIN latest ON target = entry_id WHERE seconds IS NOT NULL
), drawn AS (
  SELECT *, mean + 0.04::DOUBLE * {_normal("number", 1)} + (CASE WHEN depth = 0 THEN 0.2 WHEN depth = 1 THEN 0.12 WHEN depth <= 3 THEN 0.09 ELSE 0.07 END)::DOUBLE * {_normal("entry_id", 3)} + 0.03::DOUBLE * {_normal("entry_id", 5)} AS t,
    {presence} AS here FROM entrants, range({simulation.DRAWS}) r(draw)
), placed AS (
  SELECT race_id, entry_id, draw, sum(here::INT) OVER (PARTITION BY race_id, draw) AS running,
    1 + coalesce(sum(here::INT) OVER (PARTITION BY race_id, draw ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM drawn
), fields AS (SELECT race_id, quantile_cont(running, 0.5) AS field FROM (SELECT DISTINCT race_id, draw, running FROM placed) GROUP BY race_id)
SELECT race_id, entry_id, round(quantile_cont(place, 0.1), 6) AS low, round(quantile_cont(place, 0.5), 6) AS median, round(quantile_cont(place, 0.9), 6) AS high, round(avg((place = 1)::INT), 6) AS first, field
FROM placed JOIN fields USING (race_id) GROUP BY race_id, entry_id, field"""


def _rounded(found):
    return found.select("race_id", "entry_id", *[F.round(c, 6).alias(c) for c in ("low", "median", "high", "first")], "field")


@query(_places("true"))
def simulated_places(spark, sf_dir):
    """Where each finisher might have finished, had all of the race's finishers started."""
    return _rounded(simulation.places(_entrants(spark, sf_dir).withColumn("presence", F.lit(None).cast("double"))))


@query(_places(_uniform("entry_id", 7) + " < least(0.95::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * depth)"))
def forecast_places(spark, sf_dir):
    """Where each would finish if they ran, in fields that turn up by chance."""
    return _rounded(simulation.places(_entrants(spark, sf_dir)))
