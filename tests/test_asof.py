"""Traps of strictly earlier history, on rows made for them."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from lapwing.functions import running
from lapwing.operators import asof, identity, scoring

SCHEMA = "entry_id long, runner_id long, course_id string, distance_m double, race_date date, day int, race_id string, seconds double, sex string, age_band string, hometown string, name string"


def entry(k, runner, day, seconds, course="A", sex="F"):
    date = datetime.date(2020, 1, 1) + datetime.timedelta(days=day)
    return (k, runner, course, 5000.0, date, day, f"{course}@{date}", seconds, sex, "20-29", "X", f"n{runner}")


def test_same_day_rows_do_not_see_each_other(spark):
    rows = spark.createDataFrame([entry(1, 7, 0, 1500.0), entry(2, 7, 10, 1400.0, "B"), entry(3, 7, 10, 1300.0, "C"), entry(4, 7, 20, None)], SCHEMA)
    got = {r.entry_id: (r.depth, r.latest and r.latest.entry_id) for r in asof.with_history(rows).collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (3, 3)}
    assert asof.leaks(asof.with_history(rows)).first().leaks == 0


def test_recent_window_includes_its_first_day(spark):
    rows = spark.createDataFrame([entry(1, 7, 0, 1500.0), entry(2, 7, 548, 1500.0), entry(3, 8, 0, 1.0), entry(4, 8, 549, 1.0)], SCHEMA)
    got = {r.entry_id: r.recent for r in asof.with_history(rows).collect()}
    assert (got[2], got[4]) == (1, 0)


def test_category_median_falls_back(spark):
    past = [entry(k, k, 0, 1000.0 + k, sex="F" if k < 3 else "M") for k in range(5)]
    rows = spark.createDataFrame([*past, entry(10, 50, 40, 900.0, sex="F"), entry(11, 51, 40, 900.0, sex="M")], SCHEMA)
    got = {r.entry_id: (r.predicted, r.used) for r in asof.category_medians(rows).collect()}
    assert got[10] == (1001.0, "category") and got[11] == (1002.0, "field") and got[0] == (None, "none")


def test_empty_table(spark):
    assert scoring.scored(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("distance", "exponent"), [(1999.0, 1.08), (2000.0, 1.075), (3000.0, 1.07), (4828.032, 1.06)])
def test_exponents(spark, distance, exponent):
    assert spark.range(1).select(running.riegel_exponent(F.lit(distance))).first()[0] == exponent


def test_bisection_inverts_fitness(spark):
    for d in (5000.0, 10000.0, 20000.0):
        seconds = spark.range(1).select(running.race_time(F.lit(50.0), F.lit(d)).alias("s"))
        back = seconds.select(running.vdot(F.lit(d), F.col("s"))).first()[0]
        assert math.isclose(back, 50.0, abs_tol=1e-6)
    assert spark.range(1).select(running.vdot(F.lit(900.0), F.lit(200.0))).first()[0] is None


def test_clock(spark):
    row = spark.range(1).select(running.clock(F.lit(3661.5)), running.clock_seconds(F.lit("1:01:02")), running.clock_seconds(F.lit("9:61")), running.clock_seconds(F.lit(None).cast("string"))).first()
    assert tuple(row) == ("1:01:02", 3662, None, None)


def test_conformal_threshold_is_an_order_statistic_of_earlier_dates(spark):
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(days=k)
    rows = spark.createDataFrame([("s", day(0), float(k)) for k in range(60)] + [("s", day(1), 99.0)], "stratum string, race_date date, score double")
    got = {r.race_date: (r.pool, r.threshold) for r in scoring.rolling_thresholds(rows).collect()}
    assert got == {day(0): (0, None), day(1): (60, float(math.ceil(61 * 0.8) - 1))}


def test_links_are_never_guessed(spark):
    people = "id long, key string, sex string, hometown string"
    runners = spark.createDataFrame([(1, "a", "F", "x"), (2, "b", "F", "x"), (3, "b", "F", "y"), (4, "c", "M", "z")], people)
    entrants = spark.createDataFrame([(10, "a", None, None), (11, "b", "F", "y"), (12, "b", "F", "q"), (13, "c", "F", "z"), (14, "d", None, None)], people)
    got = {r.entrant_id: (r.status, r.runner_id) for r in identity.link(entrants, runners).collect()}
    assert got == {10: ("linked", 1), 11: ("linked", 3), 12: ("ambiguous", None), 13: ("new", None), 14: ("new", None)}
    twice = spark.createDataFrame([(20, "a", None, None), (21, "a", None, None)], people)
    assert {r.status for r in identity.link(twice, runners).collect()} == {"ambiguous"}
