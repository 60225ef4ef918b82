"""The catalogue of editions from rows of year indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions import courses


def catalogue(rows: DataFrame, aliases: tuple[tuple[str, str], ...] = (), sponsors: tuple[str, ...] = ()) -> DataFrame:
    """``href, event, race_id, date, distance_m, course_id, reason`` of every index row (href, event, printed, year).

    A row is a race, or has the reason why it isn't one. Of rows with one course,
    date and name one stays: a .php page before others, then the shorter address,
    then the later one by text, whatever their order was.
    """
    rows = rows.select("href", "event", courses.edition_id(F.col("href"), F.col("event")).alias("race_id"), courses.edition_date(F.col("href"), F.col("printed"), F.col("year")).alias("date"), courses.distance(F.col("event")).alias("distance_m"))
    reason = F.coalesce(courses.not_read(F.col("event"), F.col("href")), F.when(F.col("date").isNull(), "no date"), F.when(F.col("distance_m").isNull(), "no single distance"))
    rows = rows.withColumns({"reason": reason, "course_id": F.when(reason.isNull(), courses.course(F.col("event"), F.col("distance_m"), aliases, sponsors))})
    key = [F.col("course_id"), F.col("date"), F.regexp_replace(F.lower("event"), "[^a-z0-9]+", ""), F.when(F.col("reason").isNotNull(), F.col("href"))]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("href").endswith(".php").desc(), F.length("href"), F.desc("href")))
    # Rows with a reason meet no others: each address is a key of its own.
    return rows.withColumn("reason", F.coalesce("reason", F.when(turn > 1, "a duplicate"))).select("href", "event", "race_id", "date", "distance_m", "course_id", "reason")


def reroute(races: DataFrame, roads: DataFrame) -> DataFrame:
    """``course_id`` as the road that was run: ``roads`` (course, first, last, road) rename a course between dates, null being open."""
    found = races.join(roads, (F.col("course_id") == F.col("course")) & (F.coalesce(F.col("first") <= F.col("date"), F.lit(True))) & (F.coalesce(F.col("date") <= F.col("last"), F.lit(True))), "left")
    return found.withColumn("course_id", F.coalesce("road", "course_id")).drop("course", "first", "last", "road")


def union_of_sources(own: DataFrame, outside: DataFrame, key: list[str]) -> DataFrame:
    """``own`` rows and those of ``outside`` whose key ``own`` doesn't have."""
    return own.unionByName(outside.join(own.select(*key).distinct(), key, "left_anti"))


def borrowed(outside: DataFrame, own: DataFrame, key: list[str], name: str) -> DataFrame:
    """Every row of ``outside`` with the ``name`` of what took its place, if anything did."""
    return outside.join(own.groupBy(*key).agg(F.min(name).alias("superseded_by")), key, "left")


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with one key the first in the order."""
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_turn = 1").drop("_turn")
