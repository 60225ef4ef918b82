"""Routes, the wind along them, and what a morning's weather costs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lapwing.functions.running import GRADIENT, haversine

# Share of a wind from everywhere that a field meets, its scale in km/h, neutral mornings, and the clock's shift against standard time.
EVERY_WAY, SCALE, STEEPEST = 0.5, 10.0, 0.45
NEUTRAL_TEMP, NEUTRAL_WIND, PIVOT, THRESHOLD, SHIFT, BLEND = 10.0, 20.0, 10_000.0, 12.0, -1, 0.65
NEUTRAL_EXPOSURE = EVERY_WAY * NEUTRAL_WIND**2 / SCALE**2
HEAT_PIVOT = 5000.0


def heading(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north in which the great circle to the second point sets out."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def legs(points: DataFrame) -> DataFrame:
    """``route, leg, heading_deg, share`` from points (route, leg, lat, lon): each leg leads to the next point, and has a share of the whole length. A route that goes nowhere has none."""
    w = Window.partitionBy("route").orderBy("leg")
    on = points.withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null")
    here = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    out = on.withColumns({"metres": haversine(*here), "heading_deg": heading(*here)}).where("metres > 0")
    return out.select("route", "leg", "heading_deg", (F.col("metres") / F.sum("metres").over(Window.partitionBy("route"))).alias("share"))


def net_share(legs: DataFrame) -> DataFrame:
    """How far a route's end is from its start, over its length."""
    part = lambda f: F.sum(F.col("share") * f(F.radians("heading_deg")))
    return legs.groupBy("route").agg(F.hypot(part(F.sin), part(F.cos)).alias("net_share"))


def wind_terms(winds: DataFrame, legs: DataFrame) -> DataFrame:
    """``exposure`` and ``net`` of each wind (route, east, north, speed) on its route; a route without legs faces every way alike."""
    east, north = (F.when(F.col("east").isNull() | F.col("north").isNull(), 0.0).otherwise(F.col(c)) for c in ("east", "north"))
    r = F.radians("heading_deg")
    # The wind along a leg is e sin h + n cos h, so a route needs five sums, whatever the number of winds.
    sums = {"se": F.sin(r), "sn": F.cos(r), "see": F.sin(r) * F.sin(r), "snn": F.cos(r) * F.cos(r), "sen": F.sin(r) * F.cos(r)}
    routes = legs.groupBy("route").agg(*[F.sum(F.col("share") * v).alias(k) for k, v in sums.items()])
    rows = winds.join(routes, "route", "left").withColumns({"e": east, "n": north})
    steady = F.col("e") * F.col("e") + F.col("n") * F.col("n")
    mean = F.coalesce(F.greatest(F.col("speed"), F.sqrt(steady)), F.sqrt(steady))
    gusts = F.lit(EVERY_WAY) * (mean * mean - steady) / SCALE**2
    along = (F.col("e") * F.col("e") * F.col("see") + 2 * F.col("e") * F.col("n") * F.col("sen") + F.col("n") * F.col("n") * F.col("snn")) / SCALE**2
    exposure = F.coalesce(along, F.lit(EVERY_WAY) * steady / SCALE**2) + gusts
    return rows.withColumns({"exposure": exposure, "net": F.coalesce(F.col("e") * F.col("se") + F.col("n") * F.col("sn"), F.lit(0.0))}).drop(*sums, "e", "n")


def tailwind(bearing: Column, east: Column, north: Column) -> Column:
    """Help of the wind along a bearing; null where one of them is."""
    return east * F.sin(F.radians(bearing)) + north * F.cos(F.radians(bearing))


def adjustment(distance_m: Column, temp_c: Column, wind: Column, along: Column, temp: float, temp_log: float, wind_cost: float, along_cost: float) -> Column:
    """Share by which a morning is slower than a neutral one; no direction is no help."""
    return (F.lit(temp) + F.lit(temp_log) * F.log(distance_m / PIVOT)) * (temp_c - NEUTRAL_TEMP) + F.lit(wind_cost) * (wind - NEUTRAL_WIND) + F.lit(along_cost) * F.coalesce(along, F.lit(0.0))


def effect(temp_c: Column, sun: Column, distance_m: Column, exposure: Column, net: Column, heat: tuple[float, float], exposure_cost: float, net_cost: float, boost: float) -> Column:
    """What a morning costs, as a log ratio; nothing where it wasn't observed."""
    hot = F.greatest(F.lit(0.0), temp_c + F.lit(boost) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), sun)) - THRESHOLD)
    return F.coalesce(hot * (F.lit(heat[0]) + F.lit(heat[1]) * F.log(distance_m / HEAT_PIVOT)) + F.lit(exposure_cost) * (exposure - NEUTRAL_EXPOSURE) + F.lit(net_cost) * net, F.lit(0.0))


def race_window(distance_m: Column, start_hour: Column | int = 8, wall_clock: bool = False) -> Column:
    """(first, last) hours in which a field is on the road, in standard time or as clocks show it."""
    first = (F.lit(start_hour) if isinstance(start_hour, int) else start_hour) + (0 if wall_clock else SHIFT)
    return F.struct(first.alias("first"), (first + F.greatest(F.lit(1), F.bround(distance_m / 1000 * F.lit(0.09)))).cast("int").alias("last"))


def on_the_road(races: DataFrame, hours: DataFrame) -> DataFrame:
    """Means over the hourly readings (day, hour, temp_c, east, north, speed) of each race's window; a race without one isn't there. Readings are joined on the day, and cut to the hours."""
    rows = races.withColumn("w", race_window(F.col("distance_m"))).join(hours, "day").where(F.col("hour").between(F.col("w.first"), F.col("w.last")))
    return rows.groupBy("race_id").agg(F.count("*").alias("hours"), *[F.avg(c).alias(c) for c in ("temp_c", "east", "north", "speed")])


def _cost(slope: np.ndarray) -> np.ndarray:
    return np.polyval(GRADIENT, slope)


def _penalty(d: np.ndarray, climb: np.ndarray, drop: np.ndarray, grade: np.ndarray) -> np.ndarray:
    up, down = climb / grade, drop / grade
    flat = d - up - down
    flat = np.where((flat < 0) & (flat > -1e-6 * d), 0.0, flat)
    out = (up * _cost(grade) + down * _cost(-grade) + flat * GRADIENT[-1]) / (d * GRADIENT[-1]) - 1
    return np.where((flat < 0) | (grade <= 0), np.nan, out)


def penalty(distance_m: Column, climb_m: Column, drop_m: Column, grade: Column) -> Column:
    """Share by which hills of one grade slow a course; null if they don't fit into it."""
    poly = lambda i: sum((F.lit(c) * F.pow(i, F.lit(5.0 - k)) for k, c in enumerate(GRADIENT[1:], 1)), F.lit(GRADIENT[0]) * F.pow(i, F.lit(5.0)))
    up, down = climb_m / grade, drop_m / grade
    flat = distance_m - up - down
    flat = F.when((flat < 0) & (flat > -1e-6 * distance_m), 0.0).otherwise(flat)
    return F.when((grade > 0) & (flat >= 0), (up * poly(grade) + down * poly(-grade) + flat * GRADIENT[-1]) / (distance_m * GRADIENT[-1]) - 1)


@F.pandas_udf(DoubleType())
def implied_grade(distance_m: pd.Series, climb_m: pd.Series, drop_m: pd.Series, factor: pd.Series) -> pd.Series:
    """The grade whose penalty a course's factor is, by 60 halvings of all rows at once; null where no grade has it."""
    d, climb, drop, want = (x.to_numpy(float, na_value=np.nan) for x in (distance_m, climb_m, drop_m, factor))
    with np.errstate(all="ignore"):
        low, high = (climb + drop) / d, np.full(len(d), STEEPEST)
        there = (low > 0) & (low <= high) & (_penalty(d, climb, drop, low) <= want) & (want <= _penalty(d, climb, drop, high))
        for _ in range(60):
            middle = (low + high) / 2
            less = _penalty(d, climb, drop, middle) < want
            low, high = np.where(less, middle, low), np.where(less, high, middle)
    return pd.Series((low + high) / 2).where(there, None)


def blend(one: Column, other: Column, weight: float = BLEND) -> Column:
    """Two predictions on one scale of logs; null unless both are positive."""
    return F.when((one > 0) & (other > 0), F.exp(F.lit(1 - weight) * F.log(one) + F.lit(weight) * F.log(other)))
