"""Scalar functions of running, as column expressions. Out of range is null, never a guess."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The oxygen curve, the share of it that can be held, and the exponents by target distance.
CURVE = (-4.60, 0.182258, 0.000104)
HELD = ((0.8, 0.0), (0.1894393, -0.012778), (0.2989558, -0.1932605))
EXPONENTS = ((2000.0, 1.08), (3000.0, 1.075), (4828.032, 1.07))
LONGER = 1.06
GRADIENT = (155.4, -30.4, -43.3, 46.3, 19.5, 3.6)
EARTH = 6371000.0


def vdot(distance_m: Column, seconds: Column) -> Column:
    """Fitness from one result; null under 1000 m, outside 3 to 240 minutes, or outside 20 to 90."""
    t = seconds / 60.0
    v = distance_m / t
    value = (F.lit(CURVE[0]) + F.lit(CURVE[1]) * v + F.lit(CURVE[2]) * v * v) / sum((F.lit(a) * F.exp(F.lit(b) * t) for a, b in HELD[1:]), F.lit(HELD[0][0]))
    return F.when((distance_m >= 1000) & t.between(3, 240) & value.between(20, 90), value)


def _fitness(distance_m: np.ndarray, minutes: np.ndarray) -> np.ndarray:
    v = distance_m / minutes
    return (CURVE[0] + CURVE[1] * v + CURVE[2] * v * v) / (HELD[0][0] + sum(a * np.exp(b * minutes) for a, b in HELD[1:]))


@F.pandas_udf(DoubleType())
def race_time(fitness: pd.Series, distance_m: pd.Series) -> pd.Series:
    """Seconds in which a fitness covers a distance, by 60 bisections between 3 and 240 minutes of all rows at once; null if it isn't there."""
    want, d = fitness.to_numpy(float, na_value=np.nan), distance_m.to_numpy(float, na_value=np.nan)
    low, high = np.full(len(want), 3.0), np.full(len(want), 240.0)
    there = (_fitness(d, low) >= want) & (_fitness(d, high) <= want)
    for _ in range(60):
        middle = (low + high) / 2
        slower = _fitness(d, middle) > want
        low, high = np.where(slower, middle, low), np.where(slower, high, middle)
    return pd.Series(np.where(there, (low + high) / 2 * 60, np.nan)).where(there, None)


def riegel_exponent(distance_m: Column) -> Column:
    out = F.lit(LONGER)
    for limit, exponent in reversed(EXPONENTS):
        out = F.when(distance_m < limit, exponent).otherwise(out)
    return out


def riegel(seconds: Column, from_m: Column, to_m: Column) -> Column:
    """A time carried over to another distance, by the exponent of the target."""
    return seconds * F.pow(to_m / from_m, riegel_exponent(to_m))


def depth_stratum(depth: Column) -> Column:
    return F.when(depth == 0, "0").when(depth == 1, "1").when(depth <= 3, "2-3").otherwise("4+")


def clock(seconds: Column) -> Column:
    """H:MM:SS of whole seconds."""
    s = F.bround(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))


def clock_seconds(text: Column) -> Column:
    """Seconds of [H:]MM:SS; null for anything else."""
    parts = F.split(text, ":")
    good = text.rlike(r"^(\d+:)?[0-5]?\d:[0-5]\d$")
    return F.when(good, F.aggregate(F.transform(parts, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a * 60 + x))


def gradient_cost(slope: Column) -> Column:
    """Energy of running up a slope, over that on the flat; slopes beyond 0.45 count as 0.45."""
    i = F.greatest(F.least(slope, F.lit(0.45)), F.lit(-0.45))
    out = F.lit(0.0)
    for c in GRADIENT:
        out = out * i + F.lit(c)
    return out / F.lit(GRADIENT[-1])


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(h))


def felt_heat(temp_c: Column, sun_share: Column) -> Column:
    """Degrees over 12 that sun and air feel like; none below."""
    return F.greatest(F.lit(0.0), temp_c + F.lit(2.1) * sun_share - F.lit(12.0))
