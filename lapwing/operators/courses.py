"""How sure a course's effect is: refits over resampled runners, all in the same passes.

A draw counts each runner a Poisson number of times, which a hash of the runner and the draw decides, so
no sample is ever built: a runner's own level and yearly trend don't depend on how often they count, and a
course's effect in all draws is one sum of arrays over runners. A round of all draws is one pass over
runners, each a short list of sums by course; what it gives is a number for each course and draw.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.operators.resolve import MAX_TREND, ROUNDS
from lapwing.operators.simulation import uniform
from lapwing.sources.shared import drop, save

DRAWS, LOW, HIGH = 400, 0.025, 0.975
#: Finishes of a course that is compared with others; numbers of courses by draws that a pass sends to its tasks at most.
LEAST, LIMIT = 100, 4_000_000
#: Courses of a slice of runners up to which its sums are products of dense matrices.
DENSE = 64

_CUTS = np.cumsum([exp(-1) / factorial(k) for k in range(17)])


def times_drawn(runner: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each runner counts in each draw, ``[runner, draw]``; once in draw 0."""
    out = np.searchsorted(_CUTS, uniform(runner[:, None], draws, 11), "right")
    out[:, draws == 0] = 1
    return out


def _round(batches: Iterator[pa.RecordBatch], effects: np.ndarray, draws: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums of residuals and of finishes, for each course and draw."""
    top, bottom = np.zeros(effects.shape), np.zeros(effects.shape)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            cells = batch.column("cells").flatten()
            if not len(cells):
                continue
            g, n, sx, sxx, sy, sxy = (cells.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            sizes = batch.column("cells").value_lengths().to_numpy(zero_copy_only=False)
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            add = lambda x, starts=starts: np.add.reduceat(x, starts, axis=0)
            k, x, xx = add(n)[:, None], add(sx)[:, None], add(sxx)[:, None]
            seen, column = np.unique(g, return_inverse=True)
            dense = len(seen) <= DENSE
            if dense:
                # Few courses: sums over a runner's courses, and over runners, are products of matrices.
                table = np.zeros((3, len(sizes), len(seen)))
                for out, value in zip(table, (n, sx, sy), strict=True):
                    out[owner, column] = value
                r, xr = add(sy)[:, None] - table[0] @ effects[seen], add(sxy)[:, None] - table[1] @ effects[seen]
            else:
                own = effects[g]
                r, xr = add(sy[:, None] - n[:, None] * own), add(sxy[:, None] - sx[:, None] * own)
            spread = k * xx - x * x
            slope = np.clip((k * xr - x * r) * np.where(spread > 1e-9, 1 / np.where(spread > 1e-9, spread, 1), 0.0), -MAX_TREND, MAX_TREND)
            level = (r - slope * x) / k
            times = times_drawn(batch.column("runner_id").to_numpy(zero_copy_only=False), draws)
            if dense:
                counted = times.astype(float)
                top[seen] += table[2].T @ counted - table[0].T @ (counted * level) - table[1].T @ (counted * slope)
                bottom[seen] += table[0].T @ counted
                continue
            times = times[owner]
            order = np.argsort(g, kind="stable")
            cuts = np.flatnonzero(np.diff(g[order], prepend=-1))
            for out, value in ((top, sy[:, None] - n[:, None] * level[owner] - slope[owner] * sx[:, None]), (bottom, n[:, None])):
                out[g[order][cuts]] += np.add.reduceat((times * value)[order], cuts, axis=0)
    g, d = np.nonzero(bottom)
    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(draws[d]), pa.array(top[g, d]), pa.array(bottom[g, d])], names=["g", "draw", "top", "bottom"])


def course_draws(rows: DataFrame, group: str, draws: int = DRAWS, rounds: int = ROUNDS) -> DataFrame:
    """``group, draw, effect, finishes`` from rows (runner_id, <group>, year, y): what each course costs in each draw; draw 0 counts everyone once.

    As ``resolve.two_way``, whose answer draw 0 is; a course that nobody of a draw ran has no row there. Courses
    come to the driver, and draws are done in blocks of as many as ``LIMIT`` allows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("runner_id").cast("long").alias("runner_id"), F.col(group).cast("string").alias("name"), "year", F.col("y").cast("double").alias("y")).where("y is not null and runner_id is not null and name is not null and year is not null")
    stats = rows.groupBy("runner_id").agg(F.min("year").alias("start"), F.count("*").alias("k")).where("k >= 2").drop("k")
    rows = rows.join(stats, "runner_id").withColumn("x", (F.col("year") - F.col("start")).cast("double"))
    sums = save(rows.groupBy("runner_id", "name").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy")), "sums")
    names = sorted(r.name for r in sums.select("name").distinct().collect())  # a row a course
    index = spark.createDataFrame(list(enumerate(names)), "g long, name string")
    cells = sums.join(index, "name").groupBy("runner_id").agg(F.array_sort(F.collect_list(F.struct("g", "n", "sx", "sxx", "sy", "sxy"))).alias("cells"))
    cells = save(cells, "cells")
    drop(sums)
    found = None
    size = max(1, LIMIT // max(1, len(names)))
    for first in range(0, draws + 1, size):
        block = np.arange(first, min(first + size, draws + 1))
        effects = np.zeros((len(names), len(block)))
        for k in range(rounds if names else 0):
            summed = cells.mapInArrow(partial(_round, effects=effects, draws=block), "g long, draw long, top double, bottom double").groupBy("g", "draw").agg(F.sum("top").alias("top"), F.sum("bottom").alias("finishes"))
            if k < rounds - 1:
                told = summed.toPandas()  # a row a course and draw
                effects[told["g"], told["draw"] - first] = told["top"] / told["finishes"]
        own = save(summed.select("g", "draw", (F.col("top") / F.col("finishes")).alias("effect"), "finishes"), "draws") if names else spark.createDataFrame([], "g long, draw long, effect double, finishes double")
        found = own if found is None else found.unionByName(own)
    centre = found.groupBy("draw").agg((F.sum(F.col("effect") * F.col("finishes")) / F.sum("finishes")).alias("centre"))
    return found.join(centre, "draw").join(index, "g").select(F.col("name").alias(group), "draw", (F.col("effect") - F.col("centre")).alias("effect"), "finishes")


def course_intervals(drawn: DataFrame, lengths: DataFrame, group: str, least: int = LEAST) -> DataFrame:
    """``group, finishes, effect, low, high, peers, gap, gap_low, gap_high`` from what ``course_draws`` gives and lengths (<group>, distance_m).

    The gap is to the mean of the other courses of the same length, to the metre, in the same draw; only courses of ``least``
    finishes have and are peers. Intervals hold 95 % of the draws in which there was an estimate.
    """
    rows = drawn.join(lengths.groupBy(group).agg(F.round(F.min("distance_m")).alias("metres")), group, "left")
    fit = rows.where((F.col("draw") == 0) & (F.col("finishes") >= least)).select(group).withColumn("fit", F.lit(1))
    rows = rows.join(fit, group, "left")
    beside = rows.where("fit = 1").groupBy("metres", "draw").agg(F.sum("effect").alias("sum"), F.count("*").alias("n"))
    rows = rows.join(beside, ["metres", "draw"], "left")
    rows = rows.withColumn("gap", F.when((F.col("fit") == 1) & (F.col("n") > 1), F.col("effect") - (F.col("sum") - F.col("effect")) / (F.col("n") - 1)))
    among = lambda c, p: F.percentile(F.when(F.col("draw") > 0, F.col(c)), F.lit(p))
    at = lambda c: F.max(F.when(F.col("draw") == 0, F.col(c)))
    return rows.groupBy(group).agg(
        at("finishes").cast("long").alias("finishes"), at("effect").alias("effect"), among("effect", LOW).alias("low"), among("effect", HIGH).alias("high"),
        F.coalesce(F.when(at("fit") == 1, at("n") - 1), F.lit(0)).alias("peers"), at("gap").alias("gap"), among("gap", LOW).alias("gap_low"), among("gap", HIGH).alias("gap_high"),
    )
