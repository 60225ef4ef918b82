"""More features of a runner's form, the races a backtest scores, and a logistic regression fitted by sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.functions import printed
from lapwing.operators.asof import strict
from lapwing.operators.features import ratio
from lapwing.sources.shared import drop, save

#: Races count as of one distance if their logarithms differ by less.
NEAR = 0.2
RIDGE, STEPS = 1.0, 50


def more_form(results: DataFrame) -> DataFrame:
    """``entry_id, last_three, best_at_distance, years_racing, age, sex, log_distance, step_from_last, month`` of every entry, from strictly earlier finishes.

    The mean of the last three is a difference of running sums, read at the number
    of earlier finishes; the best near the distance is a running minimum for each
    distance that the runner ran. So a runner of any length is streamed.
    """
    rows = ratio(results)
    fin = rows.where("seconds is not null")
    order = Window.partitionBy("runner_id").orderBy("day", "race_id", "entry_id")
    sums = fin.select("runner_id", F.row_number().over(order).alias("k"), F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    ages = printed.age_range(F.col("age_band"))
    known = F.when(F.col("seconds").isNotNull() & ages["low"].isNotNull(), F.struct("day", "race_id", "entry_id", ((ages["low"] + F.least(ages["high"], ages["low"] + 10)) / 2).alias("middle")))
    last = F.when(F.col("seconds").isNotNull(), F.struct("day", "race_id", "entry_id", "distance_m"))
    rows = rows.withColumns({"k": F.count("seconds").over(strict()), "first": F.min(F.when(F.col("seconds").isNotNull(), F.col("day"))).over(strict()), "known": F.max(known).over(strict()), "last": F.max(last).over(strict())})
    upto = sums.select("runner_id", "k", F.col("sum").alias("upto"))
    before = sums.select("runner_id", (F.col("k") + 3).alias("k"), F.col("sum").alias("before"))
    rows = rows.join(upto, ["runner_id", "k"], "left").join(before, ["runner_id", "k"], "left")
    three = (F.col("upto") - F.coalesce("before", F.lit(0.0))) / F.least(F.col("k"), F.lit(3))

    distances = fin.select("runner_id", F.col("distance_m").alias("of")).distinct()
    asked = results.select("runner_id", "day", "entry_id", "distance_m").join(distances, "runner_id").where(F.abs(F.log(F.col("distance_m") / F.col("of"))) < NEAR)
    both = asked.select("runner_id", "of", "day", "entry_id", F.lit(None).cast("double").alias("r")).unionByName(fin.select("runner_id", F.col("distance_m").alias("of"), "day", F.lit(None).cast("long").alias("entry_id"), "r"))
    seen = both.withColumn("best", F.min("r").over(Window.partitionBy("runner_id", "of").orderBy("day").rangeBetween(Window.unboundedPreceding, -1))).where("entry_id is not null")
    rows = rows.join(seen.groupBy("entry_id").agg(F.min("best").alias("best")), "entry_id", "left")
    r6 = lambda c, name: F.round(c, 6).alias(name)
    return rows.select(
        "entry_id", r6(three, "last_three"), r6(F.col("best"), "best_at_distance"), r6((F.col("day") - F.col("first")) / 365.25, "years_racing"),
        r6(F.col("known.middle") + (F.col("day") - F.col("known.day")) / 365.25, "age"), F.when(F.col("sex") == "F", 1).when(F.col("sex") == "M", 0).alias("sex"),
        r6(F.log(F.col("distance_m") / 10000), "log_distance"), r6(F.log(F.col("distance_m") / F.col("last.distance_m")), "step_from_last"), F.month("race_date").alias("month"),
    )


def origins(results: DataFrame, first_year: int) -> DataFrame:
    """``race_id, race_date, finishers`` of the races that are scored: those with finishers from a year on. Earlier ones are history alone."""
    rows = results.where(F.col("seconds").isNotNull() & (F.year("race_date") >= first_year))
    return rows.groupBy("race_id", "race_date").agg(F.count("*").alias("finishers"))


def _newton_sums(batches: Iterator[pa.RecordBatch], betas: np.ndarray, blocks: list[int]) -> Iterator[pa.RecordBatch]:
    """A task's part of the gradient and of the curvature of each block's fit, as one row for each of their cells."""
    d = betas.shape[1]
    total = np.zeros((len(blocks), d, d + 1))
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(d + 1)]
        whole = np.stack([np.ones(batch.num_rows), *columns[: d - 1]], axis=1).astype(float)
        for k, block in enumerate(blocks):
            use = columns[d] < block
            x, y = whole[use], columns[d - 1][use].astype(float)
            p = 1 / (1 + np.exp(-np.clip(x @ betas[k], -500, 500)))
            total[k, :, :d] += x.T @ (x * (p * (1 - p))[:, None])
            total[k, :, d] += x.T @ (y - p)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])


def fit_logistic_before(rows: DataFrame, inputs: list[str], label: str, block: str, blocks: list[int], ridge: float = RIDGE) -> np.ndarray:
    """Coefficients, ``[block, (constant, inputs)]``, of a ridge logistic regression for each of ``blocks`` on the rows of smaller block numbers.

    All blocks' Newton steps share one pass, which sums gradients and curvatures in
    the tasks; (d + 1) squared numbers a block come to the driver, whatever the
    number of rows. The constant isn't shrunk. Rows with a null are left out, as they say nothing of
    the missing input; a block without rows before it has zeros.
    """
    rows = save(rows.select(*[F.col(c).cast("double").alias(c) for c in (*inputs, label, block)]).dropna(), "fitted")
    d = len(inputs) + 1
    shrink = ridge * np.eye(d)
    shrink[0, 0] = 0.0
    betas = np.zeros((len(blocks), d))
    for _ in range(STEPS):
        found = rows.mapInArrow(partial(_newton_sums, betas=betas, blocks=blocks), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(len(blocks) * d * (d + 1))
        for row in found:
            total[row["cell"]] = row["value"]
        total = total.reshape(len(blocks), d, d + 1)
        steps = np.array([np.linalg.lstsq(t[:, :d] + shrink, t[:, d] - shrink @ b, rcond=None)[0] for t, b in zip(total, betas, strict=True)])
        betas = betas + steps
        if np.abs(steps).max(initial=0.0) < 1e-8:
            break
    drop(rows)
    return betas


def fit_logistic(rows: DataFrame, inputs: list[str], label: str, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients, the constant first, of one such regression on all rows."""
    return fit_logistic_before(rows.withColumn("_block", F.lit(0)), inputs, label, "_block", [1], ridge)[0]


def probability(beta: np.ndarray, inputs: list[str]):
    """The fitted probability as a column."""
    z = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], inputs, strict=True)), F.lit(float(beta[0])))
    return 1 / (1 + F.exp(-z))
