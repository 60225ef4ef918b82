"""A regression fitted by sums, hills run backwards, order statistics, and places paired by race, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.operators import cards, models, mornings, scoring


def test_logistic_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(int)
    rows = [(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1)]
    got = models.fit_logistic(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y")
    z, beta, shrink = np.column_stack([np.ones(500), x]), np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ beta)))
        beta += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + shrink, z.T @ (y - p) - shrink @ beta)
    assert np.allclose(got, beta, atol=1e-6)
    assert models.fit_logistic(spark.createDataFrame([], "a double, y int"), ["a"], "y").tolist() == [0.0, 0.0]


def test_blocks_learn_from_earlier_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(float(x), int(rng.random() < 1 / (1 + np.exp(-x * (1 if k < 200 else -2)))), k // 100) for k, x in enumerate(rng.normal(size=400))]
    schema = "a double, y int, b int"
    got = models.fit_logistic_before(spark.createDataFrame(rows, schema), ["a"], "y", "b", [0, 1, 2, 4])
    assert got[0].tolist() == [0.0, 0.0]
    for k, block in ((1, 1), (2, 2), (3, 4)):
        assert np.allclose(got[k], models.fit_logistic(spark.createDataFrame([r for r in rows if r[2] < block], schema), ["a"], "y"), atol=1e-9)
    later = [(a, 1 - y if b > 1 else y, b) for a, y, b in rows]
    assert np.array_equal(got[:3], models.fit_logistic_before(spark.createDataFrame(later, schema), ["a"], "y", "b", [0, 1, 2, 4])[:3])


def test_implied_grade_refuses(spark):
    rows = spark.createDataFrame([(10000.0, 200.0, 200.0, -0.5), (10000.0, 200.0, 200.0, 9.0), (1000.0, 900.0, 900.0, 0.1), (10000.0, 0.0, 0.0, 0.0), (None, 1.0, 1.0, 0.1)], "d double, u double, v double, f double")
    assert [r[0] for r in rows.select(mornings.implied_grade("d", "u", "v", "f")).collect()] == [None] * 5


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], list(range(1000)), [0.0] * 500 + [1e9], [-1.5, None, 3.0]])
def test_order_statistics(spark, values):
    rows = spark.createDataFrame([("a", None if v is None else float(v)) for v in values] + [(None, 7.0)], "g string, v double")
    n = F.col("n")
    got = {r.g: r for r in scoring.order_statistics(rows, "g", "v", {"least": F.lit(1), "middle": F.floor((n + 1) / 2), "most": n}, 16).collect()}
    own = sorted(v for v in values if v is not None)
    assert (got["a"].n, got["a"].least, got["a"].middle, got["a"].most) == (len(own), own[0], own[(len(own) + 1) // 2 - 1], own[-1])
    assert got[None].middle == 7.0


def test_paired_places(spark):
    rows = [("r", k, float(10 + k), float(a), float(b)) for k, (a, b) in enumerate([(1, 4), (2, 3), (3, 2), (4, 1)])] + [("s", 9, 1.0, 1.0, None)]
    got = cards.paired_places(spark.createDataFrame(rows, "race_id string, entry_id int, seconds double, one double, two double"), "one", "two").first()
    assert (got.races, got.runners, got.gap0, got.gap1, got.rho0, got.rho1, got.gap_difference) == (1, 4, 0.0, 2.0, 1.0, -1.0, -2.0)
