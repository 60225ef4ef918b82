"""Course effects in every draw against loops over resampled runners, and their intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.operators import courses, resolve

SCHEMA = "runner_id long, course string, year int, y double, distance_m double, draw string"
COURSES = {"flat": (0.0, 5000.0), "hilly": (0.06, 5000.2), "long": (0.02, 10000.0), "rare": (0.1, 10000.0)}


def table(n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(n):
        for k in range(int(rng.integers(1, 7))):
            c = ["flat", "hilly", "long"][int(rng.integers(3))] if r or k else "rare"
            rows.append((r * 7, c, 2000 + k, float(0.1 * rng.normal() + COURSES[c][0]), COURSES[c][1], "x"))
    return [*rows, (None, "flat", 2000, 1.0, 1.0, "x"), (5, None, 2000, 1.0, 1.0, "x"), (5, "flat", 2000, None, 1.0, "x")]


def loops(rows, times, rounds):
    """Alternating fits on a sample in which each runner is there ``times`` times."""
    own = [r for r in rows if None not in r[:4]]
    counts = {r[0]: sum(x[0] == r[0] for x in own) for r in own}
    sample = [(r[0], j, r[1], r[2], r[3]) for r in own if counts[r[0]] >= 2 for j in range(times[r[0]])]
    names = sorted({s[2] for s in sample})
    effect = dict.fromkeys(names, 0.0)
    for _ in range(rounds):
        left = {c: [] for c in names}
        for key in {s[:2] for s in sample}:
            mine = [s for s in sample if s[:2] == key]
            x = np.array([s[3] for s in mine], float)
            x -= x.min()
            r = np.array([s[4] - effect[s[2]] for s in mine])
            spread = len(x) * (x**2).sum() - x.sum() ** 2
            slope = np.clip((len(x) * (x * r).sum() - x.sum() * r.sum()) / spread, -resolve.MAX_TREND, resolve.MAX_TREND) if spread > 1e-9 else 0.0
            level = (r.sum() - slope * x.sum()) / len(x)
            for s, at in zip(mine, x, strict=True):
                left[s[2]].append(s[4] - level - slope * at)
        effect = {c: float(np.mean(v)) for c, v in left.items()}
    centre = sum(effect[c] * len(left[c]) for c in names) / sum(map(len, left.values()))
    return {c: (effect[c] - centre, len(left[c])) for c in names}


@pytest.mark.parametrize("limit", [courses.LIMIT, 9])
def test_draws_equal_loops(spark, monkeypatch, limit):
    monkeypatch.setattr(courses, "LIMIT", limit)
    rows = table()
    got = {(r.course, r.draw): (r.effect, r.finishes) for r in courses.course_draws(spark.createDataFrame(rows, SCHEMA).repartition(3), "course", draws=4, rounds=3).collect()}
    runners = sorted({r[0] for r in rows if r[0] is not None})
    times = courses.times_drawn(np.array(runners), np.arange(5))
    want = {(c, d): v for d in range(5) for c, v in loops(rows, dict(zip(runners, times[:, d].tolist(), strict=True)), 3).items()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_first_draw_is_the_fit_itself(spark):
    rows = spark.createDataFrame(table(), SCHEMA)
    fit = {r.course: (r.effect, r.finishes) for r in resolve.two_way(rows, "course", rounds=4).collect()}
    got = {r.course: (r.effect, r.finishes) for r in courses.course_draws(rows, "course", draws=1, rounds=4).where("draw = 0").collect()}
    assert {k: pytest.approx(v, abs=1e-9) for k, v in fit.items()} == got


def test_intervals_and_gaps(spark):
    rng = np.random.default_rng(5)
    drawn = [(c, d, float(COURSES[c][0] + 0.01 * rng.normal()), 150.0 if c != "rare" else 20.0) for d in range(41) for c in COURSES if (c, d) != ("hilly", 7)]
    lengths = spark.createDataFrame([(c, m) for c, (_, m) in COURSES.items()], "course string, distance_m double")
    got = {r.course: r for r in courses.course_intervals(spark.createDataFrame(drawn, "course string, draw int, effect double, finishes double"), lengths, "course").collect()}
    at = {(c, d): e for c, d, e, _ in drawn}
    for c in COURSES:
        own = [at[c, d] for d in range(1, 41) if (c, d) in at]
        assert (got[c].effect, got[c].low, got[c].high) == pytest.approx((at[c, 0], *np.quantile(own, [0.025, 0.975])))
    gaps = [at["flat", d] - at["hilly", d] for d in range(1, 41) if d != 7]
    assert (got["flat"].peers, got["flat"].gap) == (1, pytest.approx(at["flat", 0] - at["hilly", 0]))
    assert (got["flat"].gap_low, got["flat"].gap_high) == pytest.approx(tuple(np.quantile(gaps, [0.025, 0.975])))
    assert (got["long"].peers, got["long"].gap, got["rare"].peers, got["rare"].gap_low) == (0, None, 0, None)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    drawn = courses.course_draws(none, "course", draws=2, rounds=2)
    assert drawn.count() == 0 and courses.course_intervals(drawn, none.select("course", F.col("distance_m")), "course").count() == 0


def test_products_of_matrices_equal_sums_by_cell(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    cells = []
    for _ in range(40):
        own = sorted(rng.choice(5, int(rng.integers(1, 5)), replace=False).tolist())
        cells.append([{"g": g, "n": 2.0, "sx": float(rng.integers(6)), "sxx": 20.0 + g, "sy": float(rng.normal()), "sxy": float(rng.normal())} for g in own])
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(cells)], names=["runner_id", "cells"])
    effects, found = rng.normal(0, 0.05, (5, 6)), []
    for dense in (courses.DENSE, 0):
        monkeypatch.setattr(courses, "DENSE", dense)
        found.append([c.to_numpy() for c in next(courses._round(iter([batch]), effects, np.arange(6))).columns])
    for one, other in zip(*found, strict=True):
        assert one == pytest.approx(other, abs=1e-12)
