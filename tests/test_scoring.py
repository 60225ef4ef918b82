"""Resampled intervals against brute force."""

from math import exp, factorial

import numpy as np
from pyspark.sql import functions as F

from lapwing.operators import scoring


def test_bootstrap_of_2000_draws(spark):
    rows = [(f"s{k % 3}", f"u{k % 41}", None if k % 10 == 0 else float(k * k % 97)) for k in range(600)]
    table = spark.createDataFrame(rows, "stratum string, unit string, x double")
    seeds = {r.unit: r.seed for r in table.select("unit", F.xxhash64("unit").alias("seed")).distinct().collect()}
    full, cuts = (1 << 64) - 1, np.cumsum([exp(-1) / factorial(k) for k in range(17)])

    def count(seed, draw):
        x = (seed + draw * 0x9E3779B97F4A7C15) & full
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return int(np.searchsorted(cuts, (x ^ x >> 31) / 2**64, "right"))

    counts = {u: np.array([count(s, d) for d in range(1, 2001)]) for u, s in seeds.items()}
    for r in scoring.bootstrap_whole(table, "unit", F.col("x"), "stratum").collect():
        own = [(u, x) for s, u, x in rows if s == r.stratum and x is not None]
        means = sum(counts[u] * x for u, x in own) / sum(counts[u] for u, _ in own)
        assert len(means) == 2000 and (r.n, r.point) == (len(own), round(sum(x for _, x in own) / len(own), 6))
        assert np.allclose([r.low, r.high], np.percentile(means, [2.5, 97.5]), atol=2e-6)
    every = scoring.drawn_counts(np.arange(500), 2000)
    assert abs(every.mean() - 1) < 0.01 and abs(every.var() - 1) < 0.01


def test_thresholds_of_many_scores_need_no_whole_stratum(spark):
    rows = spark.range(24_000).select(F.lit("a").alias("stratum"), (F.col("id") % 7).alias("race_date"), (F.col("id") * 7919 % 24_001 / 24_001.0).alias("score")).repartition(3)
    found = scoring.rolling_thresholds(rows)
    scores = {d: [k * 7919 % 24_001 / 24_001.0 for k in range(24_000) if k % 7 < d] for d in range(7)}
    for r in found.collect():
        own = sorted(scores[r.race_date])
        assert (r.pool, r.threshold) == (len(own), own[int(np.ceil((len(own) + 1) * 0.8)) - 1] if own else None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2


def test_rolling_conformal_computes_no_medians(spark):
    from lapwing.plans import queries as plans

    plan = plans.QUERIES["rolling_conformal"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
