"""Boosted quantiles against the same trees grown in numpy from all rows at once."""

import numpy as np
from pyspark.sql import functions as F

from lapwing.operators import boosting
from lapwing.plans import models as plan
from lapwing.plans.queries import QUERIES
from lapwing.sources.results import results

SCHEMA = "id long, block int, y double, a double, b double, c double, clash string"


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.random(n)
    y = 0.1 * np.where(a > 0.3, 1, -1) + 0.02 * b + rng.normal(size=n) * 0.02 * (1 + 2 * c)
    out = []
    for k in range(n):
        out.append((k % (n - 2), None if k % 50 == 7 else int(1 + k * 5 // n), None if k % 11 == 3 else float(y[k]), None if k % 13 == 5 else float(a[k]), float(b[k]), None if k % 3 == 0 else float(c[k]), "x"))
    return out


def dense(rows, bounds, blocks, quantiles, rounds, depth, rate, least, ridge=boosting.RIDGE):
    x = np.array([[np.nan if v is None else v for v in r[3:6]] for r in rows], float)
    bins = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(bounds[k], x[:, k])) for k in range(x.shape[1])], axis=1)
    y = np.array([np.nan if r[2] is None else r[2] for r in rows], float)
    block = np.array([-1 if r[1] is None else r[1] for r in rows])
    out = np.full((len(rows), len(quantiles)), np.nan)
    for b in blocks:
        fit, ask = (block >= 0) & (block < b) & ~np.isnan(y), block == b
        for qk, q in enumerate(quantiles):
            now = np.zeros(len(rows))
            for r in range(rounds + 1):
                leaf = np.zeros(len(rows), int)
                for level in range(depth if r else 0):
                    new = 2 * leaf
                    for node in range(1 << level):
                        own = fit & (leaf == node)
                        low = own & (y < now)
                        best, chosen = 1e-9, None
                        score = lambda n, m: ((1 - q) * m - q * (n - m)) ** 2 / (n + ridge)
                        n, m = own.sum(), low.sum()
                        for f in range(bins.shape[1]):
                            for t in sorted(set(bins[own, f]) - {0}):
                                for null in (0, 1):
                                    left = ((bins[:, f] > 0) & (bins[:, f] <= t)) | ((bins[:, f] == 0) & (null == 1))
                                    ln, lm = (own & left).sum(), (low & left).sum()
                                    gain = score(ln, lm) + score(n - ln, m - lm) - score(n, m)
                                    if ln >= least and n - ln >= least and gain > best:
                                        best, chosen = gain, left
                        if chosen is not None:
                            new[(leaf == node) & ~chosen] += 1
                    leaf = new
                step = np.zeros(len(rows))
                for k in set(leaf.tolist()):
                    own = fit & (leaf == k)
                    if own.any():
                        cells = np.sort(np.clip(np.floor((y[own] - now[own] + boosting.SPAN) * (boosting.CELLS / (2 * boosting.SPAN))), 0, boosting.CELLS - 1))
                        cell = min(c for c in set(cells.tolist()) if (cells <= c).sum() >= q * len(cells))
                        step[leaf == k] = (cell + 0.5) * (2 * boosting.SPAN / boosting.CELLS) - boosting.SPAN
                now = now + step * (rate if r else 1.0)
            out[ask, qk] = now[ask]
    out.sort(axis=1)
    return out


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)
    rows = rows_of(900)
    table = spark.createDataFrame(rows, SCHEMA)
    quantiles, inputs = (0.1, 0.5, 0.9), ["a", "b", "c"]
    got = boosting.boosted_quantiles(table.repartition(3), inputs, quantiles, rounds=3, depth=2, rate=0.3, least_fit=300).collect()
    blocks = [3, 4, 5]  # 300 rows with a y are before the third
    bounds = boosting.edges(table.where(F.col("block") < blocks[0]), inputs)
    want = dense(rows, bounds, blocks, quantiles, 3, 2, 0.3, boosting.LEAST_LEAF)
    key = lambda r: (r[0], *(np.nan_to_num(r[1:], nan=-9.0)))
    a = sorted(((r.id, *(np.nan if r[f"q{k}"] is None else r[f"q{k}"] for k in range(3))) for r in got), key=key)
    b = sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)
    np.testing.assert_allclose(np.array(a, float), np.array(b, float), atol=1e-12)
    shown = want[~np.isnan(want[:, 0])]
    assert len(shown) > 400 and (np.diff(shown, axis=1) >= 0).all()


def test_later_rows_change_nothing(spark):
    rows = rows_of(700)
    ask = dict(inputs=["a", "b", "c"], quantiles=(0.5,), rounds=2, depth=2, least_fit=200)
    first = {r.id: r.q0 for r in boosting.boosted_quantiles(spark.createDataFrame(rows, SCHEMA), **ask).collect()}
    other = [(*r[:2], r[2] if r[1] in (1, 2, 3) or r[2] is None else r[2] * 50 + 1, *r[3:]) for r in rows]
    again = {r.id: r.q0 for r in boosting.boosted_quantiles(spark.createDataFrame(other, SCHEMA), **ask).collect()}
    own = [r[0] for r in rows if r[1] is not None and r[1] <= 4 and r[0] > 1]
    assert all(first[k] == again[k] for k in own) and sum(first[k] is not None for k in own) > 100


def test_too_little_history_and_no_rows(spark):
    table = spark.createDataFrame(rows_of(60), SCHEMA)
    assert {tuple(r)[1:] for r in boosting.boosted_quantiles(table, ["a"], (0.5,)).collect()} == {(None,)}
    assert boosting.boosted_quantiles(table.limit(0), ["a"], (0.5,)).count() == 0


def test_query_is_better_than_chance(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["boosted_quantiles"](spark, sf).join(results(spark, sf).select("entry_id", "seconds", F.year("race_date").alias("year")), "entry_id").toPandas()
    assert len(got) == 15_000 and plan.ROUNDS >= 10
    asked = got.dropna()
    q = [c for c in got if c.startswith("q")]
    assert (np.diff(asked[q].to_numpy(), axis=1) >= 0).all() and len(asked) > 10_000
    inside = ((asked.q10 <= asked.seconds) & (asked.seconds <= asked.q90)).mean()
    assert 0.75 < inside < 0.85


def test_packed_columns_are_read_without_a_copy():
    import pyarrow as pa

    whole = pa.array([bytes([k, k + 1, 7]) for k in range(5)], pa.binary())
    for column in (whole, whole.slice(2, 2)):
        got = boosting._fixed(column, 3)
        assert got.reshape(-1, 3).tolist() == [list(x) for x in column.to_pylist()] and np.shares_memory(got, np.frombuffer(column.buffers()[2], np.uint8))
    assert boosting._fixed(pa.array([None, b"abc"], pa.binary()), 3).tolist() == [0, 0, 0, *b"abc"]
    assert boosting._fixed(pa.nulls(2, pa.binary()), 3).tolist() == [0] * 6
