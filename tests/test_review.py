"""Samples of decisions and their scores, against lists."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from lapwing.operators import review


def md5(*parts):
    return hashlib.md5(":".join(parts).encode()).hexdigest()


def test_draw_takes_the_smallest_hashes_of_each_stratum(spark):
    rows = [(s, f"{s}{k}", k) for s, n in (("a", 500), ("b", 7), (None, 30)) for k in range(n)] + [("b", "b1", 1), ("a", None, 0)]
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], "stratum string, pair string, k long, turn int, population int").drop("turn", "population")
    got = review.draw(table.repartition(7), 10, "s").collect()
    for stratum, size in (("a", 500), ("b", 8), (None, 30)):
        own = sorted((md5("s", stratum or "", p), p) for s, p, _ in rows if s == stratum and p is not None)
        mine = sorted((r.turn, r.pair) for r in got if r.stratum == stratum)
        assert [p for _, p in mine] == [p for _, p in own[:10]] and [t for t, _ in mine] == list(range(1, min(10, size) + 1))
        assert {(r.population, r.sampled) for r in got if r.stratum == stratum} == {(size, min(10, size))}
    assert review.draw(table.limit(0)).count() == 0


def test_score_weighs_strata_by_their_decisions(spark):
    labels = ["same", "different", "Same ", "unsure", None, "", "different", "same"]
    rows = [(s, f"{s}{k}", n, k % 3 != flip, labels[(k + flip) % 8]) for s, n, flip in (("a", 1000, 0), ("b", 50, 1), ("c", 5, 2)) for k in range(24)]
    rows += [("never", f"n{k}", 9000, False, "different") for k in range(5)]
    got = {r.measure: r for r in review.score(spark.createDataFrame(rows, "stratum string, pair string, population long, joined boolean, label string"), 60, "s").collect()}
    sure = [(s, p, n, j, (lab or "").strip().lower() == "same") for s, p, n, j, lab in rows if (lab or "").strip().lower() in ("same", "different")]

    def value(pick, d):
        up = down = 0.0
        for stratum in ("a", "b", "c", "never"):
            own = [(n, j, same, 1 if d == 0 else sum(c <= int(md5("s", p, str(d))[:8], 16) / 4294967296 for c in review._CUTS)) for s, p, n, j, same in sure if s == stratum]
            of = sum(t for _, j, same, t in own if (j if pick == "precision" else same))
            if of:
                up += own[0][0] * sum(t for _, j, same, t in own if j and same) / of
                down += own[0][0]
        return up / down if down else None

    for pick in ("precision", "recall"):
        values = [v for d in range(1, 61) if (v := value(pick, d)) is not None]
        assert (got[pick].point, got[pick].low, got[pick].high) == pytest.approx((value(pick, 0), *np.quantile(values, [0.025, 0.975])))
        assert (got[pick].labelled, got[pick].unsure, got[pick].unlabelled) == (len(sure), sum(r[4] == "unsure" for r in rows), sum(not r[4] for r in rows))


def test_decisions_of_every_kind(spark):
    from datetime import date

    said = [(1, "al", False), (2, "al", False), (3, "al#1", False), (4, "al#1", False), (5, "al#held#5", True), (6, "bea", False), (7, "cy#held#7", True), (8, "al#2", False)]
    towns = {1: "ferry", 2: "ferry", 3: "quay", 4: "port", 5: "", 6: "", 7: "x", 8: None}
    resolved = spark.createDataFrame(said, "entry_id long, runner string, ambiguous boolean")
    results = spark.createDataFrame([(k, date(2000 + k, 1, 1), t, "clash") for k, t in towns.items()], "entry_id long, race_date date, town string, runner string")
    got = review.decisions(resolved, results).collect()
    assert Counter(r.stratum for r in got) == {"merged, one town": 1, "merged, two towns": 1, "split by age": 2, "held back": 1}
    by = {r.stratum: r for r in got}
    assert {by["merged, one town"].one, by["merged, one town"].other} == {1, 2} and by["merged, one town"].joined
    assert (by["merged, two towns"].one, by["merged, two towns"].other) == (3, 4)
    assert by["held back"].one == 5 and by["held back"].other in (1, 2, 3, 4, 8) and not by["held back"].joined
    runner = {e: r for e, r, _ in said}
    assert all(runner[r.one] != runner[r.other] for r in got if r.stratum == "split by age")
