"""The hierarchical fit against dense solves, the same updates in plain numpy, and planted effects."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwing.operators import hierarchy
from lapwing.plans.queries import QUERIES
from lapwing.sources.results import results

SCHEMA = "runner_id long, grp string, race_id string, course_id string, year int, x double, y double"


def dense(years, rows, first, drift, s):
    """Mean and covariance of (levels of all seasons, fade) from rows (season, x, r, w): one linear system."""
    k = len(years)
    inverse, shift = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
    inverse[0, 0] += 1 / s.level
    shift[0] += first / s.level
    inverse[k, k] += 1 / s.fade
    for a in range(1, k):
        gap = years[a] - years[a - 1]
        step = np.zeros(k + 1)
        step[[a - 1, a]] = -1, 1
        inverse += np.outer(step, step) / (s.walk * gap)
        shift += step * drift / s.walk
    for season, x, r, w in rows:
        z = np.zeros(k + 1)
        z[season], z[k] = 1, x
        inverse += w * np.outer(z, z) / s.noise
        shift += w * z * r / s.noise
    cov = np.linalg.inv(inverse)
    return cov @ shift, cov


def test_smoother_equals_a_dense_solve():
    rng = np.random.default_rng(0)
    s = hierarchy.Scales()
    runners = [sorted(rng.choice(np.arange(1990, 2010), n, replace=False).tolist()) for n in (1, 4, 7, 2)]
    k = max(map(len, runners))
    years, known = np.zeros((4, k)), np.zeros((4, k), bool)
    precision, shift = np.zeros((4, k, 2, 2)), np.zeros((4, k, 2))
    rows = [[(int(rng.integers(len(y))), float(rng.normal()), float(rng.normal()), float(rng.random())) for _ in range(9)] for y in runners]
    for i, y in enumerate(runners):
        years[i, : len(y)], years[i, len(y) :], known[i, : len(y)] = y, y[-1], True
        for season, x, r, w in rows[i]:
            z = np.array([1, x])
            precision[i, season] += w * np.outer(z, z) / s.noise
            shift[i, season] += w * z * r / s.noise
    first, drift = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.01, -0.02, 0.0, 0.03])
    mean, cov, lag = hierarchy.smooth(years, known, precision, shift, first, drift, s)
    for i, y in enumerate(runners):
        n = len(y)
        want, spread = dense(y, rows[i], first[i], drift[i], s)
        assert np.allclose(mean[i, :n, 0], want[:n]) and np.allclose(mean[i, :n, 1], want[n])
        assert np.allclose(cov[i, :n, 0, 0], np.diag(spread)[:n]) and np.allclose(cov[i, :n, 0, 1], spread[:n, n]) and np.allclose(cov[i, :n, 1, 1], spread[n, n])
        assert np.allclose(lag[i, 1:n], [spread[a, a - 1] for a in range(1, n)])


def plain(rows, rounds, tails):
    """The same updates with lists and dense solves."""
    s = hierarchy.Scales()
    groups, races, courses = {}, {}, {}
    for r, g, race, c, year, _, y in rows:
        groups.setdefault(g, []).append(y)
        races[race] = [c, year, 0.0, 0.0]
        courses[c] = [0.0, 0.0]
    s.groups = {g: (float(np.mean(v)), 0.0) for g, v in groups.items()}
    years = sorted({r[4] for r in rows})
    s.years = dict.fromkeys(years, 0.0)
    f, vf = [None] * len(rows), [0.0] * len(rows)
    of = {}
    for i, r in enumerate(rows):
        of.setdefault(r[0], []).append(i)
    for _ in range(rounds):
        miss = lambda i: (rows[i][6] - f[i] - races[rows[i][2]][2]) ** 2 + vf[i] + races[rows[i][2]][3]  # noqa: E731, B023
        w = [1.0 if f[i] is None else (tails + 1) / (tails + miss(i) / s.noise) for i in range(len(rows))]
        stats = {g: np.zeros(8) for g in s.groups}
        for r, own in of.items():
            seasons = sorted({rows[i][4] for i in own})
            k, g = len(seasons), rows[own[0]][1]
            mean, cov = dense(seasons, [(seasons.index(rows[i][4]), rows[i][5], rows[i][6] - races[rows[i][2]][2], w[i]) for i in own], *s.groups[g], s)
            for i in own:
                a, x = seasons.index(rows[i][4]), rows[i][5]
                f[i], vf[i] = mean[a] + mean[k] * x, cov[a, a] + 2 * x * cov[a, k] + x * x * cov[k, k]
            st = stats[g]
            st[:4] += 1, mean[0], mean[0] ** 2 + cov[0, 0], mean[k] ** 2 + cov[k, k]
            for a in range(1, k):
                gap, step = seasons[a] - seasons[a - 1], mean[a] - mean[a - 1]
                st[4:] += gap, step, 1, ((step - s.groups[g][1] * gap) ** 2 + cov[a, a] + cov[a - 1, a - 1] - 2 * cov[a, a - 1]) / gap
        w = [(tails + 1) / (tails + miss(i) / s.noise) for i in range(len(rows))]
        before = {race: v[2:] for race, v in races.items()}
        wm = sum(w[i] * ((rows[i][6] - f[i] - before[rows[i][2]][0]) ** 2 + vf[i] + before[rows[i][2]][1]) for i in range(len(rows)))
        for race, v in races.items():
            own = [i for i in range(len(rows)) if rows[i][2] == race]
            p = sum(w[i] for i in own) / s.noise + 1 / s.race
            v[2:] = (sum(w[i] * (rows[i][6] - f[i]) for i in own) / s.noise + (courses[v[0]][0] + s.years[v[1]]) / s.race) / p, 1 / p
        for c in courses:
            own = [v for v in races.values() if v[0] == c]
            p = len(own) / s.race + 1 / s.course
            courses[c] = [sum(v[2] - s.years[v[1]] for v in own) / s.race / p, 1 / p]
        centre = np.mean([c[0] for c in courses.values()])
        courses = {k: [c[0] - centre, c[1]] for k, c in courses.items()}
        inverse, shift = np.zeros((len(years),) * 2), np.zeros(len(years))
        for a in range(len(years)):
            own = [v for v in races.values() if v[1] == years[a]]
            inverse[a, a] += len(own) / s.race
            shift[a] = sum(v[2] - courses[v[0]][0] for v in own) / s.race
            if a:
                inverse[a - 1 : a + 1, a - 1 : a + 1] += np.array([[1, -1], [-1, 1]]) / (s.year * (years[a] - years[a - 1]))
        cov = np.zeros_like(inverse)
        cov[1:, 1:] = np.linalg.inv(inverse[1:, 1:])
        mean = cov @ shift
        s.years = dict(zip(years, mean, strict=True))
        s.race = float(np.mean([(v[2] - courses[v[0]][0] - s.years[v[1]]) ** 2 + v[3] + courses[v[0]][1] + cov[years.index(v[1]), years.index(v[1])] for v in races.values()]))
        total = sum(stats.values())
        s.groups = {g: (v[1] / v[0], v[5] / v[4] if v[4] else 0.0) for g, v in stats.items()}
        s.noise = wm / len(rows)
        s.level, s.fade, s.walk = sum(v[2] - v[1] ** 2 / v[0] for v in stats.values()) / total[0], total[3] / total[0], total[7] / total[6]
        s.course = float(np.mean([c[0] ** 2 + c[1] for c in courses.values()]))
        s.year = float(np.mean([((mean[a + 1] - mean[a]) ** 2 + cov[a, a] + cov[a + 1, a + 1] - 2 * cov[a, a + 1]) / (years[a + 1] - years[a]) for a in range(len(years) - 1)]))
    return s, races, courses, f


def planted(runners, races, seed=1):
    """Rows with known levels, costs of races and scales: 6 courses, 8 years, three groups."""
    rng = np.random.default_rng(seed)
    course, year = rng.normal(0, 0.05, 6), np.concatenate([[0], np.cumsum(rng.normal(0, 0.02, 7))])
    course -= course.mean()
    about = [(f"c{k % 6}", k % 8, course[k % 6] + year[k % 8] + rng.normal(0, 0.02)) for k in range(races)]
    rows = []
    for r in range(runners):
        level, fade = 0.2 + 0.1 * (r % 3) + rng.normal(0, 0.1), rng.normal(0, 0.03)
        form = np.cumsum(np.concatenate([[0], rng.normal(0.005, 0.02, 7)]))
        for k in rng.choice(races, int(rng.integers(1, 9)), replace=False).tolist():
            c, y, cost = about[k]
            x = math.log((5, 8, 10, 16, 21, 42)[k % 6] / 10)
            rows.append((r, f"g{r % 3}", f"r{k}", c, 2000 + y, x, float(level + form[y] + fade * x + cost + rng.standard_t(5) * 0.03)))
    return rows, about, course


def test_equals_plain_numpy(spark):
    rows, *_ = planted(40, 16)
    found = hierarchy.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), rounds=3)
    s, races, courses, _ = plain(rows, 3, hierarchy.TAILS)
    for name in ("noise", "level", "fade", "walk", "course", "race", "year"):
        assert getattr(found.scales, name) == pytest.approx(getattr(s, name), rel=1e-8), name
    assert {r.race_id: (r.cost, r.var_cost) for r in found.races.collect()} == {k: pytest.approx(tuple(v[2:]), rel=1e-8, abs=1e-12) for k, v in races.items()}
    assert {r.course_id: r.course for r in found.courses.collect()} == {k: pytest.approx(v[0], rel=1e-8, abs=1e-12) for k, v in courses.items()}
    assert {k: pytest.approx(v, rel=1e-8, abs=1e-12) for k, v in s.groups.items()} == found.scales.groups


def test_planted_effects_are_found(spark):
    rows, about, course = planted(1500, 48)
    found = hierarchy.fit(spark.createDataFrame(rows, SCHEMA), rounds=10)
    s = found.scales
    assert math.sqrt(s.level) == pytest.approx(0.1, rel=0.15) and math.sqrt(s.noise) == pytest.approx(0.03, rel=0.2) and math.sqrt(s.walk) == pytest.approx(0.02, rel=0.4)
    got = {r.race_id: r.cost for r in found.races.collect()}
    want = np.array([a[2] for a in about])
    own = np.array([got[f"r{k}"] for k in range(len(about))])
    assert np.corrcoef(own, want)[0, 1] > 0.97 and found.moved[-1] < 0.02
    asked = spark.createDataFrame([(0, 0, "g0", "c0", 2007, 0.0), (1, 99999, "g1", "c0", 2007, 0.0), (2, None, None, "new", 2011, 0.0)], "id long, runner_id long, grp string, course_id string, year int, x double")
    said = {r.id: r for r in hierarchy.predict(found, asked).collect()}
    assert said[0].sd < said[1].sd < said[2].sd and abs(said[1]["mean"] - 0.3) < 0.25


def test_nulls_and_nothing(spark):
    rows, *_ = planted(20, 8)
    more = [(None, "g", "r", "c", 2000, 0.0, 0.0), (1, None, "r0", "c0", 2000, 0.0, 0.1), (1, "g1", None, "c0", 2000, 0.0, 0.1), (1, "g1", "r0", "c0", 2000, None, 0.1), (77, None, "r0", "c0", 2000, 0.0, 0.1)]
    table = spark.createDataFrame([(*r, "clash") for r in rows + more], SCHEMA + ", cost string")
    found = hierarchy.fit(table, rounds=2)
    assert found.levels.where("runner_id is null").count() == 0 and found.levels.where("runner_id = 77").count() == 1 and "" in found.scales.groups
    empty = hierarchy.fit(table.limit(0), rounds=2)
    assert empty.levels.count() == 0 and empty.races.count() == 0
    asked = spark.createDataFrame([(0, 1, "g", "c", 2000, 0.0)], "id long, runner_id long, grp string, course_id string, year int, x double")
    assert hierarchy.predict(empty, asked).first().sd > 0


def test_query_covers_the_last_year(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["hierarchical_predictions"](spark, sf).join(results(spark, sf).select("entry_id", "seconds"), "entry_id").where(F.col("seconds").isNotNull()).toPandas()
    inside = ((got.q10 <= got.seconds) & (got.seconds <= got.q90)).mean()
    assert len(got) > 500 and 0.72 < inside < 0.9 and (got.q10 < got.q50).all() and (got.q50 < got.q90).all()


def test_runners_too_wide_for_blocks_count_the_same(spark, monkeypatch):
    rows, *_ = planted(40, 16)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = {r[0]: sorted({(q[4], q[1]) for q in rows if q[0] == r[0]}) for r in rows}
    found = []
    for block, wide, sent in ((1 << 16, 1 << 16, 32 << 20), (8, 5, 0)):
        for name, value in (("BLOCK", block), ("WIDE", wide), ("SENT", sent)):
            monkeypatch.setattr(hierarchy, name, value)
        got = hierarchy.fit(table, rounds=2)
        assert {r.runner_id: sorted(map(tuple, r.a)) for r in got.levels.groupBy("runner_id").agg(F.collect_list(F.struct("year", "grp")).alias("a")).collect()} == wanted
        found.append((got.scales.noise, got.scales.walk, {(r.runner_id, r.year): pytest.approx((r.level, r.fade, r.var_level, r.cov, r.var_fade), rel=1e-8, abs=1e-12) for r in got.levels.where("last").collect()}))
    assert found[0][:2] == pytest.approx(found[1][:2], rel=1e-8) and len(found[0][2]) == len(wanted)
    assert {k: tuple(v.expected) for k, v in found[1][2].items()} == found[0][2]


def test_a_round_shuffles_no_finishes(spark):
    rows, *_ = planted(300, 16)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(rounds):
        before = {store_stage.stageId() for store_stage in stages()}
        hierarchy.fit(table, rounds=rounds)
        return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return [found.apply(k) for k in range(found.size())]

    assert (shuffled(3) - shuffled(1)) / 2 < len(rows)
