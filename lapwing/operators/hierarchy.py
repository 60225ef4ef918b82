"""A hierarchical model of finish times, fitted by variational updates whose statistics are grouped sums.

The logarithm of a finish over the distance's own pace is a runner's level that season,
their fade over distance, what that race cost everyone, and noise with heavy tails:

    y = level[runner, season] + fade[runner] * x + race[r] + noise

A runner's first level is drawn around their group's, later ones walk from season to
season with the group's drift, spreading with the years between; fades are drawn around nothing. A
race's cost is drawn around its course's plus its year's; years walk too. Runners and races
are updated in turn, each given the other: sums by runner and season go through
a filter and a smoother along the seasons of each runner, sums by race through a shrunk
mean; scales are set to what the updates expect. Finishes are packed once, in blocks of whole
runners, and a round passes over the blocks once: a block's runners are updated together and what it says of
its races are a few numbers each, so that no round shuffles finishes. A runner of more than ``WIDE``
finishes isn't packed: their rows are summed up by key instead. Races stay a table, of which a block is joined
with its own, and what comes to the driver are scales, groups and years.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.sources.shared import drop, save

#: Degrees of freedom of the noise; rounds of updates.
TAILS, ROUNDS = 5.0, 12
#: Finishes after which a block is closed; finishes of a runner beyond which rows are summed up by key; bytes of races' costs that are sent to all tasks instead of shuffled.
BLOCK, WIDE, SENT = 1 << 16, 1 << 16, 32 << 20

_SEASONS = "runner_id long, grp string, years array<int>, w array<double>, wx array<double>, wxx array<double>, wr array<double>, wxr array<double>"
_LEVELS = "runner_id long, grp string, year int, gap double, level double, fade double, var_level double, cov double, var_fade double, step double, step_square double, first boolean, last boolean"
_PACKED = "block long, groups array<string>, races array<long>, runner binary, code binary, seasons binary, year binary, count binary, race binary, x binary, y binary"
_TOLD = "race long, w double, wl double, wm double, n long"
_GROUP = "grp string, n long, m double, mm double, bb double, gaps double, steps double, k long, ss double"
_UPDATED = f"{_PACKED}, state binary, told array<struct<{_TOLD.replace(' ', ':').replace(',:', ',')}>>, stats array<struct<{_GROUP.replace(' ', ':').replace(',:', ',')}>>"
_KEPT = "runner_id long, grp string, year int, level double, fade double, var_level double, cov double, var_fade double, first boolean, last boolean"


@dataclass
class Scales:
    """Variances of each part, the groups' first levels and yearly drifts, and the years' costs (the first one is 0)."""

    noise: float = 0.01
    level: float = 0.04
    fade: float = 0.0025
    walk: float = 0.001
    course: float = 0.0025
    race: float = 0.0025
    year: float = 0.0004
    groups: dict[str, tuple[float, float]] = field(default_factory=dict)
    years: dict[int, float] = field(default_factory=dict)


def smooth(years: np.ndarray, known: np.ndarray, precision: np.ndarray, shift: np.ndarray, first: np.ndarray, drift: np.ndarray, scales: Scales) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means ``[runner, season, 2]``, covariances ``[..., 2, 2]`` and lagged covariances of levels with the season before, of (level, fade).

    ``precision`` and ``shift`` are what each season's rows say; seasons that aren't ``known`` come after a runner's last and say nothing.
    """
    n, k = years.shape
    gap = np.zeros((k, n))
    gap[1:] = np.where(known[:, 1:], np.diff(years, axis=1), 0).T
    p00, p01, p11 = (np.ascontiguousarray(precision[..., i, j].T) for i, j in ((0, 0), (0, 1), (1, 1)))
    b0, b1 = (np.ascontiguousarray(shift[..., i].T) for i in (0, 1))
    level, fade = first.astype(float), np.zeros(n)
    c00, c01, c11 = np.full(n, scales.level), np.zeros(n), np.full(n, scales.fade)
    before, filtered = [], []
    # Two by two matrices are written out, as solving millions of them one at a time costs far more.
    for s in range(k):
        level, c00 = level + drift * gap[s], c00 + gap[s] * scales.walk
        before.append((level, c00, c01, c11))
        # The new covariance is (1 + C P)^-1 C, which no small variance makes singular.
        a00, a01 = 1 + c00 * p00[s] + c01 * p01[s], c00 * p01[s] + c01 * p11[s]
        a10, a11 = c01 * p00[s] + c11 * p01[s], 1 + c01 * p01[s] + c11 * p11[s]
        det = a00 * a11 - a01 * a10
        c00, c01, c11 = (a11 * c00 - a01 * c01) / det, (a11 * c01 - a01 * c11) / det, (a00 * c11 - a10 * c01) / det
        left0, left1 = b0[s] - p00[s] * level - p01[s] * fade, b1[s] - p01[s] * level - p11[s] * fade
        level, fade = level + c00 * left0 + c01 * left1, fade + c01 * left0 + c11 * left1
        filtered.append((level, fade, c00, c01))
    out = np.zeros((k, 6, n))  # level, fade, three of the covariance, lagged
    out[k - 1, :5] = level, fade, c00, c01, c11
    for s in range(k - 2, -1, -1):
        own, faded, s00, s01 = filtered[s]
        ahead, w00, w01, w11 = before[s + 1]
        # Only levels walk: the pull towards the season after is the identity but for its first row.
        walked = gap[s + 1] * scales.walk
        share = np.divide(walked, w00 * w11 - w01 * w01, out=np.zeros(n), where=walked > 0)
        g0, g1 = 1 - share * w11, share * w01
        d00, d01, d11 = c00 - w00, c01 - w01, c11 - w11
        out[s + 1, 5] = c00 * g0 + c01 * g1
        level = own + g0 * (level - ahead) + g1 * (fade - faded)
        c00, c01 = s00 + g0 * g0 * d00 + 2 * g0 * g1 * d01 + g1 * g1 * d11, s01 + g0 * d01 + g1 * d11
        out[s, :5] = level, fade, c00, c01, c11
    means = out[:, :2].transpose(2, 0, 1)
    covs = out[:, [2, 3, 3, 4]].transpose(2, 0, 1).reshape(n, k, 2, 2)
    return means, covs, out[:, 5].T


def _levels(batches: Iterator[pa.RecordBatch], scales: Scales) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        counts = np.array([len(y) for y in batch.column("years").to_pylist()])
        n, k = len(counts), int(counts.max())
        known = np.arange(k) < counts[:, None]

        def padded(name: str, known: np.ndarray = known, batch: pa.RecordBatch = batch) -> np.ndarray:
            out = np.zeros(known.shape)
            out[known] = batch.column(name).flatten().to_numpy(zero_copy_only=False)
            return out

        years, w, wx, wxx, wr, wxr = (padded(c) for c in ("years", "w", "wx", "wxx", "wr", "wxr"))
        years = np.where(known, years, years[np.arange(n), counts - 1][:, None])
        groups = batch.column("grp").to_pylist()
        first, drift = (np.array([scales.groups.get(g, (0.0, 0.0))[j] for g in groups]) for j in (0, 1))
        precision = np.stack([np.stack([w, wx], -1), np.stack([wx, wxx], -1)], -1) / scales.noise
        mean, cov, lag = smooth(years, known, precision, np.stack([wr, wxr], -1) / scales.noise, first, drift, scales)
        gap = np.zeros((n, k))
        gap[:, 1:] = np.diff(years, axis=1)
        step = np.zeros((n, k))
        step[:, 1:] = np.diff(mean[..., 0], axis=1)
        square = np.zeros((n, k))
        square[:, 1:] = (step[:, 1:] - drift[:, None] * gap[:, 1:]) ** 2 + cov[:, 1:, 0, 0] + cov[:, :-1, 0, 0] - 2 * lag[:, 1:]
        index = np.arange(k)[None] + np.zeros((n, 1), int)
        rows = np.nonzero(known)[0]
        columns = [np.array(batch.column("runner_id").to_pylist())[rows], np.array(groups, object)[rows], years[known].astype(np.int32), gap[known], mean[known][:, 0], mean[known][:, 1], cov[known][:, 0, 0], cov[known][:, 0, 1], cov[known][:, 1, 1], step[known], square[known], (index == 0)[known], (index == counts[:, None] - 1)[known]]
        types = [pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * 8, pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _LEVELS.split(", ")])


def _block(rows: pa.Table, number: int) -> pa.RecordBatch:
    """Rows (runner_id, grp, race, year, x, y) in order of runner and year as one row of ``_PACKED``."""
    runner, race, year, x, y = (rows[c].to_numpy() for c in ("runner_id", "race", "year", "x", "y"))
    new = np.append(True, runner[1:] != runner[:-1])
    season = new | np.append(True, year[1:] != year[:-1])
    begins, starts = np.flatnonzero(new), np.flatnonzero(season)
    groups, code = np.unique(rows["grp"].to_numpy(), return_inverse=True)
    races, which = np.unique(race, return_inverse=True)
    packed = [
        runner[begins], np.minimum.reduceat(code, begins).astype(np.int32), np.add.reduceat(season, begins, dtype=np.int32), year[starts].astype(np.int32),
        np.diff(np.append(starts, len(runner))).astype(np.int32), which.astype(np.int32), x, y,
    ]
    columns = [pa.array([number], pa.int64()), pa.array([groups.tolist()], pa.list_(pa.string())), pa.array([races.tolist()], pa.list_(pa.int64())), *[pa.array([v.tobytes()], pa.binary()) for v in packed]]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PACKED.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole runners; a partition's rows come in order of runner and year."""
    number, held, n = TaskContext.get().partitionId() << 33, [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            rows = pa.Table.from_batches(held).combine_chunks()
            runner = rows["runner_id"].to_numpy()
            cut = int(np.searchsorted(runner, runner[-1]))  # the last runner may go on
            if cut:
                yield _block(rows.slice(0, cut).combine_chunks(), number)
                number += 1
            held, n = rows.slice(cut).to_batches(), n - cut
    if n:
        yield _block(pa.Table.from_batches(held).combine_chunks(), number)


def _read(row: dict) -> tuple[np.ndarray, ...]:
    """Runners, their groups, their numbers of seasons; seasons' years and numbers of rows; rows' races, x and y."""
    kinds = {"runner": np.int64, "code": np.int32, "seasons": np.int32, "year": np.int32, "count": np.int32, "race": np.int32, "x": float, "y": float}
    return tuple(np.frombuffer(row[c], t) for c, t in kinds.items())


def _update(row: dict, scales: Scales, tails: float) -> dict:
    """A block after one round: its runners' state, given the costs of races, and what its rows say of races and groups."""
    _, code, seasons, year, count, race, x, y = _read(row)
    costs = np.array([(c["cost"], c["var_cost"]) for c in sorted(row["costs"], key=lambda c: c["at"])]).T
    cost, var_cost = costs[:, race]
    season, off, n, k = np.repeat(np.arange(len(year)), count), y - cost, len(code), int(seasons.max())

    def expected(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level, fade, var_level, cov, var_fade = state[:, season]
        return level + fade * x, var_level + 2 * x * cov + x * x * var_fade

    def weighed(f: np.ndarray, vf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        miss = (off - f) ** 2 + vf + var_cost
        return (tails + 1) / (tails + miss / scales.noise), miss

    w = weighed(*expected(np.frombuffer(row["state"]).reshape(5, -1)))[0] if row["state"] else np.ones(len(y))
    known = np.arange(k) < seasons[:, None]

    def padded(v: np.ndarray) -> np.ndarray:
        out = np.zeros(known.shape)
        out[known] = v
        return out

    sums = [padded(np.bincount(season, v, len(year))) / scales.noise for v in (w, w * x, w * x * x, w * off, w * x * off)]
    years = padded(year)
    years = np.where(known, years, years[np.arange(n), seasons - 1][:, None])
    first, drift = (np.array([scales.groups.get(g, (0.0, 0.0))[j] for g in row["groups"]])[code] for j in (0, 1))
    precision = np.stack([np.stack(sums[:2], -1), np.stack(sums[1:3], -1)], -1)
    mean, cov, lag = smooth(years, known, precision, np.stack(sums[3:], -1), first, drift, scales)
    gap, step = (np.diff(v, axis=1) * known[:, 1:] for v in (years, mean[..., 0]))
    square = (step - drift[:, None] * gap) ** 2 + cov[:, 1:, 0, 0] + cov[:, :-1, 0, 0] - 2 * lag[:, 1:]
    walked = np.divide(square, gap, out=np.zeros_like(gap), where=gap > 0)
    level, fade = mean[:, 0].T
    by = lambda v: np.bincount(code, v, len(row["groups"])).tolist()
    stats = zip(row["groups"], np.bincount(code, minlength=len(row["groups"])).tolist(), by(level), by(level**2 + cov[:, 0, 0, 0]), by(fade**2 + cov[:, 0, 1, 1]), by(gap.sum(1)), by(step.sum(1)), map(round, by((gap > 0).sum(1))), by(walked.sum(1)), strict=True)
    state = np.stack([mean[known][:, 0], mean[known][:, 1], cov[known][:, 0, 0], cov[known][:, 0, 1], cov[known][:, 1, 1]])
    f, vf = expected(state)
    w, miss = weighed(f, vf)
    of = lambda v: np.bincount(race, v, len(row["races"])).tolist()
    told = zip(row["races"], of(w), of(w * (y - f)), of(w * miss), np.bincount(race, minlength=len(row["races"])).tolist(), strict=True)
    named = lambda names, rows: [dict(zip([c.split()[0] for c in names.split(", ")], r, strict=True)) for r in rows]
    return {"state": state.tobytes(), "told": named(_TOLD, told), "stats": named(_GROUP, (s for s in stats if s[1]))}


def _rounds(batches: Iterator[pa.RecordBatch], scales: Scales, tails: float) -> Iterator[pa.RecordBatch]:
    kept, kinds = [c.split()[0] for c in _PACKED.split(", ")], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    rows_of = lambda names: pa.list_(pa.struct([(c.split()[0], kinds[c.split()[1]]) for c in names.split(", ")]))
    types = {"state": pa.binary(), "told": rows_of(_TOLD), "stats": rows_of(_GROUP)}
    for batch in batches:
        for k in range(batch.num_rows):
            block = batch.slice(k, 1)
            new = _update(block.to_pylist()[0], scales, tails)
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in kept], *[pa.array([new[c]], t) for c, t in types.items()]], names=[*kept, *types])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of all runners of the blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            runner, code, seasons, year, *_ = _read(row)
            ends = np.cumsum(seasons)
            first, last = np.zeros(len(year), bool), np.zeros(len(year), bool)
            first[ends - seasons], last[ends - 1] = True, True
            columns = [np.repeat(runner, seasons), np.array(row["groups"], object)[np.repeat(code, seasons)], year, *np.frombuffer(row["state"]).reshape(5, -1), first, last]
            types = [pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * 5, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _KEPT.split(", ")])


@dataclass
class Fit:
    """What is expected of each part: ``levels`` by runner and season, ``races`` and ``courses``, with variances, and the scales."""

    levels: DataFrame
    races: DataFrame
    courses: DataFrame
    scales: Scales
    moved: list[float]


def _walk(sums: dict[int, tuple[float, float]], variance: float, years: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the years' costs, a walk from 0 in the first, given each year's (precision, precision times mean)."""
    k = len(years) - 1
    if k < 1:
        return np.zeros(1), np.zeros((1, 1))
    inverse = np.zeros((k + 1, k + 1))
    for a, (y0, y1) in enumerate(zip(years, years[1:], strict=False)):
        inverse[a : a + 2, a : a + 2] += np.array([[1, -1], [-1, 1]]) / (variance * (y1 - y0))
    inverse += np.diag([sums[y][0] for y in years])
    shift = np.array([sums[y][1] for y in years])
    cov = np.zeros((k + 1, k + 1))
    cov[1:, 1:] = np.linalg.inv(inverse[1:, 1:])
    return cov @ shift, cov


def _by_rows(rows: DataFrame, races: DataFrame, s: Scales, tails: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round of runners that are too wide for blocks: their levels, their rows with what is expected now, and sums by group and by race."""
    off = F.col("y") - F.col("cost")
    miss = (off - F.col("f")) * (off - F.col("f")) + F.col("vf") + F.col("var_cost")
    weight = F.coalesce((tails + 1) / (tails + miss / F.lit(s.noise)), F.lit(1.0))
    seen = rows.join(races.select("race_id", "race", "cost", "var_cost"), "race_id").withColumns({"w": weight, "r": off})
    x, w, r = (F.col(c) for c in ("x", "w", "r"))
    sums = seen.groupBy("runner_id", "year").agg(F.min("grp").alias("grp"), F.sum("w").alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.sum(w * r).alias("wr"), F.sum(w * x * r).alias("wxr"))
    seasons = sums.groupBy("runner_id").agg(F.min("grp").alias("grp"), F.array_sort(F.collect_list(F.struct("year", "w", "wx", "wxx", "wr", "wxr"))).alias("a"))
    seasons = seasons.select("runner_id", "grp", F.col("a.year").alias("years"), *[F.col(f"a.{c}").alias(c) for c in ("w", "wx", "wxx", "wr", "wxr")])
    levels = save(seasons.mapInArrow(partial(_levels, scales=s), _LEVELS), "levels")
    first = lambda c: F.sum(F.when(F.col("first"), c).otherwise(0.0))
    stats = levels.groupBy("grp").agg(
        F.count(F.when(F.col("first"), 1)).alias("n"), first(F.col("level")).alias("m"), first(F.col("level") * F.col("level") + F.col("var_level")).alias("mm"), first(F.col("fade") * F.col("fade") + F.col("var_fade")).alias("bb"),
        F.sum("gap").alias("gaps"), F.sum("step").alias("steps"), F.count(F.when(F.col("gap") > 0, 1)).alias("k"), F.sum(F.when(F.col("gap") > 0, F.col("step_square") / F.col("gap")).otherwise(0.0)).alias("ss"),
    )
    own = levels.select("runner_id", "year", "level", "fade", "var_level", "cov", "var_fade")
    f = F.col("level") + F.col("fade") * x
    vf = F.col("var_level") + 2 * x * F.col("cov") + x * x * F.col("var_fade")
    fresh = save(rows.drop("f", "vf").join(own, ["runner_id", "year"]).select("runner_id", "grp", "race_id", "course_id", "year", "x", "y", f.alias("f"), vf.alias("vf")), "wide")
    left = F.col("y") - F.col("f")
    miss = (left - F.col("cost")) * (left - F.col("cost")) + F.col("vf") + F.col("var_cost")
    weighed = fresh.join(races.select("race_id", "race", "cost", "var_cost"), "race_id").withColumn("w", (tails + 1) / (tails + miss / F.lit(s.noise)))
    told = weighed.groupBy("race").agg(F.sum("w").alias("w"), F.sum(F.col("w") * left).alias("wl"), F.sum(F.col("w") * miss).alias("wm"), F.count("*").alias("n"))
    return levels, fresh, stats, told


def fit(rows: DataFrame, rounds: int = ROUNDS, tails: float = TAILS, scales: Scales | None = None) -> Fit:
    """Fits rows (runner_id, grp, race_id, course_id, year, x, y).

    ``grp`` is one a runner (the first by name counts), ``year`` and ``course_id`` one a race. Rows with a null
    in any of these but ``grp`` are left out; a null group is a group of its own. Repeated rows count as often as they are there. No rows give an
    empty fit. ``moved`` is how far the noise's standard deviation moved in each round, relatively.
    """
    s = scales or Scales()
    rows = rows.select(F.col("runner_id").cast("long").alias("runner_id"), F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), F.col("race_id").cast("string").alias("race_id"), F.col("course_id").cast("string").alias("course_id"), F.col("year").cast("int").alias("year"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    rows = save(rows, "rows")
    races = rows.groupBy("race_id").agg(F.min("course_id").alias("course_id"), F.min("year").alias("year"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("var_cost"))
    races = save(races.withColumn("race", F.monotonically_increasing_id()), "races")
    courses = save(races.groupBy("course_id").agg(F.lit(0.0).alias("course"), F.lit(0.0).alias("var_course")), "courses")
    years = sorted(r.year for r in races.select("year").distinct().collect())  # a row a year
    s.years = {y: 0.0 for y in years}
    start = {r.grp: r.m for r in rows.groupBy("grp").agg(F.avg("y").alias("m")).collect()}  # a row a group
    s.groups = {g: s.groups.get(g, (m, 0.0)) for g, m in start.items()}
    moved: list[float] = []
    # Runners of few rows in blocks, the others row by row.
    often = save(rows.groupBy("runner_id").count().where(F.col("count") > WIDE).select("runner_id"), "often")
    wide, levels = None, None
    if not often.isEmpty():
        wide = save(rows.join(F.broadcast(often), "runner_id").withColumns({"f": F.lit(None).cast("double"), "vf": F.lit(0.0)}), "wide")
    few = rows.join(F.broadcast(often), "runner_id", "left_anti") if wide is not None else rows
    few = few.join(races.select("race_id", "race"), "race_id").select("runner_id", "grp", "race", "year", "x", "y").repartition("runner_id").sortWithinPartitions("runner_id", "year")
    blocks = save(few.mapInArrow(partial(_packed, size=BLOCK), _PACKED).withColumns({"state": F.lit(None).cast("binary")}), "blocks")
    sent = (blocks.agg(F.sum(F.size("races"))).first()[0] or 0) * 24
    drop(rows)
    drop(often)
    for _ in range(rounds if years else 0):
        # Runners, given the races, and what their rows then say of races.
        asked = blocks.select("block", F.posexplode("races").alias("at", "race")).join(races.select("race", "cost", "var_cost"), "race")
        costs = asked.groupBy("block").agg(F.collect_list(F.struct("at", "cost", "var_cost")).alias("costs"))
        joined = blocks.drop("told", "stats").join(F.broadcast(costs) if sent <= SENT else costs, "block")
        fresh = save(joined.mapInArrow(partial(_rounds, scales=s, tails=tails), _UPDATED), "blocks")
        drop(blocks)
        blocks = fresh
        stats = blocks.select(F.explode("stats").alias("g")).select("g.*")
        told = blocks.select(F.explode("told").alias("r")).select("r.*")
        if wide is not None:
            after, fresh, more, also = _by_rows(wide, races, s, tails)
            for old in (levels, wide):
                if old is not None:
                    drop(old)
            levels, wide, stats, told = after, fresh, stats.unionByName(more), told.unionByName(also)
        stats = stats.groupBy("grp").agg(*[F.sum(c.split()[0]).alias(c.split()[0]) for c in _GROUP.split(", ")[1:]]).collect()  # a row a group
        by_race = told.groupBy("race").agg(*[F.sum(c).alias(c) for c in ("w", "wl", "wm", "n")])
        # Races: shrunk means around courses and years.
        around = F.col("course") + F.coalesce(*[F.when(F.col("year") == y, F.lit(v)) for y, v in s.years.items()], F.lit(0.0))
        precision = F.col("w") / F.lit(s.noise) + F.lit(1 / s.race)
        placed = races.select("race", "race_id", "course_id", "year").join(by_race, "race").join(courses.drop("var_course"), "course_id")
        placed = placed.select("race", "race_id", "course_id", "year", ((F.col("wl") / F.lit(s.noise) + around / F.lit(s.race)) / precision).alias("cost"), (1 / precision).alias("var_cost"), "wm", "n")
        fresh = save(placed, "races")
        drop(races)
        races = fresh
        shift = F.coalesce(*[F.when(F.col("year") == y, F.lit(v)) for y, v in s.years.items()], F.lit(0.0))
        pull = F.count("*") / F.lit(s.race) + F.lit(1 / s.course)
        fresh = save(races.groupBy("course_id").agg((F.sum(F.col("cost") - shift) / F.lit(s.race) / pull).alias("course"), (1 / pull).alias("var_course")), "courses")
        drop(courses)
        centre = fresh.agg(F.avg("course")).first()[0] or 0.0
        courses = save(fresh.withColumn("course", F.col("course") - F.lit(centre)), "courses")
        drop(fresh)
        with_course = races.join(courses, "course_id")
        by_year = {r.year: (r.n / s.race, r.m / s.race) for r in with_course.groupBy("year").agg(F.count("*").alias("n"), F.sum(F.col("cost") - F.col("course")).alias("m")).collect()}
        mean, cov = _walk(by_year, s.year, years)
        s.years = dict(zip(years, mean.tolist(), strict=True))
        # Scales, as expected under all of these.
        spread = F.coalesce(*[F.when(F.col("year") == y, F.lit(v)) for y, v in zip(years, np.diag(cov).tolist(), strict=True)], F.lit(0.0))
        around = F.col("course") + F.coalesce(*[F.when(F.col("year") == y, F.lit(v)) for y, v in s.years.items()], F.lit(0.0))
        gone = (F.col("cost") - around) * (F.col("cost") - around) + F.col("var_cost") + F.col("var_course") + spread
        row = with_course.agg(F.sum("wm").alias("wm"), F.sum("n").alias("n"), F.avg(gone).alias("race")).first()
        runners, steps = sum(g.n for g in stats), sum(g.k for g in stats)
        s.groups = {g.grp: (g.m / g.n, g.steps / g.gaps if g.gaps else 0.0) for g in stats}
        noise, s.noise = s.noise, row.wm / row.n
        s.level = sum(g.mm - g.m * g.m / g.n for g in stats) / runners
        s.fade = max(sum(g.bb for g in stats) / runners, 1e-10)
        s.walk = max(sum(g.ss for g in stats) / steps, 1e-10) if steps else s.walk
        s.race = max(row.race, 1e-10)
        s.course = max(courses.agg(F.avg(F.col("course") * F.col("course") + F.col("var_course"))).first()[0], 1e-10)
        if len(years) > 1:
            jumps = [((mean[a + 1] - mean[a]) ** 2 + cov[a, a] + cov[a + 1, a + 1] - 2 * cov[a, a + 1]) / (years[a + 1] - years[a]) for a in range(len(years) - 1)]
            s.year = max(float(np.mean(jumps)), 1e-10)
        moved.append(abs(s.noise / noise - 1) / 2)
    if not moved:
        return Fit(blocks.sparkSession.createDataFrame([], _KEPT), races, courses, s, moved)
    found = blocks.mapInArrow(_unpacked, _KEPT)
    if wide is not None:
        drop(wide)
        found = found.unionByName(levels.select(found.columns))
    return Fit(found, races, courses, s, moved)


def predict(found: Fit, asked: DataFrame, tails: float = TAILS) -> DataFrame:
    """``id, mean, sd`` of y for every row of ``asked`` (id, runner_id, grp, course_id, year, x).

    A known runner walks on from the last season before that year's with the group's drift, wider with every year; one that
    the fit hasn't seen is drawn from their group, or from all groups if it is new or null; a new course is drawn from
    all courses. Years after the last fitted one walk on from it.
    """
    s = found.scales
    last = found.levels.where("last").select("runner_id", F.col("grp").alias("own"), F.col("year").alias("seen"), "level", "fade", "var_level", "cov", "var_fade")
    rows = asked.select("id", F.col("runner_id").cast("long").alias("runner_id"), F.coalesce(F.col("grp").cast("string"), F.lit("")).alias("grp"), F.col("course_id").cast("string").alias("course_id"), F.col("year").cast("int").alias("year"), F.col("x").cast("double").alias("x"))
    rows = rows.join(last, "runner_id", "left").join(found.courses, "course_id", "left")
    group = F.coalesce("own", "grp")
    lookup = lambda j, default: F.coalesce(*[F.when(group == g, F.lit(v[j])) for g, v in s.groups.items()], F.lit(default))
    overall = float(np.mean([v[0] for v in s.groups.values()])) if s.groups else 0.0
    x, gap = F.col("x"), F.greatest(F.col("year") - F.col("seen"), F.lit(0))
    own = F.coalesce(F.col("level") + F.col("fade") * x + lookup(1, 0.0) * gap, lookup(0, overall))
    var = F.coalesce(F.col("var_level") + 2 * x * F.col("cov") + x * x * F.col("var_fade") + F.lit(s.walk) * gap, F.lit(s.level) + x * x * F.lit(s.fade))
    years = sorted(s.years)
    latest = F.coalesce(*[F.when(F.col("year") == y, F.lit(s.years[y])) for y in years], F.lit(s.years[years[-1]] if years else 0.0))
    beyond = F.greatest(F.col("year") - F.lit(years[-1] if years else 0), F.lit(0))
    mean = own + F.coalesce("course", F.lit(0.0)) + latest
    var = var + F.coalesce("var_course", F.lit(s.course)) + F.lit(s.race) + F.lit(s.year) * beyond + F.lit(s.noise * tails / (tails - 2))
    return rows.select("id", mean.alias("mean"), F.sqrt(var).alias("sd"))
