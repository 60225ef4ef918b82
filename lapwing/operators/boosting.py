"""Boosted trees for quantiles, grown from counts over bins, with a fit for each block of dates.

Every block has one model a quantile, fitted on the rows of strictly earlier
blocks, and all models grow together: a level of all their trees is one pass over the
rows. A task counts, for each node, input and bin, its rows and how many of them lie
below what has been predicted; of the pinball loss nothing else is needed to choose a
split. Counts are summed by a shuffle; they come to the driver, which chooses the best split of each node.
The value of a leaf is the quantile of its residuals, found by windows over counts in cells. So sums are of whole numbers and don't depend on
the order of rows, and what is shuffled doesn't grow with the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.sources.shared import save

QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
#: Bins of an input, the first being for null; rows of a leaf and of a fit at least; what is added to counts in gains.
BINS, LEAST_LEAF, LEAST_FIT, RIDGE = 32, 20, 1000, 1.0
#: Residuals are told apart in so many cells between minus and plus the span.
CELLS, SPAN = 2048, 1.0
#: Trees are applied to the saved rows, and forgotten by the passes, after so many rounds.
KEEP = 4

_ROWS = "id long, block int, y double, bins binary, base binary"


@dataclass
class Forest:
    """Trees of all models, ``[round, model, node]``: input (-1: no split, all go left), last bin of the left, whether null goes left; and leaves ``[round, model, leaf]``."""

    blocks: list[int]
    quantiles: tuple[float, ...]
    depth: int
    splits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    first: int = 0

    @property
    def models(self) -> int:
        return len(self.blocks) * len(self.quantiles)

    def of(self, block: int) -> range:
        """The models of a block."""
        k = self.blocks.index(block) * len(self.quantiles)
        return range(k, k + len(self.quantiles))


def descend(split: np.ndarray, bins: np.ndarray, depth: int, at: int = 0) -> np.ndarray:
    """The node, ``depth`` levels below split ``at``, of each row in one tree, counted from the left.

    Each split looks at one column of ``bins``, which is quick if columns lie together (Fortran's order).
    """
    if not depth:
        return np.zeros(len(bins), np.uint8)
    left = descend(split, bins, depth - 1, 2 * at + 1) if depth > 1 else None
    column, cut, null_left = split[at]
    if column < 0:
        return np.zeros(len(bins), np.uint8) if left is None else left
    value = bins[:, column]
    beyond = value > cut
    if not null_left:
        beyond |= value == 0
    right = beyond.view(np.uint8)
    if depth == 1:
        return right
    # Products instead of a choice, which would be guessed wrong for half of the rows.
    ahead = descend(split, bins, depth - 1, 2 * at + 2) + np.array(1 << (depth - 1), np.uint8 if depth <= 8 else np.int64)
    return left + right * (ahead - left)


def predictions(forest: Forest, model: int, bins: np.ndarray, base: np.ndarray) -> np.ndarray:
    """What a model says so far."""
    out = base.copy()
    for split, leaf in zip(forest.splits[forest.first :], forest.leaves[forest.first :], strict=True):
        out += leaf[model][descend(split[model], bins, forest.depth)]
    return out


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a column whose values all have ``width`` of them, null being zeros; without a copy if none is null."""
    if column.null_count == len(column):
        return np.zeros(width * len(column), np.uint8)
    if column.null_count or column.type != pa.binary():
        return np.frombuffer(b"".join(x or bytes(width) for x in column.to_pylist()), np.uint8)
    _, offsets, values = column.buffers()
    start = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(values, np.uint8)[start : start + width * len(column)]


def _arrays(batch: pa.RecordBatch, inputs: int, models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    block, y = batch.column("block").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
    bins = _fixed(batch.column("bins"), inputs).reshape(-1, inputs)
    base = _fixed(batch.column("base"), 8 * models).view(float).reshape(-1, models)
    return block, y, bins, base


def _counts(batches: Iterator[pa.RecordBatch], forest: Forest, inputs: int, split: np.ndarray, level: int, leaves: bool) -> Iterator[pa.RecordBatch]:
    """A task's counts for a level: by (model, node, input, bin) rows and rows below the prediction; or, for ``leaves``, by (model, node, cell of the residual)."""
    nodes = 1 << level
    width = CELLS if leaves else inputs * BINS
    size = forest.models * nodes * width
    rows, below = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        block, y, bins, base = _arrays(batch, inputs, forest.models)
        # In order of blocks, so that the rows before a block are the first ones.
        order = np.argsort(block, kind="stable")
        order = order[~np.isnan(y[order])]
        block, y, bins, base = block[order], y[order], np.asfortranarray(bins[order]), np.take(base.T, order, axis=1)
        columns = None if leaves else np.ascontiguousarray(bins.T) + np.arange(inputs)[:, None] * BINS
        for b in forest.blocks:
            until = int(np.searchsorted(block, b, "left"))
            if not until:
                continue
            own = bins[:until]
            for m in forest.of(b):
                residual = y[:until] - predictions(forest, m, own, base[m, :until])
                node = descend(split[m], own, level).astype(np.int64)
                lo, hi = m * nodes * width, (m + 1) * nodes * width
                if leaves:
                    cell = np.clip(np.floor((residual + SPAN) * (CELLS / (2 * SPAN))), 0, CELLS - 1).astype(np.int64)
                    rows[lo:hi] += np.bincount(node * width + cell, minlength=hi - lo)
                    continue
                # Rows above and below the prediction are counted at once, as nodes of their own.
                state = (2 * node + (residual < 0)) * width
                found = np.bincount((columns[:, :until] + state).ravel(), minlength=2 * (hi - lo)).reshape(nodes, 2, width)
                rows[lo:hi] += found.sum(axis=1).ravel()
                below[lo:hi] += found[:, 1].ravel()
    at = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows[at]), pa.array(below[at])], names=["key", "n", "below"])


def edges(rows: DataFrame, inputs: list[str], bins: int = BINS) -> np.ndarray:
    """Bounds between the bins of each input, ``[input, bound]``: quantiles of its distinct places, from mergeable sketches."""
    shares = [(k + 1) / (bins - 1) for k in range(bins - 2)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*map(F.lit, shares)), F.lit(10_000)).alias(c) for c in inputs]).first()
    return np.array([found[c] if found[c] is not None else [0.0] * len(shares) for c in inputs])


def _binned(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((batch.num_rows, len(bounds)), np.uint8)
        for k, own in enumerate(bounds):
            x = batch.column(3 + k).to_numpy(zero_copy_only=False).astype(float)
            out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(own, x, "left"))
        packed = pa.array([r.tobytes() for r in out], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), packed, pa.nulls(batch.num_rows, pa.binary())], names=["id", "block", "y", "bins", "base"])


def _best_splits(sums: DataFrame, forest: Forest, inputs: int, level: int, least: int, ridge: float) -> np.ndarray:
    """The best split of each node, ``[model, node, (input, last bin, null left)]``; of equal ones the first. Counts come to the driver: a number a node, input and bin, whatever the number of rows."""
    nodes = 1 << level
    told = sums.toArrow()
    n, below = np.zeros((2, forest.models * nodes * inputs * BINS))
    for out, name in ((n, "n"), (below, "below")):
        out[told.column("key").to_numpy()] = told.column(name).to_numpy()
    n, below = n.reshape(-1, inputs, BINS), below.reshape(-1, inputs, BINS)
    alpha = np.tile(np.repeat(np.array(forest.quantiles), nodes), len(forest.blocks))[:, None, None, None]

    def score(n: np.ndarray, below: np.ndarray) -> np.ndarray:
        g = (1 - alpha) * below - alpha * (n - below)
        return g * g / (n + ridge)

    sides = np.array([0, 1])
    left, left_below = (np.cumsum(x[:, :, 1:], axis=2)[..., None] + x[:, :, :1, None] * sides for x in (n, below))
    every, every_below = (x.sum(axis=2)[:, :, None, None] for x in (n, below))
    gain = score(left, left_below) + score(every - left, every_below - left_below) - score(every, every_below)
    good = (n[:, :, 1:, None] > 0) & (left >= least) & (every - left >= least) & (gain > 1e-9)
    gain = np.where(good, gain, -1).reshape(len(n), -1)
    best = gain.argmax(axis=1)
    out = np.stack([best // (2 * (BINS - 1)), best // 2 % (BINS - 1) + 1, best % 2], axis=1)
    out[gain.max(axis=1) < 0] = (-1, 0, 0)
    return out.reshape(forest.models, nodes, 3)


def _leaf_values(sums: DataFrame, forest: Forest, leaves: int) -> np.ndarray:
    """The quantile of the residuals of each leaf, ``[model, leaf]``: the middle of the first cell up to which the quantile's share of rows lies."""
    rows = sums.select(F.floor(F.col("key") / CELLS).alias("leaf"), (F.col("key") % CELLS).alias("cell"), "n")
    alpha = F.element_at(F.array(*[F.lit(q) for q in forest.quantiles]), (F.floor(F.col("leaf") / leaves) % len(forest.quantiles) + 1).cast("int"))
    whole = Window.partitionBy("leaf")
    rows = rows.withColumns({"all": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("cell"))}).where(F.col("upto") >= alpha * F.col("all"))
    out = np.zeros((forest.models, leaves))
    for r in rows.groupBy("leaf").agg(F.min("cell").alias("cell")).collect():  # a row a leaf
        out[divmod(r.leaf, leaves)] = (r.cell + 0.5) * (2 * SPAN / CELLS) - SPAN
    return out


def _applied(batches: Iterator[pa.RecordBatch], forest: Forest, inputs: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *_, bins, base = _arrays(batch, inputs, forest.models)
        bins = np.asfortranarray(bins)
        now = np.stack([predictions(forest, m, bins, base[:, m]) for m in range(forest.models)], axis=1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "block", "y", "bins")), pa.array([r.tobytes() for r in now], pa.binary())], names=["id", "block", "y", "bins", "base"])


def grow(binned: DataFrame, forest: Forest, inputs: int, rounds: int, rate: float, least: int = LEAST_LEAF, ridge: float = RIDGE) -> DataFrame:
    """Adds ``rounds`` trees a model to the forest, after a constant; returns the rows with what trees up to ``forest.first`` say in ``base``."""
    for r in range(rounds + 1):
        depth = forest.depth if r else 0
        split = np.zeros((forest.models, (1 << forest.depth) - 1, 3), np.int64)
        split[:, :, 0] = -1
        for level in range(depth + 1):
            last = level == depth
            counted = binned.mapInArrow(partial(_counts, forest=forest, inputs=inputs, split=split, level=forest.depth if last else level, leaves=last), "key long, n long, below long")
            sums = counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
            if last:
                value = _leaf_values(sums, forest, 1 << forest.depth)
            else:
                split[:, (1 << level) - 1 : (2 << level) - 1] = _best_splits(sums, forest, inputs, level, least, ridge)
        forest.splits.append(split)
        forest.leaves.append(value * (rate if r else 1.0))
        if len(forest.splits) - forest.first >= KEEP:
            binned = save(binned.mapInArrow(partial(_applied, forest=forest, inputs=inputs), _ROWS), "boosted")
            forest.first = len(forest.splits)
    return binned


def _predicted(batches: Iterator[pa.RecordBatch], forest: Forest, inputs: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        block, _, bins, base = _arrays(batch, inputs, forest.models)
        out = np.full((batch.num_rows, len(forest.quantiles)), np.nan)
        for b in forest.blocks:
            own = block == b
            for k, m in enumerate(forest.of(b)):
                out[own, k] = predictions(forest, m, np.asfortranarray(bins[own]), base[own, m])
        out.sort(axis=1)
        columns = [pa.array(out[:, k], mask=np.isnan(out[:, k])) for k in range(out.shape[1])]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *(f"q{k}" for k in range(len(columns)))])


def boosted_quantiles(rows: DataFrame, inputs: list[str], quantiles: tuple[float, ...] = QUANTILES, rounds: int = 40, depth: int = 3, rate: float = 0.2, least_fit: int = LEAST_FIT) -> DataFrame:
    """``id, q0, q1 ...`` of every row (id, block, y and the inputs): its quantiles, in order, by the model of its block.

    A block's models see the rows of smaller block numbers that have a ``y``. A block with fewer
    than ``least_fit`` of these has no model: its rows get nulls, as do rows of a null block. Null inputs are a bin of their own,
    which goes to the side that gains more; rows of one id are rows of their own. Bounds of
    bins come from the rows before the first block with a model. Residuals beyond ``SPAN`` count as the last cell.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("block").cast("int").alias("block"), F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in inputs])
    rows = save(rows, "inputs")
    counts = {r.block: r.n for r in rows.where("block is not null").groupBy("block").agg(F.count("y").alias("n")).collect()}  # a row a block
    blocks, before = [], 0
    for b in sorted(counts):
        if before >= least_fit:
            blocks.append(b)
        before += counts[b]
    names = [f"q{k}" for k in range(len(quantiles))]
    none = rows.where(F.col("block").isNull() | ~F.col("block").isin(blocks)).select("id", *[F.lit(None).cast("double").alias(c) for c in names])
    if not blocks:
        return none
    bounds = edges(rows.where(F.col("block") < blocks[0]), inputs)
    binned = save(rows.where("block is not null").mapInArrow(partial(_binned, bounds=bounds), _ROWS), "binned")
    forest = Forest(blocks, tuple(quantiles), depth)
    binned = grow(binned, forest, len(inputs), rounds, rate).where(F.col("block").isin(blocks))
    found = binned.mapInArrow(partial(_predicted, forest=forest, inputs=len(inputs)), "id long, " + ", ".join(f"{c} double" for c in names))
    return found.unionByName(none)
