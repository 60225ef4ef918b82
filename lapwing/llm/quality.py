"""Quality classification by co-training.

Two classifiers look at a document from two sides: one at the text's content
(hashed words and the shapes of words, as shares), one at the page's metadata
alone (source, language, recorded length). Both are logistic regressions trained
in numpy on a bounded sample of the labelled documents. Over ``ROUNDS`` rounds
each gives the other the labels of those documents without a label of the sample
that it is surest of, among all of them, as many of each class as the labels have
in proportion. Then both views are calibrated on labelled documents that were
kept apart, and the sum of their log odds over those of the labels scores every
document.

Texts become features once, in a table; each round reads it, keeps the surest of
each task, and takes the surest of these.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.storage import drop, save
from lapwing.llm.words import mix, not_space, slices, utf8, words

#: Labelled documents sampled at most; hashed columns of the text.
LABELLED, HASHED = 4000, 2048
ROUNDS, ADDED, STEPS, SEED = 5, 100, 300, 11
#: Documents under this probability of good quality are not kept.
KEPT = 0.5

_SHAPES = 12
_SOURCES, _LANGS, _SIZES = 64, 16, 32
_META = _SOURCES + _LANGS + _SIZES + 1
_COLUMNS = "doc_id long, content long, source string, lang string, n_chars double, at binary, value binary"


def text_features(column: pa.Array) -> np.ndarray:
    """Shares of hashed words, and of words by shape: repeated, of capitals, with marks at the end, of one sign, by length."""
    data, bounds = utf8(column)
    hashes, a, b, first = words(data, bounds, not_space())
    n = len(column)
    counts = np.maximum(np.diff(first), 1)[:, None]
    text = np.repeat(np.arange(n), np.diff(first))
    out = np.zeros((n, HASHED + _SHAPES))
    np.add.at(out, (text, (hashes % np.uint64(HASHED)).astype(np.int64)), 1)
    out[:, :HASHED] = np.sqrt(out[:, :HASHED] / counts)
    if len(hashes):
        ends, begins, second = data[b - 1], data[a], data[np.minimum(a + 1, len(data) - 1)]
        repeated = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])])
        capital = (begins >= 65) & (begins <= 90) & (second >= 65) & (second <= 90) & (b - a > 1)
        sign = ((ends < 48) | ((ends > 57) & (ends < 65)) | ((ends > 90) & (ends < 97)) | ((ends > 122) & (ends < 128)))
        plain = (ends == 44) | (ends == 46)
        shapes = [repeated, capital, sign & ~plain, plain, sign & (b - a == 1), (begins >= 48) & (begins <= 57), b - a > 15, b - a < 3]
        for k, shape in enumerate(shapes):
            out[:, HASHED + k] = np.bincount(text, shape, n) / counts[:, 0]
        pairs = mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct = np.bincount(text[np.unique(pairs, return_index=True)[1]], minlength=n)
        out[:, HASHED + 8] = distinct / counts[:, 0]
    out[:, HASHED + 9] = np.log1p(np.diff(first)) / 10
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and the recorded length: by powers of 2, and its logarithm. A null is a value of its own."""
    out = np.zeros((len(source), _META), np.float32)
    for i, (s, k, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, zlib.crc32(str(s).encode()) % _SOURCES] = 1
        out[i, _SOURCES + zlib.crc32(str(k).encode()) % _LANGS] = 1
        size = np.log2(1 + max(n, 0)) if n is not None and np.isfinite(n) else 0.0
        out[i, _SOURCES + _LANGS + (_SIZES - 1 if n is None else min(int(size), _SIZES - 2))] = 1
        out[i, -1] = size / 20
    return out


class Logistic:
    """Logistic regression by Adam over all rows, its inputs scaled by their spread; in single precision, as the inputs are."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        one = np.float32
        self.mean, self.spread = x.mean(axis=0, dtype=float).astype(one), x.std(axis=0) + one(0.02)
        x = x - self.mean
        x /= self.spread
        y, weight = y.astype(one), (weight / weight.sum()).astype(one)
        at, m, v = (np.zeros(x.shape[1] + 1, one) for _ in range(3))
        for step in range(1, STEPS + 1):
            d = (1 / (1 + np.exp(-np.clip(x @ at[:-1] + at[-1], -30, 30))) - y) * weight
            g = np.append(x.T @ d + one(0.002) * at[:-1], d.sum())
            m, v = one(0.9) * m + one(0.1) * g, one(0.99) * v + one(0.01) * g * g
            at = at - one(0.03) * (m / one(1 - 0.9**step)) / (np.sqrt(v / one(1 - 0.99**step)) + one(1e-8))
        self.w, self.b = at[:-1], at[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.spread) @ self.w + self.b, -30, 30)


def calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds that fit held-out labels best, drawn towards 1 and 0, by short steps of Newton's."""
    x, at = np.stack([odds, np.ones(len(odds))], axis=1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        g = x.T @ (p - y) + (at - (1.0, 0.0))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        at = at - np.clip(np.linalg.solve(h, g), -0.25, 0.25)
    return max(float(at[0]), 0.01), float(at[1])


class CoTrained:
    """Both views' classifiers, trained on what they were given so far, and their calibrations."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.whole, self.y, self.apart = (text, meta), y, np.arange(len(y)) % 4 == 0
        self.own = [(v[~self.apart], y[~self.apart], np.ones((~self.apart).sum())) for v in self.whole]
        self.share = float(np.clip(y.mean(), 0.02, 0.98))
        self.fit()

    def fit(self) -> None:
        self.views = [self._fit(*x) for x in self.own]

    def give(self, view: int, x: np.ndarray, labels: np.ndarray) -> None:
        """Pseudo-labels, which count half."""
        a, t, w = self.own[view]
        self.own[view] = np.concatenate([a, x]), np.concatenate([t, labels]), np.concatenate([w, np.full(len(x), 0.5)])

    def finish(self) -> None:
        self.calibrations = [calibrate(m.odds(v[self.apart]), self.y[self.apart]) for m, v in zip(self.views, self.whole, strict=True)]
        p = (self.y[self.apart].sum() + 1) / (self.apart.sum() + 2)
        self.prior = float(np.log(p / (1 - p)))
        del self.whole, self.own

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Logistic:
        weight = w * np.where(y > 0, 0.5 / max(w[y > 0].sum(), 1e-9), 0.5 / max(w[y == 0].sum(), 1e-9))
        return Logistic(x, y, weight)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by text, by metadata, by both."""
        odds = [a * m.odds(x) + b for m, x, (a, b) in zip(self.views, (text, meta), self.calibrations, strict=True)]
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p(odds[0]), p(odds[1]), p(odds[0] + odds[1] - self.prior)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places and values of the text's features that are not 0, as bytes."""
    for rows in slices(batches, "text"):
        for k in range(0, rows.num_rows, 500):
            part = rows.slice(k, 500)
            text = text_features(part.column("text")).astype(np.float16)
            at = [np.flatnonzero(x) for x in text]
            found = ([i.astype(np.uint16).tobytes() for i in at], [x[i].tobytes() for x, i in zip(text, at, strict=True)])
            names = ["doc_id", "content", "source", "lang", "n_chars"]
            yield pa.RecordBatch.from_arrays([*map(part.column, names), *(pa.array(x, pa.binary()) for x in found)], names=[*names, "at", "value"])


def _both(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features of both views."""
    text = np.zeros((rows.num_rows, HASHED + _SHAPES), np.float32)
    for x, at, value in zip(text, rows.column("at").to_pylist(), rows.column("value").to_pylist(), strict=True):
        x[np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float16)
    return text, meta_features(*(rows.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _score(batches: Iterator[pa.RecordBatch], model: CoTrained | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            found = (np.full(part.num_rows, 0.5),) * 3 if model is None else model.scores(*_both(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(float)) for x in found)], names=["doc_id", "text_score", "meta_score", "score"])


def _surest(batches: Iterator[pa.RecordBatch], views: list[Logistic], counts: tuple[int, int], known: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of a task's documents, the ``counts`` good and bad ones that each view is surest of, one of each content, with the view and its log odds."""
    held: dict[tuple[int, int], pa.Table] = {}
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            content = part.column("content").to_numpy(zero_copy_only=False)
            for view, x in enumerate(_both(part)):
                odds = views[view].odds(x).astype(float)
                for good in (0, 1):
                    at = np.flatnonzero((odds > 1 if good else odds < -1) & ~np.isin(content, known[1 - view]))
                    if not len(at):
                        continue
                    new = pa.Table.from_batches([part.take(pa.array(at))]).append_column("view", pa.array(np.full(len(at), view, np.int32))).append_column("odds", pa.array(odds[at]))
                    new = pa.concat_tables([held[view, good], new]) if (view, good) in held else new
                    new = new.sort_by([("odds", "descending" if good else "ascending"), ("content", "ascending"), ("doc_id", "ascending")])
                    first = np.sort(np.unique(new.column("content").to_numpy(), return_index=True)[1])[: counts[1 - good]]
                    held[view, good] = new.take(pa.array(first))
    for table in held.values():
        yield from table.to_batches()


def features(docs: DataFrame) -> DataFrame:
    """A table of both views' features of every row of ``docs`` (doc_id, text, source, lang, n_chars); equal texts, sources, languages and lengths have equal ``content``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")], F.col("n_chars").cast("double").alias("n_chars"))
    rows = rows.select("doc_id", F.xxhash64("text", "source", "lang", "n_chars").alias("content"), "source", "lang", "n_chars", "text")
    return save(rows.mapInArrow(_featured, _COLUMNS), "features")


def train(table: DataFrame, labels: DataFrame) -> CoTrained | None:
    """From ``features`` and ``labels`` (doc_id, quality). None if there are not labels of both kinds.

    ``LABELLED`` distinct labelled documents at most are learned from, the first
    by a hash of doc_id; of contradicting labels the lower one counts. Each round
    looks at all other documents and brings ``2 * ADDED`` at most to the driver.
    """
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    keys = table.where("doc_id is not null").select("doc_id", "content").join(labels, "doc_id").groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.min("quality").alias("quality"))
    keys = keys.orderBy(F.xxhash64("doc_id"), "doc_id", "content").limit(LABELLED)
    rows = table.join(F.broadcast(keys), ["doc_id", "content"]).dropDuplicates(["doc_id", "content"])  # LABELLED rows at most
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "content").toArrow()
    y = rows.column("quality").to_numpy().astype(float)
    if len(np.unique(y)) < 2 or len(np.unique(y[np.arange(len(y)) % 4 > 0])) < 2:
        return None
    model = CoTrained(*_both(rows), y)
    known = [rows.column("content").to_numpy()] * 2
    counts = (round(ADDED * model.share), round(ADDED * (1 - model.share)))
    for _ in range(ROUNDS):
        found = save(table.mapInArrow(partial(_surest, views=model.views, counts=counts, known=known), _COLUMNS + ", view int, odds double"), "surest")
        for view in (0, 1):
            for good in (0, 1):
                own = found.where((F.col("view") == view) & ((F.col("odds") > 0) == bool(good))).dropDuplicates(["content"])
                own = own.orderBy(F.desc("odds") if good else F.asc("odds"), "content").limit(counts[1 - good]).toArrow()
                if own.num_rows:
                    model.give(1 - view, _both(own)[1 - view], np.full(own.num_rows, float(good)))
                    known[1 - view] = np.concatenate([known[1 - view], own.column("content").to_numpy()])
        drop(found)
        model.fit()
    model.finish()
    return model


def classify(table: DataFrame, model: CoTrained | None) -> DataFrame:
    """``doc_id, text_score, meta_score, score, keep`` for every row of ``features``.

    Null is an empty text, and a source, language or length of its own; all of a
    long text counts. Without labels of both kinds all scores are 0.5. Rows repeat
    as they do, an empty table gives an empty one; other columns are not looked at.
    """
    found = table.mapInArrow(partial(_score, model=model), "doc_id long, text_score double, meta_score double, score double")
    return found.withColumn("keep", F.col("score") >= KEPT)


def op2_cotrained_quality(spark, sf_dir: str) -> DataFrame:
    table = features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classify(table, train(table, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))


QUERIES: dict[str, Callable] = {"op2_cotrained_quality": op2_cotrained_quality}
