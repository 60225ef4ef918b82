"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of ``WINDOW`` bytes of UTF-8. Each byte has a vector;
filters of several widths run over the window, the largest answer of each
filter is kept, and a softmax over these gives the window's languages. The
text's are the mean over all of its windows, weighted by their bytes.

Training sees a bounded sample of the labelled rows: ``SAMPLE`` distinct texts of
each language, the first by a hash of their text, and ``SAMPLE_WINDOWS`` windows
of each, evenly spread over all of it. Scoring sees every window of every text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.words import slices, utf8

#: Bytes of a window; texts sampled of each language; windows sampled of each of these texts.
WINDOW, SAMPLE, SAMPLE_WINDOWS = 256, 300, 8
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 12, 6
STEPS, BATCH, RATE, SEED = 500, 64, 0.01, 20
#: Windows scored at once.
AT_ONCE = 512

_LETTER = re.compile(r"[^\W\d_]")


class ByteNetwork:
    """Weights as arrays; ``classes`` are the languages learned."""

    def __init__(self, classes: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.classes = classes
        f = len(WIDTHS) * FILTERS
        self.p = {"bytes": r.normal(0, 0.5, (256, DEPTH)), "out": r.normal(0, 1 / np.sqrt(f), (f, len(classes))), "bias": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = r.normal(0, 1 / np.sqrt(w * DEPTH), (w * DEPTH, FILTERS)), np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, dict]:
        """Probabilities of (windows, classes), and what the gradient needs."""
        x = self.p["bytes"][windows]
        pooled, kept = [], {}
        for w in WIDTHS:
            columns = sliding_window_view(x.reshape(len(x), -1), w * DEPTH, axis=1)[:, ::DEPTH]
            answers = columns.reshape(-1, w * DEPTH) @ self.p[f"w{w}"]
            answers = answers.reshape(len(x), -1, FILTERS)
            at = answers.argmax(axis=1)
            best = np.take_along_axis(answers, at[:, None], axis=1)[:, 0] + self.p[f"b{w}"]
            kept[w] = (at, best > 0)
            pooled.append(np.maximum(best, 0))
        features = np.concatenate(pooled, axis=1)
        return self._softmax(features), {"windows": windows, "x": x, "features": features, "kept": kept}

    def _softmax(self, features: np.ndarray) -> np.ndarray:
        scores = features @ self.p["out"] + self.p["bias"]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.zeros((len(windows), 0), np.float32)
        out = []
        for i in range(0, len(windows), AT_ONCE):
            x = self.p["bytes"][windows[i : i + AT_ONCE]]
            flat, pooled = x.reshape(len(x), -1), []
            for w in WIDTHS:
                columns = sliding_window_view(flat, w * DEPTH, axis=1)[:, ::DEPTH].reshape(-1, w * DEPTH)
                pooled.append(np.maximum((columns @ self.p[f"w{w}"]).reshape(len(x), -1, FILTERS).max(axis=1) + self.p[f"b{w}"], 0))
            out.append(self._softmax(np.concatenate(pooled, axis=1)))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)

    def gradient(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        probabilities, c = self.forward(windows)
        probabilities[np.arange(len(labels)), labels] -= 1
        d = probabilities / len(labels)
        g = {"out": c["features"].T @ d, "bias": d.sum(axis=0), "bytes": np.zeros_like(self.p["bytes"])}
        back = d @ self.p["out"].T
        rows = np.arange(len(windows))[:, None]
        for i, w in enumerate(WIDTHS):
            at, on = c["kept"][w]
            own = back[:, i * FILTERS : (i + 1) * FILTERS] * on
            places = at[:, :, None] + np.arange(w)
            columns = c["x"][rows[:, :, None], places].reshape(len(windows), FILTERS, w * DEPTH)
            g[f"w{w}"], g[f"b{w}"] = np.einsum("nfk,nf->kf", columns, own), own.sum(axis=0)
            spread = (own[:, :, None] * self.p[f"w{w}"].T[None]).reshape(len(windows), FILTERS, w, DEPTH)
            np.add.at(g["bytes"], c["windows"][rows[:, :, None], places], spread)
        return g

    def fit(self, own: list[list[bytes]], seed: int = SEED) -> ByteNetwork:
        """Adam over batches with as many of the windows ``own`` of each language; some are cut short, as short texts are."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        some = [k for k, x in enumerate(own) if x]
        for step in range(1, STEPS + 1):
            labels_now = np.array([some[j % len(some)] for j in range(BATCH)])
            windows = np.zeros((BATCH, WINDOW), np.uint8)
            for j, k in enumerate(labels_now):
                piece = own[k][r.integers(len(own[k]))]
                if r.random() < 0.3:
                    piece = piece[: int(r.integers(8, WINDOW))]
                windows[j, : len(piece)] = np.frombuffer(piece, np.uint8)
            rate = RATE * (1 - 0.9 * step / STEPS)
            for k, g in self.gradient(windows, labels_now).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def as_windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, padded with zeros, the text of each, and its bytes."""
    counts = -(-np.diff(bounds) // WINDOW)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    begin = bounds[text] + (np.arange(len(text)) - first[text]) * WINDOW
    length = np.minimum(WINDOW, bounds[text + 1] - begin)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = sliding_window_view(padded, WINDOW)[begin] if len(begin) else np.zeros((0, WINDOW), np.uint8)
    return np.where(np.arange(WINDOW) < length[:, None], out, 0).astype(np.uint8), text, length


def _predict(batches: Iterator[pa.RecordBatch], network: ByteNetwork, texts: bool = False) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        data, bounds = utf8(rows.column("text"))
        n = rows.num_rows
        total = np.zeros((n, len(network.classes)))
        windows, text, length = as_windows(data, bounds)
        np.add.at(total, text, network.predict(windows) * length[:, None])
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
        letters = [t is not None and bool(network.classes) and bool(_LETTER.search(t)) for t in rows.column("text").to_pylist()]
        best = total.argmax(axis=1) if network.classes else np.zeros(n, int)
        out = [c for c in rows.schema.names if texts or c != "text"]
        yield pa.RecordBatch.from_arrays(
            [
                *[rows.column(c) for c in out],
                pa.array([network.classes[b] if a else "und" for a, b in zip(letters, best, strict=True)]),
                pa.array([min(1.0, float(total[i, b])) if a else 0.0 for i, (a, b) in enumerate(zip(letters, best, strict=True))], pa.float64()),
            ],
            names=[*out, "lang_pred", "score"],
        )


def held_out(doc_id) -> object:
    """Whether crc32 of the doc_id as text leaves 0 when divided by 5; a null doc_id does not."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        found: tuple[list, ...] = ([], [], [], [])
        for lang, k, text in zip(*(rows.column(c).to_pylist() for c in ("lang", "k")), rows.column("text").cast(pa.binary()).to_pylist(), strict=True):
            count = -(-len(text) // WINDOW)
            some = min(count, SAMPLE_WINDOWS)
            for i in range(some):
                at = i * count // some * WINDOW
                for column, value in zip(found, (lang, k, i, text[at : at + WINDOW]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["lang", "k", "i", "piece"])


def train(docs: DataFrame) -> ByteNetwork:
    """From ``doc_id``, ``text`` and ``lang`` of the rows that are not held out, where text and lang are not null.

    Hashes of the texts are ranked, not texts, and of those chosen only the
    windows sampled come to the driver: ``SAMPLE * SAMPLE_WINDOWS`` a language at
    most. Repeated texts of one language count once.
    """
    own = docs.where("text is not null and text <> '' and lang is not null").where(~held_out(F.col("doc_id")))
    own = own.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("hash"))
    keys = own.select("lang", "hash").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("k") <= SAMPLE)
    rows = own.join(F.broadcast(keys), ["lang", "hash"])  # SAMPLE rows a language
    found = rows.select("lang", "k", "text").mapInArrow(_sampled, "lang string, k int, i int, piece binary").dropDuplicates(["lang", "k", "i"]).toArrow()
    found = sorted(zip(*(found.column(c).to_pylist() for c in ("lang", "k", "i", "piece")), strict=True))
    classes = sorted({r[0] for r in found})
    network = ByteNetwork(classes)
    return network.fit([[r[3] for r in found if r[0] == c] for c in classes]) if classes else network


def identify(docs: DataFrame, network: ByteNetwork, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` for every row of ``docs``.

    ``lang_pred`` is a language learned, or ``und`` with a score of 0 if the text
    is null or has no letter (or nothing could be learned). The score is the mean
    probability over the whole text, however long; of languages equally likely
    the first by name is given. Equal texts get equal answers; rows repeat as
    they do, an empty table gives an empty one; columns not named are not looked at.
    """
    rows = docs.select(*[c for c in keep if c != "text"], F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text" or "text" in keep)
    found = rows.mapInArrow(partial(_predict, network=network, texts="text" in keep), f"{schema}, lang_pred string, score double")
    return found.select(*keep, "lang_pred", "score")


def op7_byte_cnn_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable] = {"op7_byte_cnn_langid": op7_byte_cnn_langid}
