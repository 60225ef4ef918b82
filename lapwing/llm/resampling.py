"""Importance resampling towards a target distribution of hashed n-gram features.

Features are runs of one to three words. Their buckets are checksums of the
joined words; as a CRC-32 of two strings follows from those of each, it is
computed for arrays of words at once. Two passes over the texts, both with
bounded memory: the first sums up the buckets of all rows, the second adds up
the gains of each row's features. Between them only counts of buckets meet.

The draw takes the highest scores. Each partition of scored rows is a run, sorted
by score; runs are cut at the same bounds into ranges of scores, counts of ranges
say which rank a range begins with, and the runs of a range are merged by a
tournament tree that stops at the exact number to draw. Ranges beyond it are
not merged. A range holds a bounded number of rows, whatever the number drawn.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.storage import save
from lapwing.llm.words import SLICE, alphanumeric, lower_az, slices, utf8, words

#: Buckets of features; words that a row must have to be drawn; percentage drawn; seed of the draw.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
#: Rows of a range of scores: no fewer as long as there are as many ranges as shuffle partitions, never more.
LEAST_ROWS, MOST_ROWS = 20_000, 1_000_000

_SHORT = 64
_FULL = np.uint32(0xFFFFFFFF)
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
_OUT = "doc_id long, n_features long, weight long, score long, rank long"


@cache
def _steps() -> np.ndarray:
    """What CRC-32 makes of each byte value."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


def _look_up(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The linear map whose four tables, one a byte, are the last two axes of ``tables``."""
    at = [(c >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
    return tables[..., 0, :][at[0]] ^ tables[..., 1, :][at[1]] ^ tables[..., 2, :][at[2]] ^ tables[..., 3, :][at[3]]


@cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of appending 0 to ``_SHORT`` zero bytes, as rows of 1,024 numbers, and those of appending 1, 2, 4 ... zero bytes."""
    now = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    short = [now]
    for _ in range(_SHORT):
        now = _steps()[now & np.uint32(255)] ^ (now >> np.uint32(8))
        short.append(now)
    doubled = [short[1]]
    for _ in range(40):
        doubled.append(_look_up(doubled[-1], doubled[-1]))
    return np.stack(short).reshape(-1), doubled


def _joined(before: np.ndarray, word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of strings and the words after them, from the checksums of both and the words' bytes."""
    short, doubled = _shifts()
    at = np.minimum(length, _SHORT).astype(np.uint32) << np.uint32(10)
    out = word ^ short[at + (before & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= short[at + np.uint32(256 * k) + ((before >> np.uint32(8 * k)) & np.uint32(255))]
    for i in np.flatnonzero(length > _SHORT).tolist():
        c, left = before[i], int(length[i])
        for table in doubled:
            if left & 1:
                c = _look_up(table, c)
            left >>= 1
        out[i] = c ^ word[i]
    return out


def _spaced(c: np.ndarray) -> np.ndarray:
    """Checksums of strings with a space after them."""
    c = c ^ _FULL
    return _steps()[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8)) ^ _FULL


def checksums(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """CRC-32 of the words [a, b) of ``low``."""
    length = b - a
    c = np.full(len(a), _FULL)
    at, j = np.arange(len(a)), 0
    while len(at) and j < _SHORT:
        c[at] = _steps()[(c[at] ^ low[a[at] + j]) & np.uint32(255)] ^ (c[at] >> np.uint32(8))
        j += 1
        at = at[length[at] > j]
    c ^= _FULL
    for i in np.flatnonzero(length > _SHORT).tolist():
        c[i] = zlib.crc32(low[a[i] : b[i]])
    return c


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool, np.ndarray, np.ndarray]]:
    """(rows, whether they begin here, bytes, bounds): whole rows, or pieces of one long row, cut between words."""
    keep = alphanumeric()
    for rows in slices(batches, "text"):
        data, bounds = utf8(rows.column("text"))
        if len(data) <= 2 * SLICE:
            yield rows, True, data, bounds
            continue
        at = 0
        while at < len(data):
            to = min(at + SLICE, len(data))
            while to < len(data) and keep[data[to]]:
                gap = np.flatnonzero(~keep[data[to : to + SLICE]])
                to = min(to + (int(gap[0]) if len(gap) else SLICE), len(data))
            yield rows, at == 0, data[at:to], np.array([0, to - at])
            at = to


def features(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[pa.RecordBatch, bool, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(rows, whether they begin here, first words, [(buckets, their last words)] of runs of 1, 2 and 3 words) for the texts of ``batches``.

    The pieces of a long row follow each other; runs across their bounds count with the later piece.
    """
    lower, keep = lower_az(), alphanumeric()
    tail = np.zeros(0, np.uint8)
    for rows, new, data, bounds in _pieces(batches):
        if not new:
            data, bounds = np.concatenate([tail, data]), np.array([0, len(tail) + len(data)])
        _, a, b, first = words(data, bounds, keep)
        old = 0 if new else len(words(tail, np.array([0, len(tail)]), keep)[1])
        length, one = b - a, checksums(lower[data], a, b)
        place = np.arange(len(a)) - np.repeat(first[:-1], np.diff(first))
        second = np.flatnonzero(place >= 1)
        two = np.zeros_like(one)
        two[second] = _joined(_spaced(one[second - 1]), one[second], length[second])
        third = np.flatnonzero(place >= 2)
        three = _joined(_spaced(two[third - 1]), one[third], length[third])
        runs = [(x[at >= old], at[at >= old]) for x, at in ((one, np.arange(len(a))), (two[second], second), (three, third))]
        starts = first.copy()
        starts[0] = old
        yield rows, new, starts, [((x % np.uint32(buckets)).astype(np.int64), at) for x, at in runs]
        tail = data[a[-2] if len(a) > 1 else a[-1] :] if len(a) else np.zeros(0, np.uint8)


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for *_, runs in features(batches, buckets):
        for x, _ in runs:
            total += np.bincount(x, minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` (text) fall into each bucket: as many numbers as there are buckets."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(_counted, buckets=buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: thousandths of the log ratio of its shares in the target and in all rows, floored."""
    s, t, n = float(own.sum()), float(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + n) / ((float(x) + 1) * (t + n)))) for x, y in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def luck(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel number that the seed and the doc_id alone decide."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(batches: Iterator[pa.RecordBatch], gain: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    held: tuple[pa.RecordBatch, np.ndarray, np.ndarray] | None = None

    def scored() -> pa.RecordBatch:
        rows, n, weight = held
        ids = rows.column("doc_id").to_pylist()
        total = np.maximum(n, 0) + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
        score = weight + np.array([luck(k, seed) for k in ids], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, n, total, weight, score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    for rows, new, first, runs in features(batches, len(gain)):
        each = np.zeros(int(first[-1]) + 1, np.int64)
        for x, at in runs:
            each[at + 1] += gain[x]
        sums = np.cumsum(each)
        n, weight = np.diff(first), sums[first[1:]] - sums[first[:-1]]
        if new:
            if held:
                yield scored()
            held = rows, n, weight
        else:
            held = held[0], held[1] + n, held[2] + weight
    if held:
        yield scored()


def weights(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_weighed, gain=gain, seed=seed), _SCORED)


class Tournament:
    """The least head of several sorted runs, again and again: a tree of winners in which only the winner's path is played anew."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.tree = [-1] * (2 * self.size)
        for i, run in enumerate(runs):
            self.tree[self.size + i] = i if run else -1
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = self._winner(self.tree[2 * node], self.tree[2 * node + 1])

    def _winner(self, i: int, j: int) -> int:
        if i < 0 or j < 0:
            return max(i, j)
        return i if self.runs[i][self.at[i]] <= self.runs[j][self.at[j]] else j

    def pop(self) -> tuple:
        i = self.tree[1]
        head = self.runs[i][self.at[i]]
        self.at[i] += 1
        node = self.size + i
        if self.at[i] == len(self.runs[i]):
            self.tree[node] = -1
        while node > 1:
            node //= 2
            self.tree[node] = self._winner(self.tree[2 * node], self.tree[2 * node + 1])
        return head


def _ranked(rows: pa.Table, start: pa.Table, draw: int) -> pa.Table:
    """The rows of one range with their ranks; those beyond the draw have none, and are not merged."""
    first = start.column("first")[0].as_py()
    score, run = (rows.column(c).to_numpy() for c in ("score", "run"))
    doc = rows.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
    order = np.lexsort((doc, -score, run))
    bounds = np.flatnonzero(np.diff(run[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, int)
    keys = list(zip((-score[order]).tolist(), doc[order].tolist(), order.tolist(), strict=True))
    tournament = Tournament([keys[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    taken = [tournament.pop()[2] for _ in range(min(len(keys), max(0, draw - first)))]
    rank = np.zeros(len(keys), np.int64)
    rank[taken] = np.arange(first + 1, first + 1 + len(taken))
    return rows.select(["doc_id", "n_features", "weight", "score"]).append_column("rank", pa.array(rank, mask=rank == 0))


def _ranges(spark: SparkSession, rows: int) -> int:
    return max(1, min(-(-rows // LEAST_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-rows // MOST_ROWS))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Of the rows with ``least_words`` words, ``percent`` in a hundred (rounded down)
    are drawn, those of the highest scores; ties go to the smaller doc_id, a null one first, and rows of
    one doc_id are drawn each for itself. ``rank`` is 1, 2, 3 ... in that order, null for rows not drawn. Null and
    empty texts have no features, weight 0 and no rank. Without a target its counts are 0. An empty
    table gives an empty one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    scored = save(weights(docs, gain, seed).withColumn("run", F.spark_partition_id()).sortWithinPartitions(*order), "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    n = fit.count()
    draw = percent * n // 100
    cut = fit.repartitionByRange(_ranges(spark, n), *order).withColumn("range", F.spark_partition_id())
    cut = save(cut.sortWithinPartitions("run", *order), "ranges")
    counts = cut.groupBy("range").agg(F.count("*").alias("n"))
    starts = save(counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("first")), "starts")  # a row a range
    last = starts.where(F.col("first") < draw).agg(F.max("range")).first()[0]
    last = -1 if last is None else last
    merged = cut.where(F.col("range") <= last).groupBy("range").cogroup(starts.where(F.col("range") <= last).groupBy("range"))
    drawn = merged.applyInArrow(partial(_ranked, draw=draw), _OUT)
    rest = cut.where(F.col("range") > last).unionByName(scored.where(F.col("n_words") < least_words).withColumn("range", F.lit(0)))
    return drawn.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable] = {"op13_importance_resampling": op13_importance_resampling}
ORACLES = {
    "op13_importance_resampling": r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), listed AS (
  SELECT true AS own, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
  UNION ALL SELECT false, NULL, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) FROM benchmark
), features AS (
  SELECT own, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM listed
), counted AS (
  SELECT own, doc_id, f, count(*) AS n FROM features GROUP BY ALL
), told AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2), lambda k: ('0x' || substr(h, k + 1, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM counted), steps
), hits AS (
  SELECT own, doc_id, bucket, sum(n)::BIGINT AS n FROM counted JOIN told USING (f) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(n) FILTER (WHERE own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::DOUBLE AS t FROM hits
), gains AS (
  SELECT bucket, floor(1000 * ln((b.t + 1) * (totals.s + 10000) / ((b.s + 1) * (totals.t + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::DOUBLE AS t FROM hits GROUP BY bucket) b, totals
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM hits JOIN gains USING (bucket) WHERE own GROUP BY doc_id
), scored AS (
  SELECT l.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || l.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM listed l LEFT JOIN weighed USING (doc_id) WHERE l.own
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY words >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= 20) OVER () * 5 // 100 AS draw FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank FROM ranked"""
}
