"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item. Its set holds the runs of
``SHINGLE`` words in it, ordered by how often all documents hold them, rarest
first. A document contains the window only if it contains all of the set, so
the prefix that containment needs is the rarest run alone: documents are joined
with the windows on it. The place of the run in the window gives the place of
the window in the document (positional bound), which must fit into the document
(length bound); then every word is compared, exactly.

Windows, counts and the join are tables, whatever the size of the benchmark, and
documents are read twice: once to count runs, once to find the rarest ones. Each
time a bitmap of fixed size tells which runs can be of a window; if there are too
many for it, more of the documents' runs take part, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.storage import save
from lapwing.llm.words import alphanumeric, lower_az, runs, slices, utf8, words

#: Words of a window, and of the runs in its set.
WINDOW, SHINGLE = 10, 3
#: Words of 64 bits in the bitmap of runs: 8 MB, whatever the benchmark's size.
SLOTS = 1 << 20
#: Parts into which documents with one run are dealt, so that no run or window is one task's.
SALTS = 16


def _texts(rows: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes with A-Z lowered, the words' hashes, first bytes and ends, and the index of each text's first word."""
    data, bounds = utf8(rows.column("text"))
    return lower_az()[data].tobytes(), *words(data, bounds, alphanumeric())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["item_id", "window", "size", "runs"]
    for rows in slices(batches, "text"):
        raw, hashes, a, b, first = _texts(rows)
        out: list[tuple] = []
        for item_id, x, y in zip(rows.column("item_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            size = min(WINDOW, y - x)
            own = runs(hashes[x:y], min(SHINGLE, size)).view(np.int64) if size else ()
            for i in range(x, y - size + 1 if size else x):
                text = b" ".join(raw[a[k] : b[k]] for k in range(i, i + size)).decode()
                out.append((item_id, text, size, own[i - x : i - x + size - min(SHINGLE, size) + 1]))
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=names)


def _bitmap(run_rows: DataFrame) -> Broadcast:
    """A bit for each ``run``, in ``SLOTS`` words at most."""
    slot = F.expr(f"shiftrightunsigned(run, 6) & {SLOTS - 1}L")
    rows = run_rows.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(run & 63L as int))")).alias("bits")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return run_rows.sparkSession.sparkContext.broadcast(out)


def _found(hashes: np.ndarray, first: np.ndarray, n: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``n`` words inside a text that the bitmap has: their hashes, first words and texts."""
    own = runs(hashes, n).view(np.int64)
    at = np.flatnonzero((bitmap[(own.view(np.uint64) >> np.uint64(6)).astype(np.int64) & (len(bitmap) - 1)] >> (own & 63)) & 1)
    text = np.searchsorted(first, at, "right") - 1
    inside = at + n <= first[text + 1]
    return own[at[inside]], at[inside], text[inside]


def _count(batches: Iterator[pa.RecordBatch], lengths: list[int], bitmap: Broadcast) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        _, hashes, _, _, first = _texts(rows)
        for n in lengths:
            own, count = np.unique(_found(hashes, first, n, bitmap.value)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count)], names=["run", "count"])


def _occurrences(batches: Iterator[pa.RecordBatch], lengths: list[int], bitmap: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of each row its words' number and where it holds a run of the bitmap, with the words around that a window could take."""
    at_type = pa.list_(pa.struct({"run": pa.int64(), "at": pa.int64(), "before": pa.int32(), "around": pa.string()}))
    for rows in slices(batches, "text"):
        raw, hashes, a, b, first = _texts(rows)
        found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
        for n in lengths:
            for run, at, text in zip(*(x.tolist() for x in _found(hashes, first, n, bitmap.value)), strict=True):
                low, high = max(int(first[text]), at - WINDOW + n), min(int(first[text + 1]), at + WINDOW)
                around = b" ".join(raw[a[k] : b[k]] for k in range(low, high)).decode()
                found[text].append({"run": run, "at": at - int(first[text]), "before": at - low, "around": around})
        yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(found, at_type)], names=["row", "doc_id", "n_words", "found"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items`` for every row of ``docs`` (doc_id, text).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered; ``n_hit`` counts
    those in any occurrence of a window of an item, ``items`` are the items with
    such windows, as the sorted array ``items`` and as a digest. An item of fewer
    than ``WINDOW`` words is one window. Null, empty and wordless texts have no
    words and no hits, however long a text is all of it counts, and an empty
    table gives an empty one; items with a null item_id, a null text or without
    words count as absent. Repeated rows each get their row; items of one id count
    as one. Other columns are not looked at.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    windows = save(items.mapInArrow(_windows, "item_id string, window string, size int, runs array<long>"), "windows")
    distinct = windows.drop("item_id").dropDuplicates(["window"])
    lengths = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # 1, 2 or 3
    own = save(distinct.select("window", "size", F.size(F.array_distinct("runs")).alias("n_runs"), F.posexplode("runs").alias("offset", "run")), "runs")
    counts = docs.select("text").mapInArrow(partial(_count, lengths=lengths, bitmap=_bitmap(own)), "run long, count long").groupBy("run").agg(F.sum("count").alias("count"))
    rarest = own.join(counts, "run").groupBy("window", "size", "n_runs").agg(F.countDistinct("run").alias("held"), F.min(F.struct("count", "run", "offset")).alias("least"))
    prefix = save(rarest.where("held = n_runs").select("window", "size", "least.run", "least.offset"), "prefix")
    # Rows are numbered once, in what is written here.
    rows = save(docs.mapInArrow(partial(_occurrences, lengths=lengths, bitmap=_bitmap(prefix)), "row long, doc_id long, n_words long, found array<struct<run: long, at: long, before: int, around: string>>"), "occurrences")
    salt, salts = F.pmod(F.xxhash64("row"), F.lit(SALTS)), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))
    places = rows.select("row", F.explode("found").alias("f")).select("row", "f.*", salt.alias("salt"))
    hits = places.join(prefix.withColumn("salt", salts), ["run", "salt"]).where("before >= offset")
    hits = hits.where(F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("size")), " ") == F.col("window"))
    hits = save(hits.select("row", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("size")).alias("end"), "window", "salt"), "hits")
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    n_hit = hits.select("row", "start", "end").distinct().withColumn("new", F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    n_hit = n_hit.groupBy("row").agg(F.sum(F.greatest("new", F.lit(0))).alias("n_hit"))
    held = hits.select("row", "window", "salt").distinct().join(windows.select("window", "item_id").distinct().withColumn("salt", salts), ["window", "salt"])
    held = held.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = rows.drop("found").join(n_hit.join(held, "row"), "row", "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    count = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", count.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (count > 0).alias("contaminated"), found.alias("items"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


QUERIES: dict[str, Callable] = {"op5_decontaminate": op5_decontaminate}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op5_decontaminate": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item, w, least(10, len(w)) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item, s, array_to_string(w[k:k + s - 1], ' ') AS win FROM (SELECT item, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM i)
), dw AS (
  SELECT r, k, s, array_to_string(w[k:k + s - 1], ' ') AS win FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS k FROM d, (SELECT DISTINCT s FROM iw) WHERE len(w) >= s)
), hit AS (
  SELECT r, k, s, win FROM dw SEMI JOIN iw USING (s, win)
), places AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + s)) AS p FROM hit) GROUP BY r
), held AS (
  SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit JOIN iw USING (s, win) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN held USING (r)
"""
}
