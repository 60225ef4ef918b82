"""Embedding near-dedup by a subspace pigeonhole join.

Vectors are scaled to length 1 and rotated by one orthogonal matrix, so their
spread is even over the dimensions. A cosine of at least c is a squared distance
of at most 2 - 2c. Cut into blocks of ``DIMENSIONS`` dimensions, two vectors that
near have a block whose squared distance is at most the block's share of it, in
proportion to its dimensions. So every block is range-joined by itself, under its
share, and the candidates are verified, exactly, in double precision.

The range join of a block: its points are range-partitioned by label and by their
place on a curve through the block's space (bits of all coordinates interleaved),
cut into chunks of at most ``CHUNK`` with the box around each, and chunks of a
label meet if their boxes are at most the block's share apart. Of a pair within
the share in several blocks the first one alone keeps it, which is told from the
pair itself, so the union needs no second shuffle and pairs are never written:
a task gives, for every vector, the number of its links and the smallest vec_id
of its component in there. Equal vectors of a label are one class before that,
counted and linked afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.components import connected
from lapwing.llm.storage import save

#: Vectors compared with as many others by a task; of these at once; dimensions of a block; candidates verified at once.
CHUNK, SLAB, DIMENSIONS, AT_ONCE = 4096, 512, 16, 1 << 15
#: Parts of the boxes that one box meets in different tasks, so that a label with very many chunks isn't one task's.
SALTS = 16
#: Added to every share, as the rotation is rounded; verification is exact.
SLACK = 1e-6
#: Octiles of the normal distribution: the levels of a coordinate on the curve.
_OCTILES = np.array([-1.15, -0.67, -0.32, 0.0, 0.32, 0.67, 1.15])


@lru_cache(maxsize=8)
def rotation(dimensions: int, seed: int = 7) -> np.ndarray:
    """An orthogonal matrix but for rounding to 2^-30, which makes it the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return np.round(q * np.sign(np.diag(r)) * 2.0**30) / 2.0**30


def blocks_of(dimensions: int) -> list[slice]:
    return [slice(i, min(i + DIMENSIONS, dimensions)) for i in range(0, dimensions, DIMENSIONS)]


def rotated(x: np.ndarray, columns: slice = slice(None)) -> np.ndarray:
    """Rows at length 1, rotated. Each value depends on its own row alone and is summed up in one order, so all tasks have the same."""
    turn = rotation(x.shape[1])[:, columns]
    out, square = np.zeros((len(x), turn.shape[1])), np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j, None] * turn[j]
        square += x[:, j] * x[:, j]
    return out / np.sqrt(square)[:, None]


def _packed(x: np.ndarray) -> bytes:
    """Single precision where it says the same."""
    small = x.astype(np.float32)
    return small.tobytes() if np.array_equal(small, x) else x.tobytes()


def _unpacked(data: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if len(data) == 8 * n * d else np.float32).reshape(n, d).astype(np.float64)


def _usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Classes that can link, scaled by a power of two so that no square over- or underflows."""
    for rows in batches:
        lengths = rows["embedding"].map(len)
        for d, own in rows.groupby(lengths):
            if not d:
                continue
            x = np.array(own["embedding"].tolist(), np.float64).reshape(len(own), d)
            largest = np.abs(x).max(axis=1)
            good = np.isfinite(largest) & (largest > 0)
            x = np.ldexp(x[good], -np.frexp(largest[good])[1][:, None])
            yield pd.DataFrame({"label": own["label"].to_numpy()[good], "d": d, "vec_id": own["vec_id"].to_numpy()[good], "copies": own["copies"].to_numpy()[good], "vector": [_packed(v) for v in x]})


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each vector once a block, with its place on the curve through the block's space."""
    for rows in batches:
        for d, own in rows.groupby("d"):
            u = rotated(np.stack([_unpacked(v, 1, d)[0] for v in own["vector"]])) * np.sqrt(d)
            levels = np.searchsorted(_OCTILES, u)
            for b, columns in enumerate(blocks_of(d)):
                place = np.zeros(len(own), np.int64)
                for bit in (2, 1, 0):
                    for level in levels[:, columns].T:
                        place = place * 2 + (level >> bit & 1)
                yield own.assign(block=b, place=place)[["label", "d", "block", "place", "vec_id", "copies", "vector"]]


def _chunks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Runs of at most ``most`` rows of one label, dimension and block, with the box around each in the block's space."""
    part, number = TaskContext.get().partitionId(), 0
    held: list[pd.DataFrame] = []

    def closed() -> pd.DataFrame:
        nonlocal number, held
        rows = pd.concat(held)
        held, number = [], number + 1
        d, block = int(rows["d"].iat[0]), int(rows["block"].iat[0])
        x = np.stack([_unpacked(v, 1, d)[0] for v in rows["vector"]])
        at = rotated(x, blocks_of(d)[block])
        return pd.DataFrame({"chunk": [(part << 32) + number], "label": [rows["label"].iat[0]], "d": [d], "block": [block], "low": [at.min(axis=0)], "high": [at.max(axis=0)], "ids": [rows["vec_id"].tolist()], "copies": [rows["copies"].tolist()], "vectors": [_packed(x)]})

    key = ["label", "d", "block"]
    for batch in batches:
        for _, own in batch.groupby(key, sort=False):
            if held and held[0][key].iloc[0].tolist() != own[key].iloc[0].tolist():
                yield closed()
            at = 0
            while at < len(own):
                take = most - sum(map(len, held))
                held.append(own.iloc[at : at + take])
                at += take
                if sum(map(len, held)) >= most:
                    yield closed()
    if held:
        yield closed()


def _first_block(u: np.ndarray, w: np.ndarray, limit: float, block: int) -> np.ndarray:
    """Whether ``block`` is the first one within its share, for each pair of rows; like ``rotated``, the same in every task."""
    out = np.ones(len(u), bool)
    for b, columns in enumerate(blocks_of(u.shape[1])[: block + 1]):
        square = np.zeros(len(u))
        for x, y in zip(u[:, columns].T, w[:, columns].T, strict=True):
            square += (x - y) * (x - y)
        out &= (square <= limit * (columns.stop - columns.start) / u.shape[1] + SLACK) == (b == block)
    return out


def linked(x: np.ndarray, y: np.ndarray, block: int, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of x, row of y) of at least ``cosine`` that ``block`` is the first to find; of the pairs of one chunk with itself, each once."""
    d, limit = x.shape[1], 2 - 2 * cosine
    columns = blocks_of(d)[block]
    share = limit * (columns.stop - columns.start) / d
    u, norm_x = rotated(x), np.linalg.norm(x, axis=1)
    w, norm_y = (u, norm_x) if same else (rotated(y), np.linalg.norm(y, axis=1))
    b = w[:, columns]
    square_b = (b * b).sum(axis=1)
    for at in range(0, len(x), SLAB):
        a = u[at : at + SLAB, columns]
        near = (a * a).sum(axis=1)[:, None] + square_b - 2 * (a @ b.T) <= share + 2 * SLACK
        i, j = np.nonzero(np.triu(near, at + 1) if same else near)
        i += at
        for k in range(0, len(i), AT_ONCE):
            p, q = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            own = _first_block(u[p], w[q], limit, block)
            p, q = p[own], q[own]
            good = np.einsum("ij,ij->i", x[p], y[q]) / (norm_x[p] * norm_y[q]) >= cosine
            if good.any():
                yield p[good], q[good]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that links reach, for indices under n."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _compare(batches: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for row in rows.itertuples():
            same = pd.isna(row.chunk2)
            ids = np.concatenate([row.ids, [] if same else row.ids2]).astype(np.int64)
            copies = np.concatenate([row.copies, [] if same else row.copies2]).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            x = _unpacked(row.vectors, len(row.ids), row.d)
            y = x if same else _unpacked(row.vectors2, len(row.ids2), row.d)
            links, root = np.zeros(len(ids)), np.arange(len(ids))
            for i, j in linked(x, y, row.block, cosine, same):
                j = j + (0 if same else len(x))
                links += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                root = _roots(len(ids), np.concatenate([np.arange(len(ids)), rank[i]]), np.concatenate([root, rank[j]]))
            some = links > 0
            yield pd.DataFrame({"vec_id": ids[some], "links": links[some].astype(np.int64), "root": ids[order[root[rank]]][some]})


def near_vectors(vectors: DataFrame, cosine: float = 0.93, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding: array, label).

    Rows link if their labels are equal and not null and their cosine, in double
    precision, is at least ``cosine``. A null, empty or zero vector, one with a
    null or non-finite component and one of another length link with nothing. Equal
    vectors of a label all link with each other. Repeated vec_ids count as
    separate vectors for links but share a component; a row with a null vec_id
    links with nothing. Finite components link however large or small they are.
    Other columns are not looked at, and an empty table gives no row.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    sound = rows.where("vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null)")
    classes = save(sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "classes")
    usable = save(classes.mapInPandas(_usable, "label string, d int, vec_id long, copies long, vector binary"), "usable")
    points = usable.mapInPandas(_placed, "label string, d int, block int, place long, vec_id long, copies long, vector binary")
    order = ("label", "d", "block", "place", "vec_id")  # the last one parts equal places
    chunks = points.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = save(chunks.mapInPandas(partial(_chunks, most=chunk), "chunk long, label string, d int, block int, low array<double>, high array<double>, ids array<long>, copies array<long>, vectors binary"), "chunks")
    box = chunks.select("chunk", "label", "d", "block", "low", "high").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    other = chunks.select(F.col("chunk").alias("chunk2"), "label", "d", "block", F.col("low").alias("low2"), F.col("high").alias("high2"), (F.col("chunk") % SALTS).cast("int").alias("salt"))
    gap = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    apart = F.aggregate(F.zip_with(gap("low", "high2"), gap("low2", "high"), lambda x, y: x * x + y * y), F.lit(0.0), lambda x, y: x + y)
    share = F.lit(2 - 2 * cosine) * F.size("low") / F.col("d") + 2 * SLACK
    pairs = box.join(other, ["label", "d", "block", "salt"]).where((F.col("chunk") < F.col("chunk2")) & (apart <= share)).select("chunk", "chunk2")
    content = chunks.select("chunk", "d", "block", "ids", "copies", "vectors")
    content2 = chunks.select(*[F.col(c).alias(c + "2") for c in ("chunk", "ids", "copies", "vectors")])
    alone = content.select("*", *[F.lit(None).cast(t).alias(c) for c, t in content2.dtypes])
    tasks = pairs.join(content, "chunk").join(content2, "chunk2").select(*alone.columns).unionByName(alone)
    found = save(tasks.mapInPandas(partial(_compare, cosine=cosine), "vec_id long, links long, root long"), "found")
    members = sound.join(usable.select("label", F.col("vec_id").alias("rep"), "copies").join(classes.select("label", F.col("vec_id").alias("rep"), "embedding"), ["label", "rep"]), ["label", "embedding"])
    members = save(members.select("vec_id", "rep", "copies"), "members")
    links = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).union(members.select("vec_id", "rep")))
    counted = members.join(links, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    counted = counted.groupBy("vec_id").agg(F.max("links").alias("n_links"))
    out = rows.select("vec_id").join(counted, "vec_id", "left").join(component, F.col("vec_id") == F.col("node"), "left")
    component_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))


def op4_subspace_neighbours(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable] = {"op4_subspace_neighbours": op4_subspace_neighbours}
ORACLES = {
    "op4_subspace_neighbours": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), smallest AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links,
  coalesce(least(v.vec_id, smallest.b), v.vec_id) AS component_id, v.vec_id = coalesce(least(v.vec_id, smallest.b), v.vec_id) AS kept
FROM v LEFT JOIN smallest ON smallest.a = v.vec_id
"""
}
