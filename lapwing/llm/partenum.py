"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct runs of ``n`` words. Two sets of sizes a, b
with a Jaccard similarity of at least p / q differ in at most
(a + b)(q - p) / (q + p) elements. Sizes are cut into bands that hold sizes up
to q / p times their smallest, so similar sets lie in one band or in neighbours:
each set takes part in its own band and in the next one. In a band whose
largest size is r at most k = 2r(q - p) / (q + p) elements differ. The domain of
element hashes is cut into n1 = k // (k2 + 1) + 1 + e partitions, each of them
into n2 parts; at least e + 1 partitions then differ in k2 elements or fewer, and
of these some n2 - k2 parts are equal. One signature for each choice of
n2 - k2 parts therefore makes similar sets share one.

Choices of parts that hold no element say nothing and are left out. The e spare
partitions make up for that; a set with more than e partitions that have such a
choice adds its prefix (the first size - ceil(p / q size) + 1 elements by hash,
one of which similar sets share), which is exact for two such sets.

Documents of the same words (by a 128-bit digest of them) are one class before anything is paired. In each group with
one signature every class is compared with the smallest only; classes that are
then not connected but share a signature are compared with each other, inside
tasks and in blocks, so no pairs of a group are ever written out.

A pair is dropped if the parity maps of its sets differ in too many bits. What
is left is compared exactly, word by word: pairs are put together by their
smaller document, whose text goes to the task once, and the others stream past
it. Each document is first compared with the one it shares most signatures with,
and pairs that links already connect are not compared at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial
from hashlib import blake2b
from itertools import combinations
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.components import connected
from lapwing.llm.storage import drop, save
from lapwing.llm.words import mix, not_space, shingle_sets, slices, utf8

#: Classes compared with each other in one block; documents compared with one other in one task.
BLOCK, STAR = 1024, 512


@cache
def bands(p: int, q: int) -> np.ndarray:
    """The largest size of each band."""
    out, low = [], 1
    while low < 1 << 40:
        out.append(low * q // p)
        low = out[-1] + 1
    return np.array(out)


@cache
def layout(band: int, p: int, q: int, n2: int, k2: int) -> tuple[int, int]:
    """Partitions of a band, and how many of them are spare."""
    r = int(bands(p, q)[band])
    low = int(bands(p, q)[band - 1]) + 1 if band else 1
    k = 2 * r * (q - p) // (q + p)
    if k == 0:
        return 1, 0
    spare = 0
    for _ in range(20):
        n1 = k // (k2 + 1) + 1 + spare
        empty = exp(-low / (n1 * n2))
        unsafe = n1 * sum(len(list(combinations(range(n2), j))) * empty**j * (1 - empty) ** (n2 - j) for j in range(n2 - k2, n2 + 1))
        if spare >= (wanted := min(ceil(unsafe + 3 * sqrt(unsafe)), k)):
            break
        spare = wanted
    return k // (k2 + 1) + 1 + spare, spare


def signatures(elements: np.ndarray, p: int, q: int, n2: int, k2: int) -> np.ndarray:
    """Of one set, given as sorted distinct hashes. Similar sets share one at least; an empty set has none."""
    size = len(elements)
    if not size:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(bands(p, q), size))
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(mix(elements), out=total[1:])
    high = elements >> np.uint64(32)
    out, weak = [], False
    for band in (own, own + 1):
        n1, spare = layout(band, p, q, n2, k2)
        if n1 == 1:
            out.append(mix(total[-1:] + np.uint64(band)))
            continue
        parts = n1 * n2
        at = np.searchsorted((high * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        sums = (total[at[1:]] - total[at[:-1]]).reshape(n1, n2)
        full = (at[1:] > at[:-1]).reshape(n1, n2)
        where = mix(np.arange(n1, dtype=np.uint64) + np.uint64(band << 32))
        safe = np.ones(n1, bool)
        for j, chosen in enumerate(combinations(range(n2), n2 - k2)):
            some = full[:, chosen].any(axis=1)
            safe &= some
            value = where + np.uint64((j + 1) * 0xA24BAED4963EE407 % 2**64)
            for c in chosen:
                value = mix(value + sums[:, c])
            out.append(value[some])
        weak |= bool((~safe).sum() > spare)
    if weak:
        out.append(mix(elements[: size - -(-p * size // q) + 1] ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(out)


def parity(elements: np.ndarray) -> bytes:
    """Bit i: whether an odd number of elements end in i. Two sets differ in as many elements at least as their maps in bits. There are two bits an element or more, a power of 2, so that maps of two lengths can be compared."""
    bits = max(64, 1 << (2 * len(elements)).bit_length())
    return np.packbits(np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(maps: list[bytes], size: int) -> np.ndarray:
    """Maps of one length as rows of ``size`` bytes."""
    x = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)
    while x.shape[1] * 8 > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _aligned(maps: list[bytes]) -> np.ndarray:
    """Maps of several lengths as rows of the shortest."""
    length = np.array([len(m) for m in maps])
    out = np.zeros((len(maps), length.min() // 8), np.uint64)
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        out[own] = _folded([maps[i] for i in own.tolist()], length.min())
    return out


def _words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; both functions of bytes look at ASCII alone."""
    return (text or b"").lower().split()


def _digest(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    keep = not_space()
    for rows in slices(batches, "text"):
        sets = shingle_sets(*utf8(rows.column("text")), keep, n)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_class(t) for t in rows.column("text").cast(pa.binary()).to_pylist()], pa.binary()),
                pa.array([parity(s) for s in sets], pa.binary()),
            ],
            names=["doc_id", "n", "class", "map"],
        )


def _class(text: bytes | None) -> bytes:
    return blake2b(b" ".join(_words(text)), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], n: int, p: int, q: int, n2: int, k2: int) -> Iterator[pa.RecordBatch]:
    """A row for each signature of the first document of each class that the task meets, so a class of any size has as many rows as tasks at most."""
    keep, met = not_space(), set()
    for rows in slices(batches, "text"):
        sigs, ids, size = [], [], 0
        for doc_id, text, s in zip(rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist(), shingle_sets(*utf8(rows.column("text")), keep, n), strict=True):
            if not len(s) or doc_id is None or (own := _class(text)) in met:
                continue
            met.add(own)
            sigs.append(signatures(s, p, q, n2, k2).view(np.int64))
            ids.append(np.full(len(sigs[-1]), doc_id, np.int64))
            size += len(sigs[-1])
            if size > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], names=["sig", "doc_id"])
                sigs, ids, size = [], [], 0
        if sigs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], names=["sig", "doc_id"])


def _possible(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and maps allow the similarity."""
    for rows in batches:
        na, nb = (rows.column(c).to_numpy() for c in ("na", "nb"))
        maps = [rows.column(c).to_pylist() for c in ("mapa", "mapb")]
        lengths = np.array([[len(m) for m in x] for x in maps]).reshape(2, -1)
        good = np.minimum(na, nb) * q >= np.maximum(na, nb) * p
        for la, lb in np.unique(lengths[:, good], axis=1).T.tolist():
            at = np.flatnonzero(good & (lengths[0] == la) & (lengths[1] == lb))
            x, y = (_folded([m[i] for i in at.tolist()], min(la, lb)) for m in maps)
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            good[at] = differ * (q + p) <= (na[at] + nb[at]) * (q - p)
        yield rows.select(["a", "b", "shared"]).filter(pa.array(good))


def _shingles(text: bytes | None, n: int) -> set[tuple[bytes, ...]]:
    w = _words(text)
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else {tuple(w)} if w else set()  # noqa: B905


def _compared(batches: Iterator[pa.RecordBatch], n: int, p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Of rows by (a, salt, side): the documents of side 1 that are similar to one of side 0, which comes before them."""
    head, own = None, []
    for rows in slices(batches, "text"):
        found: tuple[list[int], list[int]] = ([], [])
        for a, salt, side, doc_id, text in zip(*(rows.column(c).to_pylist() for c in ("a", "salt", "side", "doc_id")), rows.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if (a, salt) != head:
                head, own = (a, salt), []
            theirs = _shingles(text, n)
            if side == 0:
                own.append(theirs)
                continue
            for x in own:
                same = len(x & theirs)
                if same and q * same >= p * (len(x) + len(theirs) - same):
                    found[0].append(a)
                    found[1].append(doc_id)
                    break
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def _near(ids, sizes, components, maps, sides, p: int, q: int) -> np.ndarray:
    """Pairs of rows of one group, or of its two sides, that may be similar and are not yet connected."""
    two = np.flatnonzero(sides == 1)
    one = np.flatnonzero(sides == 0) if len(two) else np.arange(len(ids))
    two = two if len(two) else one
    found, step = [np.zeros((2, 0), np.int64)], max(1, (1 << 14) // len(two))
    length, levels = np.array([len(m) for m in maps]), {}
    for size in np.unique(length).tolist():  # maps of similar sets differ in length as their sizes do, and by a power of 2
        own = np.flatnonzero((length >= size) & (length * p <= 2 * q * size))
        place = np.zeros(len(maps), np.int64)
        place[own] = np.arange(len(own))
        levels[size] = place, _aligned([maps[i] for i in own.tolist()])
    for k in range(0, len(one), step):
        i = one[k : k + step]
        a, b = sizes[i][:, None], sizes[two]
        good = (components[i][:, None] != components[two]) & (np.minimum(a, b) * q >= np.maximum(a, b) * p)
        x, y = np.nonzero(good)
        x, y = i[x], two[y]
        near, shorter = np.zeros(len(x), bool), np.minimum(length[x], length[y])
        for size in np.unique(shorter).tolist():
            at = np.flatnonzero(shorter == size)
            place, own = levels[size]
            u, v = x[at], y[at]
            near[at] = np.bitwise_count(own[place[u]] ^ own[place[v]]).sum(axis=1, dtype=np.int64) * (q + p) <= (sizes[u] + sizes[v]) * (q - p)
        x, y = ids[x[near]], ids[y[near]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
    return np.concatenate(found, axis=1)


def _apart(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """``_near`` of each group of (sig, i, j), whose rows follow each other. A group has two blocks at most."""
    held: list[np.ndarray] | None = None

    def pairs(columns: list[np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
        sides, ids, components, sizes, maps = columns[3:]
        found = [_near(ids[a:b], sizes[a:b], components[a:b], maps[a:b].tolist(), sides[a:b], p, q) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        found = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "i", "j", "side", "doc_id", "component", "n", "map")]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        new = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])) + 1
        bounds = np.concatenate([[0], new])
        yield pairs(columns, bounds)
        held = [c[bounds[-1] :] for c in columns]
    if held is not None and len(held[0]):
        yield pairs(held, np.array([0, len(held[0])]))


def _verify(pairs: DataFrame, docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of a saved table whose texts are similar enough. A text goes to each group of ``STAR`` documents that it is compared with, once."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    points = pairs.join(stars, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"))
    heads = stars.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"))
    rows = docs.join(save(heads.union(points), "targets"), "doc_id").select("a", "salt", "side", "doc_id", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return save(rows.mapInArrow(partial(_compared, n=n, p=p, q=q), "a long, b long").distinct(), "links")


def _components(links: DataFrame) -> DataFrame:
    return save(connected(links), "component")


def _still_apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs whose documents links don't connect yet."""
    for c in ("a", "b"):
        pairs = pairs.join(component.select(F.col("node").alias(c), F.col("component").alias(c + "c")), c, "left")
    return pairs.where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).drop("ac", "bc")


def jaccard_components(docs: DataFrame, n: int = 3, similarity: tuple[int, int] = (9, 10), parts: tuple[int, int] = (3, 1)) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id: long, text: string).

    ``component_id`` is the smallest doc_id that links reach, where texts link
    if their sets have a Jaccard similarity of ``similarity`` = (p, q), p / q, or
    more. ``parts`` is (n2, k2). Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered;
    a text of fewer than ``n`` words has all of them as its one element.

    Candidates come from 64-bit hashes of words and shingles; links are compared
    on the words themselves, and only texts of the same words, by a 128-bit
    digest, link without. ``n_shingles`` counts distinct hashes. A task holds the
    set of one text and that of the text compared with it, however long.

    A null, empty or blank text has 0 shingles and links with nothing. Rows with
    one doc_id are one document for links: their rows get the smallest component
    of any of them. A null doc_id keeps its count and gets a null component. An
    empty table gives an empty one; other columns are not looked at.
    """
    p, q = similarity
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = save(docs.mapInArrow(partial(_digest, n=n), "doc_id long, n long, class binary, map binary"), "digest")
    known = digest.where("doc_id is not null and n > 0")
    classes = known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = save(known.join(classes.where("copies > 1"), "class").where("doc_id <> rep").select("doc_id", "rep"), "copies")

    first = F.first("doc_id").over(Window.partitionBy("sig").orderBy("doc_id"))
    signed = docs.mapInArrow(partial(_signed, n=n, p=p, q=q, n2=parts[0], k2=parts[1]), "sig long, doc_id long")
    raw = save(signed.withColumn("first", first).where("first <> doc_id"), "raw")
    # Copies of one class in several tasks stand for it together: they are known to be equal.
    # A doc_id of several rows stands for itself, as its other texts are in no such class.
    alone = copies.join(known.groupBy("doc_id").count().where("count > 1"), "doc_id", "left_anti")
    shared = raw
    for column in ("doc_id", "first"):
        shared = shared.join(alone.select(F.col("doc_id").alias(column), "rep"), column, "left").withColumn(column, F.coalesce("rep", column)).drop("rep")
    shared = save(shared.where("first <> doc_id").select("sig", "first", "doc_id").distinct(), "shared")
    drop(raw)
    maps = known.select("doc_id", "n", "map")
    one, two = (maps.select(*[F.col(c).alias(c + s) for c in maps.columns]) for s in "ab")
    pairs = shared.groupBy(F.least("first", "doc_id").alias("a"), F.greatest("first", "doc_id").alias("b")).agg(F.count("*").alias("shared"))
    pairs = pairs.join(one, pairs.a == one.doc_ida).join(two, pairs.b == two.doc_idb).select("a", "b", "shared", "na", "nb", "mapa", "mapb")
    pairs = save(pairs.mapInArrow(partial(_possible, p=p, q=q), "a long, b long, shared long"), "pairs")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    best = save(best, "best")
    links = _verify(best, docs, n, p, q)
    component = _components(links)
    others = save(_still_apart(pairs.select("a", "b").distinct().join(best, ["a", "b"], "left_anti"), component), "others")
    more = _verify(others, docs, n, p, q)
    links, tried = save(links.union(more), "links"), best.union(others)
    component = _components(links)

    # A group with documents apart has one that is apart from its first; groups of two were compared, and groups of the same documents need one turn.
    rows = shared
    for c in ("first", "doc_id"):
        rows = rows.join(component.select(F.col("node").alias(c), F.col("component").alias(c + "c")), c, "left")
    sigs = rows.groupBy("sig").agg(F.count("*").alias("others"), F.max(F.coalesce("firstc", "first") != F.coalesce("doc_idc", "doc_id")).alias("apart"))
    rows = shared.join(sigs.where("others > 1 and apart").select("sig"), "sig", "left_semi")
    members = save(rows.select("sig", "doc_id").union(rows.select("sig", F.col("first"))).distinct(), "members")
    placed = members.join(component, F.col("doc_id") == F.col("node"), "left").select("sig", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    which = [F.bit_xor(F.xxhash64("doc_id", F.lit(seed))).alias(f"w{seed}") for seed in (1, 2)]
    mixed = members.groupBy("sig").agg(F.count("*").alias("size"), *which)
    mixed = save(mixed.where("size > 2").groupBy("size", "w1", "w2").agg(F.min("sig").alias("sig")).select("sig", "size"), "mixed")
    placed = placed.join(mixed, "sig").join(maps, "doc_id")
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), count).cast("int")
    placed = placed.withColumn("count", count).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    blocks = placed.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "doc_id", "component", "n", "map")
    blocks = blocks.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    last = blocks.mapInArrow(partial(_apart, p=p, q=q), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    last = save(last, "last")
    edges = links.union(_verify(last, docs, n, p, q)).union(copies.select("doc_id", "rep"))
    component = _components(edges)
    for table in (copies, shared, pairs, best, others, members, mixed, last, links):
        drop(table)
    out = digest.select("doc_id", F.col("n").alias("n_shingles")).join(component, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op10_partenum_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable] = {"op10_partenum_jaccard": op10_partenum_jaccard}
ORACLES = {
    "op10_partenum_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT doc_id, coalesce(len(sh), 0)::BIGINT AS n_shingles, coalesce(least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)), doc_id) AS component_id FROM s
"""
}
