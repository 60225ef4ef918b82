"""A Merkle manifest of a table of documents, its proofs, and what they say of tampered rows.

The leaves of a source, in doc_id order, are the leaves of its tree; the roots of
the sources, in order of their names, are the leaves of the tree on top. Every
``ARITY`` neighbours of a level have one parent.

Leaves are range-partitioned into pieces by (source, doc_id). How many leaves each
source has in each piece says where in its tree a piece's leaves stand, and how
many siblings each run of a level has. A ``Forest`` holds the nodes that still wait
for siblings, keyed by tree, level and run; a run that is complete becomes its
parent. Adding one forest's nodes to another is associative and an empty forest
changes nothing, so forests of pieces are reduced as a tree: neighbours first,
``FAN`` at a time. As neighbours stand next to each other in the trees, what
still waits is at most two incomplete runs a level, however many leaves there are.

For the proofs each piece rebuilds the runs inside it, and is sent those
that reach beyond it, a few a level and tree; both give each leaf its siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.storage import save

#: Children of a node; forests that are merged at a time.
ARITY, FAN = 16, 16
#: Leaves of a piece: no fewer as long as there are as many pieces as shuffle partitions, about so many at most.
LEAST_ROWS, MOST_ROWS = 5_000, 200_000
#: A row is tampered with if this divides the CRC-32 of its doc_id.
TAMPERED = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: The number of the tree whose leaves are the roots of the sources; those have 0, 1, 2 ...
TOP = -1

_ORDER = ("source_known", "source", "known", "doc_id", "leaf", "tampered")
_PIECE = "tree long, size long, level int, run long, place int, node string, done boolean"
_NODE = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("run", pa.int64()), ("place", pa.int32()), ("node", pa.string()), ("done", pa.bool_())])
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(size: int) -> list[int]:
    """The number of nodes of each level of a tree of ``size`` leaves, the root's included."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Forest:
    """Nodes without all their siblings, and the runs that were completed on the way: ``done[tree, level, run]`` are a parent's children."""

    def __init__(self, trees: int):
        self.trees = trees
        self.waiting: dict[tuple[int, int, int], dict[int, str]] = {}
        self.done: dict[tuple[int, int, int], list[str]] = {}
        self.sizes: dict[int, list[int]] = {TOP: levels(trees)}

    def add(self, tree: int, size: int, level: int, index: int, node: str) -> None:
        """Adds a node; as long as that completes a run, adds the parent. A source's root is a leaf of the top tree."""
        if tree not in self.sizes:
            self.sizes[tree] = levels(size)
        while True:
            counts = self.sizes[tree]
            if counts[level] == 1:
                if tree == TOP:
                    self.done[TOP, level, 0] = [node]
                    return
                self.done[tree, level, 0] = [node]
                tree, level, index = TOP, 0, tree
                continue
            run, place = divmod(index, ARITY)
            siblings = self.waiting.setdefault((tree, level, run), {})
            siblings[place] = node
            if len(siblings) < min(ARITY, counts[level] - run * ARITY):
                return
            children = [siblings[k] for k in range(len(siblings))]
            del self.waiting[tree, level, run]
            self.done[tree, level, run] = children
            level, index, node = level + 1, run, digest(children)

    def merge(self, other: pa.Table) -> None:
        """Adds the waiting nodes of another forest."""
        for r in other.to_pylist():
            self.add(r["tree"], r["size"], r["level"], r["run"] * ARITY + r["place"], r["node"])

    def table(self) -> pa.Table:
        rows = [(t, self.sizes[t][0], level, run, place, node, False) for (t, level, run), x in self.waiting.items() for place, node in x.items()]
        rows += [(t, self.sizes[t][0], level, run, place, node, True) for (t, level, run), x in self.done.items() for place, node in enumerate(x)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _NODE, strict=True)] if rows else [pa.array([], f.type) for f in _NODE], schema=_NODE)


def _grown(leaves: pa.Table, spans: pa.Table, trees: int) -> pa.Table:
    """The forest of one piece. Runs that the piece completes by itself are left out: it can complete them again."""
    forest = Forest(trees)
    for tree, size, index, _, leaf, _ in _placed(leaves, spans):
        forest.add(tree, size, 0, index, leaf)
    forest.done = {k: x for k, x in forest.done.items() if k[0] == TOP}
    return forest.table()


def _placed(leaves: pa.Table, spans: pa.Table) -> Iterator[tuple[int, int, int, int | None, str, str | None]]:
    """(tree, its size, index, doc_id, leaf, tampered leaf) of the leaves of a piece, in order."""
    leaves = leaves.sort_by([(c, "ascending") for c in _ORDER])
    rows = zip(*(leaves.column(c).to_pylist() for c in ("doc_id", "leaf", "tampered")), strict=True)
    for s in sorted(spans.to_pylist(), key=lambda r: r["tree"]):
        for k in range(s["n"]):
            yield s["tree"], s["size"], s["start"] + k, *next(rows)


def _folded(path: list[tuple[list[str], int]], node: str) -> str:
    for siblings, place in path:
        node = digest([*siblings[:place], node, *siblings[place + 1 :]])
    return node


def _proved(leaves: pa.Table, sent: pa.Table, trees: int) -> pa.Table:
    """The rows of one piece with their proofs, from the runs inside it and those that it is sent."""
    import pyarrow.compute as pc

    is_span = pc.is_null(sent.column("level"))
    spans, sent = sent.filter(is_span), sent.filter(pc.invert(is_span))
    forest = Forest(trees)
    rows = list(_placed(leaves, spans))
    for tree, size, index, _, leaf, _ in rows:
        forest.add(tree, size, 0, index, leaf)
    runs = forest.done | {(r["tree"], r["level"], r["run"]): r["children"] for r in sent.to_pylist()}
    top = levels(trees)
    root = runs[TOP, len(top) - 1, 0][0]
    paths: dict[tuple[int, int], tuple[list[tuple[list[str], int]], str]] = {}

    def path(tree: int, counts: list[int], index: int) -> list[tuple[list[str], int]]:
        return [(runs[tree, level, index // ARITY ** (level + 1)], index // ARITY**level % ARITY) for level in range(len(counts) - 1)]

    out = []
    for tree, _, index, doc_id, leaf, tampered in rows:
        counts = forest.sizes[tree]
        if (tree, index // ARITY) not in paths:  # leaves of one run share all but the first step
            above = path(tree, counts, index)[1:] + path(TOP, top, tree)
            paths = {(tree, index // ARITY): (above, "".join(x for siblings, place in above for k, x in enumerate(siblings) if k != place))}
        above, text = paths[tree, index // ARITY]
        own = [(runs[tree, 0, index // ARITY], index % ARITY)] if len(counts) > 1 else []
        siblings = [x for run, place in own for k, x in enumerate(run) if k != place]
        folded = _folded(own + above, tampered or leaf)
        out.append((doc_id, leaf, runs[tree, len(counts) - 1, 0][0], root, digest([*siblings, text]), folded, folded == root))
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    columns = list(zip(*out, strict=True)) or [[]] * len(types)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _PROOF.split(", ")])


def _value(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    return F.sha2(F.concat(*[_value(c) for c in fields]), 256)


def _pieces(spark: SparkSession, rows: int) -> int:
    return max(1, min(-(-rows // LEAST_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-rows // MOST_ROWS))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``folded_root`` is what the untampered siblings and the row's leaf give, the
    leaf being recomputed from the text with A-Z lowered if ``TAMPERED`` divides
    the CRC-32 of the decimal doc_id. Null is a source of its own, the first; a
    null doc_id comes first in its source and isn't tampered with; rows of one
    doc_id follow each other in the order of their leaves. Null fields and empty
    texts have leaves as others have. A lone row is the root, with the digest of
    nothing as its proof. An empty table gives an empty one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    fields = [F.col(c) for c in FIELDS]
    lowered = [*fields[:-1], F.translate("text", ascii_uppercase, ascii_lowercase)]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    rows = docs.select(*[docs[c].cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS])
    rows = rows.select("doc_id", "source", leaf_digest(fields).alias("leaf"), F.when(chosen, leaf_digest(lowered)).alias("tampered"), F.col("source").isNotNull().cast("int").alias("source_known"), F.col("doc_id").isNotNull().cast("int").alias("known"))
    rows = save(rows, "digests")
    rows = rows.repartitionByRange(_pieces(spark, rows.count()), *_ORDER).withColumn("piece", F.spark_partition_id())
    rows = save(rows, "leaves")
    counts = rows.groupBy("piece", "source_known", "source").agg(F.count("*").alias("n"))
    tree = F.struct("source_known", "source")
    sizes = save(counts.groupBy(tree.alias("key")).agg(F.sum("n").alias("size")), "sizes")
    trees = sizes.count()
    numbered = _numbered(sizes, trees)
    here = Window.partitionBy("key").orderBy("piece")
    spans = counts.select("piece", tree.alias("key"), "n").withColumn("start", F.sum("n").over(here) - F.col("n"))
    spans = save(spans.join(numbered, "key").select("piece", "tree", "size", "start", "n"), "spans")
    if not trees:
        return spark.createDataFrame([], _PROOF)
    grown = rows.groupBy("piece").cogroup(spans.groupBy("piece")).applyInArrow(partial(_grown_with_piece, trees=trees), f"piece int, {_PIECE}")
    forest = save(grown, "forest")
    finished = [forest.where("done")]
    left = int(rows.agg(F.max("piece")).first()[0]) + 1

    def reduced(nodes: pa.Table) -> pa.Table:
        one = Forest(trees)
        one.merge(nodes)
        return _with_piece(nodes.column("piece")[0].as_py(), one.table())

    while True:
        left = -(-left // FAN)
        step = forest.where("not done").withColumn("piece", F.floor(F.col("piece") / FAN).cast("int"))
        forest = save(step.groupBy("piece").applyInArrow(reduced, f"piece int, {_PIECE}"), "forest")
        finished.append(forest.where("done"))
        if left == 1:
            break
    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    runs = done.groupBy("tree", "level", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("children"))
    sent = _needed(spans, trees).join(runs, ["tree", "level", "run"]).select("piece", "tree", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n"), "level", "run", "children")
    side = spans.select("piece", "tree", "size", "start", "n", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("run"), F.lit(None).cast("array<string>").alias("children"))
    return rows.groupBy("piece").cogroup(side.unionByName(sent).groupBy("piece")).applyInArrow(partial(_proved, trees=trees), _PROOF)


def _numbered(sizes: DataFrame, trees: int) -> DataFrame:
    """``key, size, tree``: the sources numbered in order, null first. Numbers are counted in ranges of names, then the ranges are added up."""
    ranged = sizes.repartitionByRange(_pieces(sizes.sparkSession, trees), "key").withColumn("range", F.spark_partition_id())
    ranged = save(ranged, "ranges")
    counts = ranged.groupBy("range").agg(F.count("*").alias("c"))
    before = counts.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"))  # a row for some thousands of sources
    number = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    return ranged.join(before, "range").select("key", "size", (F.col("before") + number).cast("long").alias("tree"))


def _needed(spans: DataFrame, trees: int) -> DataFrame:
    """``piece, tree, level, run``: the runs on the paths from a piece's first and last leaf of each source to the root. Only these can reach beyond it."""
    ends = spans.select("piece", "tree", "size", F.explode(F.array("start", F.col("start") + F.col("n") - 1)).alias("index"))
    top = ends.select("piece", F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), F.col("tree").alias("index")).distinct()
    levels_of = F.ceil(F.log(float(ARITY), F.col("size").cast("double"))).cast("int") + 1
    steps = ends.unionByName(top).select("piece", "tree", "index", F.explode(F.sequence(F.lit(0), levels_of)).alias("level"))
    return steps.select("piece", "tree", "level", F.floor(F.col("index") / F.pow(F.lit(float(ARITY)), F.col("level") + 1)).cast("long").alias("run")).distinct()


def _with_piece(piece: int, table: pa.Table) -> pa.Table:
    return table.add_column(0, "piece", pa.array([piece] * table.num_rows, pa.int32()))


def _grown_with_piece(key: tuple, leaves: pa.Table, spans: pa.Table, trees: int) -> pa.Table:
    return _with_piece(key[0].as_py(), _grown(leaves, spans, trees))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable] = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {
    "op11_merkle_manifest": r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), told AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0 AS chosen FROM documents, steps
), fields AS (
  SELECT doc_id, source, chosen, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low FROM told
), leaves AS (
  SELECT doc_id, sha256(head || body) AS leaf, sha256(head || CASE WHEN chosen THEN low ELSE body END) AS tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM fields
), own AS (
  SELECT tree, 0 AS level, place, leaf AS h, n FROM leaves
  UNION ALL SELECT tree, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16 FROM own WHERE n > 1 GROUP BY tree, level, place // 16, n
), top AS (
  SELECT 0 AS level, tree AS place, h, count(*) OVER () AS n FROM own WHERE n = 1
  UNION ALL SELECT level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, place // 16, n
), nodes AS (
  SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT tree, level, place, h, n FROM own UNION ALL SELECT -1, level, place, h, n FROM top) WINDOW w AS (PARTITION BY tree, level, place // 16 ORDER BY place)
), path AS (
  SELECT doc_id, leaf, l.tree, tampered, list({'l': s.l, 'h': '', 'r': s.r} ORDER BY s.tree = -1, s.level) AS steps FROM leaves l
  JOIN nodes s ON s.n > 1 AND (s.tree = l.tree AND s.place = l.place // (16 ** s.level)::BIGINT OR s.tree = -1 AND s.place = l.tree // (16 ** s.level)::BIGINT) GROUP BY ALL
), folded AS (
  SELECT *, sha256(array_to_string(list_transform(steps, lambda x: x.l || x.r), '')) AS proof_sha256,
    list_reduce(list_prepend({'l': '', 'h': tampered, 'r': ''}, steps), lambda a, b: {'l': '', 'h': sha256(b.l || a.h || b.r), 'r': ''}).h AS folded_root FROM path
)
SELECT doc_id, leaf, o.h AS subroot, top.h AS root, proof_sha256, folded_root, folded_root = top.h AS verified FROM folded JOIN own o ON o.tree = folded.tree AND o.n = 1 JOIN top ON top.n = 1"""
}
