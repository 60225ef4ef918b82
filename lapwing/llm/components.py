"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.storage import drop, save


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b: long): the smallest node that links reach.

    Alternates two steps, each a grouped minimum joined back to the edges, until
    the edges no longer change: every node hangs its larger neighbours on the
    smallest of its neighbours, then its smaller ones. The number of rounds
    grows with the logarithm of the longest chain. No group of neighbours is
    ever gathered, so a node with very many links costs no more than its rows.
    Rows with a null or with a = b, and repeated rows, add nothing.
    """
    now = save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = save(small.select("e.*").where("a <> b").distinct(), "edges")
        drop(now)
        row = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now, before, mark = after, mark, (row[0], row[1])
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
