"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Every document of a source is expected in target / source_size copies. The
documents of a source stand in one order, their expected copies are summed up
along it from a random offset on, and a document is taken once for each integer
that its own share of the sum crosses. As the order is by size first, the taken
words follow the target closely.

A sum along a whole source would be one task's work. So the order runs through
groups of (size class, one of ``SPREAD`` hash values of doc_id): rows are
numbered within a group only, and groups are summed up along their source. The
number of groups of a source doesn't depend on the number of its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwing.llm.storage import save

#: Weights of the sources in the order of their names, again and again.
WEIGHTS = (3, 1, 2)
#: Taken words of all words; copies of a document at most.
SHARE, MOST = 1.5, 2.0
SPREAD = 256
SEED = "mix-1"


def _uniform(text: Column) -> Column:
    """A number in [0, 1) that the text alone decides."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def words_in(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from rows (source, size): all words shared out by weight, no target above ``most`` times its source.

    Sources are filled up together: those of the least cap for their weight end
    first, and the others go on alike. Runs over one row a source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    totals = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(on)
    totals = totals.withColumn("level", level)
    # The first source that the level of what is left does not fill sets the level of it and of all after it.
    full = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return totals.select("source", "source_size", F.coalesce(F.least(F.col("cap"), full["level"] * F.col("weight")), F.col("cap")).alias("target"))


def mixture(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs`` (doc_id, text, source).

    A size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text; null and blank texts
    have 0 and take 0 words. Null is a source of its own, the last one. Rows of
    one doc_id are ordered by size and may be taken in either's place; a null
    doc_id comes first. An empty table gives an empty one. Other columns are not
    looked at. The result depends on the rows alone, not on their places.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    sized = save(sized, "sizes")
    bits = F.length(F.bin("size"))
    eighth = F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")
    group = [F.when(F.col("size") == 0, -1).otherwise(bits * 8 + eighth).cast("int").alias("class"), F.pmod(F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(SEED))), 1, 8), 16, 10).cast("long"), F.lit(SPREAD)).cast("int").alias("spread")]
    rows = sized.withColumn("key", F.struct("source")).select("*", *group)
    counts = rows.groupBy("key", "class", "spread").agg(F.count("*").alias("count"))
    before = F.sum("count").over(Window.partitionBy("key").orderBy("class", "spread")) - F.col("count")
    goal = targets(sized).select(F.struct("source").alias("key"), "source_size", "target")
    groups = save(counts.withColumn("before", before).drop("count").join(goal, "key"), "groups")
    numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy("key", "class", "spread").orderBy("size", "doc_id")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST))).otherwise(0.0)
    offset = _uniform(F.concat(F.coalesce(F.concat(F.lit("s"), F.col("key.source")), F.lit("null")), F.lit(SEED)))
    place = F.col("before") + F.col("number")
    copies = (F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))).cast("long")
    out = numbered.join(groups, ["key", "class", "spread"]).withColumns({"rate": rate, "offset": offset})
    out = out.withColumn("copies", F.least(copies, F.lit(int(MOST)).cast("long")))
    return out.select("doc_id", F.col("key.source").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op6_systematic_mix(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies", "source")


QUERIES: dict[str, Callable] = {"op6_systematic_mix": op6_systematic_mix}
ORACLES = {
    "op6_systematic_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source
), weighted AS (
  SELECT source, s, 2 * s AS cap, [3.0, 1.0, 2.0][1 + (k - 1) % 3]::DOUBLE AS w FROM totals
), leveled AS (
  SELECT *, cap / w AS r,
    (sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), goal AS (
  SELECT source, s, least(cap, w * coalesce((SELECT min_by(level, r) FROM leveled WHERE level * w <= cap), cap / w)) AS target FROM leveled
), rowed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
      CASE WHEN size = 0 THEN -1 ELSE length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)::BIGINT) END,
      ('0x' || substr(md5(doc_id::VARCHAR || 'mix-1'), 1, 8))::BIGINT % 256, size, doc_id) AS place,
    ('0x' || substr(md5(coalesce('s' || source, 'null') || 'mix-1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized
), rated AS (
  SELECT *, CASE WHEN s > 0 THEN least(target / s, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS e
  FROM rowed JOIN goal ON rowed.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, s::BIGINT AS source_size, target,
  size * least(2, floor(place * e + u) - floor((place - 1) * e + u))::BIGINT AS taken FROM rated
"""
}
