"""Results kept by the fingerprint of what they were computed from, so that only what changed is computed again.

Inputs fall into blocks. A block's fingerprint is a sum of hashes of its rows, which any
order and any partitioning gives alike; results are Parquet partitions, one a block, that are
replaced alone, and every row carries the fingerprint it was computed for. An index says
which fingerprint of each block counts. It is written after the results: what a lost job
left behind has another fingerprint than the index and is neither read nor trusted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_INDEX = "fingerprint string, generation int, block string"


def fingerprints(inputs: DataFrame, block: Column, upto: bool = False) -> DataFrame:
    """``block, fingerprint`` of every block of the inputs: of its own rows, or with ``upto`` of its rows and those of all blocks that sort before it.

    Rows are hashed with the names of their columns; repeated rows count as often as they are there. A null block is named ``null``.
    """
    columns = sorted(inputs.columns)
    told = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    number = lambda at: F.conv(F.substring(F.md5(told), at, 15), 16, 10).cast("decimal(38,0)")
    rows = inputs.select(F.coalesce(block.cast("string"), F.lit("null")).alias("block"), number(1).alias("a"), number(17).alias("b"))
    sums = rows.groupBy("block").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    if upto:
        before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)  # a row a block
        sums = sums.select("block", *[F.sum(c).over(before).alias(c) for c in ("n", "a", "b")])
    return sums.select("block", F.md5(F.concat_ws(":", F.lit(",".join(columns)), *[F.col(c).cast("string") for c in ("n", "a", "b")])).alias("fingerprint"))


class BlockStore:
    """A folder of results by block, which every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _replace(self, rows: DataFrame, name: str) -> None:
        rows = rows.withColumn("block", F.concat(F.lit("b"), "block"))  # a letter, so that no reader takes it for a number or a date
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{self.path}/{name}")

    def index(self) -> DataFrame:
        """``block, fingerprint, generation``: how often each block was computed, and for what."""
        if not self._there("index"):
            return self.spark.createDataFrame([], _INDEX)
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/index").withColumn("block", F.substring("block", 2, 1 << 30))

    def refresh(self, inputs: DataFrame, block: Column, compute: Callable[[DataFrame], DataFrame], upto: bool = False, still_open: Column | None = None) -> DataFrame:
        """``compute`` of the inputs, with the column ``block``: computed for the blocks whose inputs changed, read for the others.

        ``compute`` takes rows with their ``block`` (string) and returns rows with it; it must treat blocks apart. With ``upto`` it
        gets the rows of earlier blocks too, in ``block_of`` the block that each row is of and in ``block`` the one that it is wanted for. Where
        ``still_open`` holds for a ``block``, the period isn't over: it is computed again in any case. Blocks that are gone from the inputs aren't read.
        """
        now = fingerprints(inputs, block, upto)
        known = self.index()
        same = known.withColumnRenamed("fingerprint", "had")
        wanted = now.join(same, "block", "left")
        new = F.col("had").isNull() | (F.col("had") != F.col("fingerprint"))
        if still_open is not None:
            new = new | still_open
        stale = wanted.where(new).select("block", "fingerprint", (F.coalesce("generation", F.lit(0)) + 1).alias("generation")).collect()  # a row a changed block
        if stale:
            changed = self.spark.createDataFrame([tuple(r) for r in stale], "block string, fingerprint string, generation int")
            named = inputs.withColumn("block_of" if upto else "block", F.coalesce(block.cast("string"), F.lit("null")))
            if upto:
                rows = named.join(changed.select("block"), F.col("block_of") <= F.col("block"))
            else:
                rows = named.join(changed.select("block"), "block", "left_semi")
            self._replace(compute(rows).join(changed.select("block", "fingerprint"), "block"), "rows")
            self._replace(changed, "index")
        return self.read(now)

    def read(self, now: DataFrame) -> DataFrame:
        """The results of the blocks and fingerprints in ``now``."""
        rows = self.spark.read.parquet(f"{self.path}/rows").withColumn("block", F.substring("block", 2, 1 << 30))
        return rows.join(now.select("block", "fingerprint"), ["block", "fingerprint"], "left_semi").drop("fingerprint")
