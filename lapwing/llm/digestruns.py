"""Exact duplicates by merging sorted runs of digests in binomial rounds, in DataFrame operations alone.

Every input partition belongs to one of ``2 ** bits`` slots and holds a run: its
distinct texts, sorted by a 64-bit digest, with the identifier that stays and
the number of rows. In a round the ``2 ** FAN_BITS`` slots that differ in one group of bits
exchange their runs: each takes the share of digests whose own bits name it, and
merges the runs that it is sent. After as many rounds as there are groups, equal
digests of all slots have met, and no slot holds more than its share.

A digest only sorts. Texts are the same entry if the length and the SHA-256 of
the lower-cased text agree too, which is verified whenever entries meet; of the
identifiers that meet, the one to be kept stays. Entries of one text are merged
at every level, so a text that a third of all rows hold is one entry a slot.

What was found goes back the way that the runs came: each level is joined to the
one above it by (slot, digest), where a key has ``2 ** FAN_BITS`` entries at most,
and rows are joined to the run of their own slot. No key has all copies of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.storage import save

#: A round merges the runs of 2 ** FAN_BITS slots; there are 2 ** LEAST_BITS slots, or more if shuffles have more partitions.
FAN_BITS, LEAST_BITS = 3, 6

_TEXT = ["digest", "sha", "n_bytes"]


def normal(text: Column) -> Column:
    """The text with A-Z lowered and nothing else changed; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _rounds(bits: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each round."""
    return [(at, min(FAN_BITS, bits - at)) for at in range(0, bits, FAN_BITS)]


def _after(at: int, width: int) -> Column:
    """The slot that takes an entry in a round: its own bits but for those of the round, which are the digest's."""
    taken = F.shiftrightunsigned("digest", at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.col("slot").bitwiseAND(F.lit(~(((1 << width) - 1) << at)).cast("long")).bitwiseOR(F.shiftleft(taken, at))


def exact_duplicates(docs: DataFrame, keep: str = "largest", bits: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (doc_id, text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty,
    so null and empty texts are one group. Of a group the row of the ``largest``
    (or ``smallest``) doc_id stays; a null doc_id stays only if the group has no
    other. Rows of one doc_id are rows of their own, and exactly one row of a group is kept.
    An empty table gives an empty one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    bits = bits or max(LEAST_BITS, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    best = {"largest": F.max, "smallest": F.min}[keep]
    text = normal(docs["text"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("digest"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("slot"))
    rows = save(rows, "digests")
    mine = F.struct((F.col("doc_id").isNull() == F.lit(keep == "smallest")).alias("known"), "doc_id", "row")

    def merged(entries: DataFrame) -> DataFrame:
        """One entry for each text of a slot: sorted runs in, a sorted run out."""
        return save(entries.groupBy("slot", *_TEXT).agg(best("best").alias("best"), F.sum("size").alias("size")), "runs")

    levels = [merged(rows.select("slot", *_TEXT, mine.alias("best"), F.lit(1).cast("long").alias("size")))]
    for at, width in _rounds(bits):
        levels.append(merged(levels[-1].withColumn("slot", _after(at, width))))
    found = levels.pop()
    for (at, width), level in zip(reversed(_rounds(bits)), reversed(levels), strict=True):
        above = found.withColumnRenamed("slot", "above")
        found = level.select("slot", *_TEXT, _after(at, width).alias("above")).join(above, ["above", *_TEXT]).drop("above")
    out = rows.join(found, ["slot", *_TEXT])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op12_digest_run_merge(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable] = {"op12_digest_run_merge": op12_digest_run_merge}
ORACLES = {
    "op12_digest_run_merge": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS n FROM documents
), g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)"""
}
