"""A corpus pipeline of five stages over ``documents``: each takes what its predecessor kept.

Language ID rejects texts whose language cannot be told; of each group of
near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) one
document stays, the smallest doc_id; documents that hold a window of a benchmark
item go; the rest is mixed to the sources' target weights, a document being
repeated as often as it was drawn; and the texts are written as packed token
ids, of which the last stage returns each document's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm import decontam, langid, mixing, packing, partenum
from lapwing.llm.storage import new_path, save

#: A document stays if its language has at least this mean probability.
SURE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those of which no language is more likely than not."""
    network = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), network, keep=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group, once; texts without words are groups of their own, rows without a doc_id stay."""
    groups = save(partenum.jaccard_components(docs, n=5, similarity=(4, 5), parts=(2, 1)), "groups")
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)  # one shuffle at every size
    again = save(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of a benchmark item. Texts without words and rows without a doc_id that hold none stay."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("contaminated").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as it was drawn; those not drawn go.

    Rows of one doc_id, or of none, are drawn one by one: of those of one source
    and size, as many get each number of copies as were drawn.
    """
    docs = docs.select(*COLUMNS)
    drawn = save(mixing.mixture(docs).select("doc_id", "source", "size", "copies"), "drawn")
    ids = save(drawn.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("copies").alias("copies")), "ids")
    plain = docs.join(ids.where("doc_id is not null and rows = 1 and copies > 0").select("doc_id", "copies").hint("merge"), "doc_id").select(*COLUMNS, "copies")
    repeat = lambda rows: rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)
    odd = save(ids.where("doc_id is null or rows > 1").select(F.col("doc_id").alias("odd")), "odd")
    if odd.isEmpty():
        return repeat(plain)
    which = lambda rows: rows.join(odd, F.col("doc_id").eqNullSafe(F.col("odd")), "left_semi")
    turn = lambda *order: F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(*order))
    rows = which(docs).withColumn("size", mixing.words_in(F.col("text"))).withColumn("turn", turn("text", "lang", "n_chars"))
    own = which(drawn).withColumn("turn", turn("copies")).where("copies > 0").select(*[F.col(c).alias(c + "2") for c in ("doc_id", "source", "size", "turn")], "copies")
    same = [F.col(c).eqNullSafe(F.col(c + "2")) for c in ("doc_id", "source", "size", "turn")]
    return repeat(plain.unionByName(rows.join(own, same).select(*COLUMNS, "copies")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes packed ids and returns doc_id, start, n_tokens and ids_crc32, read back from them; an empty text has its end id alone."""
    path = new_path(spark, "packed")
    packing.write_packed(docs, path, packing.vocabulary(), 2)
    return packing.read_documents(spark, path)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("token_ids", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
