"""What goes out: list items of pages, digests, documents, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_items(pages: DataFrame) -> DataFrame:
    """``page_id, items, heading``: the number of list items of a page and the text of its first heading."""
    items = F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    return pages.select("page_id", F.size(items).alias("items"), F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("heading"))


def listing_digest(pages: DataFrame) -> DataFrame:
    """A digest of a page's list items in order, to tell whether a list has changed."""
    items = F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    return pages.select("page_id", F.sha2(F.array_join(items, "\n"), 256).alias("digest"))


def redact(rows: DataFrame, hidden, order: list[str]) -> DataFrame:
    """Names of hidden rows become ``Runner k``, numbered down each race."""
    own = rows.withColumn("hidden", hidden)
    number = F.row_number().over(Window.partitionBy("race_id", "hidden").orderBy(*order))
    return own.withColumn("name", F.when(F.col("hidden"), F.concat(F.lit("Runner "), number.cast("string"))).otherwise(F.col("name")))
