"""Results, readings and lists as others hand them out: JSON, HTML tables, delimited text, headed lists. One text is one row; its lines become rows in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What columns of exports are called. One that is neither here nor passed over is refused.
COLUMNS = {
    "place": "place", "pos": "place", "position": "place", "bib": "bib", "name": "name", "full name": "name", "first name": "first", "first": "first", "last name": "last", "last": "last",
    "sex": "sex", "gender": "sex", "city": "hometown", "hometown": "hometown", "time": "gun", "gun time": "gun", "chip time": "chip", "net time": "chip", "club": "club", "team": "club",
}
PASSED_OVER = ("pace", "country", "age")
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain(text: Column) -> Column:
    """Text of HTML: no tags, named entities as characters, spaces closed up."""
    out = F.regexp_replace(text, "<[^>]*>", " ")
    for name, character in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(character))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sex(text: Column) -> Column:
    """M or F by the first letter, null for anything else."""
    first = F.upper(F.substring(F.trim(text), 1, 1))
    return F.when(first.isin("M", "F"), first)


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def full_name(row: Column) -> Column:
    """The whole name, or both its parts."""
    get = lambda k: F.nullif(F.trim(F.try_element_at(row, F.lit(k))), F.lit(""))
    return F.coalesce(get("name"), F.nullif(F.concat_ws(" ", get("first"), get("last")), F.lit("")))


def json_results(pages: DataFrame) -> DataFrame:
    """``page_id, place, name, sex, seconds`` of each object in the ``data`` array of a page's JSON (page_id, body); a page that isn't JSON has none."""
    schema = "data array<struct<place: int, name: string, gender: string, seconds: double>>"
    rows = pages.select("page_id", F.explode(F.from_json("body", schema)["data"]).alias("d"))
    return rows.select("page_id", "d.place", F.trim("d.name").alias("name"), sex(F.col("d.gender")).alias("sex"), "d.seconds")


def _headed(files: DataFrame, heads: Column) -> DataFrame:
    """Adds, once a file: ``width``, ``names`` of its columns (null: unknown) and ``reason`` with those that are unknown."""
    known = F.create_map(*[F.lit(x) for kv in (COLUMNS | {c: f"-{c}" for c in PASSED_OVER}).items() for x in kv])
    clean = F.transform(heads, lambda h: F.trim(F.regexp_replace(F.lower(h), "[^a-z0-9]+", " ")))
    rows = files.withColumn("clean", clean).withColumn("names", F.transform("clean", lambda h: F.try_element_at(known, h)))
    unknown = F.array_join(F.filter("clean", lambda h: F.try_element_at(known, h).isNull()), ", ")
    rows = rows.withColumns({"width": F.size("clean"), "reason": F.when(F.exists("names", lambda n: n.isNull()), F.concat(F.lit("unknown columns: "), unknown))})
    return rows.drop("clean")


def _named(rows: DataFrame, cells: Column) -> DataFrame:
    """``row`` as a map of known columns, null where there is a reason."""
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.col("width"))), 1, F.col("width"))
    pairs = F.map_from_entries(F.filter(F.arrays_zip(F.col("names").alias("k"), padded.alias("v")), lambda e: e["k"].isNotNull()))
    return rows.withColumn("row", F.when(F.col("reason").isNull(), pairs)).select("page_id", "number", "row", "reason")


def html_rows(pages: DataFrame) -> DataFrame:
    """``page_id, number, row, reason`` of each line of a page's table (page_id, body) under its first row, which names the columns."""
    lines = F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda line: F.transform(F.regexp_extract_all(line, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), plain)
    # The head is read before lines become rows; beside the explode it would be read again for each of them.
    rows = _headed(pages.withColumn("lines", lines), cells(F.get("lines", 0)))
    rows = rows.select("page_id", "names", "width", "reason", F.posexplode("lines").alias("number", "line")).where("number > 0")
    return _named(rows, cells(F.col("line")))


def delimited_rows(files: DataFrame) -> DataFrame:
    """``page_id, number, row, reason`` of each line of a file (page_id, body) under its first. Fields are parted by what the first line has most of: tabs, semicolons or commas; none holds its separator."""
    head = F.get(F.split("body", r"\r?\n"), 0)
    counts = [F.struct(F.length(head) - F.length(F.replace(head, F.lit(s))), F.lit(s).alias("s")) for s in ("\t", ";", ",")]
    rows = _headed(files.withColumn("sep", F.greatest(*counts)["s"]), F.split(head, F.col("sep")))
    rows = rows.select("page_id", "sep", "names", "width", "reason", F.posexplode(F.split("body", r"\r?\n")).alias("number", "line")).where("number > 0 and trim(line) <> ''")
    return _named(rows, F.split("line", F.col("sep")))


def headed_lists(pages: DataFrame) -> DataFrame:
    """``page_id, number, event, sex, name, town`` of each item of a page's lists (page_id, body). A heading holds for the items below it: the event, and the sex in brackets; ``Surname, Given`` is turned round."""
    parts = F.regexp_extract_all("body", F.lit(r"(?is)<(?:h\d|li)[^>]*>.*?</(?:h\d|li)>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(parts).alias("number", "part"))
    head = F.when(F.lower("part").startswith("<h"), plain(F.col("part")))
    rows = rows.withColumn("head", F.last(head, ignorenulls=True).over(Window.partitionBy("page_id").orderBy("number"))).where("lower(part) like '<li%'")
    item = F.split(plain(F.col("part")), " - ", 2)
    name = F.regexp_replace(F.get(item, 0), r"^([^,]*),\s*(.*)$", "$2 $1")
    return rows.select("page_id", "number", F.trim(F.regexp_replace("head", r"\([^)]*\)", "")).alias("event"), sex(F.nullif(F.regexp_extract("head", r"\(([^)]*)\)", 1), F.lit(""))).alias("sex"), F.trim(name).alias("name"), F.nullif(F.trim(F.get(item, 1)), F.lit("")).alias("town"))
