"""Queries that write lines of orders as exports and read them back. An order has seven lines at most, so no text is large."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions import printed
from lapwing.plans.registry import query
from lapwing.sources import exports
from lapwing.sources.results import table


def _pages(spark, sf_dir, line, before, after, sep):
    """One text an order, of ``line`` for each of its lines in order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.struct("l_linenumber", line.alias("t")).alias("line"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["t"]), sep)
    return rows.groupBy("page_id").agg(F.concat(F.lit(before), lines, F.lit(after)).alias("body"))


_NAME = "'Ann ' || l_partkey || ' O''Hara & ' || l_suppkey"
def _who():
    return F.concat(F.lit("Ann "), F.col("l_partkey").cast("string"), F.lit(" O'Hara & "), F.col("l_suppkey").cast("string"))


def _time():
    return F.concat((F.floor(F.col("l_quantity").cast("int") / 60) + F.col("l_linenumber")).cast("string"), F.lit(":"), F.lpad((F.col("l_quantity").cast("int") % 60).cast("string"), 2, "0"))


_SECONDS = "(l_quantity::INT // 60 + l_linenumber) * 60 + l_quantity::INT % 60"


@query(f""" z AS (SELECT 1) SELECT l_orderkey AS page_id, l_linenumber AS place, {_NAME} AS name, CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'R' THEN 'F' END AS sex, l_quantity::DOUBLE AS seconds FROM lineitem""", with_results=False)
def json_results(spark, sf_dir):
    gender = F.when(F.col("l_returnflag") == "A", "Male").when(F.col("l_returnflag") == "R", "female").otherwise("")
    line = F.to_json(F.struct(F.col("l_linenumber").cast("int").alias("place"), _who().alias("name"), gender.alias("gender"), F.col("l_quantity").cast("double").alias("seconds")))
    return exports.json_results(_pages(spark, sf_dir, line, '{"data": [', "]}", ","))


def _typed(rows):
    get = lambda k: F.try_element_at("row", F.lit(k))
    return rows.select("page_id", printed.integer(get("place")).alias("place"), exports.full_name(F.col("row")).alias("name"), F.nullif(get("hometown"), F.lit("")).alias("hometown"), printed.seconds(get("gun")).alias("seconds"), "reason")


@query(f""" z AS (SELECT 1) SELECT l_orderkey AS page_id, l_linenumber AS place, {_NAME} AS name, l_linestatus AS hometown, ({_SECONDS})::DOUBLE AS seconds, NULL::VARCHAR AS reason FROM lineitem""", with_results=False)
def html_results(spark, sf_dir):
    """Tables of pages, with entities and tags inside cells."""
    cell = lambda c: F.concat(F.lit("<td class='x'>"), c, F.lit("</td>"))
    who = F.concat(F.lit("<b>"), F.replace(F.replace(_who(), F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;")), F.lit("</b>"))
    line = F.concat(F.lit("<tr>"), cell(F.col("l_linenumber").cast("string")), cell(who), cell(F.col("l_linestatus")), cell(_time()), F.lit("</tr>"))
    return _typed(exports.html_rows(_pages(spark, sf_dir, line, "<table><tr><th>Place</th><th>Name</th><th>City</th><th>Gun Time</th></tr>", "</table>", "\n")))


@query(f""" z AS (SELECT 1) SELECT l_orderkey AS page_id, CASE WHEN l_orderkey % 4 > 0 THEN l_linenumber END AS place, CASE WHEN l_orderkey % 4 > 0 THEN {_NAME} END AS name, CASE WHEN l_orderkey % 4 > 0 THEN l_linestatus END AS hometown, CASE WHEN l_orderkey % 4 > 0 THEN ({_SECONDS})::DOUBLE END AS seconds, CASE WHEN l_orderkey % 4 = 0 THEN 'unknown columns: shoe size' END AS reason FROM lineitem""", with_results=False)
def delimited_results(spark, sf_dir):
    """Exports with tabs, semicolons or commas; an unknown column refuses the file and is named."""
    first = F.regexp_extract(_who(), r"^(\S+)", 1)
    line = F.concat_ws("\x01", F.col("l_linenumber").cast("string"), first, F.regexp_replace(_who(), r"^\S+\s", ""), F.col("l_linestatus"), _time(), F.lit("x"))
    pages = _pages(spark, sf_dir, line, "Pos\x01First Name\x01Last Name\x01Hometown\x01Time\x01@\n", "\n", "\n")
    body = F.replace(F.col("body"), F.lit("@"), F.when(F.col("page_id") % 4 == 0, "Shoe size").otherwise("Pace"))
    sep = F.element_at(F.array(F.lit("\t"), F.lit(";"), F.lit(",")), (F.col("page_id") % 3 + 1).cast("int"))
    return _typed(exports.delimited_rows(pages.select("page_id", F.replace(body, F.lit("\x01"), sep).alias("body"))))


@query(""" z AS (SELECT 1) SELECT l_orderkey AS page_id, CASE WHEN l_orderkey % 2 = 0 THEN 'Bay 5 km' ELSE 'Hill 10 km' END AS event, CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
  'Ann ' || l_partkey || ' Hara' AS name, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS town FROM lineitem""", with_results=False)
def headed_lists(spark, sf_dir):
    """Lists of entrants under a heading that gives the event and the sex."""
    town = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" - "), F.col("l_linestatus"))).otherwise("")
    line = F.concat(F.lit("<li>Hara, Ann "), F.col("l_partkey").cast("string"), town, F.lit("</li>"))
    pages = _pages(spark, sf_dir, line, "<h3>@</h3><ul>", "</ul>", "\n")
    even = F.col("page_id") % 2 == 0
    heading = F.concat(F.when(even, "Bay 5 km").otherwise("Hill 10 km"), F.when(F.col("page_id") % 3 == 0, "").when(even, " (Male)").otherwise(" (F)"))
    return exports.headed_lists(pages.select("page_id", F.replace("body", F.lit("@"), heading).alias("body"))).drop("number")
