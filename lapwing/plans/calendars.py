"""Queries that write lines of orders as calendars and read them back. An order has few lines, so no page is large."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.plans.registry import query
from lapwing.sources import calendars
from lapwing.sources.results import table

_NAMES = ("Harbour Front 10 Mile", "Pearl & Sons Trail Run", "Harbour Front Twilight Meet", "Cape to Cabot 20 km", "School Day", "Summer Games", "Quiet Walk")
_ALIASES = (("harbour front", "harbour-front"), ("cape to cabot", "cape-to-cabot"))
_FAMILIES = ("harbour-front", None, None, "cape-to-cabot", None, None, None)
_SKIPPED = (None, "a different sport (trail)", "track and field (twilight)", None, "a different sport (school)", "track and field (games)", calendars.UNKNOWN)


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "][l_partkey % 7 + 1]"


_EVENTS = f""" e AS (SELECT l_orderkey AS page_id, l_suppkey % 4 AS k, (1990 + l_orderkey % 10)::INT AS y, (10 + l_linenumber)::INT AS d, l_partkey % 3 > 0 AS linked, {_list(_NAMES)} AS name, {_list(_FAMILIES)}::VARCHAR AS family, {_list(_SKIPPED)}::VARCHAR AS skipped, l_partkey FROM lineitem WHERE l_orderkey % 11 > 0 AND l_linenumber <> 5
), events_ AS (SELECT page_id, CASE k WHEN 0 THEN make_date(y, 10, d) WHEN 1 THEN make_date(y, 6, d) WHEN 3 THEN make_date(y, 3, d) END AS date, CASE WHEN k = 1 THEN make_date(y, 6, d + 1) END AS "end", name, CASE WHEN linked THEN 'Town ' || l_partkey ELSE '' END AS place, CASE WHEN linked THEN '/e/' || l_partkey END AS url, family, skipped, CASE WHEN k = 2 THEN 'no date' END AS problem FROM e
  UNION ALL SELECT DISTINCT l_orderkey, NULL::DATE, NULL::DATE, NULL, NULL, NULL, NULL, NULL, 'no year in the heading' FROM lineitem WHERE l_orderkey % 11 = 0)"""


def _pages(spark, sf_dir):
    """One page an order: each eleventh without a heading, and each fifth line of an order without a badge."""
    text = lambda c: F.col(c).cast("string")
    name = F.element_at(F.array(*[F.lit(n.replace("&", "&amp;")) for n in _NAMES]), (F.col("l_partkey") % 7 + 1).cast("int"))
    day, k = lambda more: (F.col("l_linenumber") + 10 + more).cast("string"), F.col("l_suppkey") % 4
    days = F.when(k == 0, F.concat(F.lit("Sun, Oct "), day(0))).when(k == 1, F.concat(F.lit("Fri, June "), day(0), F.lit("-Sat, jun "), day(1))).when(k == 2, "TBD").otherwise(F.concat(F.lit("Mon, Mar "), day(0)))
    badge = F.when(F.col("l_linenumber") == 5, "").otherwise(F.concat(F.lit('<span class="badge day">'), days, F.lit("</span> ")))
    what = F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("<a class='x' href='/e/"), text("l_partkey"), F.lit("'><b>"), name, F.lit("</b></a>, Town "), text("l_partkey"))).otherwise(name)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.struct("l_linenumber", F.concat(F.lit("<tr><td>"), badge, what, F.lit("</td></tr>")).alias("t")).alias("line"))
    head = F.when(F.col("page_id") % 11 > 0, F.concat(F.lit("<table><tr><th>Race Calendar "), (F.col("page_id") % 10 + 1990).cast("string"), F.lit("</th></tr>\n"))).otherwise("<table>\n")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["t"]), "\n")
    return rows.groupBy("page_id").agg(lines.alias("lines")).select("page_id", F.concat(head, "lines", F.lit("</table>")).alias("html"))


@query(_EVENTS + " SELECT * FROM events_", with_results=False)
def calendar_events(spark, sf_dir):
    return calendars.calendar(_pages(spark, sf_dir), _ALIASES).drop("line")


@query(_EVENTS + " SELECT coalesce(problem, skipped, 'road race') AS outcome, count(*) AS rows, min(date) AS first, max(date) AS last FROM events_ GROUP BY ALL", with_results=False)
def calendar_outcomes(spark, sf_dir):
    """Every row of the pages, by what became of it."""
    events = calendars.calendar(_pages(spark, sf_dir), _ALIASES)
    return events.groupBy(F.coalesce("problem", "skipped", F.lit("road race")).alias("outcome")).agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))
