"""Printed pages, spellings and people on small tables made by hand."""

from datetime import date

from pyspark.sql import functions as F

from lapwing.functions import printed
from lapwing.operators import resolve as people
from lapwing.sources.pages import printed_results

LONG = """<pre>POS   BIB   NAME              TIME     F/M     AGE     HOMETOWN
----- ----- ---------------   -------- ------- ------- ----------
    1    12 Ada Quay (ABC)    31:05    M(1)    30-39   Port &amp; Co
    2   340 Wilhelmina Anders 1:02:33  F(1)    U20     Ferry
    3    41 Bo Lee            DNF      F(2)    80+     
----- ----- ---------------   -------- ------- ------- ----------
</pre>"""
CHIP = """<pre>O'all               Gun     Class      Chip
Place  Bib   Name   Time    Placing    Time   City
----- ----- ------ ------- ---------- ------ ------
    1  7    Ida     50:28   M25-29  1  50:20 Ferry
    2  9    Jo      51:00   F20-24  1  50:59 Quay
    3  11   Wilhelmi51:30   F20-24  2  51:20 Quay
</pre>"""
ODD = "<pre>POS   SHOE\n----- -----\n    1    42\n    2    43\n</pre>"


def test_printed_pages(spark):
    pages = spark.createDataFrame([("a", LONG), ("b", CHIP), ("c", ODD), ("d", None), ("e", "<p>no table</p>")], "page_id string, html string")
    rows = {(r.page_id, r.line): r for r in printed_results(pages).collect()}
    assert len(rows) == 7
    a = rows["a", 0]
    assert (a.place, a.bib, a.name, a.club, a.seconds, a.sex, a.sex_place, a.age_band, a.hometown) == (1, 12, "Ada Quay", "ABC", 1865.0, "M", 1, "30-39", "Port & Co")
    assert rows["a", 2].seconds is None and rows["a", 2].hometown is None
    b = rows["b", 0]
    assert (b.place, b.bib, b.name, b.seconds, b.sex, b.age_band, b.hometown) == (1, 7, "Ida", 3020.0, "M", "25-29", "Ferry")
    assert rows["a", 1].name == "Wilhelmina Anders" and rows["a", 1].seconds == 3753.0
    assert (rows["b", 2].name, rows["b", 2].seconds, rows["b", 2].age_band) == ("Wilhelmi", 3080.0, "20-24")
    assert "shoe" in rows["c", None].problem and rows["c", None].place is None


def test_no_pages(spark):
    assert printed_results(spark.createDataFrame([], "page_id string, html string")).count() == 0


def test_spellings(spark):
    t = F.col("t")
    rows = spark.createDataFrame([("St. John’s",), ("Saint  Johns",), ("St. Johnâ\x80\x99s",), ("Zoë́ Ça",), (None,), ("",)], "t string")
    got = rows.select(printed.town_key(printed.repair(t)).alias("k"), printed.clean(printed.repair(t)).alias("c"), printed.name_key(t).alias("n")).collect()
    assert [r.k for r in got[:3]] == ["stjohns"] * 3
    assert [r.c for r in got[:3]] == ["St. John's", "Saint Johns", "St. John's"]
    assert got[3].n == "zoeca" and got[4].k == "" and got[4].n is None and got[5].n == ""
    times = spark.createDataFrame([("31:05",), ("1:02:33.5",), ("DNF",), ("",), ("100",), (None,)], "t string")
    assert [r[0] for r in times.select(printed.seconds(t)).collect()] == [1865.0, 3753.5, None, None, None, None]


def _resolved(spark, rows):
    table = spark.createDataFrame([(i, n, date(y, 6, 1), f"r{y}", s, b, h) for i, n, y, s, b, h in rows], "entry_id long, name string, race_date date, race_id string, sex string, age_band string, hometown string")
    return {r.entry_id: r for r in people.resolve(table).collect()}


def test_resolve(spark):
    rows = [
        (1, "Al Fox", 2010, "M", "20-29", "Ferry"),
        (2, "Al FOX", 2011, "M", "50-59", "Quay"),  # too old to be the first
        (3, "al fox", 2012, "M", None, "Quay"),  # fits both; the town decides
        (4, "Al Fox", 2013, "M", None, "Elsewhere"),  # fits both; held
        (5, "Al Fox", 2014, "M", "20-29", None),
        (6, "Bea Roe", 2010, "F", None, None),
        (7, "Bea Roe", 2011, "M", None, None),  # disagrees about sex
        (8, None, 2011, "M", None, None),
    ]
    got = _resolved(spark, rows)
    assert [got[i].runner for i in range(1, 9)] == ["alfox", "alfox#1", "alfox#1", "alfox#held#4", "alfox", "bearoe", "bearoe", ""]
    assert [got[i].ambiguous for i in range(1, 9)] == [False, False, False, True, False, True, True, False]
    assert got[4].candidates == 2
    assert {k: v.runner for k, v in _resolved(spark, rows[::-1]).items()} == {k: v.runner for k, v in got.items()}
    assert _resolved(spark, []) == {}


def test_two_way_finds_a_planted_effect(spark):
    rows = [(r, c, 2000 + k, 0.1 * r + e) for r in range(40) for k, (c, e) in enumerate([("flat", 0.0), ("hilly", 0.06)] * 2 if r % 2 else [("hilly", 0.06), ("flat", 0.0)] * 2)]
    got = {r.course: r for r in people.two_way(spark.createDataFrame(rows, "runner_id long, course string, year int, y double"), "course").collect()}
    assert abs(got["hilly"].effect - got["flat"].effect - 0.06) < 1e-3
    assert got["flat"].finishes == 80
    assert people.two_way(spark.createDataFrame([], "runner_id long, course string, year int, y double"), "course").count() == 0


def test_heads_are_not_read_again_for_each_line(spark):
    from lapwing.sources import exports

    rows = exports.html_rows(spark.createDataFrame([(1, "x")], "page_id long, body string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Generate")[0].count("<t[hd]") == 1
