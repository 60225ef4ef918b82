"""Calendars of a season against what their pages say."""

from datetime import date

from lapwing.sources import calendars

ALIASES = (("pond", "pond-road"),)


def test_calendar(spark):
    row = lambda badge, rest: f'<tr><td><span class="badge">{badge}</span>{rest}</td></tr>'
    good = "<table><th>Our Calendar 2024</th>" + "".join([
        row("Thu, Feb 29", "<a id='x' href='/p'>Pond&nbsp;Mile &amp; more</a>, Bay, "),
        row("Fri, December 31-Wed, Jan 1", "Pond Meet"),
        row("soon", "Pond Walk"),
        row("Sun, May 5", " , "),
        "<tr><td>no badge</td></tr>",
        row("Sun, May 5", "Something new"),
    ]) + "</table>"
    pages = spark.createDataFrame([("a", good, 1), ("b", "<th>Calendar</th>" + row("Sun, May 5", "Pond"), 2), ("c", None, 3), ("d", "", 4)], "page_id string, html string, line int")
    events = calendars.calendar(pages, ALIASES)
    got = sorted((tuple(r) for r in events.collect()), key=lambda r: (r[0], -1 if r[1] is None else r[1]))
    assert got == [
        ("a", 0, date(2024, 2, 29), None, "Pond Mile & more", "Bay", "/p", "pond-road", None, None),
        ("a", 1, date(2024, 12, 31), date(2024, 1, 1), "Pond Meet", "", None, None, "track and field (meet)", None),
        ("a", 2, None, None, "Pond Walk", "", None, "pond-road", None, "no date"),
        ("a", 5, date(2024, 5, 5), None, "Something new", "", None, None, calendars.UNKNOWN, None),
        ("b", None, None, None, None, None, None, None, None, "no year in the heading"),
        ("d", None, None, None, None, None, None, None, None, "no year in the heading"),
    ]
    assert [r.name for r in calendars.unread(events).collect()] == ["Something new", "Pond Meet"]
    assert calendars.calendar(pages.limit(0), ALIASES).count() == 0


def test_pages_are_read_once_and_odd_days(spark, capsys):
    row = lambda badge, rest: f'<tr><td><span class="badge">{badge}</span>{rest}</td></tr>'
    html = "<th>Calendar 2023</th>" + row("Feb 29", "Pond A") + row("x, JUNE\t07 - May 31", "<a href=''></a>") + row("May 0", "Pond\u00a0 B<br>\tC &amp;lt;") + row("Sept 5-Sep 5-<i>Mar 10</i>", "<a name='n'>Pond D</a>,") + row("Marc 1", ", Pond  E ,")
    early = "<th>Calendar 0999</th>" + row("May 1", "Pond")
    pages = spark.createDataFrame([("a", html), ("b", "<th>Calendar 2023</th>"), ("c", early)], "page_id string, html string")
    events = calendars.calendar(pages, ALIASES)
    got = [(r.page_id, r.line, r.date, r.end, r.name, r.url, r.problem) for r in events.orderBy("page_id", "line").collect()]
    assert got == [
        ("a", 0, None, None, "Pond A", None, "no date"),
        ("a", 2, None, None, "Pond\u00a0 B C &lt;", None, "no date"),
        ("a", 3, date(2023, 9, 5), date(2023, 3, 10), "Pond D", None, None),
        ("a", 4, None, None, "Pond  E".replace("  ", " "), None, "no date"),
        ("c", 0, None, None, "Pond", None, "no date"),
    ]
    events.explain()
    assert capsys.readouterr().out.count("Scan ") == 1
