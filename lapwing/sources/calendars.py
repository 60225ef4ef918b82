"""Calendars of a season as web pages: a heading with the year, and one row a day with a badge, a name and a place."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.sources.exports import plain

# Words that say another sport, words that say track and field, months and their endings.
OTHER_SPORT = ("trail", "cross[- ]country", "xc", "school")
TRACK = ("track", "field", "trackfest", "tetrathlons?", "twilight", "clinic", "camp", "games", "indoor", "all[- ]comers", "meet")
MONTHS = {"jan": "uary", "feb": "ruary", "mar": "ch", "apr": "il", "may": "", "jun": "e", "jul": "y", "aug": "ust", "sep": "tember", "oct": "ober", "nov": "ember", "dec": "ember"}
UNKNOWN = "no course this project knows is named here"


def _word(name: Column, words: tuple[str, ...]) -> Column:
    """The first of the words in a name, in small letters; empty if none is there."""
    return F.lower(F.regexp_extract(name, rf"(?i)\b({'|'.join(words)})\b", 1))


def _family(name: Column, aliases: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(F.lower(name).contains(phrase), course) for phrase, course in aliases], F.lit(None).cast("string"))


def _days(badge: Column, year: Column) -> Column:
    """The days that a badge names (``Fri, Jun 5-Sat, Jun 6``), without those that can't be read. Weekdays aren't looked at."""
    known = rf"(?i)^(?:[^,]*,)?\s*((?:{'|'.join(m + '(?:' + rest + ')?' for m, rest in MONTHS.items())})\s+\d{{1,2}})\s*$"
    numbers = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS) for x in (m, k + 1)])
    month, number = lambda x: numbers[F.lower(F.left(x, F.lit(3)))], lambda x: F.right(x, F.lit(2)).try_cast("int")
    first = lambda x: F.make_date(year, month(x), F.lit(1))
    day = lambda x: F.when((x != "") & (year >= 1000) & number(x).between(1, F.dayofmonth(F.last_day(first(x)))), F.date_add(first(x), number(x) - 1))
    named = F.transform(F.split(badge, "-"), lambda x: F.regexp_extract(x, known, 1))
    return F.array_compact(F.transform(named, day))


def _plain(text: Column) -> Column:
    """``plain``, of which only the ends are left to do in a text without tags, entities and spaces other than single ones."""
    odd = [text.contains(x) for x in ("<", "&", "  ", "\t", "\n", "\v", "\f", "\r")]
    return F.when(reduce(or_, odd), plain(text)).otherwise(F.trim(text))


def _fields(row: Column) -> Column:
    """``badge, name, place, url`` of a row's text; null without a badge. Each step is an array of one, so that what two fields need is read once."""
    link = r"(?s)<a\s[^>]*href=['\"]([^'\"]*)['\"][^>]*>(.*?)</a>"
    after = lambda text, tag: F.substr(text, F.locate(tag, text) + len(tag))
    bare = lambda c: F.btrim(_plain(c), F.lit(" ,"))
    badge = F.regexp_extract(row, r'(?s)<span class="badge[^"]*">(.*?)</span>', 1)
    found = F.array(F.struct(row.alias("row"), badge.alias("badge"), F.when(row.contains("<a"), F.regexp_extract(row, link, 0)).otherwise("").alias("link")))
    cut = F.transform(found, lambda x: F.when(x["badge"] != "", F.struct(
        x["badge"].alias("badge"),
        F.when(x["link"] != "", F.regexp_extract(x["link"], link, 2)).otherwise(after(x["row"], "</span>")).alias("name"),
        F.when(x["link"] != "", after(x["row"], "</a>")).otherwise("").alias("place"),
        F.when(x["link"] != "", F.regexp_extract(x["link"], link, 1)).alias("url"),
    )))
    return F.get(F.transform(cut, lambda x: F.when(x.isNotNull(), F.struct(_plain(x["badge"]).alias("badge"), bare(x["name"]).alias("name"), bare(x["place"]).alias("place"), x["url"].alias("url")))), F.lit(0))


def calendar(pages: DataFrame, aliases: tuple[tuple[str, str], ...]) -> DataFrame:
    """``page_id, line, date, end, name, place, url, family, skipped, problem`` of every row of the pages (page_id, html).

    Rows that are no road race stay, with the reason; ``aliases`` (phrase, course)
    say what roads are called. Track comes before the courses, as meets bear the names of roads. Rows without a badge or a name are no entries. A
    row whose badge holds no day, and a page whose heading has no year, have a
    ``problem`` (the page as one row); pages that are null have none.

    Pages are read once. Rows are taken apart before they are exploded and words are columns of their own, as a filter or a
    condition on an expression would have it computed again.
    """
    year = F.regexp_extract("html", r"(?i)<th>[^<]*calendar[^<]*?(\d{4})\s*</th>", 1).try_cast("int")
    read = pages.where("html is not null").select("page_id", "html", year.alias("year"))
    fields = F.transform(F.regexp_extract_all("html", F.lit("(?s)<tr><td>(.*?)</td></tr>"), F.lit(1)), _fields)
    rows = read.select("page_id", "year", F.posexplode_outer(F.when(F.col("year").isNotNull(), fields)).alias("line", "row")).where("year is null or row.name <> ''")
    rows = rows.select("page_id", "line", "year", "row.badge", "row.name", "row.place", "row.url")
    name = F.col("name")
    rows = rows.withColumns({"sport": _word(name, OTHER_SPORT), "course": _family(name, aliases), "days": _days(F.col("badge"), F.col("year"))}).withColumn("track", F.when(F.col("sport") == "", _word(name, TRACK)))
    said = lambda reason, word: F.when(F.col(word) != "", F.concat(F.lit(f"{reason} ("), word, F.lit(")")))
    why = F.coalesce(said("a different sport", "sport"), said("track and field", "track"), F.when(name.isNotNull() & F.col("course").isNull(), UNKNOWN))
    problem = F.when(F.col("year").isNull(), "no year in the heading").when(F.size("days") == 0, "no date")
    return rows.select(
        "page_id", "line", F.get("days", F.lit(0)).alias("date"), F.get("days", F.lit(1)).alias("end"), "name", "place", "url",
        F.when((F.col("sport") == "") & (F.col("track") == ""), F.col("course")).alias("family"), why.alias("skipped"), problem.alias("problem"),
    )


def unread(events: DataFrame) -> DataFrame:
    """The rows that are no road race, those that no rule knows first, as a new race looks like that."""
    return events.where("skipped is not null").orderBy(F.col("skipped") != UNKNOWN, "date", "name")
