"""Queries on catalogues of editions and on names of courses."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions import courses
from lapwing.operators import cards, catalogue
from lapwing.plans.registry import query
from lapwing.sources.results import results, table

# Index rows made of parts: events, addresses and printed days of every form.
_EVENTS = ["Harbour {n} km", "3rd Annual {n}k Road Race", "Half Marathon", "Cape to Harbour {n}K", "Kids Walk {n} km", "Bay 1km & 3km", "Open {n} mile", "Marathon Results", "City Relay {n} km", "Acme Plain name"]
_SPONSORS = ("acme",)
_ALIASES = (("cape to harbour", "cape-to-harbour"),)
_EVENT_SQL = "[" + ", ".join("'" + e.replace("&", "&").replace("{n}", "' || n || '") + "'" for e in _EVENTS) + "][p_partkey % 10 + 1]"
_ROWS = f""" base AS (SELECT p_partkey, (p_size % 12 + 1)::VARCHAR AS n, p_partkey % 3 AS k FROM part
), rows AS (SELECT p_partkey, {_EVENT_SQL} AS event, 'results/' || CASE WHEN k = 0 THEN '2014' || lpad((p_partkey % 14)::VARCHAR, 2, '0') || lpad((p_partkey % 30)::VARCHAR, 2, '0') || '_' || p_partkey % 50 ELSE 'race' || p_partkey % 200 END || ['.php', '.htm', '.pdf', '.php'][p_partkey % 4 + 1] AS href,
  CASE WHEN p_partkey % 7 > 0 THEN ['January', 'Feb', 'August', 'Never'][p_partkey % 4 + 1] || ' ' || (p_partkey % 27 + 1) END AS printed FROM base)"""
_METRES = r"""km AS (SELECT *, list_distinct(list_transform(regexp_extract_all(lower(event), '(\d+(?:\.\d+)?)\s*km?\b', 1), lambda x: x::DOUBLE)) AS km, list_distinct(list_transform(regexp_extract_all(lower(event), '(\d+(?:\.\d+)?)\s*mi(?:le)?s?\b', 1), lambda x: x::DOUBLE)) AS mi FROM rows
), metres AS (SELECT *, CASE WHEN regexp_matches(lower(event), 'half[- ]marathon') THEN 21097.494::DOUBLE WHEN contains(lower(event), 'marathon') THEN 42194.988::DOUBLE WHEN len(km) + len(mi) > 1 THEN NULL WHEN len(km) = 1 THEN km[1] * 1000 WHEN len(mi) = 1 THEN mi[1] * 1609.344::DOUBLE WHEN regexp_matches(lower(event), '\bmile\b') THEN 1609.344::DOUBLE END AS metres FROM km)"""
_LABEL = """CASE WHEN {m} IS NULL THEN NULL WHEN abs({m} - 42194.988) < 50 THEN 'marathon' WHEN abs({m} - 21097.494) < 50 THEN 'half marathon' WHEN abs({m} - 16093.44) < 50 THEN '10 mile' WHEN abs({m} - 1609.344) < 5 THEN 'mile' ELSE regexp_replace(printf('%.3f', {m} / 1000), '\\.?0+$', '') || ' km' END"""


def _rows(spark, sf_dir):
    n, key = (F.col("p_size") % 12 + 1).cast("string"), F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*values), (by + 1).cast("int"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    event = pick([F.replace(F.lit(e), F.lit("{n}"), n) for e in _EVENTS], key % 10)
    stem = F.when(key % 3 == 0, F.concat(F.lit("2014"), two(key % 14), two(key % 30), F.lit("_"), (key % 50).cast("string"))).otherwise(F.concat(F.lit("race"), (key % 200).cast("string")))
    printed = F.when(key % 7 > 0, F.concat(pick([F.lit(m) for m in ("January", "Feb", "August", "Never")], key % 4), F.lit(" "), (key % 27 + 1).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", event.alias("event"), F.concat(F.lit("results/"), stem, pick([F.lit(x) for x in (".php", ".htm", ".pdf", ".php")], key % 4)).alias("href"), printed.alias("printed"), F.lit(2014).alias("year"))


@query(_ROWS + "," + _METRES + f" SELECT p_partkey, metres AS distance_m, {_LABEL.format(m='metres')} AS label FROM metres", with_results=False)
def event_distances(spark, sf_dir):
    d = courses.distance(F.col("event"))
    return _rows(spark, sf_dir).select("p_partkey", d.alias("distance_m"), courses.distance_label(d).alias("label"))


_CATALOGUE = _ROWS + "," + _METRES + r""", stems AS (SELECT *, regexp_replace(split_part(href, '/', 2), '\.php$', '') AS stem, lower(regexp_extract(event, '(?i)\b(trail|relay|cross[- ]country|xc|school|kid''?s?|walk(?:ers)?|teams?|awards?)\b', 1)) AS word FROM metres
), dated AS (SELECT *, CASE WHEN regexp_matches(stem, '^\d{8}') THEN stem ELSE replace(lower(event), ' ', '-') || '-' || stem END AS race_id,
    coalesce(try_strptime(regexp_extract(stem, '^(\d{8})', 1), '%Y%m%d')::DATE, try_strptime(printed || ' 2014', '%B %d %Y')::DATE, try_strptime(printed || ' 2014', '%b %d %Y')::DATE) AS date FROM stems
), reasoned AS (SELECT *, CASE WHEN word <> '' THEN 'not an individual road result (' || word || ')' WHEN lower(href) LIKE '%.pdf' THEN 'a PDF' WHEN date IS NULL THEN 'no date' WHEN metres IS NULL THEN 'no single distance' END AS why,
    regexp_replace(lower(event), '\d+(\.\d+)?\s*(km|k|mi|mile|miles)\b', ' ', 'g') AS base FROM dated
), named AS (SELECT *, CASE WHEN why IS NULL THEN coalesce(CASE WHEN contains(lower(event), 'cape to harbour') THEN 'cape-to-harbour' END,
    nullif(trim(regexp_replace(regexp_replace(regexp_replace(base, '\b(half[- ]marathon|marathon)\b', ' ', 'g'), '\b(\d+(st|nd|rd|th)|annual|road\s+race|race|results?|individual|open|championships?|acme)\b', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), ''),
    nullif(trim(regexp_replace(base, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') || '-' || round_even(metres, 0)::BIGINT END AS course_id FROM reasoned
), turned AS (SELECT *, row_number() OVER (PARTITION BY course_id, date, regexp_replace(lower(event), '[^a-z0-9]+', '', 'g'), CASE WHEN why IS NOT NULL THEN href END ORDER BY (href LIKE '%.php') DESC, length(href), href DESC) AS turn FROM named)"""


@query(_CATALOGUE + " SELECT coalesce(why, CASE WHEN turn > 1 THEN 'a duplicate' END, 'read') AS reason, count(*) AS rows, count(DISTINCT race_id) AS ids, count(DISTINCT course_id) AS courses, min(date) AS first, max(date) AS last FROM turned GROUP BY 1", with_results=False)
def catalogue_reasons(spark, sf_dir):
    found = catalogue.catalogue(_rows(spark, sf_dir), _ALIASES, _SPONSORS).withColumn("reason", F.coalesce("reason", F.lit("read")))
    return found.groupBy("reason").agg(F.count("*").alias("rows"), F.countDistinct("race_id").alias("ids"), F.countDistinct("course_id").alias("courses"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(_CATALOGUE + " SELECT race_id, course_id, date, metres AS distance_m, CASE WHEN course_id = 'cape-to-harbour-5000' AND date <= DATE '2014-06-30' THEN 'old-harbour' ELSE course_id END AS road FROM turned WHERE why IS NULL AND turn = 1", with_results=False)
def catalogue_races(spark, sf_dir):
    races = catalogue.catalogue(_rows(spark, sf_dir), _ALIASES, _SPONSORS).where("reason is null").drop("reason", "href", "event")
    roads = spark.sql("SELECT 'cape-to-harbour-5000' AS course, CAST(NULL AS DATE) AS first, DATE'2014-06-30' AS last, 'old-harbour' AS road")
    return catalogue.reroute(races.withColumn("was", F.col("course_id")), roads).select("race_id", F.col("was").alias("course_id"), "date", "distance_m", F.col("course_id").alias("road"))


@query(r""" c AS (SELECT p_partkey, ['cape-to-harbour', 'hrc', 'run-by-the-sea', 'of-the-hrc'][p_partkey % 4 + 1] || '-' || [5000, 10000, 16093, 21097, 42195, 1609][p_partkey % 6 + 1] AS course_id FROM part),
n AS (SELECT *, ['Cape to Harbour', 'HRC', 'Run by the Sea', 'Of the HRC'][p_partkey % 4 + 1] || ' ' || ['5 km', '10 km', '10 mile', 'half marathon', 'marathon', 'mile'][p_partkey % 6 + 1] AS name FROM c) SELECT p_partkey, course_id, name FROM n""", with_results=False)
def course_names(spark, sf_dir):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % by + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(pick(["cape-to-harbour", "hrc", "run-by-the-sea", "of-the-hrc"], 4), F.lit("-"), pick([5000, 10000, 16093, 21097, 42195, 1609], 6).cast("string")).alias("course_id"))
    return rows.withColumn("name", courses.course_name(F.col("course_id"), ("hrc",)))


@query(""" b AS (SELECT race_id, make_date(year(race_date)::INT, ((month(race_date) - 1) // 3 * 3 + 1)::INT, 1) AS quarter, make_date(year(race_date)::INT, ((month(race_date) - 1) // 6 * 6 + 1)::INT, 1) AS half FROM results)
SELECT quarter, half, count(DISTINCT race_id) AS races, count(*) AS entries FROM b GROUP BY ALL""")
def season_blocks(spark, sf_dir):
    rows = results(spark, sf_dir).select("race_id", courses.block_start(F.col("race_date"), 3).alias("quarter"), courses.block_start(F.col("race_date"), 6).alias("half"))
    return rows.groupBy("quarter", "half").agg(F.countDistinct("race_id").alias("races"), F.count("*").alias("entries"))


_OWN = "runner_id % 3 = 0 AND NOT (course_id = '5-LOW' AND month(race_date) % 2 = 0)"


@query(f""" own AS (SELECT * FROM results WHERE {_OWN}), outside AS (SELECT * FROM results WHERE NOT ({_OWN}))
SELECT race_id, 'own' AS source, count(*) AS rows FROM own GROUP BY race_id UNION ALL SELECT race_id, 'outside', count(*) FROM outside WHERE race_id NOT IN (SELECT race_id FROM own) GROUP BY race_id""")
def union_of_sources(spark, sf_dir):
    """Every row is one of two sources'; an outside copy of a race is left out once the first source has it."""
    rows = results(spark, sf_dir)
    own, outside = (rows.where(c).withColumn("source", F.lit(name)) for c, name in ((_OWN, "own"), (f"NOT ({_OWN})", "outside")))
    return catalogue.union_of_sources(own, outside, ["race_id"]).groupBy("race_id", "source").agg(F.count("*").alias("rows"))


@query(""" own AS (SELECT race_id, min(entry_id) AS first_id FROM results WHERE runner_id % 3 = 0 GROUP BY race_id), outside AS (SELECT DISTINCT race_id FROM results WHERE runner_id % 3 > 0) SELECT race_id, first_id AS superseded_by FROM outside LEFT JOIN own USING (race_id)""")
def borrowed_races(spark, sf_dir):
    rows = results(spark, sf_dir)
    return catalogue.borrowed(rows.where("runner_id % 3 > 0").select("race_id").distinct(), rows.where("runner_id % 3 = 0"), ["race_id"], "entry_id")


@query(""" e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS turn FROM events) SELECT user_id, event_type, event_id FROM e WHERE turn = 1""", with_results=False)
def distinct_in_order(spark, sf_dir):
    return catalogue.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(""" s AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS latest FROM events GROUP BY user_id), b AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS before FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM events) GROUP BY user_id)
SELECT user_id, latest, before FROM s LEFT JOIN b USING (user_id)""", with_results=False)
def snapshots_before(spark, sf_dir):
    """The latest look at each list, and the latest that was there on a day."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("stamp"), "ts")
    day = rows.agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("day")).first()["day"]
    latest = cards.snapshot(rows, "user_id", "stamp").select("user_id", F.col("event_id").alias("latest"))
    before = cards.snapshot(rows.where(F.col("ts") <= F.lit(day)), "user_id", "stamp").select("user_id", F.col("event_id").alias("before"))
    return latest.join(before, "user_id", "left")
