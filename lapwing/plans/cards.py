"""Queries on published lines, attendance, and what may still be published."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions import printed
from lapwing.operators import asof, cards, scoring
from lapwing.plans.registry import query
from lapwing.sources.results import results, table

# Lines are the orders of odd years, results those of the even year after; keys by two customers and a pair of years, towns by customer.
_LINES = """ all_ AS (SELECT o_orderkey AS id, (o_custkey // 2)::VARCHAR || '-' || ((year(o_orderdate) + 1) // 2)::VARCHAR AS key, (o_custkey % 4)::VARCHAR AS town, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice::DOUBLE END AS seconds, year(o_orderdate) AS y FROM orders
), line AS (SELECT * FROM all_ WHERE y % 2 = 1), res AS (SELECT * FROM all_ WHERE y % 2 = 0)"""
_OUTCOMES = _LINES + """, ln AS (SELECT *, count(*) OVER (PARTITION BY key) AS times FROM line
), cand AS (SELECT l.id AS line, any_value(l.key) AS key, any_value(l.times) AS times, count(r.id) AS n, count(r.id) FILTER (WHERE r.town = l.town) AS m, min(struct_pack(a := r.id, s := r.seconds)) FILTER (WHERE r.id IS NOT NULL) AS one, min(struct_pack(a := r.id, s := r.seconds)) FILTER (WHERE r.town = l.town) AS here FROM ln l LEFT JOIN res r ON l.key = r.key GROUP BY l.id
), picked AS (SELECT *, CASE WHEN n = 1 THEN one WHEN m = 1 THEN here END AS c FROM cand
), out AS (SELECT *, CASE WHEN times > 1 THEN 'ambiguous' WHEN n = 0 THEN 'not found in the results' WHEN c IS NULL THEN 'ambiguous' WHEN c.s IS NULL THEN 'did not finish' ELSE 'finished' END AS outcome FROM picked)"""


def _lines(spark, sf_dir):
    c = F.col("o_custkey")
    key = F.concat(F.floor(c / 2).cast("string"), F.lit("-"), F.floor((F.year("o_orderdate") + 1) / 2).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), key.alias("key"), (c % 4).cast("string").alias("town"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("double")).alias("seconds"), F.year("o_orderdate").alias("y"))
    return rows.where("y % 2 = 1").select(F.col("entry_id").alias("line"), "key", "town"), rows.where("y % 2 = 0").drop("y")


@query(_OUTCOMES + " SELECT line, outcome, CASE WHEN outcome IN ('finished', 'did not finish') THEN c.a END AS entry_id FROM out", with_results=False)
def match_lines(spark, sf_dir):
    return cards.outcomes(*_lines(spark, sf_dir)).select("line", "outcome", "entry_id")


@query(_OUTCOMES + " SELECT count(*) AS lines, count(*) FILTER (WHERE outcome = 'finished') AS finished, (SELECT count(seconds) FROM res) - count(*) FILTER (WHERE outcome = 'finished') AS unpredicted FROM out", with_results=False)
def match_counts(spark, sf_dir):
    lines, found = _lines(spark, sf_dir)
    finishers = found.agg(F.count("seconds").alias("finishers"))
    counts = cards.outcomes(lines, found).agg(F.count("*").alias("lines"), F.count(F.when(F.col("outcome") == "finished", 1)).alias("finished"))
    return counts.join(finishers).select("lines", "finished", (F.col("finishers") - F.col("finished")).alias("unpredicted"))  # a row each


@query(""" listed AS (SELECT DISTINCT race_id, day, runner_id // 3 AS key FROM results WHERE entry_id % 4 > 0), fin AS (SELECT DISTINCT race_id, day, runner_id // 3 AS key FROM results WHERE seconds IS NOT NULL AND entry_id % 3 > 0
), both_ AS (SELECT coalesce(l.race_id, f.race_id) AS race_id, l.key IS NOT NULL AS l, f.key IS NOT NULL AS f, EXISTS (SELECT 1 FROM listed o WHERE o.day = coalesce(l.day, f.day) AND o.key = coalesce(l.key, f.key)) AS d FROM listed l FULL JOIN fin f ON l.race_id = f.race_id AND l.key = f.key)
SELECT race_id, count(*) FILTER (WHERE l) AS listed, count(*) FILTER (WHERE f) AS finished, count(*) FILTER (WHERE l AND f) AS found, count(*) FILTER (WHERE f AND NOT l) AS not_listed, count(*) FILTER (WHERE f AND NOT l AND d) AS switched FROM both_ GROUP BY race_id""")
def attendance(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("key", F.floor(F.col("runner_id") / 3))
    return cards.attendance(rows.where("entry_id % 4 > 0"), rows.where("entry_id % 3 > 0"))


@query(""" e AS (SELECT event_id, event_type || ', ' || ['Kids Race', '5KM open', 'view'][event_id % 3 + 1] AS events FROM events) SELECT event_id, len(list_filter(string_split(events, ','), lambda x: lower(trim(x)) IN ('5km open', 'click'))) > 0 AS mine FROM e""", with_results=False)
def entrants_of_events(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, ["Kids Race", "5KM open", "view"])), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(", "), pick).alias("events"))
    return rows.select("event_id", cards.in_events(F.col("events"), ["5km Open", "click"]).alias("mine"))


@query(""" g AS (SELECT event_id, ts, CASE WHEN event_id % 17 > 0 THEN ts + (event_id % 50) * INTERVAL 1 HOUR END AS gun FROM events) SELECT event_id, CASE WHEN gun IS NULL THEN 'no time' WHEN event_id % 50 < 24 THEN (event_id % 50 * 3600)::VARCHAR || ' s before the gun' END AS refused FROM g""", with_results=False)
def late_cut_off(spark, sf_dir):
    """Nothing counts that is done within a day of the gun."""
    gun = F.when(F.col("event_id") % 17 > 0, F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 50).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", cards.too_late(F.col("ts"), gun).alias("refused"))


@query(""" r AS (SELECT race_id, min(race_date) AS date, min(runner_id) % 2 = 0 AS listed FROM results GROUP BY race_id), d AS (SELECT race_id, (listed OR date IS NULL) AS listed, datediff('day', DATE '1995-05-29', date) AS lead FROM r)
SELECT race_id, CASE WHEN lead = 1 THEN 'final' ELSE 'daily' END AS kind FROM d WHERE lead = 1 OR (lead BETWEEN 2 AND 7 AND listed)""")
def due_files(spark, sf_dir):
    races = results(spark, sf_dir).groupBy("race_id").agg(F.min("race_date").alias("date"), (F.min("runner_id") % 2 == 0).alias("listed"))
    return cards.due(races, F.lit("1995-05-29").cast("date"))


@query(""" r AS (SELECT race_id, min(race_date) AS date, count(*) AS n, min(runner_id) AS k FROM results GROUP BY race_id)
SELECT race_id, CASE WHEN k % 5 = 0 THEN 'scored' WHEN DATE '1995-06-15' > date THEN 'run' WHEN k % 3 > 1 THEN 'final' WHEN k % 3 > 0 THEN 'week' ELSE 'before' END AS stage,
  CASE WHEN date < DATE '1995-06-15' OR k % 5 = 0 THEN 'run' WHEN k % 4 > 0 OR coalesce(CASE WHEN k % 7 = 0 THEN DATE '1995-06-01' END <= DATE '1995-06-15', FALSE) THEN 'open' ELSE 'announced' END AS shelf FROM r""")
def race_stages(spark, sf_dir):
    rows = results(spark, sf_dir).groupBy("race_id").agg(F.min("race_date").alias("date"), F.min("runner_id").alias("k"))
    today, k = F.lit("1995-06-15").cast("date"), F.col("k")
    stage = cards.stage(k % 5 == 0, today, F.col("date"), F.when(k % 3 > 1, 1).otherwise(0), k % 3)
    shelf = cards.shelf(F.col("date"), today, k % 5 == 0, k % 4, F.when(k % 7 == 0, F.lit("1995-06-01").cast("date")))
    return rows.select("race_id", stage.alias("stage"), shelf.alias("shelf"))


_KEY = b"a key of the library"
_PADS = ["".join(f"{b ^ x:02X}" for b in _KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query(f""" k AS (SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer) SELECT c_custkey, key, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(key)))) AS digest FROM k""", with_results=False)
def keyed_digests(spark, sf_dir):
    """Who a redacted line is: the keyed digest of the name's key."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", printed.name_key(F.col("c_name")).alias("key"))
    return rows.withColumn("digest", cards.hmac_sha256(_KEY, F.col("key")))


@query(""" b AS (SELECT entry_id, substr(age_band, 1, 2)::INT AS low, substr(age_band, 4, 2)::INT AS high, year(race_date) AS y FROM results), w AS (SELECT *, y - high - 1 AS f, y - low AS l FROM b)
SELECT entry_id, 1999 - l <= high AND low <= 1999 - f AS possible FROM w""")
def bands_still_possible(spark, sf_dir):
    ages = printed.age_range(F.col("age_band"))
    return results(spark, sf_dir).select("entry_id", cards.band_still_possible(ages["low"], ages["high"], F.year("race_date"), F.lit(1999)).alias("possible"))


@query(""" b AS (SELECT runner_id, min(sex) AS sex, max(year(race_date) - substr(age_band, 4, 2)::INT - 1) AS f, min(year(race_date) - substr(age_band, 1, 2)::INT) AS l, min(race_date) AS first, max(struct_pack(a := race_date, b := race_id, c := entry_id, f := year(race_date) - substr(age_band, 4, 2)::INT - 1, l := year(race_date) - substr(age_band, 1, 2)::INT)) AS last FROM results GROUP BY runner_id
), c AS (SELECT runner_id, sex, year(first) - (CASE WHEN f <= l THEN f + l ELSE last.f + last.l END) / 2.0::DOUBLE AS age FROM b) SELECT runner_id, sex || ' ' || (least(greatest(floor(age / 10), 1), 7) * 10)::INT || 's' AS age_group FROM c""")
def runner_age_groups(spark, sf_dir):
    """Sex and decade of age at the first race, from every band printed; where they disagree the latest one counts."""
    w = printed.birth_window(F.col("age_band"), F.col("race_date"))
    rows = results(spark, sf_dir).withColumn("w", w)
    own = rows.groupBy("runner_id").agg(F.min("sex").alias("sex"), F.max("w.first").alias("f"), F.min("w.last").alias("l"), F.min("race_date").alias("first"), F.max(F.when(F.col("w.first").isNotNull(), F.struct("race_date", "race_id", "entry_id", "w"))).alias("last"))
    some = F.when(F.col("f") <= F.col("l"), F.col("f") + F.col("l")).otherwise(F.col("last.w.first") + F.col("last.w.last"))
    decade = F.least(F.greatest(F.floor((F.year("first") - some / 2) / 10), F.lit(1)), F.lit(7)) * 10
    label = F.when(some.isNull(), "unknown").otherwise(F.concat(decade.cast("int").cast("string"), F.lit("s")))
    return own.select("runner_id", F.concat_ws(" ", F.coalesce("sex", F.lit("U")), label).alias("age_group"))


@query(""" f AS (SELECT entry_id, runner_id, day, race_id, ln(seconds / distance_m) AS r FROM results WHERE seconds IS NOT NULL
), w AS (SELECT entry_id, day - lag(day) OVER o AS gap, avg(r) OVER (PARTITION BY runner_id ORDER BY day, race_id, entry_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m, row_number() OVER o AS k FROM f WINDOW o AS (PARTITION BY runner_id ORDER BY day, race_id, entry_id))
SELECT entry_id, gap, CASE WHEN k > 3 THEN round(m, 6) END AS last_three FROM w""")
def gaps_and_last_three(spark, sf_dir):
    """Days since the finish before, and the mean of the three before; by the order of dates, races and entries."""
    from pyspark.sql import Window

    w = Window.partitionBy("runner_id").orderBy("day", "race_id", "entry_id")
    rows = results(spark, sf_dir).where("seconds is not null").withColumn("r", F.log(F.col("seconds") / F.col("distance_m")))
    three = F.avg("r").over(w.rowsBetween(-3, -1))
    return rows.select("entry_id", (F.col("day") - F.lag("day").over(w)).alias("gap"), F.when(F.row_number().over(w) > 3, F.round(three, 6)).alias("last_three"))


@query(""" f AS (SELECT race_id, count(DISTINCT runner_id) AS field, count(DISTINCT course_id) AS courses, count(DISTINCT hometown) AS towns FROM results WHERE seconds IS NOT NULL GROUP BY race_id) SELECT * FROM f""")
def race_fields(spark, sf_dir):
    rows = results(spark, sf_dir).where("seconds is not null")
    return rows.groupBy("race_id").agg(F.countDistinct("runner_id").alias("field"), F.countDistinct("course_id").alias("courses"), F.countDistinct("hometown").alias("towns"))


@query()
def paired_placing(spark, sf_dir):
    return cards.paired_places(scoring.scored(results(spark, sf_dir)), "carry", "median")


@query()
def skill_by_depth(spark, sf_dir):
    """How much of the category median's error carrying over takes away, on the finishes each answers for."""
    rows = scoring.scored(results(spark, sf_dir))
    a, b = (scoring.summary(rows, m, "stratum").select("stratum", F.col("mae").alias(m)) for m in ("carry", "median"))
    return cards.skill(a.join(b, "stratum"), "carry", "median", "stratum")


@query(""" c AS (SELECT r.entry_id, r.race_date AS at, count(p.day) AS n FROM results r LEFT JOIN past p ON p.target = r.entry_id GROUP BY ALL) SELECT count(*) AS entries, sum(n)::BIGINT AS earlier, count(*) FILTER (WHERE n = 0) AS newcomers FROM c""")
def history_totals(spark, sf_dir):
    rows = asof.with_history(results(spark, sf_dir))
    return rows.agg(F.count("*").alias("entries"), F.sum("depth").alias("earlier"), F.count(F.when(F.col("depth") == 0, 1)).alias("newcomers"))
