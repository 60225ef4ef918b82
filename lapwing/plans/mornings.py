"""Queries on hills, routes, weather and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions import courses, running
from lapwing.operators import field, mornings
from lapwing.plans.registry import query
from lapwing.sources.results import results, table

_COST = "(155.4::DOUBLE * pow({i}, 5) - 30.4::DOUBLE * pow({i}, 4) - 43.3::DOUBLE * pow({i}, 3) + 46.3::DOUBLE * pow({i}, 2) + 19.5::DOUBLE * {i} + 3.6::DOUBLE)"
_HILLS = f""" h AS (SELECT l_orderkey, l_linenumber, 10000.0::DOUBLE AS d, l_quantity * 10.0::DOUBLE AS up, l_quantity * 8.0::DOUBLE AS down, 0.01::DOUBLE + l_discount AS g FROM lineitem
), f AS (SELECT *, d - up / g - down / g AS raw FROM h), g AS (SELECT *, CASE WHEN raw < 0 AND raw > -0.01 THEN 0 ELSE raw END AS flat FROM f
), p AS (SELECT *, CASE WHEN flat >= 0 THEN (up / g * {_COST.format(i='g')} + down / g * {_COST.format(i='(-g)')} + flat * 3.6::DOUBLE) / (d * 3.6::DOUBLE) - 1 END AS penalty FROM g)"""


def _hills(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(10000.0).alias("d"), (F.col("l_quantity") * F.lit(10.0)).alias("up"), (F.col("l_quantity") * F.lit(8.0)).alias("down"), (F.lit(0.01) + F.col("l_discount")).cast("double").alias("g"))
    return rows.withColumn("penalty", mornings.penalty(F.col("d"), F.col("up"), F.col("down"), F.col("g")))


@query(_HILLS + " SELECT l_orderkey, l_linenumber, round(penalty, 6) AS penalty FROM p", with_results=False)
def course_penalty(spark, sf_dir):
    return _hills(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("penalty", 6).alias("penalty"))


@query(_HILLS + " SELECT l_orderkey, l_linenumber, CASE WHEN penalty IS NOT NULL AND g >= (up + down) / d THEN round(g, 5) END AS grade FROM p WHERE flat > 1 AND penalty IS NOT NULL", with_results=False)
def implied_grade(spark, sf_dir):
    """From a grade to its penalty and back again: the same grade."""
    rows = _hills(spark, sf_dir).where("d - up / g - down / g > 1 and penalty is not null")
    return rows.select("l_orderkey", "l_linenumber", F.round(mornings.implied_grade("d", "up", "down", "penalty"), 5).alias("grade"))


_POINTS = """ pts AS (SELECT s_nationkey AS route, s_suppkey AS leg, 47 + s_acctbal / 5000.0::DOUBLE AS lat, -53 + (s_suppkey % 100) / 50.0::DOUBLE AS lon FROM supplier
), led AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM pts WINDOW w AS (PARTITION BY route ORDER BY leg)
), legs0 AS (SELECT *, 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))) AS metres,
  degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) AS bearing FROM led WHERE lat2 IS NOT NULL
), legs AS (SELECT route, leg, CASE WHEN bearing < 0 THEN bearing + 360 ELSE bearing END AS heading_deg, metres / sum(metres) OVER (PARTITION BY route) AS share FROM legs0 WHERE metres > 0)"""


def _legs(spark, sf_dir):
    points = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("route"), F.col("s_suppkey").alias("leg"), (F.lit(47) + F.col("s_acctbal") / F.lit(5000.0)).cast("double").alias("lat"), (F.lit(-53) + (F.col("s_suppkey") % 100) / F.lit(50.0)).alias("lon"))
    return mornings.legs(points)


@query(_POINTS + " SELECT route, leg, round(heading_deg, 4) AS heading_deg, round(share, 6) AS share FROM legs", with_results=False)
def route_legs(spark, sf_dir):
    return _legs(spark, sf_dir).select("route", "leg", F.round("heading_deg", 4).alias("heading_deg"), F.round("share", 6).alias("share"))


@query(_POINTS + " SELECT route, round(sqrt(pow(sum(share * sin(radians(heading_deg))), 2) + pow(sum(share * cos(radians(heading_deg))), 2)), 6) AS net_share FROM legs GROUP BY route", with_results=False)
def route_net_share(spark, sf_dir):
    return mornings.net_share(_legs(spark, sf_dir)).withColumn("net_share", F.round("net_share", 6))


_WINDS = """ wind AS (SELECT event_id, user_id % 30 AS route, CASE WHEN event_id % 11 > 0 THEN value / 10 * sin(radians(event_id % 360)) END AS east, value / 10 * cos(radians(event_id % 360)) AS north, CASE WHEN event_id % 13 > 0 THEN value / 8 END AS speed, event_id % 25 - 3 AS temp, (event_id % 7) / 5.0::DOUBLE AS sun, 1000.0::DOUBLE * (event_id % 20 + 1) AS d FROM events)"""
_TERMS = """, w0 AS (SELECT *, CASE WHEN east IS NULL OR north IS NULL THEN 0 ELSE east END AS e, CASE WHEN east IS NULL OR north IS NULL THEN 0 ELSE north END AS n FROM wind
), w1 AS (SELECT *, sqrt(e * e + n * n) AS steady FROM w0), w2 AS (SELECT *, coalesce(greatest(speed, steady), steady) AS mean FROM w1
), along AS (SELECT event_id, sum(share * pow((e * sin(radians(heading_deg)) + n * cos(radians(heading_deg))) / 10, 2)) AS x, sum(share * (e * sin(radians(heading_deg)) + n * cos(radians(heading_deg)))) AS net FROM w2 JOIN legs USING (route) GROUP BY event_id
), terms AS (SELECT w2.*, coalesce(x, 0.5::DOUBLE * steady * steady / 100) + 0.5::DOUBLE * (mean * mean - steady * steady) / 100 AS exposure, coalesce(net, 0) AS net FROM w2 LEFT JOIN along USING (event_id))"""


def _winds(spark, sf_dir):
    k, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 30).alias("route"), F.when(k % 11 > 0, v / 10 * F.sin(F.radians(k % 360))).alias("east"), (v / 10 * F.cos(F.radians(k % 360))).alias("north"), F.when(k % 13 > 0, v / 8).alias("speed"), (k % 25 - 3).alias("temp"), ((k % 7) / F.lit(5.0)).alias("sun"), (F.lit(1000.0) * (k % 20 + 1)).alias("d"))


@query(_WINDS + "," + _POINTS + _TERMS + " SELECT event_id, round(round(exposure, 9), 4) AS exposure, round(round(net, 9), 4) AS net FROM terms", with_results=False)
def wind_on_routes(spark, sf_dir):
    rows = mornings.wind_terms(_winds(spark, sf_dir), _legs(spark, sf_dir))
    # Rounded twice, as sums in another order differ in their last bits, and some values are halves.
    return rows.select("event_id", *[F.round(F.round(c, 9), 4).alias(c) for c in ("exposure", "net")])


@query(_WINDS + "," + _POINTS + _TERMS + """ SELECT event_id, round(coalesce(greatest(0, temp + 2.1::DOUBLE * greatest(0, least(1, sun)) - 12) * (0.002::DOUBLE + 0.001::DOUBLE * ln(d / 5000)) + 0.003::DOUBLE * (exposure - 2) - 0.0005::DOUBLE * net, 0), 6) AS effect,
  round((0.001::DOUBLE + 0.0004::DOUBLE * ln(d / 10000)) * (temp - 10) + 0.0006::DOUBLE * (speed - 20) - 0.0003::DOUBLE * coalesce(east * sin(radians(90)) + north * cos(radians(90)), 0), 6) AS adjustment,
  round(3600 / (1 + (0.001::DOUBLE + 0.0004::DOUBLE * ln(d / 10000)) * (temp - 10) + 0.0006::DOUBLE * (speed - 20) - 0.0003::DOUBLE * coalesce(east * sin(radians(90)) + north * cos(radians(90)), 0)), 3) AS neutral_seconds FROM terms""", with_results=False)
def morning_effects(spark, sf_dir):
    """What a morning costs by both models, and an hour's time on a neutral one."""
    rows = mornings.wind_terms(_winds(spark, sf_dir), _legs(spark, sf_dir))
    cost = mornings.effect(F.col("temp"), F.col("sun"), F.col("d"), F.col("exposure"), F.col("net"), (0.002, 0.001), 0.003, -0.0005, 2.1)
    along = mornings.tailwind(F.lit(90), F.col("east"), F.col("north"))
    adjustment = mornings.adjustment(F.col("d"), F.col("temp"), F.col("speed"), along, 0.001, 0.0004, 0.0006, -0.0003)
    return rows.select("event_id", F.round(cost, 6).alias("effect"), F.round(adjustment, 6).alias("adjustment"), F.round(F.lit(3600) / (1 + adjustment), 3).alias("neutral_seconds"))


@query(""" hourly AS (SELECT datediff('day', DATE '1970-01-01', ts::DATE) AS day, hour(ts)::INT AS hour, avg(value) AS temp_c, avg(event_id % 7) AS east, avg(user_id % 5) AS north, avg(event_id % 9) AS speed FROM events GROUP BY ALL
), base AS (SELECT min(day) AS day0 FROM hourly), races AS (SELECT race_id, any_value(distance_m) AS d, (SELECT day0 FROM base) + min(day) % 20 AS day FROM results GROUP BY race_id)
SELECT race_id, count(*) AS hours, round(avg(temp_c), 5) AS temp_c, round(avg(east), 5) AS east, round(avg(north), 5) AS north, round(avg(speed), 5) AS speed FROM races JOIN hourly USING (day) WHERE hour BETWEEN 7 AND 7 + greatest(1, round_even(d / 1000 * 0.09::DOUBLE, 0)) GROUP BY race_id""")
def conditions_on_the_road(spark, sf_dir):
    """Means of the hourly readings while each race was on the road."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    hourly = table(spark, sf_dir, "events").groupBy(day.alias("day"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("temp_c"), F.avg(F.col("event_id") % 7).alias("east"), F.avg(F.col("user_id") % 5).alias("north"), F.avg(F.col("event_id") % 9).alias("speed"))
    base = hourly.agg(F.min("day")).first()[0] or 0
    races = results(spark, sf_dir).groupBy("race_id").agg(F.first("distance_m").alias("distance_m"), (F.min("day") % 20 + base).alias("day"))
    found = mornings.on_the_road(races, hourly)
    return found.select("race_id", "hours", *[F.round(c, 5).alias(c) for c in ("temp_c", "east", "north", "speed")])


@query(""" v AS (SELECT vec_id, embedding[1]::DOUBLE + 3 AS one, embedding[2]::DOUBLE AS other FROM embeddings), b AS (SELECT *, CASE WHEN one > 0 AND other > 0 THEN exp(0.35::DOUBLE * ln(one) + 0.65::DOUBLE * ln(other)) END AS centre FROM v)
SELECT vec_id, round(centre, 5) AS centre, round(coalesce(centre / one, 1), 5) AS factor FROM b""", with_results=False)
def blend_factors(spark, sf_dir):
    """What every draw of a runner is multiplied by; 1 where a model lacks."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.get("embedding", 0).cast("double") + 3).alias("one"), F.get("embedding", 1).cast("double").alias("other"))
    centre = mornings.blend(F.col("one"), F.col("other"))
    return rows.select("vec_id", F.round(centre, 5).alias("centre"), F.round(F.coalesce(centre / F.col("one"), F.lit(1.0)), 5).alias("factor"))


@query(""" m AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 20000.0::DOUBLE AS m FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN m < 1 THEN round_even(round(m * 60, 6), 0)::BIGINT || ' sec' ELSE printf('%.1f', round_even(round(m * 10, 6), 0) / 10) || ' min' END AS text FROM m""", with_results=False)
def error_texts(spark, sf_dir):
    m = F.col("l_extendedprice") / F.lit(20000.0)
    rows = table(spark, sf_dir, "lineitem").withColumn("m", m.cast("double"))
    return rows.select("l_orderkey", "l_linenumber", courses.error_text(F.col("m")).alias("text"))


_AT = "(-4.60::DOUBLE + 0.182258::DOUBLE * (d / t) + 0.000104::DOUBLE * (d / t) * (d / t)) / (0.8::DOUBLE + 0.1894393::DOUBLE * exp(-0.012778::DOUBLE * t) + 0.2989558::DOUBLE * exp(-0.1932605::DOUBLE * t))"


@query(f""" halves AS (SELECT d, list_reduce(list_transform(range(61), lambda k: {{'lo': 3.0::DOUBLE, 'hi': 240.0::DOUBLE}}), lambda a, b: CASE WHEN {_AT.replace('t)', '((a.lo + a.hi) / 2))').replace('* t', '* ((a.lo + a.hi) / 2)').replace('/ t', '/ ((a.lo + a.hi) / 2)')} > 50 THEN {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} END) AS f FROM (SELECT DISTINCT distance_m AS d FROM results)
), refs AS (SELECT d AS distance_m, (f.lo + f.hi) * 30 AS reference FROM halves) SELECT entry_id, round(reference, 3) AS reference, round(ln(seconds / reference), 6) AS log_ratio FROM results JOIN refs USING (distance_m) WHERE seconds IS NOT NULL""")
def reference_ratios(spark, sf_dir):
    """Finishes against what a fitness of 50 would run; the reference is found once a distance."""
    rows = results(spark, sf_dir).where("seconds is not null")
    refs = rows.select("distance_m").distinct().withColumn("reference", running.race_time(F.lit(50.0), F.col("distance_m")))
    return rows.join(refs, "distance_m").select("entry_id", F.round("reference", 3).alias("reference"), F.round(F.log(F.col("seconds") / F.col("reference")), 6).alias("log_ratio"))


@query(""" q AS (SELECT vec_id, list_transform([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95], lambda p: p) AS z, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, unnest(e) AS v FROM q)
SELECT vec_id, round(quantile_cont(v, 0.1), 5) AS low80, round(quantile_cont(v, 0.9), 5) AS high80, round(quantile_cont(v, 0.05), 5) AS low90, round(quantile_cont(v, 0.95), 5) AS high90 FROM u GROUP BY vec_id""", with_results=False)
def interval_edges(spark, sf_dir):
    """The edges of central intervals among the quantiles carried."""
    q = field.quantiles(field.draws(table(spark, sf_dir, "embeddings")))
    names = [c for c in q.columns if c != "vec_id"]
    out = []
    for level in (80, 90):
        low, high = field.bounds_for(level / 100)
        out += [F.col(names[low]).alias(f"low{level}"), F.col(names[high]).alias(f"high{level}")]
    return q.select("vec_id", *out)
