"""The registered queries: each as a Spark plan, and as SQL for a second engine where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.functions import printed, running
from lapwing.operators import asof, features, field, identity, publish, scoring
from lapwing.plans import archive, calendars, cards, catalogue, exports, models, mornings, reading, review, simulation, stations  # noqa: F401  register their queries
from lapwing.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from lapwing.sources.results import results, table
from lapwing.sources.shared import new_path
from lapwing.streaming import events as streaming

_EXPONENT = "(CASE WHEN {0} < 2000 THEN 1.08 WHEN {0} < 3000 THEN 1.075 WHEN {0} < 4828.032 THEN 1.07 ELSE 1.06 END)::DOUBLE"
_LATEST = f"""
latest AS (
  SELECT target, max_by(struct_pack(s := seconds, d := distance_m, r := race_id, dt := race_date, e := entry_id), struct_pack(a := race_date, b := race_id, c := entry_id)) AS l, count(*) AS depth,
    sum((day >= target_day - 548)::INT) AS recent, min(race_date) AS first_date FROM past GROUP BY target
), editions AS (
  SELECT course_id, race_date, race_id, count(*) AS finishers, quantile_cont(seconds, 0.5) AS median FROM results WHERE seconds IS NOT NULL GROUP BY ALL
), linked AS (
  SELECT e.*, p.race_id AS previous_id, p.finishers AS previous_finishers, p.median AS previous_median FROM editions e
  ASOF LEFT JOIN editions p ON e.course_id = p.course_id AND e.race_date > p.race_date
), scored AS (
  SELECT r.*, coalesce(depth, 0) AS depth, CASE WHEN depth IS NULL THEN '0' WHEN depth = 1 THEN '1' WHEN depth <= 3 THEN '2-3' ELSE '4+' END AS stratum,
    l.s * pow(r.distance_m / l.d, {_EXPONENT.format("r.distance_m")}) AS carry,
    (SELECT CASE WHEN count(*) FILTER (WHERE h.sex = r.sex AND h.age_band = r.age_band) >= 3 THEN quantile_cont(h.seconds, 0.5) FILTER (WHERE h.sex = r.sex AND h.age_band = r.age_band)
        WHEN count(*) FILTER (WHERE h.sex = r.sex) >= 3 THEN quantile_cont(h.seconds, 0.5) FILTER (WHERE h.sex = r.sex) ELSE quantile_cont(h.seconds, 0.5) END
      FROM results h WHERE h.race_id = k.previous_id AND h.seconds IS NOT NULL) AS median
  FROM results r LEFT JOIN latest ON target = r.entry_id LEFT JOIN linked k ON k.race_id = r.race_id WHERE r.seconds IS NOT NULL
)"""


def _scored(spark, sf_dir: str) -> DataFrame:
    return scoring.scored(results(spark, sf_dir))


@query(_LATEST + " SELECT entry_id, stratum, round(carry, 6) AS predicted, round(seconds, 6) AS seconds FROM scored")
def carry_forward(spark, sf_dir):
    return _scored(spark, sf_dir).select("entry_id", "stratum", F.round("carry", 6).alias("predicted"), F.round("seconds", 6).alias("seconds"))


_SUMMARY = """, x AS (SELECT *, {0} - seconds AS g FROM scored)
SELECT coalesce(stratum, 'all') AS stratum, count(*) AS runners, count({0}) AS answered, round(count({0}) / count(*), 6) AS coverage, round(avg(abs(g) / 60), 6) AS mae,
  round(avg(abs(g) / seconds), 6) AS mape, round(avg(g / 60), 6) AS bias FROM x GROUP BY ROLLUP (stratum)"""


@query(_LATEST + _SUMMARY.format("carry"))
def carry_forward_mae_by_depth(spark, sf_dir):
    return scoring.summary(_scored(spark, sf_dir), "carry", "stratum")


@query(_LATEST + _SUMMARY.format("median"))
def category_median_mae_by_depth(spark, sf_dir):
    return scoring.summary(_scored(spark, sf_dir), "median", "stratum")


@query(_LATEST + " SELECT entry_id, coalesce(depth, 0) AS depth, coalesce(recent, 0)::BIGINT AS recent, first_date FROM results LEFT JOIN latest ON target = entry_id")
def history_depth(spark, sf_dir):
    return asof.with_history(results(spark, sf_dir)).select("entry_id", "depth", "recent", "first_date")


@query(_LATEST + " SELECT entry_id, l.r AS race_id, l.e AS latest_entry, datediff('day', l.dt, race_date)::INT AS days_since, round(l.s, 6) AS seconds FROM results JOIN latest ON target = entry_id")
def latest_before(spark, sf_dir):
    rows = asof.with_history(results(spark, sf_dir)).where("latest is not null")
    return rows.select("entry_id", F.col("latest.race_id").alias("race_id"), F.col("latest.entry_id").alias("latest_entry"), (F.col("day") - F.col("latest.day")).alias("days_since"), F.round("latest.seconds", 6).alias("seconds"))


@query(_LATEST + " SELECT race_id, finishers, round(median, 6) AS median, previous_id, previous_finishers, round(previous_median, 6) AS previous_median FROM linked")
def previous_edition(spark, sf_dir):
    rows = asof.previous_editions(results(spark, sf_dir))
    return rows.select("race_id", "finishers", F.round("median", 6).alias("median"), "previous_id", "previous_finishers", F.round("previous_median", 6).alias("previous_median"))


@query(_LATEST + """, planted AS (SELECT r.entry_id, r.race_date, CASE WHEN r.entry_id % 5 = 0 THEN r.race_date ELSE l.dt END AS last, first_date FROM results r LEFT JOIN latest ON target = r.entry_id)
SELECT count(*) AS leaks FROM planted WHERE last >= race_date OR first_date >= race_date""")
def leakage_check(spark, sf_dir):
    """Counts the leaks of a history into which every fifth entry's own day was put."""
    rows = asof.with_history(results(spark, sf_dir))
    last = F.when(F.col("entry_id") % 5 == 0, F.struct(F.col("race_date").alias("race_date"))).otherwise(F.struct(F.col("latest.race_date").alias("race_date")))
    return asof.leaks(rows.withColumn("latest", last))


_VDOT = "(-4.60::DOUBLE + 0.182258::DOUBLE * ({d} / ({s} / 60.0::DOUBLE)) + 0.000104::DOUBLE * ({d} / ({s} / 60.0::DOUBLE)) * ({d} / ({s} / 60.0::DOUBLE))) / (0.8::DOUBLE + 0.1894393::DOUBLE * exp(-0.012778::DOUBLE * ({s} / 60.0::DOUBLE)) + 0.2989558::DOUBLE * exp(-0.1932605::DOUBLE * ({s} / 60.0::DOUBLE)))"


@query(f""" v AS (SELECT entry_id, {_VDOT.format(d='distance_m', s='seconds')} AS v, seconds FROM results WHERE seconds IS NOT NULL)
SELECT entry_id, CASE WHEN seconds / 60 BETWEEN 3 AND 240 AND v BETWEEN 20 AND 90 THEN round(v, 6) END AS vdot, CASE WHEN NOT (seconds / 60 BETWEEN 3 AND 240 AND v BETWEEN 20 AND 90) THEN 'out of range' END AS reason FROM v""")
def vdot(spark, sf_dir):
    rows = results(spark, sf_dir).where("seconds is not null")
    value = running.vdot(F.col("distance_m"), F.col("seconds"))
    return rows.select("entry_id", F.round(value, 6).alias("vdot"), F.when(value.isNull(), "out of range").alias("reason"))


def _bisected(v: str, d: str) -> str:
    """SQL of the minutes at which a fitness covers a distance: 60 halvings in one list."""
    at = _VDOT.format(d=d, s="(a.lo + a.hi) * 30.0::DOUBLE")
    ends = [_VDOT.format(d=d, s=f"{60 * m}.0::DOUBLE") for m in (3, 240)]
    start = "list_transform(range(61), lambda k: {'lo': 3.0::DOUBLE, 'hi': 240.0::DOUBLE})"
    step = f"CASE WHEN {at} > {v} THEN {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} END"
    return f"CASE WHEN {ends[0]} >= {v} AND {ends[1]} <= {v} THEN list_reduce({start}, lambda a, b: {step}) END"


@query(f""" v AS (SELECT entry_id, seconds, {_VDOT.format(d='distance_m', s='seconds')} AS v FROM results WHERE seconds IS NOT NULL)
SELECT entry_id, round(seconds, 3) AS seconds, CASE WHEN seconds / 60 BETWEEN 3 AND 240 AND v BETWEEN 20 AND 90 THEN round(seconds, 3) END AS again FROM v""")
def race_time_bisection(spark, sf_dir):
    """From a time to its fitness and back again: the same time."""
    rows = results(spark, sf_dir).where("seconds is not null")
    value = running.vdot(F.col("distance_m"), F.col("seconds"))
    return rows.select("entry_id", F.round("seconds", 3).alias("seconds"), F.round(running.race_time(value, F.col("distance_m")), 3).alias("again"))


@query(f""" h AS (SELECT target, max(CASE WHEN seconds / 60 BETWEEN 3 AND 240 AND v BETWEEN 20 AND 90 THEN v END) AS best FROM (SELECT target, seconds, {_VDOT.format(d='distance_m', s='seconds')} AS v FROM past WHERE day >= target_day - 548) GROUP BY target
), b AS (SELECT entry_id, best, {_bisected("best", "distance_m")} AS f FROM results LEFT JOIN h ON target = entry_id WHERE seconds IS NOT NULL)
SELECT entry_id, round(best, 6) AS best, round((f.lo + f.hi) * 30, 3) AS predicted FROM b""")
def best_equal_vdot(spark, sf_dir):
    """The best fitness of the recent window, carried to the target's distance; null where nothing is in range."""
    rows = results(spark, sf_dir).withColumn("v", running.vdot(F.col("distance_m"), F.col("seconds")))
    rows = rows.withColumn("best", F.max("v").over(asof.strict(back=asof.RECENT_DAYS))).where("seconds is not null")
    return rows.select("entry_id", F.round("best", 6).alias("best"), F.round(running.race_time(F.col("best"), F.col("distance_m")), 3).alias("predicted"))


@query(f" x AS (SELECT p_partkey, p_size * 200.0::DOUBLE AS d FROM part) SELECT p_partkey, {_EXPONENT.format('d')} AS exponent, round(1000 * pow(d / 1000, {_EXPONENT.format('d')}), 4) AS seconds FROM x", with_results=False)
def riegel_exponent(spark, sf_dir):
    d = F.col("p_size") * F.lit(200.0)
    return table(spark, sf_dir, "part").select("p_partkey", running.riegel_exponent(d).alias("exponent"), F.round(running.riegel(F.lit(1000.0), F.lit(1000.0), d), 4).alias("seconds"))


@query(""" s AS (SELECT entry_id, round_even(seconds, 0)::BIGINT AS s FROM results WHERE seconds IS NOT NULL)
SELECT entry_id, (s // 3600)::VARCHAR || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock, s AS parsed FROM s""")
def clock_format_and_parse(spark, sf_dir):
    rows = results(spark, sf_dir).where("seconds is not null").withColumn("clock", running.clock(F.col("seconds")))
    return rows.select("entry_id", "clock", running.clock_seconds(F.col("clock")).alias("parsed"))


@query(""" SELECT entry_id, substr(age_band, 1, 2)::INT AS age_low, substr(age_band, 4, 2)::INT AS age_high, year(race_date)::INT - substr(age_band, 4, 2)::INT - 1 AS born_from, year(race_date)::INT - substr(age_band, 1, 2)::INT AS born_to FROM results""".replace(" SELECT", " z AS (SELECT 1) SELECT", 1))
def age_range(spark, sf_dir):
    low, high = F.substring("age_band", 1, 2).cast("int"), F.substring("age_band", 4, 2).cast("int")
    return results(spark, sf_dir).select("entry_id", low.alias("age_low"), high.alias("age_high"), (F.year("race_date") - high - 1).alias("born_from"), (F.year("race_date") - low).alias("born_to"))


@query(""" g AS (SELECT l_orderkey, l_linenumber, greatest(least(l_tax * 12 - 0.5::DOUBLE, 0.45::DOUBLE), -0.45::DOUBLE) AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, round((155.4::DOUBLE * pow(i, 5) - 30.4::DOUBLE * pow(i, 4) - 43.3::DOUBLE * pow(i, 3) + 46.3::DOUBLE * pow(i, 2) + 19.5::DOUBLE * i + 3.6::DOUBLE) / 3.6::DOUBLE, 6) AS cost FROM g""", with_results=False)
def gradient_cost(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(running.gradient_cost(F.col("l_tax") * 12 - F.lit(0.5)), 6).alias("cost"))


@query(""" p AS (SELECT s_suppkey, (s_acctbal - 5000) / 100.0::DOUBLE AS lat, s_suppkey % 360 - 180.0::DOUBLE AS lon FROM supplier)
SELECT s_suppkey, round(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((radians(45) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(45)) * pow(sin(radians(7 - lon) / 2), 2))), 3) AS metres FROM p""", with_results=False)
def haversine(spark, sf_dir):
    lat, lon = (F.col("s_acctbal") - 5000) / F.lit(100.0), F.col("s_suppkey") % 360 - F.lit(180.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(running.haversine(lat, lon, F.lit(45.0), F.lit(7.0)), 3).alias("metres"))


@query(""" h AS (SELECT event_id, value / 16.0::DOUBLE AS t, least(value / 800.0::DOUBLE, 1.0::DOUBLE) AS s FROM events) SELECT event_id, round(greatest(0.0::DOUBLE, t + 2.1::DOUBLE * s - 12.0::DOUBLE), 4) AS heat FROM h""", with_results=False)
def felt_heat(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(running.felt_heat(F.col("value") / F.lit(16.0), F.least(F.col("value") / F.lit(800.0), F.lit(1.0))), 4).alias("heat"))


@query(r""" z AS (SELECT 1) SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer""", with_results=False)
def name_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", printed.name_key(F.col("c_name")).alias("key"))


@query(_LATEST + """, r AS (SELECT race_id, entry_id, rank() OVER (PARTITION BY race_id ORDER BY seconds) + (count(*) OVER (PARTITION BY race_id, seconds) - 1) / 2 AS a,
    rank() OVER (PARTITION BY race_id ORDER BY carry) + (count(*) OVER (PARTITION BY race_id, carry) - 1) / 2 AS p FROM scored WHERE carry IS NOT NULL)
SELECT race_id, count(*) AS runners, round(avg(abs(p - a)), 6) AS place_gap, CASE WHEN stddev_pop(p) > 0 AND stddev_pop(a) > 0 THEN round(corr(p, a), 6) END AS spearman FROM r GROUP BY race_id HAVING count(*) >= 3""")
def place_error_spearman(spark, sf_dir):
    return scoring.place_errors(_scored(spark, sf_dir), "carry")


_SPREAD = """, m AS (SELECT {0} AS band, abs(carry - seconds) / 60 AS miss FROM scored WHERE carry IS NOT NULL)
SELECT band, count(*) AS runners, round(quantile_cont(miss, 0.5), 6) AS median_miss, round(list_sort(list(miss))[least(floor(count(*) * 0.9::DOUBLE)::BIGINT, count(*) - 1) + 1], 6) AS p90_miss FROM m GROUP BY band"""


@query(_LATEST + _SPREAD.format("CASE WHEN distance_m < 3000 THEN 0 WHEN distance_m < 6000 THEN 1 WHEN distance_m < 9000 THEN 2 WHEN distance_m < 12000 THEN 3 WHEN distance_m < 18000 THEN 4 ELSE 5 END"))
def error_by_distance_band(spark, sf_dir):
    return scoring.spread(_scored(spark, sf_dir), "carry", scoring.band_of(F.col("distance_m")))


@query(_LATEST + ", f AS (SELECT *, (rank() OVER (PARTITION BY race_id ORDER BY seconds) - 0.5) / count(*) OVER (PARTITION BY race_id) AS share FROM scored), scored2 AS (SELECT *, CASE WHEN share < 0.25 THEN 'front' WHEN share < 0.75 THEN 'mid' ELSE 'back' END AS position FROM f)" + _SPREAD.format("position").replace("FROM scored", "FROM scored2"))
def error_by_field_position(spark, sf_dir):
    return scoring.spread(scoring.field_position(_scored(spark, sf_dir)), "carry", F.col("position"))


@query(""" e AS (SELECT course_id, race_id, race_date, count(*) AS finishers, min(seconds) AS best, quantile_cont(seconds, 0.5) AS median FROM results WHERE seconds IS NOT NULL GROUP BY ALL)
SELECT race_id, finishers, round(best, 6) AS best, round(median, 6) AS median, row_number() OVER (PARTITION BY course_id ORDER BY race_date) AS edition FROM e""")
def editions_summary(spark, sf_dir):
    from pyspark.sql import Window

    rows = results(spark, sf_dir).where("seconds is not null").groupBy("course_id", "race_id", "race_date").agg(F.count("*").alias("finishers"), F.min("seconds").alias("best"), F.percentile("seconds", F.lit(0.5)).alias("median"))
    return rows.select("race_id", "finishers", F.round("best", 6).alias("best"), F.round("median", 6).alias("median"), F.row_number().over(Window.partitionBy("course_id").orderBy("race_date")).alias("edition"))


@query(""" c AS (SELECT course_id, floor(seconds / 10)::BIGINT + 1 AS step, count(*) AS n FROM results WHERE seconds IS NOT NULL GROUP BY ALL)
SELECT course_id, step * 10 AS under, sum(n) OVER (PARTITION BY course_id ORDER BY step)::BIGINT AS finished FROM c""")
def finish_curve(spark, sf_dir):
    from pyspark.sql import Window

    rows = results(spark, sf_dir).where("seconds is not null").groupBy("course_id", (F.floor(F.col("seconds") / 10) + 1).alias("step")).agg(F.count("*").alias("n"))
    return rows.select("course_id", (F.col("step") * 10).alias("under"), F.sum("n").over(Window.partitionBy("course_id").orderBy("step")).alias("finished"))


@query(_LATEST + """, m AS (SELECT stratum, abs(carry - seconds) / seconds AS a, abs(median - seconds) / seconds AS b FROM scored WHERE carry IS NOT NULL AND median IS NOT NULL)
SELECT stratum, count(*) AS runners, round(avg(a - b) * 100, 6) AS gap_points, round(avg((a < b)::INT), 6) AS won FROM m GROUP BY stratum""")
def paired_error(spark, sf_dir):
    return scoring.paired(_scored(spark, sf_dir), "carry", "median")


_MASK = "& 18446744073709551615::UHUGEINT"
_BOOTSTRAP = """, units AS (SELECT stratum, {unit} AS unit, sum({value})::DOUBLE AS total, count({value}) AS n FROM {rows} GROUP BY ALL HAVING count({value}) > 0
), seeds AS (SELECT *, ('0x' || substr(md5(unit::VARCHAR), 1, 15))::BIGINT::UHUGEINT AS seed FROM units
), x1 AS (SELECT stratum, total, n, draw, (seed + draw::UHUGEINT * 11400714819323198485::UHUGEINT) {mask} AS x FROM seeds, range(1, 2001) d(draw)
), x2 AS (SELECT stratum, total, n, draw, (xor(x, x >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) {mask} AS x FROM x1
), x3 AS (SELECT stratum, total, n, draw, (xor(x, x >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) {mask} AS x FROM x2
), x4 AS (SELECT stratum, total, n, draw, xor(x, x >> 31::UHUGEINT)::UBIGINT AS x FROM x3
), drawn AS (SELECT stratum, draw, total, n, {times} AS w FROM x4
), means AS (SELECT stratum, draw, sum(w * total) / nullif(sum(w * n), 0) AS mean FROM drawn GROUP BY ALL
), limits AS (SELECT stratum, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM means GROUP BY stratum)"""
_INTERVAL = _BOOTSTRAP + """
SELECT stratum, round(sum(total) / sum(n), 6) AS point, sum(n)::BIGINT AS n, any_value(low) AS low, any_value(high) AS high FROM units JOIN limits USING (stratum) GROUP BY stratum"""
_TIMES = " + ".join(f"(x >= {int(c)}::UBIGINT)::INT" for c in scoring.CUTS)


def _bootstrapped(text: str, unit: str, value: str, rows: str = "scored") -> str:
    return text.format(unit=unit, value=value, rows=rows, mask=_MASK, times=_TIMES)


def _seed(unit: str):
    """A unit's seed, in any engine with md5."""
    return F.conv(F.substring(F.md5(F.col(unit).cast("string")), 1, 15), 16, 10).cast("long")


@query(_LATEST + _bootstrapped(_INTERVAL, "entry_id", "abs(carry - seconds) / 60"))
def bootstrap_mae_ci(spark, sf_dir):
    return scoring.bootstrap_whole(_scored(spark, sf_dir), "entry_id", F.abs(F.col("carry") - F.col("seconds")) / 60, "stratum", seed=_seed("entry_id"))


@query(_LATEST + _bootstrapped(_INTERVAL, "race_id", "(abs(carry - seconds) / seconds < 0.1)::INT"))
def cluster_bootstrap_rate(spark, sf_dir):
    return scoring.bootstrap_whole(_scored(spark, sf_dir), "race_id", (F.abs(F.col("carry") - F.col("seconds")) / F.col("seconds") < 0.1).cast("int"), "stratum", seed=_seed("race_id"))


@query(_LATEST + _bootstrapped(", both_ AS (SELECT *, abs(ln(carry / seconds)) - abs(ln(median / seconds)) AS gap FROM scored WHERE carry IS NOT NULL AND median IS NOT NULL)" + _BOOTSTRAP, "race_id", "gap * 100", "both_") + """
, sums AS (SELECT stratum, count(DISTINCT race_id) AS races, count(*) AS runners, round(avg(abs(carry - seconds)), 6) AS model_mae, round(avg(abs(median - seconds)), 6) AS other_mae, round(avg(gap) * 100, 6) AS difference FROM both_ GROUP BY stratum)
SELECT s.*, low, high FROM sums s JOIN limits l USING (stratum)""")
def paired_error_interval(spark, sf_dir):
    """Two models on the runners that both answer, with the interval over resampled races."""
    return scoring.paired_interval(_scored(spark, sf_dir), "carry", "median", seed=_seed("race_id"))


@query()
def bootstrap_mae_ci_2000(spark, sf_dir):
    return scoring.bootstrap_whole(_scored(spark, sf_dir), "entry_id", F.abs(F.col("carry") - F.col("seconds")) / 60, "stratum")


@query()
def cluster_bootstrap_rate_2000(spark, sf_dir):
    return scoring.bootstrap_whole(_scored(spark, sf_dir), "race_id", (F.abs(F.col("carry") - F.col("seconds")) / F.col("seconds") < 0.1).cast("int"), "stratum")


_ROLLING = """, own AS (SELECT *, greatest(ln(carry * 0.9::DOUBLE) - ln(seconds), ln(seconds) - ln(carry * 1.1::DOUBLE)) AS score FROM scored WHERE carry IS NOT NULL
), dates AS (SELECT DISTINCT stratum, race_date FROM own
), cut AS (SELECT d.stratum, d.race_date, count(o.score) AS pool, list_sort(list(o.score)) AS l FROM dates d LEFT JOIN own o ON o.stratum = d.stratum AND o.race_date < d.race_date GROUP BY ALL
), thresholds AS (SELECT stratum, race_date, pool, CASE WHEN pool < 50 THEN NULL WHEN ceil((pool + 1) * 0.8::DOUBLE) > pool THEN 'inf'::DOUBLE ELSE l[ceil((pool + 1) * 0.8::DOUBLE)::BIGINT] END AS threshold FROM cut)"""


@query(_LATEST + _ROLLING + " SELECT stratum, race_date, pool, round(threshold, 6) AS threshold FROM thresholds")
def rolling_conformal(spark, sf_dir):
    rows = scoring.rolling_thresholds(scoring.intervals(scoring.carried(results(spark, sf_dir))))
    return rows.withColumn("threshold", F.round("threshold", 6))


@query(_LATEST + _ROLLING + """ SELECT stratum, count(*) AS runners, round(avg((seconds BETWEEN carry * 0.9::DOUBLE AND carry * 1.1::DOUBLE)::INT), 6) AS raw,
  round(avg((seconds BETWEEN carry * 0.9::DOUBLE * exp(-threshold) AND carry * 1.1::DOUBLE * exp(threshold))::INT), 6) AS adjusted FROM own JOIN thresholds USING (stratum, race_date) WHERE threshold IS NOT NULL GROUP BY stratum""")
def coverage_by_stratum(spark, sf_dir):
    return scoring.coverage(scoring.intervals(scoring.carried(results(spark, sf_dir))))


def _people(spark, sf_dir):
    """Customers, whole: each seventh is an entrant, all others are runners; keys grow in number with the table."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_custkey").alias("id"), F.expr("cast(c_custkey div 4 as string)").alias("key"), F.when(F.col("c_custkey") % 11 > 0, F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M")).alias("sex"), F.col("n_name").alias("hometown"))
    return rows.where("id % 7 = 0"), rows.where("id % 7 <> 0")


_LINK = """ people AS (SELECT c_custkey AS id, (c_custkey // 4)::VARCHAR AS key, CASE WHEN c_custkey % 11 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END END AS sex, n_name AS hometown FROM customer JOIN nation ON c_nationkey = n_nationkey
), pairs AS (SELECT e.id AS entrant_id, r.id AS rid, e.hometown = r.hometown AS near FROM people e LEFT JOIN people r ON e.key = r.key AND r.id % 7 <> 0 AND (e.sex IS NULL OR r.sex IS NULL OR e.sex = r.sex) WHERE e.id % 7 = 0
), picked AS (SELECT entrant_id, CASE WHEN count(rid) = 1 THEN max(rid) WHEN count(rid) FILTER (WHERE near) = 1 THEN max(rid) FILTER (WHERE near) END AS pick, count(rid) AS n FROM pairs GROUP BY entrant_id
), claimed AS (SELECT *, count(*) OVER (PARTITION BY pick) AS claims FROM picked
), linked AS (SELECT entrant_id, CASE WHEN n = 0 THEN 'new' WHEN pick IS NULL OR claims > 1 THEN 'ambiguous' ELSE 'linked' END AS status, CASE WHEN claims = 1 THEN pick END AS runner_id FROM claimed)"""


@query(_LINK + " SELECT * FROM linked", with_results=False)
def link_entrants(spark, sf_dir):
    return identity.link(*_people(spark, sf_dir))


@query(_LINK + " SELECT s.status, count(entrant_id) AS entrants FROM (VALUES ('new'), ('linked'), ('ambiguous')) s(status) LEFT JOIN linked USING (status) GROUP BY s.status", with_results=False)
def link_status_counts(spark, sf_dir):
    every = spark.createDataFrame([("new",), ("linked",), ("ambiguous",)], "status string")
    return every.join(identity.link(*_people(spark, sf_dir)), "status", "left").groupBy("status").agg(F.count("entrant_id").alias("entrants"))


@query(""" people AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 1000 < 500 THEN 'a' || (c_custkey // 3) ELSE 'b' || (c_custkey // 9) END AS key, CASE WHEN c_custkey % 11 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END END AS sex, n_name AS hometown FROM customer JOIN nation ON c_nationkey = n_nationkey
), pairs AS (SELECT e.id AS entrant_id, r.id AS rid, e.hometown = r.hometown AS near FROM people e LEFT JOIN people r ON e.key = r.key AND r.id % 7 <> 0 AND (e.sex IS NULL OR r.sex IS NULL OR e.sex = r.sex) WHERE e.id % 7 = 0
), picked AS (SELECT entrant_id, CASE WHEN count(rid) = 1 THEN max(rid) WHEN count(rid) FILTER (WHERE near) = 1 THEN max(rid) FILTER (WHERE near) END AS pick, count(rid) AS n FROM pairs GROUP BY entrant_id
), claimed AS (SELECT *, count(*) OVER (PARTITION BY pick) AS claims FROM picked)
SELECT entrant_id, CASE WHEN n = 0 THEN 'new' WHEN pick IS NULL OR claims > 1 THEN 'ambiguous' ELSE 'linked' END AS status, CASE WHEN claims = 1 THEN pick END AS runner_id FROM claimed""", with_results=False)
def link_whole_table(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.expr("if(c_custkey % 1000 < 500, 'a' || (c_custkey div 3), 'b' || (c_custkey div 9))")
    people = rows.select(F.col("c_custkey").alias("id"), key.alias("key"), F.when(F.col("c_custkey") % 11 > 0, F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M")).alias("sex"), F.col("n_name").alias("hometown"))
    return identity.link(people.where("id % 7 = 0"), people.where("id % 7 <> 0"))


@query(""" n AS (SELECT *, coalesce((lag(event_type) OVER w <> event_type)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS rows FROM g GROUP BY user_id, run""", with_results=False)
def consecutive_runs(spark, sf_dir):
    return identity.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(""" z AS (SELECT 1) SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, min_by(event_id, (ts, event_id)) AS first, count(*) AS lines FROM events GROUP BY user_id""", with_results=False)
def standing_lines(spark, sf_dir):
    return identity.standing(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "first", "lines")


@query(""" k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('click', 'view', 'purchase'))
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.k, b.k) AS k, a.event_id AS earlier, b.event_id AS later FROM (SELECT * FROM k WHERE event_type = 'click') a FULL JOIN (SELECT * FROM k WHERE event_type = 'view') b USING (user_id, k)""", with_results=False)
def kth_occurrence_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return identity.occurrences(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "user_id", "event_id")


@query(""" p AS (SELECT source, 1 - quality AS said, toxic FROM labels JOIN documents USING (doc_id)) SELECT coalesce(source, 'all') AS source, count(*) AS pairs,
  round(sum(said * toxic) / nullif(sum(said), 0), 6) AS precision, round(sum(said * toxic) / nullif(sum(toxic), 0), 6) AS recall FROM p GROUP BY ROLLUP (source)""", with_results=False)
def pair_precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return identity.precision_recall(rows.withColumn("said", 1 - F.col("quality")), "source", "said", "toxic")


_FORM = """ hr AS (SELECT target, target_day, day, entry_id, course_id, ln(seconds / (distance_m * 0.3::DOUBLE)) AS r FROM past
), f AS (SELECT target, count(*) AS results, max_by(r, (day, entry_id)) AS last, min(r) AS best, min(r) FILTER (WHERE day >= target_day - 548) AS best_recent, stddev_pop(r) AS sd, (max(day) - min(day)) / 365.25::DOUBLE AS span,
    regr_slope(r, day / 365.25::DOUBLE) AS slope, any_value(target_day) - max(day) AS since, sum(r * pow(0.5::DOUBLE, (target_day - day) / 365.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (target_day - day) / 365.0::DOUBLE)) AS decayed, count(DISTINCT course_id) AS courses,
    avg(r) FILTER (WHERE day >= target_day - 365) - avg(r) FILTER (WHERE day BETWEEN target_day - 730 AND target_day - 366) AS improvement FROM hr GROUP BY target)
SELECT r.entry_id, coalesce(results, 0) AS results, round(last, 6) AS last_ratio, round(best, 6) AS best_ever, round(best_recent, 6) AS best_recent, round(last - best, 6) AS gap_to_best, CASE WHEN results >= 2 THEN round(sd, 6) END AS consistency,
  CASE WHEN results >= 3 AND span >= 0.5 THEN round(slope, 6) END AS trend_per_year, since AS days_since, round(decayed, 6) AS form_weighted, coalesce(courses, 0)::INT AS courses, round(improvement, 6) AS improvement, round(results / greatest(span, 0.5), 6) AS races_per_year
FROM results r LEFT JOIN f ON f.target = r.entry_id"""


@query(_FORM)
def gbm_features(spark, sf_dir):
    return features.form(results(spark, sf_dir)).withColumn("races_per_year", F.when(F.col("results") > 0, F.col("races_per_year")))


@query(""" f AS (SELECT t.entry_id, count(p.day) FILTER (WHERE p.course_id = t.course_id) AS a, count(p.day) FILTER (WHERE p.day >= t.day - 61) AS b, count(p.day) FILTER (WHERE p.day >= t.day - 183) AS c,
  count(p.day) FILTER (WHERE year(p.race_date) = year(t.race_date)) AS d, count(p.day) FILTER (WHERE p.day BETWEEN t.day - 395 AND t.day - 335) AS e, count(p.day) AS g FROM results t LEFT JOIN past p ON p.target = t.entry_id GROUP BY t.entry_id)
SELECT entry_id, round(ln(1 + a), 6) AS on_course, round(ln(1 + b), 6) AS in_61, round(ln(1 + c), 6) AS in_183, round(ln(1 + d), 6) AS this_year, (e > 0)::INT AS year_ago, round(ln(1 + g), 6) AS ever FROM f""")
def participation_features(spark, sf_dir):
    return features.participation(results(spark, sf_dir))


@query(""" fin AS (SELECT * FROM results WHERE seconds IS NOT NULL), ed AS (SELECT race_id, min(day) AS at, count(DISTINCT runner_id) AS field FROM fin GROUP BY race_id
), pool AS (SELECT race_id, runner_id, row_number() OVER (PARTITION BY race_id ORDER BY count(*) DESC, runner_id) AS k FROM (SELECT e.race_id, f.runner_id FROM ed e JOIN fin f ON f.day < e.at AND f.day >= e.at - 548) GROUP BY race_id, runner_id
), there AS (SELECT DISTINCT race_id, runner_id FROM fin)
SELECT race_id, any_value(field) AS field, count(k) FILTER (WHERE k <= field) AS hits, round(count(k) FILTER (WHERE k <= field) / any_value(field), 6) AS recall FROM there JOIN ed USING (race_id) LEFT JOIN pool USING (race_id, runner_id) GROUP BY race_id""")
def participation_topk(spark, sf_dir):
    return features.turnout_topk(results(spark, sf_dir))


_EFFECTS = """ m AS (SELECT course_id, race_id, race_date, avg(ln(seconds / (distance_m * 0.3::DOUBLE))) AS mean, count(*) AS n FROM results WHERE seconds IS NOT NULL GROUP BY ALL
), b AS (SELECT *, least(greatest(n, 1), 2000) AS weight FROM m), base AS (SELECT course_id, sum(weight * mean) / sum(weight) AS base, sum(weight * cos(month(race_date) * 3.141592653589793::DOUBLE / 6)) / sum(weight) AS xbase FROM b GROUP BY course_id
), eff AS (SELECT *, mean - base AS effect, cos(month(race_date) * 3.141592653589793::DOUBLE / 6) - xbase AS x FROM b JOIN base USING (course_id))"""


@query(_EFFECTS + " SELECT race_id, n, round(effect, 6) AS effect FROM eff")
def edition_effects(spark, sf_dir):
    return features.edition_effects(results(spark, sf_dir)).select("race_id", "n", F.round("effect", 6).alias("effect"))


@query(_EFFECTS + " SELECT count(*) AS editions, round(sum(weight * x * effect) / sum(weight * x * x) * 100, 6) AS slope_pct, round(pow(sum(weight * x * effect), 2) / sum(weight * x * x) / sum(weight * effect * effect), 6) AS explained FROM eff")
def conditions_wls(spark, sf_dir):
    return features.conditions_fit(results(spark, sf_dir))


@query(_LATEST + """, b AS (SELECT w, abs(ln(carry) * (1 - w / 20) + ln(median) * w / 20 - ln(seconds)) AS miss FROM scored, range(0, 21) g(w) WHERE carry IS NOT NULL AND median IS NOT NULL)
SELECT w / 20 AS weight, count(*) AS runners, round(avg(miss) * 100, 6) AS log_error FROM b GROUP BY w""")
def blend_weight_grid(spark, sf_dir):
    return features.blend_weights(_scored(spark, sf_dir))


_DRAWS = """ d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS draw FROM embeddings), p AS (SELECT *, rank() OVER (PARTITION BY label, draw ORDER BY value) AS place FROM d)"""


def _draws(spark, sf_dir):
    return field.draws(table(spark, sf_dir, "embeddings"))


@query(_DRAWS + " SELECT vec_id, round(quantile_cont(place, 0.5), 6) AS median_place, round(quantile_cont(place, 0.1), 6) AS low_place, round(quantile_cont(place, 0.9), 6) AS high_place, round(avg((place <= 10)::INT), 6) AS top_ten FROM p GROUP BY vec_id", with_results=False)
def place_summary(spark, sf_dir):
    return field.place_summary(_draws(spark, sf_dir))


@query(_DRAWS + ", n AS (SELECT label, draw, count(*) FILTER (WHERE place <= 10 AND vec_id % 2 = 1) AS n FROM p GROUP BY ALL) SELECT label, round(avg(n), 6) AS expected, round(quantile_cont(n, 0.1), 6) AS low, round(quantile_cont(n, 0.9), 6) AS high FROM n GROUP BY label", with_results=False)
def expected_in_top(spark, sf_dir):
    return field.expected_in_top(_draws(spark, sf_dir))


@query(_DRAWS + " SELECT vec_id, " + ", ".join(f"round(quantile_cont(value, {q}), 5) AS q{int(100 * q):02d}" for q in field.QUANTILES) + " FROM d GROUP BY vec_id", with_results=False)
def draw_quantiles(spark, sf_dir):
    return field.quantiles(_draws(spark, sf_dir))


@query(""" w AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS readings, avg(value) AS v, avg(-value * sin(radians(k))) AS u, avg(-value * cos(radians(k))) AS w FROM (SELECT *, (props->>'$.k')::INT % 36 * 10 AS k FROM events) GROUP BY ALL)
SELECT hour, readings, round(v, 6) AS mean_value, round(sqrt(u * u + w * w), 6) AS wind FROM w""", with_results=False)
def hourly_vector_wind(spark, sf_dir):
    return field.hourly_wind(table(spark, sf_dir, "events"))


@query(""" m AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS mean FROM events GROUP BY ALL), g AS (SELECT event_type, value - mean AS gap FROM events JOIN m ON date_trunc('hour', ts) = hour)
SELECT event_type, count(*) AS pairs, round(avg(gap), 6) AS bias, round(stddev_samp(gap), 6) AS deviation FROM g GROUP BY event_type HAVING count(*) >= 3""", with_results=False)
def forecast_error_by_lead(spark, sf_dir):
    return field.forecast_error(table(spark, sf_dir, "events"))


_ITEMS = r"regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)"


@query(f" z AS (SELECT 1) SELECT page_id, len({_ITEMS})::INT AS items, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pages", with_results=False)
def html_list_items(spark, sf_dir):
    return publish.list_items(table(spark, sf_dir, "pages"))


@query(f" z AS (SELECT 1) SELECT page_id, sha256(array_to_string({_ITEMS}, chr(10))) AS digest FROM pages", with_results=False)
def listing_digest(spark, sf_dir):
    return publish.listing_digest(table(spark, sf_dir, "pages"))


@query(""" h AS (SELECT *, runner_id % 10 = 3 AS hidden FROM results WHERE seconds IS NOT NULL)
SELECT race_id, entry_id, CASE WHEN hidden THEN 'Runner ' || row_number() OVER (PARTITION BY race_id, hidden ORDER BY seconds, entry_id) ELSE name END AS name FROM h""")
def redact_rows(spark, sf_dir):
    rows = results(spark, sf_dir).where("seconds is not null")
    return publish.redact(rows, F.col("runner_id") % 10 == 3, ["seconds", "entry_id"]).select("race_id", "entry_id", "name")


def _stream_folder(spark) -> str:
    return new_path(spark, "stream")


@query(" z AS (SELECT 1) SELECT DISTINCT user_id FROM events", with_results=False)
def stream_first_seen(spark, sf_dir):
    """One row for each row that the stream gave: a user given twice would show."""
    stream = streaming.event_stream(spark, f"{sf_dir}/events.parquet")
    return streaming.run_to_table(streaming.first_seen(stream, "60 days"), "first", _stream_folder(spark)).select("user_id")


@query(" z AS (SELECT 1) SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL", with_results=False)
def stream_hourly_windows(spark, sf_dir):
    stream = streaming.event_stream(spark, f"{sf_dir}/events.parquet")
    return streaming.run_to_table(streaming.hourly(stream), "hourly", _stream_folder(spark), "complete")
