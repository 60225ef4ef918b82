"""Queries on reading printed results, spellings and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions import printed
from lapwing.operators import courses as course_effects
from lapwing.operators import resolve as people
from lapwing.plans.registry import query
from lapwing.sources import pages
from lapwing.sources.results import results, table

_NAMES = ["O’Brien ", "Éloïse  ", "Mac Donald ", "Zoë-", "N. "]
_TOWNS = ["St. John's", "Saint Johns", "St Johns", "Ste  Anne", "Paradise"]
_FIRST = ["ann", "anne", "anna", "jon", "john", "jo", "mike"]


def _pick(values: list[str], key):
    return F.element_at(F.array(*map(F.lit, values)), ((F.col(key) if isinstance(key, str) else key) % len(values) + 1).cast("int"))


def _sql(values: list[str], key: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


_FOLD = "strip_accents(lower(replace({0}, '’', '''')))"


@query(f""" n AS (SELECT c_custkey, {_FOLD.format(_sql(_NAMES, 'c_custkey') + ' || c_name')} AS f, {_FOLD.format(_sql(_TOWNS, 'c_custkey'))} AS t FROM customer), w AS (SELECT *, regexp_extract_all(f, '[a-z0-9]+') AS w, regexp_replace(f, '[^a-z0-9]', '', 'g') AS k FROM n)
SELECT c_custkey, k AS name_key, CASE WHEN len(w) < 2 THEN k ELSE w[1][1] || w[-1] END AS initial_key, regexp_replace(regexp_replace(t, '^(st|ste|saint|sainte)\\b\\.?\\s+', 'st '), '[^a-z0-9]', '', 'g') AS town_key FROM w""", with_results=False)
def identity_keys(spark, sf_dir):
    name = F.concat(_pick(_NAMES, "c_custkey"), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", printed.name_key(name).alias("name_key"), printed.initial_key(name).alias("initial_key"), printed.town_key(_pick(_TOWNS, "c_custkey")).alias("town_key"))


@query(f""" t AS (SELECT c_custkey, {_sql(_TOWNS, '(c_custkey % 11)')} || ' ' || c_custkey // 40 AS printed FROM customer), k AS (SELECT *, regexp_replace(regexp_replace({_FOLD.format('printed')}, '^(st|ste|saint|sainte)\\b\\.?\\s+', 'st '), '[^a-z0-9]', '', 'g') AS key, regexp_replace(printed, '\\s+', ' ', 'g') AS shown FROM t),
b AS (SELECT key, shown, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, shown) AS r FROM k GROUP BY key, shown) SELECT DISTINCT printed, b.shown FROM k JOIN b USING (key) WHERE r = 1""", with_results=False)
def town_spellings(spark, sf_dir):
    """Each printed town with the most frequent spelling of its key."""
    rows = table(spark, sf_dir, "customer").select(F.concat(_pick(_TOWNS, F.col("c_custkey") % 11), F.lit(" "), F.floor(F.col("c_custkey") / 40).cast("string")).alias("printed"))
    counts = rows.groupBy("printed").agg(F.count("*").alias("n")).withColumn("shown", printed.clean(printed.repair(F.col("printed")))).withColumn("key", printed.town_key(F.col("shown")))
    best = counts.groupBy("key", "shown").agg(F.sum("n").alias("n")).groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "shown")).alias("best"))
    return counts.select("printed", "key").join(best, "key").select("printed", F.col("best.shown").alias("shown"))


@query(f""" k AS (SELECT DISTINCT c_custkey // 12 AS surname, {_sql(_FIRST, 'c_custkey')} AS f FROM customer)
SELECT a.surname, a.f AS one, b.f AS other FROM k a JOIN k b ON a.surname = b.surname AND a.f < b.f WHERE least(length(a.f), length(b.f)) >= 3 AND (starts_with(a.f, b.f) OR starts_with(b.f, a.f) OR levenshtein(a.f, b.f) = 1)""", with_results=False)
def near_first_names(spark, sf_dir):
    """Spellings of first names under one surname that may be one person's; distinct spellings are paired, not rows."""
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 12).alias("surname"), _pick(_FIRST, "c_custkey").alias("f")).distinct()
    both = rows.alias("a").join(rows.alias("b"), (F.col("a.surname") == F.col("b.surname")) & (F.col("a.f") < F.col("b.f")))
    return both.where(printed.near(F.col("a.f"), F.col("b.f"))).select("a.surname", F.col("a.f").alias("one"), F.col("b.f").alias("other"))


_CELL = "CASE p_partkey % 6 WHEN 0 THEN 'M(' || p_size || ')' WHEN 1 THEN 'F25-29  ' || p_size WHEN 2 THEN 'LM30-34' WHEN 3 THEN p_size || '/106' WHEN 4 THEN p_size::VARCHAR ELSE 'Ben Hale (ANER)' END"


@query(f""" c AS (SELECT p_partkey, p_partkey % 6 AS k, p_size, {_CELL} AS cell FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' END AS sex, CASE k WHEN 1 THEN '25-29' WHEN 2 THEN '30-34' END AS band, CASE WHEN k IN (0, 1, 3, 4) THEN p_size END AS number, CASE WHEN regexp_matches(cell, '\\([A-Z0-9]{{2,6}}\\)$') THEN trim(split_part(cell, '(', 1)) ELSE cell END AS name, nullif(regexp_extract(cell, '\\(([A-Z0-9]{{2,6}})\\)$', 1), '') AS club FROM c""", with_results=False)
def printed_fields(spark, sf_dir):
    cell = F.col("cell")
    rows = table(spark, sf_dir, "part").withColumn("cell", F.expr(_CELL.replace("p_size::VARCHAR", "string(p_size)")))
    both, placing, code, name = printed.sex_and_place(cell), printed.class_placing(cell), printed.class_code(cell), printed.name_and_club(cell)
    return rows.select(
        "p_partkey", F.coalesce(both["sex"], placing["sex"], code["sex"]).alias("sex"), F.coalesce(placing["band"], code["band"]).alias("band"),
        F.coalesce(both["place"], placing["place"], printed.place_of(cell), printed.integer(cell)).alias("number"), name["name"].alias("name"), name["club"].alias("club"),
    )


_BANDS = "CASE p_partkey % 5 WHEN 0 THEN p_size || '-' || (p_size + 9) WHEN 1 THEN 'U' || p_size WHEN 2 THEN p_size || '&U' WHEN 3 THEN p_size || '+' ELSE 'open' END"


@query(""" b AS (SELECT p_partkey, CASE WHEN k = 0 THEN p_size WHEN k IN (1, 2) THEN 5 WHEN k = 3 THEN p_size END AS low, CASE WHEN k = 0 THEN p_size + 9 WHEN k IN (1, 2) THEN p_size WHEN k = 3 THEN 99 END AS high FROM (SELECT *, p_partkey % 5 AS k FROM part))
SELECT p_partkey, low, high, 2024 - high - 1 AS born_first, 2024 - low AS born_last FROM b""", with_results=False)
def printed_age_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("band", F.expr(_BANDS))
    ages, born = printed.age_range(F.col("band")), printed.birth_window(F.col("band"), F.lit("2024-06-01").cast("date"))
    return rows.select("p_partkey", ages["low"].alias("low"), ages["high"].alias("high"), born["first"].alias("born_first"), born["last"].alias("born_last"))


@query(""" f AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY seconds, entry_id) AS place, row_number() OVER (PARTITION BY race_id, sex ORDER BY seconds, entry_id) AS sex_place FROM results WHERE seconds IS NOT NULL)
SELECT race_id, place::INT AS place, entry_id::INT AS bib, name, sex, sex_place::INT AS sex_place, age_band, floor(seconds) AS seconds, hometown FROM f""")
def printed_results(spark, sf_dir):
    """Every race printed as pages and read back from them."""
    rows = pages.printed_results(pages.print_results(results(spark, sf_dir)))
    return rows.select(F.substring_index("page_id", "/", 1).alias("race_id"), "place", "bib", "name", "sex", "sex_place", "age_band", "seconds", "hometown")


@query(""" f AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY seconds, entry_id) AS place FROM results WHERE seconds IS NOT NULL)
SELECT race_id, (place - 1) // 120 AS page, place::INT AS place, entry_id::INT AS bib, CASE WHEN place % 120 = 3 THEN rpad(name, 20, 'x') ELSE name END AS name, age_band, floor(seconds) AS seconds, hometown, NULL::VARCHAR AS problem FROM f WHERE course_id NOT LIKE '5%'
UNION ALL SELECT DISTINCT race_id, (place - 1) // 120, NULL, NULL, NULL, NULL, NULL, NULL, 'no blank columns between the fields' FROM f WHERE course_id LIKE '5%'""")
def unruled_results(spark, sf_dir):
    """Every race printed without rulers and read back: shifted headers, names that reach the times, and pages that no blank column divides."""
    rows = pages.printed_results(pages.print_unruled(results(spark, sf_dir)))
    return rows.select(F.substring_index("page_id", "/", 1).alias("race_id"), F.substring_index("page_id", "/", -1).cast("long").alias("page"), "place", "bib", "name", "age_band", "seconds", "hometown", "problem")


def _shared_names(spark, sf_dir):
    return results(spark, sf_dir).withColumn("name", F.concat(F.lit("Runner "), F.floor(F.col("runner_id") / 3).cast("string")))


@query()
def resolve_runners(spark, sf_dir):
    return people.resolve(_shared_names(spark, sf_dir))


@query()
def runner_town_switches(spark, sf_dir):
    rows = _shared_names(spark, sf_dir)
    return people.town_switches(people.resolve(rows), rows)


def _two_way_sql(group: str, rounds: int) -> str:
    parts = [f""" y AS MATERIALIZED (SELECT runner_id, {group} AS g, ln(seconds / (distance_m * 0.3::DOUBLE)) AS y, (year(race_date) - min(year(race_date)) OVER p)::DOUBLE AS x FROM results WHERE seconds IS NOT NULL WINDOW p AS (PARTITION BY runner_id) QUALIFY count(*) OVER p >= 2),
e0 AS MATERIALIZED (SELECT g, 0::DOUBLE AS effect, count(*) AS finishes FROM y GROUP BY g)"""]
    for k in range(rounds):
        parts.append(f"""f{k} AS MATERIALIZED (SELECT runner_id, CASE WHEN count(*) * sum(x * x) - sum(x) * sum(x) > 1e-9 THEN greatest(least((count(*) * sum(x * (y - effect)) - sum(x) * sum(y - effect)) / (count(*) * sum(x * x) - sum(x) * sum(x)), 0.05), -0.05) ELSE 0 END AS slope, sum(x) AS sx, sum(y - effect) AS sy, count(*) AS n FROM y JOIN e{k} USING (g) GROUP BY runner_id),
m{k} AS MATERIALIZED (SELECT g, avg(y - (sy - slope * sx) / n - slope * x) AS m, count(*) AS finishes FROM y JOIN f{k} USING (runner_id) GROUP BY g), e{k + 1} AS MATERIALIZED (SELECT g, m - sum(m * finishes) OVER () / sum(finishes) OVER () AS effect, finishes FROM m{k})""")
    return ",\n".join(parts) + f" SELECT g AS {group}, finishes, round(effect, 6) AS effect FROM e{rounds}"


@query(_two_way_sql("course_id", people.ROUNDS))
def two_way_course_effects(spark, sf_dir):
    """What each course costs its runners, their levels and yearly trends held apart."""
    rows = results(spark, sf_dir).withColumns({"y": F.log(F.col("seconds") / (F.col("distance_m") * F.lit(0.3))), "year": F.year("race_date")})
    return people.two_way(rows, "course_id").withColumn("effect", F.round("effect", 6))


@query()
def course_intervals(spark, sf_dir):
    """What each course costs, with its interval over 400 resamples of the runners, and its gap to the courses of the same length."""
    rows = results(spark, sf_dir).withColumns({"y": F.log(F.col("seconds") / (F.col("distance_m") * F.lit(0.3))), "year": F.year("race_date")})
    # Each course's odd and even months as two courses, so that there are peers of one length.
    rows = rows.withColumn("course", F.concat_ws(" ", "course_id", F.when(F.month("race_date") % 2 == 0, "even").otherwise("odd")))
    found = course_effects.course_intervals(course_effects.course_draws(rows, "course", rounds=12), rows, "course")
    return found.select("course", "finishes", "peers", *[F.round(c, 5).alias(c) for c in ("effect", "low", "high", "gap", "gap_low", "gap_high")])
