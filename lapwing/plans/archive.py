"""Queries on the archive as a whole and on those who come for the first time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.operators import archive
from lapwing.plans.registry import query
from lapwing.sources import store
from lapwing.sources.results import results
from lapwing.sources.shared import new_path

_DEPTH = " d AS (SELECT r.*, (SELECT count(*) FROM past p WHERE p.target = r.entry_id) AS depth FROM results r WHERE r.seconds IS NOT NULL)"


@query(""" z AS (SELECT 1) SELECT year(race_date)::INT AS year, count(DISTINCT race_id) AS editions, count(DISTINCT course_id) AS courses, count(*) AS entries, count(seconds) AS finishes, count(DISTINCT runner_id) AS runners FROM results GROUP BY ALL""")
def archive_by_year(spark, sf_dir):
    return archive.by_year(results(spark, sf_dir))


@query(""" c AS (SELECT runner_id, count(seconds) AS depth FROM results GROUP BY runner_id), s AS (SELECT CASE WHEN depth = 0 THEN '0' WHEN depth = 1 THEN '1' WHEN depth <= 3 THEN '2-3' ELSE '4+' END AS stratum, count(*) AS runners FROM c GROUP BY ALL)
SELECT v.stratum, coalesce(runners, 0) AS runners FROM (VALUES ('0'), ('1'), ('2-3'), ('4+')) v(stratum) LEFT JOIN s USING (stratum)""")
def runner_depth_counts(spark, sf_dir):
    return archive.depth_counts(results(spark, sf_dir))


@query(""" l AS (SELECT race_id, concat_ws('|', entry_id, runner_id, round_even(seconds * 1000, 0)::BIGINT) AS line FROM results WHERE seconds IS NOT NULL)
SELECT race_id, count(*) AS finishes, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY race_id""")
def edition_digests(spark, sf_dir):
    return archive.edition_digests(results(spark, sf_dir))


@query(_DEPTH + """, back AS (SELECT race_id, count(*) AS back, quantile_cont(seconds, 0.5) AS median FROM d WHERE depth > 0 GROUP BY race_id HAVING count(*) >= 30), o AS (SELECT sex, ln(seconds / median) AS x FROM d JOIN back USING (race_id) WHERE depth = 0)
SELECT sex, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.1), 6) AS low, round(quantile_cont(x, 0.5), 6) AS middle, round(quantile_cont(x, 0.9), 6) AS high FROM o GROUP BY sex""")
def newcomer_pool(spark, sf_dir):
    return archive.newcomer_pool(results(spark, sf_dir))


@query(_DEPTH + " SELECT sex, age_band, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY sex), 6) AS share FROM d WHERE depth = 0 GROUP BY sex, age_band")
def newcomer_shares(spark, sf_dir):
    return archive.newcomer_shares(results(spark, sf_dir))


@query(""" e AS (SELECT race_id, year(race_date)::VARCHAR AS block, count(seconds) AS finishers, min(seconds) AS best, quantile_cont(seconds, 0.5) AS median FROM results GROUP BY ALL
), c AS (SELECT year(race_date)::VARCHAR AS block, max((entry_id % 4000 = 0)::INT) AS changed FROM results GROUP BY ALL)
SELECT race_id, block, finishers, round(best, 6) AS best, round(median, 6) AS median, 1 + changed AS generation FROM e JOIN c USING (block)""")
def stored_editions(spark, sf_dir):
    """Editions kept by year, after some entries came in: the years that have these were computed twice, the others once."""
    rows = results(spark, sf_dir).select("entry_id", "race_id", "race_date", "seconds")
    year = F.year("race_date")

    def editions(part):
        return part.groupBy("block", "race_id").agg(F.count("seconds").alias("finishers"), F.min("seconds").alias("best"), F.percentile("seconds", F.lit(0.5)).alias("median"))

    kept = store.BlockStore(spark, new_path(spark, "editions"))
    kept.refresh(rows.where("entry_id % 4000 > 0"), year, editions)
    found = kept.refresh(rows, year, editions)
    return found.join(kept.index().select("block", "generation"), "block").select("race_id", "block", "finishers", F.round("best", 6).alias("best"), F.round("median", 6).alias("median"), "generation")
