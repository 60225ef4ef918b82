"""Queries on samples of decisions and what they say of all."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapwing.functions import printed
from lapwing.operators import resolve as people
from lapwing.operators import review
from lapwing.plans.registry import query
from lapwing.sources.results import results, table

_CUTS = "[" + ", ".join(f"{c!r}::DOUBLE" for c in review._CUTS) + "]"


@query()
def review_pairs(spark, sf_dir):
    """Pairs of results to look at, of every kind of decision that the resolver made, with how many it made of each."""
    rows = results(spark, sf_dir).withColumn("name", F.concat(F.lit("Runner "), F.floor(F.col("runner_id") / 3).cast("string")))
    made = review.decisions(people.resolve(rows), rows.withColumn("town", printed.town_key(F.col("hometown"))))
    return review.draw(made).select("stratum", "pair", "joined", "one", "other", "turn", "population")


@query(f""" p AS (SELECT source AS stratum, doc_id::VARCHAR AS pair, quality = 0 AS joined, CASE WHEN doc_id % 17 = 0 THEN 'unsure' WHEN doc_id % 19 > 0 THEN CASE WHEN toxic = 1 THEN 'same' ELSE 'different' END END AS label FROM labels JOIN documents USING (doc_id)
), d AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS population FROM p QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('{review.SEED}:' || coalesce(stratum, '') || ':' || pair), pair) <= 20
), t AS (SELECT stratum, population, draw, joined::INT AS j, (label = 'same')::INT AS s, CASE WHEN draw = 0 THEN 1 ELSE len(list_filter({_CUTS}, lambda c: c <= ('0x' || substr(md5('{review.SEED}:' || pair || ':' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) END AS times
  FROM d, range({review.DRAWS + 1}) r(draw) WHERE label IN ('same', 'different')
), g AS (SELECT stratum, draw, any_value(population) AS population, sum(times * j * s) AS both_, sum(times * j) AS j, sum(times * s) AS s FROM t GROUP BY stratum, draw
), m AS (SELECT 'precision' AS measure, draw, population, both_, j AS of_ FROM g UNION ALL SELECT 'recall', draw, population, both_, s FROM g
), v AS (SELECT measure, draw, sum(population * both_ / of_) / sum(population) AS value FROM m WHERE of_ > 0 GROUP BY measure, draw)
SELECT measure, round(max(value) FILTER (WHERE draw = 0), 6) AS point, round(quantile_cont(value, {review.LOW}) FILTER (WHERE draw > 0), 6) AS low, round(quantile_cont(value, {review.HIGH}) FILTER (WHERE draw > 0), 6) AS high,
  (SELECT count(*) FILTER (WHERE label IN ('same', 'different')) FROM d) AS labelled, (SELECT count(*) FILTER (WHERE label = 'unsure') FROM d) AS unsure, (SELECT count(*) FILTER (WHERE label IS NULL) FROM d) AS unlabelled
FROM v GROUP BY measure HAVING max(value) FILTER (WHERE draw = 0) IS NOT NULL""", with_results=False)
def review_score(spark, sf_dir):
    """How good decisions are, judged from twenty of each source and weighted to all."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    label = F.when(F.col("doc_id") % 17 == 0, "unsure").when(F.col("doc_id") % 19 > 0, F.when(F.col("toxic") == 1, "same").otherwise("different"))
    rows = rows.select(F.col("source").alias("stratum"), F.col("doc_id").cast("string").alias("pair"), (F.col("quality") == 0).alias("joined"), label.alias("label"))
    found = review.score(review.draw(rows, 20))
    return found.select("measure", *[F.round(c, 6).alias(c) for c in ("point", "low", "high")], "labelled", "unsure", "unlabelled")
