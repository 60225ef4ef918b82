"""Published lines against results: who was listed, who finished, and whether a file counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTICE_SECONDS = 24 * 3600
#: Days before a race on which daily files begin.
FIRST_LEAD = 7


def outcomes(lines: DataFrame, results: DataFrame) -> DataFrame:
    """``line, key, outcome, entry_id`` of every published line (line, key, town) by results (entry_id, key, town, seconds).

    A key published twice is ambiguous; a key of several results goes by the town
    if one alone has it. Results are counted by key and by key and town before
    lines meet them, so a common key costs one row.
    """
    result = F.struct("entry_id", "seconds")
    by_key = results.groupBy("key").agg(F.count("*").alias("n"), F.min(result).alias("one"))
    by_town = results.where("town is not null").groupBy("key", "town").agg(F.count("*").alias("m"), F.min(result).alias("here"))
    times = lines.groupBy("key").agg(F.count("*").alias("times"))
    rows = lines.join(times, "key").join(by_key, "key", "left").join(by_town, ["key", "town"], "left")
    chosen = F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("here"))
    outcome = F.when(F.col("times") > 1, "ambiguous").when(F.col("n").isNull(), "not found in the results").when(chosen.isNull(), "ambiguous").when(chosen["seconds"].isNull(), "did not finish").otherwise("finished")
    return rows.select("line", "key", outcome.alias("outcome"), F.when(outcome.isin("finished", "did not finish"), chosen["entry_id"]).alias("entry_id"))


def attendance(listed: DataFrame, results: DataFrame) -> DataFrame:
    """``race_id, listed, finished, found, not_listed, switched`` from lists (race_id, day, key) and finishes (race_id, day, key): keys on both, on the second alone, and of these on another list of the day."""
    mine = listed.select("race_id", "day", "key").distinct().withColumn("l", F.lit(1))
    there = results.where("seconds is not null").select("race_id", "day", "key").distinct().withColumn("f", F.lit(1))
    both = mine.join(there, ["race_id", "day", "key"], "full")
    same_day = listed.select("day", "key").distinct().withColumn("d", F.lit(1))
    both = both.join(same_day, ["day", "key"], "left")
    count = lambda c: F.count(F.when(c, 1))
    l, f, d = (F.col(c).isNotNull() for c in ("l", "f", "d"))
    return both.groupBy("race_id").agg(count(l).alias("listed"), count(f).alias("finished"), count(l & f).alias("found"), count(f & ~l).alias("not_listed"), count(f & ~l & d).alias("switched"))


def in_events(events: Column, wanted: list[str]) -> Column:
    """Whether any part of a comma-separated entry is one of the events, whatever its case; all are if none is wanted."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.exists(F.split(events, ","), lambda x: F.lower(F.trim(x)).isin(*[w.lower() for w in wanted])), F.lit(False))


def snapshot(rows: DataFrame, key: str, stamp: str, before: Column | None = None) -> DataFrame:
    """The last row of each key by its stamp, at most at ``before``."""
    rows = rows if before is None else rows.where(F.col(stamp) <= before)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), stamp).alias("last")).select(key, "last.*")


def too_late(at: Column, gun: Column) -> Column:
    """Why what was done at a time doesn't count: it is within a day of the gun, or a time lacks."""
    left = F.unix_timestamp(gun) - F.unix_timestamp(at)
    return F.when(left.isNull(), "no time").when(left < NOTICE_SECONDS, F.concat(left.cast("string"), F.lit(" s before the gun")))


def due(races: DataFrame, today: Column) -> DataFrame:
    """``race_id, kind`` of the files that races (race_id, date, listed) want today: daily ones in the week before, the final one the day before."""
    lead = F.datediff("date", today)
    kind = F.when(lead == 1, "final").when(lead.between(2, FIRST_LEAD) & F.col("listed"), "daily")
    return races.select("race_id", kind.alias("kind")).where("kind is not null")


def stage(scored: Column, today: Column, date: Column, finals: Column, files: Column) -> Column:
    return F.when(scored, "scored").when(today > date, "run").when(finals > 0, "final").when(files > 0, "week").otherwise("before")


def shelf(date: Column, today: Column, scored: Column, entrants: Column, registration: Column) -> Column:
    open_ = F.coalesce(entrants > 0, F.lit(False)) | F.coalesce(registration <= today, F.lit(False))
    return F.when((date < today) | scored, "run").when(open_, "open").otherwise("announced")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed digest of a text, from two plain ones; the key has 64 bytes at most."""
    if len(key) > 64:
        raise ValueError("a key has 64 bytes at most")
    pad = lambda x: F.lit(bytes(b ^ x for b in key.ljust(64, b"\0")))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))), 256)


def band_still_possible(low: Column, high: Column, printed_year: Column, year: Column) -> Column:
    """Whether who was printed in a band of ages one year can be in it in another."""
    born_from, born_to = printed_year - high - 1, printed_year - low
    return F.coalesce((year - born_to <= high) & (low <= year - born_from), F.lit(False))


def paired_places(rows: DataFrame, one: str, other: str, least: int = 3) -> DataFrame:
    """Mean gaps of places and rank correlations of two models in races that both answer, and their differences, a race counting once."""
    from lapwing.operators.scoring import place_errors

    both = rows.where(F.col(one).isNotNull() & F.col(other).isNotNull())
    a, b = (place_errors(both, m, least).select("race_id", "runners", F.col("place_gap").alias(f"gap{k}"), F.col("spearman").alias(f"rho{k}")) for k, m in enumerate((one, other)))
    rows = a.join(b.drop("runners"), "race_id")
    return rows.agg(F.count("*").alias("races"), F.sum("runners").alias("runners"), *[F.round(F.avg(c), 5).alias(c) for c in ("gap0", "gap1", "rho0", "rho1")], F.round(F.avg(F.col("gap0") - F.col("gap1")), 5).alias("gap_difference"))


def skill(summary: DataFrame, model: str, baseline: str, by: str) -> DataFrame:
    """The share of the baseline's error that a model takes away, from ``by`` and both errors."""
    return summary.select(by, F.round(1 - F.try_divide(F.col(model), F.nullif(F.col(baseline), F.lit(0.0))), 6).alias("skill"))
