"""Keyed results: nothing is computed twice, and a change is computed where it is."""

from pyspark.sql import functions as F

from lapwing.sources.shared import new_path
from lapwing.sources.store import BlockStore, fingerprints

SCHEMA = "race string, year int, s double"
ROWS = [("a", 2001, 1.0), ("a", 2001, 3.0), ("b", 2002, 5.0), ("c", 2002, None), ("d", 2003, 7.0), ("e", None, 9.0)]


def counting(asked):
    def compute(rows):
        asked.append(sorted({r.block for r in rows.select("block").distinct().collect()}))
        return rows.groupBy("block", "race").agg(F.sum("s").alias("s"))

    return compute


def test_only_changed_blocks_are_computed(spark):
    store, asked = BlockStore(spark, new_path(spark, "store")), []
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    refresh = lambda rows, **more: {(r.block, r.race, r.s) for r in store.refresh(table(rows), F.col("year"), counting(asked), **more).collect()}
    first = refresh(ROWS)
    assert first == {("2001", "a", 4.0), ("2002", "b", 5.0), ("2002", "c", None), ("2003", "d", 7.0), ("null", "e", 9.0)}
    assert refresh(ROWS[::-1]) == first and len(asked) == 1
    changed = [*ROWS[:2], ("b", 2002, 6.0), *ROWS[3:]]
    assert refresh(changed) == (first - {("2002", "b", 5.0)}) | {("2002", "b", 6.0)}
    assert asked[1:] == [["2002"]]
    assert refresh(changed[:4]) == {x for x in first if x[0] == "2001"} | {("2002", "b", 6.0), ("2002", "c", None)} and len(asked) == 2
    refresh(changed, still_open=F.col("block") == "2003")
    assert asked[2:] == [["2003"]]
    assert {r.block: r.generation for r in store.index().collect()} == {"2001": 1, "2002": 2, "2003": 2, "null": 1}


def test_blocks_that_rest_on_earlier_ones(spark):
    store, asked = BlockStore(spark, new_path(spark, "store")), []

    def before(rows):
        asked.append(sorted({r.block for r in rows.select("block").distinct().collect()}))
        return rows.groupBy("block").agg(F.sum(F.when(F.col("block_of") < F.col("block"), F.col("s"))).alias("s"))

    own = [("a", 2001, 1.0), ("b", 2002, 5.0), ("c", 2003, 2.0)]
    run = lambda rows: {(r.block, r.s) for r in store.refresh(spark.createDataFrame(rows, SCHEMA), F.col("year"), before, upto=True).collect()}
    assert run(own) == {("2001", None), ("2002", 1.0), ("2003", 6.0)}
    assert run([own[0], ("b", 2002, 7.0), own[2]]) == {("2001", None), ("2002", 1.0), ("2003", 8.0)}
    assert asked == [["2001", "2002", "2003"], ["2002", "2003"]]


def test_what_a_lost_job_left_is_not_read(spark):
    store, asked = BlockStore(spark, new_path(spark, "store")), []
    table = spark.createDataFrame(ROWS, SCHEMA)
    first = {tuple(r) for r in store.refresh(table, F.col("year"), counting(asked)).collect()}
    store._replace(spark.createDataFrame([("x", 1.0, "other", "2001")], "race string, s double, fingerprint string, block string"), "rows")
    store._replace(spark.createDataFrame([("other", 9, "2001")], "fingerprint string, generation int, block string"), "index")
    assert {tuple(r) for r in store.refresh(table, F.col("year"), counting(asked)).collect()} == first and asked[1:] == [["2001"]]


def test_fingerprints_see_rows_not_their_order(spark):
    told = lambda rows: {r.block: r.fingerprint for r in fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("year")).collect()}
    one = told(ROWS)
    assert told(ROWS[::-1]) == one and len(set(one.values())) == 4
    assert told([*ROWS, ROWS[0]])["2001"] != one["2001"]
    assert told([("a", 2001, 1.5), ("a", 2001, 2.5), *ROWS[2:]])["2001"] != one["2001"]
    assert told([]) == {}
