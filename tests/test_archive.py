"""First-time finishers against their edition's returning ones, and digests that order does not change."""

import datetime
import math

from lapwing.operators import archive

SCHEMA = "entry_id long, runner_id long, race_id string, race_date date, day int, seconds double, sex string, age_band string"


def rows():
    day = datetime.date(2000, 1, 1)
    first = [(k, k, "a", day, 0, 100.0 + k, "F", "20-29") for k in range(3)]
    later = [(10 + k, k, "b", day, 30, 100.0 + k, "F", "20-29") for k in range(3)]
    return first + later + [(20, 20, "b", day, 30, 202.0, "M", "30-39"), (21, 21, "b", day, 30, None, "M", "30-39")]


def test_newcomers_are_compared_with_those_who_came_back(spark):
    got = archive.newcomer_offsets(spark.createDataFrame(rows(), SCHEMA), least=3).collect()
    assert [(r.entry_id, round(r.offset, 9)) for r in got] == [(20, round(math.log(2), 9))]
    assert archive.newcomer_offsets(spark.createDataFrame(rows(), SCHEMA), least=4).count() == 0


def test_strata_are_all_present(spark):
    got = {r.stratum: r.runners for r in archive.depth_counts(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == {"0": 1, "1": 1, "2-3": 3, "4+": 0}


def test_digests_do_not_depend_on_order(spark):
    one = archive.edition_digests(spark.createDataFrame(rows(), SCHEMA)).collect()
    other = archive.edition_digests(spark.createDataFrame(rows()[::-1], SCHEMA)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and len({r.digest for r in one}) == 2
