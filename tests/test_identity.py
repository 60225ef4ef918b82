"""Linking against brute force, with a common key, and the whole table in one of two roles."""

from lapwing.operators import identity
from lapwing.plans.queries import QUERIES

PEOPLE = "id long, key string, sex string, hometown string"


def test_link_counts_groups(spark):
    sex, town = [None, "F", "M"], [None, *"abcde"]
    entrants = [(k, ["common", "rare", f"k{k % 60}", None][k % 4], sex[k % 3], town[k % 5]) for k in range(300)] + [(900, "solo", "F", "b")]
    runners = [(1000 + k, "common" if k % 2 else f"k{k % 97}", sex[k // 7 % 3], town[k // 3 % 6]) for k in range(600)] + [(5000, "rare", "F", "a"), (6000, "solo", "F", "z")]
    picks, n = {}, {}
    for i, key, s, t in entrants:
        fit = [r for r in runners if key is not None and r[1] == key and (s is None or r[2] is None or r[2] == s)]
        near = [r for r in fit if t is not None and r[3] == t]
        n[i] = len(fit)
        picks[i] = fit[0][0] if len(fit) == 1 else near[0][0] if len(near) == 1 else None
    claims = [p for p in picks.values() if p is not None]
    want = {i: ("new", None) if not n[i] else ("linked", p) if p is not None and claims.count(p) == 1 else ("ambiguous", None) for i, p in picks.items()}
    assert {s for s, _ in want.values()} == {"new", "linked", "ambiguous"}
    linked = identity.link(spark.createDataFrame(entrants, PEOPLE), spark.createDataFrame(runners, PEOPLE))
    assert {r.entrant_id: (r.status, r.runner_id) for r in linked.collect()} == want
    below = linked._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert below.split("\n")[1].strip(" :+-").startswith("Aggregate") and below.count("Aggregate") >= 2


def test_link_whole_table_drops_nobody(spark):
    got = QUERIES["link_whole_table"](spark, "/root/testdata/sf0.001").collect()
    customers = [r.c_custkey for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect()]
    assert sorted(r.entrant_id for r in got) == sorted(k for k in customers if k % 7 == 0)
    assert any(r.runner_id is not None and r.runner_id % 3 for r in got)
