"""As-of and interval joins and whole-table ranks against plain models: hot keys, ties, nulls and empty tables."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from proofbase.operators import temporal

START = datetime(2024, 1, 1)
DDL = "id long, k string, ts timestamp"


def sides(seed=1):
    rng = random.Random(seed)
    # a third of all rows have one key; times repeat, lie on edges of stretches and far apart
    make = lambda n, at: [(at + i, rng.choice(["hot", "a", "b", "c"]) if rng.random() < 0.7 else "hot", START + timedelta(minutes=rng.choice([0, 60, 1440, 2880, rng.randrange(20_000)]))) for i in range(n)]
    left = make(300, 0) + [(5000, None, START), (5001, "a", None), (5002, "only left", START), (5003, "hot", START - timedelta(days=400)), (5004, "hot", START + timedelta(days=400)), (0, "a", START), (0, "a", START)]
    right = make(200, 10_000) + [(20_000, None, START), (20_001, "a", None), (20_002, "only right", START)]
    return left, right


@pytest.mark.parametrize("seconds", [3600, 86_400, 10**9])
def test_as_of_equals_the_model(spark, seconds):
    left, right = sides()
    got = temporal.as_of(spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL), "k", "ts", "ts", "id", seconds).collect()
    model = lambda k, t: max(((u, i) for i, q, u in right if q == k and k and t and u and u <= t), default=(None, None))[1]
    key = lambda r: str(r)
    assert sorted(((r["id"], r["k"], r["ts"], r["_right"] and r["_right"]["id"]) for r in got), key=key) == sorted(((i, k, t, model(k, t)) for i, k, t in left), key=key)


def test_as_of_of_nothing(spark):
    left, right = (spark.createDataFrame(x, DDL) for x in sides())
    assert temporal.as_of(left.limit(0), right, "k", "ts", "ts", "id").collect() == []
    assert {r["_right"] for r in temporal.as_of(left, right.limit(0), "k", "ts", "ts", "id").collect()} == {None}


@pytest.mark.parametrize("seconds", [60, 3600, 86_400])
def test_interval_join_equals_the_model(spark, seconds):
    left, right = sides(2)
    df = temporal.within(spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL), "k", "ts", "ts", seconds)
    want = Counter((i, j) for i, k, t in left for j, q, u in right if k and k == q and t and u and timedelta() <= u - t <= timedelta(seconds=seconds))
    assert Counter((r["_left"]["id"], r["_right"]["id"]) for r in df.collect()) == want and want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_ranks_equal_the_model(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 1, 2, 2, 3, rng.randrange(100)])) for i in range(n)]
    got = temporal.ranks(spark.createDataFrame(rows, "id long, v int"), [F.col("v")], [F.col("id")], 4).collect()
    place = lambda r: (r[1] is not None, r[1] or 0)
    ordered = sorted(rows, key=lambda r: (*place(r), r[0]))
    seen = Counter(place(r) for r in rows)
    levels = sorted(seen)
    base, more = divmod(n, 4)
    tiles = [t for t in range(4) for _ in range(base + (t < more))]
    want = {}
    for k, r in enumerate(ordered):
        before = sum(seen[x] for x in levels if x < place(r))
        want[r[0]] = (k + 1, before + 1, levels.index(place(r)) + 1, before / (n - 1) if n > 1 else 0.0, (before + seen[place(r)]) / n, tiles[k] + 1)
    assert {r["id"]: tuple(r[x] for x in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")) for r in got} == want


def test_no_rows_of_the_table_meet_in_one_task(spark):
    df = temporal.ranks(spark.range(1000).withColumn("v", F.col("id") % 7), [F.col("v")], [F.col("id")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the only single partition is that of the counts a range
    single = [i for i, x in enumerate(plan.split("\n")) if "SinglePartition" in x]
    below = "\n".join(plan.split("\n")[min(single) :]) if single else ""
    assert not single or "count" in below
