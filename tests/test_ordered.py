"""Neighbours, numbers and percentiles of groups that lie over several tasks, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.operators import ordered, telemetry


@pytest.fixture
def split(spark):
    """Tasks stay as they are dealt, so a large group does lie in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, seed, n=3000):
    """One group has most rows; others few; a null group; nulls and equal values."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 12 + ["a", "b", "c", None]), rng.choice([None, *range(40)]) if rng.random() < 0.5 else rng.randrange(5000), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v long, i long")


def test_the_hot_group_is_split(split):
    _, df = table(split, 1)
    rows = ordered.range_sorted(df, ["g"], ["v"])
    held = {r.p for r in rows.filter("g = 'hot'").select(F.col("__part").alias("p")).distinct().collect()}
    assert len(held) >= 3  # the small groups before it share a task
    assert ordered.spread(rows.groupBy("__part", "__key").agg(F.count("*").alias("n"))).count() <= 2 * 4


def test_neighbours(split):
    rows, df = table(split, 2)
    got = ordered.neighbours(df.select("g", "v"), "g", "v").collect()
    want = []
    for g in {r[0] for r in rows}:
        vs = sorted((r[1] for r in rows if r[0] == g), key=lambda v: (v is not None, v or 0))
        want += [(g, v, a, b) for v, a, b in zip(vs, [None, *vs[:-1]], [*vs[1:], None])]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:]) + (str(r[0]),)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_numbers(split):
    rows, df = table(split, 3)
    got = ordered.numbered(df, ["g"], ["v", "i"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert {r.i: r.n for r in got if r.g == g} == {r[2]: k for k, r in enumerate(mine, 1)}
    assert [c for c in ordered.numbered(df.limit(0), ["g"], ["v"]).collect()] == []


def test_percentiles(split):
    rows, df = table(split, 4)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    counts = df.groupBy("g", "v").agg(F.count("*").alias("c"))
    got = ordered.percentiles(counts, ["g"], "v", "c", shares, F.sum("c").alias("n")).collect()
    for r in got:
        vs = [x[1] for x in rows if x[0] == r.g and x[1] is not None]
        assert r.n == sum(1 for x in rows if x[0] == r.g)
        assert [r[p] for p in shares] == pytest.approx(np.percentile(vs, [100 * q for q in shares.values()]).tolist())
    assert len(got) == 5


def test_periods_equal_the_built_in_percentile(split):
    rng = random.Random(5)
    rows = [(f"2024-01-01 00:{rng.randrange(12):02d}:00", rng.choice(["x", "x", "x", None]), rng.choice([None, rng.random() * 100, 7.0])) for _ in range(2000)]
    df = split.createDataFrame(rows, "at string, kind string, v double").withColumn("at", F.col("at").cast("timestamp"))
    got = telemetry.periods(df, "at", "v", ["kind"]).collect()
    q = lambda p: F.percentile("v", F.lit(p))
    want = df.groupBy(F.window("at", "5 minutes")["start"].alias("period"), "kind").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("average"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("v").alias("most")).collect()
    key = lambda r: (r.period, r.kind or "")
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (a.period, a.kind, a.n, a.most) == (b.period, b.kind, b.n, b.most)
        assert [a.total, a.average, a.p50, a.p95] == pytest.approx([b.total, b.average, b.p50, b.p95])
