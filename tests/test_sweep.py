"""Rows with many entities: the sweep against replacing one after the other, and its cost."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import text as X
from cloakwork.operators import redact as R, sweep

SCHEMA = "k int, text string, entities array<struct<type:string,value:string>>"
BITS = ["John", "Ann", "é", "éAnn", "a.b", "(5)", "x-1", "EMAIL", "\U0001f600", "1985", "\\E", "$0", "-", "John Ann", "a", "x", ".", "-1", "²", "é́", "_", "[", "OTHER", "b."]


def rows(seed, n, entities):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text = "".join(rng.choice(BITS) + rng.choice(["", " ", " ", "."]) for _ in range(rng.randint(0, 60)))
        out.append((k, text, [(rng.choice(["email", "person_name", "Other", "other", "zzz", "", None]), rng.choice(BITS + ["", None])) for _ in range(rng.randint(*entities))]))
    return out


@pytest.mark.parametrize("tag", [R.default_tag, R.template_tag("**{TYPE}[{ID}]"), R.template_tag("{TYPE}-{ID}", "numeric"), R.template_tag("x"), R.template_tag("")])
def test_sweep_equals_built_in_functions(spark, monkeypatch, tag):
    """The same rows with all in the sweep and all in built-in functions."""
    df = spark.createDataFrame([*rows(3, 200, (0, 20)), (900, None, [("email", "a")]), (901, "a", None), (902, "", [])], SCHEMA)
    got = []
    for few in (0, 10_000):
        monkeypatch.setattr(R, "FEW", few)
        found = R.redact(df, tag=tag).withColumn("p", R.positions(F.col("text"), F.col("entities"))).withColumn("o", R.ordered(F.col("entities")))
        got.append(found.orderBy("k").collect())
    for a, b in zip(*got, strict=True):
        if a.entities or few:  # rows without entities never leave the built-in functions
            assert a == b


def test_sweep_equals_one_by_one():
    """Values that aren't tangled with tags, by both ways."""
    rng, n = random.Random(8), 0
    for _ in range(4000):
        values = list({rng.choice(BITS) for _ in range(rng.randint(1, 9))} - {"["})
        tags = [rng.choice(["[T]", "<tag>", "wort"]) for _ in values]
        text = "".join(rng.choice(BITS) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(0, 30)))
        pairs = list(zip(values, tags, strict=True))
        n += not sweep._tangled(pairs)
        assert sweep.replaced(text, pairs) == sweep._one_by_one(text, pairs), (text, pairs)
    assert n > 1000


def test_ten_thousand_entities_in_a_megabyte(spark):
    rng = random.Random(1)
    names = sorted({f"Name{rng.randrange(10**6)} {rng.choice('ABCDEF')}son" for _ in range(10_000)})
    text = " ".join(rng.choice(names) if rng.random() < 0.3 else "plain words" for _ in range(80_000))
    df = spark.createDataFrame([(1, text, [("person_name", n) for n in names])], SCHEMA)
    began = time.time()
    r = R.redact(df).withColumn("n", F.size(R.positions(F.col("text"), F.col("entities")))).first()
    assert time.time() - began < 30
    assert r.redacted == re.sub(r"Name\d+ .son", "[PERSON_NAME]", text)
    assert r.n == len(re.findall(r"Name\d+ .son", text)) and r.skipped_by_type == {}


def test_a_hundred_thousand_matches(spark):
    """Places in built-in functions: linear in matches."""
    df = spark.createDataFrame([(1, "ab c " * 100_000, [("other", "ab")])], SCHEMA)
    began = time.time()
    p = df.select(R.positions(F.col("text"), F.col("entities")).alias("p")).first().p
    assert len(p) == 100_000 and [tuple(x)[2:] for x in p[-2:]] == [(499_990, 499_992), (499_995, 499_997)]
    found = df.select(X.starts(F.col("text"), F.lit(r"\w+"), F.regexp_extract_all("text", F.lit(r"(\w+)"), 1)).alias("s")).first().s
    assert len(found) == 200_000 and tuple(found[-1]) == (499_998, 499_999)
    assert time.time() - began < 30
