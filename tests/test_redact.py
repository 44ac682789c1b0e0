"""Redaction, tags, skips and positions, against a restatement in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import text as X
from cloakwork.model import SHORT_CODES, TYPE_ORDER
from cloakwork.operators import detect as D, redact as R

SCHEMA = "text string, entities array<struct<type:string,value:string>>"


def redacted(spark, text, entities, tag=R.default_tag):
    r = R.redact(spark.createDataFrame([(text, entities)], SCHEMA), tag=tag).first()
    return r.redacted, r.skipped_by_type


CASES = [
    ("nothing here", [], "nothing here", {}),
    ("", [("person_name", "John")], "", {"person_name": 1}),
    ("John met John.", [("person_name", "John")], "[PERSON_NAME] met [PERSON_NAME].", {}),
    ("John Smith called John", [("person_name", "John"), ("person_name", "John Smith")], "[PERSON_NAME] called [PERSON_NAME]", {}),
    ("John here", [("person_name", "John"), ("other", "John")], "[PERSON_NAME] here", {}),
    ("John here", [("date", "1999"), ("date", "2001")], "John here", {"date": 2}),
    ("John here", [("person_name", "John"), ("person_name", "Zed")], "[PERSON_NAME] here", {}),
    ("AETNA-681277021 by AETNA", [("other", "AETNA"), ("health_plan_beneficiary_number", "AETNA-681277021")], "[HEALTH_PLAN_BENEFICIARY_NUMBER] by [OTHER]", {}),
    ("call (555) now", [("phone_number", "(555)")], "call (555) now", {"phone_number": 1}),
    ("Johnson John", [("person_name", "John")], "Johnson [PERSON_NAME]", {}),
    ("a b", [("", "a"), ("other", ""), ("other", None)], "a b", {}),
    ("mail EMAIL me@x.org", [("email", "me@x.org"), ("other", "EMAIL")], "mail [OTHER] [[OTHER]]", {}),
    ("odd a.c abc $1 \\E x", [("other", "a.c"), ("other", "x")], "odd [OTHER] abc $1 \\E [OTHER]", {}),
    ("1985 is 555-268-1985", [("date", "1985"), ("phone_number", "555-268-1985")], "[DATE] is [PHONE_NUMBER]", {}),
]


@pytest.mark.parametrize(("text", "entities", "expected", "skipped"), CASES)
def test_cases(spark, text, entities, expected, skipped):
    assert redacted(spark, text, entities) == (expected, skipped)


def test_templates(spark):
    text, found = "John and Jane and John", [("person_name", "John"), ("person_name", "Jane")]
    assert redacted(spark, text, found, R.template_tag("**{TYPE}[{ID}]"))[0] == "**NAME[A] and **NAME[B] and **NAME[A]"
    assert redacted(spark, text, found, R.template_tag("{TYPE}-{ID}", "numeric"))[0] == "NAME-1 and NAME-2 and NAME-1"
    assert redacted(spark, text, found, R.template_tag("$x\\"))[0] == "$x\\ and $x\\ and $x\\"
    # an id is used up even where the value isn't in the text
    assert redacted(spark, "only Jo", [("person_name", "Zebedee"), ("person_name", "Jo")], R.template_tag("{ID}"))[0] == "only B"


def plain(text, entities):
    rank = {t: i for i, t in enumerate(TYPE_ORDER)}
    seen, state = set(), {}
    for t, v in sorted(((t, v) for t, v in entities if t and v), key=lambda e: (rank.get(e[0], 999), e[0], -len(e[1]))):
        if v in seen:
            continue
        seen.add(v)
        new, n = re.subn(rf"\b{re.escape(v)}\b", lambda _, t=t: f"[{t.upper()}]", text)
        state.setdefault(t, []).append(n > 0)
        text = new
    return text, {t: len(s) for t, s in state.items() if not any(s)}


def test_random_documents_equal_python(spark):
    rng = random.Random(1)
    bits = ["John", "Ann", "é", "éAnn", "a.b", "(5)", "x-1", "EMAIL", "\U0001f600", "1985", "\\E", "$0", "-"]
    rows = []
    for _ in range(150):
        text = " ".join(rng.choice(bits) + rng.choice(["", rng.choice(bits)]) for _ in range(rng.randint(0, 20)))
        rows.append((text, [(rng.choice([*TYPE_ORDER, "zzz", "aaa", ""]), rng.choice(bits)) for _ in range(rng.randint(0, 7))]))
    got = R.redact(spark.createDataFrame(rows, SCHEMA)).withColumn("p", R.positions(F.col("text"), F.col("entities"))).collect()
    for (text, entities), r in zip(rows, got, strict=True):
        assert (r.redacted, r.skipped_by_type) == plain(text, entities)
        assert [(p.type, p.value, p.start, p.end) for p in r.p] == [(t, v, m.start(), m.end()) for t, v in entities for m in re.finditer(rf"\b{re.escape(v)}\b", text)]


def test_occurrences(spark):
    df = spark.createDataFrame([("b a b", [("other", "b"), ("date", "a")])], SCHEMA)
    got = df.select(R.occurrences(R.positions(F.col("text"), F.col("entities"))).alias("o")).first().o
    assert [tuple(e) for e in got] == [("other", "b"), ("date", "a"), ("other", "b")]


def test_compact_codes(spark):
    df = spark.range(1).select(F.struct(*(F.array(F.lit(f"v{c}"), F.lit(f"v{c}")).alias(c) for c in SHORT_CODES)).alias("c"))
    got = [tuple(e) for e in df.select(D.expand(F.col("c")).alias("e")).first().e]
    assert got == [(t, f"v{c}") for c, t in SHORT_CODES.items() for _ in range(2)]


def test_model_detector(spark):
    def call(text):
        if "bad" in text:
            raise ValueError("broken")
        if "busy" in text:
            raise RuntimeError("Too many tokens")
        return {"nam": ["Ann"]}

    df = spark.createDataFrame([("fine",), ("bad",), ("busy",)], "text string")
    got = {r.text: r for r in D.model_detector(df, call, sleep=lambda s: None).collect()}
    assert got["fine"].compacted.nam == ["Ann"] and got["bad"].retries == 0 and got["busy"].retries == 3 and got["busy"].error
    assert D.backoff(1, jitter=0) == 1 and D.backoff(9, jitter=0) == 16


SCALARS = [
    (lambda c: X.stem(c), ["a/b.c.txt", "x", ".hidden", "d/"], ["b.c", "x", "", ""]),
    (lambda c: X.approved_id(c), ["b/n1_approved.txt", "b/_approved.txt", "n1.txt"], ["n1", None, None]),
    (lambda c: X.trivial(c), ["", " ", ", ,", ",a"], [False, True, True, False]),
    (lambda c: X.lenient_bool(c), [" Yes", "1", "no", None], [True, True, False, False]),
    (lambda c: X.counter_name(c), ["Person Name", None], ["pii_person_name", "pii_unknown"]),
    (lambda c: X.manifest_type(c, True), ["Email", "address", "biometric_identifier"], ["EMAIL", "ADDRESS", "BIOMETRIC_ID"]),
    (lambda c: X.strip_digits(c), ["Ann12", None], ["Ann", ""]),
    (lambda c: X.readable(c), ["2024-01-15T14:05:00-05:00", "soon"], ["2024-01-15, 02:05 PM", "soon"]),
    (lambda c: X.marital(c), ["M", "L", "x", None], ["Married", "Legally Separated", "", ""]),
    (lambda c: X.evaluation_time(c), ["eval_20260102_030405.json", "other.json"], ["2026-01-02 03:04:05", "other.json"]),
    (lambda c: X.bounded_limit(c), ["500", "0", "x", "7"], [200, 1, 50, 7]),
    (lambda c: X.alpha_id(c.cast("int")), ["1", "26", "27", "52", "702", "703"], ["A", "Z", "AA", "AZ", "ZZ", "AAA"]),
    (lambda c: X.rounded(c.cast("double")), ["2.5", "3.5", "0", None], ["2", "4", "", ""]),
    (lambda c: X.age(F.lit("2000-02-29").cast("date"), c.cast("date")), ["2024-02-28", "2024-02-29", None], [23, 24, 0]),
    (lambda c: D.validity(c), ["", " \n", "x" * 20_001, "ok", None], ["empty", "empty", "too_long", "ok", "empty"]),
]


@pytest.mark.parametrize("k", range(len(SCALARS)))
def test_scalars(spark, k):
    f, given, expected = SCALARS[k]
    df = spark.createDataFrame(list(enumerate(given)), "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(f(F.col("v"))).collect()] == expected
