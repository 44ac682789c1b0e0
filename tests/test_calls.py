"""Calls in flight: overlap, order, the bound, rate, the shared budget of retries, unsound answers."""

import threading
import time

import pytest

from cloakwork.operators import detect as D, writing as N
from cloakwork.operators.calls import Caller


class Slow:
    """Answers later the earlier it was asked, and counts how many are asked at once."""

    def __init__(self):
        self.now = self.most = self.asked = 0
        self.lock = threading.Lock()

    def __call__(self, k):
        with self.lock:
            self.now, self.asked = self.now + 1, self.asked + 1
            self.most = max(self.most, self.now)
        time.sleep(0.05 if k % 4 == 0 else 0.01)
        with self.lock:
            self.now -= 1
        return k * 10


def test_overlap_order_and_bound():
    slow, taken = Slow(), []
    items = ((taken.append(k) or k,) for k in range(40))
    began = time.monotonic()
    got = []
    for a in Caller(slow, window=5).all(items):
        got.append(a.value)
        assert len(taken) - len(got) <= 5  # no more is read from the input than can be in flight
    assert got == [k * 10 for k in range(40)] and 2 <= slow.most <= 5
    assert time.monotonic() - began < 0.8 * sum(0.05 if k % 4 == 0 else 0.01 for k in range(40))


def test_budget_is_shared_and_errors_stay_with_their_row():
    asked = []

    def down(k):
        asked.append(k)
        raise RuntimeError("Throttling" if k != 3 else "bad request")

    got = list(Caller(down, window=2, attempts=4, budget=5, sleep=lambda s: None).all((k,) for k in range(6)))
    assert len(asked) == 6 + 5 and [a.error for a in got][3] == "bad request" and got[3].retries == 0
    assert sum(a.retries for a in got) == 5 and all(a.value is None for a in got)


def test_rate():
    """100 a minute: with a clock that is waited on, starts are 0.6 s apart."""
    waited = []
    list(Caller(lambda k: k, window=1, per_minute=100, sleep=waited.append).all((k,) for k in range(4)))
    assert [round(w, 1) for w in waited] == [0.6, 1.2, 1.8]


@pytest.mark.parametrize(("answer", "error"), [({"eml": ["a"]}, None), (["a"], "no object"), ({"nope": []}, "unknown code"), ({"eml": "a"}, "isn't a list"), ({"eml": [1]}, "isn't a list")])
def test_answers_are_validated(spark, answer, error):
    r = D.model_detector(spark.createDataFrame([("t",)], "text string"), lambda t: answer).first()
    assert (r.error is None) == (error is None) and (error is None or error in r.error)
    assert (r.compacted is None) == (error is not None) and (error or r.compacted.eml == ["a"])


def test_written_notes(spark):
    def write(role, prompt):
        if prompt == "p7":
            raise RuntimeError("refused")
        return "" if prompt == "p8" else f"{role}: {prompt}"

    tasks = spark.createDataFrame([(i, "r", f"p{i}") for i in range(30)], "i int, role string, prompt string")
    got = {r.i: r for r in N.written(tasks, write, per_minute=60_000, partitions=2, window=4).collect()}
    assert len(got) == 30 and got[7].error == "refused" and got[8].error == "unsound answer: no text"
    assert all(got[i].note == f"r: p{i}" for i in range(30) if i not in (7, 8))


def test_prompts_and_roles(spark):
    assert N.AS_TEMPLATE in N.prompt("progress_note", True) and N.AS_TEMPLATE not in N.prompt("progress_note")
    with pytest.raises(ValueError):
        N.prompt("poem")
    from pyspark.sql import functions as F

    got = [r.r for r in spark.createDataFrame([("radiology_report",), ("x",), (None,)], "k string").select(N.role(F.col("k")).alias("r")).collect()]
    assert got == [N.ROLES["radiology_report"], N.OTHER_ROLE, N.OTHER_ROLE]
    assert "<document>t</document>" in spark.range(1).select(D.prompt("find", F.lit("t")).alias("p")).first().p
