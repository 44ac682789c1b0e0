"""Runs of characters by class against one look at every character."""

import random

from cloakwork.operators import evaluate as E

SCHEMA = "doc_id long, place int, type string, start int, `end` int"


def plain(t, p):
    out = []
    for doc in {x[0] for x in t + p}:
        def top(side, pos):
            return min(((x[1], x[2]) for x in side if x[0] == doc and x[3] <= pos < x[4]), default=(None, None))[1]

        runs = []
        for pos in range(60):
            e, q = top(t, pos), top(p, pos)
            kind = None if e is q is None else "fp" if e is None else "fn" if q is None else "tp"
            if kind and runs and runs[-1][2] == pos and runs[-1][3] == kind:
                runs[-1][2] = pos + 1
            elif kind:
                runs.append([doc, pos, pos + 1, kind, q, e])
        out += map(tuple, runs)
    return sorted(out, key=str)


def test_random_spans(spark):
    rng = random.Random(3)

    def side(n):
        rows = []
        for place in range(n):
            start = rng.randrange(50)
            rows.append((rng.randrange(60), place, rng.choice("abc"), start, start + rng.randrange(0, 10)))
        return rows

    t, p = side(700), side(700)
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in E.annotations(df(t), df(p)).collect()), key=str)
    assert got == plain(t, p)
    assert E.annotations(df(t).limit(0), df(p).limit(0)).collect() == []


def test_many_spans_over_one_place(spark):
    """20,000 spans in one document, all open at once at its middle."""
    rows = [(1, k, "a", k, 40_000 - k) for k in range(20_000)]
    got = E.annotations(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 40_000, "tp", "a", "a")]
