"""Toxicity: the automaton against plain edit distance, misspellings, quotation, held-out quality, edges."""

import random

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import toxicity


def distance(a, b):
    """Edit distance with swaps of neighbours, each place edited once."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_edit_distance():
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abcé") for _ in range(rng.randrange(a, b)))
    terms = sorted({word(3, 13) for _ in range(40)})
    automaton = toxicity.Automaton(terms)
    words = [word(1, 15) for _ in range(3000)]
    for t in terms:  # words near terms
        for _ in range(40):
            w = list(t)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "a", "x", "b"])
                if len(w) > 2 and rng.random() < 0.3:
                    w[0], w[1] = w[1], w[0]
            words.append("".join(w) or "a")
    codes, starts, lengths, _ = toxicity._tokens(" ".join(words))
    assert len(starts) == len(words)
    found, edits = automaton.match(codes, starts, lengths)
    near = 0
    for w, t, e in zip(words, found, edits):
        best = min((d for x in terms if (d := distance(w, x)) <= toxicity.budget(x)), default=None)
        assert (t < 0) == (best is None), w
        if best is not None:
            near += best > 0
            assert (distance(w, terms[t]), e) == (best, best), (w, terms[t])
    assert near > 300


def table(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "tu", "so", "ri"]) for _ in range(rng.randrange(2, 4)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "dimbulb"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(*table(spark))


def test_learned_terms_and_misspellings(model):
    assert set(model.terms) == {"blockhead", "nitwit", "dimbulb"}
    score = lambda t: model.score(next(model.features([t]))[0])
    plain = "kalo mine tuso you are a {} rika lomi neka"
    assert score(plain.format("sori")) < 0.1
    for term in ("blockhead", "BLOCKHEAD!!", "blokchead", "bl0ckhead", "bl*ckhead", "nitwiit", "dimbul"):
        assert score(plain.format(term)) > score(plain.format("sori")) + 0.3, term
    assert score(plain.format("blockhead")) >= toxicity.THRESHOLD
    assert score(plain.format('"blockhead"')) < score(plain.format("blockhead")) - 0.3
    assert score("kalo the word nitwit mine") < score("kalo mine nitwit tuso")
    assert [m[:2] for m in next(model.features(["\U0001f600 a nitwit"]))[1]] == [(4, 10)]


def test_whole_texts(model):
    """A term behind more than two slices is found where it stands."""
    text = "kalo mine " * (toxicity.SLICE // 4) + "nitwit " * 5
    found = next(model.matches([text]))[0]
    assert [m[0] for m in found] == [i for i in range(len(text) - 35, len(text), 7)]


def test_texts_looked_at_together_stay_apart(model):
    """A text's matches and context are the same alone and among others."""
    texts = ["nitwit", 'he said', None, '"', "nitwit", '"', "", "the word", "dimbulb mine", "kalo " * 70_000 + "nitwit", "blockhead you"] * 3
    assert list(model.matches(texts)) == [next(model.matches([t])) for t in texts]


def test_held_out_quality(spark):
    docs, labels = table(spark)
    got = toxicity.annotate(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 150
    assert all(r.predicted == r.toxic for r in got)


def test_no_label_of_held_out_rows_is_read(spark):
    docs, labels = table(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.terms == b.terms and (a.beta == b.beta).all()


def test_edges(spark, model):
    """Nulls, empty texts, repeated rows, clashing names, no rows, no labels."""
    df = spark.createDataFrame([(1, None, 5, "x"), (None, "nitwit nitwit", 6, "y"), (2, "", 7, None), (2, "", 7, None), (3, " \n\t", 1, "z")], "doc_id long, text string, score int, held string")
    got = toxicity.annotate(df, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.predicted, r.matches != "[]") for r in got) == [(False, 1, 0, False), (False, 2, 0, False), (False, 2, 0, False), (False, 3, 0, False), (True, 0, 1, True)]
    assert len({r.score for r in got if r.doc_id}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.annotate(df.limit(0), model).collect() == []
    none = toxicity.fit(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.annotate(df, none).collect()} == {0}
    one = toxicity.fit(df.select("doc_id", "text"), spark.createDataFrame([(2, 1), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.annotate(df, one).collect()} == {0}
