"""The pipeline's stages, each against its own input."""

import collections
import re

import corpus_pipeline
from cloakwork.llm import langid
from cloakwork.llm.common import attach

from .test_operators import clusters, sets_of


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k == 4:
            got = out.toPandas()
            assert set(got.doc_id) == set(before.doc_id) and got.groupby("sequence_id").length.sum().max() <= 1024
            break
        assert out.columns == columns and out.schema == docs.schema, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.toPandas()
        texts = dict(zip(before.doc_id, before.text, strict=True))
        kept = set(after.doc_id)
        if k == 0:
            assert {i for i, t in texts.items() if not any(c.isalpha() for c in t)}.isdisjoint(kept) and len(kept) > 0.98 * len(texts)
        if k == 1:
            runs = collections.Counter()
            for t in after.text:
                q = [" ".join(x.split()) for x in t.split("\n") if x.strip()]
                runs.update(set(zip(q, q[1:], strict=False)))
            assert runs and max(runs.values()) == 1 and (after.n_chars == after.text.map(len)).all()
        if k == 2:
            groups, _ = clusters([(i, sets_of(t)) for i, t in texts.items()])
            assert kept == {i for i, t in texts.items() if groups.get(i, [i])[0] == i}
        if k == 3:
            plain = lambda t: f" {re.sub(r'[\W_]+', ' ', t.lower()).strip()} "
            items = [plain(t) for t in spark.read.parquet(f"{data}/benchmark.parquet").toPandas().text]
            leaked = {i for i, t in texts.items() if any(x in plain(t) for x in items)}
            assert leaked and leaked.isdisjoint(kept) and len(texts) - len(kept) <= 2 * len(leaked)
        before = after


WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
DIRTY = [
    (1, f"A first line of {WORDS}.\nAnother line, {WORDS} again."), (1, f"A first line of {WORDS}.\nAnother line, {WORDS} again."), (1, "Quite another text has the same id here, and some words."),
    (None, "A text without an id is a document like others."), (None, f"A first line of {WORDS}.\nAnother line, {WORDS} again."), (2, None), (3, ""), (4, " \n\t"),
    (5, f"This text holds the benchmark passage: alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu, {WORDS}."), (6, "word " * 30_000 + "\n" + "x" * 100_000), (7, "1234 5678"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, node long, root string, sequence_id string, `key` string, n int, __id int"


def dirty(spark, tmp_path, rows):
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "h", 1, "r", "q", "k", 2, 3) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (None, "x"), (2, None)] if rows else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_on_dirty_tables(spark, tmp_path):
    """Null and clashing ids, repeated rows, null, empty and very long texts, extra columns with names that stages use: at every stage."""
    path = dirty(spark, tmp_path, DIRTY)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for name in names[:-1]:
        out = stages[name](spark, docs, path)
        assert out.schema == docs.schema and {(r.lang, r.h, r.sequence_id) for r in out.select("lang", "h", "sequence_id").collect()} <= {("en", "h", "q")}, name
    every = sorted(DIRTY, key=str)
    lettered = [r for r in every if any(c.isalpha() for c in r[1] or "")]
    assert rows(stages[names[0]](spark, docs, path)) == lettered
    near = rows(stages[names[2]](spark, docs, path))
    twin = DIRTY[0][1]
    assert sum(t == twin for _, t in near) in (1, 2) and [r for r in near if r[1] != twin] == [r for r in every if r[1] != twin]
    clean = rows(stages[names[3]](spark, docs, path))
    assert clean == [r for r in every if r[0] != 5]
    packed = stages[names[4]](spark, docs, path).collect()
    assert sum(r.piece == 0 for r in packed) == len(DIRTY)


def test_stages_on_empty_tables(spark, tmp_path):
    path = dirty(spark, tmp_path, [])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == [], name


def test_attach_splits_hot_keys(spark):
    """A key with half of all rows, cold ones and null ones: the rows of a plain left join."""
    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 WHEN id % 11 = 0 THEN NULL ELSE id END k")
    groups = rows.filter("k IS NOT NULL").groupBy("k").count().selectExpr("k", "count c", "k * 2 v")
    same = lambda df: sorted((r.id, r.k, r.v) for r in df.collect() if r.k is not None)
    assert same(attach(rows, groups, "k", "c")) == same(rows.join(groups, "k", "left"))
    assert attach(rows, groups, "k", "c").count() == 20_000


def test_run(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100


def test_model_without_rows():
    assert langid.train(__import__("numpy").zeros((0, langid.BUCKETS)), []).predict(["abc", None])[0] == ["und", "und"]
