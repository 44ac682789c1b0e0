"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest

from cloakwork.llm import decontaminate, dedup, langid, licenses, lines, neardup, packing, paragraphs, secrets, urls
from cloakwork.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, id long, h string, node binary, size int, `key` string, n long, held_out string, n_lines string, __id int, __h int, page_id long, url string"
LONG = "word " * 60_000 + "\n" + "x" * 300_000
TEXTS = [(1, "One two three four five six seven eight nine ten eleven.\nLicensed under the MIT License."), (2, "One two three four five six seven eight nine ten eleven.\nLicensed under the MIT License."), (2, "One two three four five six seven eight nine ten eleven.\nLicensed under the MIT License."), (3, None), (None, "alpha beta gamma"), (None, None), (4, ""), (5, " \n \t\n"), (6, LONG), (7, "\u00e9t\u00e9 \U0001f600 token = abcdefgh")]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en" if t else None, 9, "h", b"x", 1, "k", 2, "z", "q", 3, 4, i, t) for i, t in texts], SCHEMA)


def run(name, spark, df):
    return {
        "pack": lambda: packing.pack(df),
        "dedup": lambda: dedup.dedup(df, dedup.DigestIndex(spark, scratch(spark, "edge"), 4), "b"),
        "license": lambda: licenses.scan(df),
        "language": lambda: langid.identify(df, langid.fit(df)),
        "annotate": lambda: langid.annotate(df, langid.fit(df)),
        "urls": lambda: urls.judge(df),
        "lines": lambda: lines.dedup_lines(df),
        "paragraphs": lambda: paragraphs.repeats(df),
        "secrets": lambda: secrets.scan(df),
        "leaks": lambda: decontaminate.contaminated(df, spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, ""), (3, "short")], "item_id long, text string")),
        "near": lambda: neardup.join(df),
    }[name]().collect()


ALL = ("pack", "dedup", "license", "language", "annotate", "urls", "lines", "paragraphs", "secrets", "leaks", "near")


@pytest.mark.parametrize("name", ALL)
def test_edges(spark, name):
    got = run(name, spark, rows(spark))
    if name in ("dedup", "language", "annotate", "urls", "lines", "secrets", "near"):
        key = "page_id" if name == "urls" else "doc_id"
        assert sorted((r[key] is None, r[key] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in TEXTS)
    if name == "pack":
        assert {r.doc_id for r in got} == {i for i, _ in TEXTS}
        assert sum(r.length for r in got if r.doc_id in (3, 4)) == 2
    if name == "dedup":
        assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {1} and [r.group_size for r in got if r.doc_id == 1] == [3]
        assert sorted(r.doc_id or 0 for r in got if r.group_size == 3 and r.kept) == [1, 3]  # the null and empty texts are one group
    if name in ("language", "annotate"):
        assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, None, 4, 5}
    if name == "lines":
        by = {(r.doc_id, r.text): r for r in got}
        assert by[(3, None)].n_lines == 0 and by[(2, "")].n_dropped == 2 and by[(1, TEXTS[0][1])].n_dropped == 0 and by[(4, "")].n_lines == 1
    if name == "license":
        assert sorted(r.doc_id for r in got) == [1, 2, 2] and {r.family for r in got} == {"MIT"}
    if name == "secrets":
        assert [(r.spans, r.n_assign) for r in got if r.doc_id == 7] == [("assign:6:22", 1)]
    if name == "leaks":
        assert sorted(r.doc_id for r in got) == [1, 2, 2] and {r.item_id for r in got} == {1}
    if name == "near":
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id in (1, 2)) == [(1, 1, 2), (2, 1, 2), (2, 1, 2)]
        assert {r.n_links for r in got if r.doc_id in (3, 4, 5)} == {0}
    if name == "paragraphs":
        assert sorted((r.doc_id, r.kept) for r in got if r.paragraph == 0 and r.kind == "paragraph") == [(1, True), (2, False), (2, False)]


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, name):
    assert run(name, spark, rows(spark, [])) == []
