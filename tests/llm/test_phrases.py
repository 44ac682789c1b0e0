"""Phrase collocations against a plain count, over borders of prefix ranges and slices, and on edges."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cloakwork.llm import phrases


def expected(rows, least, held, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        f[lang][tuple(w[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q, b in counts.items() if len(q) > len(p) and b >= least and 100 * b >= held * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if longer:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "été", "New", "York", "a\x01", "a", "b", "x" * 50, "\U0001f600"] + [f"w{i}" for i in range(12)]
    rows = []
    for _ in range(n):
        w = [rng.choice(words) if rng.random() < 0.6 else rng.choice(["New York City Hall", "the end of", "a b", "of the"]) for _ in range(rng.randrange(0, 60))]
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for x in w)
        rows.append((rng.choice(["en", "de", None]), text))
    return rows + [("en", None), (None, ""), ("fr", " .\n, "), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("small", [False, True])
def test_against_a_plain_count(spark, monkeypatch, small):
    """With small shards, slices and ranges every border is crossed."""
    if small:
        monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
        monkeypatch.setattr(phrases, "SLICE_WORDS", 300)
        monkeypatch.setattr(phrases, "RANGE_BYTES", 2000)
    rows = corpus(4, 300)
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "lang string, text string, words string, f int").repartition(5)
    if small:
        texts = df.selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text")
        assert sum(map(len, phrases._borders(texts).values())) > 10
    got = {tuple(r) for r in phrases.collocations(df, least=8, top=40).collect()}
    want = expected(rows, 8, 80, 40)
    assert len(want) > 60 and got == want


def test_slices_and_packed_tries(monkeypatch):
    """Small slices of a shard have the same paths together as one large one, and a packed trie comes back as it was."""
    text = "\n".join(t for _, t in corpus(9, 200) if t).encode()

    def counted():
        found = Counter()
        for paths, counts, words in phrases._tries(text):
            paths, counts, own = phrases._unpack(phrases._pack(paths, counts, words))
            own = [b"", *own.to_pylist()]
            for path, n in zip(paths.tolist(), counts.tolist()):
                found[tuple(own[i] for i in path)] += n
        return found

    whole = counted()
    monkeypatch.setattr(phrases, "SLICE_WORDS", 50)
    assert counted() == whole and sum(whole.values()) > 5000


def test_one_common_word_pair(spark):
    """A pair that makes up most of the corpus, in one very long text and many short ones."""
    rows = [("en", "same thing " * 40_000)] + [("en", "same thing again.")] * 500
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in phrases.collocations(df).collect()} == expected(rows, 30, 80, 2000)


def test_counts_beyond_64_bits(spark):
    """Products of counts of 2**60 stay exact."""
    big = 1 << 60
    trie = spark.createDataFrame([(["a", "b"], big - 1, [4 * big, big], [big + 3])], "words array<string>, f long, lefts array<long>, rights array<long>")
    score = trie.selectExpr("(CAST(2000000 AS decimal(7,0)) * CAST(f AS decimal(19,0))) DIV (CAST(lefts[1] AS decimal(19,0)) + CAST(rights[0] AS decimal(19,0))) AS s").first().s
    assert score == 2_000_000 * (big - 1) // (2 * big + 3)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []
