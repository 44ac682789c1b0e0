"""Operator 4: language ID by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import small_batches

#: Character n-grams of one to three letters fall into this many buckets.
BUCKETS = 4096
#: Labelled rows of each language that the fit reads at most, the first by a hash of their id.
SAMPLE = 300
#: Below this score a prediction is flagged as ambiguous.
AMBIGUOUS = 0.6
#: Code points counted at once, so a very long text needs no more memory than others.
SLICE = 400_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point itself where it is a letter, else a space."""
    t = np.arange(0x110000, dtype=np.uint32)
    t[[not chr(c).isalpha() for c in range(0x110000)]] = 32
    return t


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x BUCKETS square roots of n-gram shares, rows with a letter). Whole texts are counted, in slices."""
    counts = np.zeros((len(texts), BUCKETS), np.float32)
    lettered = np.zeros(len(texts), bool)
    for row, text in enumerate(texts):
        c = None
        for at in range(0, len(text or ""), SLICE):
            new = _codes(text[at : at + SLICE])
            joined = new if c is None else np.concatenate([c[-2:], new])
            fresh, c = len(new), joined
            word = joined != 32
            lettered[row] |= bool(word.any())
            h = joined.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for n in (1, 2, 3):
                if len(joined) >= n:
                    skip = max(0, len(joined) - fresh - n + 1)  # n-grams that the slice before has counted
                    counts[row] += np.bincount((h >> np.uint64(52)).astype(np.int64)[skip:][word[skip : len(h)]], minlength=BUCKETS)
                if len(joined) > n:
                    h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + joined[n:] * np.uint64(0x94D049BB133111EB)
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)), lettered


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1 with every column splitting the languages: all splits up to six languages, else the best of random codes."""
    if k < 2:
        return np.ones((k, 0), int)
    if k <= 6:
        cols = np.array([[1 if (v >> i) & 1 else -1 for i in range(k)] for v in range(1, 2 ** (k - 1))]).reshape(-1, k).T
        return cols
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(60):
        m = rng.choice([-1, 1], (k, max(15, int(10 * np.ceil(np.log2(k))))))
        m = m[:, np.abs(m.sum(0)) < k]
        d = ((m[:, None] != m[None]).sum(2) + m.shape[1] * np.eye(k, dtype=int)).min()
        if d > least:
            best, least = m, d
    return best


class Model:
    """langs, their codewords, and a linear classifier for each bit."""

    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.codes, self.weights, self.bias = langs, codes, weights, bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; `und` and 0 where it is null or has no letter, or nothing was learned."""
        langs, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), 64):
            x, lettered = features(texts[at : at + 64])
            if not self.langs:
                langs += ["und"] * len(x)
                continue
            margins = x @ self.weights + self.bias
            # loss-weighted decoding: each bit counts by its logistic loss against the codeword's bit
            loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None]).sum(2)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p /= p.sum(1, keepdims=True)
            for r, (k, ok) in enumerate(zip(p.argmax(1), lettered, strict=True)):
                langs.append(self.langs[k] if ok else "und")
                scores[at + r] = p[r, k] if ok else 0.0
        return langs, scores


def train(x: np.ndarray, langs: list[str], steps: int = 250, l2: float = 1e-5) -> Model:
    """Logistic regression for each bit by accelerated gradient steps; languages weigh the same however many rows each has."""
    names = sorted(set(langs))
    codes = codewords(len(names))
    y = np.array([names.index(v) for v in langs], int)
    if not len(names) or codes.shape[1] == 0:
        return Model(names, np.zeros((len(names), 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    sign = codes[y].astype(np.float32)
    share = (1 / (len(names) * np.bincount(y)[y])).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1] + 1, codes.shape[1]), np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    before, rate = w, 2.0 / (0.25 * float((share * x1**2).sum()))
    for t in range(steps):
        v = w + (t / (t + 3)) * (w - before)
        g = x1.T @ (-share * sign / (1 + np.exp(np.clip(sign * (x1 @ v), -60, 60)))) + l2 * v
        before, w = w, v - rate * g
    return Model(names, codes, w[:-1], w[-1])


def held_out(id_: Column) -> Column:
    """Rows that no fit reads: crc32 of the id as text leaves 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of at most `sample` rows of each language, not held out, with text and language.

    The sample's ids are cut to `sample` a language before any shuffle; executors turn the texts into features, so
    only (sample x languages) vectors reach the driver.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    w = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = usable.select("id", "lang").withColumn("n", F.row_number().over(w)).filter(f"n <= {sample}").drop("n").distinct()
    picked = usable.join(F.broadcast(ids), ["id", "lang"], "left_semi").withColumn("n", F.row_number().over(w)).filter(f"n <= {sample}")

    def run(batches):
        for b in batches:
            x, lettered = features(b.column(0).to_pylist())
            keep = np.flatnonzero(lettered)
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep)), pa.array([x[i].tobytes() for i in keep], pa.binary())], names=["lang", "x"])

    got = picked.select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float32).reshape(-1, BUCKETS)
    return train(x, [r.lang for r in got])


ADDED = {"held_out": T.BooleanType(), "lang_pred": T.StringType(), "score": T.DoubleType(), "ambiguous": T.BooleanType()}


def annotate(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows and columns with held_out, lang_pred, score and ambiguous added, each row judged by its whole text alone.

    Null or letterless text: `und`, score 0, not ambiguous. Repeated rows each give a row; null ids stay; an empty table
    gives none. Columns of df named like the added ones are replaced.
    """
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in ADDED]
    kinds = T.StructType([df.schema[c] for c in names] + [T.StructField(c, t) for c, t in ADDED.items()])
    text_at = len(names) + 1

    def run(batches):
        for b in batches:
            langs, scores = model.predict(b.column(text_at).to_pylist())
            unsure = [s < AMBIGUOUS and v != "und" for v, s in zip(langs, scores, strict=True)]
            own = [b.column(i) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=names + list(ADDED))

    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), held_out(F.col(id_col)).alias("held"), F.col(text_col).cast("string").alias("judged"))
    return rows.mapInArrow(run, kinds)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) for each row; see annotate."""
    return annotate(df.select(id_col, text_col), model, id_col, text_col).drop(text_col)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows: every document's language by a model of rows that aren't held out; `und` without a letter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
