"""Operator 7: substring dedup by MinHash banding of paragraphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import attach, cut, small_batches
from .similar import BROADCAST_ROWS, SIMILAR, SLICE, WORDS, Keys, _hash_words, _tables, banded, classes, digest, fetch, mix, shingles, word_hashes

#: Words of the shortest paragraph that is compared.
LEAST_WORDS = 10
#: Recall at the threshold for which bands are tuned, and rows of a band.
RECALL, ROWS = 0.995, 3
#: Words of the runs by which passages are found inside and across paragraphs that aren't alike as a whole, and the places of
#: which one is picked: equal runs of PASSAGE + PICK = 51 words are found.
PASSAGE, PICK = 25, 26
#: Code points read on both sides of a slice of a very long text, so runs across its ends are seen.
CONTEXT = 1 << 13
#: Equal runs this few words apart are a word or phrase over and over.
NEAR = 8
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Up to this many repeated passage hashes (8 bytes each) are broadcast; beyond, both sides are shuffled.
BROADCAST_HASHES = 2_000_000


def tuned(recall: float = RECALL, rows: int = ROWS, similar: float = SIMILAR) -> Keys:
    """The fewest bands with which two paragraphs at the threshold meet in one with that probability."""
    bands = 1
    while Keys(bands, rows).recall(similar) < recall:
        bands += 1
    return Keys(bands, rows)


def _paragraphs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, paragraph) of each line, in code points."""
    out, at = [], 0
    for p in text.split("\n"):
        out.append((at, at + len(p), p))
        at += len(p) + 1
    return out


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out, have = op(out[:-step], out[step:]), have + step
    return out


def _picked(key: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: whether each place has the least key of some w neighbouring places."""
    if len(key) <= w:
        return key == key.min(initial=NEVER)
    least = _slide(key, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    return _slide(np.concatenate([edge, least, edge]), w, np.maximum) == key


def _windows(joined: str, n: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, line) of the picked runs of n words, each within one of the texts that start at `first`. At most SLICE code points.

    Of PICK places in a row the one of least hash is picked (winnowing), first words of sentences before others: about two
    of PICK + 1 places, and texts that share n + PICK words in a row, with the same ends of sentences, share a picked run,
    wherever their lines end. Runs that equal one up to NEAR words before (one word over and over) don't count inside sentences.
    """
    low = joined.lower()
    if len(low) != len(joined):
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in joined)
    h, start, end = _hash_words(low)
    if len(h) < n:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.cumsum(c == 10)[start]
    sentence = np.zeros(len(h), bool)
    sentence[1:] = np.isin(c[end[:-1]], (33, 46, 63))
    _, power, inverse = _tables()
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    m = len(h) - n + 1
    name = mix((sums[n:] - sums[:m]) * inverse[:m])
    text = np.searchsorted(first, start, side="right")
    again = np.zeros(m, bool)
    for p in range(1, min(NEAR, m - 1) + 1):
        again[p:] |= name[p:] == name[:-p]
    key = np.where(sentence[:m], name >> np.uint64(1), np.where(again, NEVER, name | np.uint64(1 << 63)))
    key[text[:m] != text[n - 1 :]] = NEVER
    i = np.flatnonzero(_picked(key, PICK) & (key != NEVER))
    return name[i], start[i], end[i + n - 1], line[i]


def _cuts(text: str):
    """(offset, lines before, piece, from, to): pieces of less than SLICE code points, each with CONTEXT on both sides of its own part."""
    at, low, lines = 0, 0, 0
    while at < len(text):
        end = min(len(text), at + SLICE - 1 - 2 * CONTEXT)
        before, low = low, max(0, at - CONTEXT)
        lines += text.count("\n", before, low)
        yield low, lines, text[low : end + CONTEXT], at, end
        at = end


def _batch_windows(texts: list[str], n: int):
    """(row, hash, start, end, paragraph of the start) arrays of all picked windows of the texts, joined SLICE at a time."""
    held: list[tuple[int, int, int, str, int, int]] = []
    size = 0

    def flush():
        joined = "\n".join(x[3] for x in held)
        first = np.cumsum([0] + [len(x[3]) + 1 for x in held[:-1]])
        lines = np.cumsum([0] + [x[3].count("\n") + 1 for x in held[:-1]])
        h, start, end, line = _windows(joined, n, first)
        k = np.searchsorted(first, start, side="right") - 1
        row, offset, before, own, to = (np.array([x[i] for x in held], np.int64)[k] for i in (0, 1, 2, 4, 5))
        start, end, line = start - first[k] + offset, end - first[k] + offset, line - lines[k] + before
        keep = (start >= own) & (start < to)
        return tuple(x[keep] for x in (row, h, start, end, line))

    for row, text in enumerate(texts):
        for offset, before, piece, own, to in _cuts(text or ""):
            if held and size + len(piece) + 1 > SLICE:
                yield flush()
                held, size = [], 0
            held.append((row, offset, before, piece, own, to))
            size += len(piece) + 1
    if held:
        yield flush()


def passages(docs: DataFrame, kind: str, clustered: DataFrame, n: int = PASSAGE) -> DataFrame:
    """Passages of n or more equal words that stand in different texts and begin inside paragraphs that stay; see _windows.

    docs: (id, h, text); clustered: (id, h, par, kept), the paragraphs of clusters. Those removed have no passage rows and hold
    no passage's first place, as they go as a whole. Those kept have rows for passages that another text has in a paragraph
    that stays; what only their own removed copies repeat needs none. First only the windows' hashes are counted, over all texts; the
    windows that two texts share are then looked up, and those that overlap in a text are joined. Passages may go over
    line ends; par is the paragraph where one begins. Of a text that several rows hold, a passage is kept in the row of the least id.
    """

    def hashes(batches):
        for b in batches:
            h = b.column(0).to_numpy()
            for row, wh, *_ in _batch_windows(b.column(1).to_pylist(), n):
                yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(wh.view(np.int64))], names=["h", "wh"])

    def places(batches):
        for b in batches:
            for row, wh, start, end, par in _batch_windows(b.column(2).to_pylist(), n):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(par.astype(np.int32)), pa.array(start), pa.array(end), pa.array(wh.view(np.int64))], names=["id", "h", "par", "start", "end", "wh"])

    texts = docs.filter("text IS NOT NULL")
    shared = texts.select("h", "text").mapInArrow(hashes, "h long, wh long").groupBy("wh").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("wh")
    shared = cut(shared)
    # equal texts are searched once, in the row of the least id, and get their rows at the end
    no_id = F.col("id").isNull()
    copied = cut(texts.groupBy("h").agg(F.min(F.struct(no_id.alias("no_id"), "id")).alias("least"), F.count("*").alias("copies")).filter("copies > 1").select("h", F.col("least.id").alias("__least"), "copies"))
    one = texts.join(F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied, "h", "left").filter(F.col("copies").isNull() | F.col("id").eqNullSafe(F.col("__least")))
    rows = one.select("id", "h", "text").mapInArrow(places, f"id {kind}, h long, par int, start long, end long, wh long")
    known = clustered.select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("par").alias("__par"), F.col("kept").alias("stays")).distinct()
    rows = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_HASHES else shared, "wh")
    rows = cut(rows.join(known, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")) & (F.col("par") == F.col("__par")), "left").drop("__id", "__h", "__par"))
    place, open_ = F.struct(no_id.alias("no_id"), "id", "par", "start"), F.col("stays").isNull() | F.col("stays")
    counted = rows.join(F.broadcast(copied.select("h", "copies")) if copied.count() <= BROADCAST_ROWS else copied.select("h", "copies"), "h", "left")
    texts_left = F.min(F.when(open_, F.col("h"))) < F.max(F.when(open_, F.col("h")))
    by = cut(counted.groupBy("wh").agg(F.min(F.when(open_, place)).alias("lead"), F.coalesce(texts_left, F.lit(False)).alias("twice"), F.count("*").alias("n"), F.sum(F.coalesce("copies", F.lit(1))).alias("cluster_size")))
    open_ = attach(rows.filter(open_), by, "wh", "n", "inner").filter("stays IS NULL OR twice").withColumn("kept", F.col("lead") == place)
    w = W.partitionBy("id", "h").orderBy("start", "end")
    open_ = open_.withColumn("new", F.coalesce((F.col("start") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    open_ = open_.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = open_.groupBy("id", "h", "run").agg(F.min("par").alias("par"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("lead").alias("lead"), F.max("cluster_size").alias("cluster_size"), F.min("kept").alias("kept"))
    fields = ("par", "start", "end", "lead", "cluster_size", "kept")
    by_text = runs.groupBy("h").agg(F.collect_set(F.struct(F.col("id").alias("of"), *fields)).alias("runs"))
    by_text = cut(by_text.join(copied.select("h", "copies"), "h", "left").withColumn("copies", F.coalesce("copies", F.lit(1))))
    out = attach(texts.select("id", "h"), by_text, "h", "copies", "inner").select("id", "h", F.explode("runs").alias("r"))
    return out.select("id", "h", *(F.col(f"r.{c}").alias(c) for c in fields[:-1]), (F.col("r.kept") & F.col("id").eqNullSafe(F.col("r.of"))).alias("kept"))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR, least: int = LEAST_WORDS, recall: float = RECALL) -> DataFrame:
    """(id, paragraph, start, end, cluster_id, cluster_par, cluster_size, kept, kind) for each paragraph of a cluster of two or more, and each passage that stands in several texts.

    Paragraphs are lines of at least `least` words; two are linked if the Jaccard similarity of their sets of `words`-word
    shingles is at least `similar`, and clusters are connected components. Of a cluster the first paragraph by (id, place)
    stays (kept), the others are removals; cluster_id and cluster_par are the first one's id and number. Spans are in code
    points. Null and empty texts have no paragraphs. Rows that repeat an id and text repeat each other's paragraphs: one of
    equal (id, place) stays marked kept in each row. Null ids come last. Other columns aren't read.

    Paragraphs that stay, of a cluster or of none, may hold a passage that other texts have as well: runs of PASSAGE or more
    equal words are given with kind `passage`. A run of PASSAGE + PICK words that two texts share is found, whatever its
    lines (see _windows). Very long texts are read whole, in slices. An empty table gives no rows.

    Equal sets are one node, counted before the shuffle; only nodes that share a band with another are fetched and compared,
    first with the least node of the band, then, where that leaves several groups in a band, pair by pair (see similar.classes).
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    bands = tuned(recall, ROWS, similar)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches):
        for b in batches:
            row, par, start, end, texts = [], [], [], [], []
            for r, text in enumerate(b.column(2).to_pylist()):
                for k, (i, j, p) in enumerate(_paragraphs(text or "")):
                    if j - i >= 2 * least - 1:  # so many words need so many letters and blanks
                        row.append(r), par.append(k), start.append(i), end.append(j), texts.append(p)
            hashed = word_hashes(texts)
            some = [k for k, w in enumerate(hashed) if len(w) >= least]
            sets = [shingles(hashed[k], words) for k in some]
            take = pa.array([row[k] for k in some], pa.int64())
            pick = lambda x, t: pa.array([x[k] for k in some], t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pick(par, pa.int32()), pick(start, pa.int64()), pick(end, pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([8 * len(s) for s in sets], pa.int64()), pa.array(list(bands.bands(sets).view("int64")) if sets else [], pa.list_(pa.int64()))],
                names=["id", "h", "par", "start", "end", "name", "bytes", "keys"],
            )

    def reread(batches):
        for b in batches:
            node, par = b.column(0), b.column(1).to_pylist()
            texts = [t.split("\n")[p] for t, p in zip(b.column(2).to_pylist(), par, strict=True)]
            yield pa.RecordBatch.from_arrays([node, pa.array([shingles(w, words).tobytes() for w in word_hashes(texts)], pa.binary())], names=["node", "set"])

    rows = cut(docs.mapInArrow(sketch, f"id {kind}, h long, par int, start long, end long, name binary, bytes long, keys array<long>"))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "par", "h")
    nodes = rows.groupBy("name").agg(F.count("*").alias("size"), F.min(first).alias("first"), F.first("bytes").alias("bytes"), F.first("keys").alias("keys"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    met = banded(nodes.select("node", "keys"))
    wanted = cut(met.select("node").distinct().join(nodes, "node").select("node", "first.id", "first.h", "first.par"))
    sets = cut(fetch(docs, wanted).select("node", "par", "text").mapInArrow(reread, "node long, set binary").dropDuplicates(["node"]))
    roots = classes(nodes, met, sets, [1], None, similar)

    whole = nodes.select("node", "name", "size", "first").join(roots, "node", "left").filter("size > 1 OR root IS NOT NULL")
    whole = cut(whole.withColumn("root", F.coalesce("root", "node")))
    by = cut(whole.groupBy("root").agg(F.min("first").alias("lead"), F.sum("size").alias("cluster_size"), F.count("*").alias("n")))
    named = cut(attach(whole.select("root", "name", "size"), by, "root", "n", "inner").select("name", "size", "lead", "cluster_size"))
    places = rows.select("id", "h", "par", "start", "end", "name")
    whole_ = cut(attach(places, named, "name", "size", "inner").withColumn("kept", F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("par") == F.col("lead.par"))))
    inner = passages(docs, kind, whole_.select("id", "h", "par", "kept"))
    cols = [F.col("id").alias(id_col), F.col("par").alias("paragraph"), "start", "end", F.col("lead.id").alias("cluster_id"), F.col("lead.par").alias("cluster_par"), "cluster_size", "kept"]
    return whole_.select(*cols, F.lit("paragraph").alias("kind")).unionByName(inner.select(*cols, F.lit("passage").alias("kind")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: `repeats` over the whole table `documents`; see there for nulls, ties and empty tables."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
