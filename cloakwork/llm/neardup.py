"""Operator 10: n-gram Jaccard join of documents by a MinHash LSH forest with exact verification."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import attach, cut, small_batches
from .similar import SIMILAR, WORDS, Keys, classes, digest, fetch, links, runs, shingles, word_hashes

#: Trees of the forest, the prefix lengths tried, deepest first, and the recall until which prefixes are shortened.
TREES, LEVELS, RECALL = 24, (10, 8, 6), 0.999


def levels(forest: Keys, recall: float, similar: float, tried: tuple[int, ...] = LEVELS) -> list[int]:
    """The prefix lengths, deepest first, down to the one at which sets at the threshold meet with that recall."""
    out = []
    for d in [*tried, *range(min(tried) - 1, 0, -1)]:
        out.append(d)
        if forest.recall(similar, d) >= recall:
            break
    return out


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR, trees: int = TREES, recall: float = RECALL, counts: bool = True) -> DataFrame:
    """One row for each row of df: id, class_id, class_size, n_links, n_shingles, text_hash, kept.

    Documents are linked if the Jaccard similarity of their sets of `words`-word shingles is at least `similar`; class_id is
    the least id of the connected group, class_size its documents, n_links the documents linked with this one directly.
    Words are runs of letters and digits, lower-cased; shorter texts have one shingle of all their words. Very long texts are
    hashed whole, in slices. kept marks the first of a class by (id, text_hash), nulls last; text_hash is xxhash64 of the text. Null, empty and wordless texts are linked with nothing, in a class of their own (class_id is
    their id). Repeated rows are documents of their own, linked with each other; null ids stay and never name a class
    that has another id. Other columns aren't read, so none clashes. An empty table gives no rows.

    Each tree of the forest holds the sets by a label of MinHash values; its sorted labels are a trie (see similar.runs). Sets
    are matched on the deepest prefix first. A set's prefixes are shortened until its links are met with probability `recall`:
    as judged by a similarity halfway between the threshold and its weakest verified link, or by the threshold itself where it
    has none, so sets without links go down to the shortest prefix (recall at the threshold there: 0.9993), while
    members of a dense group of copies stop early. A stopped set may still be met by others. Equal sets are one node
    before any search, and every match is verified exactly. With counts, all pairs of a verified class are compared for
    n_links, in blocks, also those that met in no tree; without, n_links is null, and nothing grows with pairs.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    forest = Keys(trees, max(LEVELS))
    depths = levels(forest, recall, similar)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches):
        for b in batches:
            sets = [shingles(w, words) for w in word_hashes([t or "" for t in b.column(2).to_pylist()])]
            some = [k for k, s in enumerate(sets) if len(s)]
            labels = dict(zip(some, forest.labels([sets[k] for k in some]), strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([labels.get(k) for k in range(len(sets))], pa.binary())],
                names=["id", "h", "name", "n_shingles", "labels"],
            )

    def reread(batches):
        for b in batches:
            sets = [shingles(w, words) for w in word_hashes(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    rows = cut(docs.mapInArrow(sketch, f"id {kind}, h long, name binary, n_shingles int, labels binary"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("first")
    nodes = rows.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("size"), first, (F.first("n_shingles") * 8).cast("long").alias("bytes"), F.first("labels").alias("labels"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    met = runs(nodes, trees, 1, depths)
    wanted = cut(met.select("node").distinct().join(nodes.select("node", "first"), "node").select("node", "first.id", "first.h"))
    sets = cut(fetch(docs, wanted).select("node", "text").mapInArrow(reread, "node long, set binary").dropDuplicates(["node"]))

    def enough(least: Column, depth: int) -> Column:
        alike = (least + similar) / 2
        return 1 - F.pow(1 - F.pow(alike, F.lit(depth)), F.lit(trees)) >= recall

    roots = classes(nodes, met, sets, depths, enough, similar)
    whole = nodes.select("node", "name", "size", "bytes", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if counts:
        members = whole.join(roots.select("node"), "node", "left_semi").select(F.col("root").alias("bucket"), "node", "size", "bytes", F.lit(0).alias("side"))
        found = links(members, sets, similar).groupBy("node").agg(F.sum("links").alias("links"))
        whole = whole.join(found, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("size") - 1)
    else:
        whole = whole.withColumn("n_links", F.lit(None).cast("long"))
    whole = cut(whole.select("root", "name", "size", "first", "n_links"))
    by = cut(whole.groupBy("root").agg(F.min("first").alias("class"), F.sum("size").alias("class_size"), F.count("*").alias("n")))
    named = cut(attach(whole.select("root", "name", "size", "n_links"), by, "root", "n", "inner").select("name", "size", "class", "class_size", "n_links"))
    out = attach(rows.filter("name IS NOT NULL").select("id", "h", "name", "n_shingles"), named, "name", "size", "inner")
    kept = F.col("id").eqNullSafe(F.col("class.id")) & (F.col("h") == F.col("class.h"))
    out = out.select("id", F.col("class.id").alias("class_id"), "class_size", "n_links", "n_shingles", F.col("h").alias("text_hash"), kept.alias("kept"))
    alone = rows.filter("name IS NULL").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long"), F.lit(0).cast("long"), "n_shingles", "h", F.lit(True))
    return out.union(alone).withColumnRenamed("id", id_col)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: `join` over the whole table `documents`; see there for nulls, ties and empty tables."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "kept")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, '|')) END AS node, sh FROM s),
d AS (SELECT node, min(doc_id) AS least, count(*) AS size, any_value(n_shingles) AS k, any_value(sh) AS sh FROM n WHERE node IS NOT NULL GROUP BY node),
u AS (SELECT node, k, unnest(sh) AS x FROM d),
p AS (SELECT a.node AS a, b.node AS b, a.k AS ka, b.k AS kb, count(*) AS met FROM u a JOIN u b ON a.x = b.x AND a.node <> b.node GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE met / (ka + kb - met) >= 0.8 - 1e-9),
r(a, b) AS (SELECT node, node FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS node, min(least) AS class_id, sum(size)::BIGINT AS class_size FROM r JOIN d ON r.b = d.node GROUP BY r.a),
l AS (SELECT e.a AS node, sum(size)::BIGINT AS links FROM e JOIN d ON e.b = d.node GROUP BY e.a)
SELECT n.doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(class_size, 1) AS class_size, coalesce(links, 0) + coalesce(size, 1) - 1 AS n_links, n.n_shingles::INT AS n_shingles
FROM n LEFT JOIN c USING (node) LEFT JOIN l USING (node) LEFT JOIN d USING (node)
"""
