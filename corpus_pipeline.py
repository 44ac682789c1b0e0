"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloakwork.llm import decontaminate, langid, lines, neardup, packing
from cloakwork.llm.common import cut, scratch

#: Up to this many ids are broadcast to the documents; beyond, both are shuffled.
BROADCAST_IDS = 500_000
#: The columns that stages read; all others pass through under other names, so none clashes with what operators add.
READ = ("doc_id", "text", "lang")


def aside(docs: DataFrame, stage) -> DataFrame:
    """stage(docs) with the columns that no stage reads renamed meanwhile."""
    return stage(docs.toDF(*(c if c in READ else f"__own{i}" for i, c in enumerate(docs.columns)))).toDF(*docs.columns)


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs but for the rows with these (doc_id, text_hash), null ids too: another text of the same id stays."""
    found = cut(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__gone")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__hash").eqNullSafe(F.col("__gone"))
    return hashed(docs).join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, same, "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: `und` (null or letterless text) and flagged ambiguities are rejected.

    Each row is judged by its own text, whatever its id; repeated rows go or stay together. No documents: none.
    """

    def told(rows: DataFrame) -> DataFrame:
        return langid.annotate(rows, langid.fit(rows)).filter("lang_pred <> 'und' AND NOT ambiguous").select(*rows.columns)

    return aside(docs, told)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a document of which no line is left goes.

    Null and empty texts stay as they are, null ids come first; rows that repeat id and text share one result. n_chars follows
    the text, where there is such a column. No documents: none.
    """

    def shorter(rows: DataFrame) -> DataFrame:
        return lines.dedup_lines(rows).filter("n_dropped = 0 OR text RLIKE '[^ \\t\\n\\x0B\\f\\r]'").select(*rows.columns)

    out = aside(docs, shorter)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the first by (doc_id, text hash), nulls last; null, empty and wordless texts all stay.

    Of rows that repeat both the id and the text of a document that stays, one stays; a text with words counts, not its id:
    another text of the same id is another document. No documents: none.
    """

    def one_of_each(rows: DataFrame) -> DataFrame:
        found = cut(neardup.join(rows, counts=False).filter("n_shingles > 0").select("doc_id", "text_hash", "kept"))
        left = without(rows, found.filter("NOT kept"))
        twice = cut(found.filter("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
        if twice.isEmpty():
            return left
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__gone"))
        repeated = hashed(left).join(twice.toDF("__id", "__gone"), same, "left_semi")
        first = F.min_by(F.struct(*rows.columns), F.xxhash64(*(F.col(c).cast("string") for c in rows.columns)))
        return without(left, twice).union(repeated.groupBy("doc_id", "__hash").agg(first.alias("row")).select("row.*"))

    return aside(docs, one_of_each)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none; null ids and other texts of an id count alone."""
    return aside(docs, lambda rows: without(rows, decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens. Null text counts as empty; repeated rows each give pieces."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The stages learn, group and search; tests hold the rows against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table `documents` in sf_dir."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(STAGES) - 1
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < last:
            path = scratch(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
