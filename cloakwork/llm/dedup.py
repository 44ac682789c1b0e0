"""Operator 2: exact dedup against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import attach, cut, scratch

#: Runs of these characters (a space, tab to carriage return) count as one space.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """A table (digest, keep_id, batch) at a path in shared storage, `buckets` files by hash of the digest, each sorted by it.

    Reopened with the same path and buckets in a later session, it still holds what earlier batches brought. New data is
    deduplicated by a sort-merge anti-join: the index side is read by bucket, without a shuffle. Appends add sorted files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the digests of groups (digest, keep_id) that the index lacks, by sort-merge anti-join.

        Appending a batch that was appended before adds nothing, so a job may be run again.
        """
        fresh = groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def drop(self) -> None:
        """Forgets the table in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def dedup(df: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts are. Of equal rows, the one the index already knows stays, or else the
    one with the smallest id of this batch; group_size counts this batch. A null id sorts last and can't be kept over another;
    repeated rows with the kept id and the same text are all marked kept. An empty table gives no rows and leaves the index as it is.
    Groups are combined before the shuffle; rows of groups with a large share are joined by broadcast (see attach).
    """
    ids = cut(df.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")))
    groups = cut(ids.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")))
    index.append(groups, batch)
    known = cut(groups.drop("keep_id").hint("merge").join(index.read().select("digest", "keep_id").hint("merge"), "digest"))
    out = attach(ids, known, "digest", "group_size", "inner")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows: every document with the row that stays of its normalised text; null counts as empty, of equal ids any row stays."""
    index = DigestIndex(spark, scratch(spark, "digests"))
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), index, "first")


OP2_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
