"""Batches: counters, status, approvals, pages, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import counter_name
from ..model import SEEDED_TYPES


def entity_counts(notes: DataFrame, entities_col: str = "entities") -> DataFrame:
    """(type, n) over all notes, most first. Only types leave the rows, combined before the shuffle."""
    return notes.select(F.explode(F.col(entities_col)["type"]).alias("type")).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def counters(notes: DataFrame, batch_col: str = "batch_id", entities_col: str = "entities", failed: Column | None = None, types: tuple[str, ...] = SEEDED_TYPES) -> DataFrame:
    """One row a batch: input, processed, total entities, notes with any, and a counter for each type; one grouped pass.

    Entities count once for each note, so a redelivered note doesn't count twice.
    """
    ok = F.lit(True) if failed is None else ~failed
    size = F.when(ok, F.size(entities_col)).otherwise(0)
    per = [F.sum(_of(entities_col, t, ok)).alias(f"pii_{t}") for t in types]
    return notes.groupBy(batch_col).agg(F.count("*").alias("input_count"), F.count_if(ok).alias("processed_count"), F.sum(size).alias("total_entities"), F.count_if(size > 0).alias("notes_with_pii"), *per)


def _of(entities_col: str, t: str, ok: Column) -> Column:
    return F.when(ok, F.size(F.filter(entities_col, lambda e: F.coalesce(e["type"], F.lit("unknown")) == t))).otherwise(0)


def by_type(notes: DataFrame, batch_col: str = "batch_id", entities_col: str = "entities") -> DataFrame:
    """(batch, counter, n) for counters over 0, most first within a batch."""
    rows = notes.select(batch_col, F.explode(entities_col).alias("e")).select(batch_col, counter_name(F.col("e.type")).alias("counter"))
    return rows.groupBy(batch_col, "counter").agg(F.count("*").alias("n")).orderBy(batch_col, F.desc("n"), "counter")


def status(processed: Column, total: Column, stored: Column, updated: Column, as_of: Column, minutes: int = 2) -> Column:
    """The status shown: a batch partly done that was touched in the last minutes is still processing."""
    recent = F.coalesce(as_of - updated < F.expr(f"INTERVAL '{minutes}' MINUTE"), F.lit(False))
    return F.when((stored == "partially-completed") & (processed < total) & recent, "processing").otherwise(stored)


def next_status(processed: Column, total: Column, failed: Column) -> Column:
    return F.when(processed >= total, "completed").when(failed > 0, "partially-completed").otherwise("processing")


def approvals(notes: DataFrame, approved: Column, batch_col: str = "batch_id") -> DataFrame:
    """(batch, input_count, approved_count, all_approved)."""
    out = notes.groupBy(batch_col).agg(F.count("*").alias("input_count"), F.count_if(F.coalesce(approved, F.lit(False))).alias("approved_count"))
    return out.withColumn("all_approved", (F.col("approved_count") >= F.col("input_count")) & (F.col("input_count") > 0))


def last_state(changes: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """The last value of each key by time: approvals and withdrawals as they came."""
    return changes.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def page(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: tuple | None = None) -> DataFrame:
    """Keyset page: the first `limit` rows behind the key `after`, (column, descending) by order. Never an offset scan."""
    if after is not None:
        cond, same = F.lit(False), F.lit(True)
        for (c, desc), v in zip(order, after, strict=True):
            cond = cond | (same & ((F.col(c) < F.lit(v)) if desc else (F.col(c) > F.lit(v))))
            same = same & (F.col(c) == F.lit(v))
        df = df.filter(cond)
    return df.orderBy(*(F.desc(c) if d else F.asc(c) for c, d in order)).limit(max(1, min(limit, 200)))


def cursor(key: dict[str, Column]) -> Column:
    return F.base64(F.to_json(F.struct(*(c.alias(k) for k, c in key.items()))).cast("binary"))


def dead_letters(attempts: DataFrame, key: str, failed: Column, most: int = 3) -> DataFrame:
    """(key, attempts, failures, dead): keys that failed `most` times are set aside for a redrive."""
    out = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.count_if(failed).alias("failures"))
    return out.withColumn("dead", F.col("failures") >= most)
