"""The review and evaluation screens: labels, envelopes, comparisons and report lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import evaluation_time

#: The key and label that a batch's status is shown as, where not all notes of a completed one are approved.
STATUS_LABELS = {
    "created": ("created", "Created"), "ready": ("ready-to-process", "Ready to Process"), "processing": ("processing", "Processing"),
    "partially-completed": ("partially-completed", "Partially Completed"), "completed": ("needs-review", "Needs Review"),
}


def status_label(status: Column, all_approved: Column) -> Column:
    """struct<key, label> of a batch's status."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("label"))
    out = F.when((status == "completed") & F.coalesce(all_approved, F.lit(False)), pair("approved", "Approved"))
    for name, (key, label) in STATUS_LABELS.items():
        out = out.when(status == name, pair(key, label))
    return out.otherwise(pair("unknown", "Unknown"))


def note_list(notes: DataFrame, manifests: DataFrame, mistakes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Notes with their type, null without a manifest, and whether an evaluation has mistakes for them."""
    kinds = manifests.groupBy(id_col).agg(F.min("note_type").alias("note_type"))
    wrong = mistakes.select(id_col).distinct().withColumn("__wrong", F.lit(True))
    out = notes.join(kinds, id_col, "left").join(wrong, id_col, "left")
    return out.withColumn("has_mistakes", F.col("__wrong").isNotNull()).drop("__wrong").orderBy(id_col)


def compared(original: DataFrame, redacted: DataFrame, deidentified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, original, redacted, deidentified) of the notes that have all three texts."""
    named = [df.select(id_col, F.col("text").alias(name)) for df, name in ((original, "original"), (redacted, "redacted"), (deidentified, "deidentified"))]
    return named[0].join(named[1], id_col).join(named[2], id_col)


def looked_up(wanted: DataFrame, notes: DataFrame, outputs: DataFrame, saved: DataFrame, entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, code, original, redacted, entities, approved) of the notes asked for: 404 without a text that isn't empty."""
    rows = wanted.select(id_col).distinct().join(notes.select(id_col, F.col("text").alias("original")), id_col, "left")
    rows = rows.join(outputs.select(id_col, F.col("text").alias("__out")), id_col, "left").join(saved.select(id_col, F.col("text").alias("__saved")), id_col, "left").join(entities.select(id_col, "entities"), id_col, "left")
    found = F.coalesce(F.length("original"), F.lit(0)) > 0
    return rows.select(id_col, F.when(found, 200).otherwise(404).alias("code"), "original", F.coalesce("__saved", "__out", F.lit("")).alias("redacted"), "entities", F.col("__saved").isNotNull().alias("approved"))


def newest(reports: DataFrame, column: str) -> DataFrame:
    """The run that is shown first."""
    return reports.orderBy(F.desc(column)).limit(1)


def present_in_all(first: DataFrame, *others: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the first that every other frame has: semi joins, smallest frames first for the caller to choose."""
    out = first.select(key).distinct()
    for o in others:
        out = out.join(o.select(key), key, "left_semi")
    return out


def envelope(page: DataFrame, total: int, limit: int, key: str) -> DataFrame:
    """One row: items, total, limit and next_cursor, null on a short page. A page has at most 200 rows."""
    items = page.agg(F.collect_list(F.struct(*page.columns)).alias("items"), F.count("*").alias("n"), F.max(key).alias("last"))
    cursor = F.when(F.col("n") == limit, F.base64(F.to_json(F.struct(F.col("last").alias(key))).cast("binary")))
    return items.select("items", F.lit(total).alias("total"), F.lit(limit).alias("limit"), cursor.alias("next_cursor"))


def decoded_cursor(cursor: Column, schema: str) -> Column:
    """The key in a cursor, null where it can't be read."""
    return F.from_json(F.try_to_binary(cursor, F.lit("base64")).cast("string"), schema)


def segments(spans: DataFrame, length: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, class): the spans and, as `plain`, the gaps between them, before the first and after the last. A span that starts before an earlier one's end is left out."""
    w = W.partitionBy(id_col).orderBy("start", "end")
    seen = spans.select(id_col, "start", "end", "class").withColumn("before", F.coalesce(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kept = seen.filter("start >= before")
    gaps = kept.filter("start > before").select(id_col, F.col("before").alias("start"), F.col("start").alias("end"), F.lit("plain").alias("class"))
    last = spans.groupBy(id_col).agg(F.max("end").alias("start"))
    tail = length.join(last, id_col, "left").select(id_col, F.coalesce("start", F.lit(0)).alias("start"), F.col("length").alias("end"), F.lit("plain").alias("class")).filter("start < `end`")
    return kept.select(id_col, "start", "end", "class").unionByName(gaps).unionByName(tail)


def reports(names: DataFrame, column: str) -> DataFrame:
    """Evaluation reports, newest first, with a readable time; mistake folders and other files aren't reports."""
    return names.filter(F.col(column).rlike(r"^eval_.*\.json$") & ~F.col(column).contains("mistakes")).withColumn("at", evaluation_time(F.col(column))).orderBy(F.desc(column))


def first_per_category(df: DataFrame, group: list[str], order: str, limit: int) -> DataFrame:
    """The first rows of each category in their order; 0 keeps all."""
    if not limit:
        return df
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy(order))).filter(F.col("__n") <= limit).drop("__n")


def edited(before: Column, after: Column) -> Column:
    """Whether two texts differ but for line ends."""
    return F.regexp_replace(before, "\r\n", "\n") != F.regexp_replace(after, "\r\n", "\n")
