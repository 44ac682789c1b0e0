"""The life of a batch: creation, start, processing, failure, redrive, completion and approval, from a log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import stem
from ..model import SEEDED_TYPES
from .ordered import numbered

#: Where a note's objects lie; `prior` and `legacy` are older places of an approval, removed when it is saved.
KEYS = {
    "input": "{batch}/input/{note}.txt", "redacted": "{batch}/output/{note}_redacted.txt", "entities": "{batch}/output/{note}_entities.json",
    "approval": "{batch}/approvals/{note}_approved.txt", "prior": "{batch}/approvals/{note}.txt", "legacy": "{batch}/approvals/{note}.json",
}
#: Kinds of changes in a batch's log.
STARTED, INGESTED, PROCESSED, FAILED, REDRIVEN, APPROVED, WITHDRAWN = "started", "ingested", "processed", "failed", "redriven", "approved", "withdrawn"


def object_key(kind: str, batch: Column, note: Column) -> Column:
    """The key of a note's object of that kind."""
    before, _, rest = KEYS[kind].partition("{batch}")
    between, _, after = rest.partition("{note}")
    return F.concat(F.lit(before), batch, F.lit(between), note.cast("string"), F.lit(after))


def created(folders: DataFrame, files: DataFrame, at: Column, taken: DataFrame | None = None) -> DataFrame:
    """(folder, batch_id, n_files, status, created_at) of new batches.

    The id is `batch-` and the second of creation; a second one of the same second, in folder order, has `-2` after it, and
    so on, after those that taken (batch_id) holds. Only files directly in the folder count; a batch with some is `ready`.
    """
    base = F.concat(F.lit("batch-"), F.date_format(at, "yyyyMMddHHmmss"))
    own = files.filter(F.lower("path").endswith(".txt")).groupBy("folder").agg(F.count_if(~F.col("path").contains("/")).alias("n_files"))
    rows = folders.select("folder", at.alias("created_at"), base.alias("base")).join(own, "folder", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    if taken is not None:
        known = taken.groupBy(F.regexp_extract("batch_id", r"^(batch-\d{14})", 1).alias("base")).agg(F.count("*").alias("known"))
        rows = rows.join(known, "base", "left")
    else:
        rows = rows.withColumn("known", F.lit(0))
    rows = numbered(rows, ["base"], ["folder"]).withColumn("n", F.col("n") + F.coalesce("known", F.lit(0)))
    return rows.select(
        "folder", F.when(F.col("n") > 1, F.concat("base", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("base")).alias("batch_id"), "n_files",
        F.when(F.col("n_files") > 0, "ready").otherwise("created").alias("status"), "created_at",
    )


def seeded(batches: DataFrame, at: Column, key: str = "batch_id") -> DataFrame:
    """The row a batch starts with: every counter 0, processing, one time for all three timestamps."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("processed_count", "total_entities", "approved_note_count", *(f"pii_{t}" for t in SEEDED_TYPES))]
    return batches.select(key, F.lit("processing").alias("status"), *zero, *(at.alias(c) for c in ("created_at", "started_at", "updated_at")))


def started(requests: DataFrame, inputs: DataFrame, key: str = "batch_id") -> DataFrame:
    """(batch, input_count, code, status): 202 and processing for a batch with inputs, 400 and no status for one without."""
    n = inputs.groupBy(key).agg(F.count("*").alias("input_count"))
    out = requests.select(key).distinct().join(n, key, "left").withColumn("input_count", F.coalesce("input_count", F.lit(0)))
    some = F.col("input_count") > 0
    return out.withColumns({"code": F.when(some, 202).otherwise(400), "status": F.when(some, "processing")})


def notes(changes: DataFrame) -> DataFrame:
    """One row for each (batch_id, note_id): when it was ingested, first processed and first failed, and its last approval.

    Each is a minimum or a maximum, so a change that is delivered again, in whatever micro-batch, changes nothing.
    """
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    review = F.col("kind").isin(APPROVED, WITHDRAWN)
    return changes.groupBy("batch_id", "note_id").agg(
        first(INGESTED).alias("ingested_at"), first(PROCESSED).alias("processed_at"), first(FAILED).alias("failed_at"),
        F.max(F.when(F.col("kind") == FAILED, F.col("at"))).alias("last_failed_at"),
        F.max_by(F.when(review, F.col("kind")), F.when(review, F.struct("at", "kind"))).alias("review"), F.max(F.when(review, F.col("at"))).alias("reviewed_at"),
        F.min(F.when(F.col("kind") == STARTED, F.col("at"))).alias("started_at"), F.max(F.when(F.col("kind").isin(STARTED, REDRIVEN), F.col("at"))).alias("sent_at"), F.max("at").alias("updated_at"),
    )


def transitions(changes: DataFrame) -> DataFrame:
    """A batch's counters, status and timestamps from its changes (batch_id, note_id, kind, at); two grouped passes, both combined early.

    input_count and processed_count count notes, however often they were delivered. completed_at is when the last
    missing note was first processed; failed_at the first final failure; approved_at the last approval of a batch all of
    whose notes are approved. Status: completed once all notes are processed; else partially-completed where the last failure came
    after the last start or redrive; else processing once started; before, ready with inputs and created without.
    """
    return folded(notes(changes))


def folded(state: DataFrame) -> DataFrame:
    """transitions() of the rows of notes(), worked out now or kept as the state of a stream."""
    approved = F.col("review") == APPROVED
    rows = state.groupBy("batch_id").agg(
        F.count("ingested_at").alias("input_count"), F.count_if(F.col("ingested_at").isNotNull() & F.col("processed_at").isNotNull()).alias("processed_count"),
        F.count_if(F.col("ingested_at").isNotNull() & F.coalesce(approved, F.lit(False))).alias("approved_note_count"), F.min("started_at").alias("started_at"),
        F.max(F.when(F.col("ingested_at").isNotNull(), F.greatest("processed_at", "ingested_at"))).alias("__done"), F.min("failed_at").alias("failed_at"), F.max("last_failed_at").alias("__failed"),
        F.max("sent_at").alias("__sent"), F.max(F.when(approved, F.col("reviewed_at"))).alias("__approved"), F.max("updated_at").alias("updated_at"),
    )
    done = (F.col("input_count") > 0) & (F.col("processed_count") >= F.col("input_count"))
    failed = F.col("__failed").isNotNull() & (F.col("__sent").isNull() | (F.col("__failed") > F.col("__sent")))
    status = F.when(done, "completed").when(failed, "partially-completed").when(F.col("__sent").isNotNull(), "processing").when(F.col("input_count") > 0, "ready").otherwise("created")
    all_approved = done & (F.col("approved_note_count") >= F.col("input_count"))
    return rows.select(
        "batch_id", "input_count", "processed_count", "approved_note_count", status.alias("status"), all_approved.alias("all_approved"), "started_at",
        F.when(done, F.col("__done")).alias("completed_at"), "failed_at", F.when(all_approved, F.col("__approved")).alias("approved_at"), "updated_at",
    )


def redriven(state: DataFrame, dead: DataFrame, outputs: DataFrame, at: Column) -> DataFrame:
    """state after a redrive of every batch: (batch_id, redriven_count, status, completed_at).

    Dead letters (batch_id, note_id) of the batch are sent again and it is processing; with none left, a batch that has
    an output for each input is completed, keeping an earlier completed_at; any other is partially completed.
    """
    n = dead.groupBy("batch_id").agg(F.count("*").alias("redriven_count"))
    made = outputs.groupBy("batch_id").agg(F.countDistinct("note_id").alias("__made"))
    rows = state.select("batch_id", "input_count", "completed_at").join(n, "batch_id", "left").join(made, "batch_id", "left")
    none, whole = F.col("redriven_count").isNull(), F.coalesce("__made", F.lit(0)) >= F.col("input_count")
    return rows.select(
        "batch_id", F.coalesce("redriven_count", F.lit(0)).alias("redriven_count"),
        F.when(~none, "processing").when(whole, "completed").otherwise("partially-completed").alias("status"),
        F.when(none & whole, F.coalesce("completed_at", at)).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def resolved(provided: Column, saved: Column, output: Column) -> Column:
    """The redacted text that is shown: what was sent, else what was approved, else the output, else nothing."""
    return F.coalesce(provided, saved, output, F.lit(""))


def required(inputs: DataFrame, path: str = "path") -> DataFrame:
    """(batch_id, note_id): the notes an approval needs, by the stems of the inputs, each once."""
    return inputs.select("batch_id", stem(F.col(path)).alias("note_id")).distinct()


def approve(requests: DataFrame, wanted: DataFrame, state: DataFrame) -> DataFrame:
    """(batch_id, note_id, approved, code, delta) for requests (batch_id, note_id, approved): 404 for a note that isn't wanted.

    delta is what the batch's approval counter moves by: 1 for a new approval, -1 for one that is withdrawn, else 0.
    """
    known = wanted.select("batch_id", "note_id", F.lit(True).alias("__wanted"))
    rows = requests.join(known, ["batch_id", "note_id"], "left").join(state.select("batch_id", "note_id", F.col("approved").alias("__was")), ["batch_id", "note_id"], "left")
    found, was = F.col("__wanted").isNotNull(), F.coalesce("__was", F.lit(False))
    delta = F.when(~found, 0).when(F.col("approved") & ~was, 1).when(~F.col("approved") & was, -1).otherwise(0)
    return rows.select("batch_id", "note_id", "approved", F.when(found, 200).otherwise(404).alias("code"), delta.alias("delta"))


def approve_all(wanted: DataFrame, saved: DataFrame, outputs: DataFrame) -> DataFrame:
    """(batch_id, note_id, text, key, removed): every wanted note's approved text, where it goes and the older keys that go."""
    keys = ["batch_id", "note_id"]
    rows = wanted.join(saved.select(*keys, F.col("text").alias("__saved")), keys, "left").join(outputs.select(*keys, F.col("text").alias("__out")), keys, "left")
    place = lambda kind: object_key(kind, F.col("batch_id"), F.col("note_id"))
    return rows.select(*keys, resolved(F.lit(None).cast("string"), F.col("__saved"), F.col("__out")).alias("text"), place("approval").alias("key"), F.array(place("prior"), place("legacy")).alias("removed"))


def approved_batches(wanted: DataFrame, counters: DataFrame) -> DataFrame:
    """(batch_id, required_note_count, approved_note_count, delta, all_approved) after approving all notes of batches with inputs."""
    rows = wanted.groupBy("batch_id").agg(F.count("*").alias("required_note_count")).join(counters.select("batch_id", F.col("approved_note_count").alias("__was")), "batch_id", "left")
    n = F.col("required_note_count")
    return rows.select("batch_id", n, n.alias("approved_note_count"), (n - F.coalesce("__was", F.lit(0))).alias("delta"), F.lit(True).alias("all_approved"))


def note_rows(records: DataFrame, prefix: str = "NOTE#") -> DataFrame:
    """(batch_id, note_id, has_output, approved) of a batch's note records in key order; an id that is missing is the key without its prefix."""
    rows = records.filter(F.col("record_type").startswith(prefix))
    note = F.coalesce("note_id", F.substring("record_type", len(prefix) + 1, 1 << 20))
    return rows.select("batch_id", note.alias("note_id"), F.coalesce("has_output", F.lit(False)).alias("has_output"), F.coalesce("approved", F.lit(False)).alias("approved")).orderBy("batch_id", "note_id")


def listed(state: DataFrame) -> DataFrame:
    """Batches as a list shows them: `created` where there is no status, all_approved only once completed with every input approved."""
    status, n = F.coalesce("status", F.lit("created")), F.col("input_count")
    whole = (status == "completed") & (F.coalesce("approved_note_count", F.lit(0)) >= n) & (n > 0)
    return state.withColumns({"status": status, "all_approved": F.coalesce(whole, F.lit(False))})


def bounds(limit: Column, offset: Column, default: int = 50, most: int = 200) -> Column:
    """struct<limit, offset>: 1 to `most` and 0 or more; if either can't be read both are reset."""
    n = F.coalesce(F.when(limit.isNull(), default).otherwise(limit.try_cast("int")), F.lit(None))
    k = F.coalesce(F.when(offset.isNull(), 0).otherwise(offset.try_cast("int")), F.lit(None))
    bad = n.isNull() | k.isNull()
    return F.struct(F.when(bad, default).otherwise(F.greatest(F.lit(1), F.least(n, F.lit(most)))).alias("limit"), F.when(bad, 0).otherwise(F.greatest(k, F.lit(0))).alias("offset"))


def page(df: DataFrame, order: list[str], limit: int, offset: int) -> tuple[DataFrame, int]:
    """(a slice, the total) of a small list in order. For long tables see stats.page, which goes by key."""
    return df.orderBy(*order).offset(offset).limit(limit), df.count()


def sort_time(value: Column) -> Column:
    """An ISO time for sorting; what is empty or can't be read comes before all others."""
    text = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(text), F.lit("0001-01-01 00:00:00").cast("timestamp"))
