"""The online path: notes arrive as files, are detected and redacted in micro-batches, and counters follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats
from ..operators.batches import notes
from ..operators.detect import detect
from ..operators.redact import redact


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now, in micro-batches; a micro-batch that is repeated after a failure gets the same number."""
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def processed(notes: DataFrame, path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A step that redacts notes into one folder for each micro-batch; a repeated micro-batch replaces its own, so nothing counts twice."""

    def step(df: DataFrame, number: int) -> None:
        out = redact(detect(df.dropDuplicates(key))).select(*key, "redacted", "entities", "skipped_by_type")
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def counted(path: str, by: list[Column], aggs: list[Column]) -> Callable[[DataFrame, int], None]:
    """A step that keeps partial counts of its micro-batch; their sums are the counters, however often a step is repeated."""

    def step(df: DataFrame, number: int) -> None:
        df.groupBy(*by).agg(*aggs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def initialised(state: DataFrame, arriving: DataFrame, key: str, at: Column) -> DataFrame:
    """Batch rows after an ingestion: known ones go on processing and keep their counters, new ones start."""
    known = state.join(arriving.select(key).distinct(), key, "left_semi").withColumn("status", F.lit("processing")).withColumn("started_at", at)
    rest = state.join(arriving.select(key).distinct(), key, "left_anti")
    new = arriving.select(key).distinct().join(state, key, "left_anti").withColumn("status", F.lit("processing")).withColumn("started_at", at)
    return known.unionByName(rest).unionByName(new, allowMissingColumns=True)


def inserted(state: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """state and the rows of arriving whose keys it lacks."""
    return state.unionByName(arriving.dropDuplicates(keys).join(state, keys, "left_anti"), allowMissingColumns=True)


def redriven(attempts: DataFrame, key: str, failed: Column, batch: Column | None = None, most: int = 3) -> DataFrame:
    """Keys set aside after `most` failures, to be sent again; of one batch only, where told."""
    rows = attempts if batch is None else attempts.filter(batch)
    return stats.dead_letters(rows, key, failed, most).filter("dead")


def messages(inputs: DataFrame) -> DataFrame:
    """(batch_id, note_id, key, attempts): a message for each input (batch_id, key); what isn't a note has none."""
    from ..functions.text import stem

    return inputs.filter(F.col("key").endswith(".txt")).select("batch_id", stem(F.col("key")).alias("note_id"), "key", F.lit(0).alias("attempts"))


MESSAGE = "batch_id string, note_id string, key string, attempts int"


def sent(messages_: DataFrame, base: str, queue: str = "queue") -> None:
    """Puts messages (batch_id, note_id, key, attempts) into a queue of objects, `{queue}/{batch}/{note}.json`: all of them or none.

    A message that is sent again replaces the one that waits, so a note waits once.
    """
    from ..sources.objects import write_objects

    text = [F.col(c).cast("string") for c in ("batch_id", "note_id")]
    body = F.to_json(F.struct(text[0].alias("batch_id"), text[1].alias("note_id"), "key", F.col("attempts").cast("int").alias("attempts")))
    write_objects(messages_.select(F.concat(F.lit(f"{queue}/"), text[0], F.lit("/"), text[1], F.lit(".json")).alias("name"), body.alias("body")), base, "name", "body")


def waiting(spark: SparkSession, base: str, queue: str = "queue") -> DataFrame:
    """(batch_id, note_id, key, attempts, path) of the messages that wait in a queue."""
    from ..sources.files import contents

    rows = contents(spark, f"{base}/{queue}", ".json")
    return rows.select(F.from_json(F.col("content").cast("string"), MESSAGE).alias("m"), "path").select("m.*", "path")


def redrive(spark: SparkSession, base: str, batch: Column | None = None, queue: str = "queue", dead: str = "dead") -> int:
    """Sends dead letters again, of one batch only where told, and gives how many.

    They go into the queue first, with no attempts, and leave the dead letters only once all are there: what stops between finds each
    of them at least once.
    """
    from ..sources.objects import remove_keys

    letters = waiting(spark, base, dead)
    letters = letters if batch is None else letters.filter(batch)
    letters = letters.withColumn("attempts", F.lit(0)).persist()
    try:
        sent(letters, base, queue)
        return remove_keys(letters.select(F.regexp_replace("path", "^file:/+", "file:///").alias("key")))
    finally:
        letters.unpersist()


def worker(base: str, detector: Callable[[DataFrame], DataFrame], at: Column | None = None, most: int = 3) -> Callable[[DataFrame, int], None]:
    """A step that works on messages with their texts (batch_id, note_id, key, attempts, text), from detection to the note's flag.

    detector adds `entities`, `retries` and `error` (null where it went well). What it found is written once for each micro-batch, so nothing
    below asks it again: redacted notes and occurrences as objects; failed messages back into the queue, or among the dead letters at their
    last attempt; `changes` (batch_id, note_id, kind, at) with the note processed or finally failed; `metrics` (notes, failures,
    retries, entities, skipped by type). A repeated micro-batch writes the same keys and its own folders again, so nothing counts twice.
    """
    from ..operators.batches import FAILED, PROCESSED
    from ..operators.redact import occurrences, positions
    from ..sources.files import outputs
    from ..sources.objects import write_objects

    none = "array<struct<type:string,value:string>>"

    def step(df: DataFrame, number: int) -> None:
        spark, folder = df.sparkSession, f"batch={number}"
        detector(df.dropDuplicates(["batch_id", "note_id"])).write.mode("overwrite").parquet(f"{base}/worked/{folder}")
        found = attempted(spark.read.parquet(f"{base}/worked/{folder}"), F.col("error").isNotNull(), most)
        done = redact(found.filter("outcome = 'done'").withColumn("entities", F.coalesce("entities", F.array().cast(none))))
        done = done.withColumn("occurrences", F.coalesce(occurrences(positions(F.col("text"), F.col("entities"))), F.array().cast(none)))
        write_objects(outputs(done), base)
        sent(found.filter("outcome = 'again'"), base)
        sent(found.filter("outcome = 'dead'"), base, "dead")
        kind = F.when(F.col("outcome") == "done", PROCESSED).otherwise(FAILED)
        now = (F.current_timestamp() if at is None else at).cast("timestamp_ntz")
        flags = found.filter("outcome <> 'again'").select("batch_id", "note_id", kind.alias("kind"), now.alias("at"))
        flags.write.mode("overwrite").parquet(f"{base}/changes/{folder}")
        by_type = done.select(F.explode("skipped_by_type").alias("type", "n")).groupBy("type").agg(F.sum("n").cast("long").alias("n"))
        skips = by_type.agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("skipped"))
        entities = F.sum(F.when(F.col("error").isNull(), F.size("entities"))).alias("entities")
        counts = found.agg(F.count("*").alias("notes"), F.count("error").alias("failures"), F.sum("retries").alias("retries"), entities)
        counts.join(F.broadcast(skips)).write.mode("overwrite").parquet(f"{base}/metrics/{folder}")

    return step


def enqueued(batches: DataFrame, sent: DataFrame) -> DataFrame:
    """(batch_id, file_count, failed_count, outcome) of an ingestion: sent (batch_id, error); a batch without messages is `no_files`."""
    n = sent.groupBy("batch_id").agg(F.count("*").alias("file_count"), F.count("error").alias("failed_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return batches.select("batch_id").distinct().join(n, "batch_id", "left").select("batch_id", zero("file_count"), zero("failed_count"), F.when(F.col("file_count").isNull(), "no_files").otherwise("sent").alias("outcome"))


def attempted(taken: DataFrame, failed: Column, most: int = 3) -> DataFrame:
    """taken messages with one attempt more and `outcome`: `done`, `again` (only these are delivered again) or `dead` at the last attempt."""
    n = F.col("attempts") + 1
    bad = F.coalesce(failed, F.lit(False))
    return taken.withColumn("outcome", F.when(~bad, "done").when(n >= most, "dead").otherwise("again")).withColumn("attempts", n)


def drained(taken: DataFrame, failed: Callable[[Column], Column], most: int = 3) -> DataFrame:
    """Messages at their end, done or dead, after as many deliveries as each needs. failed(attempts): whether that delivery fails."""
    done, left = None, taken
    for _ in range(most):
        out = attempted(left, failed(F.col("attempts") + 1), most)
        end = out.filter("outcome <> 'again'")
        done = end if done is None else done.unionByName(end)
        left = out.filter("outcome = 'again'").drop("outcome")
    return done


def kept(changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Runs a stream of changes (batch_id, note_id, kind, at) into state: one row of batches.notes for each note.

    The state is a streaming aggregation of minima and maxima, so a change that is delivered again, in the same or a later
    micro-batch, changes nothing, and the state grows with notes and not with deliveries. Nothing but the checkpoint is written.
    """
    return notes(changes).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def note_state(spark: SparkSession, checkpoint: str, changes: DataFrame) -> DataFrame:
    """The rows of batches.notes that the last micro-batch of kept() left, read from its state; `changes` gives the schema."""
    rows = spark.read.format("statestore").load(checkpoint)
    now = notes(changes)
    fields = []  # what the aggregation keeps: a value for each minimum and maximum, value and order for the review
    for f in now.schema.fields[2:]:
        fields.append(T.StructField(f.name, f.dataType))
        if f.name == "review":
            fields.append(T.StructField("review_order", T.StructType([T.StructField("at", changes.schema["at"].dataType), T.StructField("kind", T.StringType())])))
    held = rows.select("key.*", F.col("value").cast(T.StructType(fields)).alias("v"))
    return held.select("batch_id", "note_id", *(F.col(f"v.{c}").alias(c) for c in now.columns[2:]))


def progress(run: StreamingQuery) -> dict:
    """What a caller that polls is told: whether the query still works, its last micro-batch, and rows read so far."""
    last = run.lastProgress
    return {"active": run.isActive, "batch": last["batchId"] if last else None, "rows": sum(p["numInputRows"] for p in run.recentProgress), "waiting": run.status["isTriggerActive"]}
