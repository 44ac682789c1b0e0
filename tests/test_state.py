"""Batch counters as the state of a stream."""

import random

from pyspark.sql import functions as F

from cloakwork.operators import batches as B
from cloakwork.streaming import ingest


def test_state_after_three_micro_batches_with_redeliveries(spark, tmp_path):
    """Every micro-batch delivers some changes again; the state holds a row a note, and its counters are those of the log."""
    rng = random.Random(2)
    kinds = [B.STARTED, B.INGESTED, B.PROCESSED, B.FAILED, B.REDRIVEN, B.APPROVED, B.WITHDRAWN]
    log = [(f"b{rng.randrange(4)}", rng.randrange(30), rng.choice(kinds), f"2024-01-01 00:{rng.randrange(60):02d}:{rng.randrange(60):02d}") for _ in range(400)]
    df = lambda rows: spark.createDataFrame(rows, "batch_id string, note_id long, kind string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    parts = [log[:150], log[100:300] + log[:20], log[250:] + log[250:]]
    for k, part in enumerate(parts):
        df(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df(log).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = ingest.kept(stream, f"{tmp_path}/c")
    run.awaitTermination()
    assert [p["numInputRows"] for p in run.recentProgress if p["numInputRows"]] and ingest.progress(run)["rows"] == sum(map(len, parts)) and not ingest.progress(run)["active"]
    state = ingest.note_state(spark, f"{tmp_path}/c", df(log))
    assert state.count() == len({r[:2] for r in log})
    key = lambda rows: sorted(map(str, rows))
    assert key(state.collect()) == key(B.notes(df(log)).select(state.columns).collect())
    assert key(B.folded(state).collect()) == key(B.transitions(df(log)).collect())
    again = ingest.kept(stream, f"{tmp_path}/c")  # nothing new: the state stays
    again.awaitTermination()
    assert ingest.note_state(spark, f"{tmp_path}/c", df(log)).count() == len({r[:2] for r in log})
