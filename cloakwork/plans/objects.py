"""Queries that write notes, responses, outputs and templates as objects and read them back, and the queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import batches as B, detect as D, evaluate as E, redact as R, synth as Y, telemetry as M
from ..sources import files as FS
from ..sources.files import table
from ..sources.folders import shared_dir
from ..streaming import ingest
from .catalogue import ORACLES, _docs, _entities_sql, _overlap_sql, _redact_sql, _sides, _spans, _spans_sql, query
from .state import _NOTES, _log


def _folder(spark) -> str:
    base = f"{shared_dir(spark)}/objects-{uuid.uuid4().hex}"
    return base if "://" in base else "file://" + base


_COUNT = f"SELECT doc_id, count(*) AS n FROM {_entities_sql()} WHERE type <> 'phone_number' GROUP BY doc_id"


@query(f"WITH r AS ({_redact_sql()}), o AS (SELECT * FROM ({_COUNT})) SELECT doc_id::VARCHAR AS note_id, source AS batch_id, CASE WHEN text IS NULL THEN md5('') ELSE redacted_md5 END AS redacted_md5, coalesce(n, 0) > 0 AS has_entities FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN o USING (doc_id)")
def output_files(spark, d):
    base = _folder(spark)
    notes = R.redact(D.detect(_docs(spark, d, "source")))
    notes = notes.withColumn("occurrences", F.coalesce(R.occurrences(R.positions(F.col("text"), F.col("entities"))), F.array().cast("array<struct<type:string,value:string>>")))
    FS.write_objects(FS.outputs(notes, "source", "doc_id"), base)
    name = lambda tail: F.regexp_extract("path", rf"([^/]+)/output/([^/]*){tail}$", 2).alias("note_id")
    texts = FS.contents(spark, base, "_redacted.txt").select(name("_redacted.txt"), F.regexp_extract("path", "([^/]+)/output/", 1).alias("batch_id"), F.md5(FS.decoded(F.col("content"))).alias("redacted_md5"))
    found = FS.contents(spark, base, "_entities.json").select(name("_entities.json"), F.from_json(F.col("content").cast("string"), "array<struct<type:string,value:string>>").alias("e"))
    return texts.join(found.select("note_id", (F.size("e") > 0).alias("has_entities")), "note_id")


_WORDED = {c: p for c, p in D.PATTERNS.items() if c != "phn"}


@query(f"""WITH e AS (SELECT doc_id, count(*) AS n FROM {_entities_sql()} GROUP BY doc_id), r AS ({_redact_sql()}), p AS (SELECT doc_id, count(*) AS n_positions, sum(start)::BIGINT AS starts FROM {_spans_sql(_WORDED)} GROUP BY doc_id)
SELECT 'n' || doc_id AS note_id, coalesce(e.n, 0) AS n_entities, CASE WHEN doc_id % 3 = 0 THEN 'skipped' WHEN doc_id % 3 = 1 AND doc_id % 2 = 1 THEN 'missing' ELSE 'ok' END AS outcome,
CASE WHEN text IS NULL THEN md5('') ELSE redacted_md5 END AS redacted_md5, coalesce(n_positions, 0) AS n_positions, coalesce(starts, 0) AS starts FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN p USING (doc_id)""")
def response_files(spark, d):
    """Responses written and read back, with sources relative, absolute, absent or none; then what their redaction writes, read back too."""
    base = _folder(spark)
    k = F.col("doc_id")
    source = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.concat(F.lit("in/"), k.cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("/abs/"), k.cast("string"), F.lit(".txt")))
    docs = _docs(spark, d).withColumns({"text": F.coalesce("text", F.lit("")), "stem": F.concat(F.lit("n"), k.cast("string"))})
    below = lambda stem: F.concat(F.pmod(F.xxhash64(stem), F.lit(64)).cast("string"), F.lit("/"), stem)  # noqa: E731  each folder is listed by a task
    asked = D.detect(docs).withColumns({"src": source, "at": below(F.col("stem"))})
    FS.write_objects(FS.response_files(asked, "at", "src"), f"{base}/responses")
    there = _docs(spark, d).select(F.when(k % 3 == 2, F.concat(F.lit("/abs/"), k.cast("string"), F.lit(".txt"))).when(k % 2 == 0, F.concat(F.lit("/work/in/"), k.cast("string"), F.lit(".txt"))).alias("path")).filter("path IS NOT NULL")
    rows = FS.responses(spark, f"{base}/responses", deep=True).select("note_id", "source", F.col("response.pii_entities").alias("found"))
    rows = FS.sources_resolved(rows, there, "/work").select("note_id", "outcome", F.coalesce("found", F.array().cast(D.ENTITIES)).alias("entities"))
    texts = rows.join(docs.select(F.col("stem").alias("note_id"), "text"), "note_id")
    done = R.redact(texts).withColumns({"positions": R.positions(F.col("text"), F.col("entities")), "stem": F.concat(below(F.col("note_id")), F.lit("_response"))})
    FS.write_objects(FS.redaction_files(done, "stem"), f"{base}/redacted")
    named = lambda tail: F.regexp_extract("path", f"([^/]*){tail}$", 1).alias("note_id")
    written = FS.contents(spark, f"{base}/redacted", "_redacted.txt").select(named("_redacted.txt"), F.md5(FS.decoded(F.col("content"))).alias("redacted_md5"))
    places = FS.positions(spark, f"{base}/redacted", deep=True).groupBy("note_id").agg(F.count("*").alias("n_positions"), F.sum("start").alias("starts"))
    out = rows.select("note_id", F.size("entities").cast("long").alias("n_entities"), "outcome").join(written, "note_id").join(places, "note_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_positions", "starts")})


@query("SELECT 'NATION_' || n_nationkey AS template, md5('Dear {{NAME}} of ' || n_name) AS text_md5, CASE WHEN n_nationkey % 2 = 0 THEN 'letter' ELSE 'unknown' END AS note_type FROM nation")
def template_files(spark, d):
    base = _folder(spark)
    rows = table(spark, d, "nation").withColumn("text", F.concat(F.lit("Dear {{NAME}} of "), "n_name"))
    made = Y.manifest(rows, "n_name", F.lit("letter"), F.lit("2024-01-01"), template=True)
    objects = FS.note_files(made, "n_name", template=True).filter("key LIKE '%/notes/%' OR key RLIKE '[02468].json$'")
    FS.write_objects(objects, base)
    out = FS.templates(spark, f"{base}/templates")
    return out.select("template", F.md5("text").alias("text_md5"), "note_type")


@query("SELECT 'b' || c_nationkey AS batch_id, count(*) AS n, sum(length('text ' || c_custkey))::BIGINT AS size, count(DISTINCT md5('text ' || c_custkey)) AS digests FROM customer WHERE c_custkey % 3 <> 1 AND NOT (c_custkey % 3 = 2 AND c_custkey % 7 = 0) GROUP BY 1")
def object_listing(spark, d):
    """Objects of three kinds written; some are deleted; those listed then fit a pattern and not the excluded names."""
    base = _folder(spark)
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "a").when(k % 3 == 1, "skip").otherwise("c")
    customers = FS.spread(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    rows = customers.select(F.concat(F.lit("b"), F.col("c_nationkey").cast("string"), F.lit("/input/"), name, k.cast("string"), F.lit(".txt")).alias("key"), F.concat(F.lit("text "), k.cast("string")).alias("content"))
    FS.write_objects(rows, base)
    gone = FS.matched(FS.listing(spark, base, ".txt"), "*/input/c*.txt").filter("CAST(regexp_extract(key, '([0-9]+).txt$', 1) AS long) % 7 = 0")
    first = gone.select("key").repartition("key").checkpoint()  # the names stay when the objects are gone
    assert FS.remove_keys(first) <= first.count() and FS.remove_keys(first) == 0  # fewer where a task was repeated
    assert FS.exists(spark, base) and not FS.exists(spark, f"{base}/nowhere")
    out = FS.listing(spark, base, ".txt", digests=True, pattern="*/input/*[0-9].txt", exclude="skip*")
    return out.groupBy(F.regexp_extract("key", "([^/]+)/input/", 1).alias("batch_id")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count_distinct("etag").alias("digests"))


@query("SELECT page_id, regexp_matches(url, '^[a-z0-9]+://') AS is_object, split_part(split_part(url, '://', 2), '/', 1) AS bucket, substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 2) AS key FROM pages WHERE url LIKE '%://_%'")
def object_paths(spark, d):
    out = table(spark, d, "pages").filter("url LIKE '%://_%'").select("page_id", FS.bucket_and_key(F.col("url")).alias("p"))
    return out.select("page_id", "p.is_object", "p.bucket", "p.key")


@query("SELECT n_name AS batch_id, count(c_custkey) AS file_count, count(c_custkey) FILTER (c_custkey % 10 = 2) AS failed_count, CASE WHEN count(c_custkey) = 0 THEN 'no_files' ELSE 'sent' END AS outcome FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 50 = 2 OR c_custkey % 50 = 33) ON c_nationkey = n_nationkey GROUP BY n_name")
def ingestion(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("batch_id"))
    c = table(spark, d, "customer").filter("c_custkey % 50 IN (2, 33)").join(nation, F.expr("c_nationkey = n_nationkey"))
    key = lambda tail: F.concat(F.lit("x/input/"), F.col("c_custkey").cast("string"), F.lit(tail))
    inputs = c.select("batch_id", F.explode(F.array(key(".txt"), key(".bak"))).alias("key"))
    sent = ingest.messages(inputs).withColumn("error", F.when(F.col("note_id").cast("long") % 10 == 2, "refused"))
    return ingest.enqueued(nation, sent)


@query("SELECT event_id, CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS attempts, CASE WHEN user_id % 5 < 3 THEN 'done' ELSE 'dead' END AS outcome FROM events")
def delivery(spark, d):
    """Messages that fail as often as their user says: at most three deliveries, and only failed ones again."""
    taken = table(spark, d, "events").select("event_id", "user_id", F.lit(0).alias("attempts"))
    out = ingest.drained(taken, lambda n: F.least(F.col("user_id") % 5, F.lit(3)) >= n)
    return out.select("event_id", "attempts", "outcome")


@query("""WITH d AS (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3)
SELECT (user_id % 10)::VARCHAR AS batch_id, user_id::VARCHAR AS note_id, CASE WHEN user_id % 10 < 5 THEN 'queue' ELSE 'dead' END AS place, CASE WHEN user_id % 10 < 5 THEN 0 ELSE 3 END::INT AS attempts FROM d""")
def redrive_sent(spark, d):
    """Dead letters written as objects; those of half of the batches sent again; what then waits in the queue, and what is still dead."""
    base = _folder(spark)
    dead = ingest.redriven(table(spark, d, "events").select("user_id", "event_type"), "user_id", F.col("event_type") == "error")
    letters = dead.select((F.col("user_id") % 10).alias("batch_id"), F.col("user_id").alias("note_id"), F.concat(F.lit("in/"), "user_id").alias("key"), F.lit(3).alias("attempts"))
    ingest.sent(letters, base, "dead")
    ingest.redrive(spark, base, F.col("batch_id").cast("int") < 5)
    rows = [ingest.waiting(spark, base, q).select("batch_id", "note_id", F.lit(q).alias("place"), "attempts") for q in ("queue", "dead")]
    return rows[0].unionByName(rows[1])


@query(f"WITH {_NOTES} SELECT batch_id, ic AS input_count, pc AS processed_count, ac AS approved_note_count FROM s")
def stream_transitions(spark, d):
    """The changes as a stream of files that hold every change twice, in micro-batches; the counters come from the stream's state, a row a note."""
    base = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    log = _log(spark, d)
    log.unionByName(log).repartition(4).write.parquet(f"{base}/in")
    ingest.kept(ingest.stream(spark, f"{base}/in", log.schema, 1), f"{base}/checkpoint").awaitTermination()
    state = ingest.note_state(spark, f"{base}/checkpoint", log)
    return B.folded(state).select("batch_id", "input_count", "processed_count", "approved_note_count")


@query("SELECT event_type, count(*) AS n, max(value) AS most FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY event_type")
def records_sql(spark, d):
    rows = M.in_range(_spans(spark, d, "value"), "ts", "2024-01-05 00:00:00", None)
    return FS.records(spark, rows, "SELECT event_type, count(*) AS n, max(value) AS most FROM {records} GROUP BY event_type")


@query(f"""WITH a AS ({_overlap_sql("")}), b AS ({_overlap_sql("type", " AND a.type = b.type")}), m AS ({ORACLES["mistakes"]})
SELECT 'all' AS name, tp, fp, fn, round(f1, 9) AS f1 FROM a UNION ALL SELECT type, tp, fp, fn, round(f1, 9) FROM b
UNION ALL SELECT doc_id::VARCHAR, NULL, count(*) FILTER (kind = 'fp'), count(*) FILTER (kind = 'fn'), NULL FROM m GROUP BY doc_id""")
def evaluation_files(spark, d):
    """An evaluation's files written as objects and read back: the aggregate, the types, and each document's mistakes counted in its own file."""
    base = _folder(spark)
    FS.write_objects(E.evaluation_files(*_sides(spark, d), {"evaluation_mode": "entity_based"}, "eval"), base)
    figures = "struct<precision:double,recall:double,f1:double,true_positives:long,false_positives:long,false_negatives:long>"
    kind = f"struct<settings:map<string,string>,aggregate:{figures},by_type:map<string,{figures}>>"
    report = FS.contents(spark, base, "/eval.json").select(F.from_json(F.col("content").cast("string"), kind).alias("r")).filter("r.settings['evaluation_mode'] = 'entity_based'")
    rows = report.select(F.explode(F.map_concat(F.create_map(F.lit("all"), F.col("r.aggregate")), F.col("r.by_type"))).alias("name", "f"))
    rows = rows.select("name", F.col("f.true_positives").alias("tp"), F.col("f.false_positives").alias("fp"), F.col("f.false_negatives").alias("fn"), F.round("f.f1", 9).alias("f1"))
    entry = "array<struct<start:int,end:int,value:string,type:string>>"
    one = F.from_json(F.col("content").cast("string"), f"struct<doc_id:string,false_negatives:{entry},false_positives:{entry}>").alias("m")
    docs = FS.contents(spark, f"{base}/eval_mistakes", ".json").select(one)
    size = lambda c: F.size(f"m.{c}").cast("long")
    none = F.lit(None)
    return rows.unionByName(docs.select(F.col("m.doc_id").alias("name"), none.cast("long").alias("tp"), size("false_positives").alias("fp"), size("false_negatives").alias("fn"), none.cast("double").alias("f1")))


@query(f"""WITH e AS (SELECT doc_id, count(*) AS n FROM {_entities_sql()} GROUP BY doc_id), s AS (SELECT doc_id, count(*) AS n FROM {_entities_sql()} WHERE type = 'phone_number' GROUP BY doc_id)
SELECT source AS batch_id, count(*) FILTER (doc_id % 7 <> 3) AS processed, count(*) FILTER (doc_id % 7 = 3 AND doc_id % 3 = 2) AS failed, count(*) FILTER (doc_id % 7 <> 3) AS written, count(*) FILTER (doc_id % 7 = 3 AND doc_id % 3 < 2) AS again,
count(*) FILTER (doc_id % 7 = 3 AND doc_id % 3 = 2) AS dead, any_value(m.entities) AS all_entities, any_value(m.skipped) AS all_skipped
FROM documents, (SELECT (SELECT sum(n) FROM e WHERE doc_id % 7 <> 3)::BIGINT AS entities, (SELECT sum(n) FROM s WHERE doc_id % 7 <> 3)::BIGINT AS skipped) m GROUP BY source""")
def worker_records(spark, d):
    """All documents as messages of a stream, worked on in micro-batches; every seventh fails, and so often that a third of those are dead."""
    base = _folder(spark)
    k = F.col("doc_id")
    texts = table(spark, d, "documents").select(F.col("source").alias("batch_id"), k.cast("string").alias("note_id"), F.concat(F.lit("in/"), k.cast("string")).alias("key"), (k % 3).cast("int").alias("attempts"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(3, -(-texts.count() // FS.SPREAD_ROWS))  # files of a bounded size; a third of them is a micro-batch
    texts.repartition(n).write.parquet(f"{base}/in")

    def detector(df):
        bad = F.col("note_id").cast("long") % 7 == 3
        return D.detect(df).withColumns({"retries": F.lit(1), "error": F.when(bad, "refused")})

    step = ingest.worker(base, detector, F.lit("2024-01-05 09:30:07").cast("timestamp"))
    ingest.run(ingest.stream(spark, f"{base}/in", texts.schema, -(-n // 3)), step, f"{base}/checkpoint").awaitTermination()
    flags = spark.read.parquet(f"{base}/changes").groupBy("batch_id").agg(F.count_if(F.col("kind") == B.PROCESSED).alias("processed"), F.count_if(F.col("kind") == B.FAILED).alias("failed"))
    wrote = FS.listing(spark, base, "_redacted.txt").groupBy(F.regexp_extract("key", "([^/]+)/output/", 1).alias("batch_id")).agg(F.count("*").alias("written"))
    held = lambda q, c: ingest.waiting(spark, base, q).groupBy("batch_id").agg(F.count("*").alias(c))
    whole = spark.read.parquet(f"{base}/metrics").agg(F.sum("entities").alias("all_entities"), F.sum(F.coalesce(F.element_at("skipped", F.lit("phone_number")), F.lit(0))).alias("all_skipped"))
    out = flags.join(wrote, "batch_id", "left").join(held("queue", "again"), "batch_id", "left").join(held("dead", "dead"), "batch_id", "left").join(F.broadcast(whole))
    return out.select("batch_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("processed", "failed", "written", "again", "dead")), "all_entities", "all_skipped")
