"""Queries of the batch life cycle. A batch is a user of events or a source of documents; see catalogue for the other analogies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as B
from ..sources.files import table
from .catalogue import query

#: What an event stands for in a batch's log, and its note.
KINDS = {"signup": B.STARTED, "view": B.INGESTED, "click": B.PROCESSED, "error": B.FAILED, "purchase": B.APPROVED}
_LOG = "log AS (SELECT user_id AS batch_id, event_id % 7 AS note_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END AS kind, ts AS t FROM events)"


def _log(spark, d):
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in KINDS.items()))
    return table(spark, d, "events").select(F.col("user_id").alias("batch_id"), (F.col("event_id") % 7).alias("note_id"), kind.alias("kind"), F.col("ts").cast("timestamp_ntz").alias("at"))


_NOTES = f"""{_LOG}, i AS (SELECT batch_id, note_id, min(t) AS i FROM log WHERE kind = 'ingested' GROUP BY ALL),
p AS (SELECT batch_id, note_id, min(t) AS p FROM log WHERE kind = 'processed' GROUP BY ALL), a AS (SELECT batch_id, note_id, max(t) AS a FROM log WHERE kind = 'approved' GROUP BY ALL),
n AS (SELECT batch_id, count(*) AS input_count, count(p) AS processed_count, count(a) AS approved_note_count, max(greatest(i, p)) AS done FROM i LEFT JOIN p USING (batch_id, note_id) LEFT JOIN a USING (batch_id, note_id) GROUP BY batch_id),
b AS (SELECT batch_id, min(t) FILTER (kind = 'started') AS started_at, max(t) FILTER (kind = 'started') AS sent, min(t) FILTER (kind = 'failed') AS failed_at, max(t) FILTER (kind = 'failed') AS failed,
  max(t) FILTER (kind = 'approved') AS approved, max(t) AS updated_at FROM log GROUP BY batch_id),
s AS (SELECT *, coalesce(input_count, 0) AS ic, coalesce(processed_count, 0) AS pc, coalesce(approved_note_count, 0) AS ac FROM b LEFT JOIN n USING (batch_id))"""


@query(f"""WITH {_NOTES} SELECT batch_id, ic AS input_count, pc AS processed_count, ac AS approved_note_count,
CASE WHEN ic > 0 AND pc >= ic THEN 'completed' WHEN failed IS NOT NULL AND (sent IS NULL OR failed > sent) THEN 'partially-completed' WHEN sent IS NOT NULL THEN 'processing' WHEN ic > 0 THEN 'ready' ELSE 'created' END AS status,
ic > 0 AND pc >= ic AND ac >= ic AS all_approved, started_at, CASE WHEN ic > 0 AND pc >= ic THEN done END AS completed_at, failed_at, CASE WHEN ic > 0 AND pc >= ic AND ac >= ic THEN approved END AS approved_at, updated_at FROM s""")
def batch_transitions(spark, d):
    return B.transitions(_log(spark, d))


@query(f"WITH {_NOTES} SELECT batch_id, ic AS input_count, pc AS processed_count, ac AS approved_note_count FROM s")
def redelivery(spark, d):
    """Every change delivered twice, and a third time later: the counters stay."""
    log = _log(spark, d)
    again = log.unionByName(log).unionByName(log.withColumn("at", F.col("at") + F.expr("INTERVAL '1' DAY")))
    return B.transitions(again).select("batch_id", "input_count", "processed_count", "approved_note_count")


@query("""WITH c AS (SELECT source AS batch_id, count(*) AS input_count, count(l.doc_id) AS made, CASE WHEN source < 'src2' THEN TIMESTAMP '2024-01-01' END AS completed_at FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source),
x AS (SELECT source AS batch_id, count(*) AS dead FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source)
SELECT batch_id, coalesce(dead, 0) AS redriven_count, CASE WHEN dead > 0 THEN 'processing' WHEN made >= input_count THEN 'completed' ELSE 'partially-completed' END AS status,
CASE WHEN dead IS NULL AND made >= input_count THEN coalesce(completed_at, TIMESTAMP '2024-02-02') ELSE completed_at END AS completed_at FROM c LEFT JOIN x USING (batch_id)""")
def redrive_edge(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("batch_id"), F.col("doc_id").alias("note_id"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("note_id"), "toxic")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    state = docs.groupBy("batch_id").agg(F.count("*").alias("input_count")).withColumn("completed_at", F.when(F.col("batch_id") < "src2", at("2024-01-01")))
    made = docs.join(labels, "note_id")
    return B.redriven(state, made.filter("toxic = 1"), made, at("2024-02-02"))


@query("""WITH c AS (SELECT c_mktsegment AS folder, 'batch-20240105093007' AS base, count(*) FILTER (c_custkey % 3 > 0) AS n_files, row_number() OVER (ORDER BY c_mktsegment) + 1 AS n FROM customer WHERE c_mktsegment > 'B' GROUP BY c_mktsegment)
SELECT folder, base || '-' || n AS batch_id, n_files, 'ready' AS status FROM c UNION ALL SELECT 'empty', base || '-' || (max(n) + 1), 0, 'created' FROM c GROUP BY base""")
def batch_creation(spark, d):
    rows = table(spark, d, "customer").filter("c_mktsegment > 'B'").select(F.col("c_mktsegment").alias("folder"), "c_custkey")
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "more/").otherwise(""), F.col("c_custkey").cast("string"), F.lit(".txt"))
    folders = rows.select("folder").distinct().union(spark.range(1).select(F.lit("empty")))
    taken = spark.range(1).select(F.lit("batch-20240105093007").alias("batch_id"))
    return B.created(folders, rows.select("folder", name.alias("path")), F.lit("2024-01-05 09:30:07").cast("timestamp"), taken).drop("created_at")


@query("SELECT DISTINCT source AS batch_id, 'processing' AS status, 0::BIGINT AS processed_count, 0::BIGINT AS pii_ssn, 0::BIGINT AS pii_unknown, true AS equal_times FROM documents")
def batch_seed(spark, d):
    out = B.seeded(table(spark, d, "documents").select(F.col("source").alias("batch_id")).distinct(), F.lit("2024-01-01").cast("timestamp"))
    same = (F.col("created_at") == F.col("started_at")) & (F.col("started_at") == F.col("updated_at"))
    return out.select("batch_id", "status", "processed_count", "pii_ssn", "pii_unknown", same.alias("equal_times"))


@query("SELECT n_name AS batch_id, count(c_custkey) AS input_count, CASE WHEN count(c_custkey) > 0 THEN 202 ELSE 400 END AS code, CASE WHEN count(c_custkey) > 0 THEN 'processing' END AS status FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 50 = 1) ON c_nationkey = n_nationkey GROUP BY n_name")
def batch_start(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("batch_id"))
    inputs = table(spark, d, "customer").filter("c_custkey % 50 = 1").select(F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey")
    return B.started(nation, inputs)


_WANTED = "SELECT source AS batch_id, doc_id::VARCHAR AS note_id, quality = 1 AS was, toxic FROM documents LEFT JOIN labels USING (doc_id)"


def _notes(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("batch_id"), F.col("doc_id").cast("string").alias("note_id"), "doc_id", "text")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


@query(f"SELECT batch_id, note_id, coalesce(toxic = 0, false) AS approved, 200 AS code, CASE WHEN coalesce(toxic = 0, false) AND NOT coalesce(was, false) THEN 1 WHEN NOT coalesce(toxic = 0, false) AND coalesce(was, false) THEN -1 ELSE 0 END AS delta FROM ({_WANTED}) UNION ALL SELECT DISTINCT source, 'absent', true, 404, 0 FROM documents")
def approve_notes(spark, d):
    rows = _notes(spark, d)
    asked = rows.select("batch_id", "note_id", F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("approved"))
    asked = asked.union(rows.select("batch_id").distinct().select("batch_id", F.lit("absent"), F.lit(True)))
    return B.approve(asked, rows.select("batch_id", "note_id"), rows.select("batch_id", "note_id", (F.col("quality") == 1).alias("approved")))


def _wanted(spark, d):
    inputs = _notes(spark, d).select("batch_id", B.object_key("input", F.col("batch_id"), F.col("note_id")).alias("path"))
    return B.required(inputs.union(inputs))


@query("SELECT DISTINCT source AS batch_id, doc_id::VARCHAR AS note_id FROM documents")
def required_notes(spark, d):
    return _wanted(spark, d)


@query("""SELECT source AS batch_id, doc_id::VARCHAR AS note_id, md5(CASE WHEN quality = 1 THEN 'saved ' || doc_id WHEN quality = 0 THEN coalesce(text, '') ELSE '' END) AS text_md5,
source || '/approvals/' || doc_id || '_approved.txt' AS key, source || '/approvals/' || doc_id || '.txt ' || source || '/approvals/' || doc_id || '.json' AS removed FROM documents LEFT JOIN labels USING (doc_id)""")
def approve_all_notes(spark, d):
    rows = _notes(spark, d)
    saved = rows.filter("quality = 1").select("batch_id", "note_id", F.concat(F.lit("saved "), "note_id").alias("text"))
    out = B.approve_all(_wanted(spark, d), saved, rows.filter("quality IS NOT NULL").select("batch_id", "note_id", "text"))
    return out.select("batch_id", "note_id", F.md5("text").alias("text_md5"), "key", F.array_join("removed", " ").alias("removed"))


@query("SELECT source AS batch_id, count(*) AS required_note_count, count(*) AS approved_note_count, count(*) - count(*) FILTER (quality = 1) AS delta, true AS all_approved FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def approve_all_batches(spark, d):
    counters = _notes(spark, d).groupBy("batch_id").agg(F.count_if(F.col("quality") == 1).alias("approved_note_count"))
    return B.approved_batches(_wanted(spark, d), counters)


@query("SELECT source AS batch_id, doc_id::VARCHAR AS note_id, quality IS NOT NULL AS has_output, coalesce(quality = 1, false) AS approved FROM documents LEFT JOIN labels USING (doc_id)")
def batch_notes(spark, d):
    rows = _notes(spark, d)
    record = rows.select(
        "batch_id", F.concat(F.lit("NOTE#"), "note_id").alias("record_type"), F.when(F.col("doc_id") % 2 == 0, F.col("note_id")).alias("note_id"),
        F.when(F.col("quality").isNotNull(), True).alias("has_output"), F.when(F.col("quality") == 1, True).alias("approved"),
    )
    batch = rows.select("batch_id").distinct().select("batch_id", F.lit("BATCH").alias("record_type"), *(F.lit(None).cast(t).alias(c) for c, t in (("note_id", "string"), ("has_output", "boolean"), ("approved", "boolean"))))
    return B.note_rows(record.union(batch))


@query("""WITH c AS (SELECT user_id AS batch_id, count(*) FILTER (event_type = 'view') AS input_count, count(*) FILTER (event_type = 'purchase') AS approved_note_count,
CASE user_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' END AS s FROM events GROUP BY user_id)
SELECT batch_id, input_count, approved_note_count, coalesce(s, 'created') AS status, coalesce(s = 'completed' AND approved_note_count >= input_count AND input_count > 0, false) AS all_approved FROM c""")
def batch_list(spark, d):
    count = lambda k, c: F.count_if(F.col("event_type") == k).alias(c)
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("batch_id")).agg(count("view", "input_count"), count("purchase", "approved_note_count"))
    return B.listed(rows.withColumn("status", F.when(F.col("batch_id") % 3 == 0, "completed").when(F.col("batch_id") % 3 == 1, "processing")))


_ASKED = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ten' ELSE (c_custkey - 20)::VARCHAR END AS l, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE (c_custkey % 90 - 30)::VARCHAR END AS o FROM customer"


@query(f"""SELECT c_custkey, CASE WHEN bad THEN 50 ELSE greatest(1, least(200, coalesce(try_cast(l AS INT), 50))) END::INT AS page_limit, CASE WHEN bad THEN 0 ELSE greatest(0, coalesce(try_cast(o AS INT), 0)) END::INT AS page_offset
FROM (SELECT *, (l IS NOT NULL AND try_cast(l AS INT) IS NULL) OR (o IS NOT NULL AND try_cast(o AS INT) IS NULL) AS bad FROM ({_ASKED}))""")
def page_bounds(spark, d):
    k = F.col("c_custkey")
    limit = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "ten").otherwise((k - 20).cast("string"))
    offset = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "x").otherwise((k % 90 - 30).cast("string"))
    out = table(spark, d, "customer").select("c_custkey", B.bounds(limit, offset).alias("b"))
    return out.select("c_custkey", F.col("b.limit").alias("page_limit"), F.col("b.offset").alias("page_offset"))


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM nation) AS total FROM nation ORDER BY n_name, n_nationkey LIMIT 7 OFFSET 5")
def page_offset(spark, d):
    rows, total = B.page(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_name", "n_nationkey"], 7, 5)
    return rows.withColumn("total", F.lit(total).cast("long"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0001-01-01 00:00:00' WHEN 1 THEN '0001-01-01 00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS sorted_by FROM orders""")
def sort_times(spark, d):
    iso, k = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey") % 4
    value = F.when(k == 0, "").when(k == 1, F.concat(F.lit("on "), iso)).when(k == 2, F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("+00:00")))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(B.sort_time(value), "yyyy-MM-dd HH:mm:ss").alias("sorted_by"))


@query("SELECT doc_id, source || '/input/' || doc_id || '.txt' AS input, source || '/output/' || doc_id || '_redacted.txt' AS redacted, source || '/output/' || doc_id || '_entities.json' AS entities FROM documents")
def object_keys(spark, d):
    kinds = ("input", "redacted", "entities")
    return table(spark, d, "documents").select("doc_id", *(B.object_key(k, F.col("source"), F.col("doc_id")).alias(k) for k in kinds))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN 'sent' WHEN quality = 1 THEN 'saved' WHEN quality = 0 THEN coalesce(text, '') ELSE '' END) AS shown_md5 FROM documents LEFT JOIN labels USING (doc_id)")
def resolved_text(spark, d):
    rows = _notes(spark, d)
    shown = B.resolved(F.when(F.col("doc_id") % 7 == 0, "sent"), F.when(F.col("quality") == 1, "saved"), F.when(F.col("quality") == 0, F.col("text")))
    return rows.select("doc_id", F.md5(shown).alias("shown_md5"))
