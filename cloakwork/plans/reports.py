"""Queries of telemetry totals, evaluation reports and the evaluation screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import detect as D, evaluate as E, review as V, telemetry as M
from ..sources.files import table
from .catalogue import _P, _T, _docs, _overlap_sql, _sides, _spans, ORACLES, evaluation_list, query

_KEYS = ["doc_id", "type", "value"]
_ERROR = "error"

_MINUTES = "SELECT date_trunc('minute', ts) AS minute, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, sum((props->>'$.k')::BIGINT) AS k FROM events GROUP BY 1"


@query(f"SELECT count(*) AS minutes, sum(n)::BIGINT AS total_requests, sum(bad)::BIGINT AS total_failures, sum(n - bad)::BIGINT AS total_successes, sum(k)::BIGINT AS total_tokens_used, round(sum(k) / count(*), 6) AS avg_tokens_per_minute FROM ({_MINUTES})")
def telemetry_totals(spark, d):
    minutes = M.per_minute(_spans(spark, d, "props"), "ts", F.col("event_type") == _ERROR, M.attribute("k", column="props"))
    return M.totals(minutes).withColumn("avg_tokens_per_minute", F.round("avg_tokens_per_minute", 6))


@query("""SELECT count(*) AS total_spans, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate, round(100.0 * sum(value::BIGINT % 5) / sum((props->>'$.k')::BIGINT), 6) AS cache_hit_rate
FROM (SELECT *, floor(value) AS v FROM events) e""".replace("value::BIGINT % 5", "v::BIGINT % 5"))
def telemetry_rates(spark, d):
    tokens = {"input": M.attribute("k", column="props"), "cache_read": F.floor("value").cast("long") % 5}
    out = M.rates(M.summary(_spans(spark, d, "props", "value"), F.col("event_type") == _ERROR, tokens))
    return out.select("total_spans", F.round("success_rate", 6).alias("success_rate"), F.round("cache_hit_rate", 6).alias("cache_hit_rate"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 12:00:00' AND TIMESTAMP '2024-01-09' GROUP BY event_type")
def time_range(spark, d):
    rows = M.in_range(_spans(spark, d), "ts", "2024-01-03 12:00:00", "2024-01-09 00:00:00")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'N/A' ELSE format('{:,}', c_custkey * 12345) END AS whole, CASE WHEN c_custkey % 9 = 0 THEN 'N/A' ELSE printf('%.1f%%', (c_custkey % 100) / 8) END AS percent FROM customer")
def number_formats(spark, d):
    n = F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", M.number(n * 12345).alias("whole"), M.percent((n % 100) / 8).alias("percent"))


@query("SELECT doc_id - doc_id % 10 AS block, (row_number() OVER (PARTITION BY doc_id - doc_id % 10 ORDER BY doc_id) - 1)::INT AS place, source, CASE WHEN row_number() OVER (PARTITION BY doc_id - doc_id % 10 ORDER BY doc_id) < 9 THEN lang END AS lang, min(source) FILTER (doc_id % 10 = 0) OVER (PARTITION BY doc_id - doc_id % 10) AS head FROM documents")
def columnar_rows(spark, d):
    """Ten documents as columns, the second of which is two values short, and back to rows."""
    rows = table(spark, d, "documents").select((F.col("doc_id") - F.col("doc_id") % 10).alias("block"), "doc_id", "source", "lang")
    rows = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "source", "lang"))).alias("r"))
    column = lambda name, values: F.struct(F.lit(name).alias("name"), values.alias("values"))
    columns = F.array(column("source", F.col("r.source")), column("lang", F.slice("r.lang", 1, 8)))
    rows = rows.select("block", columns.alias("columns"))
    heads = rows.select("block", M.first_value("source", F.lit(None)).alias("head"))
    back = rows.select(F.transform("columns", lambda c: F.struct(c["name"].alias("name"), F.transform(c["values"], lambda v: F.concat_ws("|", F.col("block").cast("string"), F.coalesce(v, F.lit("")))).alias("values"))).alias("columns"))
    parts = lambda c, i: F.get(F.split(F.col("row")[c], r"\|"), i)
    out = M.rows_of(back).select(parts("source", 0).cast("long").alias("block"), "place", parts("source", 1).alias("source"), parts("lang", 1).alias("lang"))
    return out.withColumn("lang", F.nullif("lang", F.lit(""))).join(heads, "block")


# --- evaluation reports -----------------------------------------------------------------------------------------------

_BY_TYPE = f"""WITH {_T}, {_P}, m AS (SELECT doc_id, type, value, count(*) AS n FROM t GROUP BY ALL), q AS (SELECT doc_id, type, value, count(*) AS n FROM p GROUP BY ALL),
j AS (SELECT coalesce(m.type, q.type) AS type, coalesce(m.n, 0) AS a, coalesce(q.n, 0) AS b FROM m FULL JOIN q ON m.doc_id = q.doc_id AND m.type = q.type AND m.value = q.value),
s AS (SELECT type, sum(least(a, b))::BIGINT AS tp, sum(b - least(a, b))::BIGINT AS fp, sum(a - least(a, b))::BIGINT AS fn FROM j GROUP BY type)"""
_RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 9)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9)::DOUBLE AS f1"


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"{_BY_TYPE} SELECT type, tp, fp, fn, {_RATES} FROM s")
def eval_matches_by_type(spark, d):
    return _rounded(E.matches_by_type(*_sides(spark, d), _KEYS))


@query(f"{_BY_TYPE}, n AS (SELECT type, row_number() OVER (ORDER BY fn DESC, type) - 1 AS place, tp, fp, fn FROM s) SELECT place::INT AS place, type, tp, fp, fn, (SELECT sum(tp) FROM s)::BIGINT AS all_tp, (SELECT sum(fn) FROM s)::BIGINT AS all_fn FROM n")
def eval_report(spark, d):
    out = E.report(*_sides(spark, d), _KEYS).withColumnsRenamed({"tp": "all_tp", "fn": "all_fn"})
    return out.select("all_tp", "all_fn", F.posexplode("types").alias("place", "t")).select("place", "t.type", "t.tp", "t.fp", "t.fn", "all_tp", "all_fn")


@query(f"{_BY_TYPE} SELECT type, tp, fp, fn FROM s ORDER BY fp DESC, type")
def type_table(spark, d):
    return E.type_table(E.matches_by_type(*_sides(spark, d), _KEYS), "fp").select("type", "tp", "fp", "fn")


@query(f"""WITH o AS ({_overlap_sql("doc_id")}), f AS (SELECT count(*) FILTER (tp = 0 AND fp = 0) AS failed, count(*) FILTER (tp > 0 OR fp > 0) AS valid FROM o),
s AS (SELECT failed > 0 AND valid > 0 AS adjusted, failed, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn) FILTER (tp > 0 OR fp > 0 OR NOT (failed > 0 AND valid > 0)), 0)::BIGINT AS fn FROM o, f GROUP BY ALL)
SELECT adjusted, failed, tp, fp, fn, {_RATES} FROM s""")
def displayed_metrics(spark, d):
    return _rounded(E.displayed(E.overlap(*_sides(spark, d), ["doc_id"])))


@query(f"SELECT doc_id, kind, type, start, \"end\", min(value) AS value FROM ({ORACLES['mistakes']}) WHERE kind = 'fp' AND type = 'ip_address' GROUP BY ALL")
def mistake_list(spark, d):
    """Mistakes seen twice, as a list shows them: one kind and type, each once."""
    from .catalogue import mistakes

    rows = mistakes(spark, d)
    return E.shown(rows.unionByName(rows), "ip_address", "fp")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS chars FROM documents")
def mistake_entries(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("chars"), F.col("source").alias("value"))
    return E.normalised(rows.withColumn("value", F.when(F.col("doc_id") % 2 == 0, F.when(F.col("chars").isNull(), F.lit(None)).otherwise("other")).otherwise(F.col("value"))))


@query(f"SELECT doc_id, l.quality::VARCHAR AS note_type, doc_id IN (SELECT doc_id FROM ({ORACLES['mistakes']})) AS has_mistakes FROM documents LEFT JOIN labels l USING (doc_id)")
def note_list(spark, d):
    from .catalogue import mistakes

    kinds = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("note_type"))
    return V.note_list(table(spark, d, "documents").select("doc_id"), kinds, mistakes(spark, d))


@query("SELECT doc_id, md5(text) AS original, md5(lower(text)) AS redacted, md5(upper(lang)) AS deidentified FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang IS NOT NULL AND text IS NOT NULL")
def three_texts(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    redacted = docs.join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lower("text").alias("text"))
    third = docs.filter("lang IS NOT NULL").select("doc_id", F.upper("lang").alias("text"))
    out = V.compared(docs.select("doc_id", "text"), redacted, third)
    return out.select("doc_id", *(F.md5(c).alias(c) for c in ("original", "redacted", "deidentified")))


@query("""SELECT w.doc_id, CASE WHEN length(text) > 0 THEN 200 ELSE 404 END AS code, md5(CASE WHEN quality = 1 THEN 'saved' WHEN quality = 0 THEN 'output' ELSE '' END) AS redacted, coalesce(quality = 1, false) AS approved, CASE WHEN length(text) > 0 AND toxic = 1 THEN 1 ELSE 0 END AS listed
FROM (SELECT doc_id FROM documents UNION SELECT -1) w LEFT JOIN documents d ON d.doc_id = w.doc_id LEFT JOIN labels l ON l.doc_id = w.doc_id""")
def note_lookup(spark, d):
    docs, labels = _docs(spark, d), table(spark, d, "labels")
    wanted = docs.select("doc_id").union(spark.range(1).select(F.lit(-1).cast("long")))
    text = lambda q, v: labels.filter(f"quality = {q}").select("doc_id", F.lit(v).alias("text"))
    entities = labels.filter("toxic = 1").select("doc_id", F.array(F.lit("x")).alias("entities"))
    out = V.looked_up(wanted, docs, text(0, "output").unionByName(text(1, "saved")), text(1, "saved"), entities)
    listed = F.when((F.col("code") == 200) & F.col("entities").isNotNull(), 1).otherwise(0)
    return out.select("doc_id", "code", F.md5("redacted").alias("redacted"), "approved", listed.alias("listed"))


@query(f'SELECT max(name) AS name, max("at") AS "at" FROM ({ORACLES["evaluation_list"]})')
def newest_evaluation(spark, d):
    return V.newest(evaluation_list(spark, d), "name")


_TYPED = "SELECT DISTINCT type, CASE type WHEN 'email' THEN 'EMAIL' WHEN 'ip_address' THEN 'IP_ADDRESS' WHEN 'account_number' THEN 'ACCOUNT_NUMBER' ELSE upper(type) END AS compared, CASE type WHEN 'email' THEN 'Email' WHEN 'ip_address' THEN 'Ip Address' WHEN 'account_number' THEN 'Account Number' END AS label FROM p"


@query(f"WITH {_P} {_TYPED}")
def compared_types(spark, d):
    rows = _sides(spark, d)[1].select("type").distinct()
    return rows.select("type", X.manifest_type(F.col("type"), True).alias("compared"), X.label(F.col("type")).alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN least(2, n) ELSE n END AS kept FROM (SELECT d.doc_id, count(e.value) AS n FROM documents d LEFT JOIN " + ORACLES["detect_entities"].replace("SELECT doc_id, type, value FROM", "", 1).strip() + " e ON e.doc_id = d.doc_id AND e.type IN ('email', 'ssn') GROUP BY d.doc_id)")
def detection_parameters(spark, d):
    """The detector's entities under parameters that ask for two types, and for some documents two entities or none."""
    wanted = D.parameters([" EMAIL", "", "ssn "], 2)
    rows = D.detect(_docs(spark, d))
    kept = lambda most: F.size(D.restricted(F.col("entities"), wanted["pii_types"], most)).cast("long")
    n = F.when(F.col("doc_id") % 3 == 0, F.lit(0).cast("long")).when(F.col("doc_id") % 3 == 1, kept(wanted["max_entities"])).otherwise(kept(1 << 30))
    return rows.select("doc_id", n.alias("kept"))
