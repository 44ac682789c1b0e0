"""Readers and writers of notes, annotations, manifests, formats and tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import approved_id, stem
from ..model import FORMAT, MANIFEST, POSITIONS_FILE, RESPONSE
from .objects import listing, opened, remove_keys, write_objects  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a task where each row grows to some kilobytes.
SPREAD_ROWS = 4_000


def spread(rows: DataFrame, key: str, each: int = SPREAD_ROWS) -> DataFrame:
    """rows in tasks of about `each` rows, dealt by a key: what is made of rows of a few bytes doesn't grow in the few tasks that a small file has.

    The rows are counted first, for Parquet from its footers. What is grouped by the key afterwards is in place already.
    """
    return rows.repartition(max(1, -(-rows.count() // each)), key)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 by its byte order mark, which stays as U+FEFF; else UTF-8; else UTF-16 little-endian; else Latin-1."""
    mark = F.hex(F.substring(content, 1, 2))
    pairs = F.hex(content)
    surrogate = r"^(?:[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])*$"
    sound = (F.length(content) % 2 == 0) & pairs.rlike(surrogate)
    return (
        F.when(mark == "FFFE", F.decode(content, "UTF-16LE")).when(mark == "FEFF", F.decode(content, "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(sound, F.decode(content, "UTF-16LE")).otherwise(F.decode(content, "ISO-8859-1"))
    )


def decoded_strict(content: Column) -> Column:
    """UTF-16 by its mark, which goes; else UTF-8, or null where it isn't valid."""
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(F.try_validate_utf8(content.cast("string")))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, size, modified, content) of the files below a folder; nothing else of them is read where only names are asked for.

    Spark lists them on the driver, which so holds a few hundred bytes of each; contents() doesn't.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


#: Objects that a task reads, and bytes of a batch of rows.
READ_OBJECTS, READ_BYTES = 2_000, 8 << 20


def contents(spark: SparkSession, path: str, suffix: str = "", deep: bool = True) -> DataFrame:
    """files() whose name ends so, of what write_objects() reaches: listed and read on the executors, so the driver holds none of the names.

    Unless deep, only the folder's own. They are listed once more to be counted, and dealt out by key before they are read.
    """
    base = path.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]):
        system, root = opened(base)
        for b in batches:
            at, held, found = 0, 0, []
            for i, key in enumerate(b.column("key").to_pylist()):
                with system.open_input_stream(root.rstrip("/") + key[len(base) :]) as f:
                    found.append(f.read())
                held += len(found[-1])
                if held >= READ_BYTES or i + 1 == b.num_rows:
                    part = b.slice(at, len(found))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=["path", "size", "modified", "content"])
                    at, held, found = i + 1, 0, []

    rows = listing(spark, path, suffix, deep=deep).select("key", "size", "modified")
    return spread(rows, "key", READ_OBJECTS).mapInArrow(read, "path string, size long, modified timestamp, content binary")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, note_id, text) of `{batch}/input/{note}.txt`."""
    rows = files(spark, path)
    return rows.select(F.regexp_extract("path", r"([^/]+)/input/[^/]*$", 1).alias("batch_id"), stem(F.col("path")).alias("note_id"), decoded(F.col("content")).alias("text"))


def batches(spark: SparkSession, path: str) -> DataFrame:
    """Distinct batch folders, hidden ones left out."""
    return files(spark, path, "*").select(F.regexp_extract("path", r"([^/]+)/(?:input|output|approved)/[^/]*$", 1).alias("batch_id")).filter("batch_id <> '' AND batch_id NOT LIKE '.%'").distinct()


def approved(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).select(approved_id(F.col("path")).alias("note_id"), "path").filter("note_id IS NOT NULL")


def _json(spark: SparkSession, path: str, schema, suffix: str, deep: bool) -> DataFrame:
    bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = contents(spark, path, f"{suffix}.json", deep).select("path", F.col("content").cast("string").alias("text")).filter("trim(text) <> ''")
    rows = rows.select(F.from_json("text", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "path")
    return rows.select("r.*", F.regexp_replace(stem(F.col("path")), f"{suffix}$", "").alias("note_id"))


def responses(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """Detections, an object a file; files that aren't JSON come with _corrupt_record."""
    return _json(spark, path, RESPONSE, "_response", deep)


def positions(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    rows = _json(spark, path, POSITIONS_FILE, "_positions", deep)
    return rows.select("note_id", F.explode("pii_entities").alias("p")).select("note_id", "p.*")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth, each entity of a note once."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    entities = rows.withColumn("note_id", F.coalesce("note_id", stem(F.col("_metadata.file_path")))).select("note_id", "note_type", F.explode("phi_entities").alias("e"))
    return entities.select("note_id", "note_type", "e.type", "e.value", F.coalesce("e.start", F.lit(0)).alias("start"), F.coalesce("e.end", F.lit(0)).alias("end")).dropDuplicates(["note_id", "type", "value", "start", "end"])


def formats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORMAT).option("multiLine", "true").json(path).orderBy("name")


def save_format(spark: SparkSession, path: str, name: str, template: str, scheme: str = "alpha") -> None:
    if not name:
        raise ValueError("a format needs a name")
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(template).alias("template"), F.lit(scheme).alias("id_scheme"), F.current_timestamp().cast("string").alias("created"))
    row.write.mode("append").json(path)


def write_notes(df: DataFrame, path: str, batch_col: str = "batch_id") -> None:
    """Redacted notes and their occurrences, by batch; a batch written again is replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col).json(path)


# --- listings ---------------------------------------------------------------------------------------------------------


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is any object below a folder; a folder that isn't there has none, any other failure is raised."""
    return not listing(spark, path, limit=1).isEmpty()


def some(rows: DataFrame, path: str) -> DataFrame:
    """rows, or an error where a folder gave none."""
    if rows.isEmpty():
        raise FileNotFoundError(f"no files in {path}")
    return rows


def like(pattern: str) -> str:
    """A regular expression for a file pattern of `*`, `?` and `[...]` over whole keys."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        end = pattern.find("]", i + 1) if c == "[" else -1
        if end > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() else "\\" + c)
    return f"(?s)^{out}$"


def matched(keys: DataFrame, pattern: str = "*", exclude: str | None = None, limit: int | None = None, key: str = "key") -> DataFrame:
    """Keys that fit a pattern as a whole and whose last part doesn't fit exclude, in order; the first `limit` of them."""
    out = keys.filter(F.col(key).rlike(like(pattern)))
    if exclude:
        out = out.filter(~F.element_at(F.split(key, "/", -1), -1).rlike(like(exclude)))
    out = out.orderBy(key)
    return out if limit is None else out.limit(limit)


def bucket_and_key(path: Column) -> Column:
    """struct<is_object, bucket, key> of `scheme://bucket/key`; of anything else the path itself."""
    p = r"^[a-z0-9]+://([^/]+)/?(.*)$"
    own = path.rlike(p)
    part = lambda i: F.when(own, F.regexp_extract(path, p, i))
    return F.struct(own.alias("is_object"), part(1).alias("bucket"), F.coalesce(part(2), path).alias("key"))


def sources_resolved(found: DataFrame, there: DataFrame, folder: str, source: str = "source") -> DataFrame:
    """found with `path` and `outcome`: `skipped` without a source, `missing` where no file of there (path) is it, else `ok`.

    A relative source is below folder.
    """
    named = F.coalesce(F.col(source), F.lit("")) != ""
    path = F.when(named, F.when(F.col(source).rlike(r"^(/|[a-z0-9]+:)"), F.col(source)).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), source)))
    known = there.select(F.col("path").alias("__there")).distinct()
    rows = found.withColumn("path", path).join(known, F.col("path") == F.col("__there"), "left")
    return rows.withColumn("outcome", F.when(~named, "skipped").when(F.col("__there").isNull(), "missing").otherwise("ok")).drop("__there")


# --- objects ----------------------------------------------------------------------------------------------------------


def remove_objects(spark: SparkSession, paths: list[str]) -> int:
    """Deletes objects, and gives how many were there; a failure other than a missing object is raised."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(conf).delete(path, False))  # false where nothing is there
    return n


def copy_object(spark: SparkSession, source: str, target: str) -> None:
    """Copies an object between any two file systems; an error where there is none."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def outputs(notes: DataFrame, batch_col: str = "batch_id", note_col: str = "note_id") -> DataFrame:
    """(key, content): `{batch}/output/{note}_redacted.txt` and `{note}_entities.json`, the occurrences, for notes with redacted and occurrences."""
    stem_ = F.concat(F.col(batch_col).cast("string"), F.lit("/output/"), F.col(note_col).cast("string"))
    pair = lambda tail, content: F.struct(F.concat(stem_, F.lit(tail)).alias("key"), content.alias("content"))
    return notes.select(F.explode(F.array(pair("_redacted.txt", F.col("redacted")), pair("_entities.json", F.to_json("occurrences")))).alias("o")).select("o.*")


def response_files(detected: DataFrame, stem_col: str, source_col: str) -> DataFrame:
    """(key, content): `{stem}_response.json` with the source and the entities found."""
    body = F.to_json(F.struct(F.col(source_col).alias("source"), F.struct(F.col("entities").alias("pii_entities")).alias("response")))
    return detected.select(F.concat(F.col(stem_col).cast("string"), F.lit("_response.json")).alias("key"), body.alias("content"))


def redaction_files(redacted: DataFrame, stem_col: str) -> DataFrame:
    """(key, content): `{stem}_redacted.txt` and `{stem}_positions.json`, the stem without a `_response` at its end."""
    own = F.regexp_replace(F.col(stem_col).cast("string"), "_response$", "")
    pair = lambda tail, content: F.struct(F.concat(own, F.lit(tail)).alias("key"), content.alias("content"))
    positions_ = F.to_json(F.struct(F.col("positions").alias("pii_entities")))
    return redacted.select(F.explode(F.array(pair("_redacted.txt", F.col("redacted")), pair("_positions.json", positions_))).alias("o")).select("o.*")


def note_files(notes: DataFrame, id_col: str, template: bool = False) -> DataFrame:
    """(key, content): a note and its manifest in folders of their own; templates in folders below `templates`."""
    top = "templates/" if template else ""
    pair = lambda folder, tail, content: F.struct(F.concat(F.lit(f"{top}{folder}/"), F.col(id_col).cast("string"), F.lit(tail)).alias("key"), F.col(content).alias("content"))
    return notes.select(F.explode(F.array(pair("notes", ".txt", "text"), pair("manifests", ".json", "manifest"))).alias("o")).select("o.*")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(template, text, note_type) of the texts in a folder `notes`, by name; the type is in the manifest beside it, else `unknown`."""
    texts = files(spark, f"{path}/notes").select(stem(F.col("path")).alias("template"), decoded(F.col("content")).alias("text"))
    if not exists(spark, f"{path}/manifests"):
        return texts.withColumn("note_type", F.lit("unknown")).orderBy("template")
    kinds = files(spark, f"{path}/manifests", "*.json").select(stem(F.col("path")).alias("template"), F.get_json_object(F.col("content").cast("string"), "$.note_type").alias("note_type"))
    return texts.join(kinds, "template", "left").withColumn("note_type", F.coalesce("note_type", F.lit("unknown"))).orderBy("template")


def load_format(spark: SparkSession, path: str, name: str) -> tuple[str, str]:
    """(template, scheme) of a saved format, the last one saved under that name."""
    found = formats(spark, path).filter(F.col("name") == name).orderBy(F.desc("created")).select("template", "id_scheme").first()
    if found is None:
        raise FileNotFoundError(f"no format named {name}")
    return tuple(found)


def records(spark: SparkSession, spans: DataFrame, sql: str) -> DataFrame:
    """A query over telemetry spans, named {records} in its text; no view of the session is touched."""
    return spark.sql(sql, records=spans)
