"""The object data source: nothing shows before the commit, failed tasks leave nothing, prefixes are pushed into the listing."""

import os
from hashlib import md5

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from cloakwork.sources import files as FS, objects as O


def made(spark, tmp_path, n=200):
    base = f"file://{tmp_path}/objects"
    rows = spark.range(n).repartition(4).selectExpr("concat('b', id % 5, '/input/n', id, '.txt') key", "concat('text ', id) content")
    FS.write_objects(rows, base)
    return base


def test_written_and_listed(spark, tmp_path):
    base = made(spark, tmp_path)
    got = FS.listing(spark, base, ".txt", digests=True).collect()
    assert {(r.key, r.size, r.etag) for r in got} == {(f"{base}/b{i % 5}/input/n{i}.txt", len(f"text {i}"), md5(f"text {i}".encode()).hexdigest()) for i in range(200)}
    assert not os.path.exists(f"{tmp_path}/objects/_waiting")
    FS.write_objects(spark.createDataFrame([("b1/input/n1.txt", "new é"), ("top.txt", None)], "key string, content string"), base)
    sizes = {r.key[len(base) + 1 :]: r.size for r in FS.listing(spark, base).collect()}
    assert len(sizes) == 201 and sizes["b1/input/n1.txt"] == 6 and sizes["top.txt"] == 0


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    """Other tasks have ended well by then; none of their objects shows, and what was there stays."""
    base = made(spark, tmp_path, 20)
    bad = spark.range(0, 400, 1, 4).selectExpr("concat('c/', id, '.txt') key", "CASE WHEN id = 399 THEN raise_error('broken') ELSE concat('text ', id) END content")
    with pytest.raises(Exception, match="broken"):
        FS.write_objects(bad, base)
    with pytest.raises(PythonException, match="not an object's key"):
        FS.write_objects(spark.createDataFrame([("d/ok.txt", "x"), ("../out.txt", "x")], "key string, content string"), base)
    assert FS.listing(spark, base).count() == 20
    assert sorted(x for x in os.listdir(f"{tmp_path}/objects") if x != "_waiting") == [f"b{i}" for i in range(5)]  # a task that was still ending may leave hidden files


def test_only_named_attempts_are_published(tmp_path):
    """Two attempts of a task end well, as with speculation: the one that Spark names is published."""
    import pyarrow as pa

    base = f"file://{tmp_path}"
    writer = O.ObjectWriter(base)
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(["k/a", "k/a", "k/b"]), pa.array(["old", t, t])], names=["key", "content"])
    writer.write(iter([batch("lost")]))
    named = writer.write(iter([batch("won")]))
    assert named.objects == 3 and not os.path.exists(f"{tmp_path}/k")
    writer.commit([named, None])
    assert open(f"{tmp_path}/k/a").read() == open(f"{tmp_path}/k/b").read() == "won" and os.listdir(tmp_path) == ["k"]


def test_prefixes_are_partitions_and_pushed(spark, tmp_path):
    base = made(spark, tmp_path)
    reader = O.ObjectReader(base, {})
    assert len(reader.partitions()) == 5
    opened = []
    reader._open = lambda root, path, f=reader._open: opened.append(path) or f(root, path)
    left = list(reader.pushFilters([O.StringStartsWith(("key",), f"{base}/b3/"), O.StringEndsWith(("key",), ".txt"), O.StringEndsWith(("other",), "x")]))
    assert len(left) == 1
    assert {p.path.rpartition("/objects/")[2] for p in reader.partitions()} == {"b3/input"}
    df = FS.listing(spark, base, ".txt").filter(F.col("key").startswith(f"{base}/b3/"))
    assert df.count() == 40
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "EndsWith" not in plan and "*(1) Filter" not in plan  # nothing is left for Spark to filter


def test_pattern_limit_and_missing(spark, tmp_path):
    base = made(spark, tmp_path, 50)
    assert FS.listing(spark, base, pattern="*/b2/*n?2.txt").count() == 4
    assert FS.listing(spark, base, limit=7).count() == 7
    assert FS.listing(spark, f"{base}/nowhere").count() == 0 and not FS.exists(spark, f"{base}/nowhere") and FS.exists(spark, base)
    with pytest.raises(Exception, match="[Uu]nrecognized|scheme"):
        FS.exists(spark, "nosuch://x/y")


def test_delete_and_copy(spark, tmp_path):
    base = made(spark, tmp_path, 10)
    assert FS.remove_objects(spark, [f"{base}/b1/input/n1.txt", f"{base}/b1/input/none.txt"]) == 1
    assert FS.listing(spark, base).count() == 9
    FS.copy_object(spark, f"{base}/b2/input/n2.txt", f"file://{tmp_path}/other/copy.txt")
    assert open(f"{tmp_path}/other/copy.txt").read() == "text 2"
    with pytest.raises(Exception, match="not exist|FileNotFound"):
        FS.copy_object(spark, f"{base}/none.txt", f"file://{tmp_path}/x.txt")


def test_formats_and_empty_folders(spark, tmp_path):
    FS.save_format(spark, f"{tmp_path}/f", "plain", "[{TYPE}]")
    FS.save_format(spark, f"{tmp_path}/f", "plain", "<{TYPE}>", "numeric")
    assert FS.load_format(spark, f"{tmp_path}/f", "plain") == ("<{TYPE}>", "numeric")
    with pytest.raises(FileNotFoundError):
        FS.load_format(spark, f"{tmp_path}/f", "other")
    with pytest.raises(ValueError):
        FS.save_format(spark, f"{tmp_path}/f", "", "x")
    os.makedirs(f"{tmp_path}/empty")
    with pytest.raises(FileNotFoundError):
        FS.some(FS.files(spark, f"{tmp_path}/empty"), "empty")
    base = made(spark, tmp_path, 10)
    assert {r.batch_id for r in FS.batches(spark, base).collect()} == {f"b{i}" for i in range(5)}
    FS.write_objects(spark.createDataFrame([("b1/approvals/n1_approved.txt", "ok"), ("b1/approvals/n2.txt", "no")], "key string, content string"), base)
    assert [r.note_id for r in FS.approved(spark, base).collect()] == ["n1"]
    assert spark.createDataFrame([("a\r\nb\rc\n",)], "t string").select(FS.unix_lines(F.col("t")).alias("t")).first().t == "a\nb\nc\n"


def test_contents_are_listed_and_read_on_executors(spark, tmp_path, monkeypatch):
    """The plan holds no file of them; folders of any depth, only the folder's own where told, nothing where there is none."""
    base = made(spark, tmp_path, 50)
    FS.write_objects(spark.createDataFrame([("top.txt", "é"), ("empty.txt", None), ("b1/other.md", "no")], "key string, content string"), base)
    monkeypatch.setattr(FS, "READ_OBJECTS", 10)
    monkeypatch.setattr(FS, "READ_BYTES", 12)
    got = FS.contents(spark, base, ".txt")
    assert got.rdd.getNumPartitions() == 6 and "FileScan" not in got._jdf.queryExecution().executedPlan().toString() and not got.inputFiles()
    want = {f"{base}/b{i % 5}/input/n{i}.txt": f"text {i}".encode() for i in range(50)} | {f"{base}/top.txt": "é".encode(), f"{base}/empty.txt": b""}
    assert {r.path: bytes(r.content) for r in got.collect()} == want and all(r.size == len(r.content) for r in got.collect())
    assert {r.path for r in FS.contents(spark, f"{tmp_path}/objects", ".txt", deep=False).collect()} == {f"{tmp_path}/objects/top.txt", f"{tmp_path}/objects/empty.txt"}
    assert FS.contents(spark, f"{base}/nowhere").count() == 0


@pytest.mark.parametrize("name", ["output_files", "response_files", "evaluation_files", "redrive_sent"])
def test_queries_hold_no_list_of_files(spark, data, name):
    from cloakwork.plans import catalogue

    df = catalogue.QUERIES[name](spark, data)
    assert "cloakwork_objects" in df._jdf.queryExecution().optimizedPlan().toString()
    assert all(f.endswith(".parquet") for f in df.inputFiles())  # the tables, no object


def test_messages_of_a_worker_come_in_files_of_bounded_size(spark, data, monkeypatch):
    """More rows make more files, not longer ones, and a micro-batch takes several of them."""
    import glob

    import pyarrow.parquet as pq

    from cloakwork.plans import catalogue
    from cloakwork.streaming import ingest

    seen, stream = [], ingest.stream
    monkeypatch.setattr(FS, "SPREAD_ROWS", 30)
    monkeypatch.setattr(ingest, "stream", lambda spark, path, schema, n: seen.append((path, n)) or stream(spark, path, schema, n))
    docs = catalogue._docs(spark, data).count()
    assert sum(r.processed + r.failed + r.again for r in catalogue.QUERIES["worker_records"](spark, data).collect()) == docs
    (path, n), *_ = seen
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet")]
    assert sum(sizes) == docs and max(sizes) <= 60 and len(sizes) == -(-docs // 30) and n == -(-len(sizes) // 3) > 1


def test_many_objects_are_published_on_executors(spark, tmp_path, monkeypatch):
    """The commit of a named job leaves many objects to a job, of which any task may be repeated; the last task's last content stays."""
    import json

    import pyarrow as pa

    monkeypatch.setattr(O, "AT_ONCE", 3)
    base = f"file://{tmp_path}"
    writer = O.ObjectWriter(base, "job")
    batch = lambda *rows: iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "content"])])
    tasks = [writer.write(batch(("k/a", "1"), ("k/b", "1"))), writer.write(batch(("k/b", "2"), ("m/c", "2"), ("k/b", "3")))]
    writer.write(batch(("k/d", "lost")))
    os.makedirs(f"{tmp_path}/k")
    (tmp_path / "k/a").write_text("old")
    writer.commit([tasks[0], None, tasks[1]])
    assert os.listdir(f"{tmp_path}/k") == ["a"] and (tmp_path / "k/a").read_text() == "old" and not os.path.exists(f"{tmp_path}/m")
    left = json.loads((tmp_path / "_waiting/job" / O.NAMED).read_text())
    assert left == {"objects": 5, "folders": [t.folder for t in tasks]}
    for _ in range(2):
        assert O._published(spark, base, left["folders"], left["objects"]) == 3
        assert {f"{p}/{f}": (tmp_path / p / f).read_text() for p in "km" for f in os.listdir(tmp_path / p)} == {"k/a": "1", "k/b": "3", "m/c": "2"}
    O.clear(*O.opened(base), "job")
    assert sorted(os.listdir(tmp_path)) == ["k", "m"]
    n = 10_500
    FS.write_objects(spark.range(0, n, 1, 3).selectExpr("concat('n', id % 2, '/', id, '.txt') key", "concat('text ', id) content"), base)
    assert FS.listing(spark, base, ".txt").count() == n and (tmp_path / "n1/10499.txt").read_text() == "text 10499" and not os.path.exists(f"{tmp_path}/_waiting")


def test_a_folder_of_many_files_is_left_to_a_task(spark, tmp_path, monkeypatch):
    """Planning looks at a few files of each folder; folders below it that come later are listed with it."""
    base = made(spark, tmp_path, 200)
    seen, entries = [], O.entries
    monkeypatch.setattr(O, "LOOKED_AT", 10)
    monkeypatch.setattr(O, "entries", lambda *a, **k: (seen.append(x) or x for x in entries(*a, **k)))
    parts = O.ObjectReader(base, {}).partitions()
    assert len(parts) == 5 and all(p.deep for p in parts) and len(seen) <= 5 + 5 + 5 * 11
    os.makedirs(f"{tmp_path}/objects/b1/input/below")
    (tmp_path / "objects/b1/input/below/x.txt").write_text("x")
    reader = O.ObjectReader(base, {})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 201


def test_excluded_names_and_bytes_as_they_are(spark, tmp_path):
    """What is excluded isn't read; the digest is of an object's own bytes, whatever its name."""
    base = made(spark, tmp_path, 10)
    (tmp_path / "objects/b1/input/note.gz").write_bytes(b"not packed")
    (tmp_path / "objects/b1/input/skip.txt").write_text("skipped")
    want = {f"n{i}.txt": md5(f"text {i}".encode()).hexdigest() for i in range(10)} | {"note.gz": md5(b"not packed").hexdigest()}
    assert {r.key.rpartition("/")[2]: r.etag for r in FS.listing(spark, base, digests=True, exclude="skip*").collect()} == want
    read, reader = [], O.ObjectReader(base, {"digests": "true", "exclude": "skip*"})
    reader._digest = lambda system, path: read.append(path) or "0"
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(read) == 11


def test_object_listing_removes_on_executors(spark, data, monkeypatch):
    from cloakwork.plans import catalogue

    def never(*_):
        raise AssertionError("objects removed one after the other, on the driver")

    monkeypatch.setattr(FS, "remove_objects", never)
    assert len(catalogue.QUERIES["object_listing"](spark, data).collect()) == 25
