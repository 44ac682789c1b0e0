"""Objects as a Spark data source: a writer that shows nothing until its job commits, and a reader that lists prefixes as partitions.

`spark.dataSource.register(ObjectSource)`, then format `cloakwork_objects`. Paths are URIs that Arrow's file systems reach from every
executor (file, hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import json
import os
import uuid
from functools import lru_cache
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass
from datetime import UTC, datetime
from hashlib import md5

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, IsNotNull, StringEndsWith, StringStartsWith, WriterCommitMessage

FORMAT = "cloakwork_objects"
SCHEMA = "key string, etag string, size long, modified timestamp"
#: Folder below the base in which a job's objects wait; listings leave out what begins with an underscore or a dot.
WAITING = "_waiting"
#: The file in a job's waiting folder that names the tasks' folders, where more objects than these are left to be published on the executors.
NAMED, AT_ONCE = "named", 10_000
#: Prefixes that a listing is split into, about; files of a folder without folders that are looked at before it is left to a task.
PREFIXES, LOOKED_AT = 64, 1000
#: Objects of a batch of rows; those that a task publishes; threads that publish or read.
ROWS, PUBLISHED, THREADS = 2000, 20_000, 16


def opened(base: str) -> tuple[fs.FileSystem, str]:
    """(file system, root) of a base; Hadoop's name for S3 is understood."""
    if "://" not in base and not base.startswith("/"):
        base = base.replace("file:/", "/", 1)
    return fs.FileSystem.from_uri(base.replace("s3a://", "s3://", 1).rstrip("/"))


def _hidden(part: str) -> bool:
    return part.startswith(("_", "."))


@dataclass
class Entry:
    """What a folder holds: a file or a folder; size and time are looked up for files where asked for."""

    path: str
    name: str
    folder: bool
    size: int = 0
    mtime: datetime | None = None


def entries(system: fs.FileSystem, path: str, details: bool = True) -> Iterator[Entry]:
    """What isn't hidden in a folder, none where it isn't there. A local folder is gone through entry by entry, so of any number none is held."""
    if isinstance(system, fs.LocalFileSystem):
        try:
            found = os.scandir(path)
        except FileNotFoundError:
            return
        with found:
            for x in found:
                if _hidden(x.name):
                    continue
                folder = x.is_dir()
                try:
                    at = x.stat() if details and not folder else None
                except FileNotFoundError:  # it went meanwhile
                    continue
                yield Entry(f"{path}/{x.name}", x.name, folder, *((at.st_size, datetime.fromtimestamp(at.st_mtime, UTC)) if at else ()))
        return
    for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if not _hidden(x.base_name):
            yield Entry(x.path, x.base_name, x.type == fs.FileType.Directory, x.size or 0, x.mtime)


@dataclass
class Written(WriterCommitMessage):
    """What a task leaves for the commit: the folder in which its objects and their list wait."""

    folder: str
    objects: int


def at_once(system: fs.FileSystem, f: Callable, items: Sequence) -> list:
    """f of all items, in order; in threads that each take a share of them, but for local files, whose calls are too short for that."""
    if isinstance(system, fs.LocalFileSystem):
        return [f(x) for x in items]
    share = -(-len(items) // THREADS)
    with ThreadPoolExecutor(THREADS) as pool:
        parts = pool.map(lambda at: [f(x) for x in items[at : at + share]], range(0, len(items), share or 1))
        return [x for part in parts for x in part]


def keys_of(system: fs.FileSystem, folder: str) -> list[str]:
    """The keys of an attempt's objects, by their numbers."""
    with system.open_input_stream(f"{folder}/keys") as keys:
        return [json.loads(k) for k in keys.read().splitlines()]


def publish(system: fs.FileSystem, moves: dict[str, str], made: set[str]) -> None:
    """Moves objects to their targets ({target: source}); made are the folders known to be there. One that a task before this one moved is left."""
    for at in {to.rpartition("/")[0] for to in moves} - made:
        system.create_dir(at, recursive=True)
        made.add(at)

    def move(task: tuple[str, str]) -> None:
        to, at = task
        if isinstance(system, fs.LocalFileSystem):
            with suppress(OSError):  # there is one, which a move replaces, or no link can be made
                os.link(at, to)  # moves between folders wait for each other in the whole file system, links don't
                os.unlink(at)
                return
        try:
            system.move(at, to)
        except FileNotFoundError:
            if system.get_file_info(to).type != fs.FileType.File:
                raise

    at_once(system, move, list(moves.items()))


def clear(system: fs.FileSystem, root: str, job: str) -> None:
    at = f"{root}/{WAITING}/{job}"
    if system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_dir(at)
    rest = fs.FileSelector(f"{root}/{WAITING}", allow_not_found=True)
    if system.get_file_info(f"{root}/{WAITING}").type != fs.FileType.NotFound and not system.get_file_info(rest):
        system.delete_dir(f"{root}/{WAITING}")


class ObjectWriter(DataSourceArrowWriter):
    """Writes (key, content) rows below a base.

    Every attempt of a task writes into a folder of its own, objects numbered, with a list of their keys; a message of fixed size tells the
    commit where. The commit moves the objects of the attempts that Spark names to their keys, reading one list after the other; an
    attempt that failed or lost a race is never named. Of a job that its caller named, more than AT_ONCE objects are left to the caller,
    who finds the named attempts in a file (see write_objects). Commit and abort remove the waiting folder. A failed job so shows
    nothing (a task that was still ending then may leave hidden files), and a key that is written again is replaced only at the commit.
    """

    def __init__(self, base: str, job: str | None = None):
        self.base, self.job, self.left = base, job or uuid.uuid4().hex, job is not None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.base)
        folder = f"{root}/{WAITING}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        n = 0
        with system.open_output_stream(f"{folder}/keys") as keys:
            for b in iterator:
                for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not key or any(p in ("", ".", "..") or _hidden(p) for p in key.split("/")):
                        raise ValueError(f"not an object's key: {key!r}")
                    with system.open_output_stream(f"{folder}/{n}") as out:
                        out.write((content or "").encode())
                    keys.write(json.dumps(key).encode() + b"\n")
                    n += 1
        return Written(folder, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = opened(self.base)
        named = [m for m in messages if m is not None and m.objects]
        if self.left and (n := sum(m.objects for m in named)) > AT_ONCE:
            with system.open_output_stream(f"{root}/{WAITING}/{self.job}/{NAMED}") as out:
                out.write(json.dumps({"objects": n, "folders": [m.folder for m in named]}).encode())
            return
        made: set[str] = set()
        for m in named:
            last = {f"{root}/{k}": f"{m.folder}/{i}" for i, k in enumerate(keys_of(system, m.folder))}  # a key that a task wrote twice has its last content
            publish(system, last, made)
        clear(system, root, self.job)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        clear(*opened(self.base), self.job)


@dataclass
class Prefix(InputPartition):
    """A folder to list with all below it, or only its own files."""

    path: str
    deep: bool


class ObjectReader(DataSourceReader):
    """Lists the objects below a base.

    Folders are opened from the top until there are enough of them; each then is a partition, listed where it runs. One that begins with many
    files and no folder isn't gone through to its end before that. A prefix or suffix of keys that a filter asks for is taken over: folders
    outside the prefix are never opened.
    """

    def __init__(self, base: str, options):
        self.base, self.digests = base, str(options.get("digests", "false")).lower() == "true"
        self.starts, self.ends, self.pattern, self.limit = "", [], options.get("pattern"), int(options.get("limit", -1))
        self.exclude = options.get("exclude")
        self.deep = str(options.get("deep", "true")).lower() == "true"

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("key",) and not self.starts:
                self.starts = f.value
            elif isinstance(f, StringEndsWith) and f.attribute == ("key",):
                self.ends.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("key",) and not self.starts:
                self.starts = f.value
                yield f
            elif not (isinstance(f, IsNotNull) and f.attribute == ("key",)):
                yield f

    def _key(self, root: str, path: str) -> str:
        return f"{self.base.rstrip('/')}/{path[len(root) :].lstrip('/')}"

    def _open(self, root: str, path: str) -> bool:
        """Whether objects with the wanted prefix can lie below a folder."""
        key = self._key(root, path) + "/"
        return key.startswith(self.starts) or self.starts.startswith(key)

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.base)
        if system.get_file_info(root).type != fs.FileType.Directory:
            return []
        if not self.deep:
            return [Prefix(root, False)]
        level, done = [root], []
        while level and len(level) < PREFIXES:
            below = []
            for path in level:
                files, folders, inside = 0, False, []
                for x in entries(system, path, details=False):
                    files, folders = files + (not x.folder), folders or x.folder
                    if x.folder and self._open(root, x.path):
                        inside.append(x.path)
                    if files > LOOKED_AT and not folders:
                        done.append(Prefix(path, True))  # with folders that may come yet
                        break
                else:
                    below += inside
                    if files:
                        done.append(Prefix(path, False))
            level = below
        return [*done, *(Prefix(p, True) for p in level)]

    def read(self, partition: Prefix | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no folder to list
            return
        system, root = opened(self.base)
        todo, rows, n = [partition.path], [], 0
        while todo:
            for x in entries(system, todo.pop()):
                if x.folder:
                    if partition.deep and self._open(root, x.path):
                        todo.append(x.path)
                    continue
                key = self._key(root, x.path)
                if not key.startswith(self.starts) or not all(key.endswith(e) for e in self.ends) or (self.pattern and not fnmatch.fnmatchcase(key, self.pattern)):
                    continue
                if self.exclude and fnmatch.fnmatchcase(x.name, self.exclude):
                    continue
                if 0 <= self.limit <= n:
                    todo = []
                    break
                n += 1
                rows.append((key, x.path, x.size, x.mtime))
                if len(rows) == ROWS:
                    yield self._batch(system, rows)
                    rows = []
        if rows:
            yield self._batch(system, rows)

    @staticmethod
    def _digest(system: fs.FileSystem, path: str) -> str:
        found = md5()
        with open(path, "rb", buffering=0) if isinstance(system, fs.LocalFileSystem) else system.open_input_stream(path, compression=None) as content:
            while chunk := content.read(1 << 20):
                found.update(chunk)
        return found.hexdigest()

    def _batch(self, system: fs.FileSystem, rows: list[tuple]) -> pa.RecordBatch:
        keys, paths, sizes, times = zip(*rows, strict=True)
        etags = at_once(system, lambda path: self._digest(system, path), paths) if self.digests else [None] * len(rows)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, etags, sizes, times), kinds, strict=True)], names=["key", "etag", "size", "modified"])


class ObjectSource(DataSource):
    """Reads (key, etag, size, modified) of the objects below `path`, and writes (key, content) rows as objects below it."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ObjectReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ObjectWriter(self.options["path"], self.options.get("job"))


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(ObjectSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_objects(df: DataFrame, base: str, key: str = "key", content: str = "content") -> None:
    """Writes each row as one object below base; all appear when the job has ended well, none where it fails. Null content is an empty object.

    More than AT_ONCE are moved to their keys by a second job, on the executors; of rows with the same key the last task's last one stays.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    _registered(spark)
    df.select(df[key].cast("string").alias("key"), df[content].cast("string").alias("content")).write.format(FORMAT).mode("append").option("job", job).save(base)
    system, root = opened(base)
    named = f"{root}/{WAITING}/{job}/{NAMED}"
    if system.get_file_info(named).type == fs.FileType.NotFound:
        return
    try:
        with system.open_input_stream(named) as f:
            left = json.loads(f.read())
        _published(spark, base, left["folders"], left["objects"])
    finally:
        clear(system, root, job)


def _published(spark: SparkSession, base: str, folders: list[str], objects: int) -> int:
    """Moves the objects of named attempts to their keys, on the executors, and gives how many keys there are. A repeated task does no harm."""

    def named(batches: Iterator[pa.RecordBatch]):
        system, _ = opened(base)
        for b in batches:
            for place, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys = keys_of(system, folder)
                for at in range(0, len(keys), ROWS):
                    part = keys[at : at + ROWS]
                    columns = pa.array(part), pa.array([place] * len(part), pa.int32()), pa.array(range(at, at + len(part)), pa.int64()), pa.array([folder] * len(part))
                    yield pa.RecordBatch.from_arrays([*columns], names=["key", "place", "i", "folder"])

    def moved(batches: Iterator[pa.RecordBatch]):
        (system, root), made, n = opened(base), set(), 0
        for b in batches:
            keys, last = b.column(0).to_pylist(), b.column(1).to_pylist()
            publish(system, {f"{root}/{k}": f"{x['folder']}/{x['i']}" for k, x in zip(keys, last, strict=True)}, made)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    tasks = spark.createDataFrame(list(enumerate(folders)), "place int, folder string").repartition(min(len(folders), -(-objects // PUBLISHED)))
    rows = tasks.mapInArrow(named, "key string, place int, i long, folder string").repartition(-(-objects // PUBLISHED), "key")
    last = rows.groupBy("key").agg(F.max(F.struct("place", "i", "folder")).alias("last"))
    return sum(r.n for r in last.mapInArrow(moved, "n long").collect())


def listing(spark: SparkSession, path: str, suffix: str = "", digests: bool = False, pattern: str | None = None, limit: int | None = None, deep: bool = True, exclude: str | None = None) -> DataFrame:
    """(key, etag, size, modified) of the objects below a folder whose key ends so and fits the pattern; hidden ones aren't objects.

    Objects whose name, the key's last part, fits exclude are left out before any is read.

    etag is the content's MD5, read only where digests are asked for. Filters on the key's beginning or end reach the listing. With a
    limit no partition lists more. A folder that isn't there has no objects. Unless deep, only the folder's own objects are listed.
    """
    _registered(spark)
    rows = spark.read.format(FORMAT).option("digests", str(digests).lower()).option("deep", str(deep).lower())
    if pattern:
        rows = rows.option("pattern", pattern)
    if exclude:
        rows = rows.option("exclude", exclude)
    if limit is not None:
        rows = rows.option("limit", str(limit))
    out = rows.load(path)
    out = out.filter(out.key.endswith(suffix)) if suffix else out
    return out if limit is None else out.limit(limit)


def remove_keys(keys: DataFrame, key: str = "key") -> int:
    """Deletes the objects that a column names by whole URI, on the executors, and gives how many were there.

    Deleting again does nothing, so a task that is repeated does no harm (its objects then count as gone).
    """

    def run(batches: Iterator[pa.RecordBatch]):
        n, folder = 0, lru_cache(1000)(opened)
        for b in batches:
            for uri in b.column(0).to_pylist():
                at, _, name = uri.rpartition("/")
                system, path = folder(at)
                path = f"{path.rstrip('/')}/{name}"
                if system.get_file_info(path).type == fs.FileType.File:
                    system.delete_file(path)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return sum(r.n for r in keys.select(keys[key].cast("string")).filter(f"`{key}` IS NOT NULL").mapInArrow(run, "n long").collect())
