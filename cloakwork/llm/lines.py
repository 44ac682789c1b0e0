"""Operator 6: line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import attach, cut, forget, small_batches
from .similar import mix

#: Lines of the shortest run that counts as repeated.
LEAST_LINES = 2
#: A line of so many words, parted by blanks, is content: it counts as repeated alone as well.
CONTENT_WORDS = 5
#: Letters of scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han): two of them count as a word.
NO_BLANKS = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Up to this many texts are broadcast by their hashes; beyond, both sides are shuffled.
BROADCAST_TEXTS = 500_000
#: Up to this many deleted lines their numbers are broadcast to the texts; beyond, both are shuffled by document.
BROADCAST_LINES = 1_000_000
SPLIT = "\n"
SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
#: Lines of these only are blank.
BLANKS = " \t\n\x0b\f\r"
#: What a tidy text holds none of: two blanks in a row or any blank but U+0020 and line ends. In UTF-8; of those from U+2000 on by their first two bytes.
UNTIDY = tuple(c.encode() for c in ("  ", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f"))
UNTIDY_WIDE = *(c.encode() for c in "\x85\xa0\u1680\u205f\u3000"), b"\xe2\x80"
ADDED = {"n_lines": T.IntegerType(), "n_dropped": T.IntegerType(), "dropped_lines": T.ArrayType(T.IntegerType()), "longest_run": T.IntegerType()}


def _content(line: str) -> bool:
    words = len(line.split(None, CONTENT_WORDS - 1))  # no more of the line is split than it takes
    return words >= CONTENT_WORDS or not line.isascii() and words + len(NO_BLANKS.findall(line)) // 2 >= CONTENT_WORDS


def _plain(text: str | None, content: bool) -> tuple[list[bytes], list[bool]]:
    """A text's lines without blank ones, each without outer and repeated blanks, in UTF-8, and where asked for whether each is content.

    Lines of tidy texts are so already, which is seen without splitting them into words.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not any(x in raw for x in UNTIDY) and (raw.isascii() or not any(x in raw for x in UNTIDY_WIDE)):
        lines = [x for x in raw.split(b"\n") if x]
        if not any(x[0] == 32 or x[-1] == 32 for x in lines):
            ascii_ = raw.isascii()
            return lines, [len(x.split(b" ", CONTENT_WORDS - 1)) >= CONTENT_WORDS or not ascii_ and _content(x.decode("utf-8", "surrogatepass")) for x in lines] if content else []
    full = [x for x in (text or "").split(SPLIT) if x.strip(BLANKS)]
    return [" ".join(x.split()).encode("utf-8", "surrogatepass") for x in full], [_content(x) for x in full] if content else []


def _lines(texts: list[str | None], content: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of a batch of texts one after the other, without blank ones: IDs, whether they are content (where asked for), and of each text the first one's number and how many it has.

    A line's ID: two 64-bit numbers of a hash of it without outer and repeated blanks.
    """
    hashed, long, n = [], [], []
    for text in texts:
        lines, c = _plain(text, content)
        hashed += map(xxhash.xxh3_128_digest, lines)
        long += c
        n.append(len(lines))
    n = np.array(n, np.int64)
    return np.frombuffer(b"".join(hashed), np.uint64).reshape(-1, 2), np.array(long, bool), np.cumsum(n) - n, n


def _window(name: np.ndarray, least: int) -> np.ndarray:
    """Names of the first `least` lines of each suffix."""
    w = 1
    while w < least and len(name):
        step = min(w, least - w)  # the last two windows may overlap
        name, w = _double(name, step), w + step
    return name


def _double(name: np.ndarray, step: int) -> np.ndarray:
    """The names at k and k + step, paired, for each k that has both."""
    x, y = name[: max(0, len(name) - step)], name[step:]
    return mix(x * SALT[0] + mix(y) * SALT[1] + SALT[2:])


def beside(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows with groups' columns, null where there is no group; groups (cut) are broadcast where their count allows it, else see attach."""
    return rows.join(F.broadcast(groups), key, "left") if groups.count() <= BROADCAST_TEXTS else attach(rows, groups, key, count)


def copies(docs: DataFrame) -> DataFrame:
    """(h, lead, ids, rows), cut: the texts (by hash) that several rows hold, the first id of each, its different ids and its rows."""
    by = docs.groupBy("id", "h").agg(F.count("*").alias("n"))
    lead = F.min(F.struct(F.col("id").isNotNull().alias("named"), "id"))
    return cut(by.groupBy("h").agg(lead.alias("lead"), F.count("*").alias("ids"), F.sum("n").alias("rows")).filter("rows > 1").select("h", F.col("lead.id").alias("lead"), "ids", "rows"))


def originals(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """(id, h, text): one row for each text with a line, in its first id."""
    rows = beside(docs.filter("text IS NOT NULL"), copied, "h", "rows")
    once = rows.filter("rows IS NULL").select("id", "h", "text")
    more = rows.filter("rows IS NOT NULL").groupBy("h").agg(F.first("text").alias("text")).join(copied.select("h", F.col("lead").alias("id")), "h")
    return once.unionByName(more.select("id", "h", "text"))


def windows(docs: DataFrame, kind: str, least: int) -> DataFrame:
    """(id, h, k, w, first), cut: the windows of w lines that stand elsewhere as well; first is the first place (id, h, k) of each.

    w is `least`, or 1 for lines that are content. A document is its sequence of line IDs without blank lines; k counts those. Its
    names are doubled within the document; equal names over all documents come from one grouped minimum.
    """

    def run(batches):
        for b in batches:
            ids, content, first, n = _lines(b.column(2).to_pylist(), least > 1)
            if not len(ids):
                continue
            # the texts of a batch are doubled together: windows that reach into the next text are left out
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(ids)) - first[row]
            wide = np.flatnonzero(k + least <= n[row])
            content = np.flatnonzero(content)
            at, name = np.concatenate([wide, content]), np.concatenate([_window(ids, least)[wide], ids[content]]).view(np.int64)
            take, width = pa.array(row[at]), np.concatenate([np.full(len(wide), least, np.int32), np.ones(len(content), np.int32)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(k[at].astype(np.int32)), pa.array(width), pa.array(np.ascontiguousarray(name[:, 0])), pa.array(np.ascontiguousarray(name[:, 1]))],
                names=["id", "h", "k", "w", "x", "y"],
            )

    named = F.struct("x", "y").alias("name")
    rows = cut(docs.mapInArrow(_merged(run), f"id {kind}, h long, k int, w int, x long, y long"))
    place = F.struct(F.col("id").isNotNull().alias("named"), "id", "h", "k")
    tied = cut(rows.groupBy(named).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"))
    out = cut(attach(rows.select("id", "h", "k", "w", named), tied, "name", "n", "inner").select("id", "h", "k", "w", "first"))
    forget(rows, tied)
    return out


def longest(docs: DataFrame, active: DataFrame) -> DataFrame:
    """(h, longest): lines of the longest run that begins at one of a text's later places and stands elsewhere too.

    docs: (h, text), active: (h, k, later), the suffixes whose first lines stand elsewhere as well. Prefix doubling: each document
    names 1, 2, 4 ... lines of its suffixes, and classes of equal names, the LCP intervals of that depth, are counted over all documents.
    A suffix after a later one, in a class whose suffixes all follow the same line, is part of a longer run and is left out; of the
    rest only a text's deepest later suffixes can begin its longest run. Those, and one suffix of each class twice as deep, are sorted, beyond the D lines
    that a class shares, by the next D lines: the suffix array of what is left. The longest common prefix with the
    neighbours in that order is the exact length. A text's lines sent are fewer than its longest run, for each run that can't grow
    to the left. Classes of any size are split by the sort; of each task its first and last row come to the driver.
    """

    def levels(batches):
        for b in batches:
            ids, _, first, n = _lines(b.column(1).to_pylist())
            row, k, later = _places(b.column(2), "k", "later")
            at, h = first[row] + k, b.column(0).to_numpy()[row]
            after = np.zeros(len(ids) + 1, bool)
            after[at[later] + 1] = True
            follows, left = after[at] & (k > 0), n[row] - k
            name, w, level = ids, 1, 0
            while len(k):
                prev = pa.array(ids[at - 1, 0].view(np.int64), mask=k == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(k), pa.array(later & follows), pa.array(later), prev, pa.array(np.full(len(k), level, np.int32)), pa.array(name[at, 0].view(np.int64)), pa.array(name[at, 1].view(np.int64))],
                    names=["h", "k", "follows", "later", "prev", "level", "x", "y"],
                )
                name, w, level = _double(name, w), 2 * w, level + 1
                keep = left >= w  # names that reach into the next text are never looked at
                h, k, at, left, later, follows = (x[keep] for x in (h, k, at, left, later, follows))

    def keys(batches):
        for b in batches:
            ids, _, first, n = _lines(b.column(1).to_pylist())
            row, k, level, named, wanted = _places(b.column(2), "k", "level", "class", "wanted")
            ids, d = ids[:, 0].astype(">u8").tobytes(), 1 << level
            heads = np.stack([named.field("x").to_numpy(), named.field("y").to_numpy()], 1).astype(">i8").tobytes()
            begin, end = first[row] + k + d, first[row] + np.minimum(k + 2 * d, n[row])
            key = [heads[16 * i : 16 * i + 16] + ids[8 * x : 8 * y] for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(b.column(0).to_numpy()[row]), pa.array(k), pa.array(d), pa.array(wanted)], names=["key", "h", "k", "d", "wanted"])

    def ends(batches):
        from pyspark import TaskContext

        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or (b.column(0)[0].as_py(),)
                last = b.column(0)[b.num_rows - 1].as_py()
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first[0]]), pa.array([last])], names=["part", "first", "last"])

    small_batches(docs.sparkSession, 200)
    places = active.groupBy("h").agg(F.collect_list(F.struct("k", "later")).alias("places"))
    deep = cut(_texts(docs, places).mapInArrow(_merged(levels), "h long, k int, follows boolean, later boolean, prev long, level int, x long, y long"))
    name = F.struct("level", "x", "y").alias("name")
    left = (F.count("prev") < F.count("*")) | (F.min("prev") < F.max("prev"))
    tied = cut(deep.groupBy(name).agg(F.count("*").alias("n"), F.min(F.xxhash64("h", "k")).alias("one"), left.alias("left")).filter("n > 1"))
    met = attach(deep.select("h", "k", "follows", "later", name), tied, "name", "n", "inner")
    met = met.groupBy("h", "k").agg(F.first("later").alias("later"), F.first("follows").alias("follows"), F.array_sort(F.collect_list(F.struct("name", "left", (F.col("one") == F.xxhash64("h", "k")).alias("one")))).alias("met"))
    met = cut(met.withColumn("deepest", F.element_at("met", -1)))
    most = met.filter("later").groupBy("h").agg(F.max("deepest.name.level").alias("most"))
    met = met.join(most, "h", "left").withColumn("wanted", F.coalesce(F.expr("later AND (deepest.left OR NOT follows) AND deepest.name.level = most"), F.lit(False)))
    ones = F.expr("transform(sequence(1, size(met)), i -> CASE WHEN i > 1 AND met[i - 1].one THEN struct(met[i - 2].name AS name, false AS wanted) END)")
    own = F.array(F.struct("deepest.name", F.col("wanted").alias("wanted")))
    rows = cut(met.select("h", "k", F.explode(F.array_compact(F.concat(own, ones))).alias("p")).select("h", "k", "p.name", "p.wanted"))
    known = cut(rows.filter("wanted").select("name").distinct())
    rows = rows.join(F.broadcast(known) if known.count() <= BROADCAST_TEXTS else known, "name", "left_semi")
    places = rows.groupBy("h").agg(F.collect_list(F.struct("k", "name.level", F.struct("name.x", "name.y").alias("class"), "wanted")).alias("places"))
    order = cut(_texts(docs, places).mapInArrow(_merged(keys), "key binary, h long, k int, d int, wanted boolean").orderBy("key", "h", "k"))
    parts, before, after = sorted(order.mapInArrow(ends, "part int, first binary, last binary").collect()), {}, {}
    for p, q in zip(parts, parts[1:], strict=False):
        before[q.part], after[p.part] = bytes(p.last), bytes(q.first)
    borders = docs.sparkSession.sparkContext.broadcast((before, after))

    def exact(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        prior, held, first = borders.value[0].get(part), None, True
        for b in batches:
            out = []
            for key, h, d, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                shared = _shared(prior, key)
                if held is not None and held[2]:
                    out.append((held[0], held[1] + max(held[3], shared)))
                held, prior, first = (h, d, wanted, shared), key, False
            yield _pairs(out)
        if held is not None and held[2]:
            yield _pairs([(held[0], held[1] + max(held[3], _shared(prior, borders.value[1].get(part))))])

    return order.mapInArrow(exact, "h long, longest int").groupBy("h").agg(F.max("longest").alias("longest"))


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())], names=["h", "longest"])


def _places(lists: pa.ListArray, *fields: str) -> tuple:
    """Of lists of structs, for each struct the row of its list and its fields; those that are structs stay in Arrow."""
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return row, *(c if pa.types.is_struct(c.type) else c.to_numpy(zero_copy_only=False) for c in map(flat.field, fields))


def _shared(x: bytes | None, y: bytes | None) -> int:
    """Lines that two rows of one class share beyond the class's own; 0 in different classes."""
    if x is None or y is None or x[:16] != y[:16]:
        return 0
    n = min(len(x), len(y)) // 8
    differ = np.flatnonzero(np.frombuffer(x, ">u8", n) != np.frombuffer(y, ">u8", n))
    return (int(differ[0]) if len(differ) else n) - 2


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(h, text, places) of the texts with places: a broadcast where their count allows it."""
    places = cut(places)
    return docs.select("h", "text").join(F.broadcast(places) if places.count() <= BROADCAST_TEXTS else places, "h").select("h", "text", "places")


def _merged(run):
    """run with its small batches merged."""

    def merged(batches):
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


def repeats(docs: DataFrame, kind: str, copied: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """(h, dropped, longest): for each text with later copies of runs the numbers (among its nonblank lines) of those to delete.

    A run of `least` lines, or a line that is content, that began at an earlier place deletes its lines, but for lines that are
    part of that earlier place itself (a run that overlaps its own first copy); the union over all runs are the maximal
    repeated runs. A text that stands elsewhere as a whole, too, shares all its lines from any place on.
    """
    texts = originals(docs, copied)
    runs = windows(texts, kind, least)
    same = F.col("h") == F.col("first.h")
    runs = runs.withColumn("later", ~(same & (F.col("k") == F.col("first.k"))))
    begin = F.when(same, F.greatest(F.col("k"), F.col("first.k") + F.col("w"))).otherwise(F.col("k"))
    gone = runs.filter("later").select("h", F.explode(F.sequence(begin, F.col("k") + F.col("w") - 1)).alias("line"), "k")
    gone = gone.groupBy("h").agg(F.array_sort(F.collect_set("line")).alias("dropped"), F.min("k").alias("from"))
    deep = longest(texts, runs.groupBy("h", "k").agg(F.max("later").alias("later"), F.max("w").alias("w")))
    return gone.join(deep, "h", "left")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LINES) -> DataFrame:
    """df's rows and columns with text cleaned, and n_lines, n_dropped, dropped_lines, longest_run added.

    Later copies of repeated runs are deleted, the first in the order of (id, text hash, place) stays. dropped_lines holds the
    numbers of the deleted lines, from 0, blank ones counted. Blank lines are never deleted nor part of a run. Null text
    stays null and has no lines. Rows that repeat both id and text are one document: they share one result, and don't repeat
    each other. Null ids come first. Very long texts are cleaned whole. Columns of df named like the added ones are
    replaced, no others clash. Empty tables give no rows.

    Equal texts are searched once, as the first id's; the others lose every line that counts, without a search.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    small_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    copied = copies(docs.filter("text IS NOT NULL").select("id", "h"))
    found = cut(repeats(docs, kind, copied, least)).withColumnsRenamed({"h": "__key", "dropped": "__dropped", "from": "__from", "longest": "__longest"})
    names = [c for c in df.columns if c not in ADDED]
    kinds = T.StructType([T.StructField(c, T.StringType() if c == text_col else df.schema[c].dataType) for c in names] + [T.StructField(c, t) for c, t in ADDED.items()])
    where = names.index(text_col)
    # the columns go by number, so no name of theirs clashes
    rows = df.select(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") if i == where else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    rows = beside(rows.withColumn("__key", F.xxhash64(f"c{where}")), copied.select(F.col("h").alias("__key"), F.col("lead").alias("__lead"), F.col("ids").alias("__ids"), F.col("rows").alias("__rows")), "__key", "__rows")
    rows = rows.withColumn("__copy", F.col("__rows").isNotNull() & ~F.col(f"c{names.index(id_col)}").eqNullSafe(F.col("__lead")))
    # a copy needs no more than its own lines, so however many there are, only first ids are looked up
    key = F.when(~F.col("__copy"), F.col("__key")).alias("__key")
    found = F.broadcast(found) if (found.agg(F.sum(F.size("__dropped"))).first()[0] or 0) <= BROADCAST_LINES else found
    out = rows.withColumn("__key", F.coalesce(key, F.lit(None))).join(found, "__key", "left")

    def clean(batches):
        n = len(names)
        for b in batches:
            texts, more = [], ([], [], [], [])
            for text, copy, ids, dropped, begin, run in zip(*(b.column(i).to_pylist() for i in (where, *range(n, n + 5))), strict=True):
                lines = [] if text is None else text.split(SPLIT)
                gone = []
                if copy or dropped:
                    full = [i for i, x in enumerate(lines) if x.strip(BLANKS)]
                    if copy:
                        dropped = range(len(full)) if len(full) >= least else [k for k, i in enumerate(full) if _content(lines[i])]
                        run = len(full) - dropped[0] if dropped else 0
                    elif (ids or 1) > 1:
                        run = max(run or 0, len(full) - begin)
                    gone = [full[k] for k in dropped]
                    out = set(gone)
                    text = SPLIT.join(x for i, x in enumerate(lines) if i not in out)
                texts.append(text)
                for x, v in zip(more, (len(lines), len(gone), gone, (run or 0) if gone else 0), strict=True):
                    x.append(v)
            own = [pa.array(texts, pa.string()) if i == where else b.column(i) for i in range(n)]
            added = [pa.array(x, t) for x, t in zip(more, (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(own + added, names=names + list(ADDED))

    small_batches(spark)
    return out.select(*(f"c{i}" for i in range(len(names))), "__copy", "__ids", "__dropped", "__from", "__longest").mapInArrow(clean, kinds)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: `dedup_lines` over the whole table `documents`, its cleaned text as a digest; see there for nulls, ties and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_lines(docs.select("doc_id", "text"))
    dropped = F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped_lines")
    return out.select("doc_id", "n_lines", "n_dropped", dropped, "longest_run", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+') AS ws, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k
  FROM t WHERE regexp_matches(line, '[^ \x09-\x0d]')),
q AS (SELECT doc_id, i, k, array_to_string(ws, ' ') AS id,
  len(ws) + len(regexp_extract_all(line, '[\x{e01}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3041}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]')) // 2 >= 5 AS content FROM f),
v AS (SELECT doc_id, k, 2 AS w, id || chr(10) || lead(id) OVER (PARTITION BY doc_id ORDER BY k) AS name FROM q UNION ALL SELECT doc_id, k, 1, id FROM q WHERE content),
o AS (SELECT w, name, min(row(doc_id, k)) AS first, count(*) AS n FROM v WHERE name IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
a AS (SELECT v.doc_id, v.k, v.w, CASE WHEN o.first[1] = v.doc_id THEN greatest(v.k, o.first[2] + v.w) ELSE v.k END AS begin FROM v JOIN o USING (w, name) WHERE row(v.doc_id, v.k) <> o.first),
g AS (SELECT DISTINCT doc_id, unnest(range(begin, k + w)) AS k FROM a),
x AS (SELECT doc_id, list(i ORDER BY i) AS gone FROM g JOIN q USING (doc_id, k) GROUP BY doc_id),
m AS (SELECT y.doc_id, y.k, z.doc_id AS other, y.k - z.k AS diagonal FROM q y JOIN q z ON y.id = z.id AND (y.doc_id <> z.doc_id OR y.k <> z.k) WHERE y.doc_id IN (SELECT doc_id FROM a)),
r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY k) AS run FROM m),
l AS (SELECT doc_id, k, max(upto) - k + 1 AS lcp FROM (SELECT *, max(k) OVER (PARTITION BY doc_id, other, diagonal, run) AS upto FROM r) GROUP BY doc_id, k),
b AS (SELECT doc_id, max(lcp) AS longest FROM l JOIN (SELECT DISTINCT doc_id, k FROM a) USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_dropped, coalesce(array_to_string(gone, ','), '') AS dropped_lines, coalesce(longest, 0)::INT AS longest_run,
sha256(coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s, j: CASE WHEN list_contains(coalesce(gone, []), j - 1) THEN NULL ELSE s END), lambda s: s IS NOT NULL), chr(10)), '')) AS clean_sha256
FROM documents d LEFT JOIN x USING (doc_id) LEFT JOIN b USING (doc_id)
"""
