"""Operator 11: phrase collocations from depth-limited count tries, built by shard, serialised sorted and merged by prefix range."""

from __future__ import annotations

import struct
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import cut, small_batches

#: Longest phrase, in words; the depth of the tries.
DEPTH = 4
#: A phrase is a candidate from so many occurrences on.
LEAST = 30
#: A candidate goes if a longer one that holds it has this share of its occurrences, in percent.
HELD = 80
#: Rows of a language in the result.
TOP = 2000
#: Bytes of text from which a shard is built, words of a slice of it, bytes of text for each prefix range.
SHARD_BYTES, SLICE_WORDS, RANGE_BYTES = 8 << 20, 1 << 20, 8 << 20
#: Prefix ranges at most (beyond, they grow), and bytes of text that are looked at to place their borders; the result depends on neither.
RANGES, BORDER_BYTES = 16_384, 16 << 20
#: So many points of those texts reach the driver at most.
BORDER_POINTS = 200_000
#: A border is cut to so many bytes of each word.
BORDER_WORD = 32

# Byte classes: 0 part of a word, 1 blank, 2 end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Border = tuple[bytes, ...]


def _array(lengths: np.ndarray, joined) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])


def _words(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text, A-Z lower-cased, and for each the number of its piece."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    inside = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    return _array(ends - starts, _LOWER[raw[kind == 0]]), np.cumsum(kind == 2, dtype=np.int32)[starts]


def _ranked(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(for each word its place among the different words, from 1, those in byte order)."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return rank[coded.indices.to_numpy()] if len(order) else np.zeros(0, np.int64), coded.dictionary.take(pa.array(order))


def _sorted(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different paths in order, with the sums of their counts. A path is a row of word numbers; 0 stands where it has ended."""
    high, low = paths[:, 0] << 32 | paths[:, 1], paths[:, 2] << 32 | paths[:, 3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return paths[order[first]], np.add.reduceat(counts[order], first)


def _changed(paths: np.ndarray) -> np.ndarray:
    """For each path and depth whether its node there is another than that of the path before."""
    new = np.ones(paths.shape, bool)
    new[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
    return new


def _pack(paths: np.ndarray, counts: np.ndarray, words: pa.Array) -> bytes:
    """A sorted trie: for each path the depth from which it differs, the words from there on, its count; then the words it uses."""
    used = np.unique(paths)
    used = used[used > 0]
    at = np.zeros(len(words) + 1, np.int64)
    at[used] = np.arange(1, len(used) + 1)
    new = _changed(paths)
    own = words.take(pa.array(used - 1))
    ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    text = np.frombuffer(own.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    parts = [x.tobytes() for x in ((DEPTH - new.sum(1)).astype(np.uint8), at[paths[new]].astype(np.uint32), counts.astype(np.uint64), np.diff(ends).astype(np.uint32), text)]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<6Q", len(counts), *map(len, parts)) + b"".join(parts))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(paths, counts, words) of a packed trie."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, *sizes = struct.unpack_from("<6Q", raw)
    ends = 48 + np.cumsum([0, *sizes])
    shared, ids, counts, lengths, text = (raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
    new = np.arange(DEPTH) >= np.frombuffer(shared, np.uint8)[:, None]
    paths = np.zeros((n, DEPTH), np.int64)
    paths[new] = np.frombuffer(ids, np.uint32)
    row = np.maximum.accumulate(np.where(new, np.arange(n)[:, None], 0), axis=0)
    return np.take_along_axis(paths, row, axis=0), np.frombuffer(counts, np.uint64).astype(np.int64), _array(np.frombuffer(lengths, np.uint32), text)


def _tries(text: bytes):
    """(paths, counts, words) of each slice of a shard's text, sorted: every word begins one path, of DEPTH words or up to the end of its piece."""
    words, piece = _words(text)
    for at in range(0, len(words), SLICE_WORDS):
        ids, known = _ranked(words[at : at + SLICE_WORDS + DEPTH - 1])
        n, here = min(SLICE_WORDS, len(words) - at), piece[at : at + len(ids)]
        paths = np.zeros((n, DEPTH), np.int64)
        for k in range(DEPTH):
            m = min(n, len(ids) - k)
            paths[:m, k] = np.where(here[k : k + m] == here[:m], ids[k : k + m], 0)
        yield *_sorted(paths, np.ones(n, np.int64)), known


def _cuts(paths: np.ndarray, words: pa.Array, borders: list[Border]) -> np.ndarray:
    """Before which sorted path each border stands."""
    known = words.to_pylist()
    key = paths[:, 0] << 42 | paths[:, 1] << 21 | paths[:, 2]
    at = []
    for border in borders:
        k = 0
        for depth, word in enumerate(border):
            i = bisect_left(known, word)
            k |= (i + 1 if word else 0) << 21 * (2 - depth)
            if word and (i == len(known) or known[i] != word):
                break
        at.append(k)
    return np.searchsorted(key, np.array(at, np.int64))


def _borders(docs: DataFrame) -> dict[str, list[Border]]:
    """By language the paths between which prefix ranges lie, from a look at some texts; they only balance the work."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(RANGES, -(-total // RANGE_BYTES))
    if ranges < 2:
        return {}
    share = min(1.0, BORDER_BYTES / total)
    step = max(1, int(total * share / 6) // min(BORDER_POINTS, ranges * 256))  # words between two points, at about six bytes a word

    def look(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, piece = _words(text.encode())
                at = np.arange(len(text) % step, len(words), step)
                rows = [[lang, *((words[int(i + k)].as_py()[:BORDER_WORD] if i + k < len(words) and piece[i + k] == piece[i] else b"") for k in range(3))] for i in at]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.binary()] * 3), strict=True)], names=["lang", "a", "b", "c"])

    points = sorted((r.lang, bytes(r.a), bytes(r.b), bytes(r.c)) for r in docs.sample(share, 7).mapInArrow(look, "lang string, a binary, b binary, c binary").collect())
    found: dict[str, list[Border]] = {}
    for lang, *path in sorted({points[len(points) * i // ranges] for i in range(1, ranges)}) if points else []:
        found.setdefault(lang, []).append(tuple(path))
    return found


def nodes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words array, f): the nodes of the corpus trie with f >= least, and the root (no words) of each language.

    docs: lang and text, neither null. Each task turns its texts into sorted tries of a bounded size and cuts them at the borders
    of prefix ranges; a range merges what all shards have of it. A path leaves a shard once, however often it occurs, so a very
    common word or phrase is one entry of each shard. Nodes that lie across a border are summed afterwards.
    """
    small_batches(docs.sparkSession)
    borders = _borders(docs)

    def shard(batches):
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush():
            for lang, texts in held.items():
                for paths, counts, words in _tries(b"\n".join(texts)):
                    ends = [*_cuts(paths, words, borders.get(lang, [])), len(paths)]
                    begin = 0
                    rows = []
                    for slot, end in enumerate(ends):
                        if end > begin:
                            rows.append((slot, _pack(paths[begin:end], counts[begin:end], words)))
                            begin = end
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "slot", "trie"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= SHARD_BYTES:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    def merge(group: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in group.column("trie").to_pylist()]
        words, known = _ranked(pa.concat_arrays([p[2] for p in parts]))
        paths, at = [], 0
        for p, _, own in parts:
            paths.append(np.concatenate([[0], words[at : at + len(own)]])[p])
            at += len(own)
        paths, counts = _sorted(np.concatenate(paths), np.concatenate([p[1] for p in parts]))
        new = _changed(paths)
        known = known.cast(pa.large_string())
        found, f = [pa.array([[]], pa.list_(pa.string()))], [np.array([counts.sum()])]
        for d in range(1, DEPTH + 1):
            first = np.flatnonzero(new[:, d - 1])
            n = np.add.reduceat(counts, first)
            keep = n >= least
            keep[[0, -1]] = True  # the first and last node of a depth may go on in the range beside
            keep &= paths[first, d - 1] > 0
            ids = paths[first[keep], :d].ravel() - 1
            found.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1, d), pa.int32()), known.take(pa.array(ids)).cast(pa.string())))
            f.append(n[keep])
        f = np.concatenate(f)
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(f), pa.string()), "words": pa.concat_arrays(found), "f": pa.array(f, pa.int64())})

    tries = docs.select("lang", "text").mapInArrow(shard, "lang string, slot int, trie binary")
    parts = tries.groupBy("lang", "slot").applyInArrow(merge, "lang string, words array<string>, f long")
    return parts.groupBy("lang", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.size("words") == 0))


def left_parts(trie: DataFrame) -> DataFrame:
    """trie with `lefts`: the counts of a node's ancestors, root first, by a walk over the nodes in order of their paths.

    The nodes are range-sorted over all tasks; what a task needs from before its first node are the ancestors that stand there,
    at most DEPTH, which the driver passes from task to task (a few numbers for each).
    """
    held = cut(trie.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words"))
    names = ["lang", "words", "f"]

    def walk(batches, spine: list):
        """spine: (word, f) from the root on; its first word is the language. It is moved along."""
        for b in batches:
            lefts = []
            for lang, words, f in zip(*(b.column(names.index(c)).to_pylist() for c in names), strict=True):
                path = [lang, *words]
                del spine[len(path) - 1 :]
                while [w for w, _ in spine] != path[: len(spine)]:
                    spine.pop()
                lefts.append([n for _, n in spine])
                spine += [(w, None) for w in path[len(spine) : -1]]
                spine.append((path[-1], f))
            yield b, lefts

    def spines(batches):
        from pyspark import TaskContext

        spine: list = []
        for _ in walk(batches, spine):
            pass
        if spine:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "words": [w for w, _ in spine], "f": [n for _, n in spine]}], pa.schema([("part", pa.int32()), ("words", pa.list_(pa.string())), ("f", pa.list_(pa.int64()))]))

    rows = held.select(*names)
    before: dict[int, list] = {}
    spine: list = []
    for r in sorted(rows.mapInArrow(spines, "part int, words array<string>, f array<long>").collect()):
        before[r.part] = spine
        own = list(zip(r.words, r.f, strict=True))
        for i, (w, n) in enumerate(own):  # what the task didn't see itself stands in the spine before it
            if n is None and [x for x, _ in spine[: i + 1]] == [x for x, _ in own[: i + 1]]:
                own[i] = (w, spine[i][1])
        spine = own

    def fill(batches):
        from pyspark import TaskContext

        for b, lefts in walk(batches, list(before.get(TaskContext.get().partitionId(), []))):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lefts, pa.list_(pa.int64()))], names=[*names, "lefts"])

    return rows.mapInArrow(fill, "lang string, words array<string>, f long, lefts array<long>")


def right_parts(trie: DataFrame) -> DataFrame:
    """trie (with lefts) with `rights`: for each cut after k words the count of the rest, along suffix links: a node's link is the node
    without its first word, so its rights are the link's count and then the link's own rights."""
    done = trie.filter(F.size("words") == 1).withColumn("rights", F.array().cast("array<long>"))
    found = []
    for depth in range(2, DEPTH + 1):
        link = done.select("lang", F.col("words").alias("link"), F.concat(F.array("f"), "rights").alias("rights"))
        rows = trie.filter(F.size("words") == depth).withColumn("link", F.slice("words", 2, depth - 1))
        done = rows.join(link, ["lang", "link"]).drop("link")
        found.append(done)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, held: int = HELD, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by the score of their lowest-scoring cut.

    Words are cut at blanks, pieces at `.,;:!?` and line ends; a phrase never leaves its piece. Null text counts as empty, null lang
    as `und`; whole texts are counted, repeated rows each. A candidate that a longer phrase explains (held percent of its occurrences)
    is left out. Ties go by a, then by the phrase's bytes. An empty table gives no rows; other columns are not read. All counts
    are exact; the arithmetic is in decimals, since products may pass 64 bits.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trie = cut(left_parts(cut(nodes(texts, least))))
    cuts = cut(right_parts(trie))
    longer = cuts.filter(F.size("words") > 2).withColumn("sub", F.expr("flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))"))
    most = longer.select("lang", F.explode("sub").alias("words"), F.col("f").alias("longer")).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = cuts.join(most, ["lang", "words"], "left").filter(f"longer IS NULL OR CAST(longer AS decimal(19,0)) * 100 < CAST(f AS decimal(19,0)) * {held}")
    best = F.expr(
        "array_min(transform(rights, (r, i) -> struct("
        " (CAST(2000000 AS decimal(7,0)) * CAST(f AS decimal(19,0))) DIV (CAST(lefts[i + 1] AS decimal(19,0)) + CAST(r AS decimal(19,0))) AS score, i AS k, lefts[i + 1] AS l, r AS r)))"
    )
    scored = kept.withColumn("best", best).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", F.element_at("lefts", 1).alias("n"), "best.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over all documents: phrases of 2 to 4 words that occur 30 times or more, 2000 a language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS p FROM lists, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, p, f, string_split(p, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), sub AS (
  SELECT lang, f, unnest(list_concat(
    list_transform(range(1, k), lambda i: array_to_string(list_slice(w, i, i + 1), ' ')),
    CASE WHEN k = 4 THEN list_transform(range(1, 3), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) ELSE [] END)) AS p
  FROM cand WHERE k > 2
), longer AS (
  SELECT lang, p, max(f) AS f FROM sub GROUP BY ALL
), kept AS (
  SELECT c.* FROM cand c LEFT JOIN longer s USING (lang, p) WHERE s.f IS NULL OR CAST(s.f AS HUGEINT) * 100 < CAST(c.f AS HUGEINT) * 80
), cuts AS (
  SELECT lang, k, p, f, j, array_to_string(list_slice(w, 1, j), ' ') AS lp, array_to_string(list_slice(w, j + 1, k), ' ') AS rp FROM kept, (VALUES (1), (2), (3)) AS js(j) WHERE j < k
), scored AS (
  SELECT c.lang, c.p AS phrase, c.f AS a, c.j, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.f) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.lp JOIN f y ON y.lang = c.lang AND y.p = c.rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang)
) WHERE rank <= 2000
"""
