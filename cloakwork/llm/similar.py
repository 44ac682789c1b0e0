"""Word shingles, MinHash keys, and verified links between texts that share a key. Used by operators 7 and 10."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import attach, components, cut, forget, small_batches

#: Words of a shingle, and the least Jaccard similarity of a link.
WORDS, SIMILAR = 5, 0.8
#: Code points hashed at once.
SLICE = 1 << 19
#: Members of a group that one task compares with as many others, and bytes of their sets.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Up to this many rows a checked side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
U = np.uint64
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * MIX1
    h = (h ^ (h >> U(27))) * MIX2
    return h ^ (h >> U(31))


def _odd(k: int) -> np.uint64:
    """A constant for each odd k."""
    return U(k * int(MIX2) % (1 << 64))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a code point belongs to a word; powers of the base and of its inverse modulo 2**64."""
    word = np.array([chr(c).isalnum() for c in range(0x110000)])
    power = lambda b: np.cumprod(np.concatenate([[U(1)], np.full(SLICE + 1, b, U)]), dtype=U)
    return word, power(U(BASE)), power(U(pow(BASE, -1, 1 << 64)))


def _slices(text: str):
    """Slices of at most SLICE code points, cut at blanks where there are any."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            blank = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = blank if blank > at else end
        yield text[at:end]
        at = end


def _hash_words(s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of one slice, as it is."""
    table, power, inverse = _tables()
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], table[c], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate([[U(0)], np.cumsum((c.astype(U) + U(1)) * power[: len(c)], dtype=U)])
    return mix((sums[end] - sums[start]) * inverse[start]), start, end


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """For each text the hashes of its words: runs of letters and digits, lower-cased. Texts are hashed together, SLICE at a time."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, str]] = []
    size = 0

    def flush():
        joined = "\n".join(s for _, s in held)
        h, start, _ = _hash_words(joined)
        ends = np.cumsum([len(s) + 1 for _, s in held])
        for (k, _), part in zip(held, np.split(h, np.searchsorted(start, ends[:-1])), strict=True):
            out[k].append(part)

    for k, text in enumerate(texts):
        for raw in _slices(text or ""):
            for s in _slices(raw.lower()):  # lower-casing may lengthen
                if held and size + len(s) + 1 > SLICE:
                    flush()
                    held, size = [], 0
                held.append((k, s))
                size += len(s) + 1
    if held:
        flush()
    return [np.concatenate(x) if x else np.zeros(0, U) for x in out]


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of n words; a text of fewer words has one shingle of all its words, an empty one none."""
    if not len(words):
        return words
    m = min(n, len(words))
    h = np.full(len(words) - m + 1, U(m))
    for k in range(m):
        h = h * U(BASE) + words[k : len(words) - m + 1 + k] * _odd(2 * k + 1)
    return np.unique(mix(h))


def digest(s: np.ndarray) -> bytes:
    """The set's name: 16 bytes that equal sets share."""
    return xxhash.xxh3_128_digest(s.tobytes())


class Keys:
    """`trees` keys for each set, each of `depth` MinHash values; sets of similarity s share one with probability 1 - (1 - s**depth)**trees."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.a = rng.integers(0, 1 << 63, trees * depth, dtype=U) * U(2) + U(1)
        self.r = rng.integers(0, 1 << 63, trees * depth, dtype=U)

    def recall(self, s: float = SIMILAR, depth: int | None = None) -> float:
        return 1 - (1 - s ** (depth or self.depth)) ** self.trees

    def _least(self, sets: list[np.ndarray]):
        """(from, to, tree, place, least hash of each set) for slices of the sets. Every set has a shingle."""
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= SLICE >> 1):
                size += len(sets[end])
                end += 1
            h, first = np.concatenate(sets[at:end]), np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
            for k in range(self.trees * self.depth):
                yield at, end, k // self.depth, k % self.depth, np.minimum.reduceat((h ^ self.r[k]) * self.a[k], first)
            at = end

    def bands(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets x trees) keys, each made of all `depth` values of a tree."""
        out = np.empty((len(sets), self.trees), U)
        for at, end, t, k, low in self._least(sets):
            out[at:end, t] = mix((out[at:end, t] if k else _odd(2 * t + 1)) ^ low)
        return out

    def labels(self, sets: list[np.ndarray]) -> list[bytes]:
        """For each set and tree `depth` tokens of one byte, one for each value: the label under which the tree holds the set."""
        out = np.empty((len(sets), self.trees, self.depth), np.uint8)
        for at, end, t, k, low in self._least(sets):
            out[at:end, t, k] = mix(low) >> U(56)
        return [x.tobytes() for x in out]


def runs(nodes: DataFrame, trees: int, width: int, levels: list[int]) -> DataFrame:
    """(node, tree, depth, top, local): the groups of two or more nodes whose labels share a prefix of `depth` tokens. Cut.

    nodes: (node long, labels binary), cut; of each tree a label of max(levels) tokens of `width` bytes. All labels are sorted
    by (tree, label) over the executors, so each tree is a trie laid out in order and the nodes under one of its prefixes
    are neighbours: a run. The longest common prefix with the neighbours gives the runs of every level. The sort splits
    runs of any size over tasks: top is the first node of the whole run, which names it, local the first of the run in the
    same task. A run that is the same as on the level before, with one token more, isn't given again. Of each task
    its first and last label come to the driver, to carry runs over the ends of tasks.
    """
    size = width * max(levels)

    def explode(batches):
        for b in batches:
            n = b.num_rows
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(n * trees, size)
            tree = np.tile(np.arange(trees, dtype=np.uint8), n)[:, None]
            keys = np.hstack([tree, raw]).tobytes()
            key = pa.BinaryArray.from_buffers(pa.binary(), n * trees, [None, pa.py_buffer(np.arange(n * trees + 1, dtype=np.int32) * (size + 1)), pa.py_buffer(keys)])
            yield pa.RecordBatch.from_arrays([key, pa.array(np.repeat(b.column(0).to_numpy(), trees))], names=["key", "node"])

    small_batches(nodes.sparkSession, 20_000)
    rows = cut(nodes.select("node", "labels").mapInArrow(explode, "key binary, node long").orderBy("key", "node"))

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Tokens that the labels share; -1 in different trees."""
        same = (x[:, 1:] == y[:, 1:]).reshape(len(x), -1, width).all(2)
        return np.where(x[:, 0] == y[:, 0], np.cumprod(same, 1).sum(1), -1)

    def load(batches):
        got = [(b"".join(b.column(0).to_pylist()), b.column(1).to_numpy()) for b in batches]
        raw = np.frombuffer(b"".join(x[0] for x in got), np.uint8).reshape(-1, size + 1)
        return raw, np.concatenate([x[1] for x in got]) if got else np.zeros(0, np.int64)

    def ends(batches):
        from pyspark import TaskContext

        raw, node = load(batches)
        if len(node):
            lcp = common(raw[1:], raw[:-1])
            starts = [int(np.flatnonzero(np.concatenate([[True], lcp < d]))[-1]) for d in levels]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([raw[0].tobytes()]), pa.array([raw[-1].tobytes()]), pa.array([[int(node[i]) for i in starts]], pa.list_(pa.int64())), pa.array([[i == 0 for i in starts]], pa.list_(pa.bool_()))],
                names=["part", "first", "last", "tops", "whole"],
            )

    parts = sorted(rows.mapInArrow(ends, "part int, first binary, last binary, tops array<long>, whole array<boolean>").collect())
    carried, after, top, last = {}, {}, [None] * len(levels), None
    for p in parts:
        if last is not None:
            after[last.part] = bytes(p.first)
            shared = common(*(np.frombuffer(bytes(x), np.uint8)[None] for x in (last.last, p.first)))[0]
            top = [t if shared >= d else None for t, d in zip(top, levels, strict=True)]
            carried[p.part] = (bytes(last.last), list(top))
        top = [t if w and t is not None else n for t, w, n in zip(top, p.whole, p.tops, strict=True)]
        last = p
    borders = nodes.sparkSession.sparkContext.broadcast((carried, after))

    def runs_of(batches):
        from pyspark import TaskContext

        raw, node = load(batches)
        n, part = len(node), TaskContext.get().partitionId()
        if not n:
            return
        before, tops = borders.value[0].get(part, (None, [None] * len(levels)))
        follow = borders.value[1].get(part)
        edge = lambda x, y: common(np.frombuffer(x, np.uint8)[None], y)[0] if x is not None else -1
        lcp = np.concatenate([[edge(before, raw[:1])], common(raw[1:], raw[:-1]), [edge(follow, raw[-1:])]])
        known = None
        for d, carry in zip(levels, tops, strict=True):
            new = lcp[:-1] < d
            at = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            to = n - np.maximum.accumulate(np.where(lcp[1:][::-1] < d, np.arange(n), 0))[::-1]  # ends of runs
            local = node[at]
            top = np.where(at == 0, carry, local) if carry is not None else local
            out = (lcp[:-1] >= d) | (lcp[1:] >= d)
            open_ = ((at == 0) & (lcp[0] >= d)) | ((to == n) & (lcp[-1] >= d))
            if known is not None:
                out &= open_ | (at != known[0]) | (to != known[1])
            known = (at, to)
            i = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[i]), pa.array(raw[i, 0].astype(np.int32)), pa.array(np.full(len(i), d, np.int32)), pa.array(top[i].astype(np.int64)), pa.array(local[i])],
                names=["node", "tree", "depth", "top", "local"],
            )

    out = cut(rows.mapInArrow(runs_of, "node long, tree int, depth int, top long, local long"))
    forget(rows)
    small_batches(nodes.sparkSession)
    return out


def banded(nodes: DataFrame) -> DataFrame:
    """The same for bands, which have one level: the groups of nodes that share a key. Cut. nodes: (node long, keys), cut.

    First only the keys are counted; the few that two nodes share are then looked up again.
    """
    at = nodes.select("node", F.explode("keys").alias("tree"))
    shared = cut(at.groupBy("tree").agg(F.min("node").alias("top"), F.count("*").alias("n")).filter("n > 1"))
    met = at.join(F.broadcast(shared), "tree") if shared.count() <= BROADCAST_ROWS else attach(at, shared, "tree", "n", "inner")
    return cut(met.select("node", "tree", F.lit(1).alias("depth"), "top", F.col("top").alias("local")))


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs (id, h, ...) for wanted (id, h, ...): a broadcast where their count allows it, else both are shuffled."""
    wanted = wanted.withColumnsRenamed({"id": "__id", "h": "__h"})
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return docs.join(side, (F.col("h") == F.col("__h")) & F.col("id").eqNullSafe(F.col("__id"))).drop("id", "h", "__id", "__h")


def _compare(rows: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarities of all pairs of rows, as a matrix. Shared shingles are counted a few thousand at a time."""
    n = len(rows)
    sizes = np.array([len(r) for r in rows], np.float64)
    every, owner = np.concatenate(rows), np.repeat(np.arange(n), sizes.astype(int))
    _, name, often = np.unique(every, return_inverse=True, return_counts=True)
    keep = often[name] > 1
    dense = np.cumsum(often > 1) - 1
    name, owner = dense[name[keep]], owner[keep]
    both = np.zeros((n, n))
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    width = 4096
    for at in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        i, j = np.searchsorted(name, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[owner[i:j], name[i:j] - at] = 1
        both += m @ m.T
    return both / (sizes[:, None] + sizes[None] - both)


def checked(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b, alike): the pairs (a, b) whose sets have at least that Jaccard similarity. sets: (node, set)."""

    def verify(batches):
        for b in batches:
            alike = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = 0
                if min(len(x), len(y)) >= similar * max(len(x), len(y)) - 1e-9:
                    i = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    both = int((x[i] == y).sum())
                alike.append(both / (len(x) + len(y) - both))
            keep = np.flatnonzero(np.array(alike) >= similar - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(np.array(alike)[keep])], names=["a", "b", "alike"])

    met = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return met.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long, alike double")


def links(members: DataFrame, sets: DataFrame, similar: float = SIMILAR, apart: bool = False) -> DataFrame:
    """(node, root, links, least) for the nodes with a verified link in their group. Compared exactly and whole, in blocks.

    members: (bucket, node, size, bytes, side), sets: (node, set). root is a node of the same linked group, links counts the
    documents (size) of linked nodes, least is the least similarity among them. Apart: only nodes of different sides count.
    A group is cut into blocks of about BLOCK members and BLOCK_BYTES; each pair of blocks is one group of rows and gives a row for
    each member, not for each pair. A set goes once into each pair of its block, so once for most groups. Small groups share rows.
    """
    groups = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"))
    rows = members.join(groups, "bucket").withColumn("nb", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all_bytes") / BLOCK_BYTES)).cast("int"))
    rows = cut(rows.withColumn("b", F.pmod(F.xxhash64("node"), "nb").cast("int")))
    n, total = rows.agg(F.count("*"), F.sum("bytes")).first()
    few = max(1, n // BLOCK, (total or 0) // BLOCK_BYTES)
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).withColumns({"i": F.least("b", "other"), "j": F.greatest("b", "other")}).join(sets, "node")
    grp = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("bucket"), F.lit(few))).otherwise(F.xxhash64("bucket", "i", "j"))
    rows = rows.select(grp.alias("grp"), "bucket", "i", "j", "b", "node", "size", "side", "set")

    def verify(t: pa.Table) -> pa.Table:
        by: dict = {}
        bucket, i, j, b, node, size, side, data = (t.column(c).to_pylist() for c in ("bucket", "i", "j", "b", "node", "size", "side", "set"))
        for k in range(t.num_rows):
            by.setdefault((bucket[k], i[k], j[k]), []).append(k)
        out = []
        for (_, bi, bj), ks in by.items():
            if len(ks) < 2:
                continue
            alike = _compare([np.frombuffer(data[k], U) for k in ks])
            near = alike >= similar - 1e-9
            np.fill_diagonal(near, False)
            if bi != bj:  # pairs within a block are counted where the block meets itself
                own = np.array([b[k] for k in ks])
                near &= own[:, None] != own[None]
            if apart:
                own = np.array([side[k] for k in ks])
                near &= own[:, None] != own[None]
            weight = near @ np.array([size[k] for k in ks], np.int64)
            root = np.arange(len(ks))
            while True:
                low = np.where(near, root[None], len(ks)).min(1)
                new = np.minimum(root, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            least = np.where(near, alike, 2.0).min(1)
            out += [(node[ks[k]], node[ks[root[k]]], int(weight[k]), float(least[k])) for k in np.flatnonzero(near.any(1))]
        c = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.float64())], names=["node", "root", "links", "least"])

    return rows.groupBy("grp").applyInArrow(verify, "node long, root long, links long, least double")


def classes(nodes: DataFrame, met: DataFrame, sets: DataFrame, levels: list[int], enough, similar: float = SIMILAR) -> DataFrame:
    """(node, root), cut: the connected components of verified links between nodes that meet in a run, for nodes with a link.

    nodes: (node, size, bytes), met: see runs, sets: (node, set); all cut. On the first level each node is verified against the
    first of its run in the same task, and those against the first of the whole run. What that leaves apart in one run is
    compared pair by pair, in blocks (links, apart), so no link of two nodes that meet is lost, and a large group of copies
    costs one comparison for each member. On later levels, with shorter prefixes, only runs with a node go on that `enough`
    (a condition on `least`, the least similarity of a link of the node so far, null where it has none, and on `depth`) lets go on.
    """
    first = met.filter(F.col("depth") == levels[0])
    pairs = first.select(F.col("node").alias("a"), F.col("local").alias("b")).union(first.select("local", "top")).filter("a <> b").distinct()
    found = cut(checked(pairs, sets, similar))
    roots = components(found)
    for k, d in enumerate(levels):
        least = found.select("a", "alike").union(found.select("b", "alike")).groupBy(F.col("a").alias("node")).agg(F.min("alike").alias("least"))
        state = roots.join(least, "node", "left")
        rows = met.filter(F.col("depth") == d).select("node", F.xxhash64("tree", "depth", "top").alias("bucket"))
        rows = cut(rows.join(state, "node", "left").withColumn("side", F.coalesce("root", "node")).withColumn("open", F.lit(True) if k == 0 else ~F.coalesce(enough(F.col("least"), levels[k - 1]), F.lit(False))))
        mixed = cut(rows.groupBy("bucket").agg(F.min("side").alias("a"), F.max("side").alias("b"), F.max("open").alias("open")).filter("a < b AND open").select("bucket"))
        if mixed.isEmpty():
            continue
        rows = rows.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed, "bucket").select("bucket", "node", "side")
        new = links(rows.join(nodes.select("node", "size", "bytes"), "node"), sets, similar, apart=True)
        found = cut(found.union(new.select("node", "root", "least")))
        roots = components(found)
    return roots
