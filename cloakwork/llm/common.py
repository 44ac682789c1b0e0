"""What the operators of this subpackage share: lineage cuts, batch sizes, joins that survive hot keys, components."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.folders import shared_dir

#: A key is hot from this share of all rows on; so at most 1 / HOT_SHARE keys are, whatever the input.
HOT_SHARE = 1e-3
#: Arrow batches for Python stages: this many rows at most, and about as many bytes, so long texts don't pile up.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: So many edges are settled by one task in its memory; more go through distributed rounds.
FEW_EDGES = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder, which outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that Python stages get: long texts come in few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that the driver knows, as a literal of the plan."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>>")))


def attach(rows: DataFrame, groups: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """rows joined with groups (one row for each key, `count` rows of `rows` each), whatever the share of a key.

    Keys with at least HOT_SHARE of the rows number 1 / HOT_SHARE at most, so those groups are broadcast and
    their rows never meet in one task; all other keys are joined by hash, each with a small share.
    groups is read twice: pass a cut one. Null keys match nothing.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    least = max(2, int(total * HOT_SHARE))
    hot, cold = groups.filter(F.col(count) >= least), groups.filter(F.col(count) < least)
    mark = hot.select(key, F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(mark), key, "left")
    a = marked.filter("__hot").drop("__hot").join(F.broadcast(hot), key, how)
    b = marked.filter("__hot IS NULL").drop("__hot").join(cold, key, how)
    return a.unionByName(b)


def forget(*frames: DataFrame) -> None:
    """Deletes the files of cut frames that nothing reads any more."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _settle(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of the component of each)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        low, new = np.minimum(x, y), root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, root), cut: for every node (long) of the edges the least node of its connected component.

    Large-star and small-star steps alternate, each a grouped minimum (combined before the shuffle) and a join that splits
    hubs (see attach), until at most `few` distinct edges are left or the edges no longer change; the files of each
    round go when the next has been written. So few edges (16 bytes each) are settled in the memory of one task. Nothing
    but a count and a checksum comes to the driver. A self-loop makes a component of one.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now[0] <= few:
            break
        if now == last:
            return cut(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")))
        last = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        large = attach(both, least, "u", "n", "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.select("u", F.col("m").alias("v"))).distinct()
        down = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        low = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = attach(down, low, "u", "n", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        forget(e, least, down, low)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")

    def settle(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            nodes, roots = _settle(*(np.concatenate(x) for x in zip(*got, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    return cut(e.coalesce(1).mapInArrow(settle, "node long, root long"))
