"""Operator 1: best-fit packing of token sequences, improved by a swap-based local search."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import small_batches
from .tokens import encoder

#: Items that one task packs together. Every block ends with one underfull bin, so waste from blocks is one bin in some ten thousand.
BLOCK = 32_768
#: Sources in a row that the search may fail to empty before it ends.
PATIENCE = 64


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for every piece of every row; a text over `capacity` has a shorter first piece.

    Null text counts as empty (its one piece is end_id alone); null ids stay null; repeated rows each give their pieces.
    """
    small_batches(df.sparkSession)

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            ids, out = b.column(0), []
            for row, text in enumerate(b.column(1)):
                t = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = (len(t) - 1) % capacity + 1
                for k, (i, j) in enumerate(zip([0, *range(first, len(t), capacity)], range(first, len(t) + 1, capacity), strict=True)):
                    out.append((row, k, i, j - i, zlib.crc32(t[i:j])))
            c = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, largest first: each item goes where the least room stays. The open bins are indexed by room; a bit mask finds the tightest."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
            room -= s
        else:
            b, room = len(bins), capacity - s
            bins.append([i])
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int, patience: int = PATIENCE) -> list[list[int]]:
    """Empties bins by moves and by one-for-one, two-for-one and one-for-two exchanges with fuller bins.

    Every step moves tokens from a bin to one at least as full, so the sum of squared fills grows and the search ends.
    The least full bin is the source; it is given up once no step helps, and `patience` sources in a row end the search.
    """
    size = sizes.tolist()
    total, least = sum(size), -(-sum(size) // capacity)
    fill = [sum(size[i] for i in b) for b in bins]
    live = len(bins)
    order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    failed = 0
    for at, src in enumerate(order):
        if live <= least or failed >= patience or total == 0:
            break
        if not bins[src] or sum(capacity - fill[b] for b in order[at + 1 :] if bins[b]) < fill[src]:
            continue  # the others have no room for what it holds
        targets = [b for b in order[at + 1 :][::-1] if bins[b] and fill[b] < capacity][:256]
        changed = True
        while changed and bins[src]:
            changed = False
            for dst in targets:
                room = capacity - fill[dst]
                if room == 0 or fill[dst] < fill[src] or not bins[src]:
                    continue
                step = _step(bins[src], bins[dst], size, room)
                if step:
                    give, take = step
                    gain = sum(size[i] for i in give) - sum(size[i] for i in take)
                    bins[src] = [i for i in bins[src] if i not in give] + take
                    bins[dst] = [i for i in bins[dst] if i not in take] + give
                    fill[src] -= gain
                    fill[dst] += gain
                    changed = True
        if bins[src]:
            failed += 1
        else:
            live, failed = live - 1, 0
    return [b for b in bins if b]


def _step(src: list[int], dst: list[int], size: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """The step that fills dst most: (given by src, taken from dst)."""
    best, found = 0, None
    a, b = src[:24], dst[:24]
    gives = [([i], size[i]) for i in a] + [([i, j], size[i] + size[j]) for k, i in enumerate(a) for j in a[k + 1 :]]
    takes = [([], 0)] + [([i], size[i]) for i in b]
    pairs = [([i, j], size[i] + size[j]) for k, i in enumerate(b) for j in b[k + 1 :]]
    for give, g in gives:
        for take, t in takes if len(give) == 2 else takes + pairs:
            if best < g - t <= room:
                best, found = g - t, (give, take)
                if best == room:
                    return found
    return found


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset): every token of every document, in sequences of `capacity` at most.

    Only narrow piece rows are shuffled, dealt evenly over tasks whatever their keys, and each task packs blocks of
    `block` items, so its memory is bounded. Sequences are gapless from 0. Empty input gives no rows. Repeated rows are
    packed as often as they occur. Other columns of df are not read, so clashing names don't matter.
    """
    spark = df.sparkSession
    rows = pieces(df, id_col, text_col, capacity, end_id, vocabulary)
    tasks = max(1, -(-df.select(F.lit(1)).count() // block))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        made = 0
        for t in blocks(batches, block):
            size = t.column("length").to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            bins = local_search(best_fit(size, capacity), size, capacity)
            for k, b in enumerate(bins):
                at = 0
                for i in b:
                    seq[i], off[i] = k, at
                    at += int(size[i])
            base = (t.column("part")[0].as_py() << 36) + made
            made += len(bins)
            yield from t.drop_columns("part").append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(off)).to_batches()

    # in an order of their own, so that a task that runs again packs alike
    dealt = rows.repartition(tasks).sortWithinPartitions(F.xxhash64("id", "piece", "ids_crc32"), "id", "piece", "length", "start")
    dealt = dealt.withColumn("part", F.spark_partition_id())  # of the shuffle, whatever task a caller's coalesce() reads it in
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def blocks(batches, n: int):
    """Tables of n rows from a stream of Arrow batches; the last may be shorter."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= n:
            t = pa.Table.from_batches(held)
            while t.num_rows >= n:
                yield t.slice(0, n).combine_chunks()
                t = t.slice(n)
            held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows: every document's pieces of at most 1024 tokens, packed; null text is empty, repeated rows each give theirs."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
