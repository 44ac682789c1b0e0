"""Order across tasks: neighbours, numbers and exact percentiles of groups of any size.

A window over a group puts all of it into one task. Here rows are range-sorted by group and order, so a group lies in as many
tasks in a row as it needs; windows then run within (task, group), and what a task needs from those before it, a border value
or a running count, is worked out from one row for each group and task. Only groups that lie in several tasks need such a row, two for each task at most,
so those rows are always few enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.folders import shared_dir

PART, KEY = "__part", "__key"


def range_sorted(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df range-sorted by group and order, with the group's columns as one struct and the task, cut by a checkpoint so that tasks stay.

    Nulls come first, and a null group is a group like others.
    """
    shared_dir(df.sparkSession)
    keyed = df.withColumn(KEY, F.struct(*(F.col(g).alias(f"g{i}") for i, g in enumerate(group))))
    return keyed.repartitionByRange(KEY, *order).sortWithinPartitions(KEY, *order).withColumn(PART, F.spark_partition_id()).checkpoint()


def within() -> W:
    return W.partitionBy(PART, KEY)


def _along() -> W:
    return W.partitionBy(KEY).orderBy(PART)


def spread(pieces: DataFrame) -> DataFrame:
    """Of one row for each group and task those of groups in several tasks: at most two for each task."""
    return pieces.withColumn("__tasks", F.count("*").over(W.partitionBy(KEY))).filter("__tasks > 1").drop("__tasks")


def carried(rows: DataFrame, borders: DataFrame) -> DataFrame:
    """rows with what borders (a few rows by task and group) hold for them, else null."""
    return rows.join(F.broadcast(borders), [PART, KEY], "left")


def neighbours(df: DataFrame, group: str, order: str) -> DataFrame:
    """df with the previous and next value of order within a group, which may be of any size.

    Equal values are each other's neighbours; null values come first, a null group is one.
    """
    rows = range_sorted(df, [group], [order])
    w = within().orderBy(order)
    ends = rows.groupBy(PART, KEY).agg(F.min(F.struct(order)).alias("first"), F.max(F.struct(order)).alias("last"))
    borders = spread(ends).select(PART, KEY, F.lag("last").over(_along()).alias("before"), F.lead("first").over(_along()).alias("after"))
    inner = rows.withColumns({"previous": F.lag(F.struct(order)).over(w), "following": F.lead(F.struct(order)).over(w)})
    found = carried(inner, borders)
    return found.select(
        *df.columns,
        F.coalesce("previous", "before")[order].alias("previous"),
        F.coalesce("following", "after")[order].alias("following"),
    )


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with the number of each row in its group, from 1, by order; ties in any order."""
    rows = range_sorted(df, group, order)
    counts = rows.groupBy(PART, KEY).agg(F.count("*").alias("c"))
    before = F.sum("c").over(_along().rowsBetween(W.unboundedPreceding, -1))
    borders = spread(counts).select(PART, KEY, before.alias("before"))
    found = carried(rows.withColumn(name, F.row_number().over(within().orderBy(*order))), borders)
    return found.withColumn(name, F.col(name) + F.coalesce("before", F.lit(0))).select(*df.columns, name)


def percentiles(df: DataFrame, group: list[str], value: str, count: str, shares: dict[str, float], *more: Column) -> DataFrame:
    """(group, a column for each share, more): exact interpolated percentiles of value, each row standing for `count` equal values.

    Null values don't count. `more` are aggregates over df's columns, in the same pass. Of a group only the two values beside each rank
    leave their tasks.
    """
    rows = range_sorted(df, group, [value])
    c = F.when(F.col(value).isNotNull(), F.col(count)).otherwise(0)
    counts = rows.groupBy(PART, KEY).agg(F.sum(c).alias("c"))
    before = F.sum("c").over(_along().rowsBetween(W.unboundedPreceding, -1))
    borders = spread(counts).select(PART, KEY, before.alias("before"), F.sum("c").over(W.partitionBy(KEY)).alias("all"))
    w = within().orderBy(value)
    placed = rows.withColumns({"__end": F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)), "__own": F.sum(c).over(within())})
    placed = carried(placed, borders).withColumns({"__end": F.col("__end") + F.coalesce("before", F.lit(0)), "__all": F.coalesce("all", "__own")})
    here = lambda r: (r >= F.col("__end") - c) & (r < F.col("__end"))
    picked = []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("__all") - 1)
        picked += [F.max(F.when(here(F.floor(at)), F.col(value))).alias(f"__low_{name}"), F.max(F.when(here(F.ceil(at)), F.col(value))).alias(f"__high_{name}")]
    out = placed.groupBy(KEY).agg(F.max("__all").alias("__all"), *picked, *more)
    for name, q in shares.items():
        at = F.lit(q) * (F.col("__all") - 1)
        mixed = (F.ceil(at) - at) * F.col(f"__low_{name}") + (at - F.floor(at)) * F.col(f"__high_{name}")
        out = out.withColumn(name, F.when(F.floor(at) == F.ceil(at), F.col(f"__low_{name}")).otherwise(mixed))
    names = [x for x in out.columns if not x.startswith("__")]
    return out.select(*(F.col(f"{KEY}.g{i}").alias(g) for i, g in enumerate(group)), *names)
