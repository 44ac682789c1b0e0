"""Detection quality: overlap evaluation, one-to-one evaluation, mistakes, character annotations."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Positions that share a bin of this many code points, or touch neighbouring ones, are compared.
BIN = 256


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_ratios(df: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall and f1; 0 where a denominator is."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _binned(df: DataFrame) -> DataFrame:
    """A row for each bin that the span lies in, so that overlaps are found by an equality join and long documents split."""
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(last / BIN))))


def flagged(a: DataFrame, b: DataFrame, same_type: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, type, value, start, end, n, hit): the spans of a, equal ones once with their number, and whether a span of b overlaps.

    One pass over each side: spans meet in bins, and the flag is a maximum that is combined before its shuffle.
    """
    keys = [id_col, "type", "value", "start", "end"]
    x = _binned(a.groupBy(*keys).agg(F.count("*").alias("n")))
    y = _binned(b.groupBy(*keys).agg(F.count("*").alias("n"))).drop("n", "value")
    y = y.toDF(*(f"__{c}" for c in y.columns))
    cond = (F.col(id_col) == F.col(f"__{id_col}")) & (F.col("bin") == F.col("__bin")) & (F.col("start") < F.col("__end")) & (F.col("__start") < F.col("end"))
    if same_type:
        cond = cond & (F.col("type") == F.col("__type"))
    return x.join(y, cond, "left").groupBy(*keys, "n").agg(F.max(F.col("__bin").isNotNull()).alias("hit"))


def overlap(truth: DataFrame, predicted: DataFrame, by: list[str], same_type: bool = False, id_col: str = "doc_id") -> DataFrame:
    """tp and fn count truth rows with and without an overlapping prediction, fp predictions without truth; by [] one row, [id] or ["type"]."""
    t, p, n = flagged(truth, predicted, same_type, id_col), flagged(predicted, truth, same_type, id_col), F.col("n")
    zero = F.lit(0).cast("long")
    rows = t.select(*by, F.when(F.col("hit"), n).otherwise(zero).alias("tp"), zero.alias("fp"), F.when(F.col("hit"), zero).otherwise(n).alias("fn"))
    rows = rows.unionByName(p.select(*by, zero.alias("tp"), F.when(F.col("hit"), zero).otherwise(n).alias("fp"), zero.alias("fn")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    return with_ratios(rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums))


def paired(predictions: DataFrame, manifests: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents in both, predictions without a manifest). Documents that only have a manifest are in neither."""
    a, b = predictions.select(id_col).distinct(), manifests.select(id_col).distinct()
    return a.join(b, id_col, "left_semi"), a.join(b, id_col, "left_anti")


def multiset(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one matches on equality (value mode, or strict with start and end): tp, fp, fn of the whole, as multisets."""
    t, p = truth.groupBy(*keys).agg(F.count("*").alias("t")), predicted.groupBy(*keys).agg(F.count("*").alias("p"))
    both = t.join(p, keys, "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    a, b = n(F.col("t")), n(F.col("p"))
    sums = both.agg(F.coalesce(F.sum(F.least(a, b)), F.lit(0)).alias("tp"), F.coalesce(F.sum(b - F.least(a, b)), F.lit(0)).alias("fp"), F.coalesce(F.sum(a - F.least(a, b)), F.lit(0)).alias("fn"))
    return with_ratios(sums)


def matches_by_type(truth: DataFrame, predicted: DataFrame, keys: list[str], type_col: str = "type") -> DataFrame:
    """The one-to-one figures of each type, over all documents: a type is matched by itself, then summed."""
    t, p = truth.groupBy(*keys).agg(F.count("*").alias("t")), predicted.groupBy(*keys).agg(F.count("*").alias("p"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    hit = F.least(n("t"), n("p"))
    return with_ratios(t.join(p, keys, "full").groupBy(type_col).agg(F.sum(hit).alias("tp"), F.sum(n("p") - hit).alias("fp"), F.sum(n("t") - hit).alias("fn")))


def report(truth: DataFrame, predicted: DataFrame, keys: list[str], type_col: str = "type") -> DataFrame:
    """One row: the micro figures, and the figures of each type as an array, most missed first."""
    by = matches_by_type(truth, predicted, keys, type_col)
    fields = (type_col, "tp", "fp", "fn", "precision", "recall", "f1")
    sums = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), F.array_sort(F.collect_list(F.struct((-F.col("fn")).alias("by"), *fields))).alias("types"))
    return with_ratios(sums).withColumn("types", F.transform("types", lambda x: F.struct(*(x[f].alias(f) for f in fields))))


def clusters(spans: DataFrame, tolerance: int, id_col: str = "doc_id") -> DataFrame:
    """spans with `cluster`: of one document and type, runs whose starts and ends lie within the tolerance from one to the next.

    Two spans that match are in one cluster: their starts are no further apart than the tolerance, so no gap of starts lies between them.
    """
    w = W.partitionBy(id_col, "type").orderBy("start", "end", "side", "place")
    new = F.coalesce(F.col("start") - F.lag("start").over(w) > tolerance, F.lit(True))
    return spans.withColumn("cluster", F.sum(new.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def tolerant(truth: DataFrame, predicted: DataFrame, tolerance: int = 5, id_col: str = "doc_id", order: str = "place") -> DataFrame:
    """(id, tp, fp, fn): one-to-one matches of equal type with both ends within the tolerance; truth as listed takes the first free prediction as listed.

    The order (column `order` of both sides) matters, but only within a cluster of spans; each is matched by a fold in generated code,
    so a document of any length is many small groups, and only counts meet again.
    """
    row = lambda df, side: df.select(id_col, F.lit(side).alias("side"), F.col(order).alias("place"), "type", "start", "end")
    spans = clusters(row(truth, "t").unionByName(row(predicted, "p")), tolerance, id_col)
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("place", "start", "end"))))
    groups = spans.groupBy(id_col, "type", "cluster").agg(side("t").alias("t"), side("p").alias("p"))

    def step(acc, x):
        fit = lambda y: (F.abs(y["start"] - x["start"]) <= tolerance) & (F.abs(y["end"] - x["end"]) <= tolerance)
        at = F.coalesce(F.get(F.filter(F.transform(acc["free"], lambda y, i: F.when(fit(y), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))
        left = F.when(at < 0, acc["free"]).otherwise(F.filter(acc["free"], lambda y, i: i != at))
        return F.struct(left.alias("free"), (acc["tp"] + (at >= 0).cast("long")).alias("tp"))

    tp = F.aggregate("t", F.struct(F.col("p").alias("free"), F.lit(0).cast("long").alias("tp")), step, lambda acc: acc["tp"])
    counts = groups.select(id_col, tp.alias("tp"), F.size("t").alias("t"), F.size("p").alias("p"))
    return counts.groupBy(id_col).agg(F.sum("tp").alias("tp"), (F.sum("p") - F.sum("tp")).alias("fp"), (F.sum("t") - F.sum("tp")).alias("fn"))


def mistakes(truth: DataFrame, predicted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kind, type, value, start, end) for each false negative and false positive."""
    cols = [id_col, "type", "value", "start", "end"]
    missed = lambda a, b, kind: flagged(a, b, False, id_col).filter("NOT hit").withColumn("i", F.explode(F.expr("sequence(1L, n)"))).select(*cols, F.lit(kind).alias("kind"))
    return missed(truth, predicted, "fn").unionByName(missed(predicted, truth, "fp"))


def normalised(entries: DataFrame) -> DataFrame:
    """Mistake entries whose text is `chars`, or `value` where that is missing."""
    have = [F.col(c) for c in ("chars", "value") if c in entries.columns]
    return entries.withColumn("chars", F.coalesce(*have)).drop("value")


def shown(annotations: DataFrame, type_: str = "all", kind: str = "all", id_col: str = "doc_id") -> DataFrame:
    """Mistakes as a list shows them: of one type and kind (or all), each (document, kind, start, end, type) once, by document and start."""
    keys = [id_col, "kind", "start", "end", "type"]
    wanted = [F.col(c) == v for c, v in (("type", type_), ("kind", kind)) if v != "all"]
    for cond in wanted:
        annotations = annotations.filter(cond)
    return annotations.groupBy(*keys).agg(F.min("value").alias("value")).orderBy(id_col, "start", "end", "kind", "type")


def type_table(by_type: DataFrame, column: str = "fn", descending: bool = True) -> DataFrame:
    """Figures by type, sorted by any column; most missed first where nothing is asked."""
    return by_type.orderBy(F.desc(column) if descending else F.asc(column), "type")


def displayed(per_document: DataFrame) -> DataFrame:
    """One row: the figures a summary shows: without failed documents where there are some and others too, else of all; `adjusted` says which."""
    n = lambda cond: [F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    valid = (F.col("tp") > 0) | (F.col("fp") > 0)
    both = per_document.agg(F.struct(*n(F.lit(True))).alias("all"), F.struct(*n(valid)).alias("valid"), F.count_if(~valid).alias("failed"), F.count_if(valid).alias("n_valid"))
    use = (F.col("failed") > 0) & (F.col("n_valid") > 0)
    return with_ratios(both.select(use.alias("adjusted"), "failed", *(F.when(use, F.col(f"valid.{c}")).otherwise(F.col(f"all.{c}")).alias(c) for c in ("tp", "fp", "fn"))))


def mistake_files(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document with mistakes: arrays and their sizes."""
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end", "value", "type"))))
    out = found.groupBy(id_col).agg(of("fp").alias("false_positives"), of("fn").alias("false_negatives"))
    return out.withColumns({"false_positive_count": F.size("false_positives"), "false_negative_count": F.size("false_negatives")})


class Sweep:
    """Runs of one document's characters by class, from its spans in the order of their starts.

    Open spans wait in a heap by place for each side, so the first listed one is on top; those that have ended are dropped when they
    come up. Memory is what is open at once, whatever the length of the document.
    """

    def __init__(self):
        self.open: tuple[list, list] = ([], [])  # (place, type, end) of true and of predicted spans
        self.ends: list[int] = []
        self.at, self.run = 0, None

    def _piece(self, end: int, out: list) -> None:
        """The characters from where the sweep stands up to end, all covered by the same spans."""
        tops = []
        for side in self.open:
            while side and side[0][2] <= self.at:
                heappop(side)
            tops.append(side[0][1] if side else None)
        expected, predicted = tops
        kind = None if expected is predicted is None else "fp" if expected is None else "fn" if predicted is None else "tp"
        if self.run and (kind != self.run[2] or self.run[1] != self.at):
            out.append(self.run)
            self.run = None
        if kind:
            self.run = (*self.run[:1], end, *self.run[2:]) if self.run else (self.at, end, kind, predicted, expected)
        self.at = end

    def _to(self, pos: float, out: list) -> None:
        while self.ends and self.ends[0] <= pos:
            end = heappop(self.ends)
            if end > self.at:
                self._piece(end, out)
        if self.ends and pos > self.at:
            self._piece(pos, out)

    def span(self, start: int, end: int, place: int, kind: str, true: bool, out: list) -> None:
        self._to(start, out)
        self.at = max(self.at, start)
        heappush(self.open[not true], (place, kind, end))
        heappush(self.ends, end)

    def close(self, out: list) -> None:
        self._to(float("inf"), out)
        if self.run:
            out.append(self.run)


def annotations(truth: DataFrame, predicted: DataFrame, id_col: str = "doc_id", order: str = "place") -> DataFrame:
    """(id, start, end, class, predicted_type, expected_type): runs of characters that are tp, fp or fn.

    At each character the first listed entity of a side counts (column `order`); a run takes its types from its first
    character. One shuffle by document and a sort by start; then spans pass one after the other through a sweep, and only spans, no texts, reach it.
    """
    side = lambda df, true: df.select(id_col, "type", "start", "end", F.col(order).cast("long").alias("place"), F.lit(true).alias("true"))
    spans = side(truth, True).unionByName(side(predicted, False)).filter("start < `end`")
    kind = spans.schema[id_col]
    out = T.StructType([kind, T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("class", "predicted_type", "expected_type"))])

    def run(batches: Iterator[pa.RecordBatch]):
        key, sweep = None, None

        def batch(ids: list, rows: list) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(ids, key_type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=out.names)

        key_type = None
        for b in batches:
            key_type, ids, rows = b.schema.field(0).type, [], []
            for own, start, end, place, type_, true in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sweep is None or own != key:
                    if sweep:
                        sweep.close(rows)
                        ids += [key] * (len(rows) - len(ids))
                    key, sweep = own, Sweep()
                sweep.span(start, end, place, type_, true, rows)
                ids += [key] * (len(rows) - len(ids))
            yield batch(ids, rows)
        if sweep:
            rows = []
            sweep.close(rows)
            yield batch([key] * len(rows), rows)

    return spans.repartition(id_col).sortWithinPartitions(id_col, "start").select(id_col, "start", "end", "place", "type", "true").mapInArrow(run, out)


def adjusted(per_document: DataFrame) -> DataFrame:
    """The micro figures without failed documents (no tp and no fp)."""
    n = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    return with_ratios(per_document.filter("tp > 0 OR fp > 0").agg(*n))


def evaluation_files(truth: DataFrame, predicted: DataFrame, settings: dict[str, str], name: str, id_col: str = "doc_id") -> DataFrame:
    """(key, content): the files that an evaluation leaves, to be written as objects.

    `{name}.json` has the settings, the aggregate and the figures by type; `{name}_mistakes/{document}.json` the mistakes of each document that
    has some, one object each, since one for all would grow with the corpus.
    """
    figures = lambda *c: F.struct("precision", "recall", "f1", F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"), *c)
    whole = overlap(truth, predicted, []).select(figures().alias("aggregate"))
    by = overlap(truth, predicted, ["type"], same_type=True).agg(F.array_sort(F.collect_list(F.struct("type", figures().alias("of")))).alias("by"))
    said = F.create_map(*(F.lit(x) for pair in settings.items() for x in pair)).alias("settings")
    body = F.to_json(F.struct(said, "aggregate", F.map_from_entries("by").alias("by_type")))
    report_ = whole.join(F.broadcast(by)).select(F.lit(f"{name}.json").alias("key"), body.alias("content"))
    found = mistake_files(mistakes(truth, predicted, id_col), id_col)
    summary = F.struct("false_positive_count", "false_negative_count").alias("summary")
    entry = F.to_json(F.struct(F.col(id_col).cast("string").alias("doc_id"), summary, "false_negatives", "false_positives"))
    return report_.unionByName(found.select(F.concat(F.lit(f"{name}_mistakes/"), F.col(id_col).cast("string"), F.lit(".json")).alias("key"), entry.alias("content")))
