"""Redaction: entity order, tags and ids, the sequential fold, skips, positions and occurrences. No shuffle: a document is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import alpha_id, let, lookup, replacement, starts, whole_word
from ..model import TAG_LABELS, TYPE_ORDER
from . import sweep
from .sweep import FEW


def ordered(entities: Column) -> Column:
    """array<struct<type, value, n>>: by type order, longest first, then as given; of equal values the first only; n counts within a type.

    Entities without a type or value are left out. A number is used up even where the value isn't in the text. Sorted by value to see
    which are first, by type to count, and back: no step looks at all entities for each.
    """
    fine = F.filter(entities, lambda e: (F.coalesce(e["type"], F.lit("")) != "") & (F.coalesce(e["value"], F.lit("")) != ""))
    at = F.array(*(F.lit(t) for t in TYPE_ORDER))
    rank = F.transform(
        fine,
        lambda e, i: F.struct(
            F.when(F.array_position(at, e["type"]) == 0, 999).otherwise(F.array_position(at, e["type"])).alias("p"),
            e["type"].alias("type"), (-F.length(e["value"])).alias("l"), i.alias("i"), e["value"].alias("value"),
        ),
    )
    new = lambda xs, x, k, c: (k == 0) | (F.get(xs, k - 1)[c] != x[c])

    by_value = F.array_sort(F.transform(F.array_sort(rank), lambda x, r: F.struct(x["value"].alias("value"), r.alias("r"), x["type"].alias("type"))))
    first = let(by_value, lambda xs: F.filter(xs, lambda x, k: new(xs, x, k, "value")))
    by_type = F.array_sort(F.transform(first, lambda x: F.struct(F.lower(x["type"]).alias("low"), x["r"].alias("r"), x["type"].alias("type"), x["value"].alias("value"))))

    def numbered(xs: Column) -> Column:
        begins = F.filter(F.transform(xs, lambda x, k: F.when(new(xs, x, k, "low"), k)), lambda k: k.isNotNull())

        def one(starts_):
            since = lambda k: F.aggregate(starts_, F.lit(0), lambda a, s: F.when(s <= k, s).otherwise(a))
            return F.transform(xs, lambda x, k: F.struct(x["r"].alias("r"), x["type"].alias("type"), x["value"].alias("value"), (k - since(k) + 1).alias("n")))

        return let(begins, one)

    return F.transform(F.array_sort(let(by_type, numbered)), lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), x["n"].alias("n")))


def default_tag(e: Column) -> Column:
    return F.concat(F.lit("["), F.upper(e["type"]), F.lit("]"))


def template_tag(template: str, scheme: str = "alpha"):
    """Tags after a template with {TYPE} and {ID}; without either, the template itself."""

    def tag(e: Column) -> Column:
        out = F.lit(template)
        if "{TYPE}" in template:
            out = F.replace(out, F.lit("{TYPE}"), F.coalesce(lookup(TAG_LABELS, F.lower(e["type"])), F.upper(e["type"])))
        if "{ID}" in template:
            out = F.replace(out, F.lit("{ID}"), alpha_id(e["n"]) if scheme == "alpha" else e["n"].cast("string"))
        return out

    return tag


def tagged(entities: Column, tag=default_tag) -> Column:
    """array<struct<type, value, tag>> of the ordered entities."""
    return F.transform(ordered(entities), lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"), tag(e).alias("tag")))


def redacted(text: Column, ready: Column) -> Column:
    """struct<text, found: array<struct<type, found>>>: tagged entities (a column of its own) replaced one after the other.

    A value is looked for in the text as replaced so far, so later values can match inside earlier tags. Rows of more than FEW entities
    go through one sweep over the text (sweep.py), with the same outcome.
    """
    few = F.coalesce(F.size(ready) <= FEW, F.lit(True))
    seed = F.struct(text.alias("text"), F.array().cast("array<struct<type:string,found:boolean>>").alias("found"))

    def step(acc, e):
        pattern = whole_word(e["value"])
        hit = F.coalesce(F.call_function("rlike", acc["text"], pattern), F.lit(False))
        new = F.when(hit, F.regexp_replace(acc["text"], pattern, replacement(e["tag"]))).otherwise(acc["text"])
        return F.struct(new.alias("text"), F.concat(acc["found"], F.array(F.struct(e["type"].alias("type"), hit.alias("found")))).alias("found"))

    return F.when(few, F.aggregate(ready, seed, step)).otherwise(sweep.redacted(F.when(~few, text), F.when(~few, ready)))


def skipped(found: Column) -> Column:
    """map<type, count> of the types of which no entity was found."""

    def counted(f: Column) -> Column:
        of = lambda t: F.filter(f, lambda x: x["type"] == t)
        none = F.filter(F.array_distinct(F.transform(f, lambda x: x["type"])), lambda t: ~F.exists(f, lambda x: (x["type"] == t) & x["found"]))
        return F.transform(none, lambda t: F.struct(t.alias("t"), F.size(of(t)).alias("n")))

    return F.map_from_entries(let(found, counted))


def redact(df: DataFrame, text_col: str = "text", entities_col: str = "entities", tag=default_tag) -> DataFrame:
    """df with `redacted` and `skipped_by_type`."""
    out = df.withColumn("__ready", tagged(F.col(entities_col), tag)).withColumn("__r", redacted(F.col(text_col), F.col("__ready")))
    return out.withColumn("redacted", F.col("__r.text")).withColumn("skipped_by_type", skipped(F.col("__r.found"))).drop("__r", "__ready")


def positions(text: Column, entities: Column) -> Column:
    """array<struct<type, value, start, end>>: every match in the original text, entity by entity as given; overlaps stay."""
    fine = F.filter(entities, lambda e: F.coalesce(e["value"], F.lit("")) != "")
    few = F.coalesce(F.size(entities) <= FEW, F.lit(True))

    def places(e: Column) -> Column:
        found = starts(text, whole_word(e["value"]), length=F.length(e["value"]))
        return F.transform(found, lambda s: F.struct(e["type"].alias("type"), e["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end")))

    return F.when(few, F.flatten(F.transform(fine, places))).otherwise(sweep.positions(F.when(~few, text), F.when(~few, entities)))


def occurrences(found: Column) -> Column:
    """array<struct<type, value>> of positions, in the order of the text."""
    by = F.array_sort(F.transform(found, lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), i.alias("i"), p["type"].alias("type"), p["value"].alias("value"))))
    return F.transform(by, lambda p: F.struct(p["type"].alias("type"), p["value"].alias("value")))
