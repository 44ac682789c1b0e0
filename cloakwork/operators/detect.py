"""Detectors: what lists the sensitive strings of a document."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import blank, starts
from ..model import COMPACT, MAX_CHARS, SHORT_CODES
from .calls import Caller, backoff, retryable  # noqa: F401

#: The type of a list of entities.
ENTITIES = "array<struct<type:string,value:string>>"

#: The offline detector: one pattern for each short code it fills.
PATTERNS = {
    "dat": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "phn": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}\b",
    "eml": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "acc": r"\b[0-9]{16}\b",
    "url": r"\bhttps?://[A-Za-z0-9./?=&_%-]*[A-Za-z0-9]\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "oth": r"\b[0-9a-f]{40}\b",
}


def compact(text: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """A compact detection: for each short code the distinct strings, in the order of the text."""
    none = F.array().cast("array<string>")
    return F.struct(*((F.when(text.rlike(p), F.array_distinct(F.regexp_extract_all(text, F.lit(f"({p})"), 1))).otherwise(none) if (p := patterns.get(c)) else none).alias(c) for c in SHORT_CODES))


def expand(found: Column) -> Column:
    """array<struct<type, value>> of a compact detection, in the order of the codes; nothing is deduplicated."""
    return F.concat(*(_typed(found[c], full) for c, full in SHORT_CODES.items()))


def _typed(values: Column, full: str) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(full).alias("type"), v.alias("value")))


def detect(df: DataFrame, text_col: str = "text", patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """df with `entities`. Null text has none."""
    parts = [_typed(F.when(F.col(text_col).rlike(p), F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(f"({p})"), 1))), SHORT_CODES[c]) for c, p in ((c, patterns[c]) for c in SHORT_CODES if c in patterns)]
    return df.withColumn("entities", F.concat(*parts))


def spans(df: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, type, value, start, end): every match of every pattern, in code points, listed by pattern. One narrow pass, no shuffle."""
    parts = []
    for c, p in patterns.items():
        found = F.regexp_extract_all(F.col(text_col), F.lit(f"({p})"), 1)
        at = starts(F.col(text_col), F.lit(p), found)
        rows = F.zip_with(found, at, lambda m, s: F.struct(F.lit(SHORT_CODES[c]).alias("type"), m.alias("value"), s["start"].alias("start"), s["end"].alias("end")))  # noqa: B023
        parts.append(F.when(F.col(text_col).rlike(p), rows).otherwise(F.array().cast("array<struct<type:string,value:string,start:int,end:int>>")))
    return df.select(id_col, F.posexplode(F.concat(*parts)).alias("place", "s")).select(id_col, "place", "s.*")


def validity(text: Column, most: int = MAX_CHARS) -> Column:
    """`empty`, `too_long` (0: no limit) or `ok`."""
    out = F.when(text.isNull() | blank(text), "empty")
    return (out.when(F.length(text) > most, "too_long") if most else out).otherwise("ok")


def parameters(types: list[str] | None = None, most: int = 100) -> dict:
    """Detection parameters: types trimmed, lower-cased, blanks dropped, all known ones where none is left; most of at least 1."""
    if most < 1:
        raise ValueError("max_entities must be 1 or more")
    wanted = [t.strip().lower() for t in types or [] if t and t.strip()]
    return {"pii_types": list(dict.fromkeys(wanted)) or list(SHORT_CODES.values()), "max_entities": most}


def restricted(entities: Column, types: list[str], most: int) -> Column:
    """The entities of these types, at most so many."""
    return F.slice(F.filter(entities, lambda e: e["type"].isin(types)), 1, most)


def setting(value: str | None, default, least=None):
    """A number from a setting of the environment: the default where it is missing or can't be read, never below `least`."""
    try:
        found = type(default)(str(value).strip()) if value is not None else default
    except ValueError:
        found = default
    return found if least is None else max(found, least)


def prompt(prompt_text: str, text: Column) -> Column:
    return F.concat(F.lit(prompt_text + "<document>"), text, F.lit("</document>"))


def sound(found: dict) -> dict[str, list[str]]:
    """A model's answer as lists of strings by short code; an error where it has another shape or an unknown code."""
    if not isinstance(found, dict):
        raise TypeError("no object")
    for code, values in found.items():
        if code not in SHORT_CODES:
            raise ValueError(f"unknown code {code!r}")
        if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
            raise TypeError(f"{code} isn't a list of strings")
    return {c: list(found.get(c, [])) for c in SHORT_CODES}


def model_detector(
    df: DataFrame, call: Callable[[str], dict], text_col: str = "text", attempts: int = 4,
    sleep: Callable[[float], None] = time.sleep, window: int = 8, budget: int = 100,
) -> DataFrame:
    """df with `compacted`, `retries` and `error` from a model: call(text) gives a list of strings for each short code.

    A task has `window` calls in flight and shares `budget` retries among them; rows keep their order. An error, or an answer that isn't
    sound, marks its row and doesn't fail the job. Retries only errors that are worth it.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("compacted", COMPACT), T.StructField("retries", T.IntegerType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]):
        caller = Caller(call, sound, window, attempts, budget, sleep=sleep)
        for b in batches:
            out = list(caller.all((t,) for t in b[text_col]))
            yield b.assign(compacted=[o.value for o in out], retries=[o.retries for o in out], error=[o.error for o in out])

    return df.mapInPandas(run, schema)
