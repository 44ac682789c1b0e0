"""Many values in one text: found by one pass over it, replaced by a sweep over what was found.

Rows with a few entities stay in generated code (redact.py). Where a row has many, a scan for each of them would cost
entities times text; here all values are looked for at once (Aho-Corasick), so the work is linear in text, values and matches.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Entities of a row up to which the built-in functions do the work.
FEW = 32

POSITIONS = "array<struct<type:string,value:string,start:int,end:int>>"
REDACTED = "struct<text:string,found:array<struct<type:string,found:boolean>>>"


@lru_cache(1 << 16)
def in_word(c: str) -> bool:
    """Whether a Unicode word boundary counts a character as part of a word."""
    kind, code = unicodedata.category(c), ord(c)
    circled = 0x24B6 <= code <= 0x24E9 or 0x1F130 <= code <= 0x1F149 or 0x1F150 <= code <= 0x1F169 or 0x1F170 <= code <= 0x1F189
    return kind[0] in "LM" or kind in ("Nl", "Nd", "Pc") or code in (0x200C, 0x200D) or circled


def _border(left: str, right: str) -> bool:
    """Whether a word begins or ends between two characters; an empty one is the end of the text."""
    return (bool(left) and in_word(left)) != (bool(right) and in_word(right))


def whole_words(text: str, values: list[str]) -> dict[str, list[int]]:
    """Where each value stands as a whole word in a text, in order; places may overlap."""
    machine = ahocorasick.Automaton()
    for v in set(values):
        if v:
            machine.add_word(v, v)
    found: dict[str, list[int]] = {}
    if text and len(machine):
        machine.make_automaton()
        for last, v in machine.iter(text):
            at = last - len(v) + 1
            if _border(text[at - 1 : at], v[0]) and _border(v[-1], text[last + 1 : last + 2]):
                found.setdefault(v, []).append(at)
    return found


def _apart(places: list[int], length: int) -> list[int]:
    """The leftmost places that don't overlap."""
    out, end = [], 0
    for at in places:
        if at >= end:
            out.append(at)
            end = at + length
    return out


def _one_by_one(text: str, entities: list[tuple[str, str]]) -> tuple[str, list[bool]]:
    """Values replaced one after the other, each in the text as it is then."""
    hits = []
    for value, tag in entities:
        parts, end, at = [], 0, text.find(value)
        while at >= 0:
            if _border(text[at - 1 : at], value[0]) and _border(value[-1], text[at + len(value) : at + len(value) + 1]):
                parts += [text[end:at], tag]
                at = end = at + len(value)
            else:
                at += 1
            at = text.find(value, at)
        hits.append(bool(parts))
        if parts:
            text = "".join(parts) + text[end:]
    return text, hits


def _tangled(entities: list[tuple[str, str]]) -> bool:
    """Whether a value could match inside a tag or over its edge, which only replacing one after the other shows."""
    tags = {t for _, t in entities}
    if "" in tags:
        return True
    edges = {c for t in tags for c in (t[0], t[-1])}
    machine = ahocorasick.Automaton()
    for v, _ in entities:
        if not edges.isdisjoint(v):
            return True
        machine.add_word(v, v)
    machine.make_automaton()
    return any(True for t in tags for _ in machine.iter(t))


def replaced(text: str, entities: list[tuple[str, str]]) -> tuple[str, list[bool]]:
    """(text, whether each was found): (value, tag) replaced as if one after the other; values differ and aren't empty.

    All places come from the text as it was. A place goes where an earlier value has taken some of it; beside a tag the word boundary
    is looked at again, with the tag's character. Where a value could match inside a tag, it is done one by one.
    """
    if not entities:
        return text, []
    if _tangled(entities):
        return _one_by_one(text, entities)
    found = whole_words(text, [v for v, _ in entities])
    taken, begins, ends, hits = bytearray(len(text)), {}, {}, []
    for value, tag in entities:
        mine, end, size = [], 0, len(value)
        for at in found.get(value, ()):
            if at < end or taken.find(1, at, at + size) >= 0:
                continue
            left, right = ends.get(at), begins.get(at + size)
            if (left and not _border(left[1][-1], value[0])) or (right and not _border(value[-1], right[1][0])):
                continue
            mine.append(at)
            end = at + size
        for at in mine:
            taken[at : at + size] = b"\x01" * size
            begins[at] = ends[at + size] = (at, tag, at + size)
        hits.append(bool(mine))
    out, end = [], 0
    for at in sorted(begins):
        out += [text[end:at], begins[at][1]]
        end = begins[at][2]
    return "".join(out) + text[end:], hits


def _rows(*columns: pa.Array):
    return zip(*(c.to_pylist() for c in columns), strict=True)


def positions(text: Column, entities: Column) -> Column:
    """Every place of every entity, entity by entity as given; null for null entities."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(POSITIONS)
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, es in _rows(texts, found):
            if es is None:
                out.append(None)
                continue
            places = {v: _apart(at, len(v)) for v, at in whole_words(t or "", [e["value"] for e in es if e["value"]]).items()}
            out.append([{"type": e["type"], "value": e["value"], "start": at, "end": at + len(e["value"])} for e in es if e["value"] for at in places.get(e["value"], ())])
        return pa.array(out, kind)

    return run(text, entities)


def redacted(text: Column, ready: Column) -> Column:
    """struct<text, found> of ready: array<struct<type, value, tag>> in order; null for null entities, a null text stays null."""
    kind = pa.struct([("text", pa.string()), ("found", pa.list_(pa.struct([("type", pa.string()), ("found", pa.bool_())])))])

    @F.arrow_udf(REDACTED)
    def run(texts: pa.Array, entities: pa.Array) -> pa.Array:
        out = []
        for t, es in _rows(texts, entities):
            if es is None:
                out.append(None)
                continue
            new, hits = (None, [False] * len(es)) if t is None else replaced(t, [(e["value"], e["tag"]) for e in es])
            out.append({"text": new, "found": [{"type": e["type"], "found": h} for e, h in zip(es, hits, strict=True)]})
        return pa.array(out, kind)

    return run(text, ready)
