"""Operator 9: benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches
from .lines import NO_BLANKS

#: Edits (of words) that a passage may have, as a share of the item's words.
EDITS = 0.15
#: Items of fewer words are searched without edits.
LEAST_WORDS = 8
#: Code points of items that one automaton holds; more items are searched in as many passes over the documents.
AUTOMATON = 8 << 20
SPLIT = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Words (runs of letters and digits, lower-cased; each letter of a script without blanks) with a space before and after each."""
    low = text.lower()
    return f" {SPLIT.sub(' ', low if low.isascii() else NO_BLANKS.sub(r' \g<0> ', low)).strip()} "


def cut_in_pieces(words: list[str], edits: int) -> list[tuple[int, list[str]]]:
    """edits + 1 runs of about the same length, with their places: a passage with at most `edits` edits keeps one whole."""
    n, k = len(words), edits + 1
    ends = [n * i // k for i in range(k + 1)]
    return [(a, words[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


class Searcher:
    """Finds passages of items in a text: exact piece hits from one automaton, each verified by Myers' bit-parallel distance."""

    def __init__(self, items: list[tuple], edits: float = EDITS, least: int = LEAST_WORDS):
        self.items, pieces = [], {}
        for item_id, text in items:
            words = plain(text or "").split()
            if not words:
                continue
            budget, masks = int(edits * len(words)) if len(words) >= least else 0, {}
            for i, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << i
            for at, run in cut_in_pieces(words, budget):
                pieces.setdefault(f" {' '.join(run)} ", []).append((len(self.items), at))
            self.items.append((item_id, len(words), budget, masks))
        self.automaton = ahocorasick.Automaton()
        for run, where in pieces.items():
            self.automaton.add_word(run, (len(run), where))
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple]:
        """(item id, least distance, first word, end word) of each item with a passage in the text, best passage first."""
        if not self.items or not text:
            return []
        s = plain(text)
        hits = list(self.automaton.iter(s))
        if not hits:
            return []
        words = s.split()
        number, at, last = 0, 0, -1
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, where) in hits:  # ends ascend, so the spaces before are counted once
            number += s.count(" ", last + 1, end + 1)
            last = end
            after = number - 1  # words before the space that the hit ends with
            for item, place in where:
                _, n, k, _ = self.items[item]
                at = after - s.count(" ", end - length + 2, end + 1)
                low, high = max(0, at - place - k), at - place + n + k
                own = windows.setdefault(item, [])
                if own and low <= own[-1][1]:
                    own[-1] = (min(own[-1][0], low), max(own[-1][1], high))
                else:
                    own.append((low, high))
        out = []
        for item, own in windows.items():
            item_id, n, k, masks = self.items[item]
            best = min((self._distance(words[a:b], n, masks, a) for a, b in own), default=(k + 1, 0))
            if best[0] <= k:
                end = best[1]
                back = {w: _reversed(m, n) for w, m in masks.items()}
                from_ = max(0, end - n - k)
                _, length = self._distance(words[from_:end][::-1], n, back, 0, best[0])
                out.append((item_id, best[0], end - length, end))
        return out

    @staticmethod
    def _distance(words: list[str], n: int, masks: dict[str, int], base: int, stop: int | None = None) -> tuple[int, int]:
        """(least distance of the item to a run of words, where that run ends). The run may start anywhere."""
        full, top = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score, best = full, 0, n, (n, base)
        for j, w in enumerate(words):
            eq = masks.get(w, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = (ph << 1) & full, (mh << 1) & full
            plus, minus = mh | (full & ~(xv | ph)), ph & xv
            if score < best[0]:
                best = (score, base + j + 1)
                if stop is not None and score <= stop:
                    break
        return best


def _reversed(mask: int, n: int) -> int:
    return int(f"{mask:0{n}b}"[::-1], 2)


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS, least: int = LEAST_WORDS) -> DataFrame:
    """(id, item, distance, first_word, end_word, text_hash) for each document and item of which it holds a passage.

    A passage is a run of the document's words within edits * (the item's words) insertions, deletions and substitutions
    of the whole item; the one with the least distance, first of these, is given. Case, punctuation and blanks don't
    count. Null and empty texts hold nothing; items of fewer than `least` words are searched without edits, those
    without words, or null, not at all. Each letter of a script without blanks (Chinese, Japanese, Thai) is a word. Repeated rows
    give their rows each; equal items too; null ids stay. No items or no documents: no rows.

    text_hash is xxhash64 of the document's text. Very long texts are searched whole. Other columns aren't read, so none clashes.

    Documents are read where they lie: nothing is shuffled, so no passage is hot. Items come to every task in blocks of
    about AUTOMATON code points, one pass for each block.
    """
    spark = df.sparkSession
    small_batches(spark)
    ids, keys = df.schema[id_col].dataType, items.schema[item_col].dataType
    item_type = to_arrow_type(keys)
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = 1 + total // AUTOMATON
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    out = None
    for p in range(passes):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p) if passes > 1 else items
        own = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])  # bounded by AUTOMATON

        def run(batches, own=own):
            searcher = Searcher(own.value, edits, least)
            for b in batches:
                found = [(row, *hit) for row, text in enumerate(b.column(1)) for hit in searcher.search(text.as_py())]
                c = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], item_type), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), b.column(2).take(pa.array(c[0], pa.int64()))], names=["id", "item", "distance", "first_word", "end_word", "text_hash"])

        part = docs.mapInArrow(run, f"id {ids.simpleString()}, item {keys.simpleString()}, distance int, first_word long, end_word long, text_hash long")
        out = part if out is None else out.union(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: `contaminated` over the whole tables `documents` and `benchmark`; see there for nulls, ties and empty tables."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
