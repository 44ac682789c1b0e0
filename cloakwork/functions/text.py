"""Scalar expressions over text, paths, types and numbers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..model import MANIFEST_TYPES, MARITAL


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of key, else null: a chain of conditions that folds into generated code, unlike a map literal."""
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, although body's lambdas name it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def stem(path: Column) -> Column:
    """Last part of a path without what follows its last dot; `.hidden` gives an empty string."""
    return F.regexp_replace(F.element_at(F.split(path, "/", -1), -1), r"\.[^.]*$", "")


def approved_id(path: Column) -> Column:
    """Note id of an approval file's path, null where it has none."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/", -1), -1), r"^(.*)_approved\.txt$", 1), F.lit(""))


def quoted(value: Column) -> Column:
    """A regular expression that matches value literally."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def whole_word(value: Column) -> Column:
    r"""value between Unicode word boundaries: a value that begins or ends with punctuation rarely matches."""
    return F.concat(F.lit(r"(?U)\b"), quoted(value), F.lit(r"\b"))


def not_in_word(value: Column) -> Column:
    """value without a word character before or after it."""
    return F.concat(F.lit(r"(?U)(?<!\w)"), quoted(value), F.lit(r"(?!\w)"))


def replacement(tag: Column) -> Column:
    """tag as a literal replacement: Java reads $ and backslash."""
    return F.regexp_replace(tag, r"([\\$])", r"\\$1")


def starts(text: Column, pattern: Column, found: Column | None = None, length: Column | None = None) -> Column:
    """array<struct<start, end>> of a pattern's matches in code points, from the pieces between them.

    Either all matches are `length` long or `found` lists them.
    """
    pieces = F.call_function("split", text, pattern, F.lit(-1))
    first = F.slice(pieces, 1, F.size(pieces) - 1)
    if found is None:
        steps = F.transform(first, lambda gap: F.struct(F.length(gap).alias("gap"), length.alias("size")))
    else:
        steps = F.zip_with(first, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
    return _running(steps)


def _running(steps: Column, chunk: int = 128) -> Column:
    """array<struct<start, end>> of array<struct<gap, size>>: each starts a gap after the end before it.

    A fold copies what it has gathered at every step, so chunks are summed first and each is then unrolled from its own offset: a
    text with very many matches costs a chunk for each match, not all matches before it.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    size = F.lit(chunk)

    def cut(xs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int"))
        return F.when(F.size(xs) > 0, F.transform(chunks, lambda c: F.slice(xs, c * size + 1, size))).otherwise(F.array().cast("array<array<struct<gap:int,size:int>>>"))

    def based(all_parts: Column) -> Column:
        total = F.transform(all_parts, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(total, seed, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.zip_with(all_parts, bases, lambda p, base: F.struct(p.alias("part"), base.alias("base")))

    def unrolled(p: Column) -> Column:
        def step(acc, x):
            start = acc["at"] + x["gap"]
            one = F.struct(start.alias("start"), (start + x["size"]).alias("end"))
            return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(p["part"], F.struct(p["base"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(let(let(steps, cut), based), unrolled))


def alpha_id(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, ...; up to six letters."""
    def step(acc, _):
        more = acc["n"] > 0
        letter = F.chr(F.pmod(acc["n"] - 1, F.lit(26)) + 65)
        rest = F.floor((acc["n"] - 1) / 26).cast("int")
        return F.struct(F.when(more, rest).otherwise(acc["n"]).alias("n"), F.when(more, F.concat(letter, acc["s"])).otherwise(acc["s"]).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.struct(n.cast("int").alias("n"), F.lit("").alias("s")), step, lambda acc: acc["s"])


def manifest_type(t: Column, predicted: bool) -> Column:
    """The name under which a type is compared: predicted ones are mapped, all else is upper-cased."""
    return F.coalesce(lookup(MANIFEST_TYPES, F.lower(t)), F.upper(t)) if predicted else F.upper(t)


def trivial(value: Column) -> Column:
    """Blanks, or commas around blanks; the empty string is not trivial."""
    return (value != "") & value.rlike(r"(?U)^,*\s*,*$")


def lenient_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def counter_name(t: Column) -> Column:
    return F.concat(F.lit("pii_"), F.replace(F.lower(F.coalesce(t, F.lit("unknown"))), F.lit(" "), F.lit("_")))


def label(t: Column) -> Column:
    return F.initcap(F.replace(F.lower(t), F.lit("_"), F.lit(" ")))


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\d", "")


def rounded(c: Column) -> Column:
    """Half to even, as a string; null and 0 give an empty string."""
    return F.when(c.isNull() | (c == 0), "").otherwise(F.bround(c).cast("long").cast("string"))


def readable(c: Column) -> Column:
    """`2024-01-15, 02:05 PM` of an ISO timestamp's own wall clock; what can't be read stays as it is."""
    local = F.try_to_timestamp(F.substring(F.replace(c, F.lit("T"), F.lit(" ")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.date_format(local, "yyyy-MM-dd, hh:mm a"), c)


def age(birth: Column, at: Column) -> Column:
    """Years completed at a date; 0 where either is missing."""
    before = F.struct(F.month(at), F.dayofmonth(at)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.coalesce(F.year(at) - F.year(birth) - before.cast("int"), F.lit(0))


def marital(code: Column) -> Column:
    return F.coalesce(lookup(MARITAL, code), F.lit(""))


def joined(*parts: Column) -> Column:
    """Parts that aren't empty, comma-separated."""
    return F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))


def evaluation_time(name: Column) -> Column:
    """`eval_YYYYmmdd_HHMMSS.json` as a readable time, else the name."""
    p = r"^eval_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})\.json$"
    g = [F.regexp_extract(name, p, i) for i in range(1, 7)]
    return F.when(name.rlike(p), F.concat(g[0], F.lit("-"), g[1], F.lit("-"), g[2], F.lit(" "), g[3], F.lit(":"), g[4], F.lit(":"), g[5])).otherwise(name)


def bounded_limit(c: Column, default: int = 50, most: int = 200) -> Column:
    return F.greatest(F.lit(1), F.least(F.coalesce(F.expr("CAST(NULL AS INT)") if c is None else c.try_cast("int"), F.lit(default)), F.lit(most)))
