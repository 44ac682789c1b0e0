"""Operator 8: secret scan with multipart credential linking. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut

#: Parts of one credential lie within this many code points of each other.
SCOPE = 300
#: The base patterns. `{24,}` and `{16,}` match as `+` with the shorter matches dropped would, as any such match ends where its run ends.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The method's weak parts, reported only beside complementary ones: named identifiers, mixed strings, endpoints.
IDENT = r"""(?i:client_?id|access_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{0,64}[0-9])(?=[A-Za-z0-9+/_-]{0,64}[A-Z])(?=[A-Za-z0-9+/_-]{0,64}[a-z])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?:https?|postgres(?:ql)?|mysql|redis|mongodb|amqp|s3)://[^\s"'<>]+"""
#: Order of kinds at the same start; base kinds first. role: what a kind brings to a credential.
KINDS = (("assign", ASSIGN, "secret"), ("access", ACCESS, "id"), ("hex", HEX, "secret"), ("ident", IDENT, "id"), ("key", KEY, "secret"), ("endpoint", ENDPOINT, "endpoint"))
BASE = 3


def spans(text: Column, pattern: str, least: int = 0) -> Column:
    """array<struct<start, end>> of the pattern's matches, in code points, end exclusive.

    Offsets come from the lengths of what lies between matches, as positions of regular expressions count UTF-16 units.
    least: of group 2's length.
    """
    lit = F.lit(pattern)
    found = F.regexp_extract_all(text, lit, F.lit(0))
    fine = F.transform(F.regexp_extract_all(text, lit, F.lit(2)), lambda g: F.length(g) >= least) if least else F.transform(found, lambda _: F.lit(True))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.arrays_zip(found.alias("m"), fine.alias("ok")), F.slice(between, 1, F.size(found)), lambda f, b: F.struct(F.length(b).alias("gap"), F.length(f["m"]).alias("len"), f["ok"].alias("ok")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, s):
        at = acc["at"] + s["gap"]
        span = F.struct(at.alias("start"), (at + s["len"]).alias("end"))
        return F.struct((at + s["len"]).alias("at"), F.when(s["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(none)


def _line(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k, _, _ in KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _tagged(c: str, k: int) -> Column:
    return F.transform(F.col(c), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for each row of df.

    Null text counts as empty. Rows that repeat both id and text share one result, each with its row. An empty table gives
    no rows; other columns aren't read.

    Weak parts: an identifier counts with a secret (base or key) within `scope` code points, a key with an identifier or an
    endpoint, an endpoint with both. Parts that overlap a base span aren't weak parts. The interval join goes by bins of
    `scope`: of each bin only the first and last part of a role are joined, so its rows grow with the parts, not their pairs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("doc"), text.alias("text"))
    rows = rows.select("doc", *(spans(F.col("text"), p, 6 if k == "assign" else 0).alias(k) for k, p, _ in KINDS))
    base = F.flatten(F.array(*(_tagged(k, i + 1) for i, (k, _, _) in enumerate(KINDS[:BASE]))))
    weak = F.flatten(F.array(*(_tagged(k, i + 1) for i, (k, _, _) in enumerate(KINDS) if i >= BASE)))
    rows = rows.select("doc", *(F.size(k).cast("long").alias(f"n_{k}") for k, _, _ in KINDS[:BASE]), base.alias("base"), weak.alias("weak"))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = cut(rows.withColumn("weak", F.when(F.size("weak") > 0, F.filter("weak", clear)).otherwise(F.col("weak"))))

    role = F.element_at(F.array(*(F.lit(r) for _, _, r in KINDS)), F.col("p.kind")).alias("role")
    busy = rows.filter((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    part = busy.select("doc", F.explode(F.concat("base", "weak")).alias("p")).select("doc", "p.start", "p.kind", "p.end", role)
    part = part.withColumn("bin", F.floor(F.col("start") / scope))
    ends = part.groupBy("doc", "role", "bin").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    ends = ends.select("doc", F.col("role").alias("other"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "first", "last")
    near = (F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope)
    met = part.filter(F.col("kind") > BASE).join(ends, ["doc", "bin"]).filter(near & (F.col("role") != F.col("other")))
    has = lambda r: F.max(F.when(F.col("other") == r, 1).otherwise(0))
    met = met.groupBy("doc", "role", "start", "kind", "end").agg(has("id").alias("i"), has("secret").alias("s"), has("endpoint").alias("e"))
    met = met.filter("(role = 'id' AND s = 1) OR (role = 'secret' AND i + e > 0) OR (role = 'endpoint' AND i + s = 2)")
    linked = met.groupBy("doc").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))

    out = rows.select("doc", "n_assign", "n_access", "n_hex", "base").join(linked, "doc", "left")
    more = F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return out.select(
        F.col("doc.id").alias(id_col), "n_assign", "n_access", "n_hex",
        F.sha2(_line(F.col("base")).cast("binary"), 256).alias("base_sha256"), _line(F.concat("base", more)).alias("spans"), F.size(more).cast("long").alias("n_linked"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows: every document's base counts and spans, with those that linking adds; null text is empty."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
