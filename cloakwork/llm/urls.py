"""Operator 5: URL filter rules indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import literal_rows

#: Up to this many rules the index is broadcast; a larger one is joined by shuffles on the token.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A pattern over lower-cased host + path. tokens: literal runs of letters and digits, at least one, that are whole tokens of any url that fits."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    listed: bool = False


def listed(verdict: str, host: str, path: str) -> Rule:
    """A rule that fits host and its subdomains where the url's path starts with path."""
    closed = path if re.search(r"[^0-9A-Za-z]$", path) else re.sub(r"[0-9A-Za-z]+$", "", path)  # the last token of a prefix may go on
    tokens = re.findall(r"[0-9a-z]+", f"{host}{closed}".translate(str.maketrans(UPPER, LOWER)))
    return Rule(host + path, rf"(?s)^(?:[^/]*\.)?\Q{host}{path}\E.*", tuple(tokens), verdict, True)


#: The rules that the contract lists.
CONTRACT = (listed("block", "com", "/en/"), listed("allow", "example.com", "/en/7"), listed("allow", "net", "/de/"), listed("block", "example.net", "/de/8"), listed("block", "org", "/es/"))
#: The method's own patterns, for urls that no listed rule fits: hosts and pages that bring spam, adult matter, adverts or logins.
PATTERNS = (
    Rule("spam-farm", r"(?s)^(?:[^/]*\.)?spam-farm\..*", ("spam", "farm"), "block"),
    Rule("casino", r"(?s)^(?:[^/]*[.-])?casino[.-].*", ("casino",), "block"),
    Rule("poker", r"(?s)^(?:[^/]*[.-])?poker[.-].*", ("poker",), "block"),
    Rule("porn", r"(?s)^(?:[^/]*[.-])?porn[.-].*", ("porn",), "block"),
    Rule("xxx", r"(?s)^(?:[^/]*[.-])?xxx(?:[.-].*|/.*|)$", ("xxx",), "block"),
    Rule("viagra", r"(?s).*(?:^|[./_-])viagra(?:[./_-].*|)$", ("viagra",), "block"),
    Rule("doubleclick", r"(?s)^(?:[^/]*\.)?doubleclick\.net(?:/.*|)$", ("doubleclick", "net"), "block"),
    Rule("login page", r"(?s)^[^/]*(?:/.*)?/wp-login\.php$", ("wp", "login", "php"), "block"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def judge(df: DataFrame, rules: tuple[Rule, ...] = CONTRACT + PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for each row of df.

    rule: the longest listed rule that fits (by name where as long), else null; pattern: the method's pattern that fits
    then, else null; verdict: theirs, `allow` where nothing fits. Null or odd urls have an empty host and path and are
    allowed. Repeated rows each give a row; null ids stay; other columns aren't read.

    Each rule stands in the index under its token that is rarest in df's urls. A url's distinct tokens fetch candidates,
    only those run their regular expressions. Equal (id, url) rows are counted first, so hot ones meet as one.
    """
    spark = df.sparkSession
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("__url"))
    host, path = parts(F.col("__url"))
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(lower_ascii(c), F.lit(r"([0-9a-z]+)"), 1))
    pages = base.groupBy("id", "__url").agg(F.count("*").alias("__n")).withColumn("host", host).withColumn("path", path)
    pages = pages.withColumn("__at", F.concat("host", "path"))
    if not rules:
        hits = pages.withColumns({"rule": F.lit(None).cast("string"), "pattern": F.lit(None).cast("string"), "verdict": F.lit("allow")})
        return _rows(hits, id_col)
    names = sorted({t for r in rules for t in r.tokens})
    known = literal_rows(spark, [{"token": t} for t in names], "token string")
    small = len(names) <= BROADCAST_RULES
    seen = base.withColumn("host", host).withColumn("path", path).select(F.explode(tokens(F.concat("host", "path"))).alias("token"))
    seen = seen.join(F.broadcast(known) if small else known, "token").groupBy("token").count()
    often = {r.token: r["count"] for r in seen.collect()}  # no more rows than the rules have tokens
    rarest = [{"token": min(r.tokens, key=lambda t: (often.get(t, 0), t)), "name": r.name, "regex": r.pattern, "verdict": r.verdict, "listed": r.listed} for r in rules]
    index = literal_rows(spark, rarest, "token string, name string, regex string, verdict string, listed boolean")
    tokened = pages.select("id", "__url", "__n", "host", "path", "__at", F.explode_outer(tokens(F.col("__at"))).alias("token"))
    found = tokened.join(F.broadcast(index) if small else index, "token", "left")
    fits = F.expr("CASE WHEN regex IS NOT NULL THEN rlike(__at, regex) ELSE false END")
    rank = F.when(fits, F.struct(F.length("name").alias("l"), F.col("name").alias("name"), F.col("verdict").alias("verdict")))
    hits = found.groupBy("id", "__url", "__n", "host", "path").agg(F.max(F.when(F.col("listed"), rank)).alias("a"), F.max(F.when(~F.col("listed"), rank)).alias("b"))
    hits = hits.select("id", "__n", "host", "path", F.col("a.name").alias("rule"), F.when(F.col("a").isNull(), F.col("b.name")).alias("pattern"), F.coalesce("a.verdict", "b.verdict", F.lit("allow")).alias("verdict"))
    return _rows(hits, id_col)


def _rows(hits: DataFrame, id_col: str) -> DataFrame:
    """Each row as often as it was there."""
    out = hits.withColumn("__k", F.explode(F.expr("sequence(1L, __n)")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "pattern")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows: every page's host, path, rule and verdict; a null url has an empty host and path."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _duck(patterns: tuple[Rule, ...]) -> str:
    test = lambda r: f"regexp_matches(loc, '{r.pattern.replace(chr(92) + 'Q', '').replace(chr(92) + 'E', '')}')"
    rules = sorted((r for r in patterns if r.listed), key=lambda r: (-len(r.name), r.name[::-1]))
    own = sorted((r for r in patterns if not r.listed), key=lambda r: (len(r.name), r.name), reverse=True)
    pick = lambda rs, v: "CASE " + " ".join(f"WHEN {test(r)} THEN '{v(r)}'" for r in rs) + " END"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, host || path AS loc FROM b),
d AS (SELECT page_id, host, path, {pick(rules, lambda r: r.name)} AS rule, {pick(rules, lambda r: r.verdict)} AS v, {pick(own, lambda r: r.name)} AS p, {pick(own, lambda r: r.verdict)} AS w FROM c)
SELECT page_id, host, path, rule, coalesce(v, w, 'allow') AS verdict, CASE WHEN rule IS NULL THEN p END AS pattern FROM d
"""


OP5_SQL = _duck(CONTRACT + PATTERNS)
