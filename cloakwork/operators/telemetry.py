"""Telemetry of detection runs: totals, minutes, errors, metric periods and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import percentiles

#: US dollars for a million tokens.
PRICE_IN, PRICE_OUT, PRICE_READ, PRICE_WRITE = 3.0, 15.0, 0.30, 3.75


def attribute(name: str, kind: str = "long", column: str = "attributes") -> Column:
    return F.get_json_object(column, f"$.{name}").try_cast(kind)


def summary(spans: DataFrame, failed: Column, tokens: dict[str, Column]) -> DataFrame:
    """Spans in all, failed and successful; total and average of each token count. A missing cache count is 0 in averages, a missing other count isn't counted."""
    n = [F.count("*").alias("total_spans"), F.coalesce(F.sum(failed.cast("int")), F.lit(0)).alias("failed_spans"), F.coalesce(F.sum((~failed).cast("int")), F.lit(0)).alias("successful_spans")]
    for name, c in tokens.items():
        c = F.coalesce(c, F.lit(0)) if name.startswith("cache") else c
        n += [F.sum(c).alias(f"total_{name}"), F.avg(c.cast("double")).alias(f"avg_{name}")]
    return spans.agg(*n)


def per_minute(spans: DataFrame, at: str, failed: Column, tokens: Column) -> DataFrame:
    return spans.groupBy(F.date_trunc("minute", at).alias("minute")).agg(F.count("*").alias("total_requests"), F.count_if(failed).alias("failures"), F.count_if(~failed).alias("successes"), F.sum(tokens).alias("tokens_used"))


def category(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.contains("too many tokens"), "Too many tokens (TPM)").when(m.contains("too many requests"), "Too many requests (RPM)").otherwise("Other")


def errors(spans: DataFrame, kind: str, message: str) -> DataFrame:
    """(type, message, n, share), most first. The total is one row, joined by broadcast."""
    counts = spans.groupBy(kind, message).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total").orderBy(F.desc("n"), kind, message)


def in_range(spans: DataFrame, at: str, start, end) -> DataFrame:
    """Spans from start to end, both included; a bound that is None doesn't count."""
    for bound, cond in ((start, lambda v: F.col(at) >= v), (end, lambda v: F.col(at) <= v)):
        spans = spans if bound is None else spans.filter(cond(F.lit(bound).cast(spans.schema[at].dataType)))
    return spans


def totals(minutes: DataFrame) -> DataFrame:
    """One row over what per_minute() gives: requests, failures, successes, tokens, and tokens for each minute that has a span."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("total_requests", "failures", "successes", "tokens_used")]
    out = minutes.agg(F.count("*").alias("minutes"), *sums).withColumnRenamed("total_total_requests", "total_requests")
    return out.withColumn("avg_tokens_per_minute", F.coalesce(F.try_divide("total_tokens_used", "minutes"), F.lit(0.0)))


def rates(total: DataFrame) -> DataFrame:
    """What summary() gives with the success rate and the share of input read from cache, in percent, null where nothing was counted."""
    percent = lambda a, b: F.try_divide(F.col(a) * 100.0, F.col(b))
    return total.withColumns({"success_rate": percent("successful_spans", "total_spans"), "cache_hit_rate": percent("total_cache_read", "total_input")})


def category_report(spans: DataFrame, kind: str, message: str, most: int = 70) -> DataFrame:
    """(category, n, percent, sample), most first: the sample is the most frequent message of a category, cut to `most` characters.

    Equal messages are counted before anything else is shuffled; the total is one row, joined by broadcast.
    """
    counts = spans.groupBy(kind, message).agg(F.count("*").alias("n"))
    first = F.min_by(F.coalesce(message, F.lit("")), F.struct(-F.col("n"), kind, message))
    out = counts.groupBy(category(F.col(message)).alias("category")).agg(F.sum("n").alias("n"), first.alias("sample"))
    total = counts.agg(F.sum("n").alias("total"))
    cut = F.when(F.length("sample") > most, F.concat(F.left("sample", F.lit(most - 3)), F.lit("..."))).otherwise(F.col("sample"))
    return out.join(F.broadcast(total)).select("category", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"), cut.alias("sample")).orderBy(F.desc("n"), "category")


def number(c: Column, whole: bool = True) -> Column:
    """A number with commas between thousands; two decimals unless whole; N/A where missing."""
    return F.coalesce(F.format_number(c, 0 if whole else 2), F.lit("N/A"))


def percent(c: Column, places: int = 1) -> Column:
    return F.coalesce(F.concat(F.format_number(c, places), F.lit("%")), F.lit("N/A"))


def rows_of(data: DataFrame, columns: str = "columns") -> DataFrame:
    """Rows from columns as a service sends them, array<struct<name, values>>: values of equal place go together, missing ones are null."""
    n = F.array_max(F.transform(columns, lambda c: F.size(c["values"])))
    rows = data.select(F.col(columns).alias("c"), n.alias("n"))
    rows = rows.select("c", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("place"))
    return rows.select("place", F.map_from_entries(F.transform("c", lambda c: F.struct(c["name"], F.get(c["values"], F.col("place"))))).alias("row"))


def first_value(name: str, default: Column, columns: str = "columns") -> Column:
    """The first value of a column as a service sends it, or the default."""
    own = F.get(F.filter(columns, lambda c: c["name"] == name), 0)
    return F.coalesce(F.get(own["values"], 0), default)


def periods(points: DataFrame, at: str, value: str, by: list[str], length: str = "5 minutes") -> DataFrame:
    """Count, sum, average, p50, p95 and maximum of each period and dimension, exact.

    Equal values are counted first, combined before the shuffle; then values are range-sorted over tasks with running counts, so a
    period that holds most rows is split however much its values differ, and only the values beside a rank are fetched.
    """
    keys = ["period", *by]
    counts = points.select(F.window(at, length)["start"].alias("period"), *by, F.col(value).alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    known = F.sum(F.when(F.col("v").isNotNull(), F.col("c")))
    sums = (F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), known.alias("known"), F.max("v").alias("most"))
    found = percentiles(counts, keys, "v", "c", {"p50": 0.5, "p95": 0.95}, *sums)
    return found.select(*keys, "n", "total", (F.col("total") / F.col("known")).alias("average"), "p50", "p95", "most")


def cost(read: Column, write: Column, input_: Column, output: Column) -> Column:
    """Dollars, cached input at its own price; input that isn't cached is never negative."""
    plain = F.greatest(F.lit(0), input_ - read - write)
    return (plain * PRICE_IN + read * PRICE_READ + write * PRICE_WRITE + output * PRICE_OUT) / 1_000_000


def savings(read: Column) -> Column:
    return read * (PRICE_IN - PRICE_READ) / 1_000_000
