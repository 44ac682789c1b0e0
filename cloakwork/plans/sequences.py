"""Queries over sequences: word differences, order statistics, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.diff import word_diff
from ..sources.files import table
from .catalogue import query

_WEEKS = """weeks AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS week, list(event_type ORDER BY ts, event_id) AS w FROM events GROUP BY ALL),
pairs AS (SELECT b.user_id, b.week, a.w AS x, b.w AS y FROM weeks a JOIN weeks b ON a.user_id = b.user_id AND a.week + 1 = b.week)"""


@query(f"""WITH RECURSIVE {_WEEKS},
r AS (SELECT user_id, week, 0 AS i, list_transform(range(len(y) + 1), lambda j: 0::BIGINT) AS best FROM pairs
  UNION ALL
  SELECT user_id, week, i + 1, list_transform(range(len(y) + 1), lambda j: list_max(list_transform(range(j + 1), lambda t: CASE WHEN t > 0 AND x[i + 1] = y[t] THEN best[t] + 1 ELSE best[t + 1] END)))
  FROM r JOIN pairs USING (user_id, week) WHERE i < len(x))
SELECT (user_id * 1000 + week)::BIGINT AS key, (len(x) - best[len(y) + 1])::BIGINT AS removed, (len(y) - best[len(y) + 1])::BIGINT AS added, best[len(y) + 1] AS unchanged
FROM r JOIN pairs USING (user_id, week) WHERE i = len(x)""")
def activity_diff(spark, d):
    """What each user did in a week against the week before, as a minimal word diff of the two sequences of event types."""
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7)
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    weeks = table(spark, d, "events").groupBy("user_id", week.alias("week")).agg(F.array_join(F.transform(steps, lambda s: s["event_type"]), " ").alias("text"))
    before = weeks.select("user_id", (F.col("week") + 1).alias("week"), F.col("text").alias("before"))
    pairs = before.join(weeks, ["user_id", "week"]).select((F.col("user_id") * 1000 + F.col("week")).alias("key"), "before", "text")
    return word_diff(pairs, "key", "before", "text")
