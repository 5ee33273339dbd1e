"""Batch twins of the streaming operators (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillmill.plans.registry import query
from quillmill.plans.views import Tables
from quillmill.streaming import events


@query("x01_tumbling_windows", """
    SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def x01(t: Tables) -> DataFrame:
    return events.tumbling(t.raw("events"))


@query("x02_sliding_windows", """
    WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS e, event_type FROM events), w AS (SELECT e - e % 1800 - 1800 * k AS start, event_type, e FROM s, range(0, 2) r(k))
    SELECT start, event_type, count(*) AS events FROM w WHERE e < start + 3600 GROUP BY 1, 2""")
def x02(t: Tables) -> DataFrame:
    return events.sliding(t.raw("events"))


@query("x03_sessions", """
    WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) + 600 AS "end", count(*) AS events FROM g GROUP BY user_id, s""")
def x03(t: Tables) -> DataFrame:
    return events.sessions(t.raw("events"))
