"""Batch forms of the streaming queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import Tables, query
from tessera.streaming import events as e


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, (time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY)::TIMESTAMP AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_days(x: Tables) -> DataFrame:
    return e.tumbling(x.events, "1 day").withColumn("total", F.round("total", 4))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(x: Tables) -> DataFrame:
    return e.sessions(x.events, "6 hours")
