"""Queries of windows over event time, and of the driver tables as sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import read

Q, S = {}, {}


def add(name, query, sql):
    Q[name], S[name] = query, sql


add("events_tumbling", lambda s, d: read(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total"), "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
add("events_sessions", lambda s, d: read(s, d, "events").groupBy(F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n"), """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM k GROUP BY user_id, s""")
add("flagship_pricing", lambda s, d: read(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")), "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
