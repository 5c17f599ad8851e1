"""Queries of the run-log operators on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from .bindings import RUN, read, run_ticks

Q, S = {}, {}


def add(name, query, sql):
    Q[name], S[name] = query, sql


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


add("run_cumulative", lambda s, d: r6(R.cumulative(run_ticks(s, d), ["agent"]), "total").select("agent", "tick", "total"), f"WITH {RUN} SELECT agent, tick, round(sum(value) OVER (PARTITION BY agent ORDER BY tick), 6) AS total FROM run")
add("run_series", lambda s, d: R.series(run_ticks(s, d), F.col("agent") == 7), f"WITH {RUN} SELECT tick, value FROM run WHERE agent = 7")
add("run_sum_to", lambda s, d: r6(R.sum_to(run_ticks(s, d), 25, ["agent"]), "total"), f"WITH {RUN} SELECT agent, round(sum(value), 6) AS total FROM run WHERE tick <= 25 GROUP BY agent")
add("run_index", lambda s, d: R.tick_at(run_ticks(s, d).withColumn("t", F.col("ms") / 1000), s.range(40).select((F.col("id") % 20).alias("agent"), (F.lit(1704067200.0) + F.col("id") * 63000).alias("at")), ["agent"]), f"""WITH {RUN}, q AS (SELECT i % 20 AS agent, 1704067200.0::DOUBLE + i * 63000 AS "at" FROM range(40) t(i))
SELECT q.agent, q."at", coalesce(max(tick) FILTER (ms / 1000.0::DOUBLE - 1e-6 <= q."at"), min(tick), 0) AS index FROM q LEFT JOIN run r ON r.agent = q.agent GROUP BY ALL""")
add("run_legs", lambda s, d: R.leg_of(run_ticks(s, d), run_ticks(s, d).filter("event_type = 'purchase'").select("agent", F.col("tick").alias("start"), F.col("event_id").alias("leg")), ["agent"]), f"""WITH {RUN} SELECT agent, tick, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY agent ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS leg FROM run""")
add("run_stack", lambda s, d: R.stack([run_ticks(s, d).filter("agent = 3"), run_ticks(s, d).filter("agent = 4")]).select("arm", "tick", "value"), f"WITH {RUN} SELECT (agent - 3)::INT AS arm, tick, value FROM run WHERE agent IN (3, 4) AND tick <= (SELECT least(max(tick) FILTER (agent = 3), max(tick) FILTER (agent = 4)) FROM run)")


def agents(s, d):
    return R.collect(run_ticks(s, d).select("agent", "tick", F.col("value").alias("x"), (F.col("value") * 2).alias("y"), (F.col("event_id") % 7 / 2).alias("heading"), (100 - F.col("value")).alias("goal"), (F.col("event_type") == "purchase").alias("reached"), (F.col("event_id") % 3 > 0).alias("rolled"), (F.col("event_id") % 5 == 0).alias("contact")), ["agent"])


add("run_collector", lambda s, d: r6(agents(s, d), "path", "turning"), f"""WITH {RUN}, k AS (SELECT agent, tick, value AS x, value * 2 AS y, (event_id % 7) / 2.0::DOUBLE AS h, 100 - value AS g, event_type = 'purchase' AS reached, event_id % 3 > 0 AS rolled, event_id % 5 = 0 AS contact FROM run),
f AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS st, abs(h - lag(h) OVER w) AS dh, reached AND NOT coalesce(lag(reached) OVER w, false) AS rise, contact AND NOT coalesce(lag(contact) OVER w, false) AS hit,
  min(g) OVER (PARTITION BY agent ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER w - row_number() OVER (PARTITION BY agent, rolled ORDER BY tick) AS run FROM k WINDOW w AS (PARTITION BY agent ORDER BY tick)),
o AS (SELECT agent, max(n) >= 3 AS rolled_over FROM (SELECT agent, run, count(*) AS n FROM f WHERE rolled GROUP BY ALL) GROUP BY agent)
SELECT f.agent, count(*) AS ticks, round(coalesce(sum(st), 0), 6) AS path, round(coalesce(sum(dh), 0), 6) AS turning, count(*) FILTER (dh > 0.5) AS turns, min(tick) FILTER (rise) AS arrived, count(*) FILTER (g > best - 0.05) AS stalls, count(*) FILTER (hit) AS hits, coalesce(any_value(o.rolled_over), false) AS rolled_over
FROM f LEFT JOIN o ON o.agent = f.agent GROUP BY f.agent""")


def card(s, d):
    o = read(s, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("arrived"), F.col("o_totalprice").alias("time"), (F.col("o_totalprice") / 3).alias("path"), (F.col("o_custkey") % 4).alias("hits"), (F.col("o_orderkey") % 11 == 0).alias("rolled_over"), F.col("o_orderpriority").alias("arm"))
    return r6(R.scorecard(o, ["arm"]), "arrival_rate", "mean_time", "p95_time", "mean_path", "hits_per_episode", "rollover_rate")


add("run_scorecard", card, """SELECT o_orderpriority AS arm, count(*) AS episodes, round(avg((o_orderstatus = 'F')::INT), 6) AS arrival_rate, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS mean_time, round(quantile_cont(o_totalprice, 0.95) FILTER (o_orderstatus = 'F'), 6) AS p95_time,
round(avg(o_totalprice / 3) FILTER (o_orderstatus = 'F'), 6) AS mean_path, round(sum(o_custkey % 4) / count(*), 6) AS hits_per_episode, round(avg((o_orderkey % 11 = 0)::INT), 6) AS rollover_rate FROM orders GROUP BY 1""")
add("run_episodes", lambda s, d: r6(read(s, d, "orders").join(read(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("episode")).agg(F.count_distinct("l_orderkey").alias("vehicles"), F.count_if(F.col("l_linestatus") == "F").alias("goals"), F.sum("l_quantity").alias("length")), "length"), "SELECT o_custkey AS episode, count(DISTINCT l_orderkey) AS vehicles, count(*) FILTER (l_linestatus = 'F') AS goals, round(sum(l_quantity), 6) AS length FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")


def cover(s, d):
    cell = s.range(400).select(F.floor(F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), (F.col("id") % 3 == 0).cast("int").alias("occ"))
    b = read(s, d, "events").select((F.col("user_id") % 20).cast("int").alias("r"), (F.col("event_id") % 20).cast("int").alias("c"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 2).cast("int").alias("occ"))
    return r6(R.coverage(cell, b), "known", "right", "missed", "phantom")


add("run_coverage", cover, """WITH t AS (SELECT i // 20 AS r, i % 20 AS c, (i % 3 = 0)::INT AS truth FROM range(400) x(i)), b AS (SELECT user_id % 20 AS r, event_id % 20 AS c, CASE WHEN event_id % 7 > 0 THEN event_id % 2 END AS occ FROM events)
SELECT round(avg((occ IS NOT NULL)::INT), 6) AS known, round(avg(coalesce(occ = truth, false)::INT), 6) AS right, round(avg(coalesce(occ = 0 AND truth = 1, false)::INT), 6) AS missed, round(avg(coalesce(occ = 1 AND truth = 0, false)::INT), 6) AS phantom FROM b JOIN t USING (r, c)""")
add("run_time_share", lambda s, d: r6(R.time_share(run_ticks(s, d), "event_type", "value"), "share"), f"WITH {RUN} SELECT event_type, round(sum(value) / (SELECT sum(value) FROM run), 6) AS share FROM run GROUP BY 1")
add("run_panels", lambda s, d: r6(run_ticks(s, d).groupBy((F.col("agent") % 4).alias("arm")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("tick").alias("last")), "mean"), f"WITH {RUN} SELECT agent % 4 AS arm, count(*) AS n, round(avg(value), 6) AS mean, max(tick) AS last FROM run GROUP BY 1")
add("run_decimate", lambda s, d: R.decimate(run_ticks(s, d).select("agent", F.col("tick").alias("i"), F.col("value").alias("y")), 20, ["agent"]), f"""WITH {RUN}, p AS (SELECT agent, tick AS i, value AS y, max(tick) OVER (PARTITION BY agent) + 1 AS n FROM run), b AS (SELECT *, (i - 1) // ceil((n - 2) / 6.0)::BIGINT AS b FROM p),
k AS (SELECT agent, min_by(i, y * 1e9 + i / 1e3) AS lo, min_by(i, -y * 1e9 + i / 1e3) AS hi FROM b WHERE n > 20 AND i > 0 AND i < n - 1 GROUP BY agent, b)
SELECT agent, i, y FROM p WHERE n <= 20 OR i = 0 OR i = n - 1 UNION SELECT p.agent, p.i, p.y FROM p JOIN k ON k.agent = p.agent AND (p.i = k.lo OR p.i = k.hi)""")
add("run_column_means", lambda s, d: r6(R.column_means(run_ticks(s, d).select(F.col("tick").alias("x"), F.col("value").alias("y"), "agent"), 0, 60, 12, ["agent"]), "mean"), f"WITH {RUN} SELECT agent, (tick / 60.0 * 12)::DOUBLE::INT * 0 + floor(tick / 5)::INT AS \"column\", round(avg(value), 6) AS mean FROM run WHERE tick < 60 GROUP BY ALL")
add("run_candidates", lambda s, d: r6(R.candidates(run_ticks(s, d).select((F.col("agent") % 12).alias("candidate"), F.col("event_id").alias("step"), (F.col("value") - 50).alias("value"), F.col("value").alias("loss"), (F.col("value") * 2).alias("work"), F.col("tick").alias("residual"))), "max_abs", "low", "high", "final", "loss", "work"), f"WITH {RUN} SELECT agent % 12 AS candidate, round(max(abs(value - 50)), 6) AS max_abs, round(min(value - 50), 6) AS low, round(max(value - 50), 6) AS high, round(max_by(value - 50, event_id), 6) AS final, round(sum(value), 6) AS loss, round(sum(value * 2), 6) AS work, max(tick) AS residual FROM run GROUP BY 1")
add("run_occupancy", lambda s, d: R.to_occupancy(run_ticks(s, d).select("event_id", ((F.col("event_id") % 17 - 8) / 4).alias("log_odds"))).select("event_id", "optimistic", "pessimistic"), f"WITH {RUN}, p AS (SELECT event_id, (1 / (1 + exp(-((event_id % 17 - 8) / 4.0::DOUBLE))))::FLOAT AS p FROM run) SELECT event_id, p > 0.6 AS optimistic, NOT (p < 0.4) AS pessimistic FROM p")
