"""Run logs: ordered series, as-of and interval lookups, per-agent collectors, scorecards and chart reductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import finite


def ordered(by: Sequence[str], tick: str = "tick") -> Window:
    return Window.partitionBy(*by).orderBy(tick)


def cumulative(log: DataFrame, by: Sequence[str], value: str = "value", tick: str = "tick") -> DataFrame:
    """Running sum of a column."""
    return log.withColumn("total", F.sum(value).over(ordered(by, tick).rowsBetween(Window.unboundedPreceding, 0)))


def series(log: DataFrame, where: Column, value: str = "value", tick: str = "tick") -> DataFrame:
    return log.filter(where).select(tick, value).orderBy(tick)


def sum_to(log: DataFrame, k: int, by: Sequence[str], value: str = "value") -> DataFrame:
    """Sum over ticks up to k."""
    return log.filter(F.col("tick") <= k).groupBy(*by).agg(F.sum(value).alias("total"))


def tick_at(log: DataFrame, queries: DataFrame, by: Sequence[str], t: str = "t", at: str = "at", slack: float = 1e-6) -> DataFrame:
    """Last tick with time <= at + slack for each query, clamped to the first; 0 for an empty log. Both sides are merged into one ordered stream by key: no range join."""
    marks = queries.select(*by, F.col(at).alias("_t"), F.lit(None).cast("long").alias("_tick"), F.lit(1).alias("_q"))
    ticks = log.select(*by, (F.col(t) - slack).alias("_t"), F.col("tick").alias("_tick"), F.lit(0).alias("_q"))
    w = Window.partitionBy(*by).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = ticks.unionByName(marks).withColumn("index", F.last("_tick", ignorenulls=True).over(w))
    first = F.min("_tick").over(Window.partitionBy(*by))
    return both.withColumn("index", F.coalesce("index", first, F.lit(0))).filter("_q = 1").select(*by, F.col("_t").alias(at), "index").distinct()


def leg_of(ticks: DataFrame, legs: DataFrame, by: Sequence[str], tick: str = "tick") -> DataFrame:
    """Last leg that starts at or before each tick, 0 if none."""
    a = ticks.select(*by, F.col(tick).alias("_t"), F.lit(None).cast("long").alias("_leg"), F.lit(1).alias("_q"))
    b = legs.select(*by, F.col("start").alias("_t"), F.col("leg").cast("long").alias("_leg"), F.lit(0).alias("_q"))
    w = Window.partitionBy(*by).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("leg", F.coalesce(F.last("_leg", ignorenulls=True).over(w), F.lit(0))).filter("_q = 1").select(*by, F.col("_t").alias(tick), "leg")


def stack(logs: Sequence[DataFrame], agents: str = "agent") -> DataFrame:
    """Logs side by side: each becomes an arm, ticks aligned to those that all have."""
    out = None
    for arm, log in enumerate(logs):
        part = log.withColumn("arm", F.lit(arm))
        out = part if out is None else out.unionByName(part)
    common = out.groupBy("tick").agg(F.count_distinct("arm").alias("n")).filter(F.col("n") == len(logs)).select("tick")
    return out.join(common, "tick", "left_semi")


def collect(ticks: DataFrame, by: Sequence[str], turn: float = 0.5, progress: float = 0.05, hold: int = 3) -> DataFrame:
    """Statistics of each agent from its ticks (x, y, heading, goal, reached, rolled, contact): path length, turning, first arrival, stalls, rollover, hits."""
    w = ordered(by)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    dh = F.abs(F.col("heading") - F.lag("heading").over(w))
    rise = lambda c: F.col(c) & ~F.coalesce(F.lag(c).over(w), F.lit(False))
    flags = ticks.withColumns({"_step": step, "_dh": dh, "_rise": rise("reached"), "_hit": rise("contact"), "_best": F.min("goal").over(past), "_run": F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "rolled").orderBy("tick"))})
    held = flags.filter("rolled").groupBy(*by, "_run").agg(F.count("*").alias("n")).groupBy(*by).agg((F.max("n") >= hold).alias("rolled_over"))
    out = flags.groupBy(*by).agg(
        F.count("*").alias("ticks"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"), F.coalesce(F.sum("_dh"), F.lit(0.0)).alias("turning"), F.count_if(F.col("_dh") > turn).alias("turns"),
        F.min(F.when(F.col("_rise"), F.col("tick"))).alias("arrived"), F.count_if(F.col("goal") > F.col("_best") - progress).alias("stalls"), F.count_if("_hit").alias("hits"),
    )
    return out.join(held, list(by), "left").withColumn("rolled_over", F.coalesce("rolled_over", F.lit(False)))


def scorecard(episodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Corpus row from episode rows (arrived, time, path, hits, rolled_over): rates over all, means and the interpolated p95 over arrivers; null where none arrived."""
    got = F.col("arrived")
    return episodes.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.avg(got.cast("double")).alias("arrival_rate"), F.avg(F.when(got, F.col("time"))).alias("mean_time"), F.percentile(F.when(got, F.col("time")), 0.95).alias("p95_time"),
        F.avg(F.when(got & finite("path"), F.col("path"))).alias("mean_path"), (F.sum("hits") / F.count("*")).alias("hits_per_episode"), F.avg(F.col("rolled_over").cast("double")).alias("rollover_rate"),
    )


def coverage(truth: DataFrame, beliefs: DataFrame, keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """Fractions over belief planes and cells: known, right, falsely free and falsely occupied; zeros without any."""
    both = beliefs.join(truth.withColumnRenamed("occ", "_truth"), list(keys))
    of = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    known = F.col("occ").isNotNull()
    wrong = lambda a, b: F.coalesce((F.col("occ") == a) & (F.col("_truth") == b), F.lit(False))
    return both.agg(of(known).alias("known"), of(F.coalesce(F.col("occ") == F.col("_truth"), F.lit(False))).alias("right"), of(wrong(0, 1)).alias("missed"), of(wrong(1, 0)).alias("phantom"))


def time_share(log: DataFrame, by: str, value: str) -> DataFrame:
    """Share of the total that each kind has. The totals are two small aggregates."""
    sums = log.groupBy(by).agg(F.sum(value).alias("s"))
    return sums.crossJoin(F.broadcast(log.agg(F.sum(value).alias("total")))).select(by, F.when(F.col("total") > 0, F.col("s") / F.col("total")).otherwise(F.lit(0.0)).alias("share"))  # one row


def decimate(points: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """Points (i from 0, y) for a chart of at most ``most``: all if they fit in max(most, 8); else both ends and, of each bucket of the interior, the first lowest, first highest and first non-finite."""
    m = max(most, 8)
    n = F.max("i").over(Window.partitionBy(*by)) + 1
    buckets = (m - 2) // 3
    p = points.withColumn("_n", n).withColumn("_b", F.floor((F.col("i") - 1) / F.ceil((F.col("_n") - 2) / buckets)))
    inner = p.filter(f"_n > {m} and i > 0 and i < _n - 1").groupBy(*by, "_b")
    good = F.when(finite("y"), F.struct("y", F.col("i")))
    high = F.when(finite("y"), F.struct("y", (-F.col("i")).alias("i")))
    picks = inner.agg(F.min(good).alias("a"), F.max(high).alias("b"), F.min(F.when(~finite("y"), F.col("i"))).alias("c"))
    ids = picks.select(*by, F.explode(F.array("a.i", -F.col("b.i"), "c")).alias("i")).filter("i is not null").distinct()
    ends = p.filter(f"_n <= {m} or i = 0 or i = _n - 1").select(*by, "i", "y")
    return ends.unionByName(points.join(ids, [*by, "i"]).select(*by, "i", "y"))


def column_means(points: DataFrame, x0: float, x1: float, columns: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the finite y whose x falls in each column of a chart."""
    at = F.floor((F.col("x") - x0) / (x1 - x0) * columns).cast("int")
    return points.filter(finite("y") & (F.col("x") >= x0) & (F.col("x") < x1)).groupBy(*by, at.alias("column")).agg(F.avg("y").alias("mean"))


def candidates(steps: DataFrame, by: str = "candidate") -> DataFrame:
    """Summary of each candidate's steps (step, value, loss, work, residual), ranked by total loss."""
    out = steps.groupBy(by).agg(
        F.max(F.abs("value")).alias("max_abs"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", "step").alias("final"),
        F.sum("loss").alias("loss"), F.sum("work").alias("work"), F.max("residual").alias("residual"),
    )
    return out


def to_occupancy(cells: DataFrame, threshold: float = 0.5, band: float = 0.1) -> DataFrame:
    """Probability of log-odds as a float, and its optimistic and pessimistic reading."""
    p = (1 / (1 + F.exp(-F.col("log_odds")))).cast("float")
    return cells.withColumn("p", p).withColumns({"optimistic": F.col("p") > max(threshold, 0.5 + band), "pessimistic": ~(F.col("p") < min(1 - threshold, 0.5 - band))})
