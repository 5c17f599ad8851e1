"""Replicated state as tables of sequenced mutations: replay, admission, prefix routing, conflicts, expiry and telemetry.

Paths are dotted; the empty prefix covers all. Prefix joins turn each path into its ancestor prefixes and are equi-joins,
so they cost the depth of the paths and no nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_path(path: Column | str) -> Column:
    """Leading and trailing separators removed."""
    return F.btrim(F.col(path) if isinstance(path, str) else path, F.lit("."))


def covers(path: Column, prefix: Column) -> Column:
    """A prefix covers itself and what is below it, by whole segments."""
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit(".")))


def ancestors(path: Column | str) -> Column:
    """All prefixes of a path, the empty one and itself included."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "[.]")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))


def prefix_join(rows: DataFrame, rules: DataFrame, key: Sequence[str], path: str = "path", prefix: str = "prefix") -> DataFrame:
    """Each row with its longest matching rule's columns, null where none matches. ``key`` identifies rows."""
    hit = rows.select(*key, F.explode(ancestors(path)).alias("_p")).join(rules.withColumnRenamed(prefix, "_p"), "_p")
    cols = [c for c in rules.columns if c != prefix]
    best = hit.groupBy(*key).agg(F.max_by(F.struct(F.col("_p").alias(prefix), *cols), F.length("_p")).alias("_r"))
    return rows.join(best, list(key), "left").select(*rows.columns, "_r." + prefix, *("_r." + c for c in cols))


def interested(rows: DataFrame, prefixes: Sequence[str], enforced: bool = True) -> DataFrame:
    """Rows under any of the prefixes; all of them if interest isn't enforced."""
    if not enforced:
        return rows
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | covers(F.col("path"), F.lit(p))
    return rows.filter(keep)


def subscribed(rows: DataFrame, subscriptions: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, subscriber) for subscriptions (prefix, descendants, subscriber): exact paths, or all below; the root with descendants matches all."""
    hit = rows.select(*key, "path", F.explode(ancestors("path")).alias("prefix")).join(subscriptions, "prefix")
    return hit.filter((F.col("prefix") == F.col("path")) | F.col("descendants")).select(*key, "subscriber").distinct()


def authorized(rows: DataFrame, policy: DataFrame, key: Sequence[str], writer: str = "origin") -> DataFrame:
    """Column allowed: the longest prefix's writers decide; no rule allows, an empty list denies."""
    got = prefix_join(rows, policy, key)
    return got.withColumn("allowed", F.when(F.col("writers").isNull(), True).otherwise(F.array_contains("writers", F.col(writer).cast("string"))))


def replay_after(rows: DataFrame, sequence: int) -> DataFrame:
    return rows.filter(F.col("sequence") > sequence)


def trim_through(rows: DataFrame, sequence: int) -> DataFrame:
    """What is left when all up to a sequence is dropped."""
    return replay_after(rows, sequence)


def fresh(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (origin, sequence) isn't among those seen."""
    return rows.join(seen.select("origin", "sequence"), ["origin", "sequence"], "left_anti")


def newest(rows: DataFrame, by: Sequence[str] = ("path",), order: Sequence[str] = ("hlc", "origin", "sequence")) -> DataFrame:
    """Last writer wins, where every row has its clock: the whole row with the greatest (hlc, origin, sequence)."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, *(F.col("_r." + c) for c in rest))


def settle(rows: DataFrame) -> DataFrame:
    """Last writer wins in arrival order, for rows of which some lack a clock: the clock decides only between two that have one, then origin, then sequence; a mutation of the same origin always applies.

    Not associative, so a fold over each path's rows in order of arrival; a path's rows are one array."""
    item = F.struct("arrival", "hlc", "origin", "sequence", "value")
    log = F.array_sort(F.collect_list(item))

    def step(now: Column, new: Column) -> Column:
        both = now["hlc"].isNotNull() & new["hlc"].isNotNull() & (now["hlc"] != new["hlc"])
        later = F.when(both, new["hlc"] > now["hlc"]).when(new["origin"] != now["origin"], new["origin"] > now["origin"]).otherwise(new["sequence"] > now["sequence"])
        return F.when(now.isNull() | (now["origin"] == new["origin"]) | later, new).otherwise(now)

    folded = rows.groupBy("path").agg(log.alias("log"))
    kind = folded.schema["log"].dataType.elementType
    return folded.select("path", F.aggregate("log", F.lit(None).cast(kind), step).alias("r")).select("path", "r.origin", "r.sequence", "r.value")


def admit(rows: DataFrame, seen: DataFrame, interest: Sequence[str], partition: tuple[int, int] | None = None, policy: DataFrame | None = None, node: str | None = None) -> DataFrame:
    """Outcome of each arriving mutation, in the order of the checks: duplicate, interest, partition, write policy; what is filtered or rejected isn't remembered as seen."""
    out = rows
    first = Window.partitionBy("origin", "sequence").orderBy("arrival")
    inside = F.lit(not interest)
    for p in interest:
        inside = inside | covers(F.col("path"), F.lit(p))
    mine = F.lit(True) if partition is None else F.pmod(F.xxhash64("path"), F.lit(partition[1])) == partition[0]
    allowed = F.lit(True)
    if policy is not None:
        out = authorized(out, policy, ["origin", "sequence", "arrival"])
        allowed = F.col("allowed")
    out = out.join(seen.select("origin", "sequence").distinct().withColumn("_seen", F.lit(True)), ["origin", "sequence"], "left")
    fits = inside & mine & allowed
    before = F.coalesce(F.sum(fits.cast("int")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    reason = F.when(F.col("_seen") | before, "duplicate").when(~inside, "interest").when(~mine, "partition").when(~allowed, "policy")
    return out.select(*rows.columns, reason.isNull().alias("applied"), F.coalesce(reason, F.lit("")).alias("reason"))


def conflicts(rows: DataFrame, last: int) -> DataFrame:
    """The last conflicts of each path, newest first: mutations by another origin than the one before."""
    w = Window.partitionBy("path").orderBy("hlc", "origin", "sequence")
    found = rows.withColumn("_o", F.lag("origin").over(w)).filter(F.col("_o") != F.col("origin"))
    k = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("hlc"), F.desc("origin"), F.desc("sequence")))
    return found.withColumn("rank", k).filter(F.col("rank") <= last).drop("_o")


def compare_clocks(a: Column | str, b: Column | str) -> Column:
    """equal, less, greater or concurrent, for vector clocks as maps node -> sequence; an absent node counts as 0."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(both, lambda v: v < 0), F.exists(both, lambda v: v > 0)
    return F.when(less & more, "concurrent").when(less, "less").when(more, "greater").otherwise("equal")


def hlc(wall_ms: Column, logical: Column | int = 0) -> Column:
    """48 bits of wall milliseconds and 16 of a counter."""
    return F.shiftleft(wall_ms.cast("long"), 16) + logical


def hlc_parts(c: Column) -> list[Column]:
    return [F.shiftright(c, 16).alias("wall_ms"), c.bitwiseAND(F.lit(0xFFFF)).alias("logical")]


def hlc_run(rows: DataFrame, by: Sequence[str], wall: str, order: Sequence[str]) -> DataFrame:
    """Monotone clock of each group: the wall time if it advances, else the last one counted up; a fold in order."""
    log = F.array_sort(F.collect_list(F.struct(*order, F.col(wall).alias("_w"))))
    step = lambda acc, x: F.concat(acc, F.array(F.greatest(hlc(x["_w"]), F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + 1)))
    return rows.groupBy(*by).agg(F.aggregate(log, F.array().cast("array<long>"), step).alias("clocks"))


def subtree(rows: DataFrame, prefix: str) -> DataFrame:
    """Snapshot of what is under a prefix."""
    return rows.filter(covers(F.col("path"), F.lit(prefix)))


def without_subtrees(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows that no prefix of ``gone`` (prefix) covers."""
    hit = rows.select("path").distinct().select("path", F.explode(ancestors("path")).alias("prefix")).join(gone.select("prefix"), "prefix").select("path").distinct()
    return rows.join(hit, "path", "left_anti")


def expire(nodes: DataFrame, now: int) -> DataFrame:
    """Nodes (path, expires_at) without those past their expiry and all below them."""
    return without_subtrees(nodes, nodes.filter(F.col("expires_at") <= now).select(F.col("path").alias("prefix")))


def bounded(rows: DataFrame, capacity: int, policy: str, by: Sequence[str] = (), order: Sequence[str] = ("arrival",)) -> DataFrame:
    """What a full queue keeps: the first rows (drop_newest) or the last (drop_oldest)."""
    keys = [F.col(c).asc() if policy == "drop_newest" else F.col(c).desc() for c in order]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).filter(F.col("_k") <= capacity).drop("_k")


def evict(nodes: DataFrame, limit: int, high: float = 0.95, low: float = 0.80, by: Sequence[str] = ()) -> DataFrame:
    """Least recently used nodes (bytes, last_access, path) that go when the total is over high * limit, until it is at most low * limit."""
    w = Window.partitionBy(*by).orderBy("last_access", "path")
    total = F.sum("bytes").over(Window.partitionBy(*by))
    gone_before = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return nodes.filter((total > high * limit) & (total - gone_before > low * limit)) if not by else nodes.withColumns({"_t": total, "_g": gone_before}).filter((F.col("_t") > high * limit) & (F.col("_t") - F.col("_g") > low * limit)).drop("_t", "_g")


def route(rows: DataFrame, delegations: DataFrame, key: Sequence[str], now: str = "hlc") -> DataFrame:
    """Cluster that holds the longest delegated prefix (prefix, cluster, lease_end) whose lease hasn't ended at the row's time."""
    hit = rows.select(*key, now, F.explode(ancestors("path")).alias("prefix")).join(delegations, "prefix").filter(F.col("lease_end") > F.col(now))
    best = hit.groupBy(*key).agg(F.max_by("cluster", F.struct(F.length("prefix"), "lease_end")).alias("cluster"))
    return rows.join(best, list(key), "left")


def resolve_links(spark, links: DataFrame, limit: int = 32) -> DataFrame:
    """(path, target, cyclic) for aliases (path, target): followed to the end, or found to come back."""
    links.createOrReplaceTempView("_links")
    walked = spark.sql(f"""WITH RECURSIVE walk(path, at, depth, cyclic) AS (
        SELECT path, target, 1, path = target FROM _links
        UNION ALL SELECT w.path, l.target, w.depth + 1, l.target = w.path FROM walk w JOIN _links l ON l.path = w.at WHERE NOT w.cyclic AND w.depth < {limit})
        SELECT path, max_by(at, depth) AS target, bool_or(cyclic) OR max(depth) >= {limit} AS cyclic FROM walk GROUP BY path""")
    return walked


def fnv1a(text: Column | str, bits: int = 32) -> Column:
    """FNV-1a of a text's UTF-8 bytes as a long (64 bits: signed)."""
    start, prime = {32: (0x811C9DC5, 0x01000193), 64: (0xCBF29CE484222325, 0x100000001B3)}[bits]  # fixed values of the hash

    @F.pandas_udf("long")
    def h(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            x = start
            for b in t.encode():
                x = (x ^ b) * prime % (1 << bits)
            return x - (1 << 64) if bits == 64 and x >> 63 else x

        return s.map(one).astype("Int64")

    return h(text)


def partition_of(path: Column | str, parts: int) -> Column:
    """Part of the 32-bit ring that a path's hash falls in."""
    return F.floor(fnv1a(path) * parts / F.lit(1 << 32)).cast("int")


# --- telemetry -------------------------------------------------------------------------------------------------------


def ewma(rows: DataFrame, by: Sequence[str], t: str, value: str, half_life: float) -> DataFrame:
    """Average with irregular decay: alpha = 1 - 2^(-dt / half_life); the first sample seeds, one at a clock that doesn't advance replaces. A fold over each group's samples in order."""
    log = F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"))))
    zero = F.struct(F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("v"))

    def step(acc: Column, x: Column) -> Column:
        alpha = 1 - F.exp(-(x["t"] - acc["t"]) * 0.6931471805599453 / half_life)
        v = F.when(acc["t"].isNull() | (x["t"] <= acc["t"]), x["v"]).otherwise(acc["v"] + alpha * (x["v"] - acc["v"]))
        return F.struct(F.greatest(x["t"], F.coalesce(acc["t"], x["t"])).alias("t"), v.alias("v"))

    return rows.groupBy(*by).agg(F.aggregate(log, zero, step)["v"].alias("ewma"))


def latency_bucket(ns: Column | str) -> Column:
    """Power-of-two bucket: 0 below 1,024 ns, then one for each doubling, 21 at most."""
    x = (F.col(ns) if isinstance(ns, str) else ns).cast("long")
    return F.when(x < 1024, 0).otherwise(F.least(F.lit(21), F.length(F.bin(x)) - 10))


def latency_percentiles(rows: DataFrame, by: Sequence[str], ns: str, percents: Sequence[float]) -> DataFrame:
    """Upper edge of the first bucket whose running count exceeds floor(total * p), at most total - 1; 0 without samples."""
    counts = rows.groupBy(*by, latency_bucket(ns).alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("bucket")
    run = counts.withColumns({"run": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(*by)), "edge": F.pow(F.lit(2.0), F.col("bucket") + 10).cast("long")})
    target = lambda p: F.least(F.floor(F.col("total") * p), F.col("total") - 1)
    return run.groupBy(*by).agg(*(F.min(F.when(F.col("run") > target(p), F.col("edge"))).alias(f"p{round(p * 100)}") for p in percents))


def rates(rows: DataFrame, by: Sequence[str], t: str, counters: Sequence[str]) -> DataFrame:
    """Counter differences by second between successive samples."""
    w = Window.partitionBy(*by).orderBy(t)
    dt = (F.col(t) - F.lag(t).over(w)) / 1000.0
    return rows.select(*by, t, *(F.when(dt > 0, (F.col(c) - F.lag(c).over(w)) / dt).alias(c + "_rate") for c in counters))


def summarize(rows: DataFrame, node: str, t: str, sums: Sequence[str], peaks: Sequence[str], now: int, stale_after: int) -> DataFrame:
    """One row of the cluster from each node's latest snapshot: sums, peaks and the number of stale nodes."""
    rest = [t, *sums, *peaks]
    last = rows.groupBy(node).agg(F.max_by(F.struct(*rest), F.col(t)).alias("r"))
    return last.agg(F.count("*").alias("nodes"), *(F.sum("r." + c).alias(c) for c in sums), *(F.max("r." + c).alias(c) for c in peaks), F.count_if(F.lit(now) - F.col("r." + t) > stale_after).alias("stale"))


def routing_feedback(rows: DataFrame, node: str, latency: str, threshold: float, min_samples: int) -> DataFrame:
    """Nodes whose mean latency exceeds a threshold over enough samples."""
    return rows.groupBy(node).agg(F.count("*").alias("samples"), F.avg(latency).alias("mean")).filter((F.col("samples") >= min_samples) & (F.col("mean") > threshold))


def blobs(rows: DataFrame, payload: str) -> DataFrame:
    """Content-addressed store: one row a digest."""
    return rows.select(F.sha2(F.col(payload).cast("binary"), 256).alias("digest"), F.col(payload).cast("binary").alias("data")).dropDuplicates(["digest"])


def chunked(rows: DataFrame, key: str, payload: str, size: int = 1 << 20) -> DataFrame:
    """Chunks of a payload with their digests; an empty payload has none."""
    data = F.col(payload).cast("binary")
    n = F.ceil(F.octet_length(data) / size).cast("int")
    cut = rows.select(key, data.alias("_d"), n.alias("_n")).filter("_n > 0").select(key, "_d", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk"))
    part = F.substring(F.col("_d"), F.col("chunk") * size + 1, F.lit(size))
    return cut.select(key, "chunk", part.alias("data")).withColumn("digest", F.sha2("data", 256))


def missing_chunks(manifest: DataFrame, have: DataFrame) -> DataFrame:
    return manifest.join(have.select("digest"), "digest", "left_anti")
