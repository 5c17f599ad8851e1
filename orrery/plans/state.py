"""Queries of the state operators on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as T
from .bindings import MUT, mutations, read

Q, S = {}, {}


def add(name, query, sql):
    Q[name], S[name] = query, sql


def tree(spark, d):
    """path, value of the customers under region and nation."""
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.concat_ws(".", F.regexp_replace("r_name", "[. ]", "_"), F.regexp_replace("n_name", "[. ]", "_"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_acctbal").alias("value"), "c_custkey", "n_nationkey")


TREE = """tree AS (SELECT regexp_replace(r_name, '[. ]', '_', 'g') || '.' || regexp_replace(n_name, '[. ]', '_', 'g') || '.' || c_custkey AS path, c_acctbal AS value, c_custkey, n_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
COVER = "({p} = '' OR path = {p} OR starts_with(path, {p} || '.'))"


def nation_rules(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = lambda c: F.regexp_replace(c, "[. ]", "_")
    return n.filter("n_nationkey % 2 = 0").select(F.concat_ws(".", name("r_name"), name("n_name")).alias("prefix"), F.col("n_nationkey").alias("rule")).union(n.filter("r_regionkey < 2").select(name("r_name"), (F.col("r_regionkey") + 100).alias("rule")).distinct())


RULES = """rules AS (SELECT regexp_replace(r_name, '[. ]', '_', 'g') || '.' || regexp_replace(n_name, '[. ]', '_', 'g') AS prefix, n_nationkey AS rule FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
  UNION SELECT regexp_replace(r_name, '[. ]', '_', 'g'), r_regionkey + 100 FROM region WHERE r_regionkey < 2)"""
LONGEST = f"""m AS (SELECT t.path, t.c_custkey, r.prefix, r.rule, row_number() OVER (PARTITION BY t.path ORDER BY length(r.prefix) DESC NULLS LAST) AS k
  FROM tree t LEFT JOIN rules r ON {COVER.format(p='r.prefix')})"""

add("state_replay_after", lambda s, d: T.replay_after(mutations(s, d), 40), f"WITH {MUT} SELECT * FROM mut WHERE sequence > 40")
add("state_trim_through", lambda s, d: T.trim_through(mutations(s, d), 60).groupBy("origin").agg(F.count("*").alias("n"), F.min("sequence").alias("first")), f"WITH {MUT} SELECT origin, count(*) AS n, min(sequence) AS first FROM mut WHERE sequence > 60 GROUP BY origin")
add("state_duplicates", lambda s, d: T.fresh(mutations(s, d), mutations(s, d).filter("event_id % 3 = 0")).select("origin", "sequence", "path"), f"WITH {MUT} SELECT origin, sequence, path FROM mut m WHERE NOT EXISTS (SELECT 1 FROM mut o WHERE o.event_id % 3 = 0 AND o.origin = m.origin AND o.sequence = m.sequence)")
add("state_interest", lambda s, d: T.interested(mutations(s, d), ["click", "purchase.3"]), f"WITH {MUT} SELECT * FROM mut WHERE {COVER.format(p=repr('click'))} OR {COVER.format(p=repr('purchase.3'))}")
add("state_normalize_path", lambda s, d: mutations(s, d).select("event_id", T.normalize_path(F.concat(F.lit(".."), "path", F.lit("."))).alias("path")), f"WITH {MUT} SELECT event_id, trim('..' || path || '.', '.') AS path FROM mut")
add("state_lww", lambda s, d: T.newest(mutations(s, d)).select("path", "origin", "sequence", "hlc", "value"), f"WITH {MUT} SELECT path, origin, sequence, hlc, value FROM mut QUALIFY row_number() OVER (PARTITION BY path ORDER BY hlc DESC, origin DESC, sequence DESC) = 1")
add("state_conflicts", lambda s, d: T.conflicts(mutations(s, d), 3).select("path", "origin", "sequence", "rank"), f"""WITH {MUT}, l AS (SELECT *, lag(origin) OVER (PARTITION BY path ORDER BY hlc, origin, sequence) AS o FROM mut)
SELECT path, origin, sequence, row_number() OVER (PARTITION BY path ORDER BY hlc DESC, origin DESC, sequence DESC)::INT AS rank FROM l WHERE o <> origin QUALIFY rank <= 3""")
add("state_authority", lambda s, d: T.prefix_join(tree(s, d), nation_rules(s, d), ["path"]).select("path", "prefix", "rule"), f"WITH {TREE}, {RULES}, {LONGEST} SELECT path, prefix, rule FROM m WHERE k = 1")


def write_policy(s, d):
    policy = nation_rules(s, d).select("prefix", F.when(F.col("rule") >= 100, F.array().cast("array<string>")).otherwise(F.array(F.lit("1"), F.lit("3"))).alias("writers"))
    return T.authorized(tree(s, d).withColumn("origin", F.col("c_custkey") % 5), policy, ["path"]).select("path", "allowed")


add("state_write_policy", write_policy, f"WITH {TREE}, {RULES}, {LONGEST} SELECT path, CASE WHEN prefix IS NULL THEN true WHEN rule >= 100 THEN false ELSE c_custkey % 5 IN (1, 3) END AS allowed FROM m WHERE k = 1")
add("state_subscriptions", lambda s, d: T.subscribed(mutations(s, d), s.createDataFrame([("", True, "all"), ("click", True, "clicks"), ("click", False, "exact"), ("view.2", False, "v2")], "prefix string, descendants boolean, subscriber string"), ["event_id"]).groupBy("subscriber").agg(F.count("*").alias("n")), f"""WITH {MUT} SELECT 'all' AS subscriber, count(*) AS n FROM mut UNION ALL SELECT 'clicks', count(*) FROM mut WHERE {COVER.format(p=repr('click'))} HAVING count(*) > 0
UNION ALL SELECT 'exact', count(*) FROM mut WHERE path = 'click' HAVING count(*) > 0 UNION ALL SELECT 'v2', count(*) FROM mut WHERE path = 'view.2' HAVING count(*) > 0""")


def expired(s, d):
    return T.expire(tree(s, d).select("path", (F.col("c_custkey") % 50).alias("expires_at")).union(nation_rules(s, d).select("prefix", F.col("rule").cast("long"))), 10)


add("state_expiry", expired, f"""WITH {TREE}, {RULES}, n AS (SELECT path, c_custkey % 50 AS expires_at FROM tree UNION ALL SELECT prefix, rule FROM rules)
SELECT path, expires_at FROM n WHERE NOT EXISTS (SELECT 1 FROM n g WHERE g.expires_at <= 10 AND (n.path = g.path OR starts_with(n.path, g.path || '.')))""")
add("state_subtree_delete", lambda s, d: T.without_subtrees(tree(s, d), nation_rules(s, d)).select("path", "value"), f"WITH {TREE}, {RULES} SELECT path, value FROM tree t WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE {COVER.format(p='r.prefix')})")
add("state_snapshot", lambda s, d: T.subtree(tree(s, d), "ASIA").select("path", "value"), f"WITH {TREE} SELECT path, value FROM tree WHERE {COVER.format(p=repr('ASIA'))}")
for policy, order in (("drop_newest", "ASC"), ("drop_oldest", "DESC")):
    add(f"state_queue_{policy}", lambda s, d, policy=policy: T.bounded(mutations(s, d), 5, policy, ["origin"], ["sequence"]).select("origin", "sequence"), f"WITH {MUT} SELECT origin, sequence FROM mut QUALIFY row_number() OVER (PARTITION BY origin ORDER BY sequence {order}) <= 5")
add("state_eviction", lambda s, d: T.evict(tree(s, d).select("path", "n_nationkey", F.lit(10).alias("bytes"), (F.col("c_custkey") % 97).alias("last_access")), 400, by=["n_nationkey"]).select("path"), f"""WITH {TREE}, t AS (SELECT path, n_nationkey, c_custkey % 97 AS la FROM tree),
w AS (SELECT *, 10 * count(*) OVER (PARTITION BY n_nationkey) AS total, 10 * (row_number() OVER (PARTITION BY n_nationkey ORDER BY la, path) - 1) AS gone FROM t) SELECT path FROM w WHERE total > 380 AND total - gone > 320""")
add("state_delegation", lambda s, d: T.route(tree(s, d).withColumn("at", F.col("c_custkey") % 30), nation_rules(s, d).select("prefix", F.concat(F.lit("c"), F.col("rule").cast("string")).alias("cluster"), (F.col("rule") % 20).cast("long").alias("lease_end")), ["path"], "at").select("path", "cluster"), f"""WITH {TREE}, {RULES},
m AS (SELECT t.path, 'c' || r.rule AS cluster, row_number() OVER (PARTITION BY t.path ORDER BY length(r.prefix) DESC NULLS LAST) AS k FROM tree t LEFT JOIN rules r ON {COVER.format(p='r.prefix')} AND r.rule % 20 > t.c_custkey % 30) SELECT path, cluster FROM m WHERE k = 1""")
add("state_summary", lambda s, d: T.summarize(mutations(s, d).select((F.col("origin") % 8).alias("node"), F.shiftright("hlc", 16).alias("t"), "sequence", "origin", "event_id"), "node", "t", ["sequence", "origin"], ["event_id"], 1706572800000, 3600000), f"""WITH {MUT}, l AS (SELECT origin % 8 AS node, max_by(sequence, hlc) AS sequence, max_by(origin, hlc) AS origin, max_by(event_id, hlc) AS event_id, max(hlc) // 65536 AS t FROM mut GROUP BY 1)
SELECT count(*) AS nodes, sum(sequence)::BIGINT AS sequence, sum(origin)::BIGINT AS origin, max(event_id) AS event_id, count(*) FILTER (1706572800000 - t > 3600000) AS stale FROM l""")
add("state_ewma", lambda s, d: T.ewma(mutations(s, d).select("origin", (F.shiftright("hlc", 16) / 1000).alias("t"), "value"), ["origin"], "t", "value", 86400.0).withColumn("ewma", F.round("ewma", 5)), f"""WITH RECURSIVE {MUT}, k AS (SELECT origin, value, (hlc // 65536) / 1000.0::DOUBLE AS t, row_number() OVER (PARTITION BY origin ORDER BY (hlc // 65536), value) AS i FROM mut),
f(origin, i, t, v) AS (SELECT origin, i, t, value FROM k WHERE i = 1 UNION ALL SELECT k.origin, k.i, greatest(k.t, f.t), CASE WHEN k.t <= f.t THEN k.value ELSE f.v + (1 - exp(-(k.t - f.t) * 0.6931471805599453 / 86400.0)) * (k.value - f.v) END FROM f JOIN k ON k.origin = f.origin AND k.i = f.i + 1)
SELECT origin, round(max_by(v, i), 5) AS ewma FROM f GROUP BY origin""")
add("state_latency_histogram", lambda s, d: mutations(s, d).groupBy((F.col("origin") % 8).alias("node"), T.latency_bucket(F.col("value") * 10000).alias("bucket")).agg(F.count("*").alias("n")), f"""WITH {MUT} SELECT origin % 8 AS node, CASE WHEN floor(value * 10000) < 1024 THEN 0 ELSE least(21, floor(log2(floor(value * 10000)))::INT - 9) END::INT AS bucket, count(*) AS n FROM mut GROUP BY ALL""")
add("state_latency_percentiles", lambda s, d: T.latency_percentiles(mutations(s, d).select((F.col("origin") % 8).alias("node"), (F.col("value") * 10000).alias("ns")), ["node"], "ns", [0.5, 0.99]), f"""WITH {MUT}, c AS (SELECT origin % 8 AS node, CASE WHEN floor(value * 10000) < 1024 THEN 0 ELSE least(21, floor(log2(floor(value * 10000)))::INT - 9) END AS b, count(*) AS n FROM mut GROUP BY ALL),
r AS (SELECT node, b, sum(n) OVER (PARTITION BY node ORDER BY b) AS run, sum(n) OVER (PARTITION BY node) AS total FROM c)
SELECT node, min(CASE WHEN run > least(floor(total * 0.5), total - 1) THEN (2 ** (b + 10))::BIGINT END) AS p50, min(CASE WHEN run > least(floor(total * 0.99), total - 1) THEN (2 ** (b + 10))::BIGINT END) AS p99 FROM r GROUP BY node""")
add("state_rates", lambda s, d: T.rates(mutations(s, d).select("origin", F.shiftright("hlc", 16).alias("t"), "sequence"), ["origin"], "t", ["sequence"]).withColumn("sequence_rate", F.round("sequence_rate", 9)), f"""WITH {MUT}, k AS (SELECT origin, hlc // 65536 AS t, sequence, lag(sequence) OVER w AS s0, ((hlc // 65536) - lag(hlc // 65536) OVER w) / 1000.0::DOUBLE AS dt FROM mut WINDOW w AS (PARTITION BY origin ORDER BY hlc // 65536))
SELECT origin, t, CASE WHEN dt > 0 THEN round((sequence - s0) / dt, 9) END AS sequence_rate FROM k""")
add("state_routing_feedback", lambda s, d: T.routing_feedback(mutations(s, d), "origin", "value", 50.0, 30).withColumn("mean", F.round("mean", 6)), f"WITH {MUT} SELECT origin, count(*) AS samples, round(avg(value), 6) AS mean FROM mut GROUP BY origin HAVING count(*) >= 30 AND avg(value) > 50")
add("state_hlc_parts", lambda s, d: mutations(s, d).select("event_id", *T.hlc_parts(F.col("hlc") + F.col("event_id") % 100)), f"WITH {MUT} SELECT event_id, (hlc + event_id % 100) // 65536 AS wall_ms, (hlc + event_id % 100) % 65536 AS logical FROM mut")
add("state_vector_clocks", lambda s, d: read(s, d, "orders").select("o_orderkey", T.compare_clocks(F.create_map(F.lit("a"), F.col("o_custkey") % 3, F.lit("b"), F.col("o_orderkey") % 3), F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.lit(1).cast("long"))).alias("relation")), """SELECT o_orderkey, CASE WHEN (a < 1 OR b < 1) AND (a > 1 OR b > 1) THEN 'concurrent' WHEN a < 1 OR b < 1 THEN 'less' WHEN a > 1 OR b > 1 THEN 'greater' ELSE 'equal' END AS relation FROM (SELECT o_orderkey, o_custkey % 3 AS a, o_orderkey % 3 AS b FROM orders)""")
add("state_blob_digests", lambda s, d: T.blobs(read(s, d, "documents"), "text").select("digest", F.octet_length("data").cast("long").alias("bytes")), "SELECT sha256(text) AS digest, any_value(strlen(text)) AS bytes FROM documents GROUP BY 1")
add("state_chunks", lambda s, d: T.chunked(read(s, d, "pages"), "page_id", "html", 1024).groupBy("page_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data")).alias("bytes")), "SELECT page_id, ceil(strlen(html) / 1024.0)::BIGINT AS chunks, strlen(html) AS bytes FROM pages WHERE html <> ''")
add("state_missing_chunks", lambda s, d: T.missing_chunks(T.blobs(read(s, d, "documents"), "text").select("digest"), T.blobs(read(s, d, "documents").filter("doc_id % 2 = 0"), "text")), "SELECT DISTINCT sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
add("state_hash_partition", lambda s, d: mutations(s, d).select("path").distinct().select("path", T.fnv1a("path").alias("hash"), T.partition_of("path", 16).alias("part")), f"""WITH {MUT}, p AS (SELECT DISTINCT path FROM mut),
h AS (SELECT path, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(path, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: xor(x, b) * 16777619 % 4294967296) AS hash FROM p)
SELECT path, hash, (hash * 16 // 4294967296)::INT AS part FROM h""")
Q["state_settle"] = lambda s, d: T.settle(mutations(s, d).withColumns({"arrival": F.col("event_id"), "hlc": F.when(F.col("event_id") % 4 > 0, F.col("hlc"))}))
Q["state_admit"] = lambda s, d: T.admit(mutations(s, d).withColumn("arrival", F.col("event_id")), mutations(s, d).filter("event_id % 5 = 0"), ["click", "view"])
add("state_links", lambda s, d: T.resolve_links(s, read(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.concat(F.lit("n"), ((F.col("n_nationkey") * 7 + 3) % 31).cast("string")).alias("target"))), """WITH RECURSIVE links AS (SELECT 'n' || n_nationkey AS path, 'n' || ((n_nationkey * 7 + 3) % 31) AS target FROM nation),
walk(path, at_, depth, cyclic) AS (SELECT path, target, 1, path = target FROM links
  UNION ALL SELECT w.path, l.target, w.depth + 1, l.target = w.path FROM walk w JOIN links l ON l.path = w.at_ WHERE NOT w.cyclic AND w.depth < 32)
SELECT path, arg_max(at_, depth) AS target, bool_or(cyclic) OR max(depth) >= 32 AS cyclic FROM walk GROUP BY path""")
