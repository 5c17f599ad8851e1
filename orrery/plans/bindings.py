"""Deterministic bindings of the engine's shapes to star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, grid

#: Dimensions of the volume that is aggregated from lineitem.
DIMS = (7, 16, 16)


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_volumes(spark, sf_dir: str) -> DataFrame:
    """x, y, z and three values a voxel: a = sum of quantities, b = number of lines, r = any returned line. Zero where there is none."""
    cell = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber").cast("long") - 1).alias("x"), (F.col("l_suppkey") % 16).alias("y"), (F.col("l_partkey") % 16).alias("z"), "l_quantity", "l_returnflag")
    sums = cell.groupBy(*AXES).agg(F.sum("l_quantity").alias("a"), F.count("*").cast("double").alias("b"), F.max((F.col("l_returnflag") == "R").cast("double")).alias("r"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return grid(spark, *DIMS).join(sums, list(AXES), "left").select(*AXES, zero("a"), zero("b"), zero("r"))


def volume(spark, sf_dir: str, which: str = "a") -> DataFrame:
    return lineitem_volumes(spark, sf_dir).select(*AXES, F.col(which).alias("value"))


def embedding_volume(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value")).select(F.col("x").cast("long").alias("x"), "y", F.lit(0).cast("long").alias("z"), F.col("value").cast("double").alias("value"))


def mutations(spark, sf_dir: str) -> DataFrame:
    """Mutation stream of the events: origin, sequence, hlc, path, value."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("origin"), F.row_number().over(w).cast("long").alias("sequence"), (ms * 65536).alias("hlc"),
        F.concat_ws(".", "event_type", (F.col("user_id") % 10).cast("string")).alias("path"), "value", "event_id",
    )


def run_ticks(spark, sf_dir: str) -> DataFrame:
    """Run log of the events: one agent a user, its events in order as ticks."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("agent"), (F.row_number().over(w) - 1).cast("long").alias("tick"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value", "event_type", "event_id")


def cells(spark, sf_dir: str) -> DataFrame:
    """Triangles of vertex numbers by line item, for incidence only."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("a"), (F.col("l_partkey") % 500).alias("b"), (F.col("l_suppkey") % 500).alias("c")).filter("a <> b and b <> c and a <> c").distinct()


# The same bindings in SQL.
VOL = """vol AS (
  SELECT g.x, g.y, g.z, coalesce(s.a, 0.0) AS a, coalesce(s.b, 0.0) AS b, coalesce(s.r, 0.0) AS r
  FROM (SELECT i % 7 AS x, (i // 7) % 16 AS y, i // 112 AS z FROM range(1792) t(i)) g
  LEFT JOIN (SELECT l_linenumber - 1 AS x, l_suppkey % 16 AS y, l_partkey % 16 AS z, sum(l_quantity) AS a,
               count(*)::DOUBLE AS b, max((l_returnflag = 'R')::INT)::DOUBLE AS r FROM lineitem GROUP BY ALL) s
  USING (x, y, z))"""
EMB = "emb AS (SELECT unnest(range(len(embedding))) AS x, vec_id AS y, 0::BIGINT AS z, unnest(embedding)::DOUBLE AS value FROM embeddings)"
MUT = """mut AS (SELECT user_id AS origin, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
  (epoch_us(ts) // 1000) * 65536 AS hlc, event_type || '.' || (user_id % 10) AS path, value, event_id FROM events)"""
RUN = """run AS (SELECT user_id AS agent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick,
  (epoch_us(ts) // 1000) AS ms, value, event_type, event_id FROM events)"""
CELLS = """cells AS (SELECT DISTINCT l_orderkey % 500 AS a, l_partkey % 500 AS b, l_suppkey % 500 AS c FROM lineitem
  WHERE l_orderkey % 500 <> l_partkey % 500 AND l_partkey % 500 <> l_suppkey % 500 AND l_orderkey % 500 <> l_suppkey % 500)"""
