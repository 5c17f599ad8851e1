"""Queries on tables with larger values and more copies than the given ones, against their SQL and against brute force."""

import contextlib
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.model import as_voxel_type
from orrery.operators import geometry as G
from orrery.operators import surfaces as U
from orrery.queries import ORACLES, QUERIES


def both(spark, name, folder, **tables):
    """Rows of a query and of its SQL on tables that are written to the folder."""
    db = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = db.sql(ORACLES[name])
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*want.columns).collect())), sorted(want.fetchall())


@contextlib.contextmanager
def deadline(spark, seconds):
    """Jobs that still run after these seconds are cancelled, so that what takes them fails."""
    t = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    t.start()
    try:
        yield
    finally:
        t.cancel()


def test_voxels_beyond_a_byte(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_quantity", F.col("l_quantity") * 1000)
    got, want = both(spark, "voxel_type_uchar", tmp_path, lineitem=lines)
    assert got == want
    assert max(r[3] for r in want) > 255
    with pytest.raises(ValueError):
        as_voxel_type("value", "uchar", "wrap")


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = (np.column_stack([rng.permutation(n), rng.integers(0, 40, (n, 2)) / 2 + rng.integers(0, 2, (n, 1)) * 60]) for n in (150, 90))
    a[:5, 1:], a[5:9, 1] = a[0, 1:], 500  # copies, and points with nothing near
    frame = lambda m: spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in m], "id long, x double, y double")
    want = {}
    for i, x, y in a:
        near = min(((x - p) ** 2 + (y - q) ** 2, int(j)) for j, p, q in b)
        if near[0] <= 9:
            want[int(i)] = near[::-1]
    assert {r["id"]: (r["other"], r["d2"]) for r in G.nearest(frame(a), frame(b), 3.0, 2).collect()} == want
    assert 50 < len(want) < 150 and len({d for _, d in want.values()}) > 5


def test_nearest_of_many_copies(spark):
    p = spark.range(400000).select("id", (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    with deadline(spark, 60):
        got = G.nearest(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), 12.0, 2).groupBy(F.col("id") % 3, "other", "d2").count().collect()
    assert sorted(map(tuple, got)) == [(0, 3, 0.0, 66667), (1, 1, 0.0, 66666), (2, 5, 0.0, 66667)]


def test_roads_equal_sql_and_the_least_of_equal_segments(spark, sf_dir, tmp_path):
    twice = lambda df, key, by: df.unionByName(df.withColumn(key, F.col(key) + by))
    people, firms = twice(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", 9797), twice(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", 7387)
    got, want = both(spark, "distance_to_road", tmp_path, customer=people, supplier=firms)
    assert got == want and len(want) > 50
    p = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 1.0), (3, 90.0, 0.0)], "id long, x double, y double")
    g = spark.createDataFrame([(s, -4.0, 0.0, 4.0, 0.0) for s in (9, 7)] + [(8, -4.0, 2.0, 4.0, 2.0), (5, -4.0, 3.0, 4.0, 3.0)], "seg long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, U.distance_to_segments(p, g, 5.0).collect())) == [(1, 7, 1.0), (2, 7, 1.0)]


def test_roads_of_many_copies(spark):
    p = spark.range(200000).select("id", (F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("y"))
    g = spark.range(100000).select(F.col("id").alias("seg"), F.lit(-4.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(4.0).alias("x1"), F.lit(0.0).alias("y1"))
    with deadline(spark, 60):
        assert [tuple(r) for r in U.distance_to_segments(p, g, 10.0).groupBy("seg", "d").count().collect()] == [(0, 1.0, 200000)]


def test_hausdorff_beyond_the_radius_and_of_nothing(spark, sf_dir, tmp_path):
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey in (2, 4, 45)")
    got, want = both(spark, "hausdorff", tmp_path, customer=people)
    assert got == want and want[0][0] > 30
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 60, (80, 3)).astype(float), rng.integers(20, 90, (50, 3)).astype(float)
    frame = lambda m: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)] + [(-1, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert G.hausdorff(frame(a), frame(b), 40.0).first()[0] == pytest.approx(max(d.min(1).max(), d.min(0).max()))
    assert G.hausdorff(frame(a), frame(b).limit(0), 40.0).first()[0] is None


def test_hausdorff_of_many_copies(spark):
    p = spark.range(400000).select("id", (F.col("id") % 4).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    with deadline(spark, 60):
        assert G.hausdorff(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), 30.0).first()[0] == 1.0


def test_neighbors_equal_brute_force_in_blocks(spark):
    rng = np.random.default_rng(6)
    m = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-6, 6, (200, 2)))]
    p = spark.createDataFrame(m, "id long, x double, y double")
    want = sorted((i, j, (x - u) ** 2 + (y - v) ** 2) for i, x, y in m for j, u, v in m if i != j and (x - u) ** 2 + (y - v) ** 2 <= 4)
    for block in (1, 3, 1024):
        assert sorted(map(tuple, G.within_radius(p, 2.0, 2, block=block).collect())) == want
    odd = spark.createDataFrame([(None, 0.0, 0.0), (7, None, 0.0), (8, float("nan"), 0.0)], "id long, x double, y double")
    assert {tuple(r) for r in G.within_radius(p.filter("id = 0").withColumns({"x": F.lit(0.0), "y": F.lit(0.0)}), 2.0, 2, odd).collect()} == {(0, None, 0.0)}


def test_neighbors_of_many_copies_meet_by_place(spark):
    p = spark.range(20000).select("id", (F.col("id") % 2 * 2.5).alias("x"), F.lit(0.0).alias("y"))
    near = G.within_radius(p, 1.0, 2)
    assert near.count() == 2 * 10000 * 9999
    joins = [x for x in near._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 1 and "Aggregate" in near._jdf.queryExecution().optimizedPlan().toString()
