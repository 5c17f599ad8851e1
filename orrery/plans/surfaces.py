"""Queries of the further mesh and polygon operators on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import surfaces as U
from .bindings import read
from .geometry import RINGS, TETS, VERT, mesh, r6, rings, tets, vertices

Q, S = {}, {}


def add(name, query, sql):
    Q[name], S[name] = query, sql


def proxies(s, d):
    return read(s, d, "part").select("p_partkey", (F.col("p_partkey") % 100).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), (F.col("p_retailprice") / 100).alias("z"), (F.col("p_size") % 3).cast("double").alias("r"))


add("cull", lambda s, d: U.culled(proxies(s, d), [(1, 0, 0, -20), (-1, 1, 0, 30)], (50.0, 25.0, 10.0), 40.0).select("p_partkey"), "SELECT p_partkey FROM (SELECT p_partkey, (p_partkey % 100)::DOUBLE AS x, p_size::DOUBLE AS y, p_retailprice / 100 AS z, (p_size % 3)::DOUBLE AS r FROM part) WHERE sqrt((x - 50) * (x - 50) + (y - 25) * (y - 25) + (z - 10) * (z - 10)) - r <= 40 AND x - 20 >= -r AND -x + y + 30 >= -r")
add("tet_slice_cells", lambda s, d: U.slice_tets(tets(s, d), vertices(s), (0, 0, 1, -0.9)).select("cid").distinct(), f"WITH {TETS}, {VERT}, t AS (SELECT a * 1000000 + (b - 40) * 10000 + (c - 80) * 100 + e - 120 AS cid, p.z AS z0, q.z AS z1, r.z AS z2, w.z AS z3 FROM tets JOIN vert p ON p.vid = a JOIN vert q ON q.vid = b JOIN vert r ON r.vid = c JOIN vert w ON w.vid = e) SELECT cid FROM t WHERE least(z0, z1, z2, z3) - 0.9 <= 0 AND greatest(z0, z1, z2, z3) - 0.9 > 0")


def roads(s, d):
    p = read(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 101).cast("double").alias("x"), (F.col("c_custkey") * 7 % 97).cast("double").alias("y"))
    g = read(s, d, "supplier").select(F.col("s_suppkey").alias("seg"), (F.col("s_suppkey") * 3 % 89).cast("double").alias("x0"), (F.col("s_suppkey") * 5 % 83).cast("double").alias("y0"), (F.col("s_suppkey") * 3 % 89 + 7).cast("double").alias("x1"), (F.col("s_suppkey") * 5 % 83 + 4).cast("double").alias("y1"))
    return r6(U.distance_to_segments(p, g, 10.0).select("id", "d"), "d")


add("distance_to_road", roads, """WITH p AS (SELECT c_custkey AS id, (c_custkey % 101)::DOUBLE AS x, (c_custkey * 7 % 97)::DOUBLE AS y FROM customer), g AS (SELECT (s_suppkey * 3 % 89)::DOUBLE AS x0, (s_suppkey * 5 % 83)::DOUBLE AS y0 FROM supplier),
t AS (SELECT id, x, y, x0, y0, greatest(0.0::DOUBLE, least(1.0, ((x - x0) * 7 + (y - y0) * 4) / 65)) AS t FROM p, g), m AS (SELECT id, min(sqrt((x0 + t * 7 - x) ** 2 + (y0 + t * 4 - y) ** 2)) AS d FROM t GROUP BY id) SELECT id, round(d, 6) AS d FROM m WHERE d <= 10""")
add("polygon_nesting", lambda s, d: U.nested(rings(s)), f"""WITH {RINGS}, ar AS (SELECT poly_id, abs(sum(x * y1 - x1 * y)) / 2 AS area FROM ed GROUP BY poly_id),
hit AS (SELECT o.poly_id AS id, e.poly_id AS outside, count(*) FILTER ((e.y > o.y) <> (e.y1 > o.y) AND o.x < e.x + (o.y - e.y) * (e.x1 - e.x) / (e.y1 - e.y)) AS n,
  bool_or((e.x1 - e.x) * (o.y - e.y) = (e.y1 - e.y) * (o.x - e.x) AND o.x BETWEEN least(e.x, e.x1) AND greatest(e.x, e.x1) AND o.y BETWEEN least(e.y, e.y1) AND greatest(e.y, e.y1)) AS rim
  FROM rings o JOIN ed e ON e.poly_id <> o.poly_id WHERE o.k = 0 GROUP BY ALL),
up AS (SELECT id, arg_min(outside, (p.area, outside)) AS parent FROM hit JOIN ar p ON p.poly_id = outside JOIN ar q ON q.poly_id = id WHERE n % 2 = 1 AND NOT rim AND p.area > q.area GROUP BY id)
SELECT ar.poly_id, parent FROM ar LEFT JOIN up ON up.id = ar.poly_id""")
Q["mesh_edge_distance"] = lambda s, d: r6(U.edge_distance(mesh(s, d), vertices(s), [0]), "distance")
Q["mesh_mean_curvature"] = lambda s, d: r6(U.mean_curvature(mesh(s, d), vertices(s)), "curvature")
