"""Queries of the geometry, level-of-detail, grid and topology operators on the bound tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import lod as L
from ..operators import topology as P
from .bindings import CELLS, DIMS, cells, read, volume

Q, S = {}, {}


def add(name, query, sql):
    Q[name], S[name] = query, sql


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


def vertices(spark):
    return spark.range(500).select(F.col("id").alias("vid"), (F.col("id") % 10).cast("double").alias("x"), (F.floor(F.col("id") / 10) % 10).cast("double").alias("y"), (F.floor(F.col("id") / 100) + F.col("id") % 7 / 10).alias("z"))


def mesh(spark, d):
    return cells(spark, d).select((F.col("a") * 250000 + F.col("b") * 500 + F.col("c")).alias("cid"), F.array("a", "b", "c").alias("corner"))


VERT = "vert AS (SELECT i AS vid, (i % 10)::DOUBLE AS x, ((i // 10) % 10)::DOUBLE AS y, i // 100 + (i % 7) / 10.0::DOUBLE AS z FROM range(500) t(i))"
TRI = f"""{CELLS}, {VERT}, tri AS (SELECT a * 250000 + b * 500 + c AS cid, a, b, c, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz
  FROM cells JOIN vert p ON p.vid = a JOIN vert q ON q.vid = b JOIN vert r ON r.vid = c),
nrm AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM tri)"""
EDGES = f"""{CELLS}, edges AS (SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS n FROM (SELECT a AS p, b AS q FROM cells UNION ALL SELECT b, c FROM cells UNION ALL SELECT c, a FROM cells) GROUP BY ALL)"""

add("mesh_extents", lambda s, d: G.extents(vertices(s)), f"WITH {VERT} SELECT min(x) AS minx, min(y) AS miny, min(z) AS minz, max(x) AS maxx, max(y) AS maxy, max(z) AS maxz FROM vert")
add("mesh_areas", lambda s, d: r6(G.triangle_areas(mesh(s, d), vertices(s)), "area"), f"WITH {TRI} SELECT cid, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) AS area FROM nrm")
add("mesh_edges", lambda s, d: G.edges(mesh(s, d)), f"WITH {EDGES} SELECT * FROM edges")
add("mesh_boundary_edges", lambda s, d: G.boundary_edges(mesh(s, d)), f"WITH {EDGES} SELECT a, b FROM edges WHERE n = 1")
add("mesh_boundary_vertices", lambda s, d: G.boundary_vertices(mesh(s, d)), f"WITH {EDGES} SELECT a AS vid FROM edges WHERE n = 1 UNION SELECT b FROM edges WHERE n = 1")
add("mesh_normals", lambda s, d: r6(G.vertex_normals(mesh(s, d), vertices(s)), "nx", "ny", "nz"), f"""WITH {TRI}, e AS (SELECT a AS vid, nx, ny, nz FROM nrm UNION ALL SELECT b, nx, ny, nz FROM nrm UNION ALL SELECT c, nx, ny, nz FROM nrm),
m AS (SELECT vid, sum(nx) nx, sum(ny) ny, sum(nz) nz FROM e GROUP BY vid), l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM m)
SELECT vid, round(nx / l, 6) + 0.0 AS nx, round(ny / l, 6) + 0.0 AS ny, round(nz / l, 6) + 0.0 AS nz FROM l""")
add("mesh_mass", lambda s, d: r6(G.mass(mesh(s, d), vertices(s)), "value"), f"""WITH {TRI}, e AS (SELECT unnest([a, b, c]) AS row, sqrt(nx * nx + ny * ny + nz * nz) / 6 AS v FROM nrm) SELECT row, row AS col, round(sum(v), 6) AS value FROM e GROUP BY row""")
add("mesh_assembly", lambda s, d: G.assemble(read(s, d, "lineitem").select((F.col("l_suppkey") % 50).alias("row"), (F.col("l_partkey") % 50).alias("col"), F.col("l_quantity").alias("value"))), "SELECT l_suppkey % 50 AS row, l_partkey % 50 AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")


def tets(s, d):
    return read(s, d, "lineitem").select((F.col("l_orderkey") % 40).alias("a"), (F.col("l_partkey") % 40 + 40).alias("b"), (F.col("l_suppkey") % 40 + 80).alias("c"), (F.col("l_linenumber") % 7 + 120).cast("long").alias("e")).distinct().select((F.col("a") * 1000000 + (F.col("b") - 40) * 10000 + (F.col("c") - 80) * 100 + F.col("e") - 120).alias("cid"), F.array("a", "b", "c", "e").alias("corner"))


TETS = "tets AS (SELECT DISTINCT l_orderkey % 40 AS a, l_partkey % 40 + 40 AS b, l_suppkey % 40 + 80 AS c, l_linenumber % 7 + 120 AS e FROM lineitem)"
add("tet_boundary", lambda s, d: G.tet_boundary(tets(s, d)).select(F.col("face")[0].alias("a"), F.col("face")[1].alias("b"), F.col("face")[2].alias("c")), f"WITH {TETS} SELECT a, b, c FROM (SELECT a, b, c FROM tets UNION ALL SELECT a, b, e FROM tets UNION ALL SELECT a, c, e FROM tets UNION ALL SELECT b, c, e FROM tets) GROUP BY ALL HAVING count(*) = 1")
add("tet_edges", lambda s, d: G.tet_edges(tets(s, d)), f"WITH {TETS} SELECT a, b FROM tets UNION SELECT a, c FROM tets UNION SELECT a, e FROM tets UNION SELECT b, c FROM tets UNION SELECT b, e FROM tets UNION SELECT c, e FROM tets")
add("tet_volumes", lambda s, d: r6(G.tet_volumes(tets(s, d), vertices(s)), "volume"), f"""WITH {TETS}, {VERT}, t AS (SELECT a * 1000000 + (b - 40) * 10000 + (c - 80) * 100 + e - 120 AS cid, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz, w.x - p.x AS wx, w.y - p.y AS wy, w.z - p.z AS wz
  FROM tets JOIN vert p ON p.vid = a JOIN vert q ON q.vid = b JOIN vert r ON r.vid = c JOIN vert w ON w.vid = e)
SELECT cid, round((ux * (vy * wz - vz * wy) + uy * (vz * wx - vx * wz) + uz * (vx * wy - vy * wx)) / 6, 6) + 0.0 AS volume FROM t""")


def points(s, d):
    return read(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 101).cast("double").alias("x"), (F.col("c_custkey") * 7 % 97).cast("double").alias("y"), F.lit(0.0).alias("z"))


PTS = "pts AS (SELECT c_custkey AS id, (c_custkey % 101)::DOUBLE AS x, (c_custkey * 7 % 97)::DOUBLE AS y FROM customer)"
add("neighbors_within_radius", lambda s, d: G.within_radius(points(s, d), 3.0, 2).select("id", "other"), f"WITH {PTS} SELECT a.id, b.id AS other FROM pts a JOIN pts b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9")
add("closest_points", lambda s, d: G.nearest(points(s, d).filter("id % 3 = 0"), points(s, d).filter("id % 3 = 1"), 12.0, 2), f"WITH {PTS} SELECT a.id, min_by(b.id, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 1e7 + b.id) AS other, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM pts a JOIN pts b ON a.id % 3 = 0 AND b.id % 3 = 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144 GROUP BY a.id")
add("hausdorff", lambda s, d: r6(G.hausdorff(points(s, d).filter("id % 2 = 0"), points(s, d).filter("id % 2 = 1"), 30.0), "distance"), f"WITH {PTS}, p AS (SELECT a.id AS i, b.id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pts a JOIN pts b ON a.id % 2 = 0 AND b.id % 2 = 1) SELECT round(sqrt(greatest((SELECT max(m) FROM (SELECT min(d2) m FROM p GROUP BY i)), (SELECT max(m) FROM (SELECT min(d2) m FROM p GROUP BY j)))), 6) AS distance")


def rings(s):
    pt = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    k = F.col("id")
    return s.range(40).select(k.alias("poly_id"), F.array(pt(k % 7, k % 5), pt(k % 7 + 20 + k, k % 5), pt(k % 7 + 20 + k, k % 5 + 15), pt(k % 7 + 9, k % 5 + 8 + k % 3), pt(k % 7, k % 5 + 15)).alias("ring"))


RINGS = """rings AS (SELECT i AS poly_id, unnest([0, 1, 2, 3, 4]) AS k, unnest([i % 7, i % 7 + 20 + i, i % 7 + 20 + i, i % 7 + 9, i % 7]) AS x, unnest([i % 5, i % 5, i % 5 + 15, i % 5 + 8 + i % 3, i % 5 + 15]) AS y FROM range(40) t(i)),
ed AS (SELECT p.poly_id, p.x, p.y, q.x AS x1, q.y AS y1 FROM rings p JOIN rings q ON p.poly_id = q.poly_id AND q.k = (p.k + 1) % 5)"""
add("polygon_measures", lambda s, d: r6(rings(s).select("poly_id", G.signed_area("ring").alias("area"), G.perimeter("ring").alias("perimeter")), "area", "perimeter"), f"WITH {RINGS} SELECT poly_id, round(sum(x * y1 - x1 * y) / 2.0::DOUBLE, 6) AS area, round(sum(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))), 6) AS perimeter FROM ed GROUP BY poly_id")


def located(s, d):
    p = points(s, d).groupBy((F.col("id") % 31).alias("x"), (F.col("id") % 17).alias("y")).agg(F.count("*").alias("n"))
    polygons = rings(s)
    hit = G.located(p, polygons).filter("place <> 'outside'").groupBy("poly_id", "place").agg(F.sum("n").alias("n"))
    rest = polygons.select("poly_id").join(hit.groupBy("poly_id").agg(F.sum("n").alias("hit")), "poly_id", "left").crossJoin(p.agg(F.sum("n").alias("all")))  # one row
    rest = rest.select("poly_id", F.lit("outside").alias("place"), (F.col("all") - F.coalesce("hit", F.lit(0))).alias("n")).filter("n > 0")
    return hit.unionByName(rest)


add("point_in_polygon", located, f"""WITH {RINGS}, p AS (SELECT c_custkey AS id, c_custkey % 31 AS px, c_custkey % 17 AS py FROM customer),
j AS (SELECT poly_id, id, bool_or((x1 - x) * (py - y) = (y1 - y) * (px - x) AND px BETWEEN least(x, x1) AND greatest(x, x1) AND py BETWEEN least(y, y1) AND greatest(y, y1)) AS rim,
  count(*) FILTER ((y > py) <> (y1 > py) AND px < (x1 - x) * (py - y) / (y1 - y)::DOUBLE + x) % 2 = 1 AS odd FROM ed, p GROUP BY ALL)
SELECT poly_id, CASE WHEN rim THEN 'boundary' WHEN odd THEN 'inside' ELSE 'outside' END AS place, count(*) AS n FROM j GROUP BY ALL""")
add("polygon_booleans", lambda s, d: _booleans(s, d), """WITH a AS (SELECT DISTINCT c_custkey % 40 AS x, c_custkey % 29 AS y FROM customer), b AS (SELECT DISTINCT c_custkey % 37 AS x, c_custkey % 31 AS y FROM customer)
SELECT 'union' AS op, (SELECT count(*) FROM (FROM a UNION FROM b)) AS n UNION ALL SELECT 'intersection', (SELECT count(*) FROM (FROM a INTERSECT FROM b)) UNION ALL SELECT 'subtract', (SELECT count(*) FROM (FROM a EXCEPT FROM b)) UNION ALL SELECT 'xor', (SELECT count(*) FROM ((FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a)))""")


def _booleans(s, d):
    a, b = (read(s, d, "customer").select((F.col("c_custkey") % m).alias("x"), (F.col("c_custkey") % n).alias("y")).distinct() for m, n in ((40, 29), (37, 31)))
    out = None
    for op in ("union", "intersection", "subtract", "xor"):
        n = G.boolean(a, b, op).agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = n if out is None else out.union(n)
    return out


# an order is linked to the next one by its odd lines: components are runs of order numbers
add("mesh_components", lambda s, d: G.connected(read(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("b")).filter("a <> b").distinct()), """WITH k AS (SELECT DISTINCT l_orderkey AS a FROM lineitem WHERE l_linenumber % 2 = 1),
g AS (SELECT a, a - row_number() OVER (ORDER BY a) AS run FROM k), l AS (SELECT a, min(a) OVER (PARTITION BY run) AS label FROM g)
SELECT DISTINCT node, label FROM (SELECT a AS node, label FROM l UNION ALL SELECT a + 1, label FROM l)""")
add("lod_parts", lambda s, d: L.partition_parts(read(s, d, "part").select((F.col("p_partkey") % 100).alias("cx"), (F.col("p_size") * 2).alias("cy"), F.lit(0).alias("cz"), F.col("p_size").alias("tris")), 16.0), "SELECT floor((p_partkey % 100) / 16.0)::BIGINT AS tx, floor(p_size * 2 / 16.0)::BIGINT AS ty, 0::BIGINT AS tz, count(*) AS parts, sum(p_size)::BIGINT AS tris FROM part GROUP BY ALL")
add("lod_suffix_key", lambda s, d: read(s, d, "part").select("p_partkey", L.suffix_group_key("p_name", ["1", "22", "3"]).alias("key")), "SELECT p_partkey, CASE WHEN ends_with(p_name, '1') THEN p_name[:-2] WHEN ends_with(p_name, '22') THEN p_name[:-3] WHEN ends_with(p_name, '3') THEN p_name[:-2] ELSE p_name END AS key FROM part")
add("lod_priority", lambda s, d: r6(read(s, d, "part").select("p_partkey", L.priority(F.col("p_size") * 1.0, F.col("p_retailprice")).alias("score"), L.screen_error_px(F.col("p_size") / 100, F.col("p_retailprice"), 1080, 1.0).alias("px"), L.switch_radius_m(F.col("p_size") / 100, 2.0, 1080, 1.0).alias("radius")), "score", "px", "radius"), "SELECT p_partkey, round(p_size / (1 + (p_retailprice / 1000) * (p_retailprice / 1000)), 6) AS score, round(p_size / 100.0::DOUBLE / p_retailprice * (1080 / (2 * tan(0.5::DOUBLE))), 6) AS px, round(p_size / 100.0::DOUBLE * (1080 / (2 * tan(0.5::DOUBLE))) / 2, 6) AS radius FROM part")
add("lod_ladder", lambda s, d: L.monotone(read(s, d, "part").select((F.col("p_partkey") % 50).alias("asset"), F.col("p_partkey").alias("rung"), F.col("p_size").cast("double").alias("world_error_m"))), "SELECT p_partkey % 50 AS asset, p_partkey AS rung, max(p_size::DOUBLE) OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS world_error_m FROM part")
add("lod_pyramid", lambda s, d: L.pyramid(volume(s, d), 3).groupBy("level").agg(F.count("*").alias("n"), F.sum("value").alias("total")), """WITH g AS (SELECT i % 7 AS x, (i // 7) % 16 AS y, i // 112 AS z FROM range(1792) t(i)), s AS (SELECT l_linenumber - 1 AS x, l_suppkey % 16 AS y, l_partkey % 16 AS z, sum(l_quantity) AS a FROM lineitem GROUP BY ALL), v AS (SELECT x, y, z, coalesce(a, 0.0) AS a FROM g LEFT JOIN s USING (x, y, z))
SELECT k::INT AS level, count(*) AS n, sum(a) AS total FROM v, range(3) r(k) WHERE x % (2 ** k)::INT = 0 AND y % (2 ** k)::INT = 0 AND z % (2 ** k)::INT = 0 GROUP BY k""")
Q["lod_solve"] = lambda s, d: L.solve(read(s, d, "part").select((F.col("p_partkey") % 20).alias("frame"), F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("score"), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("c0"), F.array(F.col("p_size") * 4.0, F.col("p_size") * 2.0, F.lit(0.0)).alias("c1"), F.array(F.col("p_size") * 64.0, F.col("p_size") * 16.0, F.lit(0.0)).alias("c2")), (40.0, 1500.0, 30000.0))
add("lod_select_rung", lambda s, d: L.select_rung(read(s, d, "events").select((F.col("user_id") % 40).alias("asset"), F.col("event_id").alias("step"), F.col("value").alias("distance")), [20.0, 60.0, 150.0]).select("asset", F.posexplode("rungs").alias("k", "rung")), """WITH RECURSIVE e AS (SELECT user_id % 40 AS asset, (row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1)::INT AS k, value AS d FROM events),
t AS (SELECT asset, k, (d >= 20)::INT + (d >= 60)::INT + (d >= 150)::INT AS p, (d >= 20::DOUBLE * 1.15::DOUBLE)::INT + (d >= 60::DOUBLE * 1.15::DOUBLE)::INT + (d >= 150::DOUBLE * 1.15::DOUBLE)::INT AS w FROM e),
r(asset, k, rung) AS (SELECT asset, k, p FROM t WHERE k = 0 UNION ALL SELECT t.asset, t.k, CASE WHEN r.rung < w THEN w WHEN r.rung > p THEN p ELSE r.rung END FROM r JOIN t ON t.asset = r.asset AND t.k = r.k + 1) SELECT asset, k, rung FROM r""")


def occupied(s, d):
    """Cells of all events; one is occupied if the last event in it has a number that 9 divides."""
    cell = read(s, d, "events").groupBy((F.col("user_id") % 32).alias("r"), (F.col("event_id") % 48).alias("c"))
    return cell.agg(F.max("event_id").alias("last")).filter("last % 9 = 0").select("r", "c")


OCC = "occ AS (SELECT user_id % 32 AS r, event_id % 48 AS c FROM events GROUP BY ALL HAVING max(event_id) % 9 = 0)"


def lattice(s, d):
    g = s.range(32 * 48).select(F.floor(F.col("id") / 48).cast("long").alias("r"), (F.col("id") % 48).alias("c"))
    return g.join(occupied(s, d).withColumn("o", F.lit(1)), ["r", "c"], "left").select("r", "c", F.coalesce("o", F.lit(0)).alias("occ"))


add("grid_inflate", lambda s, d: L.inflate(occupied(s, d), 1, 32, 48), f"WITH {OCC} SELECT DISTINCT i AS r, j AS c FROM range(32) x(i), range(48) y(j), occ WHERE abs(i - occ.r) + abs(j - occ.c) <= 1")
add("grid_edt", lambda s, d: L.edt2(lattice(s, d), 32, 48), f"WITH {OCC} SELECT i AS r, j AS c, min((i - occ.r) * (i - occ.r) + (j - occ.c) * (j - occ.c))::DOUBLE AS d2 FROM range(32) x(i), range(48) y(j), occ GROUP BY ALL")
add("grid_clearance", lambda s, d: r6(L.edt2(lattice(s, d), 32, 48).select("r", "c", L.clearance_cost(F.col("d2"), 2.0, 4.0).alias("cost")), "cost"), f"WITH {OCC} SELECT i AS r, j AS c, round(2 * greatest(0.0, 4 - sqrt(min((i - occ.r) * (i - occ.r) + (j - occ.c) * (j - occ.c)))), 6) AS cost FROM range(32) x(i), range(48) y(j), occ GROUP BY i, j")
add("grid_nearest_free", lambda s, d: L.nearest_free(occupied(s, d).select((F.col("r") * 48 + F.col("c")).alias("id"), "r", "c"), lattice(s, d).filter("occ = 0")).select("id"), f"WITH {OCC} SELECT r * 48 + c AS id FROM occ")
Q["grid_sdf"] = lambda s, d: r6(L.build_sdf(lattice(s, d), 32, 48), "sdf", "gr", "gc")
add("grid_line_of_sight", lambda s, d: L.line_of_sight(s.range(100).select("id", (F.col("id") % 32).alias("r0"), (F.col("id") % 48).alias("c0"), (F.col("id") * 7 % 32).alias("r1"), (F.col("id") * 5 % 48).alias("c1")), occupied(s, d)), f"""WITH RECURSIVE {OCC}, q AS (SELECT i AS id, i % 32 AS r0, i % 48 AS c0, i * 7 % 32 AS r1, i * 5 % 48 AS c1 FROM range(100) t(i)),
d AS (SELECT *, abs(r1 - r0) AS dr, abs(c1 - c0) AS dc, CASE WHEN r1 > r0 THEN 1 ELSE -1 END AS sr, CASE WHEN c1 > c0 THEN 1 ELSE -1 END AS sc FROM q),
b(id, r, c, err) AS (SELECT id, r0, c0, dc - dr FROM d
  UNION ALL SELECT b.id, CASE WHEN 2 * err < dc THEN r + sr ELSE r END, CASE WHEN 2 * err > -dr THEN c + sc ELSE c END, err - CASE WHEN 2 * err > -dr THEN dr ELSE 0 END + CASE WHEN 2 * err < dc THEN dc ELSE 0 END FROM b JOIN d ON b.id = d.id WHERE r <> r1 OR c <> c1)
SELECT b.id, count(occ.r) = 0 AS clear FROM b LEFT JOIN occ ON occ.r = b.r AND occ.c = b.c GROUP BY b.id""")
add("grid_water", lambda s, d: L.water_bodies(occupied(s, d)), f"""WITH RECURSIVE {OCC}, met(r, c, body) AS (SELECT r, c, r * 4294967296 + c FROM occ
  UNION SELECT o.r, o.c, m.body FROM met m JOIN occ o ON abs(o.r - m.r) + abs(o.c - m.c) = 1) SELECT r, c, min(body) AS body FROM met GROUP BY r, c""")


def searched(s, d):
    g = np.zeros((32, 48), bool)
    for r, c in occupied(s, d).collect():  # a grid of fixed size
        g[r, c] = True
    return L.paths(s.range(30).select("id", F.lit(0).alias("r0"), (F.col("id") % 48).alias("c0"), F.lit(31).alias("r1"), (F.col("id") * 11 % 48).alias("c1")), g)


Q["grid_astar"] = searched
Q["contour_tree"] = lambda s, d: P.contour_trees(volume(s, d).withColumn("vol_id", F.lit("v")), DIMS)
Q["contour_spectrum"] = lambda s, d: r6(P.contour_spectrum(volume(s, d), DIMS, 16), "volume", "area", "gradient")
Q["isosurface"] = lambda s, d: P.isosurface(volume(s, d), 800.0).agg(F.count("*").alias("triangles"))
Q["segment_seeded"] = lambda s, d: P.segment(volume(s, d).withColumn("vol_id", F.lit("v")), {1: [(1, 2, 3)], 2: [(5, 12, 12)]}, 0.02)
