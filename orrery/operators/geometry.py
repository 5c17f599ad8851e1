"""Meshes, polygons, proximity and finite elements.

Meshes are ``vertices(vid, x, y, z)`` and ``cells(cid, corner)``; operators on incidence explode corners once and join
vertices once. Proximity is by grid buckets: equi-joins on cells whose size is the radius, never a cross join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from fractions import Fraction
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import finite

AXES = ("x", "y", "z")


def extents(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(*(f(a).alias(n + a) for n, f in (("min", F.min), ("max", F.max)) for a in AXES))


def corners(cells: DataFrame, vertices: DataFrame, n: int) -> DataFrame:
    """Cells with the coordinates of their n corners as columns x0, y0, z0, x1, ..."""
    out = cells
    for k in range(n):
        out = out.withColumn("_v", F.col("corner")[k]).join(vertices.select(F.col("vid").alias("_v"), *(F.col(a).alias(f"{a}{k}") for a in AXES)), "_v").drop("_v")
    return out


def edge(i: int, j: int) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{a}{j}") - F.col(f"{a}{i}") for a in AXES)


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a):
    return F.sqrt(dot(a, a))


def triangle_areas(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    return corners(cells, vertices, 3).select("cid", (norm(cross(edge(0, 1), edge(0, 2))) / 2).alias("area"))


def tet_volumes(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Signed volume of each tetrahedron."""
    return corners(cells, vertices, 4).select("cid", (dot(edge(0, 1), cross(edge(0, 2), edge(0, 3))) / 6).alias("volume"))


def angle(k: int) -> Column:
    """Inner angle of a triangle at a corner."""
    a, b = edge(k, (k + 1) % 3), edge(k, (k + 2) % 3)
    return F.atan2(norm(cross(a, b)), dot(a, b))


def vertex_normals(cells: DataFrame, vertices: DataFrame, weight: str = "area") -> DataFrame:
    """Unit normals of vertices from their triangles, weighted uniformly, by area or by angle."""
    c = corners(cells, vertices, 3)
    n = cross(edge(0, 1), edge(0, 2))
    length = norm(n)
    unit = {a: F.when(length > 0, v / length).otherwise(F.lit(0.0)) for a, v in zip(AXES, n)}
    w = F.array(*({"uniform": F.lit(1.0), "area": length, "angle": angle(k)}[weight] for k in range(3)))
    each = c.select(*(v.alias("n" + a) for a, v in unit.items()), F.posexplode(F.arrays_zip(F.col("corner").alias("v"), w.alias("w"))).alias("_k", "_c"))
    sums = each.groupBy(F.col("_c.v").alias("vid")).agg(*(F.sum(F.col("n" + a) * F.col("_c.w")).alias("n" + a) for a in AXES))
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return sums.select("vid", *(F.when(size > 0, F.col("n" + a) / size).otherwise(F.lit(0.0)).alias("n" + a) for a in AXES))


def edges(cells: DataFrame) -> DataFrame:
    """Distinct edges (a < b) of the cells, with the number of cells that use each."""
    n = F.size("corner")
    e = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_sort(F.array(F.col("corner")[i], F.col("corner")[(i + 1) % n])))
    return cells.select(F.explode(e).alias("e")).groupBy(F.col("e")[0].alias("a"), F.col("e")[1].alias("b")).agg(F.count("*").alias("n"))


def tet_edges(cells: DataFrame) -> DataFrame:
    pairs = F.array(*(F.array_sort(F.array(F.col("corner")[i], F.col("corner")[j])) for i in range(4) for j in range(i + 1, 4)))
    return cells.select(F.explode(pairs).alias("e")).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b")).distinct()


def boundary_edges(cells: DataFrame) -> DataFrame:
    """Edges that one cell uses."""
    return edges(cells).filter("n = 1").select("a", "b")


def boundary_vertices(cells: DataFrame) -> DataFrame:
    return boundary_edges(cells).select(F.explode(F.array("a", "b")).alias("vid")).distinct()


def tet_boundary(cells: DataFrame) -> DataFrame:
    """Faces that one tetrahedron uses, corners in order."""
    faces = F.array(*(F.array_sort(F.array(*(F.col("corner")[j] for j in range(4) if j != i))) for i in range(4)))
    return cells.select(F.explode(faces).alias("face")).groupBy("face").count().filter("count = 1").select("face")


def triangulated(quads: DataFrame) -> DataFrame:
    """Two triangles of each quad."""
    c = F.col("corner")
    return quads.select("cid", F.posexplode(F.array(F.array(c[0], c[1], c[2]), F.array(c[0], c[2], c[3]))).alias("part", "corner"))


def weld(vertices: DataFrame, epsilon: float) -> DataFrame:
    """(vid, keep): vertices within epsilon of each other, chained, keep the least number. Buckets, then label passing."""
    near = within_radius(vertices.select(F.col("vid").alias("id"), *AXES), epsilon)
    label = connected(near.select(F.col("id").alias("a"), F.col("other").alias("b")))
    return vertices.select("vid").join(label.select(F.col("node").alias("vid"), F.col("label").alias("keep")), "vid", "left").withColumn("keep", F.coalesce("keep", "vid"))


def repair(cells: DataFrame, vertices: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """Welded mesh without degenerate cells and unreferenced vertices."""
    keep = weld(vertices, epsilon)
    c = cells.select("cid", F.posexplode("corner").alias("k", "vid")).join(keep, "vid").groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "keep"))), lambda s: s["keep"]).alias("corner"))
    c = c.filter(F.size(F.array_distinct("corner")) == F.size("corner"))
    return c, vertices.join(c.select(F.explode("corner").alias("vid")).distinct(), "vid", "left_semi")


def located(points: DataFrame, polygons: DataFrame, cell: float = 16.0) -> DataFrame:
    """(poly_id, x, y, n, place) of the points (x, y, n) in the cells that a polygon's (poly_id, ring) bounding box touches; points elsewhere are outside of it. An equal join by cell."""
    low, high = ({a: F.floor(pick(F.transform("ring", lambda p: p[a])) / cell).cast("long") for a in "xy"} for pick in (F.array_min, F.array_max))
    boxes = polygons.withColumn("cx", F.explode(F.sequence(low["x"], high["x"]))).withColumn("cy", F.explode(F.sequence(low["y"], high["y"])))
    at = points.withColumns({"c" + a: F.floor(F.col(a) / cell).cast("long") for a in "xy"})
    return at.join(boxes, ["cx", "cy"]).select("poly_id", "x", "y", "n", locate("ring", F.struct("x", "y")).alias("place"))


def connected(edge_list: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b) reaches, by label passing with shortcuts."""
    both = settled(edge_list.select("a", "b").union(edge_list.select("b", "a")).distinct())
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node")
    for k in range(rounds):
        low = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"))
        new = label.join(low, F.col("node") == F.col("a")).select("node", F.least("label", "low").alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("root", "label")).alias("label"))
        new = settled(new)
        same = new.join(label.select("node", F.col("label").alias("was")), "node").filter("label <> was").isEmpty()
        label = new
        if same:
            break
    return label


def settled(df: DataFrame) -> DataFrame:
    """Lineage cut by a table in the shared folder that the session names in spark.checkpoint.dir; cached where it is unset (tests)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.cache()
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def places(points: DataFrame, axes: Sequence[str], **what: Column) -> DataFrame:
    """Each place of the points once, as id, with its axes and what is aggregated there."""
    return points.groupBy(*axes).agg(F.count("*"), *(c.alias(n) for n, c in what.items())).select(F.struct(*axes).alias("id"), *axes, *what)


def meet(left: DataFrame, right: DataFrame, radius: float, axes: Sequence[str]) -> DataFrame:
    """Rows of left and right at most a radius apart, with d2: each goes to its cell, and meets those of the cells around. Right's axes get an o in front."""
    cell = lambda a: F.floor(F.col(a) / radius).cast("long")
    around = F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip(axes, o))) for o in product((-1, 0, 1), repeat=len(axes))))
    left = left.withColumns({"c" + a: cell(a) for a in axes})
    kept = [c for c in right.columns if c not in axes]
    right = right.select(*kept, *(F.col(a).alias("o" + a) for a in axes), *(cell(a).alias("b" + a) for a in axes)).withColumn("_o", F.explode(around))
    right = right.select(*kept, *("o" + a for a in axes), *((F.col("b" + a) + F.col("_o." + a)).alias("c" + a) for a in axes))
    d2 = sum(((F.col(a) - F.col("o" + a)) * (F.col(a) - F.col("o" + a)) for a in axes[1:]), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")))
    return left.join(right, ["c" + a for a in axes]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


def within_radius(points: DataFrame, radius: float, dims: int = 3, others: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """(id, other, d2) of points (id, x, y, z) at most a radius apart, themselves excluded: places meet by cells, then the ids
    of both, in blocks that are dealt out anew. The ids of one place must fit into a task."""
    axes = AXES[:dims]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / block).cast("int")), lambda k: F.slice("ids", k * block + 1, block))
    ids = lambda p: places(p, axes, ids=F.collect_list(F.struct("id"))["id"]).select(*axes, F.explode(blocks).alias("ids"))
    near = meet(ids(points), ids(others if others is not None else points).withColumnRenamed("ids", "others"), radius, axes)
    near = near.select("ids", "others", "d2").repartition(F.xxhash64("ids", "others"))
    both = near.select(F.explode("ids").alias("id"), "others", "d2").select("id", F.explode("others").alias("other"), "d2")
    return both.filter("id <> other") if others is None else both


def by_reach(points: DataFrame, find: Callable[[DataFrame, float], DataFrame], reach: float) -> DataFrame:
    """What find gives for points (id) within a reach: first within an eighth of it, then for those with nothing there within all of it."""
    near = find(points, reach / 8)
    return near.union(find(points.join(near.select("id"), "id", "left_anti"), reach))


def nearest(points: DataFrame, others: DataFrame, radius: float, dims: int = 3) -> DataFrame:
    """Nearest other of each point within a radius; the least id of equals. Points at one place are looked up once, and of others at one place the least id is met."""
    axes = AXES[:dims]
    others = places(others, axes, other=F.min("id")).drop("id")
    find = lambda p, r: meet(p, others, r, axes).groupBy("id").agg(F.min_by("other", F.struct("d2", "other")).alias("other"), F.min("d2").alias("d2"))
    near = by_reach(places(points, axes), find, radius).withColumnRenamed("id", "_place")
    found = points.select("id", F.struct(*axes).alias("_place")).join(near, "_place")
    return found.groupBy("id").agg(F.min_by("other", F.struct("d2", "other")).alias("other"), F.min("d2").alias("d2"))


def hausdorff(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Sampled symmetric distance of two point sets, null if one is empty. Places are looked up within an eighth of the radius; those with nothing there again and again within twice as much."""
    a, b = (settled(places(p.filter(reduce(and_, map(finite, AXES))), AXES)) for p in (a, b))
    both = [d for d in (a, b) if not d.isEmpty()]
    found = [farthest(p, q, radius / 8) for p, q in (both, both[::-1])] if len(both) == 2 else [a.select(F.lit(None).cast("double").alias("d2")).limit(0)]
    return reduce(DataFrame.union, found).agg(F.sqrt(F.max("d2")).alias("distance"))


def farthest(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """The greatest d2 of points (id, x, y, z) to their nearest others, as rows of d2 a pass; there must be others, and all must be finite."""
    out = None
    while True:
        near = settled(meet(points, others.drop("id"), radius, AXES).groupBy("id").agg(F.min("d2").alias("d2")))
        most = near.agg(F.max("d2").alias("d2"))
        out = most if out is None else out.union(most)
        points, radius = points.join(near.select("id"), "id", "left_anti"), radius * 2
        if points.isEmpty():
            return out


def ray_hits(rays: DataFrame, triangles: DataFrame) -> DataFrame:
    """Nearest hit (ray, cid, t) of rays (ray, ox, oy, oz, dx, dy, dz) on triangles with corner columns. The triangles of one mesh are the smaller side."""
    p, d = [F.col("o" + a) - F.col(a + "0") for a in AXES], [F.col("d" + a) for a in AXES]
    e1, e2 = edge(0, 1), edge(0, 2)
    h = cross(d, e2)
    det = dot(e1, h)
    q = cross(p, e1)
    u, v, t = (F.try_divide(x, det) for x in (dot(p, h), dot(d, q), dot(e2, q)))
    hit = rays.join(triangles, (F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0))
    return hit.withColumn("t", t).groupBy("ray").agg(F.min_by("cid", F.struct("t", "cid")).alias("cid"), F.min("t").alias("t"))


def assemble(triplets: DataFrame) -> DataFrame:
    """Sparse matrix from (row, col, value), duplicates summed."""
    return triplets.groupBy("row", "col").agg(F.sum("value").alias("value"))


def stiffness(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Cotangent stiffness of a triangle mesh, assembled."""
    c = corners(cells, vertices, 3)
    double = norm(cross(edge(0, 1), edge(0, 2)))
    c = c.filter(double > 0)  # degenerate triangles have no stiffness
    cot = [F.try_divide(dot(edge(k, (k + 1) % 3), edge(k, (k + 2) % 3)), double) / 2 for k in range(3)]
    parts = []
    for k in range(3):
        i, j = F.col("corner")[(k + 1) % 3], F.col("corner")[(k + 2) % 3]
        parts += [F.struct(a.alias("row"), b.alias("col"), (s * cot[k]).alias("value")) for a, b, s in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1))]
    return assemble(c.select(F.explode(F.array(*parts)).alias("e")).select("e.*"))


def mass(cells: DataFrame, vertices: DataFrame, lumped: bool = True) -> DataFrame:
    """Mass matrix of a triangle mesh: a third of each area at its corners, or the full element matrix."""
    c = corners(cells, vertices, 3).withColumn("_a", norm(cross(edge(0, 1), edge(0, 2))) / 2)
    pairs = [(i, j) for i in range(3) for j in range(3) if i == j or not lumped]
    share = lambda i, j: 1 / 3 if lumped else (1 / 6 if i == j else 1 / 12)
    parts = [F.struct(F.col("corner")[i].alias("row"), F.col("corner")[j].alias("col"), (F.col("_a") * share(i, j)).alias("value")) for i, j in pairs]
    return assemble(c.select(F.explode(F.array(*parts)).alias("e")).select("e.*"))


def element_gradients(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Gradient of a linear field (vertices with column f) in each triangle of the plane."""
    c = cells
    for k in range(3):
        c = c.withColumn("_v", F.col("corner")[k]).join(vertices.select(F.col("vid").alias("_v"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), F.col("f").alias(f"f{k}")), "_v").drop("_v")
    det = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    a, b = F.col("f1") - F.col("f0"), F.col("f2") - F.col("f0")
    gx = F.try_divide(a * (F.col("y2") - F.col("y0")) - b * (F.col("y1") - F.col("y0")), det)
    gy = F.try_divide(b * (F.col("x1") - F.col("x0")) - a * (F.col("x2") - F.col("x0")), det)
    return c.select("cid", gx.alias("gx"), gy.alias("gy"))


def solve_dirichlet(matrix: DataFrame, fixed: DataFrame, load: DataFrame | None = None, rounds: int = 2000, close: float = 1e-10) -> pd.DataFrame:
    """Values (row, value) with fixed ones (row, value) given: conjugate gradients on the driver over one mesh's assembled matrix."""
    m, f = matrix.toPandas(), fixed.toPandas().set_index("row")["value"]
    ids = np.unique(m["row"])
    i, j, v = np.searchsorted(ids, m["row"]), np.searchsorted(ids, m["col"]), m["value"].to_numpy()
    b = np.zeros(len(ids))
    if load is not None:
        got = load.toPandas()
        b[np.searchsorted(ids, got["row"])] = got["value"]
    x, free = np.zeros(len(ids)), ~np.isin(ids, f.index)
    x[~free] = f.reindex(ids[~free]).to_numpy()
    times = lambda y: np.bincount(i, v * y[j], len(ids))
    r = np.where(free, b - times(x), 0.0)
    p, rr = r.copy(), r @ r
    for _ in range(rounds):
        if rr < close * close:
            break
        q = np.where(free, times(p), 0.0)
        a = rr / (p @ q)
        x, r = x + a * p, r - a * q
        p, rr = r + (r @ r) / rr * p, r @ r
    return pd.DataFrame({"row": ids, "value": x})


def solve_heat(stiff: DataFrame, masses: DataFrame, start: dict[int, float], dt: float, steps: int) -> pd.DataFrame:
    """Backward Euler with one factorisation, on the driver over one mesh."""
    m, s = masses.toPandas(), stiff.toPandas()
    ids = np.unique(s["row"])
    a, k = np.zeros((len(ids),) * 2), np.zeros((len(ids),) * 2)
    np.add.at(k, (np.searchsorted(ids, s["row"]), np.searchsorted(ids, s["col"])), s["value"])
    np.add.at(a, (np.searchsorted(ids, m["row"]), np.searchsorted(ids, m["col"])), m["value"])
    inverse = np.linalg.inv(a + dt * k)
    u = np.array([start.get(int(i), 0.0) for i in ids])
    for _ in range(steps):
        u = inverse @ (a @ u)
    return pd.DataFrame({"row": ids, "value": u})


def eigenmodes(stiff: DataFrame, masses: DataFrame, k: int) -> np.ndarray:
    """Smallest k eigenvalues of a small mesh's Laplacian with lumped masses."""
    s, m = stiff.toPandas(), masses.toPandas()
    ids = np.unique(s["row"])
    a = np.zeros((len(ids),) * 2)
    np.add.at(a, (np.searchsorted(ids, s["row"]), np.searchsorted(ids, s["col"])), s["value"])
    w = np.zeros(len(ids))
    np.add.at(w, np.searchsorted(ids, m["row"]), m["value"])
    return np.linalg.eigvalsh(a / np.sqrt(np.outer(w, w)))[:k]


def gaussian_curvature(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Angle defect of interior vertices; null at the boundary."""
    c = corners(cells, vertices, 3)
    each = c.select(F.explode(F.array(*(F.struct(F.col("corner")[k].alias("vid"), angle(k).alias("a")) for k in range(3)))).alias("e")).groupBy("e.vid").agg(F.sum("e.a").alias("a"))
    rim = boundary_vertices(cells).withColumn("rim", F.lit(True))
    return each.join(rim, "vid", "left").select("vid", F.when(F.col("rim").isNull(), F.lit(2 * np.pi) - F.col("a")).alias("curvature"))


def winding_numbers(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Generalised winding number of points (id, px, py, pz) in a mesh of triangles with corner columns, by solid angles; summed by point before the shuffle."""
    v = [[F.col(f"{a}{k}") - F.col("p" + a) for a in AXES] for k in range(3)]
    la, lb, lc = (norm(x) for x in v)
    top = dot(v[0], cross(v[1], v[2]))
    low = la * lb * lc + dot(v[0], v[1]) * lc + dot(v[1], v[2]) * la + dot(v[2], v[0]) * lb
    pairs = points.join(triangles, F.lit(True))
    return pairs.select("id", (2 * F.atan2(top, low)).alias("w")).groupBy("id").agg((F.sum("w") / (4 * np.pi)).alias("winding"))


# --- polygons with integer points, as arrays of struct<x, y> ----------------------------------------------------------


def ring_sum(ring: str, f) -> Column:
    r = F.col(ring)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: f(r[i], r[(i + 1) % F.size(r)])), F.lit(0.0), lambda a, x: a + x)


def signed_area(ring: str) -> Column:
    return ring_sum(ring, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]) / 2)


def perimeter(ring: str) -> Column:
    return ring_sum(ring, lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))


def orient(a, b, c) -> Column:
    """Exact sign of the turn a, b, c of integer points, in decimals."""
    d = lambda x: x.cast("decimal(18,0)")
    return F.signum(((d(b["x"]) - d(a["x"])) * (d(c["y"]) - d(a["y"])) - (d(b["y"]) - d(a["y"])) * (d(c["x"]) - d(a["x"]))).cast("double"))


def on_segment(p, a, b) -> Column:
    between = lambda k: p[k].between(F.least(a[k], b[k]), F.greatest(a[k], b[k]))
    return (orient(a, b, p) == 0) & between("x") & between("y")


def segments_intersect(a, b, c, d) -> Column:
    proper = (orient(a, b, c) * orient(a, b, d) < 0) & (orient(c, d, a) * orient(c, d, b) < 0)
    return proper | on_segment(c, a, b) | on_segment(d, a, b) | on_segment(a, c, d) | on_segment(b, c, d)


def locate(ring: str, p) -> Column:
    """inside, boundary or outside of a ring."""
    r = F.col(ring)
    pairs = F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.struct(r[i].alias("a"), r[(i + 1) % F.size(r)].alias("b")))
    rim = F.exists(pairs, lambda e: on_segment(p, e["a"], e["b"]))
    crossing = lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & ((orient(e["a"], e["b"], p) > 0) == (e["b"]["y"] > e["a"]["y"]))
    odd = F.size(F.filter(pairs, crossing)) % 2 == 1
    return F.when(rim, "boundary").when(odd, "inside").otherwise("outside")


def in_circle(points: DataFrame) -> DataFrame:
    """Exact sign of d against the circle through a, b, c (counter-clockwise), columns ax, ay, ..., dy; Python integers."""

    @F.pandas_udf("int")
    def sign(f: pd.DataFrame) -> pd.Series:
        out = []
        for ax, ay, bx, by, cx, cy, dx, dy in f.itertuples(index=False):
            m = [(int(x - dx), int(y - dy)) for x, y in ((ax, ay), (bx, by), (cx, cy))]
            (a, b), (c, d), (e, g) = m
            v = (a * a + b * b) * (c * g - d * e) - (c * c + d * d) * (a * g - b * e) + (e * e + g * g) * (a * d - b * c)
            out.append((v > 0) - (v < 0))
        return pd.Series(out)

    return points.withColumn("sign", sign(F.struct("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")))


def is_simple(ring: Sequence[tuple[int, int]]) -> bool:
    """No two edges of a ring meet but neighbours at their common point."""
    n = len(ring)
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    sgn = lambda v: (v > 0) - (v < 0)
    on = lambda p, a, b: turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    if n < 3 or len(set(ring)) < n:
        return False
    for i in range(n):
        a, b = ring[i], ring[(i + 1) % n]
        if on(ring[(i + 2) % n], a, b) or on(a, b, ring[(i + 2) % n]):
            return False
        for j in range(i + 2, n if i else n - 1):
            c, d = ring[j], ring[(j + 1) % n]
            if sgn(turn(a, b, c)) * sgn(turn(a, b, d)) < 0 and sgn(turn(c, d, a)) * sgn(turn(c, d, b)) < 0 or on(c, a, b) or on(d, a, b) or on(a, c, d) or on(b, c, d):
                return False
    return True


def cleaned(ring: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without repeated and collinear points."""
    pts = list(ring)
    k = 0
    while len(pts) > 2 and k < len(pts):
        a, b, c = pts[k - 1], pts[k], pts[(k + 1) % len(pts)]
        if b == c or (b[0] - a[0]) * (c[1] - a[1]) == (b[1] - a[1]) * (c[0] - a[0]):
            pts.pop(k)
            k = max(0, k - 1)
        else:
            k += 1
    return pts if len(pts) > 2 else []


def triangulate(ring: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Ear clipping of a simple ring; indexes of the triangles' corners."""
    ids = list(range(len(ring)))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in ids) < 0:
        ids.reverse()
    out = []
    while len(ids) > 3:
        for k in range(len(ids)):
            a, b, c = (ring[ids[(k + d) % len(ids)]] for d in (-1, 0, 1))
            if turn(a, b, c) > 0 and not any(turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in (ring[i] for i in ids) if p not in (a, b, c)):
                out.append((ids[k - 1], ids[k], ids[(k + 1) % len(ids)]))
                ids.pop(k)
                break
        else:
            raise ValueError("the ring isn't simple")
    return [*out, tuple(ids)]


def delaunay(points: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Delaunay triangles of integer points by exact incremental insertion (cavities by in-circle tests)."""
    pts = [(Fraction(x), Fraction(y)) for x, y in points]
    big = max((abs(c) for p in pts for c in p), default=1) * 1000 + 1000
    pts += [(-3 * big, -big), (3 * big, -big), (Fraction(0), 3 * big)]
    n = len(points)

    def inside(t, p):
        m = [(pts[i][0] - p[0], pts[i][1] - p[1]) for i in t]
        (a, b), (c, d), (e, g) = m
        return (a * a + b * b) * (c * g - d * e) - (c * c + d * d) * (a * g - b * e) + (e * e + g * g) * (a * d - b * c) > 0

    found = {(n, n + 1, n + 2)}
    seen: set = set()
    for k in range(n):
        if pts[k] in seen:
            continue
        seen.add(pts[k])
        bad = [t for t in found if inside(t, pts[k])]
        rim: dict = {}
        for t in bad:
            for i in range(3):
                rim[t[i], t[(i + 1) % 3]] = True
        found.difference_update(bad)
        for a, b in rim:
            if (b, a) not in rim:
                found.add((a, b, k))
    return sorted(t for t in found if max(t) < n)


def convex_hull(points: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    pts = sorted(set(points))
    out: list = []
    for seq in (pts, pts[::-1]):
        part: list = []
        for p in seq:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]):
                part.pop()
            part.append(p)
        out += part[:-1]
    return out


def minkowski_sum(a: Sequence[tuple[int, int]], b: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sum of two convex polygons."""
    return convex_hull([(p[0] + q[0], p[1] + q[1]) for p in a for q in b])


def cells_of(rings: Sequence[Sequence[tuple[int, int]]]) -> set[tuple[int, int]]:
    """Unit cells of a rectilinear polygon with integer corners, holes by the even-odd rule."""
    out: set = set()
    for ring in rings:
        ups: dict = {}
        for (x, y), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
            if x == x1:
                for k in range(min(y, y1), max(y, y1)):
                    ups.setdefault(k, []).append(x)
        for y, xs in ups.items():
            xs.sort()
            out ^= {(x, y) for a, b in zip(xs[::2], xs[1::2]) for x in range(a, b)}
    return out


def boolean(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """union, intersection, subtract or xor of polygons as tables of unit cells (x, y): set operations of the engine."""
    a, b = a.select("x", "y").distinct(), b.select("x", "y").distinct()
    return {"union": lambda: a.union(b).distinct(), "intersection": lambda: a.intersect(b), "subtract": lambda: a.subtract(b), "xor": lambda: a.subtract(b).union(b.subtract(a))}[op]()
