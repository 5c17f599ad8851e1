"""Further mesh and polygon operators: orientation, curvature, geodesics, cuts of tetrahedra, nesting, offsets, culling.

What walks a mesh from face to face or vertex to vertex is sequential: a mesh (column mesh_id) is one group.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G

AXES = ("x", "y", "z")


def oriented(cells: DataFrame) -> DataFrame:
    """Triangles (mesh_id, cid, corner) with one winding in each connected piece, that of its least cid; a mesh is one group."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        tri = {c: list(t) for c, t in zip(f["cid"], f["corner"])}
        by_edge: dict = {}
        for c, t in tri.items():
            for i in range(3):
                by_edge.setdefault(frozenset((t[i], t[(i + 1) % 3])), []).append(c)
        done: set = set()
        for start in sorted(tri):
            if start in done:
                continue
            done.add(start)
            queue = deque([start])
            while queue:
                c = queue.popleft()
                t = tri[c]
                for i in range(3):
                    a, b = t[i], t[(i + 1) % 3]
                    for o in by_edge[frozenset((a, b))]:
                        if o not in done:
                            u = tri[o]
                            if any(u[k] == a and u[(k + 1) % 3] == b for k in range(3)):
                                tri[o] = [u[0], u[2], u[1]]
                            done.add(o)
                            queue.append(o)
        return pd.DataFrame({"mesh_id": f["mesh_id"].iloc[0], "cid": list(tri), "corner": list(tri.values())})

    return cells.select("mesh_id", "cid", "corner").groupBy("mesh_id").applyInPandas(one, "mesh_id string, cid long, corner array<long>")


def mesh_volume(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Signed volume of a closed mesh: positive if its faces wind outwards."""
    c = G.corners(cells, vertices, 3)
    p = [tuple(F.col(f"{a}{k}") for a in AXES) for k in range(3)]
    return c.agg((F.sum(G.dot(p[0], G.cross(p[1], p[2]))) / 6).alias("volume"))


def mean_curvature(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Half the length of the cotangent Laplacian of position by lumped area; null at the boundary."""
    k = G.stiffness(cells, vertices).join(vertices.withColumnRenamed("vid", "col"), "col")
    lap = k.groupBy(F.col("row").alias("vid")).agg(*(F.sum(F.col("value") * F.col(a)).alias("l" + a) for a in AXES))
    m = G.mass(cells, vertices).select(F.col("row").alias("vid"), F.col("value").alias("m"))
    rim = G.boundary_vertices(cells).withColumn("rim", F.lit(True))
    h = F.try_divide(F.sqrt(F.col("lx") ** 2 + F.col("ly") ** 2 + F.col("lz") ** 2), 2 * F.col("m"))
    return lap.join(m, "vid").join(rim, "vid", "left").select("vid", F.when(F.col("rim").isNull(), h).alias("curvature"))


def edge_distance(cells: DataFrame, vertices: DataFrame, sources: Sequence[int]) -> DataFrame:
    """Shortest distance along edges of each vertex from sources, in one group for a mesh: an upper bound of the geodesic distance."""
    e = G.edges(cells)
    ends = vertices.select(F.col("vid").alias("a"), *(F.col(c).alias(c + "0") for c in AXES)), vertices.select(F.col("vid").alias("b"), *(F.col(c).alias(c + "1") for c in AXES))
    long = e.join(ends[0], "a").join(ends[1], "b").select("a", "b", G.norm(G.edge(0, 1)).alias("w")).withColumn("_k", F.lit(1))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, w in f[["a", "b", "w"]].itertuples(index=False):
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
        best = {int(s): 0.0 for s in sources}
        heap = [(0.0, int(s)) for s in sources]
        while heap:
            d, v = heapq.heappop(heap)
            if d > best[v]:
                continue
            for u, w in near.get(v, ()):
                if d + w < best.get(u, math.inf):
                    best[u] = d + w
                    heapq.heappush(heap, (d + w, u))
        return pd.DataFrame({"vid": list(best), "distance": list(best.values())})

    return long.groupBy("_k").applyInPandas(one, "vid long, distance double")


def tet_isosurface(cells: DataFrame, vertices: DataFrame, iso: float) -> DataFrame:
    """Triangles (cid, part, corner array of points) where a field f on vertices of tetrahedra equals a value."""
    c = cells
    for k in range(4):
        c = c.withColumn("_v", F.col("corner")[k]).join(vertices.select(F.col("vid").alias("_v"), F.struct("x", "y", "z", "f").alias(f"p{k}")), "_v").drop("_v")
    spans = (F.least(*(F.col(f"p{k}.f") for k in range(4))) <= iso) & (F.greatest(*(F.col(f"p{k}.f") for k in range(4))) > iso)
    flat = c.filter(spans).select("cid", *(F.col(f"p{k}.{a}").alias(f"{a}{k}") for k in range(4) for a in ("x", "y", "z", "f")))

    def cut(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                a = np.array(r[1:], float).reshape(4, 4)
                hi, lo = np.nonzero(a[:, 3] > iso)[0], np.nonzero(a[:, 3] <= iso)[0]
                on = lambda i, j: (a[i, :3] + (a[j, :3] - a[i, :3]) * (iso - a[i, 3]) / (a[j, 3] - a[i, 3])).tolist()
                if len(hi) == 2:
                    q = [on(hi[0], lo[0]), on(hi[0], lo[1]), on(hi[1], lo[1]), on(hi[1], lo[0])]
                    tris = [[q[0], q[1], q[2]], [q[0], q[2], q[3]]]
                else:
                    one, rest = (hi, lo) if len(hi) == 1 else (lo, hi)
                    tris = [[on(one[0], k) for k in rest]]
                rows += [(r[0], k, t) for k, t in enumerate(tris)]
            yield pd.DataFrame(rows, columns=["cid", "part", "corner"])

    return flat.mapInPandas(cut, "cid long, part int, corner array<array<double>>")


def slice_tets(cells: DataFrame, vertices: DataFrame, plane: Sequence[float]) -> DataFrame:
    """Cut of tetrahedra by a plane (a, b, c, d)."""
    return tet_isosurface(cells, vertices.withColumn("f", sum((plane[i] * F.col(a) for i, a in enumerate(AXES)), F.lit(float(plane[3])))), 0.0)


def nested(rings: DataFrame) -> DataFrame:
    """(poly_id, parent): the smallest ring that holds each ring's first point strictly, null for outer ones; candidates meet by bounding box."""
    r = rings.select("poly_id", "ring", F.abs(G.signed_area("ring")).alias("area"), *(f(F.transform("ring", lambda p: p[a])).alias(n + a) for n, f in (("lo", F.array_min), ("hi", F.array_max)) for a in "xy"))
    inner = r.select(F.col("poly_id").alias("id"), F.col("ring")[0].alias("p"), F.col("area").alias("own"))
    box = (F.col("p.x").between(F.col("lox"), F.col("hix"))) & (F.col("p.y").between(F.col("loy"), F.col("hiy"))) & (F.col("id") != F.col("poly_id")) & (F.col("area") > F.col("own"))
    hit = inner.join(r, box).filter(G.locate("ring", F.col("p")) == "inside").groupBy("id").agg(F.min_by("poly_id", F.struct("area", "poly_id")).alias("parent"))
    return rings.select("poly_id").join(hit, F.col("poly_id") == F.col("id"), "left").select("poly_id", "parent")


def normal_form(ring: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Counter-clockwise from the least point, without repeated and collinear points."""
    pts = G.cleaned(ring)
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, [*pts[1:], *pts[:1]])) < 0:
        pts.reverse()
    k = pts.index(min(pts)) if pts else 0
    return pts[k:] + pts[:k]


def offset_convex(ring: Sequence[tuple[int, int]], radius: int, sides: int = 8) -> list[tuple[int, int]]:
    """A convex polygon grown by a regular polygon of a radius (points rounded to the grid)."""
    disc = [(round(radius * math.cos(2 * math.pi * k / sides)), round(radius * math.sin(2 * math.pi * k / sides))) for k in range(sides)]
    return G.minkowski_sum(ring, disc)


def convex_pieces(ring: Sequence[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Convex polygons that make up a simple ring: triangles merged over shared edges while they stay convex."""
    pieces = [[ring[i] for i in t] for t in G.triangulate(ring)]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    convex = lambda p: all(turn(p[i - 2], p[i - 1], p[i]) >= 0 for i in range(len(p)))
    merged = True
    while merged:
        merged = False
        for i in range(len(pieces)):
            for j in range(i):
                p, q = pieces[i], pieces[j]
                for k in range(len(p)):
                    a, b = p[k], p[(k + 1) % len(p)]
                    if a in q and b in q and q[(q.index(b) + 1) % len(q)] == a:
                        m = q.index(a)
                        joined = p[(k + 1) % len(p) :] + p[: (k + 1) % len(p)]
                        joined = joined[:-1] + q[m:] + q[:m]
                        joined = joined[:-1] if joined[-1] == joined[0] else joined
                        if len(set(joined)) == len(joined) and convex(joined):
                            pieces[i] = joined
                            pieces.pop(j)
                            merged = True
                            break
                if merged:
                    break
            if merged:
                break
    return pieces


def sibson(points: Sequence[tuple[float, float]], at: tuple[float, float], n: int = 200) -> dict[int, float]:
    """Natural-neighbour weights of a point: shares of its Voronoi cell that it takes from each site, by a fine grid around it; they add up to 1."""
    p = np.array(points, float)
    reach = np.sqrt(((p - at) ** 2).sum(1)).min() * 2 + np.ptp(p, axis=0).max() / 4
    s = (np.arange(n) + 0.5) / n * 2 * reach - reach
    x, y = np.meshgrid(at[0] + s, at[1] + s)
    q = np.stack([x.ravel(), y.ravel()], 1)
    d = ((q[:, None, :] - p[None]) ** 2).sum(2)
    own = ((q - at) ** 2).sum(1) < d.min(1)
    owner = d[own].argmin(1)
    return {int(k): float(v) / len(owner) for k, v in zip(*np.unique(owner, return_counts=True))}


def culled(proxies: DataFrame, planes: Sequence[Sequence[float]], eye: Sequence[float], far: float) -> DataFrame:
    """Proxies (x, y, z, r) whose sphere is on the inner side of all planes and within a distance of the eye."""
    keep: Column = F.sqrt(sum(((F.col(a) - eye[i]) * (F.col(a) - eye[i]) for i, a in enumerate(AXES)), F.lit(0.0))) - F.col("r") <= far
    for p in planes:
        keep = keep & (p[0] * F.col("x") + p[1] * F.col("y") + p[2] * F.col("z") + p[3] >= -F.col("r"))
    return proxies.filter(keep)


def distance_to_segments(points: DataFrame, segments: DataFrame, reach: float, size: float | None = None) -> DataFrame:
    """(id, seg, d): nearest segment (seg, x0, y0, x1, y1) of each point (id, x, y) within reach; segments go to the grid cells of
    their grown boxes. Points at one place are looked up once, and of equal segments the least is met."""
    size = size or reach
    cell = lambda c: F.floor(c / size).cast("long")
    s = segments.groupBy("x0", "y0", "x1", "y1").agg(F.min("seg").alias("seg"))
    for a in "xy":
        s = s.withColumn("c" + a, F.explode(F.sequence(cell(F.least(a + "0", a + "1") - reach), cell(F.greatest(a + "0", a + "1") + reach))))
    p = G.places(points, ("x", "y")).withColumns({"c" + a: cell(F.col(a)) for a in "xy"}).join(s, ["cx", "cy"])
    ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size2 = ex * ex + ey * ey
    t = F.when(size2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * ex + (F.col("y") - F.col("y0")) * ey) / size2))).otherwise(F.lit(0.0))
    d = F.sqrt(F.pow(F.col("x0") + t * ex - F.col("x"), 2) + F.pow(F.col("y0") + t * ey - F.col("y"), 2))
    near = p.withColumn("d", d).filter(F.col("d") <= reach).groupBy(F.col("id").alias("_place")).agg(F.min_by("seg", F.struct("d", "seg")).alias("seg"), F.min("d").alias("d"))
    found = points.select("id", F.struct("x", "y").alias("_place")).join(near, "_place")
    return found.groupBy("id").agg(F.min_by("seg", F.struct("d", "seg")).alias("seg"), F.min("d").alias("d"))
