"""Contour trees, spectra, isosurfaces and seeded segmentation of volumes.

Sweeps over globally sorted values are sequential, so a whole volume is one group of applyInPandas; cell-local operators
(spectra, isosurfaces) split each cell into tetrahedra and stay in DataFrame expressions.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The 14 neighbours of a voxel in the grid split into tetrahedra along its diagonals.
STENCIL = [o for o in ((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)) if any(o) and (min(o) >= 0 or max(o) <= 0)]
#: Corners of the six tetrahedra of a cell: paths from its first to its last corner along the axes.
TETS = [((0, 0, 0), a, b, (1, 1, 1)) for a, b in (((1, 0, 0), (1, 1, 0)), ((1, 0, 0), (1, 0, 1)), ((0, 1, 0), (1, 1, 0)), ((0, 1, 0), (0, 1, 1)), ((0, 0, 1), (1, 0, 1)), ((0, 0, 1), (0, 1, 1)))]


def merge_tree(values: np.ndarray, neighbours, descending: bool) -> np.ndarray:
    """For each vertex the next vertex of the join (descending) or split tree towards its root, -1 at the root."""
    n = len(values)
    order = np.lexsort((np.arange(n), values))
    order = order[::-1] if descending else order
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    top, parent, lowest, out = np.arange(n), np.arange(n), np.arange(n), np.full(n, -1)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    del top
    for v in order.tolist():
        for u in neighbours(v):
            if rank[u] < rank[v]:
                r = find(u)
                if r != find(v):
                    out[lowest[r]] = v
                    parent[r] = find(v)
                    lowest[find(v)] = v
    return out


def contour_tree(values: np.ndarray, neighbours) -> list[tuple[int, int]]:
    """Augmented contour tree by the leaf rule: arcs (higher, lower) over all vertices."""
    if np.isnan(values).any():
        raise ValueError("NaN in the field")
    join, split = merge_tree(values, neighbours, True), merge_tree(values, neighbours, False)
    n = len(values)
    up, down = [set() for _ in range(n)], [set() for _ in range(n)]  # children in each tree
    for v in range(n):
        if join[v] >= 0:
            up[join[v]].add(v)
        if split[v] >= 0:
            down[split[v]].add(v)
    queue = [v for v in range(n) if len(up[v]) + len(down[v]) == 1]
    arcs, gone = [], [False] * n

    def remove(v, tree, kids):
        p, c = tree[v], next(iter(kids[v]), None)
        if p >= 0:
            kids[p].discard(v)
        if c is not None:
            tree[c] = p
            if p >= 0:
                kids[p].add(c)
        kids[v].clear()

    while queue:
        v = queue.pop()
        if gone[v] or len(up[v]) + len(down[v]) != 1:
            continue
        high = not up[v]  # a leaf of the join tree
        other = (join if high else split)[v]
        if other < 0:
            continue
        arcs.append((v, int(other)) if high else (int(other), v))
        gone[v] = True
        remove(v, join, up)
        remove(v, split, down)
        if len(up[other]) + len(down[other]) == 1:
            queue.append(int(other))
    return arcs


def reduced(arcs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Arcs between critical vertices: regular ones, with one arc up and one down, are passed through."""
    above, below = {}, {}
    for hi, lo in arcs:
        below.setdefault(hi, []).append(lo)
        above.setdefault(lo, []).append(hi)
    regular = lambda v: len(above.get(v, ())) == 1 and len(below.get(v, ())) == 1
    out = []
    for hi, los in below.items():
        if not regular(hi):
            for lo in los:
                while regular(lo):
                    lo = below[lo][0]
                out.append((hi, lo))
    return sorted(out)


def simplified(arcs: Sequence[tuple[int, int]], values: np.ndarray, persistence: float) -> list[tuple[int, int]]:
    """Reduced tree without leaf arcs shorter than a share of the value range, shortest first."""
    arcs, least = list(arcs), persistence * (values.max() - values.min())
    while len(arcs) > 1:
        degree: dict = {}
        for a in arcs:
            for v in a:
                degree[v] = degree.get(v, 0) + 1
        leaves = [(values[h] - values[l], h, l) for h, l in arcs if min(degree[h], degree[l]) == 1 and max(degree[h], degree[l]) > 2]
        if not leaves or min(leaves)[0] >= least:
            return sorted(arcs)
        _, h, l = min(leaves)
        arcs.remove((h, l))
        arcs = reduced(arcs)
    return arcs


def grid_neighbours(dims: Sequence[int]):
    nx, ny, nz = dims

    def of(i):
        x, y, z = i % nx, i // nx % ny, i // (nx * ny)
        return [(x + a) + (y + b) * nx + (z + c) * nx * ny for a, b, c in STENCIL if 0 <= x + a < nx and 0 <= y + b < ny and 0 <= z + c < nz]

    return of


def dense(f: pd.DataFrame, dims: Sequence[int]) -> np.ndarray:
    out = np.full(dims[0] * dims[1] * dims[2], np.nan)
    out[(f["x"] + f["y"] * dims[0] + f["z"] * dims[0] * dims[1]).to_numpy()] = f["value"].to_numpy()
    return out


def contour_trees(v: DataFrame, dims: Sequence[int], persistence: float = 0.0) -> DataFrame:
    """vol_id, hi, lo and their values: the reduced contour tree of each volume; a volume is one group."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        values = dense(f, dims)
        arcs = reduced(contour_tree(values, grid_neighbours(dims)))
        if persistence:
            arcs = simplified(arcs, values, persistence)
        return pd.DataFrame([(f["vol_id"].iloc[0], h, l, values[h], values[l]) for h, l in arcs], columns=["vol_id", "hi", "lo", "hi_value", "lo_value"])

    return v.groupBy("vol_id").applyInPandas(one, "vol_id string, hi long, lo long, hi_value double, lo_value double")


def components_at(arcs: DataFrame, w: float) -> DataFrame:
    """Number of contours at a value: arcs that span it."""
    return arcs.agg(F.count_if((F.col("lo_value") <= w) & (F.col("hi_value") > w)).alias("components"))


def tetrahedra(v: DataFrame) -> DataFrame:
    """The six tetrahedra of each full cell: x, y, z, tet, values v0..v3. Values are sent to the cells that they are a corner of, and pivoted by one aggregation."""
    corner = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    sent = v.select("value", F.explode(F.array(*(F.struct((F.col("x") - a).alias("x"), (F.col("y") - b).alias("y"), (F.col("z") - c).alias("z"), F.lit(k).alias("k")) for k, (a, b, c) in enumerate(corner)))).alias("o"))
    cell = sent.groupBy("o.x", "o.y", "o.z").agg(*(F.max(F.when(F.col("o.k") == k, F.col("value"))).alias(f"c{k}") for k in range(8)))
    for k in range(8):
        cell = cell.filter(F.col(f"c{k}").isNotNull() & ~F.isnan(f"c{k}") & (F.abs(f"c{k}") != float("inf")))
    tet = F.array(*(F.struct(*(F.col(f"c{corner.index(p)}").alias(f"v{i}") for i, p in enumerate(t))) for t in TETS))
    return cell.select("x", "y", "z", F.posexplode(tet).alias("tet", "t")).select("x", "y", "z", "tet", "t.*")


def contour_spectrum(v: DataFrame, dims: Sequence[int], n: int) -> DataFrame:
    """isovalue, volume above it, area and gradient of its contour, at n values over the range: each tetrahedron adds to the isovalues that it spans."""
    ends = v.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    t = tetrahedra(v)
    s = F.array_sort(F.array("v0", "v1", "v2", "v3"))
    at = t.select("tet", *(s[k].alias(f"s{k}") for k in range(4)), *(F.col(f"v{k}") for k in range(4))).crossJoin(F.broadcast(ends))  # one row
    iso = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (n - 1)
    at = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("iso", iso)
    w = F.col("iso")
    s0, s1, s2, s3 = (F.col(f"s{k}") for k in range(4))
    cube = lambda a: F.pow(a, 3)
    above = F.when(w <= s0, 1.0).when(w >= s3, 0.0).when(w <= s1, 1 - cube(w - s0) / ((s1 - s0) * (s2 - s0) * (s3 - s0))).when(w >= s2, cube(s3 - w) / ((s3 - s0) * (s3 - s1) * (s3 - s2)))
    above = above.otherwise(F.pow(s3 - w, 2) / ((s3 - s0) * (s3 - s1)) + (s3 - w) * (w - s1) * (s2 - w) / ((s3 - s0) * (s3 - s1) * (s2 - s1)) + F.pow(s2 - w, 2) * (w - s0) / ((s3 - s0) * (s2 - s0) * (s2 - s1)))
    g = F.sqrt(F.pow(F.col("v1") - F.col("v0"), 2) + F.pow(F.col("v2") - F.col("v1"), 2) + F.pow(F.col("v3") - F.col("v2"), 2))  # along the tetrahedron's path of axes
    # area by the co-area formula: the volume's derivative times the gradient, the derivative of each piece above
    d = F.when((w <= s0) | (w >= s3), 0.0).when(w <= s1, 3 * F.pow(w - s0, 2) / ((s1 - s0) * (s2 - s0) * (s3 - s0))).when(w >= s2, 3 * F.pow(s3 - w, 2) / ((s3 - s0) * (s3 - s1) * (s3 - s2)))
    p1, p2 = (s3 - s0) * (s3 - s1) * (s2 - s1), (s3 - s0) * (s2 - s0) * (s2 - s1)
    d = d.otherwise(2 * (s3 - w) / ((s3 - s0) * (s3 - s1)) + ((w - s1) * (s2 - w) - (s3 - w) * (s2 - w) + (s3 - w) * (w - s1)) / p1 + (2 * (s2 - w) * (w - s0) - F.pow(s2 - w, 2)) / p2)
    return at.select("k", "iso", (above / 6).alias("a"), (d * g / 6).alias("b"), (d * g * g / 6).alias("c")).groupBy("k").agg(F.first("iso").alias("isovalue"), F.sum("a").alias("volume"), F.sum("b").alias("area"), F.sum("c").alias("gradient")).select("isovalue", "volume", "area", "gradient")


def isosurface(v: DataFrame, iso: float) -> DataFrame:
    """Triangles (x, y, z of the cell, tet, part, corner array of points) of the level set, by marching tetrahedra: a corner above alone gives one triangle, two and two give two."""
    t = tetrahedra(v)

    def cut(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                vals = np.array([r.v0, r.v1, r.v2, r.v3])
                pts = np.array(TETS[r.tet], float) + (r.x, r.y, r.z)
                hi, lo = np.nonzero(vals > iso)[0], np.nonzero(vals <= iso)[0]
                if not len(hi) or not len(lo):
                    continue
                on = lambda a, b: (pts[a] + (pts[b] - pts[a]) * (iso - vals[a]) / (vals[b] - vals[a])).tolist()
                if len(hi) == 2:
                    q = [on(hi[0], lo[0]), on(hi[0], lo[1]), on(hi[1], lo[1]), on(hi[1], lo[0])]
                    tris = [[q[0], q[1], q[2]], [q[0], q[2], q[3]]]
                else:
                    one, rest = (hi, lo) if len(hi) == 1 else (lo, hi)
                    tris = [[on(one[0], k) for k in rest]]
                rows += [(r.x, r.y, r.z, r.tet, k, tri) for k, tri in enumerate(tris)]
            yield pd.DataFrame(rows, columns=["x", "y", "z", "tet", "part", "corner"])

    spans = (F.least("v0", "v1", "v2", "v3") <= iso) & (F.greatest("v0", "v1", "v2", "v3") > iso)
    return t.filter(spans).mapInPandas(cut, "x long, y long, z long, tet int, part int, corner array<array<double>>")


def segment(v: DataFrame, seeds: dict[int, list[tuple[int, int, int]]], slow: float = 1.0) -> DataFrame:
    """Class of each voxel by fast marching from seeds, slowed by the gradient: a volume is one group; ties go to the lesser class, then voxel.

    A voxel that several classes name is the last one's. ValueError without any seed; the run fails with one outside of a volume."""
    if not any(seeds.values()):
        raise ValueError("no seeds")
    owner = {tuple(p): k for k, ps in seeds.items() for p in ps}

    def one(f: pd.DataFrame) -> pd.DataFrame:
        at = {(x, y, z): val for x, y, z, val in f[["x", "y", "z", "value"]].itertuples(index=False)}
        if away := sorted(p for p in owner if p not in at):
            raise ValueError(f"seeds outside of the volume: {away}")
        heap = [(0.0, k, p) for p, k in owner.items()]
        heapq.heapify(heap)
        label: dict = {}
        while heap:
            t, k, p = heapq.heappop(heap)
            if p in label:
                continue
            label[p] = k
            for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                q = (p[0] + d[0], p[1] + d[1], p[2] + d[2])
                if q in at and q not in label:
                    heapq.heappush(heap, (t + 1 + slow * abs(at[q] - at[p]), k, q))
        return pd.DataFrame([(f["vol_id"].iloc[0], *p, k) for p, k in sorted(label.items())], columns=["vol_id", "x", "y", "z", "label"])

    return v.groupBy("vol_id").applyInPandas(one, "vol_id string, x long, y long, z long, label int")


def signed_distance(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Signed distance of grid points (id, px, py, pz) to a closed mesh: exact nearest triangle, sign by winding number; the mesh is held by each task."""
    rows = [np.array([[r[f"{a}{k}"] for a in "xyz"] for k in range(3)], float) for r in triangles.collect()]
    held = points.sparkSession.sparkContext.broadcast(np.array(rows))

    def of(frames):
        for f in frames:
            p = f[["px", "py", "pz"]].to_numpy(float)
            yield pd.DataFrame({"id": f["id"], "sdf": [point_mesh(q, held.value) for q in p]})

    return points.mapInPandas(of, "id long, sdf double")


def point_mesh(p: np.ndarray, tri: np.ndarray) -> float:
    a, b, c = tri[:, 0], tri[:, 1], tri[:, 2]
    dist = np.full(len(tri), np.inf)
    for u, w in ((a, b), (b, c), (c, a)):
        e = w - u
        t = np.clip(((p - u) * e).sum(1) / np.maximum((e * e).sum(1), 1e-300), 0, 1)
        dist = np.minimum(dist, ((u + t[:, None] * e - p) ** 2).sum(1))
    n = np.cross(b - a, c - a)
    size = np.maximum((n * n).sum(1), 1e-300)
    inside = np.ones(len(tri), bool)
    for u, w in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(w - u, p - u) * n).sum(1) >= 0
    h = ((p - a) * n).sum(1) ** 2 / size
    dist = np.where(inside, np.minimum(dist, h), dist)
    x, y, z = a - p, b - p, c - p
    lx, ly, lz = (np.sqrt((v * v).sum(1)) for v in (x, y, z))
    solid = 2 * np.arctan2((x * np.cross(y, z)).sum(1), lx * ly * lz + (x * y).sum(1) * lz + (y * z).sum(1) * lx + (z * x).sum(1) * ly)
    return float(np.sqrt(dist.min()) * (-1 if solid.sum() / (4 * np.pi) > 0.5 else 1))
