"""Levels of detail, tiles and grid search: keys, ladders, budgets, distance transforms, paths."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tile_of(x: Column | str, origin: float, size: float) -> Column:
    return F.floor(((F.col(x) if isinstance(x, str) else x) - origin) / size).cast("long")


def partition_parts(parts: DataFrame, size: float, origin: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """Parts (cx, cy, cz, tris) merged by the tile of their centroid."""
    keys = [tile_of("c" + a, o, size).alias("t" + a) for a, o in zip("xyz", origin)]
    return parts.groupBy(*keys).agg(F.count("*").alias("parts"), F.sum("tris").alias("tris"))


def suffix_group_key(name: Column | str, suffixes: Sequence[str]) -> Column:
    """Name without the first of the suffixes that it ends with."""
    c = F.col(name) if isinstance(name, str) else name
    out = None
    for s in suffixes:
        cut = F.substring(c, F.lit(1), F.length(c) - len(s))
        out = F.when(c.endswith(s), cut) if out is None else out.when(c.endswith(s), cut)
    return c if out is None else out.otherwise(c)


def screen_error_px(error_m: Column, distance_m: Column, height_px: float, fov: float) -> Column:
    """Pixels that a world error covers at a distance."""
    return error_m / F.greatest(distance_m, F.lit(1e-6)) * (height_px / (2 * np.tan(fov / 2)))


def switch_radius_m(error_m: Column, px: float, height_px: float, fov: float) -> Column:
    """Distance at which a world error covers px pixels."""
    return error_m * (height_px / (2 * np.tan(fov / 2))) / px


def priority(area: Column, distance_m: Column) -> Column:
    return area / (1 + F.pow(distance_m / 1000, 2))


def monotone(ladder: DataFrame) -> DataFrame:
    """World errors made not to fall along the rungs of an asset."""
    w = Window.partitionBy("asset").orderBy("rung").rowsBetween(Window.unboundedPreceding, 0)
    return ladder.withColumn("world_error_m", F.max("world_error_m").over(w))


def select_rung(steps: DataFrame, radii: Sequence[float], slack: float = 0.15) -> DataFrame:
    """Hysteretic rung of each asset along its steps (asset, step, distance); ``radii`` are those of rungs 1, 2, ...

    The plain target is the coarsest rung whose radius the distance reaches, the widened one that for radii larger by a share
    of slack. A rung finer than the widened target goes out to it, one coarser than the plain target comes in to it, any
    other is held; the first step takes the plain target. Radii are a running maximum. A fold by asset."""
    r = F.array(*(F.lit(float(x)) for x in np.maximum.accumulate(np.array(radii, float))))
    log = F.array_sort(F.collect_list(F.struct("step", "distance")))

    def step(acc: Column, s: Column) -> Column:
        plain = F.size(F.filter(r, lambda x: s["distance"] >= x))
        widened = F.size(F.filter(r, lambda x: s["distance"] >= x * (1 + slack)))
        held = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.when(held.isNull(), plain).otherwise(F.least(F.greatest(held, widened), plain))))

    return steps.groupBy("asset").agg(F.aggregate(log, F.array().cast("array<int>"), step).alias("rungs"))


#: Names of the three ceilings of a budget, in the order in which they are tried.
CEILINGS = ("props", "triangles", "bytes")


def solve(groups: DataFrame, ceilings: Sequence[float], by: str = "frame") -> DataFrame:
    """Rung of each candidate under three ceilings: ``by``, id, score, and c0, c1, c2, arrays of a cost by rung, finest first.

    All begin at their coarsest rung. If that is over a ceiling, it is reported as binding and nothing moves. Else, by falling
    score and then id, each candidate goes finer rung by rung, charged by the difference of costs, until it is refused; the
    first refusal of a frame names its binding ceiling. Returns ``by``, id, rung, binding. Sequential, a frame at a time."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "id"], ascending=[False, True])
        costs = [np.array([r.c0, r.c1, r.c2], float) for r in f.itertuples()]
        rungs, most = [c.shape[1] - 1 for c in costs], np.array(ceilings, float)
        used = np.sum([c[:, -1] for c in costs], axis=0)
        over = np.nonzero(used > most)[0]
        binding = CEILINGS[over[0]] if len(over) else "none"
        for n, c in enumerate(costs if not len(over) else []):
            while rungs[n]:
                want = used - c[:, rungs[n]] + c[:, rungs[n] - 1]
                over = np.nonzero(want > most)[0]
                if len(over):
                    binding = CEILINGS[over[0]] if binding == "none" else binding
                    break
                used, rungs[n] = want, rungs[n] - 1
        return f.assign(rung=rungs, binding=binding)[[by, "id", "rung", "binding"]]

    return groups.groupBy(by).applyInPandas(one, f"{by} long, id long, rung int, binding string")


def pyramid(voxels: DataFrame, levels: int) -> DataFrame:
    """Level k holds every 2^k-th voxel: column level."""
    out = voxels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    step = F.pow(F.lit(2.0), "level").cast("long")
    keep = (F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("z") % step == 0)
    return out.filter(keep).withColumns({a: F.floor(F.col(a) / step).cast("long") for a in "xyz"})


def box_average(image: DataFrame, factor: int) -> DataFrame:
    """Image (y, x, c, v) smaller by a factor, each pixel the mean of its box."""
    return image.groupBy(F.floor(F.col("y") / factor).cast("long").alias("y"), F.floor(F.col("x") / factor).cast("long").alias("x"), "c").agg(F.avg("v").alias("v"))


def flipped(image: DataFrame, height: int) -> DataFrame:
    return image.withColumn("y", F.lit(height - 1) - F.col("y"))


def content_hash(triangles: Sequence[tuple], step: float = 1e-4) -> int:
    """FNV-1a 64 of triangles quantised, turned to begin with their least corner, and sorted."""
    q = [[tuple(round(c / step) for c in p) for p in t] for t in triangles]
    turned = sorted(min(t[i:] + t[:i] for i in range(3)) for t in q)
    h = 0xCBF29CE484222325
    for t in turned:
        for p in t:
            for c in p:
                for b in int(c).to_bytes(8, "little", signed=True):
                    h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


# --- grids (r, c, occ) ------------------------------------------------------------------------------------------------


def inflate(cells: DataFrame, steps: int, rows: int, cols: int) -> DataFrame:
    """Occupied cells (r, c) grown by 4-neighbours, n times: the diamond around each, then distinct."""
    diamond = F.array(*(F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1) if abs(a) + abs(b) <= steps))
    grown = cells.select("r", "c", F.explode(diamond).alias("o")).select((F.col("r") + F.col("o.r")).alias("r"), (F.col("c") + F.col("o.c")).alias("c"))
    return grown.filter(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1)).distinct()


FAR = 1e20


def edt2_line(f: np.ndarray) -> np.ndarray:
    """Exact lower envelope of parabolas: min over j of (i - j)^2 + f[j]."""
    n = len(f)
    i = np.arange(n, dtype=float)
    return np.minimum((i[:, None] - i[None, :]) ** 2 + f[None, :], FAR).min(axis=1) if n <= 512 else envelope(f)


def envelope(f: np.ndarray) -> np.ndarray:
    n, v, z, k = len(f), [0], [-np.inf], 0
    for q in range(1, n):
        while True:
            s = ((f[q] + q * q) - (f[v[-1]] + v[-1] ** 2)) / (2 * q - 2 * v[-1])
            if s > z[-1] or len(v) == 1:
                break
            v.pop(), z.pop()
        if s <= z[-1]:
            v, z = [q], [-np.inf]
        else:
            v.append(q), z.append(s)
    at = np.searchsorted(np.array(z), np.arange(n), "right") - 1
    own = np.array(v)[at]
    return np.minimum((np.arange(n) - own) ** 2 + f[own], FAR)


def edt2(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Exact squared distance of every cell to the nearest occupied one (r, c, occ), about 1e20 without any: columns, then rows, each line a group."""

    def line(axis: str, other: str, n: int, first: bool):
        def one(f: pd.DataFrame) -> pd.DataFrame:
            base = np.full(n, FAR)
            base[f[axis].to_numpy()] = np.where(f["occ"] > 0, 0.0, FAR) if first else f["d2"].to_numpy()
            return pd.DataFrame({axis: np.arange(n), other: f[other].iloc[0], "d2": edt2_line(base)})[["r", "c", "d2"]]

        return one

    a = cells.groupBy("c").applyInPandas(line("r", "c", rows, True), "r long, c long, d2 double")
    return a.groupBy("r").applyInPandas(line("c", "r", cols, False), "r long, c long, d2 double")


def build_sdf(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Signed distance, positive outside, and its unit gradient."""
    out = edt2(cells, rows, cols).withColumnRenamed("d2", "o")
    inside = edt2(cells.withColumn("occ", 1 - F.col("occ")), rows, cols).withColumnRenamed("d2", "i")
    sdf = out.join(inside, ["r", "c"]).select("r", "c", (F.sqrt("o") - F.sqrt("i")).alias("sdf"))
    for a, b, n in (("r", "c", "gr"), ("c", "r", "gc")):
        w = Window.partitionBy(b).orderBy(a)
        sdf = sdf.withColumn(n, F.coalesce(F.lead("sdf").over(w), F.col("sdf")) - F.coalesce(F.lag("sdf").over(w), F.col("sdf")))
    size = F.sqrt(F.col("gr") ** 2 + F.col("gc") ** 2)
    return sdf.withColumns({n: F.when(size > 0, F.col(n) / size).otherwise(F.lit(0.0)) for n in ("gr", "gc")})


def clearance_cost(d2: Column, gamma: float, safe: float) -> Column:
    return gamma * F.greatest(F.lit(0.0), safe - F.sqrt(d2))


def bresenham(r0: int, c0: int, r1: int, c1: int) -> list[tuple[int, int]]:
    """Cells of a line, ends included."""
    dr, dc = abs(r1 - r0), abs(c1 - c0)
    sr, sc, err, out = (1 if r1 > r0 else -1), (1 if c1 > c0 else -1), dc - dr, [(r0, c0)]
    while (r0, c0) != (r1, c1):
        e = 2 * err
        if e > -dr:
            err, c0 = err - dr, c0 + sc
        if e < dc:
            err, r0 = err + dc, r0 + sr
        out.append((r0, c0))
    return out


def line_of_sight(queries: DataFrame, occupied: DataFrame) -> DataFrame:
    """(id, clear) of segments (id, r0, c0, r1, c1): no cell of the line is occupied."""

    def cells(frames):
        for f in frames:
            rows = [(q[0], r, c) for q in f.itertuples(index=False) for r, c in bresenham(*map(int, q[1:5]))]
            yield pd.DataFrame(rows, columns=["id", "r", "c"])

    line = queries.select("id", "r0", "c0", "r1", "c1").mapInPandas(cells, "id long, r long, c long")
    hit = line.join(occupied.select("r", "c").distinct(), ["r", "c"], "left_semi").select("id").distinct()
    return queries.select("id").join(hit.withColumn("hit", F.lit(True)), "id", "left").select("id", F.col("hit").isNull().alias("clear"))


def nearest_free(queries: DataFrame, free: DataFrame, radius: int = 12) -> DataFrame:
    """Nearest free cell (id, r, c) around each cell, the first in scan order of rings up to the radius."""
    ring = F.array(*(F.struct(F.lit(max(abs(a), abs(b))).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)))
    near = queries.select("id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.explode(ring).alias("o")).select("id", "o", (F.col("r0") + F.col("o.a")).alias("r"), (F.col("c0") + F.col("o.b")).alias("c"))
    return near.join(free.select("r", "c"), ["r", "c"]).groupBy("id").agg(F.min_by(F.struct("r", "c"), "o").alias("at")).select("id", "at.r", "at.c")


def astar(grid_: np.ndarray, start: tuple[int, int], goal: tuple[int, int], cost: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Shortest 8-connected path without cutting corners; ties by (f, g, node, parent). Empty if there is none."""
    rows, cols = grid_.shape
    if grid_[start] or grid_[goal]:
        return []
    node = lambda p: p[0] * cols + p[1]
    far = lambda p: (lambda a, b: max(a, b) + (2**0.5 - 1) * min(a, b))(abs(p[0] - goal[0]), abs(p[1] - goal[1]))
    heap, parents, done = [(far(start), 0.0, node(start), -1)], {}, set()
    best = {node(start): 0.0}
    while heap:
        _, g, n, parent = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        parents[n] = parent
        r, c = divmod(n, cols)
        if (r, c) == goal:
            out = []
            while n >= 0:
                out.append(divmod(n, cols))
                n = parents[n]
            return out[::-1]
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                y, x = r + a, c + b
                if (a or b) and 0 <= y < rows and 0 <= x < cols and not grid_[y, x] and not (a and b and (grid_[r, x] or grid_[y, c])):
                    w = g + (2**0.5 if a and b else 1.0) + (float(cost[y, x]) if cost is not None else 0.0)
                    m = y * cols + x
                    if m not in done and w < best.get(m, np.inf):
                        best[m] = w
                        heapq.heappush(heap, (w + far((y, x)), w, m, n))
    return []


def pulled(path: Sequence[tuple[int, int]], grid_: np.ndarray) -> list[tuple[int, int]]:
    """Path without the points between which the line is clear."""
    out, k = list(path[:1]), 0
    while k < len(path) - 1:
        j = len(path) - 1
        while j > k + 1 and any(grid_[p] for p in bresenham(*path[k], *path[j])):
            j -= 1
        out.append(path[j])
        k = j
    return out


def paths(queries: DataFrame, grid_: np.ndarray) -> DataFrame:
    """(id, length, path) of many queries (id, r0, c0, r1, c1) on one grid, which every task holds: its size is the caller's bound."""
    held = queries.sparkSession.sparkContext.broadcast(grid_)

    def find(frames):
        for f in frames:
            got = [astar(held.value, (int(q.r0), int(q.c0)), (int(q.r1), int(q.c1))) for q in f.itertuples()]
            yield pd.DataFrame({"id": f["id"], "length": [float(sum(2**0.5 if a[0] != b[0] and a[1] != b[1] else 1.0 for a, b in zip(p, p[1:]))) if p else -1.0 for p in got], "path": [[list(c) for c in p] for p in got]})

    return queries.mapInPandas(find, "id long, length double, path array<array<long>>")


def water_bodies(cells: DataFrame) -> DataFrame:
    """4-connected components of cells (r, c; 0 <= c < 2**32 - 1, so a row's end never touches the next row): r, c, body (the least r * 2**32 + c)."""
    from .geometry import connected

    row = 1 << 32
    n = cells.select((F.col("r") * F.lit(row) + F.col("c")).alias("n"))
    pairs = n.select(F.col("n").alias("a"), F.explode(F.array(F.col("n") + 1, F.col("n") + F.lit(row))).alias("b"))
    linked = connected(pairs.join(n.withColumnRenamed("n", "b"), "b", "left_semi").select("a", "b"))
    return n.join(linked, F.col("n") == F.col("node"), "left").select(F.shiftright("n", 32).alias("r"), F.col("n").bitwiseAND(F.lit(row - 1)).alias("c"), F.coalesce("label", "n").alias("body"))
