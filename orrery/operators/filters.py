"""Further filters: total variation, contrast, vector diffusion, critical points, images, height fields, belief maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES
from .lod import bresenham
from .volume import neighbours, windowed

SIDES = [a + s for a in AXES for s in "mp"]


def total_variation(v: DataFrame, q: float, rate: float, sweeps: int, all_neighbours: bool = False) -> DataFrame:
    """Gradient-dependent total variation: each sweep moves a voxel towards its neighbours (6, or 26), weighted by 1 / (1 + g)^(2 - q) of the gradient taken once before the sweeps."""
    n = neighbours(v)
    g = F.sqrt(sum(((F.col(a + "p") - F.col(a + "m")) * (F.col(a + "p") - F.col(a + "m")) / 4 for a in AXES), F.lit(0.0)))
    weight = n.select(*AXES, F.pow(1 + g, F.lit(q - 2.0)).alias("w"))
    for _ in range(sweeps):
        if all_neighbours:
            m = windowed(v, 1).filter("dx <> 0 or dy <> 0 or dz <> 0").groupBy(*AXES).agg(F.first("value").alias("value"), F.avg("other").alias("m"))
        else:
            m = neighbours(v).withColumn("m", sum((F.col(s) for s in SIDES[1:]), F.col(SIDES[0])) / 6)
        v = m.join(weight, list(AXES)).select(*AXES, (F.col("value") + rate * F.col("w") * (F.col("m") - F.col("value"))).alias("value"))
    return v


def contrast(v: DataFrame, resistor: float, keys: Sequence[str] = ("vol_id",)) -> DataFrame:
    """Local contrast: lower and upper envelopes spread along x, forwards and back, with a resistance, and values are stretched between them; the order of the sweep matters, so a volume is one group."""
    keys = list(keys)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["z", "y", "x"])
        a = f["value"].to_numpy(float).reshape(f["z"].nunique(), f["y"].nunique(), -1)
        low, high = a.copy(), a.copy()
        for axis in (2, 1, 0):
            for flip in (False, True):
                lo, hi = (np.moveaxis(np.flip(x, axis) if flip else x, axis, 0) for x in (low, high))
                for k in range(1, lo.shape[0]):
                    lo[k] = np.minimum(lo[k], lo[k] + resistor * (lo[k - 1] - lo[k]))
                    hi[k] = np.maximum(hi[k], hi[k] + resistor * (hi[k - 1] - hi[k]))
        span = high - low
        top, bottom = a.max(), a.min()
        out = np.where(span > 0, bottom + (a - low) / np.where(span > 0, span, 1) * (top - bottom), a)
        return f.assign(value=out.ravel())[[*keys, *AXES, "value"]]

    kinds = ", ".join(f"{c} {v.schema[c].dataType.simpleString()}" for c in [*keys, *AXES])
    return v.groupBy(*keys).applyInPandas(one, f"{kinds}, value double")


def vector_diffusion(field: DataFrame, sweeps: int, rate: float = 0.1) -> DataFrame:
    """Iterated diffusion of a vector field (vx, vy, vz): each neighbour's share falls with its angle to the voxel's vector."""
    parts = ("vx", "vy", "vz")
    for _ in range(sweeps):
        out = field
        for a in AXES:
            w = Window.partitionBy(*(b for b in AXES if b != a)).orderBy(a)
            out = out.withColumns({f"{p}_{a}{s}": F.coalesce(f(p).over(w), F.col(p)) for p in parts for s, f in (("m", F.lag), ("p", F.lead))})
        moved = {p: F.lit(0.0) for p in parts}
        size = lambda suffix: F.sqrt(sum((F.col(p + suffix) * F.col(p + suffix) for p in parts[1:]), F.col(parts[0] + suffix) * F.col(parts[0] + suffix)))
        for s in SIDES:
            dot = sum((F.col(p) * F.col(f"{p}_{s}") for p in parts[1:]), F.col(parts[0]) * F.col(f"{parts[0]}_{s}"))
            both = size("") * size("_" + s)
            weight = F.when(both > 0, F.exp(dot / both - 1)).otherwise(F.lit(1.0))
            moved = {p: moved[p] + weight * (F.col(f"{p}_{s}") - F.col(p)) for p in parts}
        field = out.select(*AXES, *((F.col(p) + rate * moved[p]).alias(p) for p in parts))
    return field


def critical_points(v: DataFrame) -> DataFrame:
    """max, min or saddle voxels by the signs of differences to the six neighbours inside the grid; regular ones are absent."""
    n = neighbours(v)
    up = sum(((F.col(s) > F.col("value")).cast("int") for s in SIDES[1:]), (F.col(SIDES[0]) > F.col("value")).cast("int"))
    down = sum(((F.col(s) < F.col("value")).cast("int") for s in SIDES[1:]), (F.col(SIDES[0]) < F.col("value")).cast("int"))
    axis = [((F.col(a + "m") - F.col("value")) * (F.col(a + "p") - F.col("value")) > 0) for a in AXES]
    rising = [axis[i] & (F.col(a + "m") > F.col("value")) for i, a in enumerate(AXES)]
    some = lambda cs: cs[0] | cs[1] | cs[2]
    falling = [axis[i] & (F.col(a + "m") < F.col("value")) for i, a in enumerate(AXES)]
    kind = F.when((up == 0) & (down > 0), "max").when((down == 0) & (up > 0), "min").when(some(rising) & some(falling), "saddle")
    return n.select(*AXES, "value", kind.alias("kind")).filter("kind is not null")


def seeds_above(v: DataFrame, keep: int) -> DataFrame:
    """The strongest local maxima, at most ``keep``, by value and then voxel."""
    from .volume import local_maxima

    return local_maxima(v).orderBy(F.desc("value"), *AXES).limit(keep)


def rotated_points(points: DataFrame, degrees: float, centre: Sequence[float]) -> DataFrame:
    """Seeds turned about a centre's z axis, rounded to voxels, each once."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x, y = F.col("x") - centre[0], F.col("y") - centre[1]
    return points.select(F.round(x * c - y * s + centre[0]).cast("long").alias("x"), F.round(x * s + y * c + centre[1]).cast("long").alias("y"), "z").distinct()


def fft2(v: DataFrame) -> DataFrame:
    """Unnormalised 2-D transform of each slice: columns re and im; a slice is one group."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        a = f.pivot(index="y", columns="x", values="value").to_numpy()
        b = np.fft.fft2(a)
        y, x = np.indices(a.shape)
        return pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": f["z"].iloc[0], "re": b.real.ravel(), "im": b.imag.ravel()})

    return v.select(*AXES, "value").groupBy("z").applyInPandas(one, "x long, y long, z long, re double, im double")


def smooth_mesh(cells: DataFrame, vertices: DataFrame, sweeps: int, rate: float = 0.5) -> DataFrame:
    """Laplacian smoothing; boundary vertices stay."""
    from .geometry import boundary_vertices, edges

    e = edges(cells)
    both = e.select("a", "b").union(e.select("b", "a"))
    rim = boundary_vertices(cells).withColumn("_rim", F.lit(True))
    for _ in range(sweeps):
        mean = both.join(vertices.withColumnRenamed("vid", "b"), "b").groupBy(F.col("a").alias("vid")).agg(*(F.avg(a).alias("m" + a) for a in AXES))
        moved = vertices.join(mean, "vid", "left").join(rim, "vid", "left")
        vertices = moved.select("vid", *(F.when(F.col("_rim").isNull() & F.col("m" + a).isNotNull(), F.col(a) + rate * (F.col("m" + a) - F.col(a))).otherwise(F.col(a)).alias(a) for a in AXES))
    return vertices


# --- images (y, x, c, v) and height fields (r, c, h) -------------------------------------------------------------------


def resized_nearest(image: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Nearest pixel of (height, width) for each pixel of the new size."""
    spark = image.sparkSession
    want = spark.range(to[0] * to[1]).select(F.floor(F.col("id") / to[1]).cast("long").alias("ny"), (F.col("id") % to[1]).alias("nx"))
    want = want.withColumns({"y": F.floor((F.col("ny") + 0.5) * size[0] / to[0]).cast("long"), "x": F.floor((F.col("nx") + 0.5) * size[1] / to[1]).cast("long")})
    return want.join(image, ["y", "x"]).select(F.col("ny").alias("y"), F.col("nx").alias("x"), "c", "v")


def converted(image: DataFrame, a: str, b: str) -> DataFrame:
    """Values between u8, u16 and f32 ranges; floats are clipped to [0, 1]."""
    top = {"u8": 255.0, "u16": 65535.0, "f32": 1.0}
    v = F.col("v") / top[a] * top[b]
    return image.withColumn("v", v if b == "f32" else F.round(F.greatest(F.lit(0.0), F.least(F.lit(top[b]), v))))


def gray(image: DataFrame) -> DataFrame:
    """One channel from red, green and blue by the usual luma weights."""
    w = F.when(F.col("c") == 0, 0.299).when(F.col("c") == 1, 0.587).when(F.col("c") == 2, 0.114).otherwise(0.0)
    return image.groupBy("y", "x").agg(F.sum(F.col("v") * w).alias("v")).select("y", "x", F.lit(0).alias("c"), "v")


def height_at(field: DataFrame, points: DataFrame, rows: int, cols: int, step: float = 1.0) -> DataFrame:
    """(id, h, slope_r, slope_c): bilinear height and its differences at points (id, pr, pc), clamped to the field."""
    r, c = (F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), F.col(p) / step)) for n, p in ((rows, "pr"), (cols, "pc")))
    p = points.select("id", r.alias("fr"), c.alias("fc")).withColumns({"br": F.least(F.floor("fr"), F.lit(rows - 2)).cast("long"), "bc": F.least(F.floor("fc"), F.lit(cols - 2)).cast("long")})
    taps = p.withColumn("_t", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))))
    wr, wc = F.when(F.col("_t.i") == 1, F.col("fr") - F.col("br")).otherwise(1 - F.col("fr") + F.col("br")), F.when(F.col("_t.j") == 1, F.col("fc") - F.col("bc")).otherwise(1 - F.col("fc") + F.col("bc"))
    taps = taps.select("id", (F.col("br") + F.col("_t.i")).alias("r"), (F.col("bc") + F.col("_t.j")).alias("c"), wr.alias("wr"), wc.alias("wc"), (2 * F.col("_t.i") - 1).alias("si"), (2 * F.col("_t.j") - 1).alias("sj"))
    h = F.col("h")
    return taps.join(field.select("r", "c", "h"), ["r", "c"]).groupBy("id").agg(F.sum(F.col("wr") * F.col("wc") * h).alias("h"), (F.sum(F.col("si") * F.col("wc") * h) / step).alias("slope_r"), (F.sum(F.col("wr") * F.col("sj") * h) / step).alias("slope_c"))


def slope_deg(r: Column, c: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(r * r + c * c)))


def scatter(spark, n: int, box: Sequence[float], seed: int) -> DataFrame:
    """n placements (id, x, y) in a box, from hashes of their numbers and the seed: the same whatever the partitioning."""
    unit = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
    return spark.range(n).select("id", (box[0] + unit(0) * (box[2] - box[0])).alias("x"), (box[1] + unit(1) * (box[3] - box[1])).alias("y"))


def value_noise(x: Column, seed: int) -> Column:
    """Smooth noise of one variable from hashes at whole numbers."""
    at = lambda i: F.pmod(F.xxhash64(i.cast("long"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    i = F.floor(x)
    f = x - i
    s = f * f * (3 - 2 * f)
    return at(i) * (1 - s) + at(i + 1) * s


def sense(planes: DataFrame, occupied: np.ndarray, reach: int, hit: float = 0.85, miss: float = -0.4, most: float = 3.5) -> DataFrame:
    """Log-odds after ray casts (plane, step, r, c): cells along 16 rays are freed, the first occupied one is confirmed, clamped; (plane, r, c, log_odds, flips). Sequential, a plane is one group; the map's size is the caller's bound."""
    held = planes.sparkSession.sparkContext.broadcast(occupied)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        occ = held.value
        odds, flips = np.zeros(occ.shape), 0
        for s in f.sort_values("step").itertuples():
            for k in range(16):
                a = 2 * math.pi * k / 16
                for r, c in bresenham(int(s.r), int(s.c), int(round(s.r + reach * math.sin(a))), int(round(s.c + reach * math.cos(a))))[1:]:
                    if not (0 <= r < occ.shape[0] and 0 <= c < occ.shape[1]):
                        break
                    before = odds[r, c] > 0
                    odds[r, c] = min(most, max(-most, odds[r, c] + (hit if occ[r, c] else miss)))
                    flips += before != (odds[r, c] > 0)
                    if occ[r, c]:
                        break
        at = np.argwhere(odds != 0)
        return pd.DataFrame({"plane": f["plane"].iloc[0], "r": at[:, 0], "c": at[:, 1], "log_odds": odds[odds != 0], "flips": flips})

    return planes.groupBy("plane").applyInPandas(one, "plane long, r long, c long, log_odds double, flips long")


def xor_patch(base: bytes, new: bytes) -> bytes:
    """Delta of two payloads: lengths, check sum and the exclusive or, deflated; raw if that is shorter."""
    import struct
    import zlib

    n = max(len(base), len(new))
    mixed = bytes(a ^ b for a, b in zip(base.ljust(n, b"\0"), new.ljust(n, b"\0")))
    body = zlib.compress(mixed)
    return (b"D" + struct.pack(">II", len(new), zlib.crc32(new)) + body) if len(body) < len(new) else b"R" + new


def apply_patch(base: bytes, patch: bytes) -> bytes:
    import struct
    import zlib

    if patch[:1] == b"R":
        return patch[1:]
    size, crc = struct.unpack(">II", patch[1:9])
    mixed = zlib.decompress(patch[9:])
    out = bytes(a ^ b for a, b in zip(base.ljust(len(mixed), b"\0"), mixed))[:size]
    if zlib.crc32(out) != crc:
        raise ValueError("patch doesn't fit this base")
    return out
