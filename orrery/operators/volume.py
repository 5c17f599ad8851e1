"""Element-wise operators, statistics, resampling and projection of volumes.

Volumes are long tables with columns x, y, z and value; other columns named in ``keys`` (such as vol_id) keep several
volumes apart. Binary operators are equi-joins on the voxel, so one shuffle at most, none if both sides are partitioned by
the voxel already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import AXES, finite, grid, in_box, span, world

def val() -> Column:
    return F.col("value")



def paired(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Voxels of both volumes: columns value and other."""
    on = [*keys, *AXES]
    return a.select(*on, "value").join(b.select(*on, F.col("value").alias("other")), on)


def check_dims(a: DataFrame, b: DataFrame) -> None:
    """Raise unless both volumes have the same extents; two aggregates, for callers that don't know."""
    of = lambda v: v.agg(*(F.max(c) for c in AXES), F.count("*")).first()
    if of(a) != of(b):
        raise ValueError("volumes of different dimensions")


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "difference": lambda a, b: F.abs(a - b),
    "average": lambda a, b: (a + b) / 2,
    "mask": lambda a, b: F.when(b != 0, a).otherwise(F.lit(0.0)),
    "inverse_mask": lambda a, b: F.when(b == 0, a).otherwise(F.lit(0.0)),
}


def combine(a: DataFrame, b: DataFrame, op: str, keys: Sequence[str] = ()) -> DataFrame:
    """add, subtract, difference, average, mask or inverse_mask of two volumes; rows stay, masked values become 0."""
    return paired(a, b, keys).withColumn("value", BINARY[op](val(), F.col("other"))).drop("other")


def mapped(v: DataFrame, value: Column) -> DataFrame:
    return v.withColumn("value", value)


def scale(v: DataFrame, factor: float) -> DataFrame:
    return mapped(v, val() * factor)


def negate(v: DataFrame) -> DataFrame:
    return mapped(v, -val())


def clip(v: DataFrame, threshold: float) -> DataFrame:
    """Values below the threshold stay, others become 0."""
    return mapped(v, F.when(val() < threshold, val()).otherwise(F.lit(0.0)))


def clamp_min(v: DataFrame, least: float) -> DataFrame:
    return mapped(v, F.when(val() < least, F.lit(float(least))).otherwise(val()))


def fill(v: DataFrame, value: float, window: Sequence[int] | None = None) -> DataFrame:
    """A constant everywhere, or within an index window (x0, y0, z0, x1, y1, z1), ends included."""
    inside = in_box(window) if window else F.lit(True)
    return mapped(v, F.when(inside, F.lit(float(value))).otherwise(val()))


def put(v: DataFrame, at: Sequence[int], value: float) -> DataFrame:
    return fill(v, value, (*at, *at))


def get(v: DataFrame, at: Sequence[int], dims: Sequence[int]) -> DataFrame:
    if any(not 0 <= i < n for i, n in zip(at, dims)):
        raise IndexError("voxel outside of the volume")
    return v.filter((F.col("x") == at[0]) & (F.col("y") == at[1]) & (F.col("z") == at[2])).select("value")


def normalize(v: DataFrame, low: float = 0.0, high: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Affine map of the value range to [low, high]; a constant volume becomes low. One aggregate, whose row (or row for each volume) is joined back."""
    ends = v.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    both = v.join(ends, list(keys)) if keys else v.crossJoin(F.broadcast(ends))  # one row
    value = F.when(F.col("_hi") > F.col("_lo"), low + (val() - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (high - low)).otherwise(F.lit(float(low)))
    return both.withColumn("value", value).drop("_lo", "_hi")


def stats(v: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """min, max, mean, population standard deviation and count; zeros for an empty volume."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return v.groupBy(*keys).agg(zero(F.min("value")).alias("min"), zero(F.max("value")).alias("max"), zero(F.avg("value")).alias("mean"), zero(F.stddev_pop("value")).alias("std"), F.count("value").alias("n"))


def stats_in_box(v: DataFrame, region: Sequence[float], box: Sequence[float], dims: Sequence[int]) -> DataFrame:
    """Statistics of the voxels whose world position lies in a closed box."""
    w = world(box, dims)
    return stats(v.filter(in_box(region, w)))


def histogram(v: DataFrame, bins: int = 256, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the value range, half open, the maximum in the last; empty bins have count 0."""
    ends = v.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    both = v.join(ends, list(keys)) if keys else v.crossJoin(F.broadcast(ends))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((val() - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(F.lit(0))
    counts = both.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def robust_range(v: DataFrame, low: float = 0.02, high: float = 0.98, keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated percentiles of the finite values; null if there are none."""
    return v.filter(finite("value")).groupBy(*keys).agg(F.percentile("value", low).alias("low"), F.percentile("value", high).alias("high"))


def sub(v: DataFrame, window: Sequence[int]) -> DataFrame:
    """Crop to an index window, ends included, and count indexes from its corner."""
    return v.filter(in_box(window)).withColumns({a: F.col(a) - window[i] for i, a in enumerate(AXES)})


def sub_box(v: DataFrame, region: Sequence[float], box: Sequence[float], dims: Sequence[int]) -> DataFrame:
    """Crop to the voxels within a world box."""
    s = span(box, dims)
    at = [math.ceil((region[i] - box[i]) / s[i] - 1e-9) if s[i] else 0 for i in range(3)]
    to = [math.floor((region[i + 3] - box[i]) / s[i] + 1e-9) if s[i] else 0 for i in range(3)]
    return sub(v, (*at, *to))


def extract_slice(v: DataFrame, axis: str, at: int) -> DataFrame:
    """One plane as columns u, v and value."""
    u, w = (a for a in AXES if a != axis)
    return v.filter(F.col(axis) == at).select(F.col(u).alias("u"), F.col(w).alias("v"), "value")


def downsample(v: DataFrame, factor: int) -> DataFrame:
    """Every factor-th voxel of each axis, without averaging."""
    if factor < 1:
        raise ValueError("the factor is at least 1")
    keep = F.lit(True)
    for a in AXES:
        keep = keep & (F.col(a) % factor == 0)
    return v.filter(keep).withColumns({a: F.floor(F.col(a) / factor).cast("long") for a in AXES})


def rgba_merge(r: DataFrame, g: DataFrame, b: DataFrame, a: DataFrame) -> DataFrame:
    """Four volumes interleaved along x: red, green, blue, alpha."""
    out = r.select(*AXES, F.col("value").alias("c0"))
    for k, v in enumerate((g, b, a), 1):
        out = out.join(v.select(*AXES, F.col("value").alias(f"c{k}")), list(AXES))
    out = out.select(*AXES, F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("k", "value"))
    return out.select((F.col("x") * 4 + F.col("k")).cast("long").alias("x"), "y", "z", "value")


def composite(a: DataFrame, b: DataFrame, offset: Sequence[int], op: Callable[[Column, Column], Column] | str = "copy") -> DataFrame:
    """Second volume laid over the first at an offset: copy, add, subtract or a function of both values where they overlap."""
    f = {"copy": lambda x, y: y, "add": lambda x, y: x + y, "subtract": lambda x, y: x - y}.get(op, op)
    moved = b.select(*((F.col(c) + offset[i]).alias(c) for i, c in enumerate(AXES)), F.col("value").alias("other"))
    return a.join(moved, list(AXES), "left").withColumn("value", F.when(F.col("other").isNotNull(), f(val(), F.col("other"))).otherwise(val())).drop("other")


def neighbours(v: DataFrame, steps: Sequence[tuple[Sequence[str], str]] = ((("y", "z"), "x"), (("x", "z"), "y"), (("x", "y"), "z")), keys: Sequence[str] = ()) -> DataFrame:
    """Values of the six face neighbours: xm, xp, ym, yp, zm, zp; at an edge the voxel's own value. Three sorts, no row is repeated."""
    for across, along in steps:
        w = Window.partitionBy(*keys, *across).orderBy(along)
        v = v.withColumns({along + "m": F.coalesce(F.lag("value").over(w), val()), along + "p": F.coalesce(F.lead("value").over(w), val())})
    return v


def gradient(v: DataFrame, steps: Sequence[float] = (1.0, 1.0, 1.0), unit: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Central differences with clamped edges, of unit length if asked."""
    n = neighbours(v, keys=keys)
    d = [(F.col(a + "p") - F.col(a + "m")) / (2 * steps[i]) for i, a in enumerate(AXES)]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    parts = [F.when(length > 0, c / length).otherwise(F.lit(0.0)) if unit else c for c in d]
    return n.select(*keys, *AXES, "value", *(c.alias("g" + a) for c, a in zip(parts, AXES)))


def diffusion(v: DataFrame, sweeps: int, k: float = 3.0, rate: float = 0.16, keys: Sequence[str] = (), keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Perona-Malik diffusion: every voxel takes a share of each face neighbour's difference, damped by exp(-(d/k)^2). ``keep`` cuts the lineage every fifth sweep."""
    for s in range(sweeps):
        n = neighbours(v, keys=keys)
        flow = F.lit(0.0)
        for a in AXES:
            for side in "mp":
                d = F.col(a + side) - val()
                flow = flow + F.exp(-(d / k) * (d / k)) * d
        v = n.withColumn("value", val() + rate * flow).select(*keys, *AXES, "value")
        if keep and s % 5 == 4:
            v = keep(v)
    return v


def offsets(radius: int, dims: int = 3) -> list[tuple[int, ...]]:
    r = range(-radius, radius + 1)
    return [(x, y, z) for x in r for y in r for z in (r if dims == 3 else (0,))]


def windowed(v: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """A row for each voxel and each voxel of its cubic window: x, y, z, dx, dy, dz, value, other. Values are sent to their windows once and joined by voxel."""
    sent = v.withColumn("_o", F.explode(F.array(*(F.struct(*(F.lit(d).alias("d" + a) for a, d in zip(AXES, o))) for o in offsets(radius)))))
    sent = sent.select(*keys, *((F.col(a) - F.col("_o.d" + a)).alias(a) for a in AXES), *(F.col("_o.d" + a).alias("d" + a) for a in AXES), F.col("value").alias("other"))
    return v.select(*keys, *AXES, "value").join(sent, [*keys, *AXES])


def bilateral(v: DataFrame, radiometric: float, spatial: float, radius: int) -> DataFrame:
    """Bilateral filter with a 256-entry radiometric table over the value range (index truncated), in double precision."""
    ends = v.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    w = windowed(v, radius).crossJoin(F.broadcast(ends))
    step = F.when(F.col("_hi") > F.col("_lo"), F.floor(F.abs(F.col("other") - val()) * 255 / (F.col("_hi") - F.col("_lo")))).otherwise(F.lit(0))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    weight = F.exp(-(step * step) / (2 * radiometric**2)) * F.exp(-d2 / (2 * spatial**2))
    return w.groupBy(*AXES).agg((F.sum(weight * F.col("other")) / F.sum(weight)).alias("value"))


def local_maxima(v: DataFrame) -> DataFrame:
    """Voxels that no voxel of the 3 x 3 x 3 block exceeds."""
    return windowed(v, 1).groupBy(*AXES).agg(F.first("value").alias("value"), F.max("other").alias("_m")).filter("_m <= value").drop("_m")


def ssim(a: DataFrame, b: DataFrame, window: int = 3, sigma: float = 1.5, top: float = 255.0) -> DataFrame:
    """Mean structural similarity with a Gaussian window whose weights are renormalised at edges."""
    if window % 2 == 0:
        raise ValueError("the window is odd")
    pair = paired(a, b)
    r = window // 2
    sent = pair.withColumn("_o", F.explode(F.array(*(F.struct(*(F.lit(d).alias("d" + c) for c, d in zip(AXES, o)), F.lit(math.exp(-sum(d * d for d in o) / (2 * sigma**2))).alias("w")) for o in offsets(r)))))
    w, p, q = F.col("_o.w"), val(), F.col("other")
    m = sent.groupBy(*((F.col(c) + F.col("_o.d" + c)).alias(c) for c in AXES)).agg(F.sum(w).alias("w"), F.sum(w * p).alias("p"), F.sum(w * q).alias("q"), F.sum(w * p * p).alias("pp"), F.sum(w * q * q).alias("qq"), F.sum(w * p * q).alias("pq"))
    m = m.join(pair.select(*AXES), list(AXES), "left_semi")
    mp, mq = F.col("p") / F.col("w"), F.col("q") / F.col("w")
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    vp, vq, cv = F.col("pp") / F.col("w") - mp * mp, F.col("qq") / F.col("w") - mq * mq, F.col("pq") / F.col("w") - mp * mq
    return m.agg(F.avg((2 * mp * mq + c1) * (2 * cv + c2) / ((mp * mp + mq * mq + c1) * (vp + vq + c2))).alias("ssim"))


def gather(v: DataFrame, points: DataFrame, dims: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """Trilinear values at points with fractional indexes px, py, pz: eight taps each, one join and one sum. The last voxel clamps; points outside give null."""
    inside = F.lit(True)
    for i, a in enumerate(AXES):
        inside = inside & F.col("p" + a).between(0, dims[i] - 1)
    base = {a: F.least(F.floor("p" + a), F.lit(max(0, dims[i] - 2))).cast("long") for i, a in enumerate(AXES)}
    taps = points.filter(inside).withColumns({"b" + a: c for a, c in base.items()})
    taps = taps.withColumn("_t", F.explode(F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip(AXES, o))) for o in [(i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)]))))
    weight = F.lit(1.0)
    for a in AXES:
        f = F.col("p" + a) - F.col("b" + a)
        weight = weight * F.when(F.col("_t." + a) == 1, f).otherwise(1 - f)
    taps = taps.select(*keep, *((F.col("b" + a) + F.col("_t." + a)).alias(a) for a in AXES), weight.alias("w")).filter("w <> 0")
    return taps.join(v.select(*AXES, "value"), list(AXES)).groupBy(*keep).agg(F.sum(F.col("w") * val()).alias("value"))


def interpolate(v: DataFrame, points: DataFrame, box: Sequence[float], dims: Sequence[int], key: str) -> DataFrame:
    """Values at world points (key, wx, wy, wz); points outside of the box are an error."""
    s = span(box, dims)
    outside = ~in_box(box, ["wx", "wy", "wz"])
    at = {("p" + a): F.when(outside, F.raise_error(F.lit("point outside of the volume")).cast("double")).otherwise((F.col("w" + a) - box[i]) / s[i] if s[i] else F.lit(0.0)) for i, a in enumerate(AXES)}
    return gather(v, points.withColumns(at), dims, [key])


def resize(v: DataFrame, dims: Sequence[int], to: Sequence[int]) -> DataFrame:
    """Trilinear resampling to other dimensions over the same box."""
    spark = v.sparkSession
    ratio = [(dims[i] - 1) / (to[i] - 1) if to[i] > 1 else 0.0 for i in range(3)]
    points = grid(spark, *to).select(*AXES, *((F.col(a) * ratio[i]).alias("p" + a) for i, a in enumerate(AXES)))
    points = points.withColumnsRenamed({a: "o" + a for a in AXES})
    return gather(v, points, dims, ["ox", "oy", "oz"]).withColumnsRenamed({"o" + a: a for a in AXES})


def resize_box(v: DataFrame, dims: Sequence[int], box: Sequence[float], to: Sequence[int], new: Sequence[float]) -> DataFrame:
    """Resampling to another box; voxels outside of the old one are absent."""
    s, n = span(box, dims), span(new, to)
    at = [((F.lit(new[i]) + F.col(a) * n[i] - box[i]) / s[i] if s[i] else F.lit(0.0)).alias("p" + a) for i, a in enumerate(AXES)]
    points = grid(v.sparkSession, *to).select(*(F.col(a).alias("o" + a) for a in AXES), *at)
    return gather(v, points, dims, ["ox", "oy", "oz"]).withColumnsRenamed({"o" + a: a for a in AXES})


def rotate_z(v: DataFrame, degrees: float, dims: Sequence[int]) -> DataFrame:
    """Rotation about the centre's z axis; what comes from outside is 0."""
    c, s = math.cos(math.radians(-degrees)), math.sin(math.radians(-degrees))
    cx, cy = (dims[0] - 1) / 2, (dims[1] - 1) / 2
    x, y = F.col("x") - cx, F.col("y") - cy
    points = grid(v.sparkSession, *dims).select(*(F.col(a).alias("o" + a) for a in AXES), F.round(x * c - y * s + cx, 9).alias("px"), F.round(x * s + y * c + cy, 9).alias("py"), F.col("z").cast("double").alias("pz"))
    got = gather(v, points, dims, ["ox", "oy", "oz"])
    every = grid(v.sparkSession, *dims).withColumnsRenamed({a: "o" + a for a in AXES})
    return every.join(got, ["ox", "oy", "oz"], "left").select(*(F.col("o" + a).alias(a) for a in AXES), F.coalesce("value", F.lit(0.0)).alias("value"))


def combine_with(a: DataFrame, a_box, a_dims, b: DataFrame, b_box, b_dims, dims: Sequence[int]) -> DataFrame:
    """Both volumes over the union of their boxes: the second's value where it reaches, else the first's, else 0."""
    from ..model import box_union

    box = box_union(a_box, b_box)
    spark, s = a.sparkSession, span(box, dims)

    def of(v, own, n, name):
        t = span(own, n)
        at = [((F.lit(box[i]) + F.col(c) * s[i] - own[i]) / t[i] if t[i] else F.lit(0.0)).alias("p" + c) for i, c in enumerate(AXES)]
        return gather(v, grid(spark, *dims).select(*(F.col(c).alias("o" + c) for c in AXES), *at), n, ["ox", "oy", "oz"]).withColumnRenamed("value", name)

    every = grid(spark, *dims).withColumnsRenamed({c: "o" + c for c in AXES})
    for part in (of(a, a_box, a_dims, "va"), of(b, b_box, b_dims, "vb")):
        every = every.join(part, ["ox", "oy", "oz"], "left")
    return every.select(*(F.col("o" + c).alias(c) for c in AXES), F.coalesce("vb", "va", F.lit(0.0)).alias("value"))


def project(v: DataFrame, angles: Sequence[float], dims: Sequence[int], step: float = 1.0) -> DataFrame:
    """Ray sums at each angle: (angle, u, z) by trilinear samples along the ray."""
    spark, r = v.sparkSession, math.hypot(dims[0] - 1, dims[1] - 1) / 2
    n = int(2 * r / step) + 1
    rays = spark.createDataFrame([(k, math.cos(math.radians(a)), math.sin(math.radians(a))) for k, a in enumerate(angles)], "angle int, c double, s double")
    g = spark.range(dims[0] * dims[2]).select((F.col("id") % dims[0]).alias("u"), F.floor(F.col("id") / dims[0]).cast("long").alias("oz"))
    p = g.crossJoin(F.broadcast(rays)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # angles are a parameter, not data
    along, across = F.col("k") * step - r, F.col("u") - (dims[0] - 1) / 2
    p = p.select("angle", "u", "oz", "k", (across * F.col("c") - along * F.col("s") + (dims[0] - 1) / 2).alias("px"), (across * F.col("s") + along * F.col("c") + (dims[1] - 1) / 2).alias("py"), F.col("oz").cast("double").alias("pz"))
    got = gather(v, p, dims, ["angle", "u", "oz", "k"]).groupBy("angle", "u", "oz").agg(F.sum("value").alias("value"))
    return got.select("angle", "u", F.col("oz").alias("z"), (F.col("value") * step).alias("value"))


def ramp_filter(p: DataFrame) -> DataFrame:
    """Ramp filter of each angle's projection along u, by FFT; a group is one projection image."""
    import numpy as np
    import pandas as pd

    def one(f: pd.DataFrame) -> pd.DataFrame:
        t = f.pivot(index="z", columns="u", values="value").fillna(0.0)
        got = np.fft.ifft(np.fft.fft(t.to_numpy(), axis=1) * np.abs(np.fft.fftfreq(t.shape[1])), axis=1).real
        out = pd.DataFrame(got, index=t.index, columns=t.columns).stack().rename("value").reset_index()
        return out.assign(angle=f["angle"].iloc[0])[["angle", "u", "z", "value"]]

    return p.groupBy("angle").applyInPandas(one, "angle int, u long, z long, value double")


def back_project(p: DataFrame, angles: Sequence[float], dims: Sequence[int]) -> DataFrame:
    """Mean over the angles of linear taps of their projections."""
    spark = p.sparkSession
    rays = spark.createDataFrame([(k, math.cos(math.radians(a)), math.sin(math.radians(a))) for k, a in enumerate(angles)], "angle int, c double, s double")
    g = grid(spark, *dims).crossJoin(F.broadcast(rays))
    at = (F.col("x") - (dims[0] - 1) / 2) * F.col("c") + (F.col("y") - (dims[1] - 1) / 2) * F.col("s") + (dims[0] - 1) / 2
    g = g.withColumn("at", at).filter(F.col("at").between(0, dims[0] - 1)).withColumn("u0", F.least(F.floor("at"), F.lit(max(0, dims[0] - 2))).cast("long"))
    taps = g.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("w", F.when(F.col("d") == 1, F.col("at") - F.col("u0")).otherwise(1 - F.col("at") + F.col("u0")))
    taps = taps.select("angle", *AXES, (F.col("u0") + F.col("d")).alias("u"), "w")
    return taps.join(p, ["angle", "u", "z"]).groupBy(*AXES).agg((F.sum(F.col("w") * val()) / len(angles)).alias("value"))


def bricked(v: DataFrame, size: int = 32) -> DataFrame:
    """Brick columns bx, by, bz, by which volumes are stored and pruned."""
    return v.withColumns({"b" + a: F.floor(F.col(a) / size).cast("long") for a in AXES})


def with_halo(v: DataFrame, size: int, halo: int = 1) -> DataFrame:
    """Each voxel in its brick and in those whose halo it is in: for kernels by applyInPandas on a brick."""
    for a in AXES:
        low, high = F.floor((F.col(a) - halo) / size), F.floor((F.col(a) + halo) / size)
        v = v.withColumn("b" + a, F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    return v


def bricks_in_region(manifest: DataFrame, box: Sequence[float]) -> DataFrame:
    """Bricks (x0, y0, z0, x1, y1, z1) that overlap a half-open box."""
    keep = F.lit(True)
    for i, a in enumerate(AXES):
        keep = keep & (F.col(a + "0") < box[i + 3]) & (F.col(a + "1") > box[i])
    return manifest.filter(keep)


def bricks_in_frustum(manifest: DataFrame, planes: Sequence[Sequence[float]]) -> DataFrame:
    """Bricks with a corner on the inner side of every plane (a, b, c, d), a x + b y + c z + d >= 0: its farthest corner decides."""
    keep = F.lit(True)
    for p in planes:
        far = F.lit(float(p[3]))
        for k, a in zip(p, AXES):
            far = far + k * F.col(a + ("1" if k >= 0 else "0"))
        keep = keep & (far >= 0)
    return manifest.filter(keep)
