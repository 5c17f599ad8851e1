"""Data model: column layouts of the engine's tables and small helpers on them.

Volumes are long tables ``vol_id, x, y, z, value`` (x fastest) with one metadata row each; meshes are ``vertices`` and
``cells``; state is a stream of mutations; run logs are long tables by tick, arm and agent. Missing values are null inside
the engine; sentinels and NaN are converted at its edges by :func:`from_sentinel` and :func:`to_sentinel`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOXELS = "vol_id string, var int, t int, x long, y long, z long, value double"
VOLUME_META = "vol_id string, nx long, ny long, nz long, minx double, miny double, minz double, maxx double, maxy double, maxz double, voxel_type string"
VERTICES = "mesh_id string, vid long, x double, y double, z double"
CELLS = "mesh_id string, kind string, cid long, corner array<long>, material int"
POLYGONS = "poly_id long, ring int, pos int, x long, y long"
MUTATIONS = "cluster string, origin string, sequence long, hlc long, path string, op string, value string, arrival long"
TELEMETRY = "node string, ts_ns long, published long, applied long, enqueue_ns long, delivery_ns long"
RUN_TICKS = "episode string, arm int, agent int, tick long, t double, x double, y double, heading double, speed double, mode int, reached boolean"
AXES = ("x", "y", "z")
#: Ranges of the unsigned and signed voxel types.
RANGES = {"uchar": (0, 255), "ushort": (0, 65535), "uint": (0, 4294967295), "char": (-128, 127), "int": (-2147483648, 2147483647)}


def from_sentinel(c: Column | str, sentinel: float) -> Column:
    """Null for NaN and for a sentinel such as -1, 1e20 or 1e30."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (c != F.lit(sentinel)), c)


def to_sentinel(c: Column | str, sentinel: float) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(sentinel))


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def as_voxel_type(value: Column | str, kind: str, outside: str = "raise") -> Column:
    """Conversion as the voxel types define it: integers truncate towards zero and must be in range; with ``outside="keep"`` those out of range stay as they are, truncated."""
    if outside not in ("raise", "keep"):
        raise ValueError("outside is raise or keep")
    c = F.col(value) if isinstance(value, str) else value
    if kind in ("float", "double"):
        return c.cast(kind)
    low, high = RANGES[kind]
    whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    if outside == "keep":
        return whole.cast("long")
    return F.when(whole.between(low, high), whole.cast("long")).otherwise(F.raise_error(F.lit(f"value outside of {kind}")).cast("long"))


def index_of(nx: int, ny: int) -> Column:
    """Flat index of a voxel, x fastest."""
    return F.col("x") + F.col("y") * nx + F.col("z") * (nx * ny)


def from_index(i: Column | str, nx: int, ny: int) -> list[Column]:
    i = F.col(i) if isinstance(i, str) else i
    return [(i % nx).alias("x"), (F.floor(i / nx) % ny).cast("long").alias("y"), F.floor(i / (nx * ny)).cast("long").alias("z")]


def grid(spark, nx: int, ny: int, nz: int) -> DataFrame:
    """Every voxel of a grid, generated by the executors."""
    return spark.range(nx * ny * nz).select(*from_index("id", nx, ny))


def parse_dimension(text: str) -> tuple[int, int, int]:
    """"x,y,z"."""
    x, y, z = (int(p) for p in text.split(","))
    return x, y, z


def parse_box(text: str) -> tuple[float, ...]:
    """"minx,miny,minz,maxx,maxy,maxz"."""
    parts = tuple(float(p) for p in text.split(","))
    if len(parts) != 6:
        raise ValueError("a box has six parts")
    return parts


def span(box: Sequence[float], dims: Sequence[int]) -> tuple[float, ...]:
    """World distance between neighbouring voxels."""
    return tuple((box[i + 3] - box[i]) / (dims[i] - 1) if dims[i] > 1 else 0.0 for i in range(3))


def world(box: Sequence[float], dims: Sequence[int]) -> list[Column]:
    """World coordinates of voxels."""
    s = span(box, dims)
    return [(F.lit(box[i]) + F.col(a) * s[i]).alias("w" + a) for i, a in enumerate(AXES)]


def in_box(box: Sequence[float], cols: Sequence[Column | str] = AXES) -> Column:
    """Closed box test."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return cols[0].between(box[0], box[3]) & cols[1].between(box[1], box[4]) & cols[2].between(box[2], box[5])


def box_within(inner: Sequence[float], outer: Sequence[float]) -> bool:
    return all(outer[i] <= inner[i] and inner[i + 3] <= outer[i + 3] for i in range(3))


def box_union(a: Sequence[float], b: Sequence[float]) -> tuple[float, ...]:
    return (*(min(a[i], b[i]) for i in range(3)), *(max(a[i + 3], b[i + 3]) for i in range(3)))
