"""Readers and writers of volume, mesh, point, contour, log and archive files.

A reader takes files through Spark's binaryFile or text source, so any store that Spark reads will do, and decodes them on
the executors: one file is one unit of decoding. A registry dispatches by extension; ``file|object`` names an object in a
file. Volume windows are pushed to the decoder, which copies only the window's slabs out of the buffer.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CELLS, VERTICES, VOXELS

#: Voxel types by number in multi-variable files, big-endian.
TYPES = {1: ">u1", 2: ">u2", 3: ">u4", 4: ">f4", 5: ">f8"}
NAMES = {">u1": "uchar", ">u2": "ushort", ">u4": "uint", ">f4": "float", ">f8": "double"}
RAWV_MAGIC = 0xBAADBEEF
META = "path string, var int, name string, t int, nx long, ny long, nz long, minx double, miny double, minz double, maxx double, maxy double, maxz double, voxel_type string"


class Block:
    """One variable at one time of a volume file."""

    def __init__(self, var, name, t, dims, box, dtype, offset):
        self.var, self.name, self.t, self.dims, self.box, self.dtype, self.offset = var, name, t, dims, box, dtype, offset

    def array(self, data: bytes) -> np.ndarray:
        nx, ny, nz = self.dims
        return np.frombuffer(data, self.dtype, nx * ny * nz, self.offset).reshape(nz, ny, nx)


def rawiv_blocks(data: bytes) -> list[Block]:
    """Single-variable grid: 68 bytes of big-endian header; the type follows from the size."""
    head = struct.unpack(">6f2I3I3f3f", data[:68])
    dims = head[8:11]
    n = dims[0] * dims[1] * dims[2]
    size = (len(data) - 68) // max(1, n)
    kind = {1: ">u1", 2: ">u2", 4: ">f4", 8: ">f8"}.get(size)
    if kind is None:
        raise ValueError("not a rawiv file")
    return [Block(0, "", 0, dims, head[:6], kind, 68)]


def rawiv_bytes(values: np.ndarray, box: Sequence[float]) -> bytes:
    nz, ny, nx = values.shape
    kind = {"u1": ">u1", "u2": ">u2", "f8": ">f8"}.get(values.dtype.str[1:], ">f4")
    span = [(box[i + 3] - box[i]) / max(1, d - 1) for i, d in enumerate((nx, ny, nz))]
    cells = max(0, nx - 1) * max(0, ny - 1) * max(0, nz - 1)
    return struct.pack(">6f2I3I3f3f", *box, nx * ny * nz, cells, nx, ny, nz, *box[:3], *span) + values.astype(kind).tobytes()


def rawv_blocks(data: bytes) -> list[Block]:
    """Variables and timesteps: header, a record for each variable, then each variable's timesteps."""
    magic, nx, ny, nz, times, count = struct.unpack(">6I", data[:24])
    if magic != RAWV_MAGIC:
        raise ValueError("not a rawv file")
    ends, offset, out = struct.unpack(">8f", data[24:56]), 56 + 65 * count, []
    box = (*ends[:3], *ends[4:7])
    for var in range(count):
        at = 56 + 65 * var
        kind, name = TYPES[data[at]], data[at + 1 : at + 65].split(b"\0")[0].decode("latin-1")
        for t in range(times):
            out.append(Block(var, name, t, (nx, ny, nz), box, kind, offset))
            offset += nx * ny * nz * np.dtype(kind).itemsize
    return out


def rawv_bytes(blocks: Sequence[tuple[str, Sequence[np.ndarray]]], box: Sequence[float]) -> bytes:
    """blocks: (name, arrays by time) of each variable."""
    nz, ny, nx = blocks[0][1][0].shape
    times, codes = len(blocks[0][1]), {v: k for k, v in TYPES.items()}
    kind = lambda a: {"u1": ">u1", "u2": ">u2", "u4": ">u4", "f8": ">f8"}.get(a.dtype.str[1:], ">f4")
    out = struct.pack(">6I8f", RAWV_MAGIC, nx, ny, nz, times, len(blocks), *box[:3], 0.0, *box[3:], float(times - 1))
    for name, arrays in blocks:
        out += bytes([codes[kind(arrays[0])]]) + name.encode("latin-1")[:63].ljust(64, b"\0")
    return out + b"".join(a.astype(kind(arrays[0])).tobytes() for _, arrays in blocks for a in arrays)


def spider_blocks(data: bytes) -> list[Block]:
    """EM volume: float header of whole records (slices, rows, ..., columns as 12th, header bytes as 22nd), either byte order."""
    for order in "<>":
        head = np.frombuffer(data, order + "f4", 27)
        nz, ny, nx, size = int(abs(head[0])), int(head[1]), int(head[11]), int(head[21])
        if nx > 0 and ny > 0 and nz > 0 and size + 4 * nx * ny * nz == len(data):
            return [Block(0, "", 0, (nx, ny, nz), (0.0, 0.0, 0.0, nx - 1.0, ny - 1.0, nz - 1.0), order + "f4", size)]
    raise ValueError("not a SPIDER volume")


def npy_blocks(data: bytes) -> list[Block]:
    """2-D arrays as volumes of one slice."""
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version[0] == 1 else np.lib.format.read_array_header_2_0)(f)
    if fortran or len(shape) != 2:
        raise ValueError("only 2-D arrays in C order")
    return [Block(0, "", 0, (shape[1], shape[0], 1), (0.0, 0.0, 0.0, shape[1] - 1.0, shape[0] - 1.0, 0.0), kind.str, f.tell())]


def unsupported(data: bytes):
    raise NotImplementedError("VTK volumes can't be read")


VOLUMES: dict[str, Callable[[bytes], list[Block]]] = {"rawiv": rawiv_blocks, "rawv": rawv_blocks, "vol": spider_blocks, "spi": spider_blocks, "npy": npy_blocks, "vtk": unsupported}


def register_volume(extension: str, reader: Callable[[bytes], list[Block]]) -> None:
    VOLUMES[extension.lower()] = reader


def split_object(path: str) -> tuple[str, str | None]:
    """file|object."""
    file, _, name = path.partition("|")
    return file, name or None


def extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def read_volume(spark: SparkSession, path: str, var: int | None = None, t: int | None = None, window: Sequence[int] | None = None, box: Sequence[float] | None = None) -> DataFrame:
    """Voxels of a file or folder of files: all, one variable and time, an index window (x0, y0, z0, x1, y1, z1, ends included) or a world box."""
    file, name = split_object(path)

    def decode(frames: Iterator[pd.DataFrame]):
        for f in frames:
            for p, data in zip(f["path"], f["content"]):
                for b in VOLUMES[extension(p)](data):
                    if (var is None or b.var == var) and (t is None or b.t == t) and (name is None or b.name == name):
                        yield from slabs(p, b, data, window or (index_window(b, box) if box else (0, 0, 0, *(d - 1 for d in b.dims))))

    return spark.read.format("binaryFile").load(file).select("path", "content").mapInPandas(decode, VOXELS)


def index_window(b: Block, box: Sequence[float]) -> tuple[int, ...]:
    if any(box[i] < b.box[i] or box[i + 3] > b.box[i + 3] for i in range(3)):
        raise ValueError("the box isn't within the volume's")
    s = [(b.box[i + 3] - b.box[i]) / (b.dims[i] - 1) if b.dims[i] > 1 else 1.0 for i in range(3)]
    return (*(int(np.ceil((box[i] - b.box[i]) / s[i] - 1e-9)) for i in range(3)), *(int(np.floor((box[i + 3] - b.box[i]) / s[i] + 1e-9)) for i in range(3)))


def slabs(path: str, b: Block, data: bytes, w: Sequence[int]):
    a = b.array(data)
    y, x = np.mgrid[w[1] : w[4] + 1, w[0] : w[3] + 1]
    for z in range(w[2], w[5] + 1):
        v = a[z, w[1] : w[4] + 1, w[0] : w[3] + 1]
        yield pd.DataFrame({"vol_id": path, "var": b.var, "t": b.t, "x": x.ravel(), "y": y.ravel(), "z": z, "value": v.ravel().astype(float)})


def volume_info(spark: SparkSession, path: str) -> DataFrame:
    """Dimensions, box and type of each variable and time."""

    def info(frames):
        for f in frames:
            rows = [(p, b.var, b.name, b.t, *b.dims, *map(float, b.box), NAMES.get(b.dtype, b.dtype)) for p, data in zip(f["path"], f["content"]) for b in VOLUMES[extension(p)](data)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in META.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(info, META)


def write_volume(voxels: DataFrame, path: str, dims: Sequence[int], box: Sequence[float], kind: str = "f4") -> None:
    """One rawiv file on the driver's store; larger volumes are written as Parquet by brick instead."""
    out = np.zeros((dims[2], dims[1], dims[0]), kind)
    for r in voxels.select("x", "y", "z", "value").toLocalIterator():
        out[r["z"], r["y"], r["x"]] = r["value"]
    with open(path, "wb") as f:
        f.write(rawiv_bytes(out, box))


def write_bricks(voxels: DataFrame, path: str, size: int = 32) -> None:
    """Parquet partitioned by brick, for pruned window reads."""
    from ..operators.volume import bricked

    bricked(voxels, size).repartition("bx", "by", "bz").write.partitionBy("bx", "by", "bz").parquet(path)


def read_bricks(spark: SparkSession, path: str, window: Sequence[int], size: int = 32) -> DataFrame:
    """Index window of a bricked volume: bricks are pruned, then voxels filtered."""
    v = spark.read.parquet(path)
    for i, a in enumerate("xyz"):
        v = v.filter(F.col("b" + a).between(window[i] // size, window[i + 3] // size)).filter(F.col(a).between(window[i], window[i + 3]))
    return v.drop("bx", "by", "bz")


# --- meshes ----------------------------------------------------------------------------------------------------------


def parse_off(text: str):
    words = (w for line in text.splitlines() for w in line.split("#")[0].split())
    if not next(words).endswith("OFF"):
        raise ValueError("not an OFF file")
    n, m, _ = (int(next(words)) for _ in range(3))
    points = [tuple(float(next(words)) for _ in range(3)) for _ in range(n)]
    lines = [x for x in text.splitlines() if x.split("#")[0].strip()][2 + n : 2 + n + m]
    return points, [tuple(map(int, x.split()[1 : 1 + int(x.split()[0])])) for x in lines]


def parse_raw(text: str, normals: bool = False, colors: bool = False):
    """Counts, then points (with normals and colours), then cells."""
    rows = [x.split() for x in text.splitlines() if x.strip()]
    n, m = int(rows[0][0]), int(rows[0][1])
    cells = [tuple(map(int, r)) for r in rows[1 + n : 1 + n + m]]
    low = min((min(c) for c in cells if c), default=0)
    del normals, colors  # further columns are not part of the position
    return [tuple(map(float, r[:3])) for r in rows[1 : 1 + n]], [tuple(i - (1 if low == 1 and max(map(max, cells)) == n else 0) for i in c) for c in cells]


def parse_obj(text: str):
    points, cells = [], []
    for line in text.splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            points.append(tuple(map(float, w[1:4])))
        elif w[:1] == ["f"]:
            at = [int(x.split("/")[0]) for x in w[1:]]
            cells.append(tuple(i - 1 if i > 0 else len(points) + i for i in at))
    return points, cells


def parse_ply(text: str):
    head, _, body = text.partition("end_header")
    if "format ascii" not in head:
        raise ValueError("only ASCII PLY")
    n, m = int(re.search(r"element vertex (\d+)", head)[1]), int((re.search(r"element face (\d+)", head) or [0, 0])[1])
    rows = [x.split() for x in body.splitlines() if x.strip()]
    return [tuple(map(float, r[:3])) for r in rows[:n]], [tuple(map(int, r[1 : 1 + int(r[0])])) for r in rows[n : n + m]]


def parse_stl(text: str):
    points = [tuple(map(float, m)) for m in re.findall(r"vertex\s+(\S+)\s+(\S+)\s+(\S+)", text)]
    return points, [(i, i + 1, i + 2) for i in range(0, len(points), 3)]


def parse_bunny(text: str):
    """Built-in test mesh: an octahedron."""
    points = [(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, -1.0)]
    return points, [(a, b, c) if (a == 0) ^ (b == 3) ^ (c == 5) else (a, c, b) for a in (0, 1) for b in (2, 3) for c in (4, 5)]


MESHES: dict[str, Callable[[str], tuple]] = {"off": parse_off, "raw": parse_raw, "rawn": lambda t: parse_raw(t, True), "rawc": lambda t: parse_raw(t, False, True), "rawnc": lambda t: parse_raw(t, True, True), "obj": parse_obj, "ply": parse_ply, "stl": parse_stl, "bunny": parse_bunny}


def register_mesh(ext: str, parser: Callable[[str], tuple]) -> None:
    MESHES[ext.lower()] = parser


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and cells of mesh files; a file is a mesh."""
    text = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))

    def vertices(frames):
        for f in frames:
            yield pd.DataFrame([(p, i, *v) for p, t in zip(f["path"], f["text"]) for i, v in enumerate(MESHES[extension(p)](t)[0])], columns=["mesh_id", "vid", "x", "y", "z"])

    def cells(frames):
        kinds = {2: "line", 3: "tri", 4: "quad", 8: "hex"}
        for f in frames:
            yield pd.DataFrame([(p, kinds.get(len(c), "poly"), i, list(c), 0) for p, t in zip(f["path"], f["text"]) for i, c in enumerate(MESHES[extension(p)](t)[1])], columns=["mesh_id", "kind", "cid", "corner", "material"])

    return text.mapInPandas(vertices, VERTICES), text.mapInPandas(cells, CELLS)


def off_text(points: Sequence[Sequence[float]], cells: Sequence[Sequence[int]]) -> str:
    return "\n".join(["OFF", f"{len(points)} {len(cells)} 0", *(" ".join(map(repr, map(float, p))) for p in points), *(f"{len(c)} " + " ".join(map(str, c)) for c in cells)]) + "\n"


# --- points, contours, images ----------------------------------------------------------------------------------------


def read_point_classes(spark: SparkSession, path: str) -> DataFrame:
    """class, color, variable, timestep, i, j, k of XML files, repeated points once; object-space lists have one class."""

    def parse(frames):
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"]):
                if extension(p) == "pts":
                    words = data.decode().split()
                    xyz = list(map(float, words[1 : 1 + 3 * int(words[0])]))
                    rows += [("", "", 0, 0, *xyz[i : i + 3]) for i in range(0, len(xyz), 3)]
                else:
                    for c in ElementTree.fromstring(data).iter("pointclass"):
                        seen = dict.fromkeys(tuple(map(float, q.text.split())) for q in c.iter("point"))
                        rows += [(c.get("name"), c.get("color"), int(c.get("variable")), int(c.get("timestep")), *q) for q in seen]
            yield pd.DataFrame(rows, columns=["class", "color", "variable", "timestep", "i", "j", "k"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "class string, color string, variable int, timestep int, i double, j double, k double")


def point_classes_xml(rows: Sequence[tuple]) -> str:
    """XML of (class, color, variable, timestep, i, j, k) rows."""
    root, at = ElementTree.Element("pointclassdoc"), {}
    for name, color, variable, timestep, *p in rows:
        key = (name, color, variable, timestep)
        if key not in at:
            at[key] = ElementTree.SubElement(root, "pointclass", {"name": name, "color": color, "variable": str(variable), "timestep": str(timestep)})
        ElementTree.SubElement(at[key], "point").text = " ".join(f"{c:g}" for c in p)
    return "<!DOCTYPE pointclassdoc>\n" + ElementTree.tostring(root, encoding="unicode")


def read_contours(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, include: str | None = None, exclude: str | None = None, min_points: int = 0) -> DataFrame:
    """slice, z, component, poly and xy of Reconstruct sections (NAME.N, XML), filtered by slice, component name and size."""

    def parse(frames):
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"]):
                root = ElementTree.fromstring(re.sub(rb"<!DOCTYPE[^>]*>", b"", data))
                for k, c in enumerate(root.iter("Contour")):
                    pts = [tuple(map(float, q.split())) for q in c.get("points", "").split(",") if q.strip()]
                    thick = float(root.get("thickness", "1"))
                    rows.append((int(root.get("index", "0")), int(root.get("index", "0")) * thick, c.get("name"), k, c.get("hidden") == "true", c.get("closed") != "false", [{"x": x, "y": y} for x, y in pts]))
            yield pd.DataFrame(rows, columns=["slice", "z", "component", "poly", "hidden", "closed", "xy"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "slice int, z double, component string, poly int, hidden boolean, closed boolean, xy array<struct<x:double,y:double>>")
    out = out.filter("not hidden and closed").filter(F.size("xy") >= max(3, min_points))
    for c, keep in ((F.col("slice") >= first if first is not None else None, True), (F.col("slice") <= last if last is not None else None, True), (F.col("component").rlike(include) if include else None, True), (~F.col("component").rlike(exclude) if exclude else None, True)):
        out = out.filter(c) if c is not None and keep else out
    return out.drop("hidden", "closed")


def contour_counts(contours: DataFrame) -> DataFrame:
    return contours.agg(F.count("*").alias("polygons"), F.sum(F.size("xy")).alias("vertices"), F.array_sort(F.collect_set("component")).alias("components"))


def pgm_array(data: bytes) -> np.ndarray:
    m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    return np.frombuffer(data, "u1" if int(m[3]) < 256 else ">u2", int(m[1]) * int(m[2]), m.end()).reshape(int(m[2]), int(m[1]))


def pgm_bytes(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.astype("u1").tobytes()


def slices_to_volume(spark: SparkSession, path: str) -> DataFrame:
    """Grayscale images as z slices, in the order of their paths."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = sorted(r[0] for r in files.select("path").collect())  # names only
    order = spark.createDataFrame(list(zip(names, range(len(names)))), "path string, z long")

    def decode(frames):
        for f in frames:
            for z, data in zip(f["z"], f["content"]):
                a = pgm_array(data)
                y, x = np.indices(a.shape)
                yield pd.DataFrame({"x": x.ravel(), "y": y.ravel(), "z": z, "value": a.ravel().astype(float)})

    return files.join(F.broadcast(order), "path").select("z", "content").mapInPandas(decode, "x long, y long, z long, value double")


def volume_to_slices(v: DataFrame) -> DataFrame:
    """(z, content): PGM images of the slices, values normalised to 0..255; a slice is a group."""
    from ..operators.volume import normalize

    def one(f: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(f["y"].max()) + 1, int(f["x"].max()) + 1))
        a[f["y"], f["x"]] = f["value"]
        return pd.DataFrame({"z": [f["z"].iloc[0]], "content": [pgm_bytes(a)]})

    return normalize(v, 0, 255).select("x", "y", "z", "value").groupBy("z").applyInPandas(one, "z long, content binary")


# --- logs, trees, archives --------------------------------------------------------------------------------------------


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """tick, t, arm, agent, column, value of JSON Lines logs; null is a missing value; a truncated last line is dropped. The header names the columns."""
    lines = spark.read.text(path, wholetext=True)

    def parse(frames):
        for f in frames:
            rows = []
            for text in f["value"]:
                columns, tick = [], 0
                for line in text.splitlines():
                    try:
                        r = json.loads(line)
                    except ValueError:
                        continue
                    if "agent_columns" in r:
                        columns = r["agent_columns"]
                    elif r.get("kind") == "tick":
                        for arm, agents in enumerate(r["agents"]):
                            for agent, values in enumerate(agents):
                                rows += [(tick, float(r["t"]), arm, agent, c, v) for c, v in zip(columns, values)]
                        tick += 1
            yield pd.DataFrame(rows, columns=["tick", "t", "arm", "agent", "column", "value"]).astype({"value": "float64"})

    return lines.mapInPandas(parse, "tick long, t double, arm int, agent int, column string, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_input_trace(spark: SparkSession, path: str) -> DataFrame:
    """set, event and check records by tick."""
    return spark.read.schema("tick long, kind string, name string, value string").json(path)


def tree_json(rows: DataFrame) -> DataFrame:
    """One nested JSON text of a state tree (path, value); a tree is one group."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}
        for path, value in sorted(zip(f["path"], f["value"])):
            node = root
            for part in path.split("."):
                node = node.setdefault("children", {}).setdefault(part, {})
            node["value"] = value
        return pd.DataFrame({"json": [json.dumps(root, sort_keys=True)]})

    return rows.withColumn("_k", F.lit(1)).groupBy("_k").applyInPandas(one, "json string")


def parse_tree(text: str) -> list[tuple[str, str]]:
    out, stack = [], [("", json.loads(text))]
    while stack:
        path, node = stack.pop()
        if path and "value" in node:
            out.append((path, node["value"]))
        stack += [(f"{path}.{k}" if path else k, n) for k, n in node.get("children", {}).items()]
    return sorted(out)


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content of tar (plain, gz, bz2, xz), zip, gzip and zstd files."""

    def members(frames):
        for f in frames:
            for p, data in zip(f["path"], f["content"]):
                yield pd.DataFrame([(p, n, c) for n, c in archive_members(p, data)], columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, content binary")


def archive_members(path: str, data: bytes) -> list[tuple[str, bytes]]:
    base = path.rsplit("/", 1)[-1]
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(n, z.read(n)) for n in z.namelist() if not n.endswith("/")]
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        data, base = zstandard.ZstdDecompressor().decompressobj().decompress(data), base.removesuffix(".zst")
    elif data[:2] == b"\x1f\x8b":
        data, base = gzip.decompress(data), base.removesuffix(".gz")
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return [(m.name, t.extractfile(m).read()) for m in t if m.isfile()]
    except tarfile.ReadError:
        return [(base, data)]


def pack_tar(members: Sequence[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()
