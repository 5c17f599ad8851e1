"""File readers by round trips, streams against batch results."""

import gzip
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import state as T
from orrery.plans.bindings import mutations
from orrery.sources import files as S
from orrery.streaming import state_stream as ST

BOX = (0.0, 0.0, 0.0, 3.0, 2.0, 1.0)


@pytest.fixture
def values():
    return np.arange(24, dtype="f4").reshape(2, 3, 4)


def test_rawiv_windows(spark, tmp_path, values):
    p = tmp_path / "a.rawiv"
    p.write_bytes(S.rawiv_bytes(values, BOX))
    v = S.read_volume(spark, str(p))
    assert {(r["x"], r["y"], r["z"]): r["value"] for r in v.collect()} == {(x, y, z): values[z, y, x] for z in range(2) for y in range(3) for x in range(4)}
    assert S.read_volume(spark, str(p), window=(1, 1, 0, 2, 2, 0)).count() == 4
    assert S.read_volume(spark, str(p), box=(0.5, 0.0, 0.0, 2.0, 1.0, 1.0)).count() == 8
    with pytest.raises(Exception, match="within the volume"):
        S.read_volume(spark, str(p), box=(-1.0, 0.0, 0.0, 2.0, 1.0, 1.0)).count()
    info = S.volume_info(spark, str(p)).first()
    assert (info["nx"], info["ny"], info["nz"], info["voxel_type"], info["maxx"]) == (4, 3, 2, "float", 3.0)
    S.write_volume(v, str(tmp_path / "b.rawiv"), (4, 3, 2), BOX)
    assert (tmp_path / "b.rawiv").read_bytes() == p.read_bytes()
    S.write_bricks(v, str(tmp_path / "bricks"), 2)
    assert S.read_bricks(spark, str(tmp_path / "bricks"), (1, 0, 0, 2, 1, 1), 2).count() == 8


def test_rawv_variables_and_times(spark, tmp_path, values):
    p = tmp_path / "a.rawv"
    p.write_bytes(S.rawv_bytes([("density", [values, values + 1]), ("kind", [values.astype("u1"), values.astype("u1")])], BOX))
    assert S.read_volume(spark, str(p)).count() == 96
    assert S.read_volume(spark, str(p), var=0, t=1).agg(F.sum("value")).first()[0] == values.sum() + 24
    assert S.read_volume(spark, f"{p}|kind").select("var").distinct().collect()[0][0] == 1


def test_npy_spider_vtk(spark, tmp_path, values):
    np.save(tmp_path / "a.npy", values[0])
    assert S.read_volume(spark, str(tmp_path / "a.npy")).count() == 12
    head = np.zeros(256, "<f4")
    head[[0, 1, 11, 21]] = 2, 3, 4, 1024
    (tmp_path / "a.spi").write_bytes(head.tobytes() + values.astype("<f4").tobytes())
    assert S.read_volume(spark, str(tmp_path / "a.spi")).agg(F.sum("value")).first()[0] == values.sum()
    (tmp_path / "a.vtk").write_bytes(b"x")
    with pytest.raises(Exception, match="VTK"):
        S.read_volume(spark, str(tmp_path / "a.vtk")).count()


def test_meshes(spark, tmp_path):
    pts, cells = S.parse_bunny("")
    (tmp_path / "a.off").write_text(S.off_text(pts, cells))
    v, c = S.read_mesh(spark, str(tmp_path / "a.off"))
    assert v.count() == 6 and c.count() == 8 and c.filter("kind = 'tri'").count() == 8
    assert S.parse_obj("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 -1\n") == ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])
    assert S.parse_ply("ply\nformat ascii 1.0\nelement vertex 3\nelement face 1\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")[1] == [(0, 1, 2)]
    assert len(S.parse_stl("solid\nfacet\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendfacet\n")[0]) == 3
    assert S.parse_raw("3 1\n0 0 0\n1 0 0\n0 1 0\n0 1 2\n")[1] == [(0, 1, 2)]


def test_points_contours_images(spark, tmp_path):
    rows = [("A & B", "#fff", 0, 1, 1.0, 2.0, 3.0), ("A & B", "#fff", 0, 1, 1.0, 2.0, 3.0)]
    (tmp_path / "a.vgr").write_text(S.point_classes_xml(rows))
    assert [tuple(r) for r in S.read_point_classes(spark, str(tmp_path / "a.vgr")).collect()] == rows[:1]
    (tmp_path / "a.pts").write_text("2\n0 0 0\n1 2 3\n")
    assert S.read_point_classes(spark, str(tmp_path / "a.pts")).count() == 2
    (tmp_path / "s.1").write_text('<Section index="1" thickness="0.5"><Contour name="axon" hidden="false" closed="true" points="0 0, 1 0, 1 1,"/><Contour name="x" hidden="true" closed="true" points="0 0, 1 0, 1 1,"/></Section>')
    c = S.read_contours(spark, str(tmp_path / "s.1"), include="^ax")
    assert S.contour_counts(c).first()["vertices"] == 3 and c.first()["z"] == 0.5
    d = tmp_path / "slices"
    d.mkdir()
    for z in range(2):
        (d / f"{z}.pgm").write_bytes(S.pgm_bytes(np.full((2, 3), 10 * z + 5)))
    v = S.slices_to_volume(spark, str(d))
    assert v.filter("z = 1").select("value").distinct().first()[0] == 15
    assert S.volume_to_slices(v).count() == 2


def test_logs_and_archives(spark, tmp_path):
    (tmp_path / "run.jsonl").write_text('{"agent_columns": ["x", "v"]}\n{"kind": "tick", "t": 0.1, "agents": [[[1, null]]]}\n{"kind": "ti')
    got = S.read_run_log(spark, str(tmp_path / "run.jsonl")).orderBy("column").collect()
    assert [(r["column"], r["value"]) for r in got] == [("v", None), ("x", 1.0)]
    rows = [("a", "1"), ("a.b", "2"), ("c.d", "3")]
    text = S.tree_json(spark.createDataFrame(rows, "path string, value string")).first()[0]
    assert S.parse_tree(text) == rows
    tar = S.pack_tar([("m.txt", b"hi")])
    assert S.archive_members("a.tar", tar) == [("m.txt", b"hi")] == S.archive_members("a.tar.gz", gzip.compress(tar))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.txt", "hi")
    assert S.unpack(spark, str(tmp_path / "a.zip")).first()["content"] == b"hi"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = mutations(spark, sf_dir)
    batch.repartition(3).write.parquet(str(tmp_path / "m"))
    stream = ST.replay(spark, str(tmp_path / "m"), batch.schema)
    ST.run_to_table(ST.newest(ST.admitted(stream, ["click"])), "newest")
    last = spark.table("newest").groupBy("path").agg(F.max_by("value", F.struct("hlc", "origin", "sequence")).alias("value"))
    want = T.newest(T.interested(batch, ["click"])).select("path", "value")
    assert sorted(last.collect()) == sorted(want.collect())
    ST.run_to_table(ST.latency_histogram(stream, "origin", "value"), "hist", "complete")
    assert spark.table("hist").agg(F.sum("n")).first()[0] == batch.count()
