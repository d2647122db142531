import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.functions import catalog as C
from skarn.functions.names import known, name_key, near, path_key, split_key
from skarn.operators import augment, curves, estimate, fits, metrics, reports
from skarn.operators import vectors as V
from skarn.operators.catalog import entries, entry_groups
from skarn.operators.graph import connected_components
from skarn.operators.neighbours import nearest
from skarn.operators.prefix import grouped_prefix
from skarn.operators.prepare import group_split, merged_limits, parent_by_stillness
from skarn.operators.spelling import near_words
from skarn.operators.units import common_units, length_unit, parse_unit, read_statement, scale_class
from skarn.plans import frames_pack, relational_pack, spatial_pack
from skarn.sources import readers, writers


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_spelling(spark):
    assert column(spark, [" Big-Robots ", "", None, "--", "ÄB 1"], "string", name_key) == ["bigrobots", None, None, None, "äb1"]
    assert column(spark, ["./A\\b c / D.urdf ", "", None, "a//b"], "string", path_key) == ["a/b_c/d.urdf", None, None, "a/b"]
    assert column(spark, ["TRAIN ", "valid", "Test", None, "odd"], "string", split_key) == ["train", "val", "test", None, "odd"]
    assert column(spark, ["N/A", " ", None, "x"], "string", known) == [None, None, None, "x"]
    pairs = [("robotarm", "robtarm", True), ("robotarm", "orbotarm", True), ("robotarm", "robotarms", True), ("robotarm", "robotleg", False), ("arm_v2", "arm_v3", False), ("robotarm_left", "robotarm_4f", False), ("x", "x", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.filter(near(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_near_words_find_every_slip(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (6, 9, 10, 11, 12, 13, 20) for _ in range(4)]
    asked = []
    for w in words:
        i = rng.randrange(len(w) - 1)
        asked += [w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]]
    a = spark.createDataFrame([("s", x, w) for x, w in zip(asked, [w for w in words for _ in range(4)])], "s string, w string, want string")
    b = spark.createDataFrame([("s", w) for w in words] + [("other", asked[0]), ("s", None)], "s string, w string")
    got = near_words(a, b, ["s"], "w").withColumnRenamed("match", "want")
    assert a.distinct().join(got, ["s", "w", "want"], "left_anti").count() == 0


def test_near_words_find_slips_in_suffixes(spark):
    pairs = [("atlas_descripton", "atlas_description"), ("atlasdescription", "atlas_description"), ("atlas_ddescription", "atlas_description"), ("atlas_decsription", "atlas_description"), ("scen_atlas", "scene_atlas")]
    a = spark.createDataFrame([("s", x, y) for x, y in pairs], "s string, w string, want string")
    b = spark.createDataFrame([("s", y) for _, y in pairs] + [("s", f"other{i}_description") for i in range(9)], "s string, w string")
    got = {(r.w, r.match) for r in near_words(a, b, ["s"], "w").collect()}
    assert got == {p for p in pairs if p != ("scen_atlas", "scene_atlas")}  # parts of up to four letters must agree


def test_classification(spark):
    paths = ["src/foo_arm/foo.xml", "src/foo_arm/scene.xml", "a/urdfs/robots/foo/foo.urdf", "u/urdf_files/random/robot-assets/foo/foo.urdf", "b/data/bar/bar.urdf", "b/examples/pybullet/gym/pybullet_data/x.urdf", "r/robosuite/models/assets/robots/iiwa/robot.xml", "m/x_support/go.urdf", "plain.urdf"]
    assert column(spark, paths, "string", C.path_tail) == ["foo_arm/foo.xml", "foo_arm/scene.xml", "foo/foo.urdf", "foo/foo.urdf", "bar/bar.urdf", "x.urdf", "iiwa/robot.xml", "x_support/go.urdf", "plain.urdf"]
    assert column(spark, paths, "string", C.model_leaf) == ["foo", "foo_arm", "foo", "foo", "bar", "pybullet_data", "iiwa", "x", "plain"]
    assert column(spark, paths, "string", C.is_scene) == [False, True] + [False] * 7
    assert column(spark, [0, 1, 499_999, 500_000, 5_000_000, None], "bigint", C.fidelity_of_bytes) == ["unknown", "low", "low", "medium", "high", "unknown"]
    assert column(spark, [0.0, 0.29, 0.3, 1.0, 2.5, 2.51, 50.0, 50.1, None], "double", scale_class) == ["unknown", "compact", "tabletop", "fullsize", "fullsize", "huge", "huge", "unit_bug", "unknown"]
    assert column(spark, ["The MIT License", "gnu general public license version 3", "", None], "string", C.licence_of) == ["MIT", "GPL-3.0", "Unknown", "Unknown"]
    rows = [("ok", 6, 8, 2, True), ("ok", 6, 3, 2, False), ("ok", 0, 3, 0, False), ("ok", 2, 0, 0, False), ("load_failed: x", 6, 8, 0, False), (None, None, None, None, False)]
    df = spark.createDataFrame(rows, "s string, d int, r int, u int, want boolean")
    assert df.filter(C.trainable(*[F.col(c) for c in "sdru"]) != F.col("want")).count() == 0
    joints = [(0, -1.0, 1.0, 2.0), (0, -1e6, 1e6, 6.283186), (1, None, None, 6.283186), (2, 0.0, 0.5, 0.5), (2, -1e6, 1e6, 10.0), (0, None, None, 0.0), (3, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(joints, "k int, lo double, hi double, want double")
    assert df.filter(F.abs(C.joint_span(F.col("k"), F.col("lo"), F.col("hi")) - F.col("want")) > 1e-9).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, None), (7, 7)] + [(2000, 2001 + i) for i in range(50)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_components_of_all_supplier_part_links(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randint(1, 80), rng.randint(1, 150), rng.randint(1, 50), i) for i in range(90)] + [(None, 3, 1, 1), (4, None, 1, 1)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity int, l_orderkey int").write.parquet(str(tmp_path / "lineitem.parquet"))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for s, p, _, _ in rows:
        if s is not None and p is not None:
            x, y = find(f"S{s}"), find(f"P{p}")
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in relational_pack.supplier_part_components(spark, str(tmp_path)).collect()}
    assert got == {x: find(x) for x in up} and len(set(got.values())) > 5


def test_groups_and_deliveries(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [
        (1, "s/a/a.urdf", "G1", None, t(1)), (1, "s/a/a.urdf", "G1", None, t(2)), (2, "s/b/b.urdf", " g1", None, t(1)), (3, "s/c/c.urdf", None, "./S/B/B.urdf", t(1)), (4, "s/d/d.urdf", "", "s/gone.urdf", t(1)),
        (5, "s/e/e.urdf", None, "s/gone.urdf", t(1)), (6, None, "unknown", None, t(1)), (7, None, "unknown", " ", None), (None, "x", "G1", None, t(1)),
    ]
    cat = spark.createDataFrame(rows, "entry_id bigint, path string, dedup_group_id string, dup_of string, ingested_at timestamp").withColumn("group_id", F.lit("clash"))
    e = entries(cat)
    assert e.count() == 7 and e.filter("entry_id = 1").first().ingested_at == t(2)
    assert {r.entry_id: r.group_id for r in entry_groups(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert entry_groups(e.limit(0)).count() == 0


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(7)
    want, n, s = {}, {}, {}
    for i, g, v in rows:
        n[g] = n.get(g, 0) + 1
        want[i] = (n[g], s.get(g, 0))
        s[g] = s.get(g, 0) + (v or 0)
    assert {r.id: (r["rank"], r.before) for r in grouped_prefix(df, ["g"], ["id"], "v").collect()} == want


@pytest.mark.parametrize("word,unit", [("mm", "mm"), ("Zentimetern", "cm"), ("milímetros", "mm"), ("inches", "in"), ("Zollmaße", "in"), ("feet", "ft"), ("SI", "m"), ("metres", "m"), ("kg", None), ("min", None), ("drawing", None), ("m2", None), ("", None), ("decimetres", "dm"), ("yards", "yd"), ("km", "km"), ("µm", "um"), ("nanometres", "nm")])
def test_unit_words(word, unit):
    assert length_unit(word) == unit


def test_ambiguous_units():
    assert parse_unit("min", "time")[0] == 60 and parse_unit("min", "length")[1] == "length" and parse_unit("mm²")[2] == 2


@pytest.mark.parametrize("note,stated", [
    ("was in cm, box converted to m", "m"), ("unit fixed: now metres (was mm)", "m"), ("inch drawing, box already converted to metres", "m"), ("shell thickness 3 mm", None), ("1 unit = 1 cm", "cm"), ("AABB (in.)", "in"), ("Maße in mm angegeben", "mm"),
    ("lengths: mm; masses: kg", "mm"), ("size given in thousandths of a metre", "mm"), ("mesh exported at 1000:1, box left unscaled", "mm"), ("converted from inches in 2024", None), ("cutter diameter 1/4 in", None), ("one unit is one inch", "in"), ("", None), (None, None), ("x" * 5000, None),
    ("not in mm", None), ("values in mm, formerly cm", "mm"), ("units: decimetres", "dm"), ("box is not in cm but in mm", "mm"), ("in mm instead of inches", "mm"), ("originally in feet, now in m", "m"), ("min 3 sets, kin chain", None),
])
def test_statements(note, stated):
    assert read_statement(note)[0] == stated


def test_hilbert_places_decode_to_their_cells(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i % 3, [rng.random() for _ in range(3)]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = spatial_pack.hilbert_places(spark, str(tmp_path)).collect()
    assert len(got) == 200 and all(r.round_trip for r in got)
    assert (curves.hilbert_points(np.array([r.hilbert for r in got]), 8) == [[r.gx, r.gy, r.gz] for r in got]).all()


def test_common_units(spark):
    E = "entry_id bigint, source string, notes string, scale_class string, aabb_extent_m array<double>, unit string"
    rows = [
        (1, "Mil", None, None, [500.0, 400.0, 300.0], "clash"), (2, "mil", "extents in metres", None, [0.5, 0.4, 0.3], None), (3, "met", None, "50.1 cm", [0.501, 0.4, 0.3], None), (4, "met", None, "max 50.1 cm", [50.1, 40.0, 30.0], None),
        (5, "met", "1.2 x 0.4 x 0.3 m overall", None, [1200.0, 400.0, 300.0], None), (6, "nix", None, "tabletop", [0.7, 0.5, 0.1], None), (7, "nix", None, None, None, None), (8, "nix", None, None, [0.0, 0.0, 0.0], None), (9, "nix", None, None, [], None),
        (10, None, None, None, [float("nan"), None, 2.0], None), (11, "nix", None, None, [501.2, 400.0, 300.0], None),
        (12, "mil", "extents in yards", None, [2.0, 1.0, 1.0], None), (13, "mil", "units: decimetres", "tabletop", [7.0, 1.0, 1.0], None),
    ]
    ref = spark.createDataFrame([("mil", "millimetres", None), ("met", None, "probe prints metres"), ("nix", None, None)], "source string, length_unit string, remark string")
    groups = spark.createDataFrame([(i, 3 if i == 11 else i) for i in range(1, 12)], "entry_id bigint, group_id bigint")
    got = {r.entry_id: r for r in common_units(spark.createDataFrame(rows, E), ref, groups).collect()}
    assert {k: r.unit for k, r in got.items()} == {1: "mm", 2: "m", 3: "m", 4: "cm", 5: "mm", 6: "m", 10: "m", 11: "mm", 12: "yd", 13: "dm"}
    assert got[12].extent_m[0] == pytest.approx(1.8288) and got[13].longest_m == pytest.approx(0.7)
    assert got[1].extent_m == pytest.approx([0.5, 0.4, 0.3]) and got[1].size_class == "tabletop" and got[5].evidence == "measured"
    assert common_units(spark.createDataFrame([], E), ref, groups).count() == 0


def test_curves(spark):
    pts = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (3, 5, 6)]
    df = spark.createDataFrame(pts, "x int, y int, z int")
    got = [tuple(r) for r in df.select(curves.morton(F.col("x"), F.col("y"), F.col("z"), 4), curves.morton(F.col("y"), F.col("x"), F.col("z"), 4)).collect()]
    assert got == [(4, 2), (2, 4), (1, 1), (238, 350)]
    p = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    codes = curves.hilbert_codes(p, 3)
    assert sorted(codes) == list(range(512)) and (curves.hilbert_points(codes, 3) == p).all()
    along = p[np.argsort(codes)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()  # the curve never jumps
    cloud = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 0), ("c", 0), ("c", 1), ("c", 2), ("c", 3)], "c string, p int")
    got = curves.patches(cloud, "c", "p", 4)
    assert got.filter("c = 'a'").count() == 12 and sorted(r.p for r in got.filter("borrowed").collect()) == [6, 7] and got.filter("c <> 'a'").count() == 5


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, 3)), np.concatenate([rng.normal(size=(60, 3)), [[50.0, 50, 50]]])
    q = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)] + [(99, None, 0.0, 0.0)], "id int, x double, y double, z double")
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(b)], "pid int, x double, y double, z double")
    got = {(r.id, r.place): r.pid for r in nearest(q, p, 3, 0.2).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert got == {(i, k + 1): int(j) for i in range(40) for k, j in enumerate(np.argsort(d[i])[:3])}
    assert nearest(q, p.limit(2), 3, 0.2).count() == 80 and nearest(q.limit(0), p, 3, 0.2).count() == 0


def test_percentiles_and_modes(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b"]), rng.choice([None, *range(20)])) for _ in range(500)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    got = {r.g: r for r in reports.spread(df, ["g"], "v").collect()}
    for g in "ab":
        own = [v for k, v in rows if k == g and v is not None]
        assert (got[g].low, got[g].median, got[g].p90, got[g].high) == pytest.approx((min(own), np.median(own), np.percentile(own, 90), max(own)))
    assert reports.exact_percentiles(df, [], "v", {"m": 0.5}).first().m == np.median([v for _, v in rows if v is not None])
    m = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("x", 1), ("x", -1), ("x", -1), ("x", -1), ("y", -1)], "g string, l int")
    assert [tuple(r) for r in reports.mode_lowest(m, ["g"], "l").collect()] == [("x", 1, 2)]
    n = reports.next_rows(spark.createDataFrame([("k", 2, 5.0), ("k", 1, 3.0), (None, 1, 1.0)], "k string, o int, v double"), "k", ["o"], "v").orderBy("place").collect()
    assert [(r.v, r.next, r.first) for r in n] == [(3.0, 5.0, 3.0), (5.0, None, 3.0)]


def test_geometry(spark):
    one = spark.range(1)
    v = lambda *x: V.vec(*[F.lit(float(a)) for a in x])
    r = one.select(
        V.line_distance(v(0, 0, 0), v(1, 0, 0), v(0, 0, 2), v(0, 1, 0)).alias("a"), V.line_distance(v(0, 0, 0), v(1, 0, 0), v(0, 3, 4), v(1, 0, 0)).alias("b"), V.axis_angle_error(v(1, 0, 0), v(-1, 1, 0)).alias("c"),
        V.roll_pitch_yaw(V.rodrigues(v(0, 0, 1), F.lit(0.5)))[2].alias("d"), V.turn_angle(V.matmul(V.rodrigues(v(0, 1, 0), F.lit(0.3)), V.rodrigues(v(0, 1, 0), F.lit(0.4)))).alias("e"), V.quaternion(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("q"),
        V.reprojection_error(v(0, 0, -1), v(0, 0), 1, 0, 0).alias("f"), V.onto_axis(v(1, 2, 3), v(0, 0, 0), v(0, 0, 2)).alias("g"), V.unit(v(0, 0, 0)).alias("u"),
    ).first()
    assert (r.a, r.b, r.c) == pytest.approx((2, 5, 45)) and (r.d, r.e) == pytest.approx((0.5, 0.7)) and r.q == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1], abs=1e-12)
    assert r.f == math.inf and r.g == [0, 0, 3] and r.u == [None] * 3


def test_estimates():
    a = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    b = np.array([[1, 2, 3], [1, 3, 3], [0, 2, 3], [1, 2, 4.0]])
    r, t = estimate.rigid_fit(a, b)
    assert t == pytest.approx([1, 2, 3]) and np.allclose(a @ r.T + t, b)
    s = estimate.screw(r, t)
    assert s["kind"] == "revolute" and s["amount"] == pytest.approx(math.pi / 2) and np.abs(s["axis"]) == pytest.approx([0, 0, 1])
    assert estimate.screw(np.eye(3), np.array([0, 0, 2.0]))["kind"] == "prismatic" and estimate.screw(np.eye(3), np.zeros(3))["kind"] == "fixed"
    u = np.arange(12) * math.pi / 6
    f = estimate.circle_fit(np.stack([1 + 0.5 * np.cos(u), 2 + 0.5 * np.sin(u), np.full(12, 3.0)], 1))
    assert f["centre"] == pytest.approx([1, 2, 3]) and f["radius"] == pytest.approx(0.5) and f["score"] == pytest.approx(1)
    assert estimate.circle_fit(np.zeros((2, 3)))["residual"] == math.inf
    assert estimate.clean_fragments([1, 1, 1, 2, 2, 1, 2, 2, 2, 3], [(i, i + 1) for i in range(9)]) == [1, 1, 1, 2, 2, 2, 2, 2, 2, 3]
    assert estimate.infer_tree({(1, 2): 1, (2, 3): 1}, {1: 3, 2: 6, 3: 1}) == {2: -1, 1: 2, 3: 2}
    assert len(estimate.axis_rotations()) == 24
    rng = np.random.default_rng(1)
    p = rng.normal(size=(120, 3))
    q, w = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    poses = np.stack([p, np.concatenate([p[:60] @ q.T + 1, p[60:] + [0, 0, 2]])])
    body = estimate.segment_bodies(poses, 1e-6, 10)
    assert len(set(body[:60])) == len(set(body[60:])) == 1 and body[0] != body[60] and (body >= 0).all()
    r, t, rms = estimate.icp(p, p + [0.02, 0, 0])
    assert rms < 1e-6 and t == pytest.approx([0.02, 0, 0], abs=1e-6)
    keep = estimate.punch_holes(p, 0.8, 20, 0.3, 1)
    assert 0.7 <= keep.mean() < 1


def test_bodies_of_all_poses_and_refined_triples(spark, tmp_path):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(40, 3))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    steps = [p if k < 9 else np.concatenate([p[:20], p[20:] @ turn.T + [3, 0, 0]]) for k in range(21)]
    rows = [(0, i, [float(x) for s in steps for x in s[i]] + [0.5]) for i in range(40)]
    spark.createDataFrame(rows, "label int, vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    body = {r.vec_id: r.body for r in frames_pack.segmented_bodies(spark, str(tmp_path)).collect()}
    assert len({body[i] for i in range(20)}) == len({body[i] for i in range(20, 40)}) == 1 and body[0] != body[20] and min(body.values()) >= 0
    q = rng.normal(size=(30, 3))
    noisy = np.stack([q] + [q @ turn.T + rng.normal(size=q.shape) * 0.02 for _ in range(4)])
    assert (estimate.segment_bodies(noisy, 0.07, 10, tries=3) >= 0).sum() >= 29
    close = np.array([[0, 0, 0], [0.001, 0, 0], [0, 0.001, 0], [1.0, 0, 0], [0, 1, 0], [2, 0, 0]])
    assert set(estimate.spread_triple(close[[0, 1, 3, 4]], 0.02, rng)) >= {2, 3}
    assert estimate.spread_triple(close[:3], 0.02, rng) is None and estimate.spread_triple(close[[0, 3, 5]], 0.02, rng) is None


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.5, True), (2, 1, 2.0, True), (0, -1, 9.0, False)], "p int, l int, d double, ok boolean")
    r = df.agg(metrics.accuracy(F.col("p"), F.col("l")).alias("a"), metrics.masked_mean(metrics.smooth_l1(F.col("d")), F.col("ok")).alias("s")).first()
    assert (r.a, r.s) == pytest.approx((0.5, (0.125 + 1.5) / 2))
    none = df.limit(0).agg(metrics.accuracy(F.col("p"), F.col("l")).alias("a"), metrics.masked_mean(F.col("d"), F.col("ok")).alias("m")).first()
    assert (none.a, none.m) == (0.0, 0.0)


def test_limits_and_splits(spark):
    rows = [("j1", (-1.0, 1.0), None, (0.0, 0.0), None), ("j2", None, (-2.0, 2.0), (0.0, 0.0), (-0.5, 3.0)), ("j3", None, None, (-0.2, 0.4), None), ("j4", None, (1.0, 2.0), (0.0, 0.0), (-1.0, 0.5))]
    pair = "struct<lower: double, upper: double>"
    df = spark.createDataFrame(rows, f"j string, o {pair}, t {pair}, s {pair}, c {pair}")
    got = {r.j: (r.m.lower, r.m.upper) for r in df.select("j", merged_limits(*[F.col(k) for k in "otsc"]).alias("m")).collect()}
    assert got["j1"] == (-1, 1) and got["j2"] == (-0.5, 2) and got["j3"] == pytest.approx((-1.1, 1.3)) and got["j4"] == (-1, 0.5)
    d = spark.createDataFrame([(f"k{s}_{i}", str(s)) for s in (25, 15, 5, 2, 1) for i in range(s)], "k string, s string")
    n = {r.s: r.n for r in group_split(d, "k", "s", 0.1).filter("part = 'val'").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert n == {"25": 2, "15": 2, "5": 1, "2": 1}


def test_samples(spark):
    d = spark.createDataFrame([(g, i) for g, n in (("a", 100), ("b", 7)) for i in range(n)], "g string, i int").withColumn("id", F.xxhash64("g", "i"))
    n = {r.g: r.n for r in augment.drop_share(d, ["g"], "id", 0.3, 1).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 70, "b": 5}
    r = augment.resample(d, ["g"], "id", 20, 1)
    assert {x.g: (x.n, x.s) for x in r.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("s")).collect()} == {"a": (20, 20), "b": (20, 20)}
    f = spark.createDataFrame([("m", i, float(i)) for i in range(10)], "m string, f int, area double")
    s = augment.surface_points(f, "m", "f", "area", 1000, 3)
    assert s.count() == 1000 and s.filter("a < 0 or b < 0 or a + b > 1 or f = 0").count() == 0
    assert abs(s.filter("f = 9").count() - 200) < 12


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"source": "s", "path": "s/a/a.urdf", "dof": 6, "joint_types": ["revolute"]}, {"source": "t", "extra": 1}]))
    m = readers.read_manifest(spark, str(tmp_path / "m.json"))
    assert m.count() == 2 and m.filter("dof = 6").first().joint_types == ["revolute"]
    writers.write_manifest(m, str(tmp_path / "out"))
    assert spark.read.schema(readers.MANIFEST).json(str(tmp_path / "out")).exceptAll(m).count() == 0
    writers.write_csv(m, str(tmp_path / "csv"), ["path", "total_mass", "unheard"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["path", "total_mass", "unheard"]
    xml = '<robot name="r"><link name="a"><inertial><mass value="1.5"/></inertial></link><link name="b"/><joint name="j" type="revolute"><parent link="a"/><child link="b"/><limit lower="-1" upper="2"/></joint></robot>'
    x = {r.i: r for r in readers.scan_robot_xml(spark.createDataFrame([(1, xml), (2, "nonsense"), (3, None)], "i int, x string"), "i", "x").collect()}
    assert (x[1].dof, x[1].links, x[1].total_mass, x[1].root, x[1].meshes) == (1, 2, 1.5, "a", []) and x[2].status == x[3].status == "parse_failed"
    j = spark.createDataFrame([("r", 0, 1, "revolute", [0.0, 0.0, 1.0], [0.0, 0.0, 1.0], -1.0, 2.0), ("r", 1, 2, "fixed", [0.0] * 3, [1.0, 0.0, 0.0], 0.0, 0.0)], "k string, parent int, child int, type string, origin array<double>, axis array<double>, lower double, upper double")
    back = readers.scan_robot_xml(writers.robot_xml(j, "k"), "k", "xml").first()
    assert (back.links, back.dof, back.root) == (3, 1, "link_0")
    (tmp_path / "cam.json").write_text(json.dumps([{"id": 3, "width": 640, "height": 480, "position": [1, 2, 3], "rotation": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "fx": 500}]))
    c = readers.read_cameras(spark, str(tmp_path / "cam.json"), "3dgs").first()
    assert (c.name, c.fy, c.cx, c.cy, c["shift"]) == ("00003", 500, 320, 240, [-1, -2, -3])
    (tmp_path / "ns.json").write_text(json.dumps({"fl_x": 100, "cx": 5, "cy": 6, "w": 10, "h": 12, "frames": [{"file_path": "img/f1.png", "transform_matrix": [[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]}]}))
    c = readers.read_cameras(spark, str(tmp_path / "ns.json"), "nerfstudio").first()
    assert (c.name, c.fx, c.fy, c.width, c["shift"]) == ("f1", 100, 100, 10, [-1, 2, 3])
    with pytest.raises(ValueError):
        readers.read_cameras(spark, "x", "odd")
    assert readers.read_limits(spark, "joints: {a: {lower: -1, upper: 1}, b: {lower: 2, upper: 1}, c: {lower: 0, upper: .inf}}").count() in (0, 1)
    assert readers.read_limits(spark, "][").count() == 0
    t = "x\n=====\nLicense for contents in the directory 'foo/'\n====\nMIT License ...\n====\nLicense for contents in the directory 'bar'\n====\nnothing known\n"
    assert {tuple(r) for r in readers.licence_blocks(spark.createDataFrame([(t,)], "t string"), "t").collect()} == {("foo", "MIT"), ("bar", "Unknown")}
    files = spark.createDataFrame([("s/pkg/meshes/a.stl",), ("s/r/b.stl",), ("z/deep/meshes/c.stl",)], "path string")
    refs = spark.createDataFrame([("s/pkg/urdf/r.urdf", "package://pkg/meshes/a.stl"), ("s/r/r.urdf", "b.stl"), ("s/r/r.urdf", "package://q/meshes/c.stl"), ("s/r/r.urdf", "none.stl")], "owner string, ref string")
    assert {r.ref: r.found for r in readers.resolve_meshes(refs, files).collect()} == {"package://pkg/meshes/a.stl": "s/pkg/meshes/a.stl", "b.stl": "s/r/b.stl", "package://q/meshes/c.stl": "z/deep/meshes/c.stl", "none.stl": None}
    seq = readers.image_sequences(spark.createDataFrame([("x/joint_2/state1.png",), ("x/joint_2/state0.png",), ("x/joint_3/state0.png",), ("x/other.png",)], "path string")).collect()
    assert [(r.joint, len(r.images)) for r in seq] == [(1, 2)]
    for name, body in (("src/a/A.urdf", "<robot/>"), ("src/a/b.xml", "<mujoco/>"), ("src/a/c.xml", "<config/>")):
        f = tmp_path / "raw" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    assert {(r.source, r.path, r.format) for r in readers.discover(spark, str(tmp_path / "raw")).collect()} == {("src", "src/a/A.urdf", "urdf"), ("src", "src/a/b.xml", "xml")}
    writers.write_shards(spark.range(25).withColumnRenamed("id", "k"), "k", str(tmp_path / "shards"), 10)
    assert {r.shard: r["count"] for r in spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().collect()} == {"shard_000000": 10, "shard_000001": 10, "shard_000002": 5}
    assert json.loads(writers.stats_json(spark.createDataFrame([("a",), ("a",), (None,)], "l string"), "l").first().json) == {"a": 2}
    assert writers.markdown_lines(spark.createDataFrame([("a|b", None)], "x string, y int"), ["x", "y"]).first().line == "| a\\|b |  |"


def test_stream(spark, tmp_path):
    from skarn.streaming.counts import windowed_counts

    rows = [(dt.datetime(2025, 1, 1, h), "a", 1.0) for h in (0, 0, 1, 5)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, value double")
    df.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "k").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start.hour, r.n) for r in spark.table("counts").collect()} == {(0, 2), (1, 1), (5, 1)} == {(r.start.hour, r.n) for r in windowed_counts(df, "ts", "k").collect()}


def test_label_merge(spark):
    from skarn.operators.labels import changed_labels, inside_polygon, merge_labels, mesh_volumes, whole_faces

    rows = [("m", i, 1 if i < 10 else 2 if i < 14 else 3 if i < 16 else -1, 5 if i in (0, 1, 2, 3, 10) else None) for i in range(17)]
    df = spark.createDataFrame(rows, "mesh string, face int, cluster int, user int")
    got = {r.face: r.label for r in merge_labels(df, "mesh", "face", "cluster", "user").collect()}
    assert [got[i] for i in range(17)] == [5] * 11 + [6] * 3 + [7] * 2 + [-1]
    tie = spark.createDataFrame([("m", i, 1, 4 if i < 3 else None) for i in range(10)], "mesh string, face int, cluster int, user int")
    assert [r.label for r in merge_labels(tie, "mesh", "face", "cluster", "user").orderBy("face").collect()] == [4] * 3 + [5] * 7
    assert merge_labels(df.limit(0), "mesh", "face", "cluster", "user").count() == 0
    ch = changed_labels(spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", None, None)], "g string, x int, y int"), ["g"], "x", "y").first()
    assert (ch.rows, ch.changed, ch.labels_before, ch.labels_after) == (3, 1, 1, 2)
    pts = spark.createDataFrame([(0.5, 0.5, True), (1.5, 0.5, False), (0.2, 1.9, True), (1.8, 1.9, False)], "x double, y double, want boolean")
    assert pts.filter(inside_polygon(F.col("x"), F.col("y"), [(0, 0), (1, 0), (1, 1), (0.5, 2), (0, 2)]) != F.col("want")).count() == 0
    v = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0, 1), ("m", 1, 1.0, 0.0, 0.0, 1), ("m", 2, 0.0, 1.0, 0.0, 1), ("m", 3, 0.0, 0.0, 1.0, 2)], "mesh string, v int, x double, y double, z double, label int")
    f = spark.createDataFrame([("m", 0, 0, 2, 1), ("m", 1, 0, 1, 3), ("m", 2, 0, 3, 2), ("m", 3, 1, 2, 3)], "mesh string, face int, v0 int, v1 int, v2 int")
    assert [tuple(r) for r in whole_faces(f, v).collect()] == [("m", 0, 1)]
    m = mesh_volumes(f, v).first()
    assert (m.volume, m.cx) == pytest.approx((1 / 6, 0.25))


def test_name_repair(spark):
    from skarn.operators.names_repair import ordered_dedup, repair_names

    R = "name string, new_name string, dof int, joint_types array<string>, source string"
    c = spark.createDataFrame([("a/x", "a/p/x", 2, ["r", "p"], "s1"), ("a/x", "a/q/x", 2, ["p", "r"], "s2"), ("a/x", "a/z/x", 3, ["r"] * 3, "s1"), ("b/y", "b/p/y", 1, ["r"], "s1")], R)
    r = spark.createDataFrame([(1, "a/x", 2, ["p", "r"]), (2, "a/x", 3, ["r"] * 3), (3, "a/x", 9, None), (4, "b/y", None, None), (5, "n/n", 1, [])], "id int, name string, dof int, joint_types array<string>")
    got = {x.id: (x.name, x.repaired) for x in repair_names(r, c, spark.createDataFrame([("s2", 1), ("s1", 2)], "source string, rank int")).collect()}
    assert got == {1: ("a/q/x", True), 2: ("a/z/x", True), 3: ("a/x", False), 4: ("b/p/y", True), 5: ("n/n", False)}
    d = spark.createDataFrame([("A", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert {r.v for r in ordered_dedup(d, "k", ["o"]).collect()} == {"y", "z"}


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_frames_and_json(spark):
    from skarn.operators import frames

    turn = [float(x) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)]
    rows = [(f"n{i}", f"n{i - 1}" if i else None, turn, [1.0, 0.0, 0.0]) for i in range(9)] + [("own", "own", turn, [0.0] * 3), ("lost", "gone", turn, [5.0, 0.0, 0.0])]
    got = {r.node: r.t for r in frames.compose_frames(spark.createDataFrame(rows, "n string, p string, r array<double>, t array<double>"), "n", "p", "r", "t").collect()}
    at, m = np.zeros(3), np.eye(3)
    for i in range(9):
        at, m = at + m @ [1, 0, 0], m @ np.array(turn).reshape(3, 3)
        assert got[f"n{i}"] == pytest.approx(list(at))
    assert got["lost"] == [5, 0, 0] and len(got) == 11
    with pytest.raises(RuntimeError):
        frames.compose_frames(spark.createDataFrame([("a", "b", turn, [0.0] * 3), ("b", "a", turn, [0.0] * 3)], "n string, p string, r array<double>, t array<double>"), "n", "p", "r", "t", 4)
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.9, 0.0, 0.0), (3, 1.8, 0.0, 0.0), (4, 5.0, 0.0, 0.0), (5, None, 0.0, 0.0)], "k int, x double, y double, z double")
    assert {(r.a, r.b) for r in frames.pairs_within(p, "k", 1.0).collect()} == {(1, 2), (2, 3)}
    assert {r.k: r.body for r in frames.merge_close(p, "k", 1.0).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2}
    c = frames.read_critiques(spark.createDataFrame([('{"issues": [{"severity": "high"}], "auto_fix_merges": [{"target": 1, "sources": [2]}, {"sources": [3]}, {"target": 4, "sources": []}]}',), ("no json",), (None,)], "t string"), "t").collect()
    assert [r.severe for r in c] == [True, False, False] and len(c[0].critique.auto_fix_merges) == 1
    q = frames.read_priors(spark.createDataFrame([('{"confidence": 0.7, "expected_dof": 6}',), ("{}",), (None,)], "t string"), "t").collect()
    assert [r.trusted for r in q] == [True, False, False] and q[0].prior.expected_dof == 6 and q[1].prior.expected_chain_topology == "serial"


def test_scenes(spark):
    rng = np.random.default_rng(4)
    cloud = rng.normal(size=(30, 3))
    rots = [estimate.rigid_fit(cloud, cloud + 0.05 * rng.normal(size=(30, 3)))[0] for _ in range(9)]
    assert np.allclose(estimate.mean_rotation(np.array([np.eye(3)] * 3)), np.eye(3)) and np.allclose(estimate.mean_rotation(np.array(rots)), np.eye(3), atol=0.05)
    assert estimate.spread_triple(np.zeros((5, 3)), 0.02, rng) is None and estimate.spread_triple(np.eye(3), 0.02, rng) is not None
    p = rng.normal(size=(30, 3))
    rows = [("s", i, [*map(float, q), *map(float, q + (1 if i < 15 else 0))]) for i, q in enumerate(p)] + [("s", 30, None), ("s", 31, [0.0]), ("t", 0, [0.0] * 6)]
    got = {(r.s, r.v): r.body for r in estimate.scene_bodies(spark.createDataFrame(rows, "s string, v int, poses array<double>"), "s", "v", "poses", 1e-6, 5).collect()}
    assert len({got["s", i] for i in range(15)}) == 1 and len({got["s", i] for i in range(15, 30)}) == 1 and got["s", 0] != got["s", 20] and got["s", 30] == got["s", 31] == got["t", 0] == -1
    w = spark.createDataFrame([("a", 1, 2, 3), ("a", 2, 3, 5), ("a", 1, 3, 1)], "s string, la int, lb int, weight int")
    assert {r.label: r.parent for r in estimate.scene_trees(w, "s").collect()} == {2: -1, 1: 2, 3: 2}
    c = spark.createDataFrame([(i % 2, i, *map(float, q)) for i, q in enumerate(p)], "c int, k int, x double, y double, z double")
    h = estimate.holed(c, "c", "k", 0.7, 5, 0.3, 1)
    assert 21 <= h.count() <= 30 and {r.k for r in h.collect()} == {r.k for r in estimate.holed(c.repartition(3), "c", "k", 0.7, 5, 0.3, 1).collect()}


def test_fits_from_sums_are_those_of_the_points(spark):
    rng = np.random.default_rng(3)
    rows, clouds = [], {}
    for g in range(4):
        turn = estimate.rigid_fit(rng.normal(size=(9, 3)), rng.normal(size=(9, 3)))[0]
        a = rng.normal(size=(30, 3))
        b = a @ turn.T + rng.normal(size=3) + rng.normal(size=(30, 3)) * 0.01
        clouds[g] = (a, b)
        rows += [(g, *map(float, p), *map(float, q), "clash") for p, q in zip(a, b)]
    df = spark.createDataFrame([*rows, (0, None, 1.0, 1.0, 1.0, 1.0, 1.0, "x")], "g int, x double, y double, z double, u double, v double, w double, n string")
    for r in fits.rigid_fits(df.drop("n"), ["g"]).collect():
        turn, shift = estimate.rigid_fit(*clouds[r.g])
        assert np.allclose(np.array(r.rotation).reshape(3, 3), turn, atol=1e-8) and np.allclose(r["shift"], shift, atol=1e-8)
        left = np.linalg.norm(clouds[r.g][0] @ turn.T + shift - clouds[r.g][1], axis=1)
        assert r.residual == pytest.approx(np.sqrt((left**2).mean()), abs=1e-6)
    t = np.linspace(0, 5, 40)
    circle = np.stack([2 * np.cos(t) + 1, 2 * np.sin(t) + 3, 0.2 * rng.normal(size=40)], 1)
    sets = {"ring": circle, "cloud": clouds[0][0], "two": circle[:2]}
    df = spark.createDataFrame([(k, *map(float, p)) for k, v in sets.items() for p in v], "k string, x double, y double, z double")
    got = {r.k: r for r in fits.circle_fits(df, ["k"]).collect()}
    for k in ("ring", "cloud"):
        want = estimate.circle_fit(sets[k])
        assert got[k].radius == pytest.approx(want["radius"]) and np.allclose(got[k].centre, want["centre"]) and got[k].score == pytest.approx(want["score"])
        assert abs(np.dot(got[k].normal, want["normal"])) == pytest.approx(1)
    assert got["two"].radius == 0 and got["two"].residual == float("inf") and got["two"].score == 0
    assert fits.circle_fits(df.limit(0), ["k"]).count() == 0


def test_joints_of_boundaries(spark):
    ring = [("m", 0, 1, 12, math.cos(i), math.sin(i), 0.0) for i in range(12)]
    few = [("m", 1, 2, 2, 1.0, 0.0, 1.0), ("m", 1, 2, 2, 0.0, 1.0, 1.0)]
    b = spark.createDataFrame(ring + few, "mesh string, la int, lb int, edges bigint, x double, y double, z double")
    c = spark.createDataFrame([("m", 0, [0.0, 0.0, 1.0]), ("m", 1, [0.0, 0.0, -1.0]), ("m", 2, [2.0, 0.0, -1.0])], "mesh string, label int, centre array<double>")
    got = {r.lb: r for r in fits.boundary_joints(b, c).collect()}
    assert got[1].kind == "revolute" and got[1].axis == pytest.approx([0, 0, -1]) and got[1].radius == pytest.approx(1) and got[1].origin == pytest.approx([0, 0, 0], abs=1e-9)
    assert got[2].kind == "fixed" and got[2].origin == [1.0, 0.0, -1.0] and got[2].confidence == 0


def test_fragments_follow_their_edges(spark):
    l = spark.createDataFrame([("m", f, x) for f, x in enumerate([0, 0, 1, 0, 1, 1])] + [("e", 0, 2), ("m", 9, None)], "mesh string, face bigint, label int")
    e = spark.createDataFrame([("m", 0, 1), ("m", 1, 2), ("m", 2, 3), ("m", 3, 4), ("m", 4, 5)], "mesh string, f1 bigint, f2 bigint")
    got = {(r.mesh, r.face): r.cleaned for r in estimate.cleaned_labels(l, e).collect()}
    assert got == {("m", f): x for f, x in enumerate(estimate.clean_fragments([0, 0, 1, 0, 1, 1], [(i, i + 1) for i in range(5)]))} | {("e", 0): 2}


def test_parents_match_brute_force(spark):
    rng = random.Random(4)
    odd = lambda: rng.choice([None, float("nan"), float("inf"), -3.5, 0.0] + [rng.randint(-3, 4) * 0.125 for _ in range(12)])
    cells = {(b % 3 if b != 50 else None, b, t, i): odd() for b in range(60) for t in (None, "a", "b", "c") for i in range(2) if rng.random() < 0.4}
    cells |= {(0, 60, "z", 0): 1.0, (0, 63, "z", 0): None, (0, 63, "a", 0): 2.0, (1, 61, None, 0): 1.0, (0, None, "a", 0): 1.0}
    rows = [(s, b, t, v) for (s, b, t, _), v in cells.items()]
    spark.createDataFrame(rows, "s int, b bigint, t string, v double").createOrReplaceTempView("motion")
    m = spark.table("motion")
    want = spark.sql("""with p as (select s, b, round(sum(v), 2) as total from motion group by all), v as (select s, b, t, sum(v) as v from motion group by all),
      d as (select a.b as child, o.b as parent, round(sum(x.v * y.v), 2) as dot from p a join p o on a.s = o.s and o.total < a.total join v x on x.b = a.b join v y on y.b = o.b and x.t = y.t group by all),
      r as (select *, row_number() over (partition by child order by dot desc nulls last, parent) as rn from d)
      select p.b, r.parent from p left join r on r.child = p.b and rn = 1""").collect()
    for block in (7, 2048):
        got = parent_by_stillness(m, "s", "b", "t", "v", block).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and sum(r.parent is not None for r in got) > 30
    assert parent_by_stillness(m.limit(0), "s", "b", "t", "v").count() == 0


def test_parents_write_no_pairs(spark):
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    m = spark.range(6000).select(F.lit(1).alias("s"), (F.col("id") % 2000).alias("b"), (F.col("id") % 3).alias("t"), (F.xxhash64("id") % 100000 / 100).alias("v"))
    before = written()
    assert parent_by_stillness(m, "s", "b", "t", "v").filter("parent is null").count() >= 1
    assert written() - before < 2_000_000  # 2 million pairs would be more
