"""Meshes of faces, rotations, cameras, motions and joints."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import augment as A
from skarn.operators import estimate as S
from skarn.operators import fits as T
from skarn.operators import frames as K
from skarn.operators import labels as L
from skarn.operators import metrics as M
from skarn.operators import vectors as V
from skarn.operators.curves import bit_depth, grid
from skarn.operators.neighbours import nearest
from skarn.operators.prefix import grouped_prefix
from skarn.operators.reports import mode_lowest
from skarn.sources.tables import materialize, newest, read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_P = "(select vec_id, label, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z, list_transform(embedding, lambda v: cast(v as double)) as e from embeddings)"


def _xyz(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return e.select("vec_id", "label", *[F.col("e")[i].alias(n) for i, n in enumerate("xyz")], "e")


# meshes: parts as the vertices of grids of 20 x 20, two faces per square
_F = """(select p_partkey // 400 as mesh, 2 * (p_partkey % 400) + k as face, case k when 0 then i else i + 1 end as v0, case k when 0 then i + 1 else i + 21 end as v1, i + 20 as v2, cast((s + k) % 4 - 1 as integer) as label
  from (select p_partkey, p_partkey % 400 as i, p_size as s, unnest([0, 1]) as k from part) where i % 20 < 19 and i < 380)"""
_E = f"(select mesh, face, label, unnest([struct_pack(a := least(v0, v1), b := greatest(v0, v1)), struct_pack(a := least(v1, v2), b := greatest(v1, v2)), struct_pack(a := least(v0, v2), b := greatest(v0, v2))], recursive := true) from {_F})"
_ADJ = f"(select x.mesh, x.face as f1, y.face as f2, x.a, x.b, x.label as l1, y.label as l2 from {_E} x join {_E} y on x.mesh = y.mesh and x.a = y.a and x.b = y.b and x.face < y.face)"


def _faces(spark, sf):
    p = read_table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").alias("s"))
    i = F.col("i")
    f = p.select(F.floor(F.col("k") / 400).alias("mesh"), (F.col("k") % 400).alias("i"), "s", F.explode(F.array(F.lit(0), F.lit(1))).alias("two"))
    f = f.filter("i % 20 < 19 and i < 380")
    return f.select("mesh", (2 * i + F.col("two")).alias("face"), (i + F.col("two")).alias("v0"), F.when(F.col("two") == 0, i + 1).otherwise(i + 21).alias("v1"), (i + 20).alias("v2"), ((F.col("s") + F.col("two")) % 4 - 1).cast("int").alias("label"))


def _corners(spark, sf):
    p = read_table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_size")
    v = F.col("k") % 400
    return p.select(F.floor(F.col("k") / 400).alias("mesh"), v.alias("v"), (v % 20).cast("double").alias("x"), F.floor(v / 20).cast("double").alias("y"), (F.col("p_size") * F.lit(0.01)).cast("double").alias("z"), (F.col("p_size") % 3 - 1).alias("label"))


@query(f"select mesh, f1, f2, a, b from {_ADJ}")
def face_adjacency(spark, sf):
    """Faces that share an edge."""
    return L.face_adjacency(_faces(spark, sf))


@query(f"""with b as (select mesh, least(l1, l2) as la, greatest(l1, l2) as lb, a, b from {_ADJ} where l1 <> l2 and l1 >= 0 and l2 >= 0)
select mesh, la, lb, count(*) as edges, (select count(distinct v) from (select unnest([y.a, y.b]) as v from b y where y.mesh = b.mesh and y.la = b.la and y.lb = b.lb)) as vertices from b group by mesh, la, lb""")
def label_boundaries(spark, sf):
    """Shared edges of each pair of labels in a mesh, and their vertices."""
    f = materialize(_faces(spark, sf), "faces")
    b = L.label_boundaries(L.face_adjacency(f), f)
    v = b.withColumn("v", F.explode(F.array("a", "b"))).groupBy("mesh", "la", "lb").agg(F.countDistinct("v").alias("vertices"))
    return b.groupBy("mesh", "la", "lb").agg(F.count("*").alias("edges")).join(v, ["mesh", "la", "lb"])


@query(f"""with recursive f as (select mesh * 1000 + face as id, mesh, face, label from {_F}), e as (select mesh * 1000 + f1 as s, mesh * 1000 + f2 as t from {_ADJ} where l1 = l2), w as (select s, t from e union select t, s from e),
r as (select id as s, id as t from f union select r.s, w.t from r join w on w.s = r.t), c as (select s as id, min(t) as m from r group by 1), n as (select m, count(*) as size from c group by 1),
k as (select m, row_number() over (partition by m // 1000 order by m) - 1 as part from n where size >= 3)
select f.mesh, f.face, f.label, coalesce(k.part, -1) as part, n.size from f join c on c.id = f.id join n on n.m = c.m left join k on k.m = c.m""")
def label_parts(spark, sf):
    """Connected faces of one label, small parts dropped, the others numbered."""
    f = materialize(_faces(spark, sf), "faces")
    return L.label_parts(L.face_adjacency(f), f.select("mesh", "face", "label"), 3)


@query()
def cleaned_fragments(spark, sf):
    """Stray parts of labels given to the faces they touch, one after another."""
    f = materialize(_faces(spark, sf), "faces")
    return S.cleaned_labels(f.select("mesh", "face", "label"), L.face_adjacency(f))


@query(f"""with v as (select p_partkey // 400 as mesh, p_partkey % 400 as v, p_size % 3 - 1 as label from part)
select f.mesh, f.face, cast(a.label as integer) as label from {_F} f join v a on a.mesh = f.mesh and a.v = f.v0 join v b on b.mesh = f.mesh and b.v = f.v1 join v c on c.mesh = f.mesh and c.v = f.v2 where a.label = b.label and b.label = c.label and a.label >= 0""")
def whole_faces(spark, sf):
    """Faces whose three corners have one label."""
    v = _corners(spark, sf)
    return L.whole_faces(_faces(spark, sf), v).withColumn("label", F.col("label").cast("int"))


@query("select p_partkey, p_partkey % 20 between 5 and 14 and (p_partkey % 400) // 20 between 3 and 9 as inside from part")
def polygon_selection(spark, sf):
    """Centres that lie in a polygon."""
    v = F.col("p_partkey") % 400
    box = [(4.5, 2.5), (14.5, 2.5), (14.5, 9.5), (4.5, 9.5)]
    return read_table(spark, sf, "part").select("p_partkey", L.inside_polygon((v % 20).cast("double"), F.floor(v / 20).cast("double"), box).alias("inside"))


@query()
def boundary_joints(spark, sf):
    """Joints between labels of a mesh from the circle through their boundary."""
    f, v = materialize(_faces(spark, sf), "faces"), materialize(_corners(spark, sf), "corners")
    b = materialize(L.label_boundaries(L.face_adjacency(f), f), "boundaries")
    n = b.groupBy("mesh", "la", "lb").agg(F.count("*").alias("edges"))
    ends = b.select("mesh", "la", "lb", F.explode(F.array("a", "b")).alias("v")).distinct().join(n, ["mesh", "la", "lb"]).join(v.select("mesh", "v", "x", "y", "z"), ["mesh", "v"])
    own = f.filter("label >= 0").select("mesh", "label", F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct().join(v.drop("label"), ["mesh", "v"])
    centres = own.groupBy("mesh", "label").agg(F.array(*[F.avg(c) for c in "xyz"]).alias("centre"))
    return T.boundary_joints(ends, centres)


@query(f"""with q as (select vec_id, e[1] / n as w, e[2] / n as x, e[3] / n as y, e[4] / n as z from (select *, sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2 + e[4] ** 2) as n from {_P})),
m as (select vec_id, 1 - 2 * (y * y + z * z) as m0, 2 * (x * y + z * w) as m3, 2 * (x * z - y * w) as m6, 2 * (y * z + x * w) as m7, 1 - 2 * (x * x + y * y) as m8 from q)
select vec_id, round(atan2(m7, m8), 5) as roll, round(atan2(-m6, sqrt(m0 * m0 + m3 * m3)), 5) as pitch, round(atan2(m3, m0), 5) as yaw from m""")
def quaternion_angles(spark, sf):
    """Rotations of quaternions and their angles about fixed axes (L3, L4)."""
    r = V.roll_pitch_yaw(F.col("m"))
    q = _xyz(spark, sf).select("vec_id", V.quaternion(*[F.col("e")[i] for i in range(4)]).alias("m"))
    return q.select("vec_id", *[F.round(r[i], 5).alias(n) for i, n in enumerate(("roll", "pitch", "yaw"))])


@query(f"""with v as (select vec_id, e[1] as px, e[2] as py, e[3] as pz, e[4] as ux, e[5] as uy, e[6] as uz, e[7] as qx, e[8] as qy, e[9] as qz, case when vec_id % 10 = 0 then e[4] * 2 else e[10] end as vx, case when vec_id % 10 = 0 then e[5] * 2 else e[11] end as vy, case when vec_id % 10 = 0 then e[6] * 2 else e[12] end as vz from {_P}),
n as (select *, uy * vz - uz * vy as nx, uz * vx - ux * vz as ny, ux * vy - uy * vx as nz, qx - px as wx, qy - py as wy, qz - pz as wz from v), k as (select *, (wx * ux + wy * uy + wz * uz) / (ux * ux + uy * uy + uz * uz) as s from n)
select vec_id, round(case when vec_id % 10 = 0 then sqrt((wx - s * ux) ** 2 + (wy - s * uy) ** 2 + (wz - s * uz) ** 2) else abs(wx * nx + wy * ny + wz * nz) / sqrt(nx * nx + ny * ny + nz * nz) end, 5) as distance,
round(degrees(acos(least(1.0, abs(ux * vx + uy * vy + uz * vz) / (sqrt(ux * ux + uy * uy + uz * uz) * sqrt(vx * vx + vy * vy + vz * vz))))), 3) as angle, round(px + s * ux, 5) as foot from k""")
def line_distances(spark, sf):
    """Distance and angle of two lines, parallel ones too, and the foot of a point on an axis."""
    at = lambda i: F.slice("e", i, 3)
    d = _xyz(spark, sf).select("vec_id", at(1).alias("p"), at(4).alias("u"), at(7).alias("q"), F.when(F.col("vec_id") % 10 == 0, V.times(at(4), F.lit(2.0))).otherwise(at(10)).alias("v"))
    p, u, q, v = (F.col(c) for c in "puqv")
    return d.select("vec_id", F.round(V.line_distance(p, u, q, v), 5).alias("distance"), F.round(V.axis_angle_error(u, v), 3).alias("angle"), F.round(V.onto_axis(q, p, u)[0], 5).alias("foot"))


@query(f"""with f as (select 640 / (2 * tan(radians(60.0) / 2)) as f) select vec_id, round(f, 5) as fx, case when z > 1e-6 then round(sqrt((f * x / z + 320 - 300) ** 2 + (f * y / z + 240 - 250) ** 2), 3) end as error, z <= 1e-6 as behind from {_P}, f""")
def reprojections(spark, sf):
    """Pixel errors with a camera guessed from its field of view, infinite behind it."""
    fx = K.focal_of_view(640, 60.0)
    d = _xyz(spark, sf).select("vec_id", V.reprojection_error(F.array("x", "y", "z"), F.array(F.lit(300.0), F.lit(250.0)), fx, 320.0, 240.0).alias("err"))
    return d.select("vec_id", F.round(F.lit(fx), 5).alias("fx"), F.when(F.col("err") < float("inf"), F.round("err", 3)).alias("error"), (F.col("err") == float("inf")).alias("behind"))


@query(f"""with r as (select label, k, i, avg(e[9 * k + i + 1]) as m from {_P}, (select unnest(range(0, 7)) as k), (select unnest(range(0, 9)) as i) group by 1, 2, 3)
select label, round(max(d), 6) as distance from (select a.label, a.k, sqrt(sum((a.m - b.m) ** 2)) as d from r a join r b on b.label = a.label + 1 and a.k = b.k and a.i = b.i group by 1, 2) group by 1""")
def pose_distances(spark, sf):
    """Largest Frobenius distance over the poses of neighbouring bodies."""
    d = _xyz(spark, sf).select("label", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"), "e")
    m = materialize(d.groupBy("label", "k").agg(*[F.avg(F.get("e", 9 * F.col("k") + i)).alias(f"m{i}") for i in range(9)]).select("label", "k", F.array(*[f"m{i}" for i in range(9)]).alias("m")), "poses")
    j = m.join(m.select((F.col("label") - 1).alias("label"), "k", F.col("m").alias("o")), ["label", "k"])
    return j.groupBy("label").agg(F.round(F.max(V.norm(V.minus(F.col("m"), F.col("o")))), 6).alias("distance"))


@query(f"""with d as (select a.vec_id as id, b.vec_id as pid, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from {_P} a join {_P} b on b.vec_id % 2 = 1 where a.vec_id % 2 = 0),
r as (select *, row_number() over (partition by id order by d, pid) as k, lead(d) over (partition by id order by d, pid) as second from d) select id, pid, round(d, 6) as distance from r where k = 1 and d < 0.75::double * second""")
def ratio_matches(spark, sf):
    """Nearest partners that are clearly nearer than the second."""
    p = _xyz(spark, sf)
    near = materialize(nearest(p.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "id"), p.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "pid"), 2, 0.05), "near")
    j = near.filter("place = 1").join(near.filter("place = 2").select("id", F.col("distance").alias("second")), "id")
    return j.filter(F.col("distance") < 0.75 * F.col("second")).select("id", "pid", F.round("distance", 6).alias("distance"))


@query("""select l_returnflag as g, round(coalesce(sum(case when l_linestatus = 'O' then (abs(l_discount - 0.05) + abs(l_tax - 0.04)) / 2 end), 0) / greatest(count(*) filter (l_linestatus = 'O'), 1), 6) as limits from lineitem group by 1""")
def limits_error(spark, sf):
    """Mean absolute error of both limits over valid joints."""
    d = read_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", *[F.col(c).cast("double").alias(c) for c in ("l_discount", "l_tax")])
    return d.groupBy(F.col("l_returnflag").alias("g")).agg(F.round(M.masked_mean((F.abs(F.col("l_discount") - 0.05) + F.abs(F.col("l_tax") - 0.04)) / 2, F.col("l_linestatus") == "O"), 6).alias("limits"))


@query("""with r as (select l_suppkey % 20 as scene, l_partkey % 6 - 1 as body, l_linenumber as link from lineitem), c as (select scene, body, link, count(*) as n from r where body >= 0 group by all), m as (select scene, body, link as best from (select *, row_number() over (partition by scene, body order by n desc, link) as rn from c) where rn = 1)
select r.scene, round(avg(case when m.best = r.link then 1.0 else 0.0 end), 6) as accuracy, count(*) filter (r.body = -1) as unassigned from r left join m using (scene, body) group by 1""")
def remapped_accuracy(spark, sf):
    """Accuracy after each body is given the link it covers most; rows without a body are wrong."""
    r = materialize(read_table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("scene"), (F.col("l_partkey") % 6 - 1).alias("body"), F.col("l_linenumber").alias("link")), "bodies")
    m = mode_lowest(r.filter("body >= 0"), ["scene", "body"], "link").select("scene", "body", F.col("link").alias("best"))
    j = r.join(m, ["scene", "body"], "left")
    return j.groupBy("scene").agg(F.round(F.avg(F.coalesce((F.col("best") == F.col("link")).cast("double"), F.lit(0.0))), 6).alias("accuracy"), F.count_if(F.col("body") == -1).alias("unassigned"))


_POINTS = "(select example_id, robot_idx, k, p.label as label from (select example_id, robot_idx, unnest(points) as p, generate_subscripts(points, 1) - 1 as k from (select * from (select *, row_number() over (partition by example_id order by created_at desc) as rn from shard_example) where rn = 1)))"


@query(f"select label, count(*) as n from (select *, row_number() over (partition by example_id order by md5(example_id || '/' || k), k) as rn from {_POINTS}) where rn <= 16 group by 1")
def sampled_labels(spark, sf):
    """Labels of 16 points of each example, taken by the order of a hash."""
    x = newest(read_table(spark, sf, "shard_example").select("example_id", "points", "created_at"), "example_id", "created_at").select("example_id", F.posexplode("points").alias("k", "p"))
    x = x.select("example_id", "k", F.col("p.label").alias("label"), F.md5(F.concat_ws("/", F.col("example_id").cast("string"), F.col("k").cast("string"))).alias("h"))
    return grouped_prefix(x, ["example_id"], ["h", "k", "example_id"]).filter(F.col("rank") <= 16).groupBy("label").agg(F.count("*").alias("n"))


@query("select shard, robot_idx, count(*) as rows from (select * from (select *, row_number() over (partition by example_id order by created_at desc) as rn from shard_example) where rn = 1) group by all")
def rows_per_robot(spark, sf):
    """Examples of each robot of each shard."""
    x = newest(read_table(spark, sf, "shard_example").select("example_id", "shard", "robot_idx", "created_at"), "example_id", "created_at")
    return x.groupBy("shard", "robot_idx").agg(F.count("*").alias("rows"))


@query("""select l_orderkey, l_linenumber, case when l_linenumber % 4 = 0 then 'geometric' when l_linenumber % 3 = 0 then 'motion' when l_linenumber % 2 = 0 then 'model' else 'default' end as source,
case when l_linenumber % 4 = 0 then 'prismatic' when l_linenumber % 3 = 0 then 'revolute' when l_linenumber % 2 = 0 then 'continuous' else 'fixed' end as kind, case when l_linenumber % 4 = 0 then 4.0 when l_linenumber % 3 = 0 then 3.0 when l_linenumber % 2 = 0 then 2.0 else 0.0 end as x from (select distinct l_orderkey, l_linenumber from lineitem)""")
def joint_sources(spark, sf):
    """The joint that counts: from geometry, from motion, from the model, or a fixed one."""
    li = materialize(read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "pairs")
    key = ["l_orderkey", "l_linenumber"]
    part = lambda name, n, kind: li.filter(F.col("l_linenumber") % n == 0).select(*key, F.struct(F.lit(kind).alias("kind"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("axis"), F.array(F.lit(float(n)), F.lit(0.0), F.lit(0.0)).alias("origin")).alias(name))
    j = li.join(part("g", 4, "prismatic"), key, "left").join(part("m", 3, "fixed"), key, "left").join(part("d", 2, "continuous"), key, "left")
    s = T.joint_source(F.col("g"), F.col("m"), F.col("d"))
    return j.select(*key, s.alias("s")).select(*key, F.col("s.origin_of").alias("source"), "s.kind", F.col("s.origin")[0].alias("x"))


@query("""with k as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) as place from supplier), p as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as place from customer)
select s_nationkey, s_suppkey, c_custkey, cast(k.place as bigint) as place from k join p on c_nationkey = s_nationkey and p.place = k.place""")
def joints_by_height(spark, sf):
    """The k-th joint by height with the k-th pair, as far as both go."""
    s = grouped_prefix(read_table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], ["s_acctbal", "s_suppkey"]).withColumnRenamed("rank", "place")
    c = grouped_prefix(read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("s_nationkey"), "c_custkey"), ["s_nationkey"], ["c_custkey"]).withColumnRenamed("rank", "place")
    return s.join(c, ["s_nationkey", "place"]).select("s_nationkey", "s_suppkey", "c_custkey", F.col("place").cast("long").alias("place"))


@query("select o_orderkey, coalesce(n_regionkey, o_custkey % 40) as cluster from orders left join nation on n_nationkey = o_custkey % 40")
def body_clusters(spark, sf):
    """Bodies with the clusters of a map, those outside it as they are."""
    o = read_table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("body"))
    n = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("body"), "n_regionkey")
    return o.join(n, "body", "left").select("o_orderkey", F.coalesce(F.col("n_regionkey"), F.col("body")).cast("long").alias("cluster"))


@query(f"""with c as (select label, avg(x) as x, avg(y) as y, avg(z) as z from {_P} group by 1), o as (select * from c where label = 0), d as (select c.label, row_number() over (order by round((c.x - o.x) ** 2 + (c.y - o.y) ** 2 + (c.z - o.z) ** 2, 9), c.label) - 1 as rn from c, o where c.label <> 0)
select vec_id, cast(case when label = 0 then 0 else 100 + rn end as bigint) as label from {_P} left join d using (label)""")
def relabelled_by_distance(spark, sf):
    """Labels numbered on from 100 by the distance of their centre from the anchor's."""
    p = _xyz(spark, sf).drop("e")
    c = materialize(p.groupBy("label").agg(*[F.avg(n).alias(n) for n in "xyz"]), "centres")
    o = c.filter("label = 0").first()  # the anchor's centre
    d = c.filter("label <> 0").withColumn("d", F.round(sum(((F.col(n) - F.lit(o[n])) * (F.col(n) - F.lit(o[n])) for n in "yz"), (F.col("x") - F.lit(o.x)) * (F.col("x") - F.lit(o.x))), 9))
    ids = grouped_prefix(d.select("label", "d"), [], ["d", "label"]).select("label", (F.col("rank") + 99).alias("new"))
    return p.join(ids, "label", "left").select("vec_id", F.coalesce("new", F.lit(0)).cast("long").alias("label"))


@query(f"with m as (select label, avg(x) as mx, avg(y) as my, avg(z) as mz from {_P} group by 1) select vec_id, round((x - mx) * (1 + label * 0.1::double) + mx, 5) as x, round((z - mz) * (1 + label * 0.1::double) + mz, 5) as z from {_P} join m using (label)")
def scaled_clouds(spark, sf):
    """Clouds scaled about their centroids (M6)."""
    return A.scaled(_xyz(spark, sf).select("vec_id", "label", "x", "y", "z"), "label", 1 + F.col("label") * 0.1).select("vec_id", F.round("x", 5).alias("x"), F.round("z", 5).alias("z"))


@query(f"select label, cast(round_even(count(*) * 0.9::double, 0) as bigint) as points, true as axes_of_length_1, true as same_scale, cast(64 as bigint) as resampled from {_P} group by 1")
def augmented_clouds(spark, sf):
    """Random motion, scale, noise and loss of points in this order, then 64 points of each cloud: how
    many stay, whether axes only turned and distances only scaled (M5, M8, M9)."""
    p = _xyz(spark, sf).select("vec_id", "label", "x", "y", "z", F.lit(0.6).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.8).alias("az"))
    a = materialize(A.augment(p, "label", "vec_id", 5, sigma=0.0), "augmented")
    mid = lambda d, s: d.groupBy("label").agg(*[F.avg(c).alias(f"m{c}{s}") for c in "xyz"])
    j = a.join(p.join(a.select("vec_id"), "vec_id", "left_semi").select("vec_id", "label", *[F.col(c).alias(f"{c}0") for c in "xyz"]), ["vec_id", "label"])
    j = j.join(mid(a, ""), "label").join(mid(p.join(a.select("vec_id"), "vec_id", "left_semi"), "0"), "label")
    far = lambda s: V.norm(F.array(*[F.col(f"{c}{s}") - F.col(f"m{c}{s}") for c in "xyz"]))
    ratio = far("") / far("0")
    some = A.resample(a.select("label", "vec_id"), ["label"], "vec_id", 64, 3).groupBy("label").agg(F.countDistinct("slot").alias("resampled"))
    out = j.groupBy("label").agg(F.count("*").alias("points"), (F.max(F.abs(V.norm(F.array("ax", "ay", "az")) - 1)) < 1e-9).alias("axes_of_length_1"), ((F.max(ratio) - F.min(ratio)) < 1e-9).alias("same_scale"))
    return out.join(some, "label")


@query("""select example_id, case when n = 0 then 'auto' when kids <= 1 then 'serial' else 'tree' end as mode from (select example_id, coalesce(len(joint_parents), 0) as n, coalesce((select max(k) from (select count(*) as k from (select unnest(joint_parents) as p) where p >= 0 group by p)), 0) as kids
from (select * from (select *, row_number() over (partition by example_id order by created_at desc) as rn from training_example) where rn = 1))""")
def topology_modes(spark, sf):
    """Whether joints are taken as a chain, as a tree, or are to be inferred."""
    t = newest(read_table(spark, sf, "training_example").select("example_id", "joint_parents", "created_at"), "example_id", "created_at")
    return t.select("example_id", K.topology_mode(F.col("joint_parents")).alias("mode"))


@query("""select l_orderkey, round(sum(l_linenumber * 0.1::double), 6) as angle, count(*) as steps from lineitem group by 1 having count(*) >= 2 and sum(l_linenumber * 0.1::double) < 3""")
def composed_motions(spark, sf):
    """The motion from the first to the last state, from those between neighbours in their order."""
    z = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.rodrigues(z, F.col("l_linenumber") * F.lit(0.1)).alias("r"))
    # the states of one scene are few
    steps = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "r"))).alias("s"), F.count("*").alias("steps"), F.sum(F.col("l_linenumber") * 0.1).alias("all"))
    whole = F.aggregate("s", F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(9)]), lambda m, x: V.matmul(x["r"], m))
    return steps.filter("steps >= 2 and all < 3").select("l_orderkey", F.round(V.turn_angle(whole), 6).alias("angle"), "steps")


@query(f"""with m as (select min(x) as x, min(y) as y, min(z) as z from {_P}), g as (select greatest(max(trunc((p.x - m.x) / 0.05::double)), max(trunc((p.y - m.y) / 0.05::double)), max(trunc((p.z - m.z) / 0.05::double))) as most, max(label) as label from {_P} p, m)
select cast(length(bin(cast(most as bigint))) as integer) as depth, 3 * length(bin(cast(most as bigint))) + length(bin(label)) <= 63 as fits from g""")
def grid_depth(spark, sf):
    """Bits that the largest cell number takes, and whether codes with the batch in front fit (Q2)."""
    p = _xyz(spark, sf).select("vec_id", "label", "x", "y", "z")
    depth = bit_depth(grid(p, 0.05))
    return p.agg(F.lit(depth).alias("depth"), (3 * depth + F.length(F.bin(F.max("label"))) <= 63).alias("fits"))


@query("""select n_nationkey, case when n_nationkey % 3 = 0 then 'branched' else 'serial' end as topology, case when n_nationkey % 2 = 0 then n_nationkey * 0.05::double else 0.0 end as confidence, n_nationkey % 2 = 0 and n_nationkey * 0.05::double >= 0.7 as trusted, cast(case when n_nationkey % 4 = 0 then 1 else 0 end as integer) as merges, n_nationkey % 5 = 0 as severe from nation""")
def typed_answers(spark, sf):
    """Typed JSON with defaults; merges without a target or sources left out; severe issues and trust."""
    k = F.col("n_nationkey")
    some = lambda c, v: F.when(c, v)
    prior = F.to_json(F.struct(some(k % 3 == 0, F.lit("branched")).alias("expected_chain_topology"), some(k % 2 == 0, k * 0.05).alias("confidence")))
    merge = lambda t, s: F.struct(t.cast("int").alias("target"), s.alias("sources"))
    merges = F.array(merge(k, F.array().cast("array<int>")), merge(some(k < 0, k), F.array(F.lit(1))), merge(some(k % 4 == 0, k), F.array(F.lit(2))))
    critique = F.to_json(F.struct(F.array(F.struct(F.when(k % 5 == 0, "critical").otherwise("low").alias("severity"))).alias("issues"), merges.alias("auto_fix_merges")))
    n = read_table(spark, sf, "nation").select("n_nationkey", prior.alias("p"), critique.alias("c"))
    d = K.read_critiques(K.read_priors(n, "p"), "c")
    return d.select("n_nationkey", F.col("prior.expected_chain_topology").alias("topology"), F.col("prior.confidence").alias("confidence"), "trusted", F.size("critique.auto_fix_merges").alias("merges"), "severe")


@query(f"""with a as (select cast(0 as integer) as pose, -1 as joint, 0.0::double as angle union all select cast(1 + 2 * j + s as integer), j, case s when 0 then 0.3::double else -0.3::double end from (select unnest(range(0, 3)) as j), (select unnest([0, 1]) as s)),
p as (select vec_id, pose, label % 4 as link, joint, angle, x, y, z from {_P}, a) select vec_id, pose, round(case when joint >= 0 and link > joint then cos(angle) * x - sin(angle) * y else x end, 5) as x, round(case when joint >= 0 and link > joint then sin(angle) * x + cos(angle) * y else y end, 5) as y from p""")
def synthetic_poses(spark, sf):
    """Vertices in the home pose and with each joint turned both ways: a joint turns all links after it."""
    rows = K.sweep_poses(3, 0.3)
    p = _xyz(spark, sf).select("vec_id", "x", "y", "z", (F.col("label") % 4).alias("link"), F.explode(F.array(*[F.struct(F.lit(i).alias("pose"), F.lit(j).alias("joint"), F.lit(a).alias("angle")) for i, (j, a) in enumerate(rows)])).alias("s"))
    turned = (F.col("s.joint") >= 0) & (F.col("link") > F.col("s.joint"))
    x, y = A.yaw(F.col("x"), F.col("y"), F.when(turned, F.col("s.angle")).otherwise(0.0))
    return p.select("vec_id", F.col("s.pose").alias("pose"), F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query(f"""with d as (select vec_id, label, vec_id % 7 = 0 as orphan, k, e[3 * k + 1] - e[1] as x, e[3 * k + 2] - e[2] as y, e[3 * k + 3] - e[3] as z from {_P}, (select unnest(range(1, 21)) as k)), m as (select label, k, avg(x) as x, avg(y) as y, avg(z) as z from d where not orphan group by 1, 2),
w as (select d.vec_id, m.label, round(max(sqrt((d.x - m.x) ** 2 + (d.y - m.y) ** 2 + (d.z - m.z) ** 2)), 9) as worst from d join m using (k) where d.orphan group by 1, 2), b as (select *, row_number() over (partition by vec_id order by worst, label) as rn from w)
select vec_id, case when worst < 0.9 then label else -1 end as body, round(worst, 6) as worst from b where rn = 1""")
def reassigned_orphans(spark, sf):
    """Vertices without a body given to the one whose motion they follow best, if near enough."""
    e = _xyz(spark, sf).withColumn("orphan", F.col("vec_id") % 7 == 0)
    d = e.select("vec_id", "label", "orphan", "e", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k")).select("vec_id", "label", "orphan", "k", *[(F.get("e", 3 * F.col("k") + i) - F.get("e", F.lit(i))).alias(n) for i, n in enumerate("xyz")])
    return S.nearest_motions(d.filter("orphan"), d.filter("not orphan"), "vec_id", "label", "k", 0.9)
