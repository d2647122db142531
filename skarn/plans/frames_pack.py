"""Frames, axes, close pairs, roots and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import estimate as S
from skarn.operators import frames as K
from skarn.operators import vectors as V
from skarn.sources.tables import newest, read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_P = "(select vec_id, label, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"


def _xyz(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")])


@query("""with n as (select n_nationkey as k, n_nationkey * 0.1::double as a, n_regionkey * 0.2::double as b, n_regionkey as r from nation)
select 'C' || c_custkey as node, round(cos(b) * (cos(a) * 2 - sin(a) * 0 + n.k) - sin(b) * (sin(a) * 2 + cos(a) * 0) + r, 4) as x, round(sin(b) * (cos(a) * 2 + n.k) + cos(b) * (sin(a) * 2) + 0, 4) as y from customer join n on n.k = c_nationkey""")
def composed_frames(spark, sf):
    """Frames of a three-level tree in its roots' frames, by pointer doubling."""
    r, n, c = (read_table(spark, sf, t) for t in ("region", "nation", "customer"))
    tag = lambda t, k: F.concat(F.lit(t), F.col(k).cast("string"))
    turn = lambda a: V.rodrigues(V.vec(F.lit(0), F.lit(0), F.lit(1)), a)
    rows = r.select(tag("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("up"), turn(F.col("r_regionkey") * F.lit(0.2)).alias("r"), V.vec(F.col("r_regionkey"), F.lit(0), F.lit(0)).alias("t"))
    rows = rows.unionByName(n.select(tag("N", "n_nationkey").alias("node"), tag("R", "n_regionkey").alias("up"), turn(F.col("n_nationkey") * F.lit(0.1)).alias("r"), V.vec(F.col("n_nationkey"), F.lit(0), F.lit(0)).alias("t")))
    rows = rows.unionByName(c.select(tag("C", "c_custkey").alias("node"), tag("N", "c_nationkey").alias("up"), turn(F.lit(0.0)).alias("r"), V.vec(F.lit(2), F.lit(0), F.lit(0)).alias("t")))
    f = K.compose_frames(rows, "node", "up", "r", "t").filter(F.col("node").startswith("C"))
    return f.select("node", F.round(F.col("t")[0], 4).alias("x"), F.round(F.col("t")[1], 4).alias("y"))


@query(f"""with f as (select label, arg_min(x, vec_id) as fx, arg_min(y, vec_id) as fy, arg_min(z, vec_id) as fz from {_P} group by 1),
a as (select p.label, x, y, z, case when x * fx + y * fy + z * fz < 0 then -1.0 else 1.0 end as s from {_P} p join f using (label)), m as (select label, avg(x * s) as mx, avg(y * s) as my, avg(z * s) as mz, count(*) as n from a group by 1)
select label, n, round(mx / sqrt(mx * mx + my * my + mz * mz), 5) as ax, round(my / sqrt(mx * mx + my * my + mz * mz), 5) as ay from m""")
def mean_axes(spark, sf):
    """Mean of undirected axes after turning them to one side."""
    p = _xyz(spark, sf).select("label", "vec_id", V.vec(F.col("x"), F.col("y"), F.col("z")).alias("a"))
    return K.mean_axes(p, "label", ["vec_id"], "a").select("label", "n", F.round(F.col("axis")[0], 5).alias("ax"), F.round(F.col("axis")[1], 5).alias("ay"))


@query(f"""select a.vec_id as a, b.vec_id as b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 5) as distance from {_P} a join {_P} b on a.vec_id < b.vec_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 0.03""")
def close_pairs(spark, sf):
    """Pairs of points nearer than a tolerance."""
    return K.pairs_within(_xyz(spark, sf), "vec_id", 0.03).select("a", "b", F.round("distance", 5).alias("distance"))


@query(f"""with recursive e as (select a.vec_id as a, b.vec_id as b from {_P} a join {_P} b on a.vec_id <> b.vec_id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 0.03),
r as (select vec_id as s, vec_id as t from {_P} union select r.s, e.b from r join e on e.a = r.t), c as (select s, min(t) as m from r group by 1) select s as vec_id, cast(dense_rank() over (order by m) - 1 as bigint) as body from c""")
def merged_bodies(spark, sf):
    """Points joined through close pairs, numbered without gaps."""
    return K.merge_close(_xyz(spark, sf), "vec_id", 0.03)


@query(f"""with c as (select label, round(avg(z), 6) as z, count(*) as n from {_P} group by 1) select (select label from c order by z, label limit 1) as lowest, (select label from c order by n desc, label limit 1) as largest""")
def root_choice(spark, sf):
    """The root label: lowest centroid, or most faces."""
    c = _xyz(spark, sf).groupBy("label").agg(F.round(F.avg("z"), 6).alias("z"), F.count("*").alias("n"))
    return c.agg(F.min_by("label", F.struct("z", "label")).alias("lowest"), F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("largest"))


@query("""select o_orderkey, case when c_custkey is null then 'no such customer' end as rejected, r_name from orders left join customer on c_custkey = o_custkey and c_acctbal > 0 left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey""")
def matched_or_rejected(spark, sf):
    """Rows with their partners through several hops, and why the others have none."""
    o, c, n, r = (read_table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    m = K.match_or_reject(o.select("o_orderkey", "o_custkey"), "o_custkey", c.filter("c_acctbal > 0").select("c_custkey", "c_nationkey"), "c_custkey", "no such customer")
    m = m.join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey", "left").join(r.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey", "left")
    return m.select("o_orderkey", "rejected", "r_name")


@query("""with h as (select n_nationkey as k, (n_nationkey * 0.618033988749895::double) % 1.0 * 6 as h from nation), c as (select k, unnest([5, 3, 1]) as n, h from h)
select k, max(case when n = 5 then v end) as red, max(case when n = 3 then v end) as green, max(case when n = 1 then v end) as blue from (select k, n, round(0.95 - 0.95 * 0.65 * greatest(0.0, least((n + h) % 6, 4 - (n + h) % 6, 1.0)), 5)::double as v from c) group by 1""")
def palette(spark, sf):
    """Colours of labels."""
    c = K.palette(F.col("n_nationkey"))
    return read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), *[F.round(c[i], 5).alias(n) for i, n in enumerate(("red", "green", "blue"))])


@query("""select p_partkey, case when p_size % 12 = 0 then 'base' else 'link' || (p_size % 12) end as link, round(p_partkey % 5 * 0.05::double + 0.02, 6) as mx, round(p_partkey // 5 * 0.05::double + 0.02, 6) as my, round((p_size - 320.0) / 600, 6) as rx, cast(p_size % 4 as integer) as joints from part""")
def markers_and_names(spark, sf):
    """Marker centres, pixel rays, link names and default physics."""
    m = K.marker_centre(F.col("p_partkey"), 5, 0.04, 0.01)
    ray = K.ray_through(F.col("p_size").cast("double"), F.lit(240.0), 600.0, 320.0, 240.0)
    phys = K.default_physics(F.col("p_size") % 4)
    return read_table(spark, sf, "part").select("p_partkey", K.link_name(F.col("p_size") % 12).alias("link"), F.round(m[0], 6).alias("mx"), F.round(m[1], 6).alias("my"), F.round(ray[0] / ray[2], 6).alias("rx"), F.size(phys["effort"]).alias("joints"))


@query("""with j as (select example_id, j.parent as parent, j.child as child from (select example_id, unnest(joints) as j from (select * from (select *, row_number() over (partition by example_id order by created_at desc) as rn from shard_example) where rn = 1)))
select example_id, count(*) as joints, count(distinct parent) as parents, count(*) filter (parent not in (select c.child from j c where c.example_id = j.example_id)) as from_roots, max(k) <= 1 as serial from (select *, count(*) over (partition by example_id, parent) as k from j) j group by 1""")
def chain_shapes(spark, sf):
    """Whether each example's joints form chains, and how many start at roots."""
    x = newest(read_table(spark, sf, "shard_example").select("example_id", "joints", "created_at"), "example_id", "created_at")
    kids = F.transform("joints", lambda j: j["child"])
    x = x.select("example_id", F.explode("joints").alias("j"), kids.alias("kids")).select("example_id", F.col("j.parent").alias("parent"), (~F.array_contains("kids", F.col("j.parent"))).alias("top"))
    k = x.groupBy("example_id", "parent").agg(F.count("*").alias("k"), F.count_if("top").alias("t"))
    return k.groupBy("example_id").agg(F.sum("k").alias("joints"), F.count("*").alias("parents"), F.sum("t").alias("from_roots"), (F.max("k") <= 1).alias("serial"))


@query("""with p as (select vec_id, label, k, cast(embedding[3 * k + 1] as double) as x, cast(embedding[3 * k + 2] as double) as y, cast(embedding[3 * k + 3] as double) as z from embeddings, (select unnest(range(0, 21)) as k)),
d as (select p.vec_id, p.label, p.k, p.x - o.x as x, p.y - o.y as y, p.z - o.z as z from p join p o on o.vec_id = p.vec_id and o.k = 0),
m as (select label, k, avg(x) as x, avg(y) as y, avg(z) as z from d group by 1, 2)
select vec_id, round(max(sqrt((d.x - m.x) ** 2 + (d.y - m.y) ** 2 + (d.z - m.z) ** 2)), 6) as worst, count(*) filter (sqrt((d.x - m.x) ** 2 + (d.y - m.y) ** 2 + (d.z - m.z) ** 2) < 0.2) as inliers from d join m using (label, k) group by 1""")
def pose_residuals(spark, sf):
    """Worst distance of each vertex from its body's mean motion over all poses."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = read_table(spark, sf, "embeddings").select("vec_id", "label", v.alias("e"))
    k = F.sequence(F.lit(0), F.lit(20))
    d = e.select("vec_id", "label", "e", F.explode(k).alias("k")).select("vec_id", "label", "k", *[(F.get("e", 3 * F.col("k") + i) - F.get("e", F.lit(i))).alias(n) for i, n in enumerate("xyz")])
    m = d.groupBy("label", "k").agg(*[F.avg(n).alias(f"m{n}") for n in "xyz"])
    far = V.norm(F.array(*[F.col(n) - F.col(f"m{n}") for n in "xyz"]))
    return d.join(m, ["label", "k"]).groupBy("vec_id").agg(F.round(F.max(far), 6).alias("worst"), F.count_if(far < 0.2).alias("inliers"))


@query()
def segmented_bodies(spark, sf):
    """Bodies of pose series by consensus of refined triples: all whole x, y, z of a vector are poses."""
    e = read_table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").alias("poses"))
    return S.scene_bodies(e, "label", "vec_id", "poses", 0.2, 5)


@query()
def inferred_trees(spark, sf):
    """Trees of labels from their shared edges: nations of customers that order in turn."""
    from skarn.operators.prefix import grouped_prefix
    from skarn.sources.tables import materialize

    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.pmod("o_orderkey", F.lit(9)).cast("int").alias("label"))
    f = materialize(grouped_prefix(o, ["o_custkey"], ["o_orderkey"]), "faces")
    b = f.select("o_custkey", (F.col("rank") - 1).alias("rank"), F.col("label").alias("next"))
    w = f.join(b, ["o_custkey", "rank"]).filter("label <> next").groupBy((F.col("o_custkey") % 10).alias("scene"), F.least("label", "next").alias("la"), F.greatest("label", "next").alias("lb")).agg(F.count("*").alias("weight"))
    return S.scene_trees(w, "scene")


@query()
def punched_clouds(spark, sf):
    """Clouds with spheres cut out, by seeds of their own."""
    return S.holed(_xyz(spark, sf), "label", "vec_id", 0.1, 8, 0.3, 7)
