"""Point clouds, grids, curves, neighbours and rigid geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skarn.operators import curves as G
from skarn.operators import reports as R
from skarn.operators import vectors as V
from skarn.operators.neighbours import nearest
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


def _xyz(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")])


_P = "(select vec_id, label, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"
SIZE, DEPTH = 0.02, 8
_GRID = f"(select *, cast(floor((x - min(x) over ()) / {SIZE}) as bigint) as gx, cast(floor((y - min(y) over ()) / {SIZE}) as bigint) as gy, cast(floor((z - min(z) over ()) / {SIZE}) as bigint) as gz from {_P})"


def _morton_sql(a: str, b: str, c: str) -> str:
    return " | ".join(f"((({v} >> {i}) & 1) << {3 * i + k})" for i in range(DEPTH) for v, k in ((a, 2), (b, 1), (c, 0)))


_CODE = f"(select *, cast({_morton_sql('gx', 'gy', 'gz')} as bigint) as code from {_GRID})"


def _coded(spark, sf):
    return G.grid(_xyz(spark, sf), SIZE).withColumn("code", G.morton(F.col("gx"), F.col("gy"), F.col("gz"), DEPTH))


@query(f"select vec_id, cast(gx as integer) as gx, cast(gy as integer) as gy, cast(gz as integer) as gz, code, cast({_morton_sql('gy', 'gx', 'gz')} as bigint) as code_trans, (cast(label as bigint) << {3 * DEPTH}) | code as code_batch, true as round_trip from {_CODE}")
def morton_codes(spark, sf):
    """Grid cells and their codes, both ways and with the batch in front (Q1, Q3, Q5)."""
    g = _coded(spark, sf)
    back = G.morton_decode(F.col("code"), DEPTH)
    return g.select("vec_id", "gx", "gy", "gz", "code", G.morton(F.col("gy"), F.col("gx"), F.col("gz"), DEPTH).alias("code_trans"), G.with_batch(F.col("code"), F.col("label"), DEPTH).alias("code_batch"), ((back["x"] == F.col("gx")) & (back["y"] == F.col("gy")) & (back["z"] == F.col("gz"))).alias("round_trip"))


@query(f"select vec_id, cast(row_number() over (order by code, vec_id) - 1 as bigint) as place from {_CODE}")
def curve_places(spark, sf):
    """Order along the curve and its inverse (H8, Q6)."""
    return G.curve_rank(_coded(spark, sf).select("vec_id", "code"), "code", "vec_id").select("vec_id", "place")


@query()
def hilbert_places(spark, sf):
    """Places on the Hilbert curve, and whether decoding gives the cell back (Q4, Q5)."""
    g = _coded(spark, sf)
    g = g.select("vec_id", "gx", "gy", "gz", G.hilbert(F.col("gx"), F.col("gy"), F.col("gz"), DEPTH).alias("hilbert"), G.hilbert(F.col("gy"), F.col("gx"), F.col("gz"), DEPTH).alias("hilbert_trans"))
    g = g.withColumn("back", G.hilbert_decode(F.col("hilbert"), DEPTH))
    return g.withColumn("round_trip", (F.col("back.x") == F.col("gx")) & (F.col("back.y") == F.col("gy")) & (F.col("back.z") == F.col("gz"))).drop("back")


@query(f"select code >> 9 as cell, count(*) as n, min(vec_id) as head, round(sum(x), 6) as x_sum, round(avg(x), 6) as x_mean, round(min(x), 6) as x_min, round(max(x), 6) as x_max from {_CODE} group by 1")
def voxel_pool(spark, sf):
    """Coarser cells with reduced values."""
    out = G.voxel_pool(_coded(spark, sf), "code", "vec_id", 3, ["x"])
    return out.select("cell", "n", "head", *[F.round(c, 6).alias(c) for c in ("x_sum", "x_mean", "x_min", "x_max")])


@query(f"select vec_id, round(x + avg(x) over (partition by code >> 9), 6) as unpooled from {_CODE}")
def voxel_unpool(spark, sf):
    """Pooled values added back to their points (Q8)."""
    g = materialize(_coded(spark, sf), "coded")
    return G.voxel_unpool(g, G.voxel_pool(g, "code", "vec_id", 3, ["x"]), "code", 3, "x", "x_mean").select("vec_id", F.round("unpooled", 6).alias("unpooled"))


PATCH = 16
_PLACED = f"(select vec_id, label, row_number() over (partition by label order by code, vec_id) - 1 as place, count(*) over (partition by label) as n from {_CODE})"


@query(f"""select vec_id, label, cast(place // {PATCH} as bigint) as patch, cast(place % {PATCH} as integer) as slot, false as borrowed from {_PLACED}
union all select vec_id, label, cast((n - 1) // {PATCH} as bigint), cast(place % {PATCH} as integer), true from {_PLACED} where n > {PATCH} and n % {PATCH} <> 0 and place // {PATCH} = (n - 1) // {PATCH} - 1 and place % {PATCH} >= n % {PATCH}""")
def patch_fill(spark, sf):
    """Patches of a fixed size along the curve, the last one filled up (H9, Q9)."""
    from skarn.operators.prefix import grouped_prefix

    g = grouped_prefix(_coded(spark, sf).select("vec_id", "label", "code"), ["label"], ["code", "vec_id"]).withColumn("place", F.col("rank") - 1)
    return G.patches(g, "label", "place", PATCH).select("vec_id", "label", "patch", "slot", "borrowed")


@query(f"""with p as (select vec_id, label, place // {PATCH} as patch, place % {PATCH} as slot, gx, gy, gz from (select *, row_number() over (partition by label order by code, vec_id) - 1 as place from {_CODE}))
select a.label, cast(a.patch as bigint) as patch, cast(sum(abs(a.gx - b.gx) + abs(a.gy - b.gy) + abs(a.gz - b.gz)) as bigint) as total from p a join p b on a.label = b.label and a.patch = b.patch and b.slot = a.slot + 1 group by all""")
def patch_offsets(spark, sf):
    """Relative cells of neighbours inside patches (Q10)."""
    from skarn.operators.prefix import grouped_prefix

    g = grouped_prefix(_coded(spark, sf).select("vec_id", "label", "code", "gx", "gy", "gz"), ["label"], ["code", "vec_id"])
    g = g.withColumn("patch", ((F.col("rank") - 1) / PATCH).cast("long"))
    w = Window.partitionBy("label", "patch").orderBy("rank")
    step = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in ("gy", "gz")), F.abs(F.col("gx") - F.lag("gx").over(w)))
    return g.withColumn("step", step).filter("step is not null").groupBy("label", "patch").agg(F.sum("step").cast("long").alias("total"))


@query(f"select label, count(*) as n, cast(sum(count(*)) over (order by label) as bigint) as stop, cast(sum(count(*)) over (order by label) - count(*) as bigint) as start from {_P} group by label")
def cloud_offsets(spark, sf):
    """Where each cloud lies in the concatenation (H5, H6)."""
    return G.offsets(_xyz(spark, sf), "label")


@query(f"""with d as (select a.vec_id as id, b.vec_id as pid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as distance from {_P} a, {_P} b where a.vec_id <> b.vec_id or true)
select id, pid, round(distance, 6) as distance, cast(place as integer) as place from (select *, row_number() over (partition by id order by distance, pid) as place from d) where place <= 5""")
def nearest_five(spark, sf):
    """The five nearest points of every point."""
    p = _xyz(spark, sf)
    out = nearest(p.withColumnRenamed("vec_id", "id"), p.withColumnRenamed("vec_id", "pid"), 5, 0.05)
    return out.select("id", "pid", F.round("distance", 6).alias("distance"), "place")


@query(f"""with d as (select a.vec_id as id, b.label, row_number() over (partition by a.vec_id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.vec_id) as place from {_P} a, {_P} b),
v as (select id, label, count(*) as n from d where place <= 5 group by 1, 2) select id, label, n from (select *, row_number() over (partition by id order by n desc, label) as rn from v) where rn = 1""")
def neighbour_vote(spark, sf):
    """The commonest label of the five nearest, the lowest winning ties."""
    p = materialize(_xyz(spark, sf), "xyz")
    hits = nearest(p.withColumnRenamed("vec_id", "id"), p.withColumnRenamed("vec_id", "pid"), 5, 0.05)
    return R.mode_lowest(hits.join(p.select(F.col("vec_id").alias("pid"), "label"), "pid"), ["id"], "label")


@query(f"""with c as (select label, avg(x) as cx, avg(y) as cy, avg(z) as cz from {_P} group by 1) select vec_id, best from
(select p.vec_id, c.label as best, row_number() over (partition by p.vec_id order by round((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) + (p.z - c.cz) * (p.z - c.cz), 12), c.label) as rn from {_P} p, c) where rn = 1""")
def nearest_centroid(spark, sf):
    """The label whose centroid is nearest."""
    p = materialize(_xyz(spark, sf), "xyz")
    c = p.groupBy("label").agg(*[F.avg(k).alias(k) for k in "xyz"]).withColumnRenamed("label", "pid")
    return nearest(p.withColumnRenamed("vec_id", "id"), c, 1, 0.1).select(F.col("id").alias("vec_id"), F.col("pid").alias("best"))


@query(f"""select label, count(*) as n, round(avg(x), 6) as cx, round(avg(y), 6) as cy, round(avg(z), 6) as cz, round(case when count(*) < 2 then 0 else max(x) - min(x) end, 6) as ex, round(case when count(*) < 2 then 0 else max(y) - min(y) end, 6) as ey,
round(covar_pop(x, y) * count(*), 5) as cxy, round(covar_pop(x, x) * count(*), 5) as cxx from {_P} group by 1""")
def centroid_extent(spark, sf):
    """Centroid, extent and sums of products of each cloud."""
    n, few = F.count("*"), F.count("*") < 2
    return _xyz(spark, sf).groupBy("label").agg(
        n.alias("n"), *[F.round(F.avg(k), 6).alias(f"c{k}") for k in "xyz"], *[F.round(F.when(few, 0.0).otherwise(F.max(k) - F.min(k)), 6).alias(f"e{k}") for k in "xy"],
        F.round(F.covar_pop("x", "y") * n, 5).alias("cxy"), F.round(F.covar_pop("x", "x") * n, 5).alias("cxx"),
    )


@query(f"""with c as (select label, avg(x) as cx, avg(y) as cy, avg(z) as cz from {_P} group by 1), r as (select p.*, cx, cy, cz, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) as r from {_P} p join c using (label)),
s as (select label, quantile_cont(r, 0.99) as s from r group by 1)
select vec_id, round((x - cx) / s, 5) as nx, round((y - cy) / s, 5) as ny, round((z - cz) / s, 5) as nz, round((x - cx) / s * s + cx - x, 6) + 0.0 as back from r join s using (label)""")
def normalised(spark, sf):
    """Clouds centred and scaled by the 99th percentile of their radius, and back."""
    p = _xyz(spark, sf)
    c = p.groupBy("label").agg(*[F.avg(k).alias(f"c{k}") for k in "xyz"])
    r = p.join(c, "label").withColumn("r", F.sqrt(sum(((F.col(k) - F.col(f"c{k}")) * (F.col(k) - F.col(f"c{k}")) for k in "yz"), (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")))))
    r = materialize(r, "radius")
    s = R.exact_percentiles(r, ["label"], "r", {"s": 0.99}).drop("n")
    unit = {k: (F.col(k) - F.col(f"c{k}")) / F.col("s") for k in "xyz"}
    return r.join(s, "label").select("vec_id", *[F.round(u, 5).alias(f"n{k}") for k, u in unit.items()], (F.round(unit["x"] * F.col("s") + F.col("cx") - F.col("x"), 6) + 0.0).alias("back"))


_Q = "(select vec_id, label, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z, cast(embedding[4] as double) as u, cast(embedding[5] as double) as v, cast(embedding[6] as double) as w from embeddings)"


def _pairs(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", V.vec(*[F.col("embedding")[i] for i in range(3)]).alias("a"), V.vec(*[F.col("embedding")[i] for i in range(3, 6)]).alias("b"))


@query(f"""select vec_id, round(degrees(acos(least(1, abs(x * u + y * v + z * w) / (sqrt(x * x + y * y + z * z) * sqrt(u * u + v * v + w * w))))), 3) as angle,
round(sqrt((y * w - z * v) * (y * w - z * v) + (z * u - x * w) * (z * u - x * w) + (x * v - y * u) * (x * v - y * u)), 6) as cross_norm, round((-y) * (-1.0) + 2.0 * 0, 6) as px, round(x + 2.0, 6) as py, round(z + 3.0, 6) as pz from {_Q}""")
def axis_errors(spark, sf):
    """Angles between axes, and points after a quarter turn about z and a shift."""
    m, t = V.rodrigues(V.vec(F.lit(0), F.lit(0), F.lit(1)), F.lit(1.5707963267948966)), V.vec(F.lit(0), F.lit(2), F.lit(3))
    d = _pairs(spark, sf)
    p = V.move(m, t, F.col("a"))
    flip = lambda c: F.round(c, 6) + 0.0
    return d.select("vec_id", F.round(V.axis_angle_error(F.col("a"), F.col("b")), 3).alias("angle"), F.round(V.norm(V.cross(F.col("a"), F.col("b"))), 6).alias("cross_norm"), flip(-p[0]).alias("px"), flip(p[1]).alias("py"), flip(p[2]).alias("pz"))


@query(f"""select vec_id, round(case when z > 1e-6 then 600 * x / z + 320 end, 3) as u, round(case when z > 1e-6 then 600 * y / z + 240 end, 3) as v, z > 1e-6 as seen,
round(sqrt((x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w)), 6) as apart from {_Q.replace("as u,", "as u,")}""")
def projections(spark, sf):
    """Pixels of points before a camera; those behind it have none."""
    d = _pairs(spark, sf)
    px = V.project(F.col("a"), 600.0, 320.0, 240.0)
    return d.select("vec_id", F.round(px[0], 3).alias("u"), F.round(px[1], 3).alias("v"), (F.col("a")[2] > 1e-6).alias("seen"), F.round(V.norm(V.minus(F.col("a"), F.col("b"))), 6).alias("apart"))


@query(f"""with m as (select label, median(sqrt(x * x + y * y + z * z)) as m from {_P} group by 1)
select p.label, count(*) filter (sqrt(x * x + y * y + z * z) < 10 * m.m) as kept, count(*) filter (sqrt(x * x + y * y + z * z) < 0.3) as inside, count(*) filter (z > 0) as above from {_P} p join m using (label) group by 1""")
def crops(spark, sf):
    """Points within ten medians, in a sphere and above a plane."""
    p = materialize(_xyz(spark, sf).withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))), "radius")
    m = R.exact_percentiles(p, ["label"], "r", {"m": 0.5}).drop("n")
    return p.join(m, "label").groupBy("label").agg(F.count_if(F.col("r") < 10 * F.col("m")).alias("kept"), F.count_if(F.col("r") < 0.3).alias("inside"), F.count_if(F.col("z") > 0).alias("above"))


@query("""select example_id, cast(count(*) as bigint) as n, count(distinct p.label) as labels, count(*) filter (p.label < 0) as unlabelled, round(max(cast(p.x as double)) - min(cast(p.x as double)), 5) as ex
from (select example_id, unnest(points) as p from (select * from (select *, row_number() over (partition by example_id order by created_at desc) as rn from shard_example) where rn = 1)) group by 1""")
def example_clouds(spark, sf):
    """Points, labels and extent of each example."""
    x = newest(read_table(spark, sf, "shard_example").select("example_id", "points", "created_at"), "example_id", "created_at").select("example_id", F.explode("points").alias("p"))
    return x.groupBy("example_id").agg(F.count("*").alias("n"), F.countDistinct("p.label").alias("labels"), F.count_if(F.col("p.label") < 0).alias("unlabelled"), F.round(F.max(F.col("p.x").cast("double")) - F.min(F.col("p.x").cast("double")), 5).alias("ex"))
