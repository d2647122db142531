"""Dataset preparation, metrics, sampling and estimation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions.catalog import clean_label, joint_code
from skarn.operators import augment as A
from skarn.operators import fits as T
from skarn.operators import metrics as M
from skarn.operators import prepare as P
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


@query("""with k as (select distinct s_suppkey as key, s_nationkey as stratum from supplier), r as (select *, row_number() over (partition by stratum order by md5(cast(key as varchar)), key) as rn, count(*) over (partition by stratum) as n from k)
select key, stratum, case when rn <= case when n >= 2 then greatest(1, cast(round_even(n * 0.1, 0) as integer)) else 0 end then 'val' else 'train' end as part from r""")
def stratified_split(spark, sf):
    """Groups split within strata, lone ones to training."""
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("stratum"))
    return P.group_split(s, "key", "stratum", 0.1)


@query("""with r as (select s_suppkey as key, row_number() over (order by md5(cast(s_suppkey as varchar)), s_suppkey) as rn, count(*) over () as n from supplier) select key, case when rn <= greatest(1, round_even(n * 0.15, 0)) then 'val' else 'train' end as part from r""")
def group_split(spark, sf):
    """Groups split by the order of a hash."""
    return P.group_split(read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key")), "key", None, 0.15)


@query("""select example_id, list_resize(list_transform(joint_types, lambda x: case when x >= 0 and x < 64 then x else -1 end), 8, -1)::integer[] as types, cast(least(len(joint_types), 8) as integer) as n
from (select * from (select *, row_number() over (partition by example_id order by created_at desc) as rn from training_example) where rn = 1)""")
def padded_joints(spark, sf):
    """Joint types cut or filled to eight slots, labels out of range cleaned."""
    t = newest(read_table(spark, sf, "training_example").select("example_id", "joint_types", "created_at"), "example_id", "created_at")
    return t.select("example_id", P.pad(F.transform("joint_types", clean_label_of), 8, F.lit(-1)).alias("types"), F.least(F.size("joint_types"), F.lit(8)).alias("n"))


def clean_label_of(x):
    return clean_label(x)


@query("""select t as name, cast(case t when 'revolute' then 0 when 'continuous' then 1 when 'prismatic' then 2 when 'fixed' then 3 when 'floating' then 4 when 'planar' then 5 else 3 end as integer) as code, count(*) as n
from (select unnest(joint_types) as t from (select * from (select *, row_number() over (partition by entry_id order by ingested_at desc) as rn from catalog_entry) where rn = 1)) group by all""")
def joint_codes(spark, sf):
    """Joint types and their codes; unknown types are fixed (C17)."""
    e = newest(read_table(spark, sf, "catalog_entry").select("entry_id", "joint_types", "ingested_at"), "entry_id", "ingested_at")
    return e.select(F.explode("joint_types").alias("name")).groupBy("name", joint_code(F.col("name")).alias("code")).agg(F.count("*").alias("n"))


_L = "(select l_returnflag as g, l_linenumber - 2 as label, (l_suppkey % 7) - 1 as predicted, l_discount * 20 - 1 as d, l_quantity / 25 - 1 as logit, cast(l_linestatus = 'O' as double) as target, l_linestatus = 'O' as valid, l_tax from lineitem)"


@query(f"""select g, round(coalesce(avg(case when label >= 0 then cast(predicted = label as double) end), 0), 6) as accuracy,
round(coalesce(sum(case when valid then case when abs(d) < 1 then 0.5 * d * d else abs(d) - 0.5 end end), 0) / greatest(count(*) filter (valid), 1), 5) as origin,
round(avg(greatest(logit, 0) - logit * target + ln(1 + exp(-abs(logit)))), 5) as bce, round(avg(cast((logit > 0) = valid as double)), 6) as valid_accuracy,
round(coalesce(sum(case when valid then 1 - abs(cos(d)) end), 0) / greatest(count(*) filter (valid), 1), 5) as axis from {_L} group by 1""")
def masked_metrics(spark, sf):
    """Accuracy, smooth L1, binary cross entropy and axis loss over valid rows."""
    li = read_table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("g"), (F.col("l_linenumber") - 2).alias("label"), (F.col("l_suppkey") % 7 - 1).alias("predicted"), (F.col("l_discount") * 20 - 1).alias("d"),
        (F.col("l_quantity") / 25 - 1).alias("logit"), (F.col("l_linestatus") == "O").alias("valid"),
    )
    hit = ((F.col("logit") > 0) == F.col("valid")).cast("double")
    return li.groupBy("g").agg(
        F.round(M.accuracy(F.col("predicted"), F.col("label")), 6).alias("accuracy"), F.round(M.masked_mean(M.smooth_l1(F.col("d")), F.col("valid")), 5).alias("origin"),
        F.round(F.avg(M.bce_with_logits(F.col("logit"), F.col("valid").cast("double"))), 5).alias("bce"), F.round(F.avg(hit), 6).alias("valid_accuracy"),
        F.round(M.masked_mean(M.axis_loss(F.cos("d")), F.col("valid")), 5).alias("axis"),
    )


@query("""with e as (select label, [cast(embedding[1] as double), cast(embedding[2] as double), cast(embedding[3] as double)] as x, label % 4 - 1 as y from embeddings), c as (select *, list_max(x) as m from e)
select label, round(avg(case when y >= 0 then m + ln(exp(x[1] - m) + exp(x[2] - m) + exp(x[3] - m)) - x[y + 1] end), 6) as loss, round(max(x[1]), 6) as pooled from c group by 1""")
def cross_entropy(spark, sf):
    """Cross entropy of logits, negative labels left out; largest feature per group."""
    e = read_table(spark, sf, "embeddings").select("label", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("x"), (F.col("label") % 4 - 1).alias("y"))
    return e.groupBy("label").agg(F.round(F.avg(M.cross_entropy(F.col("x"), F.col("y"))), 6).alias("loss"), F.round(F.max(F.col("x")[0]), 6).alias("pooled"))


@query("""select l_suppkey, round(a + b + c + 0.5 * d + 0.5 * b + 0.5 * c, 5) as total, a >= 0.5 and b * 100 < 5.2 and c * 100 < 4.2 as passes from
(select l_suppkey, round(avg(l_quantity) / 50, 6) as a, round(avg(l_discount), 6) as b, round(avg(l_tax), 6) as c, round(avg(l_linenumber), 6) as d from lineitem group by 1)""")
def totals_and_gates(spark, sf):
    """Weighted sum of losses, and whether all gates pass."""
    g = read_table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity") / 50, 6).alias("a"), F.round(F.avg("l_discount"), 6).alias("b"), F.round(F.avg("l_tax"), 6).alias("c"), F.round(F.avg("l_linenumber"), 6).alias("d"))
    a, b, c, d = (F.col(k) for k in "abcd")
    ok = M.gates(a + 0.45, b * 100 - 3.2, c * 100 + 0.8)
    return g.select("l_suppkey", F.round(M.weighted_total(a, b, c, d, b, c), 5).alias("total"), ok.alias("passes"))


@query("""with f as (select n.name, min(s.shard) as first from (select shard, unnest(names) as name from (select * from (select *, row_number() over (partition by shard order by written_at desc) as rn from shard) where rn = 1)) n join shard s on s.shard = n.shard group by 1) select name, cast(row_number() over (order by first, name) - 1 as bigint) as code from f""")
def dictionary_codes(spark, sf):
    """Numbers for names in the order they are first seen."""
    from skarn.operators.prefix import grouped_prefix

    s = newest(read_table(spark, sf, "shard").select("shard", "names", "written_at"), "shard", "written_at").select("shard", F.explode("names").alias("name"))
    return grouped_prefix(s.groupBy("name").agg(F.min("shard").alias("first")), [], ["first", "name"]).select("name", (F.col("rank") - 1).alias("code"))


@query()
def joint_samples(spark, sf):
    """A position for each joint of each example, from seeds and keys (M1)."""
    x = newest(read_table(spark, sf, "shard_example").select("example_id", "joints", "created_at"), "example_id", "created_at").select("example_id", F.posexplode("joints").alias("k", "j"))
    lo, hi = F.nanvl(F.col("j.lower"), F.lit(-1.0)).cast("double"), F.nanvl(F.col("j.upper"), F.lit(1.0)).cast("double")
    return x.select("example_id", "k", F.round(A.joint_config(F.col("j.type"), lo, hi, 11, F.col("example_id"), F.col("k")), 6).alias("position"), lo.alias("lower"), hi.alias("upper"))


@query()
def augmented_points(spark, sf):
    """Points of each example with noise and a random turn, a tenth dropped."""
    x = newest(read_table(spark, sf, "shard_example").select("example_id", "points", "created_at"), "example_id", "created_at").select("example_id", F.posexplode("points").alias("k", "p"))
    angle = A.uniform(3, F.col("example_id")) * 6.283185307179586
    u, v = A.yaw(F.col("p.x").cast("double"), F.col("p.y").cast("double"), angle)
    x = x.select("example_id", (F.col("example_id") * 100000 + F.col("k")).alias("id"), A.noise(u, 0.001, 5, F.col("example_id"), F.col("k")).alias("x"), A.noise(v, 0.001, 6, F.col("example_id"), F.col("k")).alias("y"), F.col("p.z").cast("double").alias("z"))
    return A.drop_share(x, ["example_id"], "id", 0.1, 9)


@query()
def surface_samples(spark, sf):
    """Points on faces by area: orders as meshes, lines as faces (M2)."""
    li = read_table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("area"))
    return A.surface_points(li, "l_suppkey", "l_partkey", "area", 32, 4)


@query()
def circles(spark, sf):
    """A circle through each label's points, from sums."""
    e = read_table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    return T.circle_fits(e, ["label"])


@query()
def rigid_motions(spark, sf):
    """The motion between two triples of coordinates of each label, as a screw, from sums."""
    e = read_table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyzuvw")])
    return T.rigid_fits(e, ["label"])


@query("""with f as (select l_suppkey as mesh, l_partkey as face, min(l_linenumber) as cluster, max(case when l_partkey % 11 = 0 then cast(l_partkey % 3 + 100 as integer) end) as usr from lineitem group by 1, 2),
n as (select mesh, cluster, count(*) as n from f group by 1, 2), t as (select mesh, cluster, usr, count(*) as k, min(face) as ff from f where usr is not null group by 1, 2, 3),
b as (select *, row_number() over (partition by mesh, cluster order by k desc, ff) as rn from t), s as (select f.*, coalesce(f.usr, case when b.k / n.n > 0.1 then b.usr end) as fixed from f join n using (mesh, cluster) left join b on b.mesh = f.mesh and b.cluster = f.cluster and b.rn = 1),
r as (select mesh, cluster, row_number() over (partition by mesh order by min(face)) as rank from s where fixed is null group by 1, 2), m as (select mesh, coalesce(max(usr), -1) as base from f group by 1)
select s.mesh, s.face, cast(coalesce(s.fixed, m.base + r.rank) as integer) as label from s join m using (mesh) left join r on r.mesh = s.mesh and r.cluster = s.cluster""")
def merged_labels(spark, sf):
    """User labels over predicted clusters."""
    from skarn.operators.labels import merge_labels

    li = read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("mesh"), F.col("l_partkey").alias("face")).agg(F.min("l_linenumber").alias("cluster"))
    li = li.withColumn("user", F.when(F.col("face") % 11 == 0, (F.col("face") % 3 + 100).cast("int")))
    return merge_labels(li, "mesh", "face", "cluster", "user", 0.1)


@query("""select p_brand as g, count(*) as n, count(*) filter (p_size % 4 <> p_partkey % 4) as changed, count(distinct p_size % 4) as labels from part group by 1""")
def label_changes(spark, sf):
    """Rows whose label changed."""
    from skarn.operators.labels import changed_labels

    p = read_table(spark, sf, "part").select(F.col("p_brand").alias("g"), (F.col("p_size") % 4).alias("a"), (F.col("p_partkey") % 4).alias("b"))
    return changed_labels(p, ["g"], "a", "b").select("g", F.col("rows").alias("n"), "changed", F.col("labels_before").alias("labels"))


@query("""with c as (select string_split(path, '/')[1] || '/' || regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]*$', '\\1') as name, path as new_name, dof, list_sort(joint_types) as types, coalesce(r.trust_rank, 99) as rank
 from (select *, row_number() over (partition by entry_id order by ingested_at desc) as rn from catalog_entry) e left join source_ref r on r.source = e.source where rn = 1),
o as (select name, min(new_name) as only, count(distinct new_name) as n from c group by 1), x as (select * from (select *, row_number() over (partition by name, dof, types order by rank, new_name) as rn from c) where rn = 1)
select c.new_name as id, coalesce(case when o.n = 1 then o.only else x.new_name end, c.name) as name from c join o using (name) left join x on x.name = c.name and x.dof = c.dof and x.types = c.types""")
def repaired_names(spark, sf):
    """Older names resolved by degrees of freedom and joint types."""
    from skarn.operators.names_repair import repair_names

    e = newest(read_table(spark, sf, "catalog_entry").select("entry_id", "source", "path", "dof", "joint_types", "ingested_at"), "entry_id", "ingested_at")
    p = F.split("path", "/")
    c = e.select(F.col("path").alias("new_name"), F.concat_ws("/", p[0], F.regexp_replace(F.element_at(p, -1), r"(?<=.)\.[^.]*$", "")).alias("name"), "dof", "joint_types", "source")
    ranks = read_table(spark, sf, "source_ref").select("source", F.col("trust_rank").alias("rank"))
    return repair_names(c.withColumnRenamed("new_name", "id"), c, ranks).select("id", "name")
