"""Files and tables that are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skarn.functions import catalog as C
from skarn.operators.prefix import grouped_prefix
from skarn.plans import sql as Q
from skarn.sources import readers, writers
from skarn.sources.tables import materialize, newest, read_table, shared_dir

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/skarn-{name}-{uuid.uuid4().hex}"


def _texts(spark: SparkSession, df, name: str) -> str:
    """The folder with a file per row of a fixed table: df has path and text."""
    root = _folder(spark, name)
    writers.write_texts(spark, {r.path: r.text for r in df.collect()}, root)
    return root


_FORMS = "case n_nationkey % 3 when 0 then 'urdf' when 1 then 'sdf' else 'xml' end"


@query(f"""with f as (select 'r' || n_regionkey as source, 'nation_' || n_nationkey || '.' || {_FORMS} as name, {_FORMS} as format, n_nationkey as k from nation)
select source, source || '/sub/' || case when k % 2 = 0 then upper(name) else name end as path, format from f where format <> 'xml' or k % 4 < 2""")
def discovered_files(spark, sf):
    """Model files found below a folder, by kind; paths that differ in case only count once (A1, A2)."""
    n = read_table(spark, sf, "nation")
    form = F.when(F.col("n_nationkey") % 3 == 0, "urdf").when(F.col("n_nationkey") % 3 == 1, "sdf").otherwise("xml")
    name = F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"), F.lit("."), form)
    head = F.concat(F.lit("data/r"), F.col("n_regionkey").cast("string"), F.lit("/sub/"))
    text = F.when((form != "xml") | (F.col("n_nationkey") % 4 < 2), "<mujoco/>").otherwise("<settings/>")
    low = n.select(F.concat(head, name).alias("path"), text.alias("text"))
    up = n.filter("n_nationkey % 2 = 0").select(F.concat(head, F.upper(name)).alias("path"), text.alias("text"))
    other = n.select(F.concat(head, F.lit("note_"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"), text.alias("text"))
    return readers.discover(spark, _texts(spark, low.unionByName(up).unionByName(other), "files") + "/data")


@query("""with j as (select example_id, unnest(joints) as j from (select * from (select *, row_number() over (partition by example_id order by created_at desc) as rn from shard_example) where rn = 1)),
d as (select distinct example_id, j.parent as p, j.child as c, j.type as t from j where j.parent >= 0 and j.child >= 0),
n as (select example_id, count(distinct l) as links from (select example_id, unnest([p, c]) as l from d) group by 1)
select example_id, links, cast(count(*) filter (t <> 3) as integer) as dof, 'ok' as status from d join n using (example_id) group by all""")
def scanned_robots(spark, sf):
    """Robot descriptions written from joints, and their links and degrees of freedom read back."""
    x = newest(read_table(spark, sf, "shard_example").select("example_id", "joints", "created_at"), "example_id", "created_at")
    names = F.create_map(*[F.lit(v) for kv in C.JOINT_CODES.items() for v in kv[::-1]])
    j = x.select("example_id", F.explode("joints").alias("j")).filter("j.parent >= 0 and j.child >= 0")
    j = j.select("example_id", F.col("j.parent").alias("parent"), F.col("j.child").alias("child"), F.coalesce(names[F.col("j.type")], F.lit("fixed")).alias("type")).distinct()
    zero = F.array(*[F.lit(0.0)] * 3)
    xml = materialize(writers.robot_xml(j.select("*", zero.alias("origin"), zero.alias("axis"), F.lit(-1.0).alias("lower"), F.lit(1.0).alias("upper")), "example_id"), "descriptions")
    return readers.scan_robot_xml(xml, "example_id", "xml").select("example_id", F.col("links").cast("long").alias("links"), "dof", "status")


@query(f"""select format, case lower(trim(format)) when 'urdf' then 'urdf' when 'mjcf' then 'mjcf' when 'xml' then 'mjcf' when 'sdf' then 'skipped: sdf' else 'skipped: unknown format ' || coalesce(lower(trim(format)), 'null') end as loads, count(*) as n from {Q.ENTRIES} group by all""")
def format_dispatch(spark, sf):
    """Which reader loads each format, and why others are skipped (A5)."""
    e = newest(read_table(spark, sf, "catalog_entry").select("entry_id", "format", "ingested_at"), "entry_id", "ingested_at")
    return e.groupBy("format", C.load_status(F.col("format")).alias("loads")).agg(F.count("*").alias("n"))


@query(f"""select source, path, dof, joint_types, round(total_mass, 4) as mass, cast(len(aabb_extent_m) as integer) as numbers, license from {Q.ENTRIES}""")
def manifest_round_trip(spark, sf):
    """The catalog written as a manifest and read back."""
    e = newest(read_table(spark, sf, "catalog_entry"), "entry_id", "ingested_at")
    path = _folder(spark, "manifest")
    writers.write_manifest(e.drop("entry_id", "scanned_at", "ingested_at"), path)
    m = spark.read.schema(readers.MANIFEST).json(path)
    return m.select("source", "path", "dof", "joint_types", F.round("total_mass", 4).alias("mass"), F.size("aabb_extent_m").alias("numbers"), "license")


@query("select l_linenumber, cast(count(*) as integer) as rows, round(avg(l_discount), 4) as loss, cast(null as varchar) as note from lineitem group by 1")
def metric_log(spark, sf):
    """A log of metrics written as CSV with fixed fields and rounding, and read back."""
    m = read_table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("rows"), F.avg("l_discount").cast("double").alias("loss"), F.lit("x").alias("extra"))
    path = _folder(spark, "log")
    writers.write_csv(m, path, ["l_linenumber", "rows", "loss", "note"])
    return spark.read.option("header", True).schema("l_linenumber int, rows int, loss double, note string").csv(path)


@query("select '| ' || n_nationkey || ' | ' || replace(n_name || '|' || n_regionkey, '|', '\\|') || ' |  |' as line from nation")
def markdown_report(spark, sf):
    """Lines of a Markdown table, written as text and read back."""
    n = read_table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("|"), F.col("n_regionkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("empty"))
    path = _folder(spark, "report")
    writers.markdown_lines(n, ["n_nationkey", "name", "empty"]).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""with t as (select * from (select *, row_number() over (partition by example_id order by created_at desc) as rn from training_example) where rn = 1), w as (select max(greatest(coalesce(len(joint_parents), 0), coalesce(len(joint_children), 0))) as n from t)
select example_id, printf('shard_%06d', (row_number() over (order by example_id) - 1) // 300) as shard, list_resize(coalesce(joint_parents, []), n, -1)::integer[] as joint_parents, cast(coalesce(len(joint_parents), 0) as integer) as joints from t, w""")
def packed_shards(spark, sf):
    """Examples with their joints filled to the longest, in shards of a size, read back by columns."""
    t = newest(read_table(spark, sf, "training_example").select("example_id", "joint_parents", "joint_children", "created_at"), "example_id", "created_at")
    path = _folder(spark, "shards")
    writers.write_shards(writers.pack_joints(t, "example_id", ["joint_parents", "joint_children"]), "example_id", path, 300)
    back = spark.read.parquet(path).select("example_id", "shard", "joint_parents", "valid")
    return back.select("example_id", "shard", "joint_parents", F.size(F.filter("valid", lambda v: v)).alias("joints"))


@query("select p_brand as brand, count(*) as n from part group by 1")
def shard_stats(spark, sf):
    """A histogram written as JSON and read back."""
    path = _folder(spark, "stats")
    writers.stats_json(read_table(spark, sf, "part"), "p_brand").select("json").write.text(path)
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("brand", "n"))


@query("select count(*) as rows_before, count(*) as rows_after, count(*) filter (s_suppkey % 3 = 0) as changed, 0 as unexpected, 0 as missed, 0 as other from supplier")
def verified_rewrite(spark, sf):
    """A table rewritten in its place, and what became of its rows."""
    before = read_table(spark, sf, "supplier")
    path = _folder(spark, "rewritten")
    before.write.parquet(path)
    due = F.col("s_suppkey") % 3 == 0
    writers.replace_table(spark.read.parquet(path).withColumn("s_name", F.when(due, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name"))), path)
    return writers.verify_rewrite(before, spark.read.parquet(path), "s_suppkey", "s_name", due)


_LICENCE = "case n_nationkey % 4 when 0 then 'MIT' when 1 then 'Apache-2.0' when 2 then 'Unknown' end"


@query(f"select c_custkey, coalesce({_LICENCE}, 'BSD-3-Clause') as licence from customer join nation on n_nationkey = c_nationkey")
def directory_licences(spark, sf):
    """Licences of directories from one licence file, laid over a default."""
    n = read_table(spark, sf, "nation").filter("n_nationkey % 4 < 3")
    body = F.when(F.col("n_nationkey") % 4 == 0, "MIT License").when(F.col("n_nationkey") % 4 == 1, "Apache License, Version 2.0").otherwise("all rights reserved")
    line = "=" * 20
    block = F.concat(F.lit(f"{line}\nLicense for contents in the directory 'd"), F.col("n_nationkey").cast("string"), F.lit(f"/'\n{line}\n"), body, F.lit("\n"))
    root = _texts(spark, n.agg(F.lit("LICENSE").alias("path"), F.concat(F.lit("head\n"), F.array_join(F.array_sort(F.collect_list(block)), "")).alias("text")), "licence")  # 25 nations
    found = readers.licence_blocks(spark.read.text(root, wholetext=True), "value")
    c = read_table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("directory"))
    return c.join(found, "directory", "left").select("c_custkey", F.coalesce("licence", F.lit("BSD-3-Clause")).alias("licence"))


@query("""select p_partkey, case p_partkey % 4 when 0 then 's' || p_partkey || '/pkg/meshes/a.stl' when 1 then 's' || p_partkey || '/pkg/urdf/b.stl' when 2 then 'far/meshes/m' || p_partkey || '.stl' end as found from part""")
def resolved_meshes(spark, sf):
    """The files that mesh references mean: package paths, relative ones, and any by their ending."""
    p = read_table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % 4).alias("q"))
    owner = F.concat(F.lit("s"), F.col("k"), F.lit("/pkg/urdf/r.urdf"))
    ref = F.when(F.col("q") == 0, "package://pkg/meshes/a.stl").when(F.col("q") == 1, "file://b.stl").when(F.col("q") == 2, F.concat(F.lit("package://other/meshes/m"), F.col("k"), F.lit(".stl"))).otherwise("gone.stl")
    file = F.when(F.col("q") == 0, F.concat(F.lit("s"), F.col("k"), F.lit("/pkg/meshes/a.stl"))).when(F.col("q") == 1, F.concat(F.lit("s"), F.col("k"), F.lit("/pkg/urdf/b.stl"))).when(F.col("q") == 2, F.concat(F.lit("far/meshes/m"), F.col("k"), F.lit(".stl"))).otherwise(F.concat(F.lit("s"), F.col("k"), F.lit("/x.stl")))
    found = readers.resolve_meshes(p.select(owner.alias("owner"), ref.alias("ref")), p.select(file.alias("path")))
    return found.select(F.regexp_extract("owner", r"^s(\d+)/", 1).cast(p.schema["p_partkey"].dataType).alias("p_partkey"), "found")


@query("""select case when n_nationkey % 2 = 0 then n_name else printf('%05d', n_nationkey) end as name, 600.0 + n_nationkey as fx, case when n_nationkey % 3 = 0 then 500.0 else 600.0 + n_nationkey end as fy, 320.0 as cx, 240.0 as cy, cast(-n_regionkey as double) as sx, cast(n_nationkey as double) as sy from nation""")
def camera_list(spark, sf):
    """Cameras of a list with missing names, focal lengths and middles; a turn about z by half."""
    n = read_table(spark, sf, "nation")
    d = lambda x: F.lit(float(x))
    cam = F.struct(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("img_name"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.array(-F.col("n_regionkey").cast("double"), F.col("n_nationkey").cast("double"), d(0)).alias("position"), F.array(F.array(d(-1), d(0), d(0)), F.array(d(0), d(-1), d(0)), F.array(d(0), d(0), d(1))).alias("rotation"), (F.col("n_nationkey") + 600.0).cast("double").alias("fx"), F.when(F.col("n_nationkey") % 3 == 0, d(500)).alias("fy"))
    root = _texts(spark, n.agg(F.lit("cameras.json").alias("path"), F.to_json(F.collect_list(cam)).alias("text")), "cameras")
    c = readers.read_cameras(spark, f"{root}/cameras.json", "3dgs")
    return c.select("name", "fx", "fy", "cx", "cy", F.col("shift")[0].alias("sx"), F.col("shift")[1].alias("sy")).withColumns({"sx": F.col("sx") + 0.0, "sy": F.col("sy") + 0.0})


@query("""select 'f' || n_nationkey as name, case when n_nationkey % 2 = 0 then 700.0 + n_nationkey else 650.0 end as fx, case when n_nationkey % 2 = 0 then 700.0 + n_nationkey else 655.0 end as fy, 321.0 as cx, 242.0 as cy, 640 as width, 480 as height, cast(-n_nationkey as double) as sx, cast(n_regionkey as double) as sy from nation""")
def camera_frames(spark, sf):
    """Cameras of frames, with numbers of their own or shared ones from a matrix, turned to look along z."""
    n = read_table(spark, sf, "nation")
    d = lambda x: F.lit(float(x))
    own = F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") + 700.0).cast("double"))
    pose = F.array(F.array(d(1), d(0), d(0), F.col("n_nationkey").cast("double")), F.array(d(0), d(1), d(0), F.col("n_regionkey").cast("double")), F.array(d(0), d(0), d(1), d(0)), F.array(d(0), d(0), d(0), d(1)))
    frame = F.struct(F.concat(F.lit("img/f"), F.col("n_nationkey").cast("string"), F.lit(".png")).alias("file_path"), pose.alias("transform_matrix"), own.alias("fl_x"), own.alias("fl_y"))
    shared = F.array(F.array(d(650), d(0), d(321)), F.array(d(0), d(655), d(242)), F.array(d(0), d(0), d(1)))
    root = _texts(spark, n.agg(F.lit("transforms.json").alias("path"), F.to_json(F.struct(shared.alias("camera_matrix"), F.array(F.lit(640), F.lit(480)).alias("image_size"), F.collect_list(frame).alias("frames"))).alias("text")), "frames")
    c = readers.read_cameras(spark, f"{root}/transforms.json", "nerfstudio")
    return c.select("name", "fx", "fy", "cx", "cy", "width", "height", (F.col("shift")[0] + 0.0).alias("sx"), (F.col("shift")[1] + 0.0).alias("sy"))


@query("""select cast(600 + n_nationkey as double) as fx, 601.0 as fy, 320.0 as cx, 240.0 as cy, list_resize(list_transform(range(0, n_nationkey % 7), lambda i: i * 0.5::double), 5, 0.0::double) as dist from nation""")
def calibrations(spark, sf):
    """Calibrations written as JSON and read back, the distortion cut or filled to five numbers."""
    n = read_table(spark, sf, "nation").withColumn("m", (F.col("n_nationkey") % 7).cast("int"))
    dist = F.slice(F.array(*[F.lit(i * 0.5) for i in range(6)]), F.lit(1), F.col("m"))
    text = writers.calibration_json((F.col("n_nationkey") + 600.0).cast("double"), F.lit(601.0), F.lit(320.0), F.lit(240.0), dist)
    return readers.read_calibration(spark, _texts(spark, n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".json")).alias("path"), text.alias("text")), "calibrations"))


@query("select 'j' || n_nationkey as joint, cast(-n_regionkey as double) as lower, n_nationkey - 3.0::double as upper from nation where n_nationkey - 3 > -n_regionkey and n_nationkey % 5 <> 0")
def joint_limits(spark, sf):
    """Limits of a YAML file; those that are not finite or not ordered are left out."""
    n = read_table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 nations
    text = "joints:\n" + "".join(f"  j{r.n_nationkey}:\n    lower: {-r.n_regionkey}\n    upper: {'.inf' if r.n_nationkey % 5 == 0 else r.n_nationkey - 3}\n" for r in n)
    return readers.read_limits(spark, text)


@query("select l_orderkey, l_linenumber as item, cast(min(l_suppkey % 5) as integer) as label from lineitem group by all")
def annotations(spark, sf):
    """JSON maps of items to labels, written and read back."""
    li = read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_suppkey") % 5).alias("v"))
    # an order has few lines
    m = li.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), "v")))).alias("text"))
    return readers.read_annotations(materialize(m, "annotations"), "l_orderkey", "text").select("l_orderkey", F.col("item").cast(li.schema["l_linenumber"].dataType).alias("item"), "label")


@query("""select cast(p_size - 1 as integer) as joint, cast(count(*) as integer) as images, min('b/joint_' || p_size || '/state' || p_partkey || '.png') as first from part where p_size <= 30 group by 1 having count(*) >= 2""")
def image_sequences(spark, sf):
    """Sequences of images by the names of their folders."""
    p = read_table(spark, sf, "part")
    path = F.when(F.col("p_size") <= 30, F.concat(F.lit("b/joint_"), F.col("p_size").cast("string"), F.lit("/state"), F.col("p_partkey").cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("b/other_"), F.col("p_size").cast("string"), F.lit("/state.png")))
    return readers.image_sequences(p.select(path.alias("path"))).select("joint", F.size("images").alias("images"), F.col("images")[0].alias("first"))


@query(f"""with p as (select lower(vendor) as pat, vendor as ven, row_number() over (order by vendor_id) as ord from vendor_ref), e as (select entry_id, lower(path) as path from {Q.ENTRIES}),
t as (select entry_id, path, list_filter(regexp_split_to_array(path, '[/\\\\]'), lambda x: x not in ('', 'urdfs', 'robots', 'mjcf', 'model', 'models', 'asset', 'assets', 'robot_assets')) as tok from e)
select t.entry_id, coalesce(arg_min(p.pat, p.ord), any_value(tok[1]), '') as family, coalesce(arg_min(p.ven, p.ord), '') as vendor from t left join p on contains(t.path, p.pat) group by t.entry_id""")
def inferred_vendors(spark, sf):
    """Family and vendor of each path by the first pattern of a table that occurs in it."""
    patterns = [(r.vendor.lower(), r.vendor) for r in read_table(spark, sf, "vendor_ref").select("vendor_id", "vendor").orderBy("vendor_id").collect()]  # a fixed table
    e = newest(read_table(spark, sf, "catalog_entry").select("entry_id", "path", "ingested_at"), "entry_id", "ingested_at")
    return e.select("entry_id", C.first_match(F.col("path"), patterns).alias("m")).select("entry_id", "m.family", "m.vendor")


@query("""with r as (select s_suppkey, s_name, row_number() over (order by s_name, s_suppkey) - 1 as place, count(*) over () as n from supplier), k as (select *, (place - 10) // 3 as step from r where place >= 10 and place < 10 + n // 2 and (place - 10) % 3 = 0)
select s_suppkey, place, step, step in (select (i * (m - 1)) // 6 from (select unnest(range(0, 7)) as i, (select count(*) from k) as m)) as even from k""")
def strided_rows(spark, sf):
    """Rows after the first ten, of half the list, every third, seven of them evenly spaced."""
    s = read_table(spark, sf, "supplier").select("s_suppkey", "s_name")
    n = s.count()
    r = grouped_prefix(s, [], ["s_name", "s_suppkey"]).select("s_suppkey", (F.col("rank") - 1).alias("place")).filter((F.col("place") >= 10) & (F.col("place") < 10 + n // 2))
    k = materialize(r.filter((F.col("place") - 10) % 3 == 0).withColumn("step", F.floor((F.col("place") - 10) / 3)), "strided")
    m = k.count()
    return k.withColumn("even", F.col("step").isin(*{i * (m - 1) // 6 for i in range(7)}))
