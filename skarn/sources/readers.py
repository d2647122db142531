"""Readers of catalogs, robot descriptions, cameras, limits and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.catalog import licence_of, looks_like_robot_xml

MANIFEST = (
    "source string, path string, format string, family string, vendor string, status string, dof int, joint_types array<string>, link_count int, actuated_link_count int, total_mass double,"
    " link_mesh_count int, meshes_resolved int, meshes_unresolved int, notes string, quality_tier string, license string, dedup_group_size int, dedup_group_id string, is_canonical boolean,"
    " dup_of string, canonical_train_set boolean, mesh_bytes_total bigint, joint_range_total_rad double, joint_range_total_m double, aabb_extent_m array<double>, fidelity_class string, scale_class string"
)
ROBOT_XML = (
    "_name string, link array<struct<_name: string, inertial: struct<mass: struct<_value: double>>, visual: array<struct<geometry: struct<mesh: struct<_filename: string>>>>>>,"
    " joint array<struct<_name: string, _type: string, parent: struct<_link: string>, child: struct<_link: string>, limit: struct<_lower: double, _upper: double>>>"
)
_RELATIVE = r"^.*?{root}/"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A catalog: one JSON array of entries, or one entry a line; missing keys are null."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """source, path, format of each model file below root: urdf, then sdf, then xml that looks
    like a model. Paths that differ in case only are one file, the first of that order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{urdf,sdf,xml,URDF,SDF,XML}").load(root)
    rel = F.regexp_replace(F.col("path"), f"^.*?{root.rstrip('/').split('/')[-1]}/", "")
    f = files.select(rel.alias("path"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("format"), F.decode(F.substring("content", 1, 4096), "UTF-8").alias("head"))
    f = f.filter((F.col("format") != "xml") | looks_like_robot_xml(F.col("head")))
    rank = F.when(F.col("format") == "urdf", 0).when(F.col("format") == "sdf", 1).otherwise(2)
    first = f.groupBy(F.lower("path").alias("k")).agg(F.min(F.struct(rank, "path", "format")).alias("x"))
    return first.select(F.split("x.path", "/")[0].alias("source"), "x.path", "x.format")


def scan_robot_xml(df: DataFrame, key: str, xml: str) -> DataFrame:
    """key, name, links, dof, joint_types, total_mass, meshes, root of each description; a text
    that is no XML of a robot has null numbers (status 'parse_failed')."""
    ok = F.col(xml).rlike(r"(?is)^\s*(<\?.*?\?>\s*)?(<!--.*?-->\s*)*<robot\b.*</robot>\s*$")
    r = df.select(key, F.when(ok, F.from_xml(xml, ROBOT_XML)).alias("r"))
    joints = F.filter(F.coalesce("r.joint", F.array().cast("array<struct<_name:string,_type:string,parent:struct<_link:string>,child:struct<_link:string>,limit:struct<_lower:double,_upper:double>>>")), lambda j: j["_type"] != "fixed")
    every = F.coalesce(F.transform("r.joint", lambda j: j["child"]["_link"]), F.array().cast("array<string>"))
    names = F.transform("r.link", lambda x: x["_name"])
    mass = F.aggregate("r.link", F.lit(0.0), lambda s, x: s + F.coalesce(x["inertial"]["mass"]["_value"], F.lit(0.0)))
    meshes = F.flatten(F.transform("r.link", lambda x: F.coalesce(F.transform(x["visual"], lambda v: v["geometry"]["mesh"]["_filename"]), F.array().cast("array<string>"))))
    return r.select(
        key, F.when(F.col("r").isNull(), "parse_failed").otherwise("ok").alias("status"), F.col("r._name").alias("name"), F.when(F.col("r").isNotNull(), F.size("r.link")).alias("links"),
        F.when(F.col("r").isNotNull(), F.size(joints)).alias("dof"), F.when(F.col("r").isNotNull(), F.transform(joints, lambda j: j["_type"])).alias("joint_types"), mass.alias("total_mass"),
        F.filter(meshes, lambda m: m.isNotNull()).alias("meshes"), F.get(F.array_except(names, every), F.lit(0)).alias("root"),
    )


def licence_blocks(df: DataFrame, text: str) -> DataFrame:
    """directory, licence of a licence file: blocks between lines of '=', in which one that names
    a directory is followed by its text."""
    blocks = df.select(F.posexplode(F.split(F.col(text), r"(?m)^=+\s*$\n")).alias("i", "block"))
    name = F.regexp_extract("block", r"License for contents in the directory '([^']+)'", 1)
    named = blocks.select("i", "block", F.regexp_replace(name, "/+$", "").alias("directory"))
    heads = named.filter("directory <> ''").select("directory", (F.col("i") + 1).alias("i"))
    return heads.join(named.filter("directory = ''").select("i", "block"), "i").select("directory", licence_of(F.col("block")).alias("licence"))


def _size(prefix: str = "") -> list:
    c = lambda n: F.col(prefix + n)
    return [F.coalesce(c("w"), c("width"), F.get(c("image_size"), F.lit(0))).alias("width"), F.coalesce(c("h"), c("height"), F.get(c("image_size"), F.lit(1))).alias("height")]


def read_camera_list(spark: SparkSession, path: str) -> DataFrame:
    """name, width, height, fx, fy, cx, cy, rotation, shift (world to camera) of a camera list.

    The principal point is the middle, fy is fx, and a name the index where they are missing; a
    camera at C turned by R sees a point p at R^T p - R^T C."""
    c = spark.read.schema("id int, img_name string, width int, height int, position array<double>, rotation array<array<double>>, fx double, fy double, cx double, cy double").json(path, multiLine=True)
    back = F.array(*[F.col("rotation")[j][i] for i in range(3) for j in range(3)])
    shift = F.array(*[-(F.col("rotation")[0][i] * F.col("position")[0] + F.col("rotation")[1][i] * F.col("position")[1] + F.col("rotation")[2][i] * F.col("position")[2]) for i in range(3)])
    return c.select(F.coalesce("img_name", F.format_string("%05d", "id")).alias("name"), "width", "height", "fx", F.coalesce("fy", "fx").alias("fy"), F.coalesce("cx", F.col("width") / 2).alias("cx"), F.coalesce("cy", F.col("height") / 2).alias("cy"), back.alias("rotation"), shift.alias("shift"))


_INTRINSICS = "fl_x double, fl_y double, cx double, cy double, w int, h int, width int, height int, image_size array<int>, camera_matrix array<array<double>>"


def read_camera_frames(spark: SparkSession, path: str) -> DataFrame:
    """name, width, height, fx, fy, cx, cy, rotation, shift of a file of frames, whose camera is
    theirs or shared; the poses look along -z, so y and z are turned before they are undone."""
    frame = f"struct<file_path: string, transform_matrix: array<array<double>>, {_INTRINSICS.replace(' double', ': double').replace(' int', ': int').replace(' array', ': array')}>"
    d = spark.read.schema(f"{_INTRINSICS}, frames array<{frame}>").json(path, multiLine=True).select("*", F.explode("frames").alias("f"))
    pick = lambda n, i, j: F.coalesce(F.col(f"f.{n}"), F.get(F.get(F.col("f.camera_matrix"), F.lit(i)), F.lit(j)), F.col(n), F.get(F.get(F.col("camera_matrix"), F.lit(i)), F.lit(j)))
    m = lambda i, j: F.col("f.transform_matrix")[i][j] * (1.0 if j == 0 else -1.0)
    rot = F.array(*[m(j, i) for i in range(3) for j in range(3)])
    shift = F.array(*[-(m(0, i) * F.col("f.transform_matrix")[0][3] + m(1, i) * F.col("f.transform_matrix")[1][3] + m(2, i) * F.col("f.transform_matrix")[2][3]) for i in range(3)])
    own, shared = _size("f."), _size()
    return d.select(F.regexp_replace(F.element_at(F.split("f.file_path", "/"), -1), r"\.\w+$", "").alias("name"), F.coalesce(own[0], shared[0]).alias("width"), F.coalesce(own[1], shared[1]).alias("height"), pick("fl_x", 0, 0).alias("fx"), F.coalesce(pick("fl_y", 1, 1), pick("fl_x", 0, 0)).alias("fy"), pick("cx", 0, 2).alias("cx"), pick("cy", 1, 2).alias("cy"), rot.alias("rotation"), shift.alias("shift"))


def read_cameras(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cameras of a file of either schema: '3dgs' or 'nerfstudio'."""
    if schema not in ("3dgs", "nerfstudio"):
        raise ValueError(f"unknown camera schema {schema!r}")
    return read_camera_list(spark, path) if schema == "3dgs" else read_camera_frames(spark, path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """fx, fy, cx, cy and five distortion numbers, missing ones 0."""
    c = spark.read.schema("camera_matrix array<array<double>>, dist_coeffs array<double>").json(path, multiLine=True)
    k = F.col("camera_matrix")
    return c.select(k[0][0].alias("fx"), k[1][1].alias("fy"), k[0][2].alias("cx"), k[1][2].alias("cy"), F.slice(F.concat(F.coalesce("dist_coeffs", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), 5)), 1, 5).alias("dist"))


def read_limits(spark: SparkSession, text: str) -> DataFrame:
    """joint, lower, upper of a YAML text of limits; those not finite or not ordered are left out,
    and a text that is no such YAML has none."""
    rows = []
    try:
        import yaml

        for name, v in (yaml.safe_load(text) or {}).get("joints", {}).items():
            lo, hi = float(v["lower"]), float(v["upper"])
            if abs(lo) < float("inf") and abs(hi) < float("inf") and hi > lo:
                rows.append((str(name), lo, hi))
    except Exception:  # noqa: BLE001 - any text is allowed here
        rows = []
    return spark.createDataFrame(rows, "joint string, lower double, upper double")


def read_annotations(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, item, label for each entry of the JSON maps {item: label}; null labels and texts that
    are no such map have none."""
    m = df.select(key, F.explode(F.from_json(text, "map<string,int>")).alias("item", "label"))
    return m.filter("label is not null").select(key, F.col("item").cast("int").alias("item"), "label")


def image_sequences(files: DataFrame, path: str = "path") -> DataFrame:
    """joint (from 0), images: folders joint_<k> with at least two state* files, in their order."""
    f = files.select(F.regexp_extract(path, r"joint_(\d+)/state[^/]*$", 1).alias("k"), F.col(path).alias("p")).filter("k <> ''")
    return f.groupBy((F.col("k").cast("int") - 1).alias("joint")).agg(F.array_sort(F.collect_list("p")).alias("images")).filter(F.size("images") >= 2)


def resolve_meshes(refs: DataFrame, files: DataFrame) -> DataFrame:
    """owner, ref, found: the file a mesh reference means. refs: owner (path of the description),
    ref; files: path. file:// is dropped; package://pkg/sub is sought in the owner's folders from
    the nearest up, with and without the package's name, then anywhere by that ending; other
    references are relative to the owner. Candidates meet the listing in an equi-join."""
    r = refs.select("owner", "ref").distinct().withColumn("clean", F.regexp_replace("ref", "^file://", ""))
    pack = F.regexp_extract("clean", "^package://(.*)$", 1)
    folders = F.slice(F.split("owner", "/"), 1, F.greatest(F.size(F.split("owner", "/")) - 1, F.lit(0)))
    up = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda n: F.array_join(F.slice(folders, F.lit(1), n), "/"))
    inside = F.regexp_replace(pack, "^[^/]+/", "")
    join = lambda a, b: F.regexp_replace(F.concat(a, F.lit("/"), b), "^/", "")
    tries = F.when(pack != "", F.concat(F.transform(up, lambda d: F.struct(F.length(d).alias("depth"), join(d, pack).alias("path"))), F.transform(up, lambda d: F.struct(F.length(d).alias("depth"), join(d, inside).alias("path"))))).otherwise(F.array(F.struct(F.lit(0).alias("depth"), join(F.array_join(folders, "/"), F.regexp_replace("clean", r"^\./", "")).alias("path"))))
    c = r.select("owner", "ref", F.explode(tries).alias("t")).select("owner", "ref", "t.depth", "t.path").join(files.select("path").distinct(), "path")
    best = c.groupBy("owner", "ref").agg(F.max_by("path", F.struct("depth", "path")).alias("found"))
    base = lambda x: F.element_at(F.split(x, "/"), -1)
    left = r.join(best, ["owner", "ref"], "left_anti").filter(pack != "").select("owner", "ref", inside.alias("tail"), base(inside).alias("base"))
    any_ = left.join(files.select(F.col("path").alias("f"), base(F.col("path")).alias("base")), "base").filter(F.endswith(F.concat(F.lit("/"), F.col("f")), F.concat(F.lit("/"), F.col("tail")))).groupBy("owner", "ref").agg(F.min("f").alias("found"))
    return r.select("owner", "ref").join(best.unionByName(any_), ["owner", "ref"], "left")
