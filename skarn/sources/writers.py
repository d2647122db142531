"""Writers of catalogs, reports, shards and robot descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators.prefix import grouped_prefix


def write_manifest(df: DataFrame, path: str) -> None:
    """One entry a line, nulls kept."""
    df.write.option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], digits: int = 4) -> None:
    """Fixed columns in order with a header; numbers with decimals are rounded; missing columns
    are empty, others are left out."""
    kinds = dict(df.dtypes)
    cols = [F.lit(None).cast("string").alias(c) if c not in kinds else F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) for c in columns]
    df.select(*cols).write.option("header", True).csv(path)


def markdown_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line of a Markdown table per row; bars are escaped and nulls are empty."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def write_shards(examples: DataFrame, key: str, path: str, size: int) -> None:
    """Examples in shards of `size` rows in the order of their key, as folders shard=shard_000000."""
    s = grouped_prefix(examples, [], [key]).withColumn("shard", F.format_string("shard_%06d", ((F.col("rank") - 1) / size).cast("long"))).drop("rank")
    s.repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)


def stats_json(df: DataFrame, label: str) -> DataFrame:
    """One row with the JSON of a histogram {label: count}, for labels that are few."""
    h = df.groupBy(F.col(label).cast("string").alias("k")).agg(F.count("*").alias("n")).filter("k is not null")
    return h.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("json"))


def _text(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def robot_xml(joints: DataFrame, key: str) -> DataFrame:
    """key, xml: a description per group of joints (parent, child, type, origin and axis as three
    numbers, lower, upper); links are those that joints name, joints in the order of their child.
    A robot's joints are few and are gathered into its text."""
    three = lambda c: F.format_string("%.6f %.6f %.6f", F.col(c)[0].cast("double"), F.col(c)[1].cast("double"), F.col(c)[2].cast("double"))
    j = F.concat(
        F.lit('<joint name="joint_'), _text(F.col("child")), F.lit('" type="'), _text(F.col("type")), F.lit('"><parent link="link_'), _text(F.col("parent")), F.lit('"/><child link="link_'), _text(F.col("child")),
        F.lit('"/><origin xyz="'), three("origin"), F.lit('"/><axis xyz="'), three("axis"), F.lit('"/><limit lower="'), F.format_string("%.6f", F.col("lower").cast("double")), F.lit('" upper="'), F.format_string("%.6f", F.col("upper").cast("double")), F.lit('"/></joint>'),
    )
    g = joints.filter("parent is not null and child is not null").select(key, "parent", "child", j.alias("j")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("child", "parent", "j"))).alias("js"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("parent", "child"))))).alias("links"))
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<link name="link_'), x.cast("string"), F.lit('"/>'))), "")
    return g.select(key, F.concat(F.lit('<robot name="'), _text(F.col(key)), F.lit('">'), links, F.array_join(F.transform("js", lambda x: x["j"]), ""), F.lit("</robot>")).alias("xml"))


def write_texts(spark: SparkSession, texts: dict[str, str], root: str) -> None:
    """Few small files (descriptions, cameras, calibrations), by their paths below root."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, text in texts.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()


def replace_table(df: DataFrame, path: str) -> None:
    """df in the place of the table at path, which it may be computed from: it is written beside
    it first and takes its name when it is whole."""
    new = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").parquet(new)
    jvm = df.sparkSession._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{new} could not take the place of {path}")


def verify_rewrite(before: DataFrame, after: DataFrame, key: str, column: str, expected: Column) -> DataFrame:
    """One row: rows before and after, how many have another value of the column, how many of those
    were expected to stay (expected is over the row before), how many were expected to change and
    did not, and how many differ in any other column or are missing on one side."""
    rest = [c for c in before.columns if c not in (key, column)]
    a = before.select(F.col(key).alias("k"), F.col(column).alias("a"), F.xxhash64(F.lit(0), *rest).alias("ha"), F.coalesce(expected, F.lit(False)).alias("due"))
    b = after.select(F.col(key).alias("k2"), F.col(column).alias("b"), F.xxhash64(F.lit(0), *rest).alias("hb"))
    j = a.join(b, F.col("k") == F.col("k2"), "full")
    moved = ~F.col("a").eqNullSafe(F.col("b"))
    both = F.col("k").isNotNull() & F.col("k2").isNotNull()
    return j.agg(
        F.count("k").alias("rows_before"), F.count("k2").alias("rows_after"), F.count_if(both & moved).alias("changed"), F.count_if(both & moved & ~F.col("due")).alias("unexpected"),
        F.count_if(both & ~moved & F.col("due")).alias("missed"), F.count_if(~both | (F.col("ha") != F.col("hb"))).alias("other"),
    )


def pack_joints(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """key, the arrays filled with -1 to the longest of the table, and valid: which slots hold a
    joint. Null arrays are all filling."""
    widest = df.agg(F.max(F.greatest(*[F.coalesce(F.size(a), F.lit(0)) for a in arrays], F.lit(0)))).first()[0] or 0  # one number
    fill = lambda a: F.slice(F.concat(F.coalesce(F.col(a), F.array().cast("array<int>")), F.array_repeat(F.lit(-1), widest)), 1, max(widest, 1))
    valid = F.transform(F.sequence(F.lit(1), F.lit(max(widest, 1))), lambda i: i <= F.col("__n"))
    return df.withColumn("__n", F.coalesce(F.size(arrays[0]), F.lit(0))).select(key, *[fill(a).alias(a) for a in arrays], valid.alias("valid"))


def calibration_json(fx: Column, fy: Column, cx: Column, cy: Column, dist: Column) -> Column:
    """The JSON text of a camera's calibration."""
    rows = F.array(F.array(fx, F.lit(0.0), cx), F.array(F.lit(0.0), fy, cy), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return F.to_json(F.struct(rows.alias("camera_matrix"), dist.alias("dist_coeffs")))
