"""The best representative of each group of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.names import name_key

# The fields whose presence makes a record complete.
COUNTED = ("family", "vendor", "license", "total_mass", "mesh_bytes_total", "joint_range_total_rad", "aabb_extent_m", "fidelity_class", "scale_class")


def _filled(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    if kind == "string":
        return F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    return F.coalesce(F.size(c) > 0, F.lit(False)) if kind == "array" else F.col(c).isNotNull()


def survivors(catalog: DataFrame, groups: DataFrame, source_ref: DataFrame, fields: tuple[str, ...] = COUNTED) -> DataFrame:
    """One row per group: group_entry_id, entry_id, members, dominant, and each field merged.

    catalog: one row per entry_id with source, meshes_resolved, scanned_at and the fields;
    groups: entry_id, group_id; source_ref: source, trust_rank (1 is most trusted).
    entry_id is the record ranked first by completeness (how many fields are neither null nor
    blank), trust, resolved meshes and recency, the smallest entry_id deciding ties; the rank
    filter works before the shuffle too (group limit), so a group of a third of all rows is no
    hot task. Each field has the value of the most trusted, then most recent, then smallest
    entry that fills it, null if none does. dominant: against every other record of the group
    the first one is at least as good in all four and better in one. That holds just if it has
    the group's best value of each and no other record has all four. A null is worse than any
    value; a source that source_ref does not list is trusted least. Groups of one are dominant.
    """
    trust = source_ref.select(name_key(F.col("source")).alias("__source"), "trust_rank").groupBy("__source").agg(F.min("trust_rank").alias("__trust"))
    full = sum((_filled(catalog, c).cast("int") for c in fields), F.lit(0))
    e = catalog.select("entry_id", name_key(F.col("source")).alias("__source"), full.alias("__full"), F.col("meshes_resolved").alias("__meshes"), F.col("scanned_at").alias("__when"), *fields)
    e = e.join(trust, "__source", "left").join(groups.select("entry_id", F.col("group_id").alias("group_entry_id")), "entry_id")
    four = ["__full", "__trust", "__meshes", "__when"]
    w = Window.partitionBy("group_entry_id").orderBy(F.col("__full").desc(), F.col("__trust").asc_nulls_last(), F.col("__meshes").desc_nulls_last(), F.col("__when").desc_nulls_last(), "entry_id")
    top = e.select("group_entry_id", "entry_id", *four).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    weight = F.struct(F.coalesce(-F.col("__trust"), F.lit(-(2**31) + 1)), F.col("__when"), -F.col("entry_id"))
    merged = [F.max_by(F.col(c), F.when(_filled(catalog, c), weight)).alias(c) for c in fields]
    best = e.groupBy("group_entry_id").agg(F.count("*").alias("members"), F.max("__full").alias("b0"), F.min("__trust").alias("b1"), F.max("__meshes").alias("b2"), F.max("__when").alias("b3"), *merged)
    # how many records share the first one's four values: counted per value, not per pair
    alike = e.groupBy("group_entry_id", *four).agg(F.count("*").alias("__alike"))
    alike = alike.select(F.col("group_entry_id").alias("__g"), *[F.col(c).alias(f"{c}a") for c in four], "__alike")
    out = top.join(best, "group_entry_id")
    same = F.col("group_entry_id") == F.col("__g")
    for c in four:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}a"))
    out = out.join(alike, same)
    dominant = F.col("__alike") == 1
    for i, c in enumerate(four):
        dominant = dominant & F.col(c).eqNullSafe(F.col(f"b{i}"))
    return out.select("group_entry_id", "entry_id", "members", dominant.alias("dominant"), *fields)
