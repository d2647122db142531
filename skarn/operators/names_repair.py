"""Repair of training rows whose older names fit several catalog entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repair_names(rows: DataFrame, candidates: DataFrame, ranks: DataFrame) -> DataFrame:
    """id, name, repaired: each row's newer name, or its older one where none fits.

    rows: id, name (older form), dof, joint_types; candidates: name (older form), new_name, dof,
    joint_types, source; ranks: source, rank. A name with one candidate takes it; one with several
    takes the candidate of the same dof and the same joint types in any order, of the best ranked
    source and then the first name. Rows of a hot name meet one row per (name, dof, types).
    """
    c = candidates.join(ranks, "source", "left").select("name", "new_name", "dof", F.array_sort("joint_types").alias("types"), F.coalesce("rank", F.lit(99)).alias("rank"))
    single = c.groupBy("name").agg(F.min("new_name").alias("only"), F.countDistinct("new_name").alias("n"))
    exact = c.groupBy("name", "dof", "types").agg(F.min(F.struct("rank", "new_name")).alias("x")).select("name", "dof", "types", F.col("x.new_name").alias("fit"))
    r = rows.select("id", "name", "dof", F.array_sort("joint_types").alias("types")).join(single, "name", "left").join(exact, ["name", "dof", "types"], "left")
    new = F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("fit"))
    return r.select("id", F.coalesce(new, "name").alias("name"), new.isNotNull().alias("repaired"))


def ordered_dedup(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the order; keys compare without case."""
    cols = [F.col(c) for c in df.columns]
    first = df.groupBy(F.lower(key).alias("__k")).agg(F.min(F.struct(*order, F.struct(*cols).alias("__row"))).alias("__x"))
    return first.select("__x.__row.*")
