"""Groups of catalog entries that describe one model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.names import group_key, path_key
from skarn.operators.graph import connected_components
from skarn.sources.tables import materialize, newest


def entries(catalog: DataFrame) -> DataFrame:
    """Each entry once, as delivered last."""
    return newest(catalog, "entry_id", "ingested_at" if "ingested_at" in catalog.columns else None)


def entry_groups(catalog: DataFrame) -> DataFrame:
    """(entry_id, group_id): group_id is the smallest entry_id of the entries that are linked,
    directly or through others, by the same dedup_group_id or by a dup_of that names a path.

    Spelling of ids and paths is brought together first. Null or blank ids link nothing, nor
    does a dup_of whose path no entry has. Entries with no link are groups of their own. A
    shared id becomes links to its smallest entry (a star, so n entries give n links, never
    pairs); the smallest is a partial aggregate, so an id on a third of all rows is no hot task.
    """
    e = catalog.select("entry_id", group_key(F.col("dedup_group_id")).alias("gid"), path_key(F.col("path")).alias("path"), path_key(F.col("dup_of")).alias("dup")).filter("entry_id is not null")
    e = materialize(e, "keys")  # read six times below
    hub = e.filter("gid is not null").groupBy("gid").agg(F.min("entry_id").alias("dst"), F.max("entry_id").alias("last")).filter("dst < last")
    by_id = e.filter("gid is not null").join(hub, "gid").select(F.col("entry_id").alias("src"), "dst")
    home = e.filter("path is not null").groupBy("path").agg(F.min("entry_id").alias("dst"), F.max("entry_id").alias("last"))
    by_path = e.filter("dup is not null").join(home.select(F.col("path").alias("dup"), "dst"), "dup").select(F.col("entry_id").alias("src"), "dst")
    same_path = e.filter("path is not null").join(home.filter("dst < last").select("path", "dst"), "path").select(F.col("entry_id").alias("src"), "dst")
    found = connected_components(by_id.unionByName(by_path).unionByName(same_path))
    return e.select("entry_id").distinct().join(found.withColumnRenamed("node", "entry_id"), "entry_id", "left").select("entry_id", F.coalesce("component", "entry_id").alias("group_id"))
