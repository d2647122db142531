"""Counts, histograms, leaders and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.prefix import grouped_prefix
from skarn.sources.tables import materialize


def counts_by_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, category, n: the counts by each column in one pass (grouping sets). A row is
    expanded before its shuffle and counted in part there, so no column's hot value is slow."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("category")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.category").agg(F.count("*").alias("n"))


def leaders(df: DataFrame, key: str, k: int, ascending: bool = False) -> DataFrame:
    """key, n: the k keys of most (or fewest) rows, ties by key."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").asc() if ascending else F.col("n").desc(), key).limit(k)


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """size, groups: how many keys have how many rows."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n and a percentile per name in shares, with linear interpolation between ranks.

    Values are counted first and the counts summed up across partitions, so no task holds the
    values of a hot group. Null values are left out, and with them groups of nothing else.
    """
    v = df.select(*by, F.col(value).alias("__v")).filter("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    ranked = grouped_prefix(v, by, ["__v", *by], "__c")
    total = v.groupBy(*by).agg(F.sum("__c").alias("n"))
    same = F.lit(True)
    for c in by:
        total = total.withColumnRenamed(c, f"__t_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
    j = ranked.join(total, same) if by else ranked.withColumn("__k", F.lit(1)).join(total.withColumn("__k", F.lit(1)), "__k")
    aggs = []
    for name, p in shares.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("__c"))
        lo, hi = F.max(F.when(holds(F.floor(at)), F.col("__v"))), F.max(F.when(holds(F.ceil(at)), F.col("__v")))
        aggs.append((lo + (hi - lo) * F.max(at - F.floor(at))).alias(name))
    return j.groupBy(*by).agg(F.max("n").alias("n"), *aggs)


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, low, median, p90, high of a value, by exact percentiles."""
    return exact_percentiles(df, by, value, {"low": 0.0, "median": 0.5, "p90": 0.9, "high": 1.0})


def nan_stats(value: Column, name: str) -> list[Column]:
    """Mean and population deviation that leave NaN out."""
    v = F.nanvl(value, F.lit(None).cast("double"))
    return [F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std")]


def mode_lowest(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, label, n: the commonest label >= 0, the lowest winning ties; none for groups without."""
    n = df.filter(F.col(label) >= 0).groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max(F.struct("n", (-F.col(label)).alias("neg"))).alias("top")).select(*by, (-F.col("top.neg")).alias(label), F.col("top.n").alias("n"))


def share_of_top(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """mode_lowest with the label's share of the group's rows of any label."""
    total = df.groupBy(*by).agg(F.count("*").alias("total"))
    return mode_lowest(df, by, label).join(total, by).withColumn("share", F.col("n") / F.col("total"))


def chunk_ids(df: DataFrame, order: list, size: int) -> DataFrame:
    """df with pos (from 0) in the order and chunk, its block of `size` rows, over all rows.

    Ranks come from `grouped_prefix`, so no single task sorts the table."""
    return grouped_prefix(df, [], order).withColumn("pos", F.col("rank") - 1).drop("rank").withColumn("chunk", (F.col("pos") / size).cast("long"))


def dense_ids(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """df with id: the key's place among the distinct keys of its group, from 0. Null keys and
    groups are left out."""
    keys = df.select(*by, key).dropna().distinct()
    return df.join(grouped_prefix(keys, by, [key, *by]).withColumn("id", F.col("rank") - 1).drop("rank"), [*by, key])


def next_rows(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, place, value, next, first: each row's value with the one after it and the first of
    its key (next is null for the last). Neighbours meet by place, so a hot key is no hot task;
    rows with a null key are left out."""
    r = materialize(grouped_prefix(df.filter(F.col(key).isNotNull()), [key], order).select(key, F.col("rank").alias("place"), value), "places")
    after = r.select(key, (F.col("place") - 1).alias("place"), F.col(value).alias("next"))
    first = r.filter("place = 1").select(key, F.col(value).alias("first"))
    return r.join(after, [key, "place"], "left").join(first, key)
