"""Vendors as the reference table names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.names import known, name_key
from skarn.operators.spelling import near_words

# Legal forms that are no part of a name.
LEGAL_FORMS = "inc|gmbh|ltd|llc|corp|co|company|limited"


def _bare(c: Column) -> Column:
    return name_key(F.regexp_replace(F.lower(F.trim(c)), rf"[\s,]+({LEGAL_FORMS})\.?$", ""))


def vendor_names(df: DataFrame, vendor_ref: DataFrame, column: str = "vendor") -> DataFrame:
    """(column, vendor_name) for each distinct known text of a column.

    A text names a vendor if its letters and digits, with or without a legal form, are those of
    the vendor's key, full name or an alias; or else, if it is near (one slip) those of just one
    vendor. Keys that two vendors share name neither. Blank texts, placeholders and texts that
    fit no vendor are left out. Only distinct texts are matched.
    """
    names = vendor_ref.select(F.col("vendor").alias("vendor_name"), F.explode(F.concat(F.array("vendor", "full_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text"))
    keys = names.select("vendor_name", F.explode(F.array(name_key(F.col("text")), _bare(F.col("text")))).alias("key")).filter("key is not null and vendor_name is not null").distinct()
    keys = keys.groupBy("key").agg(F.min("vendor_name").alias("vendor_name"), F.max("vendor_name").alias("other")).filter("vendor_name = other").drop("other")
    texts = df.select(F.col(column).alias("text")).distinct().filter(known(F.col("text")).isNotNull())
    tried = texts.select("text", F.explode(F.array_distinct(F.array(name_key(F.col("text")), _bare(F.col("text"))))).alias("key")).filter("key is not null")
    exact = tried.join(keys, "key").groupBy("text").agg(F.min("vendor_name").alias("vendor_name"), F.max("vendor_name").alias("other")).filter("vendor_name = other").drop("other")
    left = tried.join(exact, "text", "left_anti")
    close = near_words(left, keys, [], "key").select("key", F.col("match").alias("ref"))
    close = left.join(close, "key").join(keys.select(F.col("key").alias("ref"), "vendor_name"), "ref")
    close = close.groupBy("text").agg(F.min("vendor_name").alias("vendor_name"), F.max("vendor_name").alias("other")).filter("vendor_name = other").drop("other")
    return exact.unionByName(close).withColumnRenamed("text", column)
