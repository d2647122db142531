"""Finding words that are the same but for a slip of the pen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.names import fixed_parts, near


def left_out(word: Column) -> Column:
    """What a word becomes when one letter, or none, is left out: words one slip apart share one."""
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_union(without, F.array(word))


def near_words(asked: DataFrame, known: DataFrame, scope: list[str], word: str) -> DataFrame:
    """(*scope, word, match) for each word of asked and each word of known, in one scope, that
    are `near`; equal words match too. Both sides are reduced to distinct words first.

    Words meet by hashes of their scope, the parts that must agree, and what is left without one
    letter. All words of one key differ in one letter only, so a key holds at most a word's
    length times the alphabet of them, and the work follows the number of real candidates
    however many words a scope has or how they begin. Rows with a null scope or word are left out.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        d = df.select(*scope, F.col(word).alias(name)).dropna().distinct()
        d = d.withColumn("h", F.explode(F.transform(left_out(F.col(name)), lambda x: F.xxhash64(*scope, fixed_parts(F.col(name)), x))))
        return d.select(*[F.col(s).alias(f"{s}_{name}") for s in scope], name, "h")

    a, b = side(asked, "a"), side(known, "b")
    same = near(F.col("a"), F.col("b"))
    for s in scope:
        same = same & (F.col(f"{s}_a") == F.col(f"{s}_b"))
    return a.join(b, "h").filter(same).select(*[F.col(f"{s}_a").alias(s) for s in scope], F.col("a").alias(word), F.col("b").alias("match")).distinct()
