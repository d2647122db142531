"""Column expressions that bring spellings of names, paths and labels together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that say that nothing is known.
PLACEHOLDERS = ("unknown", "n/a", "na", "none", "null", "nil", "-", "--", "?", "tbd", "unspecified", "not known", "not available", "undefined")
# File kinds, and stems that name no model.
FILE_KINDS = "urdf|xml|sdf|mjcf"
GENERIC_STEMS = ("robot", "model", "scene")


def known(c: Column) -> Column:
    """c, or null where it is blank or only says that it is unknown."""
    t = F.lower(F.trim(c))
    return F.when((t != "") & ~t.isin(*PLACEHOLDERS), c)


def name_key(c: Column) -> Column:
    """Letters and digits only, in lower case; null where nothing is left."""
    k = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when(k != "", k)


def path_key(c: Column) -> Column:
    """A path in one spelling: lower case, forward slashes, no leading ./, no spaces round
    slashes, hyphens and inner spaces as underscores; null where nothing is left."""
    k = F.replace(F.lower(F.trim(c)), F.lit("\\"), F.lit("/"))
    k = F.regexp_replace(k, r"\s*/+[\s/]*", "/")
    k = F.regexp_replace(k, r"^(\./|/)+", "")
    k = F.regexp_replace(k, r"[-\s]+", "_")
    return F.when(k != "", k)


def group_key(c: Column) -> Column:
    """A group id in one spelling: path_key without any blanks; placeholders are null."""
    k = F.regexp_replace(F.lower(known(c)), r"\s+", "")
    k = F.regexp_replace(F.replace(k, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    k = F.replace(k, F.lit("-"), F.lit("_"))
    return F.when(k != "", k)


def stem_of(key: Column) -> Column:
    """The last segment of a path_key without its file kind."""
    return F.regexp_replace(F.element_at(F.split(key, "/"), -1), rf"\.({FILE_KINDS})$", "")


def split_key(c: Column) -> Column:
    """train, val or test from any spelling of a split; others as their name_key."""
    k = name_key(c)
    return (
        F.when(k.isin("train", "training", "trn"), "train")
        .when(k.isin("val", "valid", "validation", "dev", "eval"), "val")
        .when(k.isin("test", "testing", "tst"), "test")
        .otherwise(k)
    )


def fixed_parts(word: Column) -> Column:
    """The parts of a word that have digits or up to four letters (v2, mk3, left): they tell
    models of one family apart, so no slip is looked for in them."""
    return F.array_join(F.filter(F.split(word, "_"), lambda p: (F.length(p) <= 4) | p.rlike("[0-9]")), "_")


def near(a: Column, b: Column) -> Column:
    """True where two words are the same but for one letter added, lost, changed or moved, and
    their fixed parts agree."""
    letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    d = F.levenshtein(a, b)
    return (fixed_parts(a) == fixed_parts(b)) & ((d <= 1) | ((d == 2) & (letters(a) == letters(b))))
