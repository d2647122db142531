"""Classification rules of catalog entries, as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that do not identify a model.
GENERIC_LEAVES = (
    "model", "robot", "scene", "main", "base", "default", "test", "example", "demo", "world", "simulation", "robot_full",
    "scene_mjx", "scene_left", "scene_right", "scene_motor", "scene_position", "scene_velocity", "scene_arm", "scene_torque", "scene_terrain", "scene_no_arm",
)
# Leading directories of example trees that are skipped.
EXAMPLE_DIRS = ("data", "examples", "pybullet", "gym", "pybullet_data")
# Licence texts, in the order they are tried; all texts of an item must occur.
LICENCE_TEXTS = (
    ("Apache-2.0", ("apache license",)), ("Apache-2.0", ("apache-2.0",)), ("MIT", ("mit license",)),
    ("BSD-3-Clause", ("bsd 3-clause",)), ("BSD-3-Clause", ("bsd-3-clause",)), ("BSD-3-Clause", ("redistribution and use in source and binary forms",)),
    ("CC-BY-4.0", ("creative commons attribution 4.0",)), ("CC-BY-4.0", ("cc-by-4.0",)), ("CC-BY-4.0", ("cc by 4.0",)),
    ("CC-BY-SA", ("creative commons attribution-sharealike",)), ("CC-BY-SA", ("cc-by-sa",)), ("CC-BY-NC", ("creative commons", "noncommercial")),
    ("GPL-3.0", ("gnu general public", "version 3")), ("GPL-2.0", ("gnu general public", "version 2")), ("MPL-2.0", ("mozilla public license",)),
)
# Codes of joint types.
JOINT_CODES = {"revolute": 0, "continuous": 1, "prismatic": 2, "fixed": 3, "floating": 4, "planar": 5}
# Directories that name no family.
STOP_DIRS = ("urdfs", "robots", "mjcf", "model", "models", "asset", "assets", "robot_assets")
PI = 3.141593


def status_class(status: Column) -> Column:
    """load_failed, parse_failed or skipped for a status that starts so, else the status."""
    return F.when(status.startswith("load_failed"), "load_failed").when(status.startswith("parse_failed"), "parse_failed").when(status.startswith("skipped"), "skipped").otherwise(status)


def trainable(status: Column, dof: Column, resolved: Column, unresolved: Column) -> Column:
    """status ok, at least one degree of freedom, and at least 80 % of the meshes resolved."""
    total = F.coalesce(resolved, F.lit(0)) + F.coalesce(unresolved, F.lit(0))
    return F.coalesce((status == "ok") & (dof >= 1) & (total > 0) & (F.try_divide(resolved, total) >= 0.8), F.lit(False))


def fidelity_of_bytes(n: Column) -> Column:
    """high from 5 MB, medium from 0.5 MB, low above nothing, else unknown."""
    return F.when(n >= 5_000_000, "high").when(n >= 500_000, "medium").when(n > 0, "low").otherwise("unknown")


def dof_bucket(dof: Column) -> Column:
    return F.when(dof >= 13, "13+").when(dof >= 7, "7-12").when(dof >= 1, "1-6").otherwise("unknown")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def model_leaf(path: Column) -> Column:
    """The name that identifies a model: the stem without one suffix, or the parent directory's
    where the stem is generic or shorter than three letters and the directory is not generic."""
    p = F.lower(path)
    stem = F.regexp_replace(_stem(p), "_(description|urdf|xml|robot|model|mjcf|scene)$", "")
    up = F.regexp_replace(F.coalesce(F.try_element_at(F.split(p, "/"), F.lit(-2)), F.lit("")), "_(description|urdf|xml|robot|model|mjcf|scene|support)$", "")
    return F.when((stem.isin(*GENERIC_LEAVES) | (F.length(stem) < 3)) & (up != "") & ~up.isin(*GENERIC_LEAVES), up).otherwise(stem)


def path_tail(path: Column) -> Column:
    """The path without its source and the directories under which sources keep their models."""
    skip = "|".join(EXAMPLE_DIRS)
    p = F.regexp_replace(F.lower(path), "^[^/]*/", "")
    p = F.regexp_replace(p, "^urdf_files/random/[^/]+(/|$)|^urdf_files(/|$)", "")
    p = F.regexp_replace(p, "^urdfs/robots(/|$)", "")
    p = F.regexp_replace(p, f"^(data|examples)(/|$)(({skip})(/|$))*", "")
    return F.regexp_replace(p, "^(robosuite/models/assets/robots|models/assets/robots|models/assets)(/|$)", "")


def is_scene(path: Column) -> Column:
    """Whether a path names a scene around a model rather than the model."""
    return _stem(F.lower(path)).rlike("^scene$|^scene_|_scene$")


def licence_of(text: Column) -> Column:
    """The licence whose words occur first in the order of LICENCE_TEXTS, in the first 1500
    characters of a text; Unknown if none."""
    head = F.lower(F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1500))
    out = F.lit("Unknown")
    for name, words in reversed(LICENCE_TEXTS):
        hit = F.lit(True)
        for w in words:
            hit = hit & F.contains(head, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def looks_like_robot_xml(text: Column) -> Column:
    """Whether the first 4096 characters hold a tag of a simulation model."""
    return F.lower(F.substring(text, 1, 4096)).rlike("<mujoco|<worldbody|<body")


def joint_span(kind: Column, lower: Column, upper: Column) -> Column:
    """What a joint adds to the range of its kind: a turn for a continuous joint or a span of
    4 pi and more, a prismatic span of at most 10, nothing for what has no limits."""
    span = F.when(~F.isnan(lower) & ~F.isnan(upper), upper - lower)
    turn = F.lit(2 * PI)
    return (
        F.when(kind == JOINT_CODES["continuous"], turn)
        .when(kind == JOINT_CODES["revolute"], F.when(span < 4 * PI, F.greatest(span, F.lit(0.0))).when(span.isNotNull(), turn).otherwise(0.0))
        .when(kind == JOINT_CODES["prismatic"], F.when(span > 0, F.least(span, F.lit(10.0))).otherwise(0.0))
        .otherwise(0.0)
    )


def sampling_limits(kind: Column, lower: Column, upper: Column) -> Column:
    """(lower, upper) for sampling: a half turn each way for continuous, missing or inverted
    limits, revolute cut to that, prismatic to 2 each way."""
    bound = F.when(kind == JOINT_CODES["prismatic"], 2.0).otherwise(PI)
    bad = (kind == JOINT_CODES["continuous"]) | lower.isNull() | upper.isNull() | F.isnan(lower) | F.isnan(upper)
    lo, hi = F.greatest(lower, -bound), F.least(upper, bound)
    bad = bad | (lo > hi)
    return F.struct(F.when(bad, F.lit(-PI)).otherwise(lo).alias("lower"), F.when(bad, F.lit(PI)).otherwise(hi).alias("upper"))


def joint_code(name: Column) -> Column:
    """The code of a joint type; unknown ones are fixed."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in JOINT_CODES.items() for x in kv])[F.lower(name)], F.lit(JOINT_CODES["fixed"]))


def clean_label(label: Column, most: int = 64) -> Column:
    """-1 for labels outside 0 .. most - 1."""
    return F.when((label >= 0) & (label < most), label).otherwise(-1)


def first_match(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """(family, vendor) of a path: the first of the (pattern, vendor) pairs whose pattern occurs in
    it; else the first directory or name that is none of STOP_DIRS, without a vendor. The list is
    one constant array, searched row by row without a join."""
    p = F.lower(path)
    table = F.from_json(F.lit(json.dumps([{"family": a, "vendor": b} for a, b in patterns])), "array<struct<family:string,vendor:string>>")
    hit = F.get(F.filter(table, lambda x: F.contains(p, x["family"])), F.lit(0))
    token = F.get(F.filter(F.split(p, r"[/\\\\]"), lambda t: (t != "") & ~t.isin(*STOP_DIRS)), F.lit(0))
    return F.struct(F.coalesce(hit["family"], token, F.lit("")).alias("family"), F.coalesce(hit["vendor"], F.lit("")).alias("vendor"))


def load_status(format_: Column) -> Column:
    """How an entry of a format is loaded: by the urdf or the mjcf reader, or skipped and why."""
    f = F.lower(F.trim(format_))
    return F.when(f == "urdf", "urdf").when(f.isin("mjcf", "xml"), "mjcf").when(f == "sdf", "skipped: sdf").otherwise(F.concat(F.lit("skipped: unknown format "), F.coalesce(f, F.lit("null"))))
