"""Small dense estimations per group, on pandas frames: fits, segmentation and tree repair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.sources.tables import ship


def rigid_fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that move points a onto b with least squares, never mirroring."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ flip @ u.T
    return r, cb - r @ ca


def screw(r: np.ndarray, t: np.ndarray, still: float = 1e-3) -> dict:
    """Kind, axis, a point of the axis and the amount of a rigid motion."""
    angle = float(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1)))
    if angle < still:
        n = float(np.linalg.norm(t))
        return {"kind": "fixed" if n < still else "prismatic", "axis": (t / n if n >= still else np.array([0.0, 0.0, 1.0])), "origin": np.zeros(3), "amount": n if n >= still else 0.0}
    if angle > np.pi - 1e-4:  # the axis is the eigenvector of 1
        w, v = np.linalg.eigh((r + r.T) / 2)
        axis = v[:, np.argmax(w)]
    else:
        axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / (2 * np.sin(angle))
    axis = axis / np.linalg.norm(axis)
    flat = t - axis * (axis @ t)
    origin = np.linalg.lstsq(np.eye(3) - r, flat, rcond=None)[0]
    return {"kind": "revolute", "axis": axis, "origin": origin - axis * (axis @ origin), "amount": angle}


def circle_fit(p: np.ndarray) -> dict:
    """Circle through points in space: plane by least spread, then a linear fit in the plane.
    Fewer than three points have radius 0 and an infinite residual."""
    if len(p) < 3:
        return {"centre": p.mean(0) if len(p) else np.zeros(3), "normal": np.array([0.0, 0.0, 1.0]), "radius": 0.0, "residual": float("inf"), "score": 0.0}
    c = p.mean(0)
    _, _, vt = np.linalg.svd(p - c, full_matrices=True)
    flat = (p - c) @ vt[:2].T
    sol = np.linalg.lstsq(np.column_stack([2 * flat, np.ones(len(p))]), (flat**2).sum(1), rcond=None)[0]
    radius = float(np.sqrt(max(sol[2] + sol[0] ** 2 + sol[1] ** 2, 0)))
    off = np.abs(np.linalg.norm(flat - sol[:2], axis=1) - radius)
    residual = float(np.sqrt((off**2 + ((p - c) @ vt[2]) ** 2).mean()))
    return {"centre": c + sol[:2] @ vt[:2], "normal": vt[2], "radius": radius, "residual": residual, "score": float(np.clip(np.exp(-4 * off.mean() / max(radius, 1e-9)), 0, 1))}


def segment_bodies(poses: np.ndarray, tolerance: float, least: int, seed: int = 0, tries: int = 200, spread: float = 0.02, refits: int = 5) -> np.ndarray:
    """A body number per vertex of a pose series (poses, vertices, 3), -1 where none fits.

    Body after body is taken off: triples of unassigned vertices that are at least `spread` apart
    in the first pose propose a motion, which is refitted on the vertices that follow it, up to
    `refits` times, until they no longer change; of all refitted sets the largest is the body."""
    rng = np.random.default_rng(seed)
    n = poses.shape[1]
    body = np.full(n, -1)

    def follow(of: np.ndarray) -> np.ndarray:
        a, b = poses[0][of], poses[1:, of]  # `rigid_fit` of all poses at once
        ca, cb = a.mean(0), b.mean(1, keepdims=True)
        u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
        vt[:, 2] *= np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)[:, None]
        return (np.linalg.norm((poses[0] - ca) @ (u @ vt) + cb - poses[1:], axis=2) < tolerance).all(0)

    number = 0
    while (free := np.flatnonzero(body < 0)).size >= max(least, 3):
        best = np.zeros(n, bool)
        for _ in range(tries):
            pick = spread_triple(poses[0][free], spread, rng)
            if pick is None:
                break
            hit = follow(free[pick]) & (body < 0)
            if hit.sum() < 3:
                continue
            for _ in range(refits):
                again = follow(np.flatnonzero(hit)) & (body < 0)
                if again.sum() < 3 or (again == hit).all():
                    break
                hit = again
            if hit.sum() > best.sum():
                best = hit
        if best.sum() < least:
            break
        body[best] = number
        number += 1
    return body


def icp(a: np.ndarray, b: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, shift and residual that bring cloud a onto cloud b: nearest partners, without
    those farther than ten medians, fitted again until the residual stays."""
    r, t, last = np.eye(3), np.zeros(3), np.inf
    for _ in range(rounds):
        moved = a @ r.T + t
        d2 = ((moved[:, None, :] - b[None]) ** 2).sum(2)
        near = d2.argmin(1)
        d = np.sqrt(d2[np.arange(len(a)), near])
        ok = d <= 10 * max(np.median(d), 1e-12)
        r, t = rigid_fit(a[ok], b[near[ok]])
        rms = float(np.sqrt((d[ok] ** 2).mean()))
        if abs(last - rms) < 1e-6:
            break
        last = rms
    return r, t, rms


def axis_rotations() -> list[np.ndarray]:
    """The 24 rotations that map axes to axes."""
    from itertools import permutations, product

    out = []
    for order in permutations(range(3)):
        for signs in product((1, -1), repeat=3):
            m = np.zeros((3, 3))
            m[range(3), order] = signs
            if np.linalg.det(m) > 0:
                out.append(m)
    return out


def clean_fragments(labels: list[int], edges: list[tuple[int, int]]) -> list[int]:
    """Face labels where each label's largest connected part keeps it and every other part takes
    the commonest label of the faces it touches, one after another, later parts seeing earlier
    moves. Equal sizes go to the part of the smallest face, equal counts to the smallest label."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = list(labels)
    for label in sorted({x for x in labels if x >= 0}):
        own = {f for f, x in enumerate(out) if x == label}  # as earlier labels left it
        parts = []
        while own:
            todo = [min(own)]
            own.discard(todo[0])
            part = set(todo)
            while todo:
                more = [y for y in near.get(todo.pop(), ()) if y in own]
                own.difference_update(more)
                part.update(more)
                todo += more
            parts.append(part)
        for part in sorted(parts, key=lambda p: (-len(p), min(p)))[1:]:
            count: dict[int, int] = {}
            for x in part:
                for y in near.get(x, ()):
                    if y not in part and out[y] != label:
                        count[out[y]] = count.get(out[y], 0) + 1
            if count:
                to = min(count, key=lambda k: (-count[k], k))
                for x in part:
                    out[x] = to
    return out


def infer_tree(weights: dict[tuple[int, int], int], faces: dict[int, int], root: int | None = None) -> dict[int, int]:
    """Parent of each label (-1 for the root): breadth first from the root, each new label hangs
    on the visited one with which it shares most edges; labels out of reach hang on the root."""
    near: dict[int, dict[int, int]] = {}
    for (a, b), w in weights.items():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    if not faces:
        return {}
    root = root if root is not None else min(faces, key=lambda k: (-faces[k], k))
    parent, queue = {root: -1}, [root]
    while queue:
        at = queue.pop(0)
        for new in sorted(near.get(at, ())):
            if new not in parent:
                parent[new] = max((v for v in near[new] if v in parent), key=lambda v: (near[new][v], v == at, -v))
                queue.append(new)
    return parent | {k: root for k in faces if k not in parent}


def punch_holes(p: np.ndarray, radius: float, most: int, limit: float, seed: int) -> np.ndarray:
    """Which points stay when up to `most` spheres are cut out, until `limit` of them are gone."""
    rng = np.random.default_rng(seed)
    keep = np.ones(len(p), bool)
    for _ in range(most):
        if not len(p):
            break
        hole = np.linalg.norm(p - p[rng.integers(len(p))], axis=1) < radius
        if (~(keep & ~hole)).sum() > limit * len(p):
            break
        keep &= ~hole
    return keep


def cleaned_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """mesh, face, label, cleaned: `clean_fragments` of each mesh, one after another as it is
    defined. labels: mesh, face, label; edges: mesh, f1, f2 of faces that touch. A mesh is solved
    in the memory of one task; null labels are left out."""
    ship(labels.sparkSession)
    s = labels.schema

    def run(d: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("face")
        at = {int(f): i for i, f in enumerate(d["face"])}
        pairs = [(at[int(a)], at[int(b)]) for a, b in zip(e["f1"], e["f2"]) if int(a) in at and int(b) in at]
        d["cleaned"] = clean_fragments([int(x) for x in d["label"]], pairs)
        return d[["mesh", "face", "label", "cleaned"]]

    left = labels.select("mesh", "face", "label").filter("label is not null").groupBy("mesh")
    return left.cogroup(edges.select(F.col("mesh").alias("m"), "f1", "f2").groupBy("m")).applyInPandas(run, f"mesh {s['mesh'].dataType.simpleString()}, face {s['face'].dataType.simpleString()}, label {s['label'].dataType.simpleString()}, cleaned int")


def nearest_motions(orphans: DataFrame, assigned: DataFrame, key: str, body: str, pose: str, tolerance: float) -> DataFrame:
    """key, body, worst: for each orphan the body whose mean displacement (x, y, z) it follows best,
    by the worst distance over all poses; -1 if that is not below the tolerance. Bodies are few:
    each orphan meets one row of each body and pose."""
    m = assigned.groupBy(F.col(body).alias("__b"), pose).agg(*[F.avg(c).alias(f"__{c}") for c in "xyz"])
    far = F.sqrt(sum(((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in "yz"), (F.col("x") - F.col("__x")) * (F.col("x") - F.col("__x"))))
    w = orphans.join(m, pose).groupBy(key, "__b").agg(F.round(F.max(far), 9).alias("worst"))
    best = w.groupBy(key).agg(F.min(F.struct("worst", "__b")).alias("t"))
    return best.select(key, F.when(F.col("t.worst") < tolerance, F.col("t.__b")).otherwise(-1).alias("body"), F.round("t.worst", 6).alias("worst"))


def mean_rotation(rotations: np.ndarray) -> np.ndarray:
    """The rotation nearest to many in the mean: that of the largest eigenvector of the sum of
    their quaternions' outer products, which does not mind a quaternion's sign."""
    total = np.zeros((4, 4))
    for m in rotations:
        k = np.array([
            [m[0, 0] - m[1, 1] - m[2, 2], 0, 0, 0], [m[1, 0] + m[0, 1], m[1, 1] - m[0, 0] - m[2, 2], 0, 0],
            [m[2, 0] + m[0, 2], m[2, 1] + m[1, 2], m[2, 2] - m[0, 0] - m[1, 1], 0], [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1], m[0, 0] + m[1, 1] + m[2, 2]],
        ]) / 3
        q = np.linalg.eigh(k)[1][:, -1]
        total += np.outer(q, q)
    x, y, z, w = np.linalg.eigh(total)[1][:, -1]
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def spread_triple(p: np.ndarray, least: float, rng: np.random.Generator, tries: int = 50) -> np.ndarray | None:
    """Three points of which no two are nearer than `least` and that are not on one line, else none."""
    for _ in range(tries if len(p) >= 3 else 0):
        i = rng.choice(len(p), 3, replace=False)
        e = p[i]
        if min(np.linalg.norm(e[0] - e[1]), np.linalg.norm(e[0] - e[2]), np.linalg.norm(e[1] - e[2])) >= least and np.linalg.norm(np.cross(e[1] - e[0], e[2] - e[0])) >= 1e-6:
            return i
    return None


def scene_bodies(df: DataFrame, scene: str, vertex: str, poses: str, tolerance: float, least: int) -> DataFrame:
    """scene, vertex, body: `segment_bodies` of each scene, whose vertices have an array of x, y, z
    per pose. Vertices whose arrays are null or shorter than the scene's longest have body -1."""
    ship(df.sparkSession)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(vertex)
        size = [0 if x is None else len(x) // 3 for x in d[poses]]
        whole = np.array([k == max(size) and k > 1 for k in size], bool)
        body = np.full(len(d), -1)
        if whole.sum() >= 3:
            body[whole] = segment_bodies(np.stack([np.asarray(x, float)[: max(size) * 3].reshape(-1, 3) for x in d[poses][whole]], 1), tolerance, least)
        return pd.DataFrame({scene: d[scene], vertex: d[vertex], "body": body.astype("int32")})

    s = df.schema
    return df.select(scene, vertex, poses).groupBy(scene).applyInPandas(run, f"{scene} {s[scene].dataType.simpleString()}, {vertex} {s[vertex].dataType.simpleString()}, body int")


def scene_trees(weights: DataFrame, scene: str) -> DataFrame:
    """scene, label, parent: `infer_tree` of each scene's label pairs (la, lb, weight); the root, of
    parent -1, is the label on most edges."""
    ship(weights.sparkSession)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        w = {(int(a), int(b)): int(n) for a, b, n in zip(d["la"], d["lb"], d["weight"])}
        faces: dict[int, int] = {}
        for (a, b), n in w.items():
            faces[a], faces[b] = faces.get(a, 0) + n, faces.get(b, 0) + n
        tree = sorted(infer_tree(w, faces).items())
        return pd.DataFrame({scene: [d[scene].iloc[0]] * len(tree), "label": [k for k, _ in tree], "parent": [v for _, v in tree]})

    return weights.select(scene, "la", "lb", "weight").groupBy(scene).applyInPandas(run, f"{scene} {weights.schema[scene].dataType.simpleString()}, label bigint, parent bigint")


def holed(df: DataFrame, cloud: str, key: str, radius: float, most: int, limit: float, seed: int) -> DataFrame:
    """The rows of df (cloud, key, x, y, z) that stay after `punch_holes` of each cloud, which is
    solved in memory; the seed is the cloud's own."""
    ship(df.sparkSession)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(key)
        return d[punch_holes(d[["x", "y", "z"]].to_numpy(float), radius, most, limit, seed + int(d[cloud].iloc[0]) * 100003)]

    d = df.select(cloud, key, "x", "y", "z").dropna()
    return d.groupBy(cloud).applyInPandas(run, d.schema)
