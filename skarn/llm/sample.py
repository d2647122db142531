"""Samples whose categories have given shares, by systematic unequal-probability sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.prefix import grouped_prefix
from skarn.sources.tables import materialize

#: The category of records that no target names.
REST = "*"


def categorised(records: DataFrame, targets: DataFrame, dimensions: list[str]) -> DataFrame:
    """records (id and one text per dimension) with texts that no target names set to REST."""
    wanted = {}
    for r in targets.select("dimension", "category").distinct().collect():
        wanted.setdefault(r.dimension, set()).add(r.category)
    return records.select("id", *[F.when(F.col(d).isin(*sorted(wanted.get(d, {REST}))), F.col(d)).otherwise(REST).alias(d) for d in dimensions])


def _fill(want: np.ndarray, room: np.ndarray, total: float) -> np.ndarray:
    """want scaled to the given total where no value may exceed its room."""
    out = np.minimum(want, room)
    for _ in range(60):
        short = total - out.sum()
        if abs(short) < 1e-9:
            break
        if short < 0:
            out = out * (total / out.sum())
            continue
        free = room - out
        base = np.where(free > 1e-12, np.maximum(out, 1e-9), 0)
        if not base.sum():
            break
        out = np.minimum(out + base * (short / base.sum()), room)
    return out


def inclusion(cells: list[tuple], sizes: list[int], targets: list[tuple], dimensions: list[str], take: int) -> np.ndarray:
    """Inclusion probability of each cell, by raking to the targets of every dimension in turn.

    cells: the categories of each cell; targets: (dimension, category, permille). What a category
    cannot give is taken from REST, then from the others of its dimension. The last step makes
    the expected size `take` exactly (or all records, if there are fewer)."""
    n = np.array(sizes, float)
    take = min(take, n.sum())
    p = np.full(len(n), take / n.sum())
    plans = []
    for i, d in enumerate(dimensions):
        cats = sorted({c[i] for c in cells})
        asked = {c: q for dim, c, q in targets if dim == d and q is not None}
        if not asked:
            continue
        at = [np.array([k for k, c in enumerate(cells) if c[i] == cat]) for cat in cats]
        have = np.array([n[a].sum() for a in at])
        want = np.array([asked.get(c, 0) if c != REST else max(0, 1000 - sum(asked.values())) for c in cats], float) * take / 1000
        want = np.minimum(want, have)
        if REST in cats:  # what the named ones cannot give comes from the unnamed first
            k = cats.index(REST)
            want[k] = min(have[k], want[k] + take - want.sum())
        plans.append((at, _fill(want, have, take)))
    for _ in range(200):
        old = p.copy()
        for at, want in plans:
            for a, w in zip(at, want):
                p[a] = _fill(p[a] * n[a], n[a], w) / n[a]
        if np.abs(p - old).max() < 1e-10:
            break
    return np.clip(_fill(p * n, n, take) / n, 0, 1)


def repair(cells: list[tuple], sizes: list[int], chosen: list[int], floors: list[tuple], dimensions: list[str], take: int) -> tuple[list[int], list[int]]:
    """(added, removed) per cell, so that each category has min_rows or all its records.

    floors: (dimension, category, min_rows). Rows are added in the category's cells, those with
    most records left first, and as many taken away from the cells that have most chosen ones,
    but from no category that would then be below its floor; only if there is nothing to take
    away does the sample exceed `take`."""
    sizes_, now = list(sizes), list(chosen)
    least: dict[tuple[int, str], int] = {}
    for d, c, m in floors:
        if m is not None and d in dimensions:
            i = dimensions.index(d)
            least[i, c] = min(max(m, least.get((i, c), 0)), sum(n for x, n in zip(cells, sizes_) if x[i] == c))
    have = lambda i, c: sum(k for x, k in zip(cells, now) if x[i] == c)
    added, removed = [0] * len(cells), [0] * len(cells)
    for (i, c), m in sorted(least.items()):
        while (lack := m - have(i, c)) > 0:
            at = max((k for k, x in enumerate(cells) if x[i] == c), key=lambda k: (sizes_[k] - now[k], -k))
            more = min(lack, sizes_[at] - now[at])
            added[at] += more
            now[at] += more
    while sum(now) > min(take, sum(sizes_)):
        spare = [min([now[k] - added[k], *(have(i, c) - m for (i, c), m in least.items() if x[i] == c)]) for k, x in enumerate(cells)]
        at = max(range(len(cells)), key=lambda k: (spare[k], -k))
        if spare[at] <= 0:
            break
        less = min(sum(now) - take, max(1, spare[at] // 2))
        removed[at] += less
        now[at] -= less
    return added, removed


def sample_to_targets(records: DataFrame, targets: DataFrame, dimensions: list[str], take: int, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sample, report): a sample of `take` of the records, and how far it meets the targets.

    records: id (unique) and one text per dimension; targets: target_id, dimension, category,
    target_permille, min_rows. sample: id, the dimensions, probability, added. Within each cell
    (combination of categories; there are at most as many as targets allow, however many records)
    records are ordered at random, by a hash of seed and id. The cells stand in sorted order; the
    running sum of inclusion probabilities over all of them is a record's rank in its cell times
    the cell's probability, plus the cell's start; ranks are summed up across partitions. One
    random start then selects each record in whose interval an integer falls. Last, a category
    with fewer selected records than min_rows gets the next ones of its cells' orders (added =
    true), as far as it has any, and as many of the last ones of other cells go (`repair`).

    report: the targets with available, asked (target_permille of take), planned (expected rows
    by the inclusion probabilities), sampled, and why a target is not met: unmet_share (the
    category has fewer records than asked), unmet_floor (the repaired sample has fewer than
    min_rows, so all the category's records are in it), unmet_jointly (it has records enough, but
    the targets of other dimensions leave it at least one short of what is asked). Null permille
    or min_rows ask for nothing. No records give no sample; null dimensions count as REST.
    """
    r = materialize(categorised(records, targets, dimensions), "categories")
    cells = sorted((tuple(x[d] for d in dimensions), x.n) for x in r.groupBy(*dimensions).agg(F.count("*").alias("n")).collect())
    spark = records.sparkSession
    names, sizes = [c for c, _ in cells], [k for _, k in cells]
    goals = targets.select("target_id", "dimension", "category", "target_permille", "min_rows").collect()  # bounded by the targets
    p = inclusion(names, sizes, [(x.dimension, x.category, x.target_permille) for x in goals], dimensions, take) if cells else np.zeros(0)
    starts = np.concatenate([[0.0], np.cumsum(p * np.array(sizes))])
    text = ", ".join(f"{d} string" for d in dimensions)
    table = spark.createDataFrame([(*c, float(q), float(s)) for c, q, s in zip(names, p, starts)], f"{text}, probability double, start double")
    ranked = grouped_prefix(r.withColumn("__h", F.xxhash64(F.lit(seed), "id")), dimensions, ["__h", "id"])
    u = float(np.random.default_rng(seed).random())
    ends = lambda k: F.floor(F.col("start") + F.col("probability") * k - u)
    marked = ranked.join(table, dimensions).withColumns({"place": ends(F.col("rank")) - ends(F.lit(0)), "chosen": ends(F.col("rank")) > ends(F.col("rank") - 1)})
    marked = materialize(marked.select("id", *dimensions, "probability", "rank", "place", "chosen"), "marked")
    got = {tuple(x[d] for d in dimensions): x.k for x in marked.groupBy(*dimensions).agg(F.count_if("chosen").alias("k")).collect()}
    chosen = [got[c] for c in names]
    added, removed = repair(names, sizes, chosen, [(x.dimension, x.category, x.min_rows) for x in goals], dimensions, take)
    edits = spark.createDataFrame([(*c, k - gone, more) for c, k, more, gone in zip(names, chosen, added, removed)], f"{text}, stay long, more long")
    out = marked.join(edits, dimensions).withColumn("added", ~F.col("chosen"))
    out = out.filter(F.when(F.col("chosen"), F.col("place") <= F.col("stay")).otherwise(F.col("rank") - F.col("place") <= F.col("more")))
    rows = []
    for x in goals:
        at = [k for k, c in enumerate(names) if x.dimension in dimensions and c[dimensions.index(x.dimension)] == x.category]
        available = sum(sizes[k] for k in at)
        asked = (x.target_permille or 0) * take / 1000
        planned, sampled = float(sum(p[k] * sizes[k] for k in at)), sum(chosen[k] + added[k] - removed[k] for k in at)
        few = (x.target_permille or 0) * take > available * 1000
        rows.append((x.target_id, x.dimension, x.category, x.target_permille, x.min_rows, available, asked, round(planned, 3), sampled, few, x.min_rows is not None and sampled < x.min_rows, not few and planned <= asked - 1))
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema.fields}
    report = spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in ("target_id", "dimension", "category", "target_permille", "min_rows")) + ", available long, asked double, planned double, sampled long, unmet_share boolean, unmet_floor boolean, unmet_jointly boolean")
    return out.select("id", *dimensions, "probability", "added"), report
