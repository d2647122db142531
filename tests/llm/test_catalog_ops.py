import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from skarn.llm import capping, sample, survivor, vendors

REF = [("big_robots", "Big Robots", ["BR", "Big Robots GmbH"]), ("small_robots", "Small Robots", None), ("bigger_robots", "Bigger Robots", ["Shared"]), ("x_works", "X Works", ["Shared"])]


def test_vendor_spellings(spark):
    ref = spark.createDataFrame(REF, "vendor string, full_name string, aliases array<string>")
    texts = ["big_robots", " BIG ROBOTS ", "BigRobots", "br", "Big Robots, Inc.", "big_robotts", "bi_grobots", "unknown", "", None, "N/A", "shared", "nobody at all", "small-robots"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, vendor string")
    got = {r.vendor: r.vendor_name for r in vendors.vendor_names(df, ref).collect()}
    assert got == {t: "big_robots" for t in texts[:7]} | {"small-robots": "small_robots"}


def greedy(records, edges, cap):
    use, out = Counter(), set()
    by = {}
    for r, c in edges:
        if c is not None:
            by.setdefault(r, set()).add(c)
    for r, s in sorted(records, key=lambda x: (-(x[1] if x[1] is not None else -1e9), x[0])):
        if all(use[c] < cap for c in by.get(r, ())):
            out.add(r)
            use.update(by.get(r, ()))
    return out


def test_matching_is_the_greedy_one(spark):
    rng = random.Random(4)
    for n, permille in ((400, 100), (300, 30), (50, 0)):
        records = [(i, rng.choice([None, *range(6)])) for i in range(n)]
        edges = [(i, c) for i in range(n) for c in {rng.choice(["v1", "v1", "v2", f"v{rng.randint(3, 30)}"]), rng.choice(["s1", "s1", "s2", f"s{rng.randint(3, 9)}", None])}]
        r = spark.createDataFrame(records, "record bigint, score int").withColumn("contributor", F.lit("clash"))
        e = spark.createDataFrame(edges + edges[:20] + [(9999, "v1")], "record bigint, contributor string")
        kept, cons = capping.cap_contributors(r, e, ["-score"], permille)
        assert {x.record for x in kept.filter("kept").collect()} == greedy(records, edges, n * permille // 1000)
        assert kept.count() == n
        demand = Counter(c for _, c in set(edges) if c)
        cap = n * permille // 1000
        assert {x.contributor: (x.demand, x.displaced) for x in cons.collect()} == {c: (k, max(0, k - cap)) for c, k in demand.items()}
        why = {x.record: x.dropped_by for x in kept.filter("not kept").collect()}
        held = Counter(c for r, c in set(edges) if r not in why)
        assert all(c is not None and held[c] == cap and (r, c) in edges for r, c in why.items())
        assert kept.filter("kept and dropped_by is not null").count() == 0


def test_matching_of_nothing(spark):
    r = spark.createDataFrame([], "record bigint, score int")
    e = spark.createDataFrame([], "record bigint, contributor string")
    kept, cons = capping.cap_contributors(r, e, ["-score"], 50)
    assert kept.count() == 0 and cons.count() == 0


CAT = "entry_id bigint, source string, meshes_resolved int, scanned_at timestamp, family string, vendor string, license string, total_mass double, mesh_bytes_total bigint, joint_range_total_rad double, aabb_extent_m array<double>, fidelity_class string, scale_class string, members string"


def test_survivors_match_brute_force(spark):
    rng = random.Random(6)
    day = lambda d: None if d is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=d)
    trust = {"a": 1, "b": 2, "c": 3}
    rows, four = [], {}
    for i in range(1, 301):
        full = [rng.choice([None, "", "x"]) for _ in range(5)]
        nums = [rng.choice([None, 1.0]), rng.choice([None, 5]), rng.choice([None, 2.0]), rng.choice([None, [1.0]])]
        src, meshes, when = rng.choice(["a", "A ", "b", "c", "zz", None]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2])
        rows.append((i, src, meshes, day(when), full[0], full[1], full[2], nums[0], nums[1], nums[2], nums[3], full[3], full[4], "clash"))
        n = sum(x == "x" for x in full) + sum(x is not None for x in nums)
        four[i] = (n, -trust.get((src or "").strip().lower(), 99), -1 if meshes is None else meshes, -1 if when is None else when)
    groups = {i: (i - 1) // 3 * 3 + 1 if i < 200 else 200 for i in range(1, 301)}
    want = set()
    for g in set(groups.values()):
        own = [i for i in groups if groups[i] == g]
        for i in own:
            if len(own) > 1 and all(all(a >= b for a, b in zip(four[i], four[j])) and four[i] != four[j] for j in own if j != i):
                want.add((g, i))
    df = spark.createDataFrame(rows, CAT)
    gdf = spark.createDataFrame(list(groups.items()), "entry_id bigint, group_id bigint")
    ref = spark.createDataFrame(list(trust.items()), "source string, trust_rank int")
    out = survivor.survivors(df.drop("members"), gdf, ref)
    assert {(r.group_entry_id, r.entry_id) for r in out.filter("dominant and members >= 2").collect()} == want and want
    assert out.count() == len(set(groups.values()))
    assert survivor.survivors(df.limit(0), gdf, ref).count() == 0


def test_fields_come_from_the_most_trusted(spark):
    d = dt.datetime(2025, 1, 1)
    rows = [(1, "b", 1, d, "f1", None, "", None, None, None, [], None, None, None), (2, "a", 1, d, " ", "v2", "L2", 1.0, None, None, [2.0], None, None, None), (3, "a", 1, d, None, "v3", None, None, 7, None, None, None, None, None)]
    out = survivor.survivors(spark.createDataFrame(rows, CAT), spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "entry_id bigint, group_id bigint"), spark.createDataFrame([("a", 1), ("b", 2)], "source string, trust_rank int")).first()
    assert (out.entry_id, out.family, out.vendor, out.license, out.mesh_bytes_total, out.aabb_extent_m, out.scale_class) == (2, "f1", "v2", "L2", 7, [2.0], None)


TARGETS = [(1, "size", "s", 500, 1), (2, "size", "m", 300, 1), (3, "size", "l", 200, 30), (4, "kind", "k1", 700, 1), (5, "kind", "gone", 100, 1), (6, "kind", "rare", None, 4)]


def test_sample_follows_targets(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["s", "m", "m", "m", None]) if i > 20 else "l", rng.choice(["k1", "k2"]) if i % 100 else "rare") for i in range(1, 2001)]
    rec = spark.createDataFrame(rows, "id bigint, size string, kind string").withColumn("probability", F.lit("clash"))
    t = spark.createDataFrame(TARGETS, "target_id int, dimension string, category string, target_permille int, min_rows int")
    got, report = sample.sample_to_targets(rec, t, ["size", "kind"], 1000)
    rows = got.collect()
    assert len({r.id for r in rows}) == len(rows) == 1000
    sizes, kinds = Counter(r["size"] for r in rows), Counter(r.kind for r in rows)
    assert sizes["l"] == 20 and abs(sizes["m"] - 300) <= 5 and kinds["rare"] >= 4 and abs(kinds["k1"] - 700) <= 20
    rep = {r.target_id: (r.available, r.unmet_share, r.unmet_floor, r.unmet_jointly) for r in report.collect()}
    assert rep[3] == (20, True, True, False) and rep[5] == (0, True, True, False) and rep[6] == (20, False, False, False) and rep[2][1:] == (False, False, False)
    assert {r.target_id: r.sampled for r in report.collect()} == {1: sizes["s"], 2: sizes["m"], 3: 20, 4: kinds["k1"], 5: 0, 6: kinds["rare"]}
    assert {r.id for r in sample.sample_to_targets(rec, t, ["size", "kind"], 1000)[0].collect()} == {r.id for r in rows}
    none, report = sample.sample_to_targets(rec.limit(0), t, ["size", "kind"], 0)
    assert none.count() == 0 and report.count() == 6


def test_targets_that_fail_together(spark):
    rec = spark.createDataFrame([(i, "a" if i < 500 else "b", "x" if i < 500 else "y") for i in range(1000)], "id int, size string, kind string")
    t = spark.createDataFrame([(1, "size", "a", 900, None), (2, "kind", "x", 100, None)], "target_id int, dimension string, category string, target_permille int, min_rows int")
    report = {r.target_id: r for r in sample.sample_to_targets(rec, t, ["size", "kind"], 500)[1].collect()}
    assert report[1].unmet_jointly and not report[1].unmet_share


def test_floors_take_the_place_of_others():
    rng = random.Random(1)
    for _ in range(200):
        cells = [(a, b) for a in "pqr" for b in "xyz"]
        sizes = [rng.randint(1, 60) for _ in cells]
        chosen = [rng.randint(0, n) for n in sizes]
        floors = [(d, c, rng.choice([None, 0, 5, 40, 500])) for d, cs in (("a", "pqr"), ("b", "xyz")) for c in cs]
        added, removed = sample.repair(cells, sizes, chosen, floors, ["a", "b"], sum(chosen))
        now = [k + a - r for k, a, r in zip(chosen, added, removed)]
        assert all(0 <= k <= n for k, n in zip(now, sizes)) and all(r <= k for r, k in zip(removed, chosen))
        for d, c, m in floors:
            i = "ab".index(d)
            assert m is None or sum(k for x, k in zip(cells, now) if x[i] == c) >= min(m, sum(n for x, n in zip(cells, sizes) if x[i] == c))
