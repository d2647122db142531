import datetime as dt
import random
import time
from collections import defaultdict

import numpy as np

from skarn.operators.hierarchy import Forest, cycle_links, descendants, hierarchy, link_forest
from skarn.sources.tables import newest

NESTED = "example_id bigint, topo array<array<int>>, ok array<boolean>, link int, path string"


def on_cycle(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    found = set()
    for s in list(near):
        seen, todo = set(), list(near[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, ())
        if s in seen:
            found.add(s)
    return found


def test_cycles_match_brute_force(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for i in range(400):
        n = rng.randint(1, 12)
        edges = [[rng.randint(-1, n), rng.randint(-1, n)] for _ in range(rng.randint(0, 14))]
        flags = [rng.random() < 0.8 for _ in edges]
        rows.append((i, edges, flags, 1, "x"))
        good = [tuple(e) for e, f in zip(edges, flags) if f and min(e) >= 0]
        want |= {(i, v) for v in on_cycle(good)}
    df = spark.createDataFrame(rows + rows[:5], NESTED)
    got = {tuple(r) for r in cycle_links(df, "example_id", "topo", "ok", "nested").collect()}
    assert got == want and len(want) > 50


def test_odd_arrays_are_no_joints(spark):
    rows = [
        (1, None, None, 0, None), (2, [], [], 0, None), (3, [[1, 1]], None, 0, None), (4, [[1, 1]], [True], 0, None),
        (5, [[1], None, [2, 2, 2], [3, None]], [True] * 4, 0, None), (6, [[0, 1], [1, 0]], [True], 0, None), (None, [[1, 1]], [True], 0, None),
    ]
    got = [tuple(r) for r in cycle_links(spark.createDataFrame(rows, NESTED), "example_id", "topo", "ok", "nested").collect()]
    assert got == [(4, 1)]
    empty = spark.createDataFrame([], NESTED)
    assert cycle_links(empty, "example_id", "topo", "ok", "nested").count() == 0
    assert link_forest(empty, "example_id", "topo", "ok", "nested").count() == 0


def test_forest_of_arrays(spark):
    df = spark.createDataFrame([(1, [0, 1, 0, 5, -1], [1, 2, 3, 5]), (2, [4, 3, 1], [3, 4, 0])], "example_id bigint, p array<int>, c array<int>")
    got = {(r.example_id, r.link): r for r in link_forest(df, "example_id", "p", "c", "flat").collect()}
    assert got[1, 2].path == [0, 1, 2] and got[1, 2].depth == 2 and got[1, 2].root == 0
    assert got[1, 0].descendants == [1, 2, 3] and got[1, 0].parent is None
    assert got[1, 5].in_cycle
    assert got[2, 3].in_cycle and got[2, 4].in_cycle and got[2, 3].path is None
    assert not got[2, 0].in_cycle and got[2, 0].path == [1, 0]


def test_table_form(spark):
    rows = [(i + 1, i) for i in range(20)] + [(100, 101), (101, 102), (102, 100), (103, 100), (7, 6), (None, 3), (200, None), (201, 201)]
    h = hierarchy(spark.createDataFrame(rows, "node int, parent int"), "node", "parent")
    got = {r.node: r for r in h.collect()}
    assert got[20].path == list(range(21)) and got[20].root == 0 and got[20].depth == 20
    assert {got[i].status for i in (100, 101, 102)} == {"cycle"} and got[103].status == "below_cycle"
    assert got[200].depth == 0 and got[201].status == "tree" and got[0].parent is None
    assert descendants(h).filter("ancestor = 15").count() == 5
    assert hierarchy(spark.createDataFrame([], "node int, parent int"), "node", "parent").count() == 0


def test_forest_matches_table_form(spark):
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(60):
        n = rng.randint(2, 30)
        order = rng.sample(range(n), n)
        p = [order[rng.randint(0, k - 1)] for k in range(1, n)]
        rows.append((i, p, order[1:]))
        pairs += [(i * 1000 + c, i * 1000 + q) for q, c in zip(p, order[1:])]
    a = {(r.example_id * 1000 + r.link): (r.depth, [i % 1000 for i in r.path]) for r in link_forest(spark.createDataFrame(rows, "example_id bigint, p array<int>, c array<int>"), "example_id", "p", "c", "flat").collect()}
    b = {r.node: (r.depth, [i % 1000 for i in r.path]) for r in hierarchy(spark.createDataFrame(pairs, "node int, parent int"), "node", "parent").collect()}
    assert a == b


def test_links_of_several_parents(spark):
    rng = random.Random(11)
    rows = [(0, [0, 0, 0, 1, 2], [1, 2, 4, 3, 4]), (1, [0, 5, 5], [5, 5, 6]), (2, [0, 1, 3, 2, 3], [2, 2, 3, 4, 1])]
    for i in range(3, 300):
        n, k = rng.randint(1, 9), rng.randint(0, 12)
        rows.append((i, [rng.randint(0, n) for _ in range(k)], [rng.randint(0, n) for _ in range(k)]))
    df = spark.createDataFrame(rows, "example_id bigint, p array<int>, c array<int>")
    got = {(r.example_id, r.link): r for r in link_forest(df, "example_id", "p", "c", "flat").collect()}
    assert got[0, 2].descendants == [4] and got[0, 4].path == [0, 4] and got[1, 0].descendants == [5, 6]
    seen = 0
    for i, p, c in rows:
        down, up = defaultdict(set), defaultdict(set)
        for a, b in zip(p, c):
            down[a].add(b)
            up[b].add(a)
        reach = {}
        for s in set(p) | set(c):
            reach[s], todo = set(), [s]
            while todo:
                for x in down[todo.pop()] - reach[s]:
                    reach[s].add(x)
                    todo.append(x)
        cyclic = {s for s in reach if s in reach[s]}
        for s in reach:
            r = got.pop((i, s))
            bad = s in cyclic or any(s in reach[x] for x in cyclic)
            way = [s]
            while not bad and up[way[0]]:
                way.insert(0, min(up[way[0]]))
            assert r.in_cycle == (s in cyclic) and r.parent == min(up[s] - {s}, default=None)
            assert (r.root, r.depth, r.path, r.descendants) == ((None,) * 4 if bad else (way[0], len(way) - 1, way, sorted(reach[s])))
            seen += len(up[s]) > 1 and not bad
    assert not got and seen > 50


def test_big_ring_with_forks_is_fast():
    rng = random.Random(5)
    n = 100_000
    ring = np.arange(n)
    extra = np.array([rng.randrange(n) for _ in range(2000)])
    parent = np.concatenate([ring, extra[:1000], [n, 0]])
    child = np.concatenate([(ring + 1) % n, extra[1000:], [0, n + 1]])
    start = time.time()
    f = Forest(np.zeros(len(parent), np.int64), parent, child)
    link, above = f.ancestors()
    assert f.in_cycle[:n].all() and not f.in_cycle[n:].any() and f.bad[n + 1] and not f.bad[n]
    assert (above == n).all() and sorted(link) == [*range(n), n + 1]
    assert time.time() - start < 10


def test_later_delivery_counts(spark):
    day = lambda d: dt.datetime(2025, 1, d)
    rows = [(1, [0, 1], [1, 0], day(1)), (1, [0, 1], [1, 2], day(2)), (2, [0], [1], None), (2, [0], [0], day(1)), (3, [0], [0], day(1)), (3, [5], [6], day(1))]
    df = spark.createDataFrame(rows, "example_id bigint, p array<int>, c array<int>, t timestamp_ntz")
    got = {tuple(r) for r in cycle_links(df, "example_id", "p", "c", "flat", "t").collect()}
    assert got - {(3, 0)} == {(2, 0)}
    forest = link_forest(newest(df, "example_id", "t").select("example_id", "p", "c"), "example_id", "p", "c", "flat")
    assert {(r.example_id, r.link) for r in forest.filter("in_cycle").collect()} == got
