"""Parent-child links to full hierarchies, by pointer doubling.

Two forms of one method. `hierarchy` takes any table of (node, parent) rows and joins ancestor
pointers with themselves, so the distance covered doubles with each join. `link_forest` and
`cycle_links` take rows that each hold a whole small graph in arrays: all its pointers are in
one row, so the same doubling runs as array gathers inside the scan's tasks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.sources.tables import content_order, discard, materialize, ship


def hierarchy(df: DataFrame, node: str, parent: str, max_rounds: int = 64) -> DataFrame:
    """node, parent, root, depth, path (array from the root), status for each node.

    A node named only as a parent is a root; a null or own parent makes a root of depth 0
    (status 'tree'). Of several parents the smallest counts. Nodes on a cycle have the status
    'cycle', nodes that only hang below one 'below_cycle'; both have null root, depth and path.
    Rows with a null node are ignored, repeated rows count once, other columns are not read.

    Each round joins every unresolved pointer with the pointer of its target, and concatenates
    the path segments. While a tree is unresolved, each round resolves some of its nodes; so when
    a round resolves none, the rest has no root. It goes on until a pointer, which spans 2^r
    links after r rounds, is longer than any way into a cycle.
    """
    rows = df.select(F.col(node).alias("node"), F.col(parent).alias("parent")).filter("node is not null")
    first = rows.groupBy("node").agg(F.min(F.when(F.col("parent") != F.col("node"), F.col("parent"))).alias("parent"))
    tops = rows.filter("parent is not null").select(F.col("parent").alias("node")).distinct().join(first, "node", "left_anti")
    start = first.unionByName(tops.select("node", F.lit(None).cast(first.schema["parent"].dataType).alias("parent")))
    state = materialize(start.select("node", "parent", F.col("parent").alias("jump"), F.col("parent").isNotNull().cast("int").alias("depth"), F.array("node").alias("path")), "up")
    spans, before = 1, -1
    for _ in range(max_rounds):
        left = state.filter("jump is not null").count()
        if not left or (left == before and spans >= left):
            break
        before = left
        up = state.select(F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("depth").alias("more"), F.col("path").alias("above"))
        moved = state.filter("jump is not null").join(up, "jump").select("node", "parent", F.col("far").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("above", "path").alias("path"))
        after = materialize(state.filter("jump is null").unionByName(moved), "up")
        discard(state)
        state, spans = after, spans * 2
    # a jump over at least as many links as there are unresolved nodes ends on a cycle, and every cycle node is the end of one
    on_cycle = state.filter("jump is not null").select(F.col("jump").alias("node"), F.lit(True).alias("on_cycle")).distinct()
    whole = F.col("jump").isNull()
    return state.join(on_cycle, "node", "left").select(
        "node", "parent",
        F.when(whole, F.element_at("path", 1)).alias("root"),
        F.when(whole, F.col("depth")).alias("depth"),
        F.when(whole, F.col("path")).alias("path"),
        F.when(whole, "tree").when(F.col("on_cycle"), "cycle").otherwise("below_cycle").alias("status"),
    )


def descendants(forest: DataFrame) -> DataFrame:
    """(ancestor, node, distance) pairs of a `hierarchy`; a root's descendants stay rows and are
    never gathered into one value, since a root may hold the whole table."""
    pairs = forest.filter("path is not null").select("node", "depth", F.posexplode("path").alias("level", "ancestor"))
    return pairs.filter("ancestor <> node").select("ancestor", "node", (F.col("depth") - F.col("level")).alias("distance"))


def _joints_nested(topology: pa.ListArray, valid: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, parent, child) of the joints in [parent, child] pairs whose slot is valid."""
    rows, inner = _flat(topology)
    flags_row, flags = _flat(valid)
    lengths = np.bincount(flags_row, minlength=len(topology))
    at = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(topology)))])[rows]
    on = np.zeros(len(rows), bool)
    within = place < lengths[rows]
    on[within] = pc.fill_null(flags, False).to_numpy(zero_copy_only=False)[(at[rows] + place)[within]]
    size = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
    on &= size == 2
    ends = pc.fill_null(inner.flatten(), -1).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    return rows[on], ends[begin[on]], ends[begin[on] + 1]


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), size), lists.flatten()


def _joints_flat(parents: pa.ListArray, children: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, parent, child) of two parallel lists; a longer list's rest has no partner and is no joint."""
    rows, p = _flat(parents)
    crow, c = _flat(children)
    n = len(parents)
    lengths, at = np.bincount(crow, minlength=n), np.concatenate([[0], np.cumsum(np.bincount(crow, minlength=n))])
    place = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])[rows]
    on = place < lengths[rows]
    child = pc.fill_null(c, -1).to_numpy(zero_copy_only=False)
    return rows[on], pc.fill_null(p, -1).to_numpy(zero_copy_only=False)[on], child[(at[rows] + place)[on]]


class Forest:
    """The links of many small graphs, with doubled ancestor pointers."""

    def __init__(self, row: np.ndarray, parent: np.ndarray, child: np.ndarray):
        real = (parent >= 0) & (child >= 0)
        row, parent, child = row[real].astype(np.int64), parent[real].astype(np.int64), child[real].astype(np.int64)
        keys, ids = np.unique(np.concatenate([row << 32 | parent, row << 32 | child]), return_inverse=True)
        self.row, self.link, n = keys >> 32, keys & 0xFFFFFFFF, len(keys)
        joints = np.unique(ids[len(row):] * max(n, 1) + ids[: len(row)])  # by child, then parent
        self.child, self.parent = joints // max(n, 1), joints % max(n, 1)
        loop = self.child == self.parent
        self.in_cycle = np.zeros(n, bool)
        self.in_cycle[self.child[loop]] = True
        self.child, self.parent = self.child[~loop], self.parent[~loop]
        first = np.ones(len(self.child), bool)
        first[1:] = self.child[1:] != self.child[:-1]
        self.up = np.arange(n)
        self.up[self.child[first]] = self.parent[first]
        self.fork = np.zeros(n, bool)
        self.fork[self.child[~first]] = True
        # doubling: jump spans 2^k links, depth counts the links it went up
        jump, self.depth = self.up, (self.up != np.arange(n)).astype(np.int32)
        widest = int(np.bincount(self.row).max()) if n else 0
        for _ in range(widest.bit_length()):
            self.depth = self.depth + self.depth[jump]
            jump = jump[jump]
        self.root = jump
        self.lost = self.up[jump] != jump  # no root after more jumps than there are links
        self.in_cycle[jump[self.lost]] = True
        self._below()

    def _below(self) -> None:
        """in_cycle of rows where links have several parents, and bad: whether a link is on a
        cycle or can be reached from one by any of its parents.

        Where every link has one parent, badness doubles along the pointers. What doubling leaves,
        the rows with forks, is contracted to strongly connected components in one walk over its
        joints; they come out ancestors first, so the same walk tells what lies below cycles.
        """
        n = len(self.row)
        forked = np.zeros(int(self.row.max()) + 1 if n else 0, bool)
        forked[self.row[self.fork]] = True
        self.forked = forked[self.row] if n else np.zeros(0, bool)
        self.bad, jump = self.in_cycle | self.lost, self.up
        for _ in range(int(np.bincount(self.row).max()).bit_length() if n else 0):
            self.bad = self.bad | self.bad[jump]
            jump = jump[jump]
        self.part = np.arange(n)  # the component of each link, named by one of its links
        on = self.forked[self.child] if len(self.child) else np.zeros(0, bool)
        p, c = self.parent[on], self.child[on]
        begin = np.searchsorted(c, np.arange(n + 1)).tolist()
        above = p.tolist()
        seen, low, loops, bad = [0] * n, [0] * n, self.in_cycle.tolist(), self.bad.tolist()
        done, held, stack, tick = [False] * n, [], [], 0
        for start in np.flatnonzero(self.forked).tolist():
            if seen[start]:
                continue
            stack.append((start, begin[start]))
            while stack:
                v, at = stack.pop()
                if at == begin[v]:
                    tick += 1
                    seen[v] = low[v] = tick
                    held.append(v)
                elif low[above[at - 1]] < low[v] and not done[above[at - 1]]:
                    low[v] = low[above[at - 1]]
                while at < begin[v + 1]:
                    w = above[at]
                    at += 1
                    if not seen[w]:
                        stack += [(v, at), (w, begin[w])]
                        break
                    if not done[w] and seen[w] < low[v]:
                        low[v] = seen[w]
                else:
                    if low[v] == seen[v]:
                        k = len(held) - 1
                        while held[k] != v:
                            k -= 1
                        members, held[k:] = held[k:], []
                        cyclic = len(members) > 1
                        down = cyclic or any(loops[m] or any(bad[w] for w in above[begin[m] : begin[m + 1]] if done[w]) for m in members)
                        for m in members:
                            done[m], loops[m], bad[m], self.part[m] = True, loops[m] or cyclic, down, v
        self.in_cycle, self.bad = np.array(loops, bool), np.array(bad, bool)

    def ancestors(self) -> tuple[np.ndarray, np.ndarray]:
        """(link, ancestor) over all joints, without the link itself, of the ancestors that no
        cycle leads to: pointers where no link of the row has several parents. In the other rows
        each ancestor's links are passed on downwards from component to component, so the work
        follows the number of pairs there are."""
        node, at, _ = self.chains(~self.forked)
        tree = node != at
        n = max(len(self.row), 1)
        on = self.forked[self.child] if len(self.child) else np.zeros(0, bool)
        down, up = self.part[self.child[on]], self.part[self.parent[on]]
        edges = np.unique((up * n + down)[up != down])  # by ancestor
        up, down = edges // n, edges % n
        new = pairs = edges[~self.bad[up]] if len(edges) else edges
        while len(new):
            far, link = new // n, new % n
            begin, size = np.searchsorted(up, link), np.searchsorted(up, link, "right") - np.searchsorted(up, link)
            step = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            new = np.setdiff1d(np.repeat(far, size) * n + down[step], pairs)
            pairs = np.union1d(pairs, new)
        far, part = pairs // n, pairs % n
        members = np.argsort(self.part, kind="stable")
        begin, size = np.searchsorted(self.part[members], part), np.searchsorted(self.part[members], part, "right") - np.searchsorted(self.part[members], part)
        at_member = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.concatenate([node[tree], members[at_member]]), np.concatenate([at[tree], np.repeat(far, size)])

    def chains(self, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, ancestor, ancestor's depth), the node itself included, of all links below no
        cycle (and marked in `of`). The rows that come out are at least half the square of the
        passes that this takes. Without `of` the ways up by smallest parents are followed."""
        node = np.flatnonzero(~self.bad) if of is None else np.flatnonzero(of & ~self.lost)
        at, out = node, []
        while len(node):
            if of is not None:
                good = ~self.bad[at]
                out.append((node[good], at[good], self.depth[at[good]]))
            else:
                out.append((node, at, self.depth[at]))
            more = self.up[at] != at
            node, at = node[more], self.up[at[more]]
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _batches(kind: str):
    return _joints_nested if kind == "nested" else _joints_flat


def cycle_links(df: DataFrame, key: str, first: str, second: str, kind: str, time: str | None = None) -> DataFrame:
    """(key, link) of each link on a cycle, in the graphs that df's rows hold.

    kind 'nested': first is an array of [parent, child] pairs, second the array of flags that
    say which slots hold a joint. kind 'flat': first has the parents, second the children.
    Negative or null ends, pairs that are not two numbers, and slots that only one array has,
    are no joints; null arrays have none. Rows with a null key are ignored; of a key that occurs
    again the row of the latest time counts, as `newest` has it. No other column is read. The
    arrays are read once and not shuffled: what is, is a row per graph with its links on cycles.
    """
    ship(df.sparkSession)
    joints = _batches(kind)
    rows = df.filter(F.col(key).isNotNull()).select(key, first, second, (F.col(time) if time else F.lit(None).cast("timestamp_ntz")).alias("at"), content_order(first, second).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = Forest(*joints(b.column(1), b.column(2)))
            at = np.concatenate([[0], np.cumsum(np.bincount(f.row[f.in_cycle], minlength=b.num_rows))]).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(at), pa.array(f.link[f.in_cycle].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), links], ["example_id", "at", "h", "links"])

    found = rows.mapInArrow(run, f"example_id {df.schema[key].dataType.simpleString()}, at {rows.schema['at'].dataType.simpleString()}, h long, links array<int>")
    last = found.groupBy("example_id").agg(F.max_by("links", F.struct("at", -F.col("h"))).alias("links"))
    return last.select("example_id", F.explode("links").alias("link"))


def link_forest(df: DataFrame, key: str, first: str, second: str, kind: str) -> DataFrame:
    """example_id, link, parent, root, depth, path, descendants, in_cycle for each link of the
    graphs that df's rows hold (arguments and rules as for `cycle_links`; keys must be unique).

    parent is the smallest of a link's parents, null for a root. root, depth and path (links from
    the root) are those of the way up by smallest parents, also where other parents lead to other
    roots. descendants holds every link that any joints lead down to, so a link below several
    parents or roots is among the descendants of each, and links on a cycle are among those of
    the links above it. root, depth, path and descendants are null for links on a cycle, a joint
    of a link with itself included, and for links of which any parent leads to a cycle.
    """
    ship(df.sparkSession)
    joints = _batches(kind)

    def lists(owner: np.ndarray, value: np.ndarray, n: int, null: np.ndarray) -> pa.Array:
        at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.int32)), mask=pa.array(null)) if n else pa.array([], pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                f = Forest(*joints(b.column(1), b.column(2)))
                n, at = len(f.row), np.arange(len(f.row))
                null = f.bad
                node, above, level = f.chains()
                down = np.lexsort((level, node))
                under, over = f.ancestors()
                order = np.lexsort((under, over))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(f.row)),
                    pa.array(f.link.astype(np.int32)),
                    pa.array(f.link[f.up].astype(np.int32), mask=f.up == at),
                    pa.array(f.link[f.root].astype(np.int32), mask=null),
                    pa.array(f.depth.astype(np.int32), mask=null),
                    lists(node[down], f.link[above[down]], n, null),
                    lists(over[order], f.link[under[order]], n, null),
                    pa.array(f.in_cycle),
                ], ["example_id", "link", "parent", "root", "depth", "path", "descendants", "in_cycle"])

    schema = f"example_id {df.schema[key].dataType.simpleString()}, link int, parent int, root int, depth int, path array<int>, descendants array<int>, in_cycle boolean"
    return df.filter(F.col(key).isNotNull()).select(key, first, second).mapInArrow(run, schema)
