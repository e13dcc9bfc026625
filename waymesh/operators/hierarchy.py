"""Parent-child links to full hierarchies: path, depth, root, descendants, cycles.

Leaves are peeled until only cycles are left; each cycle is then opened by
making its members roots, and an Euler tour of the resulting forest is ranked
by pointer jumping.  The entry and exit ranks of a label enclose exactly its
descendants, and the signed ranks give its depth.

A task works off whole groups (trees) in Arrow batches, many at a time.  A
group of more than ``local_rows`` labels is first contracted across tasks:
rounds that peel all leaves and splice chains, each an aggregation and a join
over what is left, until the rest fits a task, where the same peeling and
ranking is done with weights; the rounds are then undone in reverse order.
Sizes shrink by a constant share a round, so all of them together cost a few
passes over the group, whatever its shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.session import cut, map_arrow, spread

#: Labels of one group that a task may hold: about 200 bytes each without their paths, so some 600 MB, and a few seconds of work.
LOCAL_ROWS = 3_000_000
_BUFFER = 150_000
#: Path elements of one batch (32 MB); a single longer path is a batch of its own.
PATH_ELEMENTS = 4_000_000
_SCHEMA = "group_id bigint, label_id bigint, parent_id bigint, root_id bigint, top_id bigint, cycle_id bigint, depth bigint, entry bigint, exit bigint, descendants bigint, path array<bigint>"


# --------------------------------------------------------------------------- in one task


def peel(parent: np.ndarray) -> np.ndarray:
    """True for the nodes that stay when leaves are peeled again and again: those on cycles.

    ``parent`` holds the index of each node's parent, or -1.
    """
    left = np.bincount(parent[parent >= 0], minlength=len(parent))
    alive = np.ones(len(parent), bool)
    leaves = np.flatnonzero(left == 0)
    while len(leaves):
        alive[leaves] = False
        up = parent[leaves]
        up = up[up >= 0]
        np.subtract.at(left, up, 1)
        up = np.unique(up)
        leaves = up[(left[up] == 0) & alive[up]]
    return alive


def rank_tour(parent: np.ndarray, order: np.ndarray) -> dict[str, np.ndarray]:
    """Euler tours of a forest by list ranking: root, depth, entry and exit of each node.

    Children follow each other by ``order``.  Element 2v enters node v and
    2v+1 leaves it; every tree's list ends by leaving its root.  All jumps
    double in each round, so rounds grow with the logarithm of the longest
    tour, whatever the depth of the trees.
    """
    n = len(parent)
    enter, leave = 2 * np.arange(n), 2 * np.arange(n) + 1
    after = np.empty(2 * n, np.int64)
    after[enter] = leave  # a leaf turns back at once
    kids = np.flatnonzero(parent >= 0)
    kids = kids[np.lexsort((order[kids], parent[kids]))]
    mates = parent[kids]
    first = np.ones(len(kids), bool)
    first[1:] = mates[1:] != mates[:-1]
    last = np.ones(len(kids), bool)
    last[:-1] = mates[1:] != mates[:-1]
    after[2 * mates[first]] = 2 * kids[first]
    after[2 * kids[~last] + 1] = 2 * kids[1:][~first[1:]] if len(kids) else 0
    after[2 * kids[last] + 1] = 2 * mates[last] + 1
    ends = 2 * np.flatnonzero(parent < 0) + 1
    after[ends] = ends
    steps = np.ones(2 * n, np.int64)
    level = np.where(np.arange(2 * n) % 2 == 0, 1, -1)
    steps[ends] = 0
    level[ends] = 0
    while True:
        further = after[after]
        steps += steps[after]
        level += level[after]
        if np.array_equal(further, after):
            break
        after = further
    root = after[enter] // 2
    length = steps[2 * root] + 1
    return {
        "root": root,
        "depth": -level[enter] + 1,
        "entry": length - 1 - steps[enter],
        "exit": length - 1 - steps[leave],
    }


def _places(group: np.ndarray, label: np.ndarray, parent: np.ndarray, has_parent: np.ndarray) -> np.ndarray:
    """Where each label's parent stands, or -1."""
    n = len(label)
    g = np.unique(group, return_inverse=True)[1].astype(np.int64)
    codes = np.unique(np.concatenate([label, parent[has_parent]]))
    width = len(codes) + 1
    own = g * width + np.searchsorted(codes, label)
    wanted = g * width + np.searchsorted(codes, np.where(has_parent, parent, label))
    by = np.argsort(own, kind="stable")
    at = np.searchsorted(own[by], wanted)
    hit = has_parent & (at < n)
    hit[hit] = own[by][at[hit]] == wanted[hit]
    return np.where(hit, by[np.minimum(at, n - 1)], -1)


def resolve(group: np.ndarray, label: np.ndarray, parent: np.ndarray, has_parent: np.ndarray, paths: bool) -> Iterator[pa.RecordBatch]:
    """Hierarchy columns of whole groups; (group, label) must be unique.

    Paths are made batch by batch and never all held: a chain of n labels has n * n / 2 elements.
    """
    n = len(label)
    up = _places(group, label, parent, has_parent)
    cyclic = peel(up)
    forest = np.where(cyclic, -1, up)
    tour = rank_tour(forest, label)
    cycle = np.full(n, -1, np.int64)
    on = np.flatnonzero(cyclic)
    low, jump = label.copy(), up.copy()
    for _ in range(int(len(on)).bit_length()):
        low[on] = np.minimum(low[on], low[jump[on]])
        jump[on] = jump[jump[on]]
    bad = cyclic[tour["root"]]
    cycle[bad] = low[tour["root"]][bad]
    depth = tour["depth"]
    arrays = [
        pa.array(group), pa.array(label), pa.array(parent, mask=~has_parent), pa.array(label[tour["root"]], mask=bad), pa.array(label[tour["root"]]), pa.array(cycle, mask=~bad),
        pa.array(depth), pa.array(tour["entry"]), pa.array(tour["exit"]), pa.array((tour["exit"] - tour["entry"] - 1) // 2),
    ]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    if not paths:
        done = pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.list_(pa.int64()))], names=names)
        for k in range(0, n, 10_000):
            yield done.slice(k, 10_000)
        return
    # parents come before their children on the tour, so the path at hand begins every path below it
    by = np.lexsort((tour["entry"], tour["root"]))
    deep, name = depth[by], label[by]
    done = pa.RecordBatch.from_arrays(arrays, names=names[:-1]).take(pa.array(by))
    ends = np.cumsum(deep + 1)
    path = np.empty(int(deep.max()) + 1 if n else 0, np.int64)
    k = 0
    while k < n:
        before = int(ends[k - 1]) if k else 0
        to = min(max(int(np.searchsorted(ends, before + PATH_ELEMENTS, "right")), k + 1), k + 10_000, n)
        out = np.empty(int(ends[to - 1]) - before, np.int64)
        at = 0
        for d, x in zip(deep[k:to].tolist(), name[k:to].tolist()):
            path[d] = x
            out[at : at + d + 1] = path[: d + 1]
            at += d + 1
        offsets = np.concatenate([[0], ends[k:to] - before]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*done.slice(k, to - k).columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))], names=names)
        k = to


def _local(paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            p = b.column(2)
            return b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), p.fill_null(0).to_numpy(zero_copy_only=False), p.is_valid().to_numpy(zero_copy_only=False)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(columns(b))
            size += b.num_rows
            if size < _BUFFER:
                continue
            cols = tuple(np.concatenate(c) for c in zip(*held))
            whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
            if whole:
                yield from resolve(*(c[:whole] for c in cols), paths)
            held, size = [tuple(c[whole:] for c in cols)], len(cols[0]) - whole
        if size:
            yield from resolve(*(np.concatenate(c) for c in zip(*held)), paths)

    return run


# --------------------------------------------------------------------------- across tasks


_STEP = "g bigint, v bigint, up bigint, acc bigint, plus bigint, wt bigint, low bigint, via array<bigint>"
_DONE = "g bigint, v bigint, size bigint, d bigint, top bigint, cycle bigint, path array<bigint>"


def solve(g: np.ndarray, v: np.ndarray, up: np.ndarray, has_up: np.ndarray, acc: np.ndarray, plus: np.ndarray, wt: np.ndarray, low: np.ndarray, via: list | None) -> Iterator[pa.RecordBatch]:
    """What is left of contracted groups: size, weighted depth, top, cycle and path of each label.

    ``acc`` is the size of what was peeled into a label, itself included; the
    link to its parent stands for spliced labels: their size ``plus``, weight
    ``wt``, least label ``low`` and names ``via``.
    """
    n = len(v)
    parent = _places(g, v, up, has_up)
    cyclic = peel(parent)
    forest = np.where(cyclic, -1, parent)
    tour = rank_tour(forest, v)
    ring, jump = np.minimum(v, low), parent.copy()
    on = np.flatnonzero(cyclic)
    for _ in range(int(len(on)).bit_length()):
        ring[on] = np.minimum(ring[on], ring[jump[on]])
        jump[on] = jump[jump[on]]
    # labels of a subtree follow each other on the tour
    by = np.lexsort((tour["entry"], tour["root"]))
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    below = (tour["exit"] - tour["entry"] - 1) // 2
    sums = np.concatenate([[0], np.cumsum((acc + np.where(forest >= 0, plus, 0))[by])])
    size = sums[place + below + 1] - sums[place] - np.where(forest >= 0, plus, 0)
    # a label's weight counts for all below it: entered on the way down, left on the way up
    steps = np.zeros(2 * n, np.int64)
    first = np.zeros(n, np.int64)
    roots, counts = np.unique(tour["root"], return_counts=True)
    first[roots] = np.concatenate([[0], np.cumsum(2 * counts)[:-1]])
    w = np.where(forest >= 0, wt, 0)
    steps[first[tour["root"]] + tour["entry"]] = w
    steps[first[tour["root"]] + tour["exit"]] = -w
    d = np.cumsum(steps)[first[tour["root"]] + tour["entry"]]
    bad = cyclic[tour["root"]]
    arrays = [pa.array(g), pa.array(v), pa.array(size), pa.array(d), pa.array(v[tour["root"]]), pa.array(ring[tour["root"]], mask=~bad)]
    names = [x.split()[0] for x in _DONE.split(", ")]
    done = pa.RecordBatch.from_arrays(arrays, names=names[:-1]).take(pa.array(by))
    deep = tour["depth"][by]
    stack: list[list[int]] = []
    k = 0
    while k < n:
        if via is None:
            to = min(n, k + 10_000)
            path = pa.nulls(to - k, pa.list_(pa.int64()))
        else:
            rows, held, to = [], 0, k
            while to < n and (not rows or held < PATH_ELEMENTS) and len(rows) < 10_000:
                x = int(by[to])
                own = [int(v[x])] if forest[x] < 0 else [*stack[int(deep[to]) - 1], *via[x], int(v[x])]
                del stack[int(deep[to]) :]
                stack.append(own)
                rows.append(own)
                held += len(own)
                to += 1
            path = pa.array(rows, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*done.slice(k, to - k).columns, path], names=names)
        k = to


def _solve(paths: bool):
    def answer(t: pa.Table) -> Iterator[pa.RecordBatch]:
        num = lambda c: t.column(c).fill_null(0).to_numpy()
        low = t.column("low").fill_null(np.iinfo(np.int64).max).to_numpy()
        yield from solve(num("g"), num("v"), num("up"), t.column("up").is_valid().to_numpy(), num("acc"), num("plus"), num("wt"), low, t.column("via").to_pylist() if paths else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < _BUFFER:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            whole = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if whole:
                yield from answer(t.slice(0, whole).combine_chunks())
                held = t.slice(whole).to_batches()
        if held:
            yield from answer(pa.Table.from_batches(held).combine_chunks())

    return run


def _contract(nodes: DataFrame, local_rows: int, paths: bool) -> DataFrame:
    """(g, v, size, d, top, cycle, path) of nodes(g, v, up, wt): subtree size, weight to the top, the top label or least label of the cycle met."""
    cols = [x.split()[0] for x in _STEP.split(", ")]
    empty = F.array().cast("array<bigint>")
    none = F.lit(None).cast("bigint")
    left = cut(nodes.select("g", "v", "up", F.lit(1).cast("bigint").alias("acc"), F.lit(0).cast("bigint").alias("plus"), "wt", none.alias("low"), (empty if paths else F.lit(None).cast("array<bigint>")).alias("via")))
    undo: list[tuple[str, DataFrame]] = []
    n = 0

    def most() -> int:
        return left.groupBy("g").count().agg(F.max("count")).head()[0] or 0

    while most() > local_rows:
        n += 1
        # peel: every leaf goes into its parent
        kids = left.filter("up is not null").groupBy(F.col("g").alias("g2"), F.col("up").alias("v2")).agg(F.count(F.lit(1)).alias("k"))
        marked = cut(left.join(kids, (F.col("g") == F.col("g2")) & (F.col("v") == F.col("v2")), "left").drop("g2", "v2"))
        leaf = F.col("k").isNull() & F.col("up").isNotNull()
        leaves = marked.filter(leaf).drop("k")
        into = leaves.groupBy(F.col("g").alias("g2"), F.col("up").alias("v2")).agg(F.sum(F.col("acc") + F.col("plus")).alias("more"), F.count(F.lit(1)).alias("gone"))
        rest = marked.filter(~leaf).join(into, (F.col("g") == F.col("g2")) & (F.col("v") == F.col("v2")), "left")
        rest = rest.withColumn("acc", F.col("acc") + F.coalesce("more", F.lit(0))).withColumn("k", F.coalesce("k", F.lit(0)) - F.coalesce("gone", F.lit(0)))
        undo.append(("peel", leaves))
        # a root, or a loop of one, with nothing else on it is done
        alone = (F.col("up").isNull() & (F.col("k") == 0)) | ((F.col("up") == F.col("v")) & (F.col("k") == 1))
        rest = cut(rest.withColumn("alone", F.coalesce(alone, F.lit(False))))
        undo.append(("alone", rest.filter("alone").select(*cols)))
        rest = rest.filter(~F.col("alone"))
        # splice: a label with one child hands it to its parent; neither of the two is spliced in the same round, by hashes of their names
        coin = lambda c: F.xxhash64("g", c, F.lit(n)) % 2 == 0
        rest = cut(rest.select(*cols, (F.col("up").isNotNull() & (F.col("k") == 1) & (F.col("up") != F.col("v")) & coin("v") & ~coin("up")).alias("out")))
        taken = rest.filter("out").select(F.col("g").alias("g2"), F.col("v").alias("m"), F.col("up").alias("m_up"), F.col("acc").alias("m_acc"), F.col("plus").alias("m_plus"), F.col("wt").alias("m_wt"), F.col("low").alias("m_low"), F.col("via").alias("m_via"))
        stay = rest.filter(~F.col("out"))
        pairs = cut(stay.join(taken, (F.col("g") == F.col("g2")) & (F.col("up") == F.col("m")), "left"))
        hit = F.col("m").isNotNull()
        undo.append(("splice", pairs.filter(hit).select("g", F.col("m").alias("v"), F.col("m_up").alias("up"), F.col("v").alias("child"), F.col("plus").alias("child_plus"), F.col("m_acc").alias("acc"), F.col("m_wt").alias("wt"), F.col("m_via").alias("via"))))
        left = cut(
            pairs.select(
                "g", "v", F.when(hit, F.col("m_up")).otherwise(F.col("up")).alias("up"), "acc", F.when(hit, F.col("plus") + F.col("m_acc") + F.col("m_plus")).otherwise(F.col("plus")).alias("plus"),
                F.when(hit, F.col("wt") + F.col("m_wt")).otherwise(F.col("wt")).alias("wt"), F.when(hit, F.least("low", "m", "m_low")).otherwise(F.col("low")).alias("low"),
                (F.when(hit, F.concat("m_via", F.array("m"), "via")).otherwise(F.col("via")) if paths else F.col("via")).alias("via"),
            )
        )
    known = cut(map_arrow(spread(left.select(*cols), "g").sortWithinPartitions("g"), _solve(paths), _DONE))
    for kind, rows in reversed(undo):
        if kind == "alone":
            ring = F.when(F.col("up").isNotNull(), F.least("v", "low"))
            known = known.unionByName(rows.select("g", "v", F.col("acc").alias("size"), F.lit(0).cast("bigint").alias("d"), F.col("v").alias("top"), ring.alias("cycle"), (F.array("v") if paths else F.lit(None).cast("array<bigint>")).alias("path")))
            continue
        p = known.select(F.col("g").alias("g2"), F.col("v").alias("p"), F.col("d").alias("p_d"), F.col("top").alias("p_top"), F.col("cycle").alias("p_cycle"), F.col("path").alias("p_path"))
        j = rows.join(p, (F.col("g") == F.col("g2")) & (F.col("up") == F.col("p")))
        path = F.concat("p_path", "via", F.array("v")) if paths else F.lit(None).cast("array<bigint>")
        if kind == "peel":
            new = j.select("g", "v", F.col("acc").alias("size"), (F.col("p_d") + F.col("wt")).alias("d"), F.col("p_top").alias("top"), F.col("p_cycle").alias("cycle"), path.alias("path"))
        else:
            c = known.select(F.col("g").alias("g3"), F.col("v").alias("c"), F.col("size").alias("c_size"), F.col("top").alias("c_top"), F.col("cycle").alias("c_cycle"))
            j = j.join(c, (F.col("g") == F.col("g3")) & (F.col("child") == F.col("c")))
            ring = F.col("c_cycle").isNotNull() & (F.col("c_top") == F.col("c"))  # its child is on the cycle, so it is, too
            pick = lambda a, b: F.when(ring, a).otherwise(b)
            new = j.select(
                "g", "v", pick(F.col("acc"), F.col("acc") + F.col("c_size") + F.col("child_plus")).alias("size"), pick(F.lit(0).cast("bigint"), F.col("p_d") + F.col("wt")).alias("d"),
                pick(F.col("v"), F.col("p_top")).alias("top"), pick(F.col("c_cycle"), F.col("p_cycle")).alias("cycle"), (pick(F.array("v"), path) if paths else path).alias("path"),
            )
        known = cut(known.unionByName(new))
    return known


def _large(labels: DataFrame, paths: bool, local_rows: int) -> DataFrame:
    """Groups beyond the local bound: contracted once for sizes and depths, and once, with what lies before each label, for entries."""
    known = labels.select(F.col("group_id").alias("g2"), F.col("label_id").alias("p2"))
    up = cut(labels.join(known, (F.col("group_id") == F.col("g2")) & (F.col("parent_id") == F.col("p2")), "left").select(F.col("group_id").alias("g"), F.col("label_id").alias("v"), "parent_id", F.col("p2").alias("up")))
    tree = _contract(up.select("g", "v", "up", F.lit(1).cast("bigint").alias("wt")), local_rows, paths)
    all_ = cut(up.join(tree, ["g", "v"]).withColumn("up", F.when(~(F.col("cycle").isNotNull() & (F.col("top") == F.col("v"))), F.col("up"))))
    # what siblings before a label take up: sums of chunks of 65,536 names, then within each chunk
    chunk = F.floor(F.col("v") / 65536)
    kids = all_.filter("up is not null").select("g", "up", "v", "size", chunk.alias("chunk"))
    sums = kids.groupBy("g", "up", "chunk").agg(F.sum("size").alias("s"))
    before = sums.withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("g", "up").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("g", "up", "chunk").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = kids.withColumn("inner", inner).join(before, ["g", "up", "chunk"]).select("g", "v", (1 + 2 * (F.col("base") + F.col("inner"))).alias("wt"))
    entry = _contract(all_.select("g", "v", "up").join(place, ["g", "v"], "left").select("g", "v", "up", F.coalesce("wt", F.lit(0)).cast("bigint").alias("wt")), local_rows, False)
    out = all_.join(entry.select("g", "v", F.col("d").alias("entry")), ["g", "v"])
    return out.select(
        F.col("g").alias("group_id"), F.col("v").alias("label_id"), "parent_id", F.when(F.col("cycle").isNull(), F.col("top")).alias("root_id"), F.col("top").alias("top_id"), F.col("cycle").alias("cycle_id"), F.col("d").alias("depth"),
        "entry", (F.col("entry") + 2 * F.col("size") - 1).alias("exit"), (F.col("size") - 1).alias("descendants"), "path",
    )


def hierarchy(links: DataFrame, paths: bool = True, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """links(group_id bigint, label_id bigint, parent_id bigint) -> one row per label.

    root_id is null and cycle_id set for labels that never reach a root; top_id
    is the root, or the label on the cycle that is met first; their ``depth`` is the number of links to the first label on the cycle and their
    ``path`` begins there.  All descendants of label d are the labels x of its
    group and root with d.entry < x.entry and x.exit < d.exit (the same holds
    within what hangs off one cycle label); ``descendants`` counts them.
    ``path`` runs from the root to the label; ``paths=False`` leaves it null, and
    ``ancestors_of`` gives the paths of chosen labels from their intervals.

    * A parent that is null or no label of the group makes the label a root; a
      label that is its own parent is a cycle of one.
    * Rows with a null group or label are no labels.  Repeated rows count once;
      among rows of one label with different parents the smallest parent holds
      (null only if all are null).
    * An empty table gives an empty result.
    """
    labels = links.filter(F.col("group_id").isNotNull() & F.col("label_id").isNotNull())
    labels = labels.groupBy("group_id", "label_id").agg(F.min("parent_id").alias("parent_id")).select(*[F.col(c).cast("bigint") for c in ("group_id", "label_id", "parent_id")])
    sizes = links.filter(F.col("group_id").isNotNull()).groupBy("group_id").count().filter(F.col("count") > local_rows).select(F.col("group_id").cast("bigint").alias("group_id"))
    large = cut(sizes)
    if not large.head(1):
        return map_arrow(spread(labels, "group_id").sortWithinPartitions("group_id"), _local(paths), _SCHEMA)
    small = labels.join(large, "group_id", "left_anti")
    near = map_arrow(spread(small, "group_id").sortWithinPartitions("group_id"), _local(paths), _SCHEMA)
    return near.unionByName(_large(labels.join(large, "group_id", "left_semi"), paths, local_rows))


def tree_links(labels: DataFrame) -> DataFrame:
    """Links of shortest-path-tree labels, by node or by edge as each tree was searched.

    Of a label delivered again with another parent the earliest delivery holds.
    Rows of an unknown mode, or without tree or label id, are no labels.
    """
    node = F.col("traversal_mode") == "node_based"
    rows = labels.filter(F.col("traversal_mode").isin("node_based", "edge_based")).select(
        "tree_id", F.when(node, F.col("node_id")).otherwise(F.col("edge_id")).cast("bigint").alias("label_id"), F.when(node, F.col("prev_node_id")).otherwise(F.col("prev_edge_id")).cast("bigint").alias("parent_id"), "received_at"
    )
    rows = rows.filter(F.col("tree_id").isNotNull() & F.col("label_id").isNotNull())
    first = F.min(F.struct("received_at", "parent_id"))
    return rows.groupBy(F.col("tree_id").alias("group_id"), "label_id").agg(first.alias("f")).select("group_id", "label_id", F.col("f.parent_id").alias("parent_id"))


def ancestors_of(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(group_id, label_id, ancestor_id, depth) of the ``wanted``(group_id, label_id) labels, by interval containment.

    Full paths of chosen labels where arrays of all paths would be quadratic:
    the ancestors by ``depth``, the label itself at the end.
    """
    asked = tree.join(wanted.select("group_id", "label_id").distinct(), ["group_id", "label_id"])
    a = asked.select(F.col("group_id").alias("g"), "label_id", F.col("top_id").alias("r"), F.col("entry").alias("en"), F.col("exit").alias("ex"))
    b = tree.select("group_id", F.col("label_id").alias("ancestor_id"), F.col("top_id").alias("root"), "entry", "exit", "depth")
    inside = (F.col("g") == F.col("group_id")) & (F.col("r") == F.col("root")) & (F.col("entry") <= F.col("en")) & (F.col("ex") <= F.col("exit"))
    return a.join(b, inside).select("group_id", "label_id", "ancestor_id", "depth")


def descendants_of(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(group_id, label_id, descendant_id) of the ``wanted``(group_id, label_id) labels, by interval containment."""
    tops = tree.join(wanted.select("group_id", "label_id").distinct(), ["group_id", "label_id"])
    top = F.col("top_id")
    a = tops.select(F.col("group_id").alias("g"), F.col("label_id").alias("top"), top.alias("r"), F.col("entry").alias("en"), F.col("exit").alias("ex"))
    b = tree.select("group_id", F.col("label_id").alias("descendant_id"), top.alias("root"), "entry", "exit")
    inside = (F.col("g") == F.col("group_id")) & (F.col("r") == F.col("root")) & (F.col("en") < F.col("entry")) & (F.col("exit") < F.col("ex"))
    return a.join(b, inside).select("group_id", F.col("top").alias("label_id"), "descendant_id")
