"""Least weights between many pairs of nodes, searched from both ends over a packed graph.

A table of requests meets one graph, and each request needs a small part of it
that nobody knows before.  So the graph is packed, some 10 bytes an arc,
written once, and read by each of a few blocks of requests, no more of them
than there are cores and however many requests there are; a block unpacks it
and answers its requests in groups over plain arrays.  Graphs of more than
``PACKED_ARCS`` arcs don't fit a task; see ``search.pair_weights`` for these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import MEAN_RADIUS_M
from waymesh.operators.fragments import INF, _gather, great_circle, lower_bound
from waymesh.session import map_arrow

#: Arcs of a graph that a task unpacks: some 45 bytes each at the peak, so about 550 MB.
PACKED_ARCS = 12_000_000
#: Numbers of features that are sent with a graph, 8 bytes each.
PACKED_NUMBERS = 16_000_000
#: Arcs, nodes or requests of one packed row.
CHUNK = 250_000
#: Labels that a group of requests has room for, 8 bytes each.
GROUP_SLOTS = 12_000_000
#: Arcs that are unpacked in the time of one request.
ARCS_A_REQUEST = 20_000

HEAD, ARCS, FEATURES, PLACES = 0, 1, 2, 3
_PACKED = "kind int, n int, a binary, b binary, c binary"
_PAIRS = "part int, request binary, source binary, target binary"


def copies(n_requests: int, n_arcs: int, cores: int) -> int:
    """Blocks of requests, each with a copy of the graph: at most one a core, and none whose requests take less than the unpacking."""
    return max(1, min(cores, n_requests * ARCS_A_REQUEST // max(1, n_arcs)))


# --------------------------------------------------------------------------- packing


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in the fewest bytes each, as distances to the least one; before them the bytes each and the least one."""
    low = x.min()
    y = x.view(np.uint64) - low.view(np.uint64)  # wraps where int64 would not hold it
    kind = np.min_scalar_type(y.max())
    return np.array([kind.itemsize, low], np.int64).tobytes() + y.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    """The numbers again, as int32 where they fit."""
    size, low = np.frombuffer(data, np.int64, 2)
    x = (np.frombuffer(data, f"u{size}", offset=16).astype(np.uint64) + low.view(np.uint64)).view(np.int64)
    return _small(x)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if -(2**31) <= x.min() and x.max() < 2**31 else x


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _row(kind: int, n: int, *data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([n], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], names=[x.split()[0] for x in _PACKED.split(", ")])


def _pack_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _chunks(batches):
        base, adj, w = (t.column(c).to_numpy() for c in ("base", "adj", "w"))
        order = np.argsort(base, kind="stable")
        base = base[order]
        steps = np.diff(base) if len(base) > 1 else np.zeros(1, np.int64)  # few bytes, as the arcs are sorted
        yield _row(ARCS, len(base), base[:1].tobytes() + _narrow(steps), _narrow(adj[order]), _narrow(w[order]))


def _pack_features(batches: Iterator[pa.RecordBatch], kind: int = FEATURES) -> Iterator[pa.RecordBatch]:
    for t in _chunks(batches):
        f = t.column("f").combine_chunks()
        yield _row(kind, t.num_rows, _narrow(t.column("node").to_numpy()), f.flatten().to_numpy(zero_copy_only=False).astype(float).tobytes(), b"")


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["request", "source", "target"]
    for i, t in enumerate(_chunks(batches)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([_narrow(t.column(c).to_numpy())], pa.binary()) for c in names]], names=["part", *names])


# --------------------------------------------------------------------------- in one block


class _Graph:
    """Arcs of both directions over slots: a node's number, and that plus ``n`` for searches against the arcs."""

    def __init__(self, arcs: list[tuple[bytes, bytes, bytes]], known: list[tuple[bytes, bytes]], places: bool = False) -> None:
        base, adj, w = self._ends(arcs)
        low, high = (min(base.min(), adj.min()), max(base.max(), adj.max())) if len(base) else (0, -1)
        self.ids = None
        self.low, self.n = int(low), int(high) - int(low) + 1
        if self.n > len(base) + 1024:  # numbers with wide gaps
            self.ids = np.unique(np.concatenate([np.unique(base), np.unique(adj)]))
            self.n = len(self.ids)
        base, adj = self.code(base), self.code(adj)
        self.count = np.concatenate([np.bincount(base, minlength=self.n), np.bincount(adj, minlength=self.n)]).astype(np.int32)
        self.start = np.cumsum(self.count, dtype=np.int64) - self.count
        m = len(base)
        self.to, self.w = np.empty(2 * m, np.int32), np.empty(2 * m, w.dtype)
        for side, (own, other) in enumerate(((base, adj), (adj, base))):
            order = np.argsort(own, kind="stable")
            np.take(other, order, out=self.to[side * m : (side + 1) * m])
            np.take(w, order, out=self.w[side * m : (side + 1) * m])
            del order
        self.to[m:] += self.n
        # within this step the number of labels grows less than threefold
        self.width = max(1, int(w.mean() / max(1, m / max(1, np.count_nonzero(self.count[: self.n]))))) if m else 1
        self.feature = None
        if known:
            self._lay(known)
            if places:
                self._rate(base, adj, w)
        if self.feature is not None:
            self.reach = _most(self.feature[self.known])

    @staticmethod
    def _ends(arcs: list[tuple[bytes, bytes, bytes]]) -> list[np.ndarray]:
        cols: list[list[np.ndarray]] = [[], [], []]
        for a, b, c in arcs:
            adj = _wide(b)
            base = np.cumsum(np.concatenate([np.frombuffer(a, np.int64, 1), _wide(a[8:])[: len(adj) - 1]]), dtype=np.int64)
            for col, x in zip(cols, (_small(base), adj, _wide(c))):
                col.append(x)
        return [np.concatenate(col) if col else np.zeros(0, np.int32) for col in cols]

    def _lay(self, known: list[tuple[bytes, bytes]]) -> None:
        for a, b in known:
            node = _wide(a)
            f = np.frombuffer(b, float).reshape(len(node), -1)
            at = self.code(node)
            ok = at >= 0
            if self.feature is None:
                self.feature, self.known = np.zeros((self.n, f.shape[1])), np.zeros(self.n, bool)
            self.feature[at[ok]], self.known[at[ok]] = f[ok], True

    def _rate(self, base: np.ndarray, adj: np.ndarray, w: np.ndarray) -> None:
        """Give places the least weight a metre of all arcs.  An arc to where no place is known may be of any length, so there is no bound then."""
        self.feature = np.column_stack([self.feature, np.zeros(self.n)])
        met = self.count[: self.n] + self.count[self.n :] > 0
        rate = INF if len(w) and self.known[met].all() else 0
        for i in range(0, len(w) if rate else 0, CHUNK):
            metres = great_circle(self.feature[base[i : i + CHUNK]], self.feature[adj[i : i + CHUNK]])
            rate = min(rate, (w[i : i + CHUNK] / np.maximum(metres, 0.001)).min())
        self.feature[:, 2] = rate
        if rate <= 0:
            self.feature = None

    def code(self, x: np.ndarray) -> np.ndarray:
        """Numbers of nodes, below zero for those that no arc has."""
        if self.ids is None:
            at = x.astype(np.int64) - self.low
            return np.where((at >= 0) & (at < self.n), at, -1).astype(np.int32)
        at = np.minimum(np.searchsorted(self.ids, x), self.n - 1)
        return np.where(self.ids[at] == x, at, -1).astype(np.int32)


def _most(f: np.ndarray) -> int:
    """No bound by these features is above it."""
    if not len(f):
        return 0
    spread = np.nanmax(np.vstack([f, np.full(f.shape[1], -np.inf)]), axis=0) - np.nanmin(np.vstack([f, np.full(f.shape[1], np.inf)]), axis=0)
    most = MEAN_RADIUS_M * (spread[0] + spread[1]) * f[:, 2].max() if f.shape[1] == 3 else spread.max()
    return int(min(max(most * (1 + 1e-6), 0) + 1, INF // 2))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted without repeats; ``np.unique`` hashes these, which takes several times as long."""
    x = np.sort(x)
    one = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=one[1:])
    return x[one]


def _search(g: _Graph, s: np.ndarray, t: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Least weights from s to t, INF where there is no way; ``dist`` has 2 n labels a request, all INF, and is left so.

    Both ends of all requests go on at once.  Labels below the least open one
    of their end are final.  A label is kept only where its weight and what is
    left at least (the final label of the other end, else how far that has
    come, or the bound by features) are below the best way found, and goes on
    only where the other end has no final label.
    """
    k, n = len(s), g.n
    best = np.full(k, INF)
    best[s == t] = 0
    first = np.arange(k, dtype=np.int64) * (2 * n)
    open_ = np.concatenate([first + s, first + n + t])
    dist[open_] = 0
    touched = [open_]
    while True:
        d, end = dist[open_], open_ // n
        low = np.full(2 * k, INF)
        np.minimum.at(low, end, d)
        keep = (low[0::2] + low[1::2] < best)[end >> 1]
        if not keep.any():
            break
        pick = keep & (d <= low[end] + g.width)
        now, later, d = open_[pick], open_[keep & ~pick], d[pick]
        slot = now % (2 * n)
        ids, of = _gather(g.start, g.count, slot)
        to, w = (now - slot)[of] + g.to[ids], d[of] + g.w[ids]
        ok = w < dist[to]
        to, w = to[ok], w[ok]
        end = to // n
        other, far = dist[to + n - 2 * n * (end & 1)], low[end ^ 1]
        ok = w + np.minimum(other, far) < best[end >> 1]
        to, w = to[ok], w[ok]
        if g.feature is not None and len(to):
            most = best[end[ok] >> 1]
            near = np.flatnonzero(w + g.reach >= most)  # a bound tells nothing of the others
            out = near[w[near] + _left(g, to[near], s, t) >= most[near]]
            to, w = np.delete(to, out), np.delete(w, out)
        np.minimum.at(dist, to, w)
        to = _distinct(to)
        touched.append(to)
        end = to // n
        other = dist[to + n - 2 * n * (end & 1)]
        np.minimum.at(best, end >> 1, dist[to] + other)
        open_ = _distinct(np.concatenate([later, to[other >= low[end ^ 1]]]))
    for x in touched:
        dist[x] = INF
    return best


def _left(g: _Graph, to: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """What is left at least from each label to the goal of its end, by features; 0 where they are not known."""
    r, back, node = to // (2 * g.n), to // g.n & 1 == 1, to % g.n
    frm, goal = np.where(back, s[r], node), np.where(back, node, t[r])
    ok = g.known[frm] & g.known[goal]
    out = np.zeros(len(to), np.int64)
    if ok.any():
        out[ok] = lower_bound(g.feature[frm[ok]], g.feature[goal[ok]])
    return out


def _answer(batches: Iterator[pa.RecordBatch], group_slots: int) -> Iterator[pa.RecordBatch]:
    arcs, known, pairs, places = [], [], [], False
    for b in batches:
        for i, kind in enumerate(b.column("kind").to_pylist()):
            at = lambda *names: tuple(b.column(c)[i].as_py() for c in names)  # noqa: B023, E731
            if kind == HEAD:
                pairs.append(np.stack([_wide(x).astype(np.int64) for x in at("request", "source", "target")]))
            elif kind == ARCS:
                arcs.append(at("a", "b", "c"))
            else:
                known.append(at("a", "b"))
                places |= kind == PLACES
    if not pairs:
        return
    request, s, t = np.concatenate(pairs, axis=1)
    w = np.full(len(request), INF)
    w[s == t] = 0
    g = _Graph(arcs, known, places)
    arcs.clear()
    known.clear()
    if g.n:
        a, b = g.code(s), g.code(t)
        todo = np.flatnonzero((a >= 0) & (b >= 0) & (s != t))
        k = max(1, min(len(todo), group_slots // (2 * g.n)))
        dist = np.full(2 * g.n * k, INF)
        for i in range(0, len(todo), k):
            at = todo[i : i + k]
            w[at] = _search(g, a[at], b[at], dist)
    ok = w < INF
    yield pa.RecordBatch.from_arrays([pa.array(request[ok]), pa.array(w[ok])], names=["request", "w"])


def pair_weights(edges: DataFrame, requests: DataFrame, n_arcs: int, features: DataFrame | None = None, group_slots: int = GROUP_SLOTS, places: bool = False) -> DataFrame:
    """(request, w) of requests(request, source, target) over edges(base, adj, w), of which there are ``n_arcs``; see ``search.pair_weights``.

    With ``places``, f of features(node, f) is (y, x) in radians, and blocks
    find the least weight a metre themselves.
    """
    spark = edges.sparkSession
    n = copies(requests.count(), n_arcs, spark.sparkContext.defaultParallelism)
    head = spark.range(1).select(F.lit(HEAD).alias("kind"), F.lit(0).alias("n"), *[F.lit(None).cast("binary").alias(c) for c in "abc"])
    graph = head.unionByName(map_arrow(edges.select(*[F.col(c).cast("bigint").alias(c) for c in ("base", "adj", "w")]), _pack_arcs, _PACKED))
    if features is not None:
        known = features.select(F.col("node").cast("bigint").alias("node"), F.col("f").cast("array<double>").alias("f")).filter("node is not null")
        graph = graph.unionByName(map_arrow(known, partial(_pack_features, kind=PLACES if places else FEATURES), _PACKED))
    ids = ["request", "source", "target"]
    blocks = requests.select(*[F.col(c).cast("bigint").alias(c) for c in ids]).repartitionById(n, F.pmod(F.xxhash64("request"), F.lit(n)).cast("int"))
    # a product of n partitions with one: all blocks read the one copy of the graph, which no other join or shuffle does; requests come with its head
    rows = map_arrow(blocks, _pack_pairs, _PAIRS).hint("shuffle_replicate_nl").join(graph.repartition(1), (F.col("part") == 0) | (F.col("kind") == HEAD))
    rows = rows.select("kind", "a", "b", "c", *[F.when(F.col("kind") == HEAD, F.col(c)).alias(c) for c in ids])
    return map_arrow(rows, partial(_answer, group_slots=group_slots), "request bigint, w bigint")
