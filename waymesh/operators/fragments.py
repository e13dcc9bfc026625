"""Label-setting over fragments of a graph: the engine of all searches.

Arcs are cut into fragments by a hash of the node they leave from, so many that
none holds more than ``FRAGMENT_ARCS`` of them; a node with more arcs than that
is spread over several fragments.  A round brings the labels that arrive at a
fragment together with its arcs and relaxes them to a fixpoint inside the
fragment, in buckets of growing weight over plain arrays; what leaves the
fragment is sent on.  Only fragments with new labels take part in a round, and
only changed labels are written.  A graph of one fragment is done in one round,
a large one needs as many as a way changes fragments, whatever the sources.
Sources are dealt into blocks, so that a task holds a bounded number of labels.

The cut is the same rule at every size; there is no second algorithm.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geo import MEAN_RADIUS_M
from waymesh.session import cut, ship

#: Arcs of one fragment: some 60 bytes each as arrays, so about 120 MB a task.
FRAGMENT_ARCS = 2_000_000
#: Labels a task is expected to hold at most, by four arcs a node: 40 bytes each.
BLOCK_LABELS = 6_000_000
#: Rounds after which changed labels are merged into one table.
COMPACT = 8
MAX_ROUNDS = 100_000
INF = np.iinfo(np.int64).max // 4

ARC, TURN, GOAL, FEATURE, SHARED = 0, 1, 2, 3, 4
LABEL, MESSAGE, BOUND = 0, 1, 2
_STATE = "frag int, block int, kind int, source bigint, a bigint, node bigint, w bigint, hops int"
_FIELD = ["frag", "block", "kind", "a", "base", "adj", "w", "home", "f", "g"]


# --------------------------------------------------------------------------- in one fragment


def _gather(start: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the lists ``at``, and which list each is of."""
    n = count[at]
    of = np.repeat(np.arange(len(at)), n)
    before = np.cumsum(n) - n
    return np.arange(len(of)) - before[of] + start[at][of], of


def _lists(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, count) of entries laid out by their owner 0..n-1."""
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=n)
    return order, np.cumsum(count) - count, count


def _least(slot: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal slots the one of least weight, then fewest hops."""
    order = np.lexsort((h, w, slot))
    slot, w, h = slot[order], w[order], h[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    return slot[first], w[first], h[first]


class _Field:
    """What a search needs of a fragment; slots are the keys that carry labels."""

    def __init__(self, right: pa.Table, left: pa.Table, frag: int, turns: bool, alone: bool) -> None:
        col = {c: right.column(c) for c in ("kind", "a", "base", "adj", "w", "home")}
        kind = col["kind"].to_numpy()
        num = lambda c, m: col[c].filter(pa.array(m)).to_numpy()
        arcs = kind == ARC
        a, base, adj, w, home = (num(c, arcs) for c in ("a", "base", "adj", "w", "home"))
        la, ln, lk = (left.column(c).to_numpy() for c in ("a", "node", "kind"))
        la, ln = la[lk != BOUND], ln[lk != BOUND]
        goals = kind == GOAL
        gs, gt, shared = num("base", goals), num("adj", goals), num("adj", kind == SHARED)
        self.nodes = np.unique(np.concatenate([base, adj, ln, gt, shared]))
        self.n = len(self.nodes)
        code = lambda x: np.searchsorted(self.nodes, x)
        self.turns, self.alone = turns, alone
        tail, head = code(base), code(adj)
        if turns:
            names = np.unique(np.concatenate([a, la]))
            pair = np.concatenate([np.searchsorted(names, a) * self.n + head, np.searchsorted(names, la) * self.n + code(ln)])
            keys, at = np.unique(pair, return_inverse=True)
            self.slot_a, self.slot_node = names[keys // self.n], keys % self.n
            to, self.left_slot = at[: len(a)], at[len(a) :]
            order, self.start, self.count = _lists(tail, self.n)
            self.edge, self.tail = a[order], tail[order]
            self.size = len(keys)
        else:
            to = head + a * self.n
            order, self.start, self.count = _lists(tail + a * self.n, 2 * self.n)
            self.left_slot = code(ln) + la * self.n
            self.size = 2 * self.n
            self.slot_a, self.slot_node = np.repeat([0, 1], self.n), np.tile(np.arange(self.n), 2)
        self.to, self.w = to[order], w[order]
        here = np.ones(self.n, bool)
        if not alone:
            here[:] = False
            here[code(ln)] = True  # only labels of this fragment arrive
            here[tail] = True
            here[head[home == frag]] = True
        self.here = here[self.slot_node]
        hub = np.zeros(self.n, bool)
        hub[head[home < 0]] = True
        self.hub = hub[self.slot_node]
        self.width = max(1, int(w.mean())) if len(w) else 1
        self.shared = code(shared).tolist()
        self.goals: dict[int, list[int]] = {}
        self.request: dict[int, int] = {}
        rows = np.flatnonzero(goals)
        for i, s, t in zip(rows.tolist(), gs.tolist(), code(gt).tolist()):
            self.goals.setdefault(s, []).append(t)
            self.request[s] = i
        self.right = right
        known = np.flatnonzero(kind == FEATURE)
        self.known = code(col["base"].to_numpy()[known]) if len(known) else None
        if self.known is not None:
            ok = (self.known < self.n) & (self.nodes[np.minimum(self.known, self.n - 1)] == col["base"].to_numpy()[known])
            self.known, known = self.known[ok], known[ok]
            self.feature = np.array([_numbers(x) for x in right.column("f").take(pa.array(known)).to_pylist()]).reshape(len(known), -1)
        if turns:
            self._lay_turns(num("a", kind == TURN), num("base", kind == TURN), num("w", kind == TURN))

    def _lay_turns(self, frm: np.ndarray, to: np.ndarray, cost: np.ndarray) -> None:
        """Listed turns as (slot of arrival, arc, cost); an arc's own turn back is listed, too."""
        by_edge = np.argsort(self.edge, kind="stable")
        edge = self.edge[by_edge]
        by_slot = np.argsort(self.slot_a, kind="stable")
        slot_a = self.slot_a[by_slot]
        lo, hi = np.searchsorted(edge, to), np.searchsorted(edge, to, "right")
        at, of = _gather(lo, hi - lo, np.arange(len(to)))
        arc, frm, cost = by_edge[at], frm[of], cost[of]
        lo, hi = np.searchsorted(slot_a, frm), np.searchsorted(slot_a, frm, "right")
        at, of = _gather(lo, hi - lo, np.arange(len(frm)))
        slot, arc, cost = by_slot[at], arc[of], cost[of]
        ok = self.slot_node[slot] == self.tail[arc]
        slot, arc, cost = slot[ok], arc[ok], cost[ok]
        key = slot * max(1, len(self.edge)) + arc
        order = np.lexsort((cost, key))
        key, slot, arc, cost = key[order], slot[order], arc[order], cost[order]
        one = np.ones(len(key), bool)
        one[1:] = key[1:] != key[:-1]
        self.listed = key[one]
        open_ = one & (cost >= 0)
        order, self.turn_start, self.turn_count = _lists(slot[open_], self.size)
        self.turn_arc, self.turn_cost = arc[open_][order], cost[open_][order]

    def potentials(self, source: int, both: bool) -> np.ndarray | None:
        """Twice a lower bound of the way that is left, for each slot; for searches from both ends the difference of both bounds."""
        if self.known is None or source not in self.request:
            return None
        row = self.request[source]
        ends = [_numbers(self.right.column(c)[row].as_py()) for c in ("f", "g")]
        if ends[1] is None or (both and ends[0] is None):
            return None
        to = np.zeros(self.n, np.int64)
        to[self.known] = lower_bound(self.feature, ends[1])
        if not both:
            return np.concatenate([2 * to, 2 * to])
        frm = np.zeros(self.n, np.int64)
        frm[self.known] = lower_bound(ends[0], self.feature)
        if self.alone and len(self.known) < self.n:  # a search from both ends relies on the bounds of all nodes
            return None
        return np.concatenate([to - frm, frm - to])


def _numbers(text: str | None) -> np.ndarray | None:
    """Features as they travel: numbers with commas, which pass to Python far faster than arrays."""
    return None if text is None else np.array(text.split(","), float)


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres between rows that begin with y, x in radians."""
    y1, x1, y2, x2 = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * MEAN_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h)))


def lower_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least weight from a to b by their features, rounded down: pairs of (weight from, weight to) each landmark, NaN where there is no way,
    or three numbers (y, x in radians, weight a metre) for the great circle."""
    a, b = np.broadcast_arrays(np.atleast_2d(a), np.atleast_2d(b))
    if a.shape[1] == 3:
        return np.floor(great_circle(a, b) * np.minimum(a[:, 2], b[:, 2])).astype(np.int64)
    frm, to = slice(0, None, 2), slice(1, None, 2)
    best = np.maximum(np.nan_to_num(b[:, frm] - a[:, frm], nan=0.0), np.nan_to_num(a[:, to] - b[:, to], nan=0.0))
    return np.maximum(0, best.max(axis=1)).astype(np.int64)


def _walk(g: _Field, dist: np.ndarray, hops: np.ndarray, open_: np.ndarray, limit: int | None, rounds: int | None, bound: int, goals: list[int], pot: np.ndarray | None, both: bool) -> tuple[list[np.ndarray], int]:
    """Relax node labels until none is open or the rest cannot matter: (touched slots, bound)."""
    touched, n = [open_], g.n
    targets = np.array(goals, np.int64)
    step = 0

    def better(now: int) -> int:
        if both or not len(targets):
            return now
        return min(now, int(dist[targets].max()))

    bound = better(bound)
    while len(open_):
        key = 2 * dist[open_] if pot is None else 2 * dist[open_] + pot[open_]
        low = int(key.min())
        if both:
            ends = [int(key[open_ < n].min(initial=INF)), int(key[open_ >= n].min(initial=INF))]
            if g.alone and (sum(ends) >= 2 * bound or max(ends) >= INF):
                break
        elif low >= 2 * bound:
            break
        if rounds is None:
            pick = key <= low + 2 * g.width
            now, later = open_[pick], open_[~pick]
        elif step == rounds:
            break
        else:
            now, later = open_, open_[:0]
        step += 1
        ids, of = _gather(g.start, g.count, now)
        to, w, h = g.to[ids], dist[now][of] + g.w[ids], hops[now][of] + 1
        ok = w < dist[to]
        if rounds is None:
            ok |= (w == dist[to]) & (h < hops[to])
        if limit is not None:
            ok &= w <= limit
        if bound < INF:
            ok &= (w < bound) if both else (2 * w + (0 if pot is None else pot[to]) <= 2 * bound)
        to, w, h = _least(to[ok], w[ok], h[ok])
        dist[to], hops[to] = w, h
        touched.append(to)
        if both and len(to):
            bound = min(bound, int((dist[to] + dist[np.where(to < n, to + n, to - n)]).min()))
        bound = better(bound)
        open_ = np.unique(np.concatenate([later, to[g.here[to]]]))
    return touched, bound


def _walk_turns(g: _Field, dist: np.ndarray, hops: np.ndarray, open_: np.ndarray, limit: int | None) -> list[np.ndarray]:
    """The same for arrivals over edges.

    An arc is relaxed without a cost by the best arrival that may take it so;
    later arrivals of its node are read only while some arc is left over, so a
    hub does not pair all it is entered and left by.
    """
    touched = [open_]
    paid = np.full(len(g.to), INF)  # least arrival that took the arc without a cost
    most = np.full(g.n, INF)  # the greatest of these at each node
    most[g.count[: g.n] == 0] = -1
    while len(open_):
        d = dist[open_]
        pick = d <= int(d.min()) + g.width
        now, later = open_[pick], open_[~pick]
        node = g.slot_node[now]
        order = np.lexsort((dist[now], node))
        now, node = now[order], node[order]
        lead = np.ones(len(now), bool)
        lead[1:] = node[1:] != node[:-1]
        at, of = _gather(g.turn_start, g.turn_count, now)
        slots, ws, hs = [g.to[g.turn_arc[at]]], [dist[now][of] + g.w[g.turn_arc[at]] + g.turn_cost[at]], [hops[now][of] + 1]
        use = now[lead]
        use = use[dist[use] < most[g.slot_node[use]]]
        if len(use):
            v = g.slot_node[use]
            ids, of = _gather(g.start, g.count, v)
            key = use[of] * len(g.to) + ids
            hit = np.searchsorted(g.listed, key)
            barred = (g.edge[ids] == g.slot_a[use][of]) | ((hit < len(g.listed)) & (g.listed[np.minimum(hit, len(g.listed) - 1)] == key) if len(g.listed) else False)
            aw = dist[use][of]
            go = ~barred & (aw < paid[ids])
            paid[ids[go]] = aw[go]
            firsts = np.cumsum(g.count[v]) - g.count[v]
            most[v] = np.maximum.reduceat(paid[ids], firsts)
            slots.append(g.to[ids[go]])
            ws.append(aw[go] + g.w[ids[go]])
            hs.append(hops[use][of][go] + 1)
        rest = now[~lead]
        rest = rest[dist[rest] < most[g.slot_node[rest]]]
        to, w, h = np.concatenate(slots), np.concatenate(ws), np.concatenate(hs)
        ok = (w < dist[to]) | ((w == dist[to]) & (h < hops[to]))
        if limit is not None:
            ok &= w <= limit
        to, w, h = _least(to[ok], w[ok], h[ok])
        dist[to], hops[to] = w, h
        touched.append(to)
        open_ = np.unique(np.concatenate([later, rest, to[g.here[to]]]))
    return touched


def _group(key: tuple, left: pa.Table, right: pa.Table, turns: bool, both: bool, alone: bool, limit: int | None, rounds: int | None) -> pa.Table:
    """One fragment and one block of sources: changed labels, labels for elsewhere and bounds."""
    frag, block = (int(k.as_py()) for k in key)
    names = [x.split()[0] for x in _STATE.split(", ")]
    if not left.num_rows:
        return pa.table({c: pa.array([], pa.int32() if t == "int" else pa.int64()) for c, t in (x.split() for x in _STATE.split(", "))})
    left = left.combine_chunks()
    g = _Field(right.combine_chunks(), left, frag, turns, alone)
    kind, source, w, hops_in = (left.column(c).to_numpy() for c in ("kind", "source", "w", "hops"))
    place = np.full(left.num_rows, -1)
    place[kind != BOUND] = g.left_slot
    order = np.argsort(source, kind="stable")
    cuts = np.flatnonzero(np.diff(source[order])) + 1
    dist, hops = np.full(g.size, INF), np.zeros(g.size, np.int64)
    out: list[tuple] = []
    for rows in np.split(order, cuts):
        s = int(source[rows[0]])
        k, at, ww, hh = kind[rows], place[rows], w[rows], hops_in[rows]
        bound = int(ww[k == BOUND].min(initial=INF))
        settled, new = k == LABEL, k == MESSAGE
        a, b, c = _least(at[settled], ww[settled], hh[settled])
        dist[a], hops[a] = b, c
        a2, b2, c2 = _least(at[new], ww[new], hh[new])
        ok = (b2 < dist[a2]) | ((b2 == dist[a2]) & (c2 < hops[a2]))
        a2, b2, c2 = a2[ok], b2[ok], c2[ok]
        dist[a2], hops[a2] = b2, c2
        if turns:
            touched = _walk_turns(g, dist, hops, a2, limit)
        else:
            pot = g.potentials(s, both)
            goals = g.goals.get(s, []) + g.shared
            if both and len(a2):
                bound = min(bound, int((dist[a2] + dist[np.where(a2 < g.n, a2 + g.n, a2 - g.n)]).min()))
            touched, bound = _walk(g, dist, hops, a2, limit, rounds, bound, goals, pot, both)
        new = np.unique(np.concatenate(touched))
        if bound < INF and not both and not turns:  # what is beyond the last goal is not final
            new = new[(2 * dist[new] if pot is None else 2 * dist[new] + pot[new]) <= 2 * bound]
        home = g.here[new]
        news = ((new[home], LABEL), (new[~home], MESSAGE))
        if g.hub.any():  # what was found of a hub here is for all fragments that have arcs of it
            was, was_hops = np.full(len(new), INF), np.full(len(new), INF)
            at2 = np.searchsorted(new, a2)
            hit = (at2 < len(new)) & (new[np.minimum(at2, len(new) - 1)] == a2) if len(new) else np.zeros(len(a2), bool)
            was[at2[hit]], was_hops[at2[hit]] = b2[hit], c2[hit]
            news = (*news, (new[home & g.hub[new] & ((dist[new] < was) | (hops[new] < was_hops))], MESSAGE))
        if rounds is not None and not alone:  # one edge a round: what was found now is read in the next one
            home = np.isin(new, a2)
            news = ((new[home], LABEL), (new[~home], MESSAGE))
        for part, tag in news:
            if len(part):
                out.append((np.full(len(part), tag), np.full(len(part), s), g.slot_a[part], g.nodes[g.slot_node[part]], dist[part], hops[part]))
        if bound < INF and (both or goals if not turns else False):
            out.append(tuple(np.array([x]) for x in (BOUND, s, 0, 0, bound, 0)))
        every = np.unique(np.concatenate([a, *touched]))
        dist[every] = INF
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
    n = len(cols[0])
    arrays = [pa.array(np.full(n, frag), pa.int32()), pa.array(np.full(n, block), pa.int32()), pa.array(cols[0], pa.int32()), *[pa.array(c.astype(np.int64)) for c in cols[1:5]], pa.array(cols[5], pa.int32())]
    return pa.table(arrays, names=names)


# --------------------------------------------------------------------------- across fragments


def search(
    arcs: DataFrame,
    seeds: DataFrame,
    turns: DataFrame | None = None,
    goals: DataFrame | None = None,
    shared: DataFrame | None = None,
    features: DataFrame | None = None,
    both: bool = False,
    limit: int | None = None,
    rounds: int | None = None,
    fragment_arcs: int = FRAGMENT_ARCS,
    by_turns: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Labels (source, a, node, w, hops), and bounds (source, w) of searches with goals.

    arcs(a, base, adj, w): ``a`` is the direction searched, 0 or 1 (``both``),
    or the edge (``by_turns``).  seeds(source, a, node, w, hops).
    turns(from_edge, to_edge, cost) lists the turns that are barred (-1) or
    cost something.  goals(source, target): a search ends when the rest cannot
    shorten the way to any of its goals; shared(target) are goals of every
    source.  features(node, f) give lower bounds,
    see ``lower_bound``.  Weights must not be negative.
    """
    spark = arcs.sparkSession
    aimed = goals is not None or shared is not None  # one of the two
    ship(spark)
    clean = arcs.filter("base is not null and adj is not null and w is not null").select(F.col("a").cast("bigint").alias("a"), *[F.col(c).cast("bigint").alias(c) for c in ("base", "adj", "w")]).persist(StorageLevel.MEMORY_AND_DISK)
    seeds = seeds.select(*[F.col(c).cast("bigint").alias(c) for c in ("source", "a", "node", "w")], F.col("hops").cast("int").alias("hops"))
    n_arcs, n_sources = clean.count(), max(1, seeds.select("source").distinct().count())
    p = max(1, math.ceil(n_arcs / fragment_arcs))
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, min(n_sources, max(math.ceil(n_sources * min(n_arcs, fragment_arcs) / 4 / BLOCK_LABELS), cores // p)))
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(p)).cast("int") if p > 1 else F.lit(0)
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int") if blocks > 1 else F.lit(0)
    laid = clean.withColumn("frag", home("base"))
    hot = None
    if p > 1:
        most = max(1, fragment_arcs // 2)
        hot = cut(clean.groupBy("base").count().filter(F.col("count") > most).select(F.col("base").alias("hub"), F.least(F.lit(p), F.ceil(F.col("count") / most)).cast("int").alias("copies")))
        if hot.head(1):
            # a hub's arcs are dealt to several fragments, and its labels sent to all of these
            laid = laid.join(F.broadcast(hot) if hot.count() <= 10_000 else hot, F.col("base") == F.col("hub"), "left")
            laid = laid.withColumn("frag", F.when(F.col("hub").isNull(), F.col("frag")).otherwise(F.pmod(F.col("frag") + F.pmod(F.xxhash64("a", "adj", "w"), F.col("copies")), F.lit(p)).cast("int"))).drop("hub", "copies")
        else:
            hot = None
    where = home("adj")
    if hot is not None:  # below zero: a hub
        laid = laid.join(hot.select("hub"), F.col("adj") == F.col("hub"), "left")
        where = F.when(F.col("hub").isNull(), where).otherwise(-1)

    def deliver(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("frag", home("node"))
        if hot is None:
            return rows
        rows = rows.join(hot, F.col("node") == F.col("hub"), "left")
        return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies") - 1, F.lit(0))))).withColumn("frag", F.pmod(F.col("frag") + F.col("k"), F.lit(p)).cast("int")).drop("hub", "copies", "k")

    none, no_f = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    field = laid.select("frag", F.lit(ARC).alias("kind"), "a", "base", "adj", "w", where.alias("home"), no_f.alias("f"), no_f.alias("g"))
    if turns is not None:
        at = turns.withColumn("frag", F.lit(0)) if p == 1 else turns.join(laid.select(F.col("a").alias("to_edge"), "frag").distinct(), "to_edge")
        field = field.unionByName(at.select("frag", F.lit(TURN).alias("kind"), F.col("from_edge").alias("a"), F.col("to_edge").alias("base"), none.alias("adj"), F.col("cost").alias("w"), F.lit(0).alias("home"), no_f.alias("f"), no_f.alias("g")))
    if features is not None:
        f = features.select(F.col("node").cast("bigint").alias("node"), F.array_join(F.col("f").cast("array<string>"), ",").alias("f"))
        field = field.unionByName(deliver(f).select("frag", F.lit(FEATURE).alias("kind"), none.alias("a"), F.col("node").alias("base"), none.alias("adj"), none.alias("w"), F.lit(0).alias("home"), "f", no_f.alias("g")))
    field = field.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else field.withColumn("block", F.lit(0))
    if goals is not None:
        goals = goals.select(F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target")).filter("source is not null and target is not null").distinct()
        g = goals.withColumns({"f": no_f, "g": no_f})
        if features is not None:
            start = seeds.filter("a = 0").select("source", F.col("node").alias("__s")).join(f.select(F.col("node").alias("__s"), F.col("f").alias("sf")), "__s", "left").select("source", "sf")
            g = goals.join(start, "source", "left").join(f.select(F.col("node").alias("target"), F.col("f").alias("tf")), "target", "left").select("source", "target", F.col("sf").alias("f"), F.col("tf").alias("g"))
        g = g.withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))) if p > 1 else g.withColumn("frag", F.lit(0))
        field = field.unionByName(g.select("frag", F.lit(GOAL).alias("kind"), none.alias("a"), F.col("source").alias("base"), F.col("target").alias("adj"), none.alias("w"), F.lit(0).alias("home"), "f", "g", block.alias("block")))
    if shared is not None:
        shared = shared.select(F.col("target").cast("bigint").alias("target")).filter("target is not null").distinct()
        every = shared.withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        field = field.unionByName(every.select("frag", F.lit(SHARED).alias("kind"), none.alias("a"), F.lit(0).cast("bigint").alias("base"), F.col("target").alias("adj"), none.alias("w"), F.lit(0).alias("home"), no_f.alias("f"), no_f.alias("g"), "block"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * p * blocks, 20_000))
    spread = (lambda rows: rows.repartition(parts, "frag", "block")) if p * blocks > 1 else lambda rows: rows
    field = spread(field.select(*(_FIELD if features is not None else _FIELD[:-2])))
    if p > 1:
        field = field.persist(StorageLevel.MEMORY_AND_DISK)
    run = partial(_group, turns=by_turns, both=both, alone=p == 1, limit=limit, rounds=rounds if p == 1 else None if rounds is None else 1)

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key, left, right)

    def round_(state: DataFrame) -> DataFrame:
        state = spread(state.select(*[x.split()[0] for x in _STATE.split(", ")]))
        return cut(state.groupBy("frag", "block").cogroup(field.groupBy("frag", "block")).applyInArrow(one, _STATE))

    mail = deliver(seeds.filter("source is not null and node is not null").groupBy("source", "a", "node").agg(F.min(F.struct("w", "hops")).alias("m")).select("source", "a", "node", "m.w", "m.hops")).select("frag", block.alias("block"), F.lit(MESSAGE).alias("kind"), "source", "a", "node", "w", "hops")
    if p == 1:
        got = round_(mail)
        clean.unpersist()
        labels = got.filter(F.col("kind") == LABEL).select("source", "a", "node", "w", "hops")
        return labels, got.filter(F.col("kind") == BOUND).select("source", "w") if aimed else None
    key = ["source", "a", "node"]
    least = lambda rows, *more: rows.groupBy(*more, *key).agg(F.min(F.struct("w", "hops")).alias("m")).select(*more, *key, "m.w", "m.hops")
    deltas: list[DataFrame] = []
    bounds: DataFrame | None = None
    step = 0
    while mail.head(1) and (rounds is None or step < rounds):
        if step > MAX_ROUNDS:
            raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
        state = mail
        active = mail.select("frag", "block").distinct()
        for d in deltas:
            state = state.unionByName(d.join(F.broadcast(active), ["frag", "block"], "left_semi"))  # at most fragments times blocks rows
        if bounds is not None:
            state = state.unionByName(bounds.withColumn("block", block).join(F.broadcast(active), "block").select("frag", "block", F.lit(BOUND).alias("kind"), "source", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("node"), "w", F.lit(0).alias("hops")))
        new = round_(state)
        deltas.append(new.filter(F.col("kind") == LABEL))
        if len(deltas) > COMPACT:
            rows = deltas[0]
            for d in deltas[1:]:
                rows = rows.unionByName(d)
            deltas = [cut(least(rows, "frag", "block").withColumn("kind", F.lit(LABEL)).select(*[x.split()[0] for x in _STATE.split(", ")]))]
        if aimed:
            if both:
                now = new.filter(F.col("kind") == BOUND).select("source", "w")
            else:
                every = deltas[0]
                for d in deltas[1:]:
                    every = every.unionByName(d)
                at = every.groupBy("source", F.col("node").alias("target")).agg(F.min("w").alias("w"))
                if shared is not None:
                    of = shared.agg(F.count(F.lit(1)).alias("n")).scalar()
                    now = at.join(shared, "target").groupBy("source").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == of).select("source", "w")
                else:
                    now = goals.join(at, ["source", "target"], "left").groupBy("source").agg(F.max("w").alias("w"), F.count("w").alias("n"), F.count(F.lit(1)).alias("of")).filter("n = of").select("source", "w")
            bounds = cut((now if bounds is None else bounds.unionByName(now)).groupBy("source").agg(F.min("w").alias("w")))
        out = least(new.filter(F.col("kind") == MESSAGE))
        if bounds is not None:
            out = out.join(bounds.withColumnRenamed("w", "bw"), "source", "left").filter(F.col("bw").isNull() | (F.col("w") < F.col("bw") if both else F.col("w") <= F.col("bw"))).drop("bw")
        mail = cut(deliver(out).select("frag", block.alias("block"), F.lit(MESSAGE).alias("kind"), *key, "w", "hops"))
        step += 1
    labels = mail.select(*key, "w", "hops")  # labels a bounded search has found with its last edge
    for d in deltas:
        labels = labels.unionByName(d.select(*key, "w", "hops"))
    labels = cut(least(labels))
    field.unpersist()
    clean.unpersist()
    if not aimed:
        return labels, None
    bounds = bounds if bounds is not None else labels.select("source", "w").limit(0)
    if not both:
        labels = labels.join(bounds.withColumnRenamed("w", "bw"), "source", "left").filter("bw is null or w <= bw").drop("bw")
    return labels, bounds
