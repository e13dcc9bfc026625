"""Map matching: candidates of each observation, transition costs and the best sequence.

Costs are negative log densities: a normal one of the distance to the road and
an exponential one of the difference between route and beeline.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.session import cut, ship

#: Standard deviation of positions in metres, and mean of the route difference in metres.
SIGMA, BETA = 10.0, 2.0


def emission(distance: Column, sigma: float = SIGMA) -> Column:
    """-log of the normal density of a distance."""
    return F.lit(math.log(math.sqrt(2 * math.pi) * sigma)) + distance * distance / (2 * sigma * sigma)


def transition(route: Column, beeline: Column, beta: float = BETA) -> Column:
    """-log of the exponential density of |route - beeline|."""
    return F.lit(math.log(beta)) + F.abs(route - beeline) / beta


#: Steps of one piece of a trace.
PIECE = 2_048
_WAYS = "trace bigint, piece int, entry bigint, last int, exit bigint, cost double"
_MARKS = "trace bigint, piece int, entry bigint, last int, exit bigint, base double"
_OUT = "trace bigint, step int, candidate bigint, cost double"


def _frame(rows: list[tuple], schema: str):  # noqa: ANN202
    import pandas as pd

    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    kinds = {n: {"bigint": "int64", "int": "int32", "double": "float64"}[k] for n, k in zip(names, kinds)}
    return pd.DataFrame(rows, columns=list(names)).astype(kinds)


def _layers(steps: np.ndarray, names: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """Candidates by step and name, the cheapest of equal ones, and where each step lies."""
    order = np.lexsort((costs, names, steps))
    steps, names, costs = steps[order], names[order], costs[order]
    one = np.ones(len(steps), bool)
    one[1:] = (steps[1:] != steps[:-1]) | (names[1:] != names[:-1])
    steps, names, costs = steps[one], names[one], costs[one]
    values, first = np.unique(steps, return_index=True)
    ends = [*first[1:].tolist(), len(steps)]
    return steps, names, costs, {int(v): (int(f), int(e)) for v, f, e in zip(values, first, ends)}


def _piece(left, right, begin: int, entry: list[int] | None, base: list[float] | None):  # noqa: ANN001, ANN202
    """Least costs through a piece from each of its entries: names and costs of every layer (entries x candidates) and what came before."""
    _, names, costs, at = _layers(left["step"].to_numpy(), left["candidate"].to_numpy(), left["cost"].to_numpy())
    move_step, move_a, move_b, move_w = (right[c].to_numpy() for c in ("step", "a", "b", "cost"))
    order = np.argsort(move_step, kind="stable")
    move_step, move_a, move_b, move_w = move_step[order], move_a[order], move_b[order], move_w[order]
    step, layers = begin, []
    if begin == 0:
        lo, hi = at.get(0, (0, 0))
        if lo == hi:
            return []
        own, total, prev = names[lo:hi], costs[lo:hi][None, :], np.full((1, hi - lo), -1)
        layers.append((0, own, total, prev))
        step = 1
    else:
        lo, hi = np.searchsorted(move_step, [begin, begin + 1])
        own = np.unique(move_a[lo:hi]) if entry is None else np.array(entry)
        total = np.where(np.eye(len(own), dtype=bool), 0.0, np.inf) if base is None else np.where(np.eye(len(own), dtype=bool), np.array(base)[:, None], np.inf)
        layers.append((begin - 1, own, total, None))
    while step in at and len(own):
        lo, hi = at[step]
        new, emit = names[lo:hi], costs[lo:hi]
        x, y = np.searchsorted(move_step, [step, step + 1])
        a, b, w = move_a[x:y], move_b[x:y], move_w[x:y]
        i, j = np.searchsorted(own, a), np.searchsorted(new, b)
        ok = (i < len(own)) & (j < len(new))
        ok[ok] = (own[i[ok]] == a[ok]) & (new[j[ok]] == b[ok])
        way = np.full((len(own), len(new)), np.inf)
        np.minimum.at(way, (i[ok], j[ok]), w[ok])
        through = total[:, :, None] + way[None, :, :]
        prev = through.argmin(axis=1)  # the smallest of equal ones
        nxt = np.take_along_axis(through, prev[:, None, :], 1)[:, 0, :] + emit[None, :]
        keep = np.isfinite(nxt).any(axis=0)
        if not keep.any():
            break
        own, total, prev = new[keep], nxt[:, keep], prev[:, keep]
        layers.append((step, own, total, prev))
        step += 1
    return layers


def viterbi(candidates: DataFrame, transitions: DataFrame, piece: int = PIECE) -> DataFrame:
    """(trace, step, candidate, cost): the cheapest sequence of each trace, its cost up to each step.

    candidates(trace bigint, step, candidate bigint, cost), steps from 0;
    transitions(trace, step, a, b, cost) lead from candidate a at step - 1 to b
    at step.  A trace ends where no candidate can be reached.  Ties go to the
    smaller candidate, within a piece and where pieces meet.

    Traces are cut into pieces of ``piece`` steps.  A piece is reduced to the
    least costs from its entries to its exits; these small tables are joined
    along each trace, and then every piece is walked back by itself.  A task
    holds one piece, however long the trace.
    """
    c = candidates.select(F.col("trace").cast("bigint").alias("trace"), F.col("step").cast("int").alias("step"), F.col("candidate").cast("bigint").alias("candidate"), F.col("cost").cast("double").alias("cost")).filter("trace is not null and step is not null and candidate is not null and cost is not null")
    t = transitions.select(F.col("trace").cast("bigint").alias("trace"), F.col("step").cast("int").alias("step"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("cost").cast("double").alias("cost")).filter("cost is not null")
    c, t = (x.withColumn("piece", F.floor(F.col("step") / piece).cast("int")) for x in (c, t))
    ship(c.sparkSession)
    c = cut(c)
    if not c.filter("piece > 0").head(1):  # all traces are of one piece: nothing to join
        return c.groupBy("trace").cogroup(t.groupBy("trace")).applyInPandas(_one_piece, _OUT)
    t = cut(t)
    ways = cut(c.groupBy("trace", "piece").cogroup(t.groupBy("trace", "piece")).applyInPandas(partial(_ways, piece=piece), _WAYS))
    marks = cut(ways.groupBy("trace").applyInPandas(partial(_chain, piece=piece), _MARKS))
    chosen = c.join(marks.withColumnRenamed("exit", "out"), ["trace", "piece"])
    return chosen.groupBy("trace", "piece").cogroup(t.groupBy("trace", "piece")).applyInPandas(partial(_walk_back, piece=piece), _OUT)


def _ways(key, left, right, piece: int):  # noqa: ANN001, ANN202
    """From each entry to each exit of the furthest layer that it reaches: (entry, last step, exit, cost)."""
    begin = int(key[1]) * piece
    rows = []
    layers = _piece(left, right, begin, None, None)
    if layers and not (begin and len(layers) == 1):
        entries = [-1] if begin == 0 else layers[0][1].tolist()
        full = layers[-1][0]
        for e, name in enumerate(entries):
            for step, own, total, _ in reversed(layers):
                hit = np.flatnonzero(np.isfinite(total[e]))
                if step < begin:
                    break
                if len(hit):
                    rows += [(key[0], key[1], name, step, int(own[k]), float(total[e][k])) for k in (hit if step == full else hit[np.lexsort((own[hit], total[e][hit]))[:1]])]
                    break
    return _frame(rows, _WAYS)


def _chain(ways, piece: int):  # noqa: ANN001, ANN202
    """The best exits of all pieces of a trace, from their tables: (piece, entry, last step, exit, cost before the piece)."""
    rows, trace = [], ways["trace"].iloc[0]
    now: dict[int, float] = {-1: 0.0}
    came: list[dict[int, tuple[int, int, float]]] = []
    parts = dict(tuple(ways.groupby("piece")))
    k = 0
    while k in parts:
        got: dict[int, tuple] = {}
        p = parts[k]
        best_last = -1
        found = []
        for e, last, x, cost in zip(p["entry"].tolist(), p["last"].tolist(), p["exit"].tolist(), p["cost"].tolist()):
            if e in now:
                found.append((last, now[e] + cost, e, x))
                best_last = max(best_last, last)
        for last, cost, e, x in found:
            if last == best_last and (x not in got or (cost, e) < got[x][:2]):
                got[x] = (cost, e, last)
        if not got:
            break
        came.append({x: (e, last, now[e]) for x, (_, e, last) in got.items()})
        now = {x: v[0] for x, v in got.items()}
        k += 1
        if best_last < k * piece - 1:  # it ends within the piece
            break
    if came:
        x = min(now, key=lambda c: (now[c], c))
        for n in range(len(came) - 1, -1, -1):
            e, last, base = came[n][x]
            rows.append((trace, n, e, last, x, base))
            x = e
    return _frame(rows, _MARKS)


def _walk_back(key, left, right, piece: int):  # noqa: ANN001, ANN202
    """The sequence of one piece between its chosen entry and exit."""
    if not len(left):
        return _frame([], _OUT)
    begin = int(key[1]) * piece
    entry, last, out, base = int(left["entry"].iloc[0]), int(left["last"].iloc[0]), int(left["out"].iloc[0]), float(left["base"].iloc[0])
    layers = _piece(left, right, begin, [entry], [base])
    at = [k for k, x in enumerate(layers) if x[0] == last][0]
    return _frame([(key[0], *r) for r in _back(layers, at, int(np.searchsorted(layers[at][1], out)), begin)], _OUT)


def _back(layers: list[tuple], at: int, j: int, begin: int) -> list[tuple[int, int, float]]:
    """(step, candidate, cost) from the first step of a piece to candidate ``j`` of layer ``at``."""
    rows = []
    while at >= 0 and layers[at][0] >= begin:
        step, own, total, prev = layers[at]
        rows.append((step, int(own[j]), float(total[0][j])))
        j = int(prev[0][j])
        at -= 1
    return rows[::-1]


def _one_piece(key, left, right):  # noqa: ANN001, ANN202
    """The sequence of a trace of one piece."""
    layers = _piece(left, right, 0, None, None) if len(left) else []
    if not layers:
        return _frame([], _OUT)
    _, own, total, _ = layers[-1]
    return _frame([(key[0], *r) for r in _back(layers, len(layers) - 1, int(np.lexsort((own, total[0]))[0]), 0)], _OUT)


def rank_candidates(snaps: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest snaps of each (trace, step), ties by candidate."""
    from waymesh.operators.relational import top_k

    return top_k(snaps, ["trace", "step"], [F.asc("distance"), F.asc("candidate")], most)
