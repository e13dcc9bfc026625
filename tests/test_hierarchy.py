import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymesh.operators import hierarchy as h

LINKS = "group_id bigint, label_id bigint, parent_id bigint"


def brute(rows):
    """Plain walk up from every label."""
    up = {}
    for g, x, p in rows:
        if g is None or x is None:
            continue
        old = up.get((g, x), "none")
        up[g, x] = p if old in ("none", None) else old if p is None else min(p, old)
    out = {}
    for g, x in up:
        seen, at = [], x
        while at is not None and (g, at) in up and at not in seen:
            seen.append(at)
            at = up[g, at]
        if at in seen and at is not None:
            ring = seen[seen.index(at) :]
            out[g, x] = (None, min(ring), seen.index(at), tuple(reversed(seen[: seen.index(at) + 1])))
        else:
            out[g, x] = (seen[-1], None, len(seen) - 1, tuple(reversed(seen)))
    return out


def graph(n, seed, groups=3):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        ids = r.sample(range(10 * n), n)
        for x in ids:
            rows.append((g, x, r.choice([None, -1, *r.choices(ids, k=6)])))
    for g in range(groups):
        rows += [(g, 10**6 + i, 10**6 + i + 1) for i in range(40)] + [(g, 10**6 + 40, -5)]
    return rows


@pytest.mark.parametrize("bound", [10**6, 50])
def test_equals_plain_walk(spark, bound):
    rows = graph(120, 5) + [(7, 1, 1), (7, 2, 1), (7, 3, None), (8, 4, 9), (None, 1, 2), (8, None, 4)]
    rows += rows[:30]
    want = brute(rows)
    got = h.hierarchy(spark.createDataFrame(rows, LINKS).withColumn("depth", F.lit("clash")), True, bound).collect()
    assert len(got) == len(want)
    tree = {}
    for r in got:
        assert (r["root_id"], r["cycle_id"], r["depth"], tuple(r["path"])) == want[r["group_id"], r["label_id"]]
        tree[r["group_id"], r["label_id"]] = r
    for (g, x), r in tree.items():
        below = [y for (k, y), s in tree.items() if k == g and s["path"][0] == r["path"][0] and r["entry"] < s["entry"] and s["exit"] < r["exit"]]
        assert r["descendants"] == len(below)
        assert set(below) == {y for (k, y), s in tree.items() if k == g and y != x and x in s["path"]}


def test_descendants_of(spark):
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 1, 2), (2, 2, 1), (2, 3, 1)]
    t = h.hierarchy(spark.createDataFrame(rows, LINKS))
    got = h.descendants_of(t, spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "group_id bigint, label_id bigint"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 2), (1, 1, 3), (1, 1, 4), (1, 2, 3), (2, 1, 3)}
    got = h.ancestors_of(t, spark.createDataFrame([(1, 3), (2, 3), (2, 2)], "group_id bigint, label_id bigint"))
    assert {tuple(r) for r in got.collect()} == {(1, 3, 1, 0), (1, 3, 2, 1), (1, 3, 3, 2), (2, 3, 1, 0), (2, 3, 3, 1), (2, 2, 2, 0)}


def test_shapes_beyond_the_bound(spark):
    n = 150
    rows = [(1, i, i - 1) for i in range(n)] + [(2, i, 0 if i else None) for i in range(n)] + [(3, i, None) for i in range(n)]
    rows += [(4, i, i) for i in range(n)] + [(5, i, (i + 1) % n) for i in range(n)] + [(5, n + i, i) for i in range(n)]
    df = spark.createDataFrame(rows, LINKS)
    near, far = ({tuple(map(str, r)) for r in h.hierarchy(df, True, bound).collect()} for bound in (10**6, 100))
    assert near == far and len(near) == len(rows)


def test_empty_and_deep_chain(spark):
    assert h.hierarchy(spark.createDataFrame([], LINKS)).count() == 0
    chain = spark.range(20_000).select(F.lit(1).cast("bigint").alias("group_id"), F.col("id").alias("label_id"), (F.col("id") - 1).alias("parent_id"))
    top = h.hierarchy(chain, paths=False).agg(F.max("depth").alias("d"), F.max("descendants").alias("n")).head()
    assert (top["d"], top["n"]) == (19_999, 19_999)


def test_paths_of_deep_chain_come_in_bounded_batches():
    n = 20_000
    ids = np.arange(n, dtype=np.int64)
    chain = pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int64)), pa.array(ids), pa.array(ids - 1)], names=["group_id", "label_id", "parent_id"])
    rows = 0
    for b in h._local(True)(iter([chain])):
        paths = b.column(10)
        assert len(paths.flatten()) <= 4_000_000
        for k in (0, len(paths) - 1):
            assert np.array_equal(paths[k].values.to_numpy(), np.arange(b.column(1)[k].as_py() + 1))
        rows += len(b)
    assert rows == n


def test_labels_of_both_modes(spark):
    rows = [(1, "node_based", 5, 50, None, 7, "2024-01-02"), (1, "node_based", 6, 51, 5, 7, "2024-01-01"), (1, "node_based", 6, 51, 6, 7, "2024-01-03"), (2, "edge_based", 5, 50, 5, 51, "2024-01-01"), (2, "edge_based", 5, 51, 5, 50, "2024-01-01"), (3, None, 1, 1, 1, 1, None), (4, "node_based", None, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "tree_id bigint, traversal_mode string, node_id int, edge_id int, prev_node_id int, prev_edge_id int, received_at string")
    got = {tuple(r) for r in h.tree_links(df).collect()}
    assert got == {(1, 5, None), (1, 6, 5), (2, 50, 51), (2, 51, 50)}
