import json

from pyspark.sql import functions as F

from waymesh.operators import nesting as n


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "response_id bigint, body string")


def test_tables_and_keys(spark):
    df = frame(spark, {"a": {"b": 1, "c": {"d": "x"}}, "items": [{"k": 1, "subs": [{"v": True}, {"v": None}]}, {"k": "2", "subs": []}]}, None, "{broken", "[]", {"items": None})
    plan = n.plan(n.analyse(df, "body"))
    assert set(plan) == {"$", "items[]", "subs[]"}
    root = n.shred(df, "body", plan["$"], ["response_id"]).filter("response_id = 0").head()
    assert (root["a_b"], root["a_c_d"], root["parent_id"]) == (1, "x", None)
    items = {r["row_id"]: r for r in n.shred(df, "body", plan["items[]"], ["response_id"]).collect()}
    assert {k: v["k"] for k, v in items.items()} == {"$.items[0]": "1", "$.items[1]": "2"}
    subs = n.shred(df, "body", plan["subs[]"], ["response_id"]).collect()
    assert [(r["parent_table"], r["parent_id"], r["pos"], r["v"]) for r in subs] == [("items[]", "$.items[0]", [0, 0], True), ("items[]", "$.items[0]", [0, 1], None)]
    assert all(r["parent_id"] in items for r in subs)


def test_shared_and_recursive_elements(spark):
    df = frame(spark, {"solution": {"info": {"took": 1.5}}, "info": {"took": 2}, "tree": {"x": 1, "tree": {"x": 2, "tree": {"x": 3}}}})
    plan = n.plan(n.analyse(df, "body"))
    assert len(plan["info"].sources) == 2
    assert {r["took"] for r in n.shred(df, "body", plan["info"], ["response_id"]).collect()} == {1.5, 2.0}
    assert sorted(r["x"] for r in n.shred(df, "body", plan["tree"], ["response_id"]).collect()) == [1, 2, 3]


def test_mixed_kinds_and_fixed_lists(spark):
    df = frame(spark, {"p": "text", "iv": [1, 2]}, {"p": {"type": "L"}, "iv": [3, 4]}, {"p": [[1.0, 2.0]], "iv": None})
    plan = n.plan(n.analyse(df, "body"))
    rows = sorted(n.shred(df, "body", plan["$"], ["response_id"]).collect(), key=lambda r: r["response_id"])
    assert [(r["iv_0"], r["iv_1"]) for r in rows] == [(1, 2), (3, 4), (None, None)]
    assert rows[0]["p"] == "text" and rows[1]["p_type"] == "L"


def test_names_that_clash(spark):
    df = frame(spark, {"pos": 1, "response_id": 7, "a": {"b": 1}, "a_b": 2, "A_B": 3})
    got = n.shred(df, "body", n.plan(n.analyse(df, "body"))["$"], ["response_id"]).head().asDict()
    assert got["v_pos"] == 1 and got["v_response_id"] == 7 and got["response_id"] == 0
    assert sorted(v for k, v in got.items() if k.lower().startswith("a_b")) == [1, 2, 3]


def test_items(spark):
    routes = frame(spark, {"paths": [{"instructions": [{"text": None, "interval": [0, 2]}, {"text": "go", "interval": None}]}, {"instructions": []}]}, {"message": "x"})
    matrices = frame(spark, {"solution": {"distances": [[0, None], [5, 0]], "hints": [{"message": "m", "point_pairs": [[0, 1], [1, 0]]}, {"message": "n", "point_pairs": None}]}, "distances": [[9]]}, {"distances": [[7]], "hints": [{"point_pairs": [[2, 3]]}]}, {"solution": None, "distances": [[8]]})
    matrices = matrices.unionAll(matrices)
    got = {tuple(r) for r in n.nested_items(routes, matrices).collect()}
    assert got == {
        ("instructions", 0, 0, 0, 0, 2, ""), ("instructions", 0, 0, 1, -1, -1, "go"),
        ("point_pairs", 0, 0, 0, 0, 1, "m"), ("point_pairs", 0, 0, 1, 1, 0, "m"), ("point_pairs", 1, 0, 0, 2, 3, ""),
        ("distances", 0, 0, 0, 0, -1, ""), ("distances", 0, 1, 0, 5, -1, ""), ("distances", 0, 1, 1, 0, -1, ""), ("distances", 1, 0, 0, 7, -1, ""), ("distances", 2, 0, 0, 8, -1, ""),
    }


def test_empty_tables(spark):
    e = frame(spark, None).filter(F.lit(False))
    assert n.nested_items(e, e).count() == 0
