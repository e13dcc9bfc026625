"""Nested JSON records to flat tables with parent keys, by shared inlining.

``analyse`` builds the schema graph: element types (object members and array
items) and the links between them, with the kinds of their values.  ``plan``
inlines what occurs once under its parent and makes a table of every element
that repeats, that several parents share, or that is recursive.  ``shred``
reads such a table out of the bodies; parsing and unnesting stay in the JVM on
VARIANT values.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.session import map_arrow

_KINDS = {str: "string", bool: "boolean", int: "integer", float: "number", list: "array", dict: "object", type(None): "null"}


@dataclass(frozen=True)
class Stat:
    """One place of the schema graph: the kinds seen there and the least and greatest length of its arrays."""

    path: str
    kinds: frozenset[str]
    shortest: int
    longest: int


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch the distinct (path, kind) with array lengths; its size follows the schema, not the data."""
    for b in batches:
        seen: dict[tuple[str, str], list[int]] = {}

        def note(path: str, kind: str, n: int) -> None:
            at = seen.setdefault((path, kind), [n, n])
            at[0], at[1] = min(at[0], n), max(at[1], n)

        for text in b.column(0).to_pylist():
            try:
                stack = [("$", json.loads(text))] if text else []
            except (ValueError, RecursionError):
                continue
            while stack:
                path, v = stack.pop()
                if isinstance(v, dict):
                    note(path, "object", len(v))
                    stack.extend((f"{path}.{json.dumps(k)}", x) for k, x in v.items())
                elif isinstance(v, list):
                    note(path, "array", len(v))
                    if v and all(type(x) in (int, float) for x in v):
                        note(f"{path}[]", "integer" if all(type(x) is int for x in v) else "number", 0)
                    else:
                        stack.extend((f"{path}[]", x) for x in v)
                else:
                    note(path, _KINDS[type(v)], 0)
        keys = list(seen)
        cols = [[k[0] for k in keys], [k[1] for k in keys], [seen[k][0] for k in keys], [seen[k][1] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["path", "kind", "shortest", "longest"])


def analyse(df: DataFrame, body: str, most_paths: int = 20_000) -> dict[str, Stat]:
    """The schema graph of the JSON texts in column ``body``.

    Unreadable and null texts are passed over.  The graph comes to the driver,
    as a schema must; more than ``most_paths`` places (data used as member
    names) raise ValueError.
    """
    raw = map_arrow(df.select(F.col(body).cast("string").alias("body")), _profile, "path string, kind string, shortest bigint, longest bigint")
    got = raw.groupBy("path", "kind").agg(F.min("shortest").alias("s"), F.max("longest").alias("l")).limit(most_paths + 1).collect()
    if len(got) > most_paths:
        raise ValueError(f"more than {most_paths} places in the schema of {body!r}: member names seem to hold data")
    by = defaultdict(list)
    for r in got:
        by[r["path"]].append(r)
    out = {}
    for path, rs in by.items():
        arrays = [r for r in rs if r["kind"] == "array"]
        out[path] = Stat(path, frozenset(r["kind"] for r in rs) - {"null"}, min((r["s"] for r in arrays), default=0), max((r["l"] for r in arrays), default=0))
    return out


@dataclass
class Table:
    """A table to be made: ``sources`` are the places its rows come from, ``columns`` the inlined ones (relative path, name, type)."""

    name: str
    sources: list[str]
    columns: list[tuple[str, str, str]] = field(default_factory=list)
    parents: dict[str, str] = field(default_factory=dict)  # of each source, the place of the table row above it


def _steps(path: str) -> list[str]:
    """'$."a"[]."b"' -> ['a', '[]', 'b']"""
    out, rest = [], path[1:]
    while rest:
        if rest.startswith("[]"):
            out.append("[]")
            rest = rest[2:]
        else:
            name, n = json.JSONDecoder().raw_decode(rest[1:])
            out.append(name)
            rest = rest[1 + n :]
    return out


def _sql_type(kinds: frozenset[str]) -> str:
    if kinds <= {"integer"}:
        return "bigint"
    if kinds <= {"integer", "number"}:
        return "double"
    return "boolean" if kinds == {"boolean"} else "string"


def element(path: str) -> str:
    """Name of the element type at a place: its member name, with [] for each level of array in it."""
    s = _steps(path)
    n = len(s)
    while n and s[n - 1] == "[]":
        n -= 1
    return (s[n - 1] if n else "$") + "[]" * (len(s) - n)


def plan(stats: dict[str, Stat], lists: dict[str, int] | None = None) -> dict[str, Table]:
    """Shared inlining: which tables there are, where their rows come from and what is inlined.

    * Elements are told apart by name; places of one name and of object or
      array kind are one element.
    * A table is made of the root, of array items, and of object elements met
      under several parent elements (shared) or below themselves (recursive).
    * Other objects are inlined into their parent, scalars always.
    * A member that is a short array of scalars whose length never differs (an
      interval, a box) is inlined as one column for each position.
    * An element that is an object here and a scalar or array there is inlined
      as JSON text where it is not an object.

    ``lists`` names elements whose first n items are to be inlined even if
    their lengths differ.
    """
    lists = lists or {}
    parents: dict[str, set[str]] = defaultdict(set)

    def above(path: str) -> str | None:
        if path == "$":
            return None
        return path[:-2] if path.endswith("[]") else path[: path.rindex('."')] if '."' in path else "$"

    def fixed(path: str) -> bool:
        st = stats.get(path)
        if st and "array" in st.kinds and element(path) in lists:
            return True
        item = stats.get(path + "[]")
        if path.endswith("[]"):  # rows of a matrix stay rows, also where all are equally long
            return False
        return bool(st and st.kinds == {"array"} and 0 < st.shortest == st.longest <= 4 and item and not item.kinds & {"array", "object"})

    for p, st in stats.items():
        if p != "$" and not p.endswith("[]") and "object" in st.kinds:
            parents[element(p)].add(element(above(p)))

    def recursive(p: str) -> bool:
        steps = _steps(p)
        return bool(steps) and steps[-1] != "[]" and steps[-1] in steps[:-1]

    def is_table(p: str) -> bool:
        if p == "$":
            return True
        if p.endswith("[]"):
            return not fixed(p[:-2])
        return "object" in stats[p].kinds and (len(parents[element(p)]) > 1 or recursive(p))

    tables: dict[str, Table] = {}
    for p in sorted(stats):
        if is_table(p):
            t = tables.setdefault(element(p), Table(element(p), []))
            t.sources.append(p)
            up = above(p)
            while up is not None and not is_table(up):
                up = above(up)
            if up is not None:
                t.parents[p] = up
    for t in tables.values():
        cols: dict[str, tuple[str, set[str]]] = {}

        def inline(path: str, rel: str, name: str) -> None:
            kinds = stats[path].kinds if path in stats else frozenset()
            if fixed(path):
                for i in range(lists.get(element(path), stats[path].longest)):
                    kinds = stats[path + "[]"].kinds if path + "[]" in stats else frozenset()
                    cols.setdefault(f"{rel}[{i}]", (f"{name}_{i}" if name else f"item_{i}", set()))[1].update(kinds)
                return
            rest = kinds - {"object", "array"}
            mixed = len({k if k in ("object", "array") else "scalar" for k in kinds}) > 1
            if rest or mixed:
                cols.setdefault(rel, (name or "value", set()))[1].update(kinds if mixed else rest)
            if "object" in kinds and not (rel and is_table(path)):
                for child in sorted(c for c in stats if above(c) == path and not c.endswith("[]")):
                    key = _steps(child)[-1]
                    inline(child, f'{rel}."{key}"' if "." in key else f"{rel}.{key}", f"{name}_{key}" if name else key)

        for src in t.sources:
            inline(src, "", "")
        used: dict[str, int] = {}
        for rel, (name, kinds) in cols.items():
            kind = "string" if kinds & {"object", "array"} else _sql_type(frozenset(kinds))
            used[name.lower()] = used.get(name.lower(), 0) + 1  # names that differ in case only would clash
            t.columns.append((rel, name if used[name.lower()] == 1 else f"{name}__{used[name.lower()]}", kind))
    return tables


def _get(v: Column, rel: str, kind: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(x if x.startswith("[") else _member(x) for x in _rel_steps(rel)), kind)


def _member(name: str) -> str:
    return f'["{name}"]' if "'" in name else f"['{name}']"


def _rel_steps(rel: str) -> list[str]:
    out, i = [], 0
    while i < len(rel):
        if rel[i] == "[":
            j = rel.index("]", i) + 1
            out.append(rel[i:j])
        elif rel[i + 1] == '"':
            j = rel.index('"', i + 2) + 1
            out.append(rel[i + 2 : j - 1])
        else:
            j = min(x for x in (rel.find(".", i + 1), rel.find("[", i + 1), len(rel)) if x > 0)
            out.append(rel[i + 1 : j])
        i = j
    return out


def shred(df: DataFrame, body: str, table: Table, keys: list[str]) -> DataFrame:
    """Rows of one planned table.

    Columns: ``keys`` of the record, ``parent_table`` and ``parent_id`` (null at
    the root), ``row_id``, ``pos`` (positions in all enclosing arrays, outermost
    first) and the inlined ones.  ``row_id`` is the place of the element in its
    record, so that it is the same in every run, and with ``keys`` joins child
    to parent.  An inlined name that clashes with these gets the prefix ``v_``.
    Null and unreadable bodies, absent members and empty arrays give no rows.
    """
    base = df.select(*keys, F.try_parse_json(F.col(body).cast("string")).alias("__v"), F.lit("$").alias("__id"), F.lit(None).cast("string").alias("__up"), F.array().cast("array<bigint>").alias("__pos"))
    fixed = {*keys, "parent_table", "parent_id", "row_id", "pos"}
    out = None
    for src in table.sources:
        rows, steps, up = base, _steps(src), table.parents.get(src)
        for k, step in enumerate(steps):
            opened = "$" + "".join("[]" if s == "[]" else "." + json.dumps(s) for s in steps[:k])
            if opened == up:
                rows = rows.withColumn("__up", F.col("__id"))
            if step == "[]":
                rows = rows.filter(F.schema_of_variant("__v").startswith("ARRAY"))
                rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("__v").outer())).select(*keys, F.col("value").alias("__v"), F.concat("__id", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("__id"), "__up", F.concat("__pos", F.array(F.col("pos").cast("bigint"))).alias("__pos"))
            else:
                rows = rows.select(*keys, F.try_variant_get("__v", "$" + _member(step), "variant").alias("__v"), F.concat("__id", F.lit(f".{step}")).alias("__id"), "__up", "__pos").filter(F.col("__v").isNotNull() & ~F.is_variant_null("__v"))
        made = [_get(F.col("__v"), rel, kind).alias(f"v_{name}" if name in fixed else name) for rel, name, kind in table.columns]
        rows = rows.select(*keys, F.lit(up and element(up)).cast("string").alias("parent_table"), F.col("__up").alias("parent_id"), F.col("__id").alias("row_id"), F.col("__pos").alias("pos"), *made)
        out = rows if out is None else out.unionByName(rows)
    return out


def shred_named(df: DataFrame, body: str, tables: dict[str, Table], name: str, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Like ``shred``, with exactly ``columns`` (name: type) inlined; those that the data lack are null."""
    got = shred(df, body, tables.get(name, Table(name, [])), keys) if name in tables else None
    if got is None:
        got = df.filter(F.lit(False)).select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in (("parent_table", "string"), ("parent_id", "string"), ("row_id", "string"), ("pos", "array<bigint>"))])
    return got.select(*keys, "parent_table", "parent_id", "row_id", "pos", *[(F.col(f"`{c}`") if c in got.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def instruction_items(routes: DataFrame) -> DataFrame:
    """(response_id, path_no, instruction_no, first, last, text) of the instructions of route responses."""
    tables = plan(analyse(routes, "body"), {"interval": 2})
    rows = shred_named(routes, "body", tables, "instructions[]", ["response_id"], {"interval_0": "bigint", "interval_1": "bigint", "text": "string"})
    rows = rows.filter(F.col("parent_table") == "paths[]")
    return rows.select("response_id", F.get("pos", F.lit(0)).alias("path_no"), F.get("pos", F.lit(1)).alias("instruction_no"), F.col("interval_0").alias("first"), F.col("interval_1").alias("last"), "text")


def matrix_items(matrices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Point pairs with the message of their hint, and distance cells, of matrix responses.

    Members lie under ``solution``, or at the top of a body without one.
    """
    tables = plan(analyse(matrices, "body"), {"point_pairs[]": 2})
    v = F.try_parse_json(F.col("body").cast("string"))
    inner = F.try_variant_get(v, "$.solution", "variant")
    source = matrices.withColumn("__under", F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False)))
    keys = ["response_id", "__under"]
    place = F.when(F.col("__under"), "$.solution.").otherwise("$.")
    pairs = shred_named(source, "body", tables, "point_pairs[]", keys, {"item_0": "bigint", "item_1": "bigint"})
    hints = shred_named(source, "body", tables, "hints[]", keys, {"message": "string"})
    hints = hints.filter(F.col("row_id").startswith(F.concat(place, F.lit("hints[")))).select("response_id", F.col("row_id").alias("parent_id"), "message").distinct()
    pairs = pairs.join(hints, ["response_id", "parent_id"])
    pairs = pairs.select("response_id", F.get("pos", F.lit(0)).alias("hint_no"), F.get("pos", F.lit(1)).alias("pair_no"), F.col("item_0").alias("first"), F.col("item_1").alias("second"), "message")
    cells = shred_named(source, "body", tables, "distances[][]", keys, {"value": "bigint"})
    cells = cells.filter(F.col("row_id").startswith(F.concat(place, F.lit("distances["))) & F.col("value").isNotNull())
    cells = cells.select("response_id", F.get("pos", F.lit(0)).alias("row_no"), F.get("pos", F.lit(1)).alias("column_no"), F.col("value").alias("distance"))
    return pairs, cells


def nested_items(routes: DataFrame, matrices: DataFrame) -> DataFrame:
    """One list of instructions, point pairs and distances with the keys of their parents, once each."""
    pairs, cells = matrix_items(matrices)
    row = lambda name, df, a, b, x, y, label: df.select(F.lit(name).alias("field"), "response_id", F.col(a).alias("parent_no"), F.col(b).alias("item_no"), x.cast("bigint").alias("first_value"), y.cast("bigint").alias("second_value"), label.alias("label"))
    none = F.lit(-1)
    out = row("instructions", instruction_items(routes), "path_no", "instruction_no", F.coalesce("first", none), F.coalesce("last", none), F.coalesce("text", F.lit("")))
    out = out.unionByName(row("point_pairs", pairs, "hint_no", "pair_no", F.col("first"), F.col("second"), F.coalesce("message", F.lit(""))))
    return out.unionByName(row("distances", cells, "row_no", "column_no", F.col("distance"), none, F.lit(""))).distinct()
