"""Schemas that drift between files: every change reported, all files read into one table.

Each file is profiled into a schema graph (members, JSON types, nesting).  The
graphs of neighbouring files of a series are compared by similarity flooding:
match scores start from names and types and are propagated along equal edges
of the pairwise connectivity graph until they converge.  A consistent set of
correspondences is then selected, and only that set decides what counts as the
same field under another name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators.windows import lag_in_chunks
from waymesh.session import cut, map_arrow, spread

MAX_NAMES = 5_000
_TYPES = (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"))


KEYS = ["response_id", "series_id", "file_id", "record_no", "exported_at"]


def path_objects(responses: DataFrame, more: list[str] | None = None) -> DataFrame:
    """One row for each object in ``paths``: the keys of the response (and ``more`` columns), path_no and the object as VARIANT.

    Rows without series or file are left out; unreadable bodies, bodies
    without ``paths`` and path entries that are no objects give no rows.
    """
    rows = responses.filter(F.col("series_id").isNotNull() & F.col("file_id").isNotNull())
    paths = F.try_variant_get(F.try_parse_json(F.col("body").cast("string")), "$.paths", "variant")
    cols = [*KEYS, *[c for c in more or [] if c not in KEYS]]
    rows = rows.select(*cols, paths.alias("v")).filter(F.schema_of_variant("v").startswith("ARRAY"))
    rows = rows.lateralJoin(responses.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*cols, F.col("pos").alias("path_no"), F.col("value").alias("v"))
    return rows.filter(F.schema_of_variant("v").startswith("OBJECT"))


def path_members(responses: DataFrame) -> DataFrame:
    """(series_id, file_id, name, kind, shape) of the members of path objects.

    ``kind`` is the JSON type, null for a JSON null; ``shape`` the nested type.
    """
    rows = path_objects(responses)
    rows = rows.lateralJoin(responses.sparkSession.tvf.variant_explode(F.col("v").outer())).select("series_id", "file_id", F.col("key").alias("name"), F.schema_of_variant("value").alias("shape"))
    shape = F.col("shape")
    kind = F.when(shape == "VOID", None)
    for prefix, name in _TYPES:
        kind = kind.when(shape.startswith(prefix), name)
    return rows.select("series_id", "file_id", "name", kind.otherwise("number").alias("kind"), "shape")


def file_schemas(responses: DataFrame) -> DataFrame:
    """One row a file: series_id, file_id, exported_at, fields (sorted array of name, types, shapes)."""
    files = responses.filter(F.col("series_id").isNotNull() & F.col("file_id").isNotNull()).groupBy("series_id", "file_id").agg(F.min("exported_at").alias("exported_at"))
    types = path_members(responses).filter(F.col("kind").isNotNull()).groupBy("series_id", "file_id", "name").agg(F.array_sort(F.collect_set("kind")).alias("types"), F.array_sort(F.collect_set(F.when(F.col("kind").isin("object", "array"), F.col("shape")))).alias("shapes"))
    fields = types.groupBy("series_id", "file_id").agg(F.array_sort(F.collect_list(F.struct("name", "types", "shapes"))).alias("fields"))
    none = F.array().cast(fields.schema["fields"].dataType)
    return files.join(fields, ["series_id", "file_id"], "left").withColumn("fields", F.coalesce("fields", none))


def neighbours(schemas: DataFrame) -> DataFrame:
    """Each file with the one before it in its series, by exported_at, then file_id; first files have none."""
    month = F.coalesce(F.substring(F.col("exported_at").cast("string"), 1, 7), F.lit(""))
    pairs = lag_in_chunks(schemas, ["series_id"], ["exported_at", "file_id"], month, ["file_id", "fields"], "before")
    return pairs.filter(F.col("before").isNotNull())


@lru_cache(maxsize=100_000)
def name_similarity(a: str, b: str) -> float:
    """Likeness of two member names in 0..1: letters in common order and words shared."""
    words = [tuple(w.lower() for w in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", x)) for x in (a, b)]
    la, lb = ("".join(w) or x.lower() for w, x in zip(words, (a, b)))
    ratio = SequenceMatcher(None, min(la, lb), max(la, lb), autojunk=False).ratio()
    u, v = set(words[0]), set(words[1])
    return max(ratio, len(u & v) / max(1, min(len(u), len(v))) * 0.9)


def parse_shape(text: str) -> tuple[str, dict]:
    """A nested type as (kind, children); the element of an array is its child ``[]``.  Names in backticks may hold anything."""
    at = 0

    def word() -> str:
        nonlocal at
        m = _SHAPE_WORD.match(text, at)
        at = m.end()
        return m[0]

    def read() -> tuple[str, dict]:
        nonlocal at
        kind = word()
        children: dict = {}
        if at < len(text) and text[at] == "<":
            at += 1
            while text[at] != ">":
                if kind == "ARRAY":
                    children["[]"] = read()
                else:
                    if text[at] == "`":
                        m = _SHAPE_NAME.match(text, at)
                        name, at = m[1].replace("``", "`"), m.end()
                    else:
                        m = _SHAPE_PLAIN.match(text, at)
                        name, at = m[1], m.end()
                    children[name] = read()
                if text[at] == ",":
                    at += 2
            at += 1
        elif at < len(text) and text[at] == "(":  # DECIMAL(10,2)
            at = text.index(")", at) + 1
        return kind, children

    return read()


_SHAPE_WORD = re.compile(r"[A-Z_]+")
_SHAPE_NAME = re.compile(r"`((?:[^`]|``)*)`: ")
_SHAPE_PLAIN = re.compile(r"([^`:]*): ")


@lru_cache(maxsize=20_000)
def _graph(fields: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]) -> tuple[list[str], list[list[int]], list[tuple[str, ...]]]:
    """(names, children, types) of the nodes of a schema: node 0 is the record, then its fields, then what they nest."""
    names, children, types = [""], [[]], [("object",)]

    def put(parent: int, name: str, kinds: tuple[str, ...], nested: list[dict]) -> None:
        at = len(names)
        names.append(name)
        children.append([])
        types.append(kinds)
        children[parent].append(at)
        inner: dict[str, list[tuple[str, dict]]] = {}
        for kids in nested:
            for k, v in kids.items():
                inner.setdefault(k, []).append(v)
        later.extend((at, k, tuple(sorted({kind for kind, _ in v})), [kids for _, kids in v]) for k, v in sorted(inner.items()))

    later: list = []
    for name, kinds, shapes in fields:
        put(0, name, kinds, [parse_shape(x)[1] for x in shapes])
    while later:
        put(*later.pop(0))
    return names, children, types


def flood(old: list[tuple[str, tuple[str, ...], tuple[str, ...]]], new: list[tuple[str, tuple[str, ...], tuple[str, ...]]], rounds: int = 500, eps: float = 1e-3) -> tuple[np.ndarray, bool]:
    """Match scores (old x new) of the fields of two schema graphs by similarity flooding, and whether they converged.

    Nodes are the record, its fields and all that they nest, at any depth, and
    type sets.  Pairs of nodes are joined where equal edges (``member`` or
    ``type``) lead to both; a pair passes its score along, split evenly over
    the edges of one kind, forwards and backwards.  Initial scores (likeness of
    names and of type sets) are added in each round and the largest is scaled
    to one, until nothing moves by more than eps.
    """
    if not old or not new:
        return np.zeros((len(old), len(new))), True
    (na, ca, ta), (nb, cb, tb) = _graph(tuple(old)), _graph(tuple(new))
    index: dict = {(0, 0): 0}
    start, src, dst, share, back = [1.0], [], [], [], []
    todo = [(0, 0)]
    for x, y in todo:
        here = index[x, y]
        pairs = [(i, j) for i in ca[x] for j in cb[y]]
        for i, j in pairs:
            index[i, j] = len(start)
            start.append(name_similarity(na[i], nb[j]))
            src.append(here)
            dst.append(index[i, j])
            share.append(1 / len(pairs))
            back.append(1.0)
            todo.append((i, j))
    kinds: dict = {}
    for x, y in todo:
        kinds.setdefault((ta[x], tb[y]), []).append(index[x, y])
    for (u, v), members in kinds.items():
        at = len(start)
        start.append(len(set(u) & set(v)) / max(1, len(set(u) | set(v))))
        src += members
        dst += [at] * len(members)
        share += [1.0] * len(members)
        back += [1 / len(members)] * len(members)
    first, n = np.array(start), len(start)
    src, dst, share, back = np.array(src), np.array(dst), np.array(share), np.array(back)
    s, settled = first.copy(), False
    for _ in range(rounds):
        t = s + first
        t2 = t + np.bincount(dst, t[src] * share, n) + np.bincount(src, t[dst] * back, n)
        t2 /= t2.max()
        moved, s = np.abs(t2 - s).max(), t2
        if moved < eps:
            settled = True
            break
    return s[1 : 1 + len(old) * len(new)].reshape(len(old), len(new)), settled


def correspond(old: list[tuple], new: list[tuple], scored: bool = True) -> list[tuple[str | None, str | None, float, float]]:
    """Selected (old name, new name, score, margin), one-to-one; None for a side without partner.

    A name in both files is the same field.  Of the others only fields of one
    type set may correspond, and the converged scores choose: a pair is taken
    when each is the other's best of those left, the highest first.  ``margin``
    is how far its score lies above that of the best rival of either side, and
    infinite where neither has a rival of its type set; it is zero where scores
    did not converge.  Where only pairs without a rival are asked for, no score
    can matter: without ``scored`` nothing is flooded, scores are zero and
    fields with rivals stay without partner.
    """
    score, settled = flood(old, new) if scored else (np.zeros((len(old), len(new))), False)
    at = {x[0]: i for i, x in enumerate(new)}
    out = [(x[0], x[0], float(score[i, at[x[0]]]), math.inf) for i, x in enumerate(old) if x[0] in at]
    same = {x[0] for x in out}
    left = [i for i, x in enumerate(old) if x[0] not in same]
    right = [j for j, x in enumerate(new) if x[0] not in same]
    fit = {(i, j): float(score[i, j]) for i in left for j in right if old[i][1] == new[j][1]}
    if not scored:
        n_i, n_j = Counter(i for i, _ in fit), Counter(j for _, j in fit)
        fit = {(i, j): s for (i, j), s in fit.items() if n_i[i] == n_j[j] == 1}
    used_i, used_j = set(), set()
    for i, j in sorted(fit, key=lambda p: (-fit[p], old[p[0]][0], new[p[1]][0])):
        if i in used_i or j in used_j:
            continue
        used_i.add(i)
        used_j.add(j)
        rivals = [s for (x, y), s in fit.items() if (x == i) != (y == j)]
        margin = math.inf if not rivals else max(0.0, fit[i, j] - max(rivals)) if settled else 0.0
        out.append((old[i][0], new[j][0], fit[i, j], margin))
    out += [(old[i][0], None, 0.0, math.inf) for i in left if i not in used_i]
    out += [(None, new[j][0], 0.0, math.inf) for j in right if j not in used_j]
    return out


_MATCH = "series_id string, file_id string, before_id string, old_name string, new_name string, old_types array<string>, new_types array<string>, score double, margin double"


def _match(batches: Iterator[pa.RecordBatch], scored: bool = True) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _MATCH.split(", ")]
    kinds = [pa.string()] * 5 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.float64()]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for r in b.to_pylist():
            old = [(f["name"], tuple(f["types"]), tuple(f["shapes"])) for f in r["before"]["fields"]]
            new = [(f["name"], tuple(f["types"]), tuple(f["shapes"])) for f in r["fields"]]
            was, now = {x[0]: list(x[1]) for x in old}, {x[0]: list(x[1]) for x in new}
            for a, c, score, margin in correspond(old, new, scored):
                for col, v in zip(cols, (r["series_id"], r["file_id"], r["before"]["file_id"], a, c, was.get(a), now.get(c), score, margin)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def correspondences(schemas: DataFrame, scored: bool = True) -> DataFrame:
    """Field correspondences of neighbouring files, by similarity flooding unless ``scored`` is false; see ``correspond``."""
    return map_arrow(spread(neighbours(schemas).select("series_id", "file_id", "before", "fields")), partial(_match, scored=scored), _MATCH)


def changes(matches: DataFrame, margin: float = math.inf) -> DataFrame:
    """(file_id, field, change_kind) from correspondences.

    A correspondence is a rename if its score lies ``margin`` above all rivals
    (infinite: if it has none, the strict reading, for which ``correspondences``
    need not be scored), else it is reported as one field removed and one added.
    """
    both = F.col("old_name").isNotNull() & F.col("new_name").isNotNull()
    event = lambda name, kind: F.struct(name.alias("field"), F.lit(kind).alias("change_kind"))
    events = (
        F.when(F.col("old_name") == F.col("new_name"), F.when(F.col("old_types") != F.col("new_types"), F.array(event(F.col("old_name"), "retyped"))))
        .when(both & (F.col("margin") >= margin), F.array(event(F.col("old_name"), "renamed")))
        .when(both, F.array(event(F.col("old_name"), "removed"), event(F.col("new_name"), "added")))
        .when(F.col("old_name").isNotNull(), F.array(event(F.col("old_name"), "removed")))
        .otherwise(F.array(event(F.col("new_name"), "added")))
    )
    return matches.select("file_id", F.explode(events).alias("e")).select("file_id", "e.field", "e.change_kind").distinct()


def canonical_names(schemas: DataFrame, matches: DataFrame) -> dict[str, tuple[str, str]]:
    """Member name -> (name in the unified table, type), over all files.

    Names are joined when they correspond somewhere and never occur in the
    same file, strongest evidence first; the group takes the name used by most
    files.  Types widen: number to double, boolean with others to boolean,
    every mixture with text, arrays or objects to JSON text.  The driver sees
    names and counts only; more than MAX_NAMES names raise ValueError.
    """
    names = schemas.select(F.explode("fields").alias("f")).groupBy("f.name").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("f.types"))).alias("types")).limit(MAX_NAMES + 1).collect()
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} member names: they seem to hold data")
    count, types = {r["name"]: r["n"] for r in names}, {r["name"]: set(r["types"]) for r in names}
    moved = matches.filter(F.col("old_name") != F.col("new_name")).groupBy("old_name", "new_name").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s")).collect()
    # only names that some chain of correspondences joins can clash
    part = {n: n for r in moved for n in (r["old_name"], r["new_name"])}

    def top(n: str) -> str:
        while part[n] != n:
            part[n] = n = part[part[n]]
        return n

    for r in moved:
        part[top(r["old_name"])] = top(r["new_name"])
    spark = schemas.sparkSession
    parts = spark.createDataFrame([(n, top(n)) for n in sorted(part)], "name string, part string")
    met = schemas.select("series_id", "file_id", F.explode("fields.name").alias("name")).join(F.broadcast(parts), "name")  # at most MAX_NAMES rows
    met = met.groupBy("series_id", "file_id", "part").agg(F.array_sort(F.collect_set("name")).alias("names")).filter(F.size("names") > 1).select("names").distinct()
    pair = F.explode(F.expr("flatten(transform(names, x -> transform(filter(names, y -> x < y), y -> struct(x as a, y as b))))"))
    together = {(r["a"], r["b"]) for r in met.select(pair.alias("p")).select("p.a", "p.b").distinct().collect()}
    group = {n: {n} for n in count}
    for r in sorted(moved, key=lambda r: (-r["s"], -r["n"], r["old_name"], r["new_name"])):
        a, b = group[r["old_name"]], group[r["new_name"]]
        if a is not b and not any((min(x, y), max(x, y)) in together for x in a for y in b):
            for x in a | b:
                group[x] = a
            a |= b
    out = {}
    for n in sorted(count):
        g = group[n]
        kinds = set().union(*(types[x] for x in g))
        kind = "string" if kinds & {"array", "object"} else "boolean" if "boolean" in kinds else "double" if "number" in kinds and kinds <= {"number", "string"} else "string"
        out[n] = (min(g, key=lambda x: (-count[x], x)), kind)
    return out


def unify(responses: DataFrame) -> DataFrame:
    """All paths of all files as one table with one name and type a field.

    Keys: response_id, series_id, file_id, record_no, path_no; then the unified
    fields in order of name.  A value that does not convert is null, and its
    JSON text is kept under its field in the map ``unread``.  A unified name
    that clashes with a key gets the prefix ``field_``.  Of a response that was
    delivered again the first received one holds.
    """
    schemas = cut(file_schemas(responses))
    names = canonical_names(schemas, cut(correspondences(schemas)))
    targets: dict[str, tuple[str, list[str]]] = {}
    for name, (target, kind) in sorted(names.items()):
        targets.setdefault(target, (kind, []))[1].append(name)
    keys = ["response_id", "series_id", "file_id", "record_no", "path_no"]
    by = "received_at" if "received_at" in responses.columns else "exported_at"
    text = F.to_json("v")
    rows = path_objects(responses, [by]).groupBy(*keys).agg(F.min_by(text, F.struct(F.col(by), text)).alias("text"))
    rows = rows.select(*keys, F.try_variant_get(F.parse_json("text"), "$", "map<string,string>").alias("m"))
    made, unread = [], []
    for name, (kind, sources) in sorted(targets.items()):
        raw = F.coalesce(*[F.element_at("m", F.lit(x)) for x in sources])
        low = F.lower(raw)
        value = F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False) if kind == "boolean" else raw.try_cast("double") if kind == "double" else raw
        made.append(value.alias(f"field_{name}" if name in keys else name))
        unread.append(F.when(raw.isNotNull() & value.isNull(), F.struct(F.lit(name).alias("key"), raw.alias("value"))))
    left = F.map_from_entries(F.filter(F.array(*unread), lambda x: x.isNotNull())) if unread else F.create_map().cast("map<string,string>")
    return rows.select(*keys, *made, left.alias("unread"))
