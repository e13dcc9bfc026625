"""OpenStreetMap extracts, XML and PBF, as three tables.

osm_nodes(id, lat, lon, tags), osm_ways(id, refs, tags) and
osm_relations(id, members(type, ref, role), tags).  Order of elements in the
file does not matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.session import map_arrow

_TAG = "tag array<struct<_k:string,_v:string>>"


def _tags() -> Column:
    pairs = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))
    # the last of repeated keys holds
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: k != t["key"]), F.create_map(t["key"], t["value"])))


def read_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an .osm or .osm.xml file, also gzip or bzip2; each table reads only its own elements."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", f"_id bigint, _lat double, _lon double, {_TAG}")
    ways = read("way", f"_id bigint, nd array<struct<_ref:bigint>>, {_TAG}")
    rels = read("relation", f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAG}")
    none = F.array().cast("array<bigint>")
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return {
        "nodes": nodes.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags().alias("tags")),
        "ways": ways.select(F.col("_id").alias("id"), F.coalesce(F.transform("nd", lambda n: n["_ref"]), none).alias("refs"), _tags().alias("tags")),
        "relations": rels.select(F.col("_id").alias("id"), F.coalesce(members, F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).alias("members"), _tags().alias("tags")),
    }


# --------------------------------------------------------------------------- PBF: a reader of wire format


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, the rest as bytes."""
    i, n = 0, len(data)
    while i < n:
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(data, i)
        elif kind == 2:
            size, i = _varint(data, i)
            v, i = data[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            v, i = data[i : i + size], i + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, v


def _varint(data: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[i]
        i += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, i
        shift += 7


def packed(data: bytes, signed: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(data):
        v, i = _varint(data, i)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def _deltas(data: bytes) -> list[int]:
    out, at = [], 0
    for d in packed(data, True):
        at += d
        out.append(at)
    return out


def blobs(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(type, unpacked content) of the blocks of a PBF file."""
    i = 0
    while i + 4 <= len(data):
        (size,) = struct.unpack(">I", data[i : i + 4])
        head = dict(fields(data[i + 4 : i + 4 + size]))
        i += 4 + size
        body = dict(fields(data[i : i + head[3]]))
        i += head[3]
        yield head[1].decode(), zlib.decompress(body[3]) if 3 in body else body[1]


def elements(block: bytes) -> Iterator[tuple]:
    """(kind, id, lat, lon, refs, members, tags) of one data block."""
    grain, off_lat, off_lon, strings, groups = 100, 0, 0, [], []
    for k, v in fields(block):
        if k == 1:
            strings = [s.decode() for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            off_lat = v
        elif k == 20:
            off_lon = v
    degrees = lambda v, off: 1e-9 * (off + grain * v)
    named = lambda ks, vs: [(strings[a], strings[b]) for a, b in zip(packed(ks), packed(vs))]
    for group in groups:
        for k, v in fields(group):
            m = dict(fields(v))
            if k == 1:
                z = lambda x: (x >> 1) ^ -(x & 1)
                yield "node", z(m[1]), degrees(z(m[8]), off_lat), degrees(z(m[9]), off_lon), None, None, named(m.get(2, b""), m.get(3, b""))
            elif k == 2:
                kv, at = packed(m.get(10, b"")), 0
                for i, la, lo in zip(_deltas(m[1]), _deltas(m[8]), _deltas(m[9])):
                    tags = []
                    while at < len(kv) and kv[at]:
                        tags.append((strings[kv[at]], strings[kv[at + 1]]))
                        at += 2
                    at += 1
                    yield "node", i, degrees(la, off_lat), degrees(lo, off_lon), None, None, tags
            elif k == 3:
                yield "way", m[1], None, None, _deltas(m.get(8, b"")), None, named(m.get(2, b""), m.get(3, b""))
            elif k == 4:
                kinds = ("node", "way", "relation")
                members = [{"type": kinds[t], "ref": r, "role": strings[s]} for s, r, t in zip(packed(m.get(8, b"")), _deltas(m.get(9, b"")), packed(m.get(10, b"")))]
                yield "relation", m[1], None, None, None, members, named(m.get(2, b""), m.get(3, b""))


_ELEMENT = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("tags", pa.map_(pa.string(), pa.string()))])
_ELEMENT_DDL = "kind string, id bigint, lat double, lon double, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"


def read_pbf(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of .osm.pbf files: files are cut into blocks, and blocks decoded in parallel."""

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                for kind, block in blobs(data):
                    if kind == "OSMData":
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                rows = list(elements(block))
                for k in range(0, len(rows), 10_000):
                    cols = zip(*rows[k : k + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, _ELEMENT)], names=_ELEMENT.names)

    files = spark.read.format("binaryFile").load(path).select("content")
    every = map_arrow(map_arrow(files, cut_blocks, "block binary").repartition(spark.sparkContext.defaultParallelism), decode, _ELEMENT_DDL)
    return {
        "nodes": every.filter("kind = 'node'").select("id", "lat", "lon", "tags"),
        "ways": every.filter("kind = 'way'").select("id", "refs", "tags"),
        "relations": every.filter("kind = 'relation'").select("id", "members", "tags"),
    }


# --------------------------------------------------------------------------- from elements to a graph


#: Values of ``highway`` that make no road.
NO_ROADS = ("construction", "proposed", "abandoned", "razed", "raceway", "elevator")


def roads(ways: DataFrame) -> DataFrame:
    """Ways with at least two nodes that are roads or ferries."""
    t = F.col("tags")
    return ways.filter((F.size("refs") >= 2) & (F.coalesce(t["route"].isin("ferry", "shuttle_train"), F.lit(False)) | (t["highway"].isNotNull() & ~t["highway"].isin(*NO_ROADS))))


def graph(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): edges(edge, way_id, node_a, node_b, dist_m, points, tags) between junctions and ends of roads.

    Ways are split where they meet other ways or themselves.  Nodes missing
    from the extract are skipped; edges left with one node are dropped, as are
    loops of a single node.
    """
    from waymesh.functions.geo import line_length_m
    from waymesh.operators.attributes import segments

    ways = roads(tables["ways"])
    pieces = segments(ways.select("id", "refs")).select("way_id", "segment", F.posexplode("nodes").alias("pos", "node"))
    at = pieces.join(tables["nodes"].select(F.col("id").alias("node"), "lat", "lon"), "node")
    lines = at.groupBy("way_id", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "lat", "lon"))).alias("p")).filter(F.size("p") >= 2)
    points = F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    edges = lines.select(F.xxhash64("way_id", "segment").alias("edge"), "way_id", "segment", F.col("p")[0]["node"].alias("node_a"), F.element_at("p", -1)["node"].alias("node_b"), points.alias("points"))
    edges = edges.filter("node_a <> node_b or size(points) > 2").withColumn("dist_m", F.greatest(F.lit(0.001), line_length_m(F.col("points"))))
    edges = edges.join(ways.select(F.col("id").alias("way_id"), "tags"), "way_id")
    ends = edges.select(F.explode(F.array("node_a", "node_b")).alias("id")).distinct()
    return tables["nodes"].join(ends, "id", "left_semi").select(F.col("id").alias("node"), "lat", "lon", "tags"), edges


def restrictions(relations: DataFrame) -> DataFrame:
    """(relation, kind, from_way, via_node, to_way) of simple turn restrictions; each needs one from, via node and to."""
    t = F.col("tags")
    rows = relations.filter((t["type"] == "restriction") & t["restriction"].isNotNull())
    pick = lambda role, kind: F.filter("members", lambda m: (m["role"] == role) & (m["type"] == kind))
    rows = rows.select(F.col("id").alias("relation"), t["restriction"].alias("kind"), pick("from", "way").alias("f"), pick("via", "node").alias("v"), pick("to", "way").alias("t"))
    return rows.filter("size(f) = 1 and size(v) = 1 and size(t) = 1").select("relation", "kind", F.col("f")[0]["ref"].alias("from_way"), F.col("v")[0]["ref"].alias("via_node"), F.col("t")[0]["ref"].alias("to_way"))


def forbidden_turns(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(from_edge, via_node, to_edge) forbidden by ``restrictions``: no_ rules forbid their turn, only_ rules all others."""
    ends = edges.select("edge", "way_id", F.explode(F.array("node_a", "node_b")).alias("node"))
    a = ends.select(F.col("edge").alias("from_edge"), F.col("way_id").alias("from_way"), F.col("node").alias("via_node"))
    b = ends.select(F.col("edge").alias("to_edge"), F.col("way_id").alias("w"), F.col("node").alias("via_node"))
    turns = rules.join(a, ["from_way", "via_node"]).join(b, "via_node").filter("from_edge <> to_edge")
    hit = F.when(F.col("kind").startswith("only_"), F.col("w") != F.col("to_way")).otherwise(F.col("kind").startswith("no_") & (F.col("w") == F.col("to_way")))
    return turns.filter(hit).select("from_edge", "via_node", "to_edge").distinct()
