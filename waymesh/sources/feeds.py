"""Timetable feeds, tracks, areas, elevation tiles and stored graphs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions.text import seconds_of_time, xml_escape
from waymesh.session import map_arrow

#: Kinds of the columns of timetable files; others are text.
GTFS_TYPES = {
    "int": ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "exception_type", "payment_method", "transfers", "transfer_duration", "headway_secs", "exact_times", "route_type", "shape_pt_sequence", "location_type", "stop_sequence", "pickup_type", "drop_off_type", "transfer_type", "min_transfer_time", "direction_id"),
    "double": ("stop_lat", "stop_lon", "shape_pt_lat", "shape_pt_lon", "shape_dist_traveled"),
    "date": ("start_date", "end_date", "date"),
    "time": ("arrival_time", "departure_time", "start_time", "end_time"),
    "decimal(10,4)": ("price",),
}
GTFS_FILES = ("agency", "calendar", "calendar_dates", "fare_attributes", "fare_rules", "feed_info", "frequencies", "routes", "shapes", "stops", "stop_times", "transfers", "trips")


def read_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Typed tables of an unpacked feed: one for each known file present; times are seconds, bad values null.

    For reasons of bad values read the lines with operators.bad_rows instead.
    """
    kind = {c: k for k, cs in GTFS_TYPES.items() for c in cs}
    out = {}
    for name in GTFS_FILES:
        if not Path(path, f"{name}.txt").exists():
            continue
        raw = spark.read.csv(f"{path}/{name}.txt", header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        cols = []
        for c in raw.columns:
            clean = c.strip().lstrip("﻿")
            v, k = F.col(f"`{c}`"), kind.get(clean)
            cols.append((F.expr(f"try_to_date(`{c}`, 'yyyyMMdd')") if k == "date" else seconds_of_time(v) if k == "time" else v.try_cast(k) if k else v).alias(clean))
        out[name] = raw.select(*cols)
    return out


def write_feed(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as a folder of CSV parts with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


_TRACK = "trace_id string, segment int, seq int, ts timestamp, lat double, lon double, ele double"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, segment, seq, ts, lat, lon, ele) of GPX 1.0 and 1.1 files; missing times and elevations are null.

    Files without track points, and unreadable ones, give no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime as dt

        for b in batches:
            rows: list[tuple] = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    root = ElementTree.fromstring(data)
                except ElementTree.ParseError:
                    continue
                local = lambda e: e.tag.rpartition("}")[2]
                for s, seg in enumerate(e for e in root.iter() if local(e) == "trkseg"):
                    for i, p in enumerate(e for e in seg if local(e) == "trkpt"):
                        sub = {local(c): (c.text or "").strip() for c in p}
                        at = dt.datetime.fromisoformat(sub["time"].replace("Z", "+00:00")) if sub.get("time") else None
                        if at and at.tzinfo is None:
                            at = at.replace(tzinfo=dt.timezone.utc)
                        rows.append((name, s, i, at, float(p.get("lat")), float(p.get("lon")), float(sub["ele"]) if sub.get("ele") else None))
            types = (pa.string(), pa.int32(), pa.int32(), pa.timestamp("us", "UTC"), pa.float64(), pa.float64(), pa.float64())
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _TRACK.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, parse, _TRACK)


def gpx_text(tracks: DataFrame) -> DataFrame:
    """(trace_id, gpx) of tracks(trace_id, seq, ts, lat, lon, ele); null times and elevations are left out."""
    ele = F.coalesce(F.concat(F.lit("<ele>"), F.col("ele").cast("string"), F.lit("</ele>")), F.lit(""))
    time = F.coalesce(F.concat(F.lit("<time>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time>")), F.lit(""))
    point = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('">'), ele, time, F.lit("</trkpt>"))
    body = tracks.withColumn("p", point).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("seq", "p"))).alias("ps"))
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="waymesh" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return body.select("trace_id", F.concat(F.lit(head), xml_escape(F.col("trace_id")), F.lit("</name><trkseg>"), F.array_join(F.transform("ps", lambda x: x["p"]), ""), F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """(area_id, props, rings) of GeoJSON feature collections; each polygon of a multipolygon is a row of its own.

    Features without id are named by file and position.  Other geometries are left out.
    """
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))
    tvf = spark.tvf
    f = docs.select("file", F.try_variant_get("v", "$.features", "variant").alias("v")).lateralJoin(tvf.variant_explode(F.col("v").outer())).select("file", F.col("pos").alias("n"), F.col("value").alias("f"))
    kind = F.try_variant_get("f", "$.geometry.type", "string")
    xy = "array<array<array<double>>>"
    polygons = F.when(kind == "Polygon", F.array(F.try_variant_get("f", "$.geometry.coordinates", xy))).when(kind == "MultiPolygon", F.try_variant_get("f", "$.geometry.coordinates", f"array<{xy}>"))
    name = F.coalesce(F.try_variant_get("f", "$.id", "string"), F.concat_ws("#", F.element_at(F.split("file", "/"), -1), F.col("n").cast("string")))
    props = F.try_variant_get("f", "$.properties", "map<string,string>")
    rows = f.select(name.alias("area_id"), props.alias("props"), F.explode(polygons).alias("p")).filter("p is not null")
    return rows.select("area_id", "props", F.transform("p", lambda r: F.transform(r, lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat")))).alias("rings"))


def geojson_features(areas: DataFrame) -> DataFrame:
    """(area_id, feature): each area as the text of a GeoJSON feature."""
    ring = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    return areas.select("area_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("area_id").alias("id"), F.col("props").alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))).alias("feature"))


def read_model(text: str) -> dict:
    """A rule model from JSON with // and # line comments and /* */ blocks, outside of texts."""
    keep = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|#[^\n]*|/\*.*?\*/', re.S)
    return json.loads(keep.sub(lambda m: m[0] if m[0][0] == '"' else " ", text))


def tile_name(lat: int, lon: int) -> str:
    """Name of the one-degree elevation tile whose south-west corner is given."""
    return f"{'N' if lat >= 0 else 'S'}{abs(lat):02d}{'E' if lon >= 0 else 'W'}{abs(lon):03d}"


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """(tile, row, heights array<short>) of .hgt tiles, row 0 in the north; heights beyond -1000..12000 are null."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = int(len(data) // 2) ** 0.5
                n = int(round(n))
                grid = np.frombuffer(data, ">i2", n * n).reshape(n, n).astype(np.int16)
                tile = name.rpartition("/")[2].partition(".")[0].upper()
                for k in range(0, n, 256):
                    rows = grid[k : k + 256]
                    bad = (rows < -1000) | (rows > 12_000)
                    flat = pa.array(rows.ravel(), pa.int16(), mask=bad.ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, n), pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([tile] * len(rows)), pa.array(np.arange(k, k + len(rows)), pa.int32()), lists], names=["tile", "row", "heights"])

    return map_arrow(spark.read.format("binaryFile").load(path).select("path", "content"), parse, "tile string, row int, heights array<smallint>")


def elevations(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """points(id, lat, lon) with ``ele`` of the nearest grid point; 0 where there is no tile or no value.

    Grid rows, not whole tiles, are joined to the points, so that a tile with
    very many points is spread like any other key.
    """
    shape = tiles.groupBy("tile").agg((F.max("row") + 1).alias("n"))
    la, lo = F.floor("lat").cast("int"), F.floor("lon").cast("int")
    name = F.format_string("%s%02d%s%03d", F.when(la >= 0, "N").otherwise("S"), F.abs(la), F.when(lo >= 0, "E").otherwise("W"), F.abs(lo))
    p = points.withColumn("tile", name).join(shape, "tile", "left")
    p = p.withColumn("row", F.round((la + 1 - F.col("lat")) * (F.col("n") - 1)).cast("int")).withColumn("__c", F.round((F.col("lon") - lo) * (F.col("n") - 1)).cast("int"))
    hit = p.join(tiles, ["tile", "row"], "left")
    return hit.select(*points.columns, F.coalesce(F.get("heights", F.col("__c")).cast("double"), F.lit(0.0)).alias("ele"))


GRAPH_VERSION = 1


def save_graph(tables: dict[str, DataFrame], path: str, **info: str) -> None:
    """Tables as parquet, and a sidecar with version, columns and ``info``, written last."""
    meta = {"version": GRAPH_VERSION, "tables": {}, "info": info}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        meta["tables"][name] = df.schema.jsonValue()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_graph")


def load_graph(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and ``info`` of a stored graph; another version or other columns raise ValueError."""
    from pyspark.sql.types import StructType

    meta = json.loads(spark.read.text(f"{path}/_graph").head()["value"])
    if meta["version"] != GRAPH_VERSION:
        raise ValueError(f"graph of version {meta['version']}, not {GRAPH_VERSION}")
    out = {}
    for name, schema in meta["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        want = StructType.fromJson(schema)
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in want]:
            raise ValueError(f"columns of {name} have changed")
        out[name] = df
    return out, meta["info"]


# --------------------------------------------------------------------------- realtime updates (wire format)


def decode_updates(data: bytes) -> Iterator[tuple]:
    """(feed_ts, trip_id, start_time, relationship, stop_sequence, arrival_delay_s, departure_delay_s, skipped) of a realtime message."""
    from waymesh.sources.osm import fields

    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    stamp = 0
    for k, v in fields(data):
        if k == 1:
            stamp = dict(fields(v)).get(3, 0)
        elif k == 2:
            update = dict(fields(v)).get(3)
            if update is None:
                continue
            trip, stops = {}, []
            for a, b in fields(update):
                if a == 1:
                    trip = dict(fields(b))
                elif a == 2:
                    stops.append(dict(fields(b)))
            delay = lambda s, n: signed(dict(fields(s[n]))[1]) if n in s and 1 in dict(fields(s[n])) else None  # noqa: B023, E731
            for s in stops or [{}]:
                yield stamp, trip.get(1, b"").decode(), trip.get(2, b"").decode(), trip.get(4, 0), s.get(1), delay(s, 2), delay(s, 3), s.get(5, 0) == 1


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """Stop time updates of realtime message files."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for data in b.column(0).to_pylist() for r in decode_updates(data)]
            types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["feed_ts", "trip_id", "start_time", "relationship", "stop_sequence", "arrival_delay_s", "departure_delay_s", "skipped"])

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), parse, "feed_ts bigint, trip_id string, start_time string, relationship int, stop_sequence int, arrival_delay_s int, departure_delay_s int, skipped boolean")


def message(*parts: tuple[int, int | bytes | str]) -> bytes:
    """A protobuf message of (number, value): ints as varints, texts and bytes with their length."""
    out = bytearray()

    def varint(n: int) -> None:
        n &= (1 << 64) - 1
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)

    for k, v in parts:
        if isinstance(v, int):
            varint(k << 3)
            varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            varint(k << 3 | 2)
            varint(len(v))
            out.extend(v)
    return bytes(out)


def tile_bytes(layer: str, lines: list[list[tuple[int, int]]], tags: list[dict[str, str]], extent: int = 4096) -> bytes:
    """A vector tile of one layer of lines in tile units, with text attributes."""
    keys: dict[str, int] = {}
    values: dict[str, int] = {}
    feats = []
    packed = lambda ns: b"".join(message((0, n))[1:] for n in ns)
    zig = lambda d: (d << 1) ^ (d >> 63)
    for line, tag in zip(lines, tags):
        if len(line) < 2:
            continue
        pairs = [i for k, v in sorted(tag.items()) for i in (keys.setdefault(k, len(keys)), values.setdefault(v, len(values)))]
        geo, at = [9], (0, 0)
        for n, p in enumerate(line):
            if n == 1:
                geo.append((len(line) - 1) << 3 | 2)
            geo += [zig(p[0] - at[0]), zig(p[1] - at[1])]
            at = p
        feats.append((2, message((2, packed(pairs)), (3, 2), (4, packed(geo)))))
    body = message((15, 2), (1, layer), *feats, *[(3, k) for k in keys], *[(4, message((1, v))) for v in values], (5, extent))
    return message((3, body))


def decode_tile(data: bytes) -> list[tuple[str, list[tuple[int, int]], dict[str, str]]]:
    """(layer, line, attributes) of a tile of lines with text attributes."""
    from waymesh.sources.osm import fields, packed

    out = []
    for _, layer in fields(data):
        parts = list(fields(layer))
        name = next(v for k, v in parts if k == 1).decode()
        keys = [v.decode() for k, v in parts if k == 3]
        values = [dict(fields(v))[1].decode() for k, v in parts if k == 4]
        for k, v in parts:
            if k != 2:
                continue
            f = dict(fields(v))
            t, g = packed(f.get(2, b"")), packed(f[4])
            zag = lambda n: (n >> 1) ^ -(n & 1)
            line, at, i = [], [0, 0], 0
            while i < len(g):
                count = g[i] >> 3
                i += 1
                for _ in range(count):
                    at = [at[0] + zag(g[i]), at[1] + zag(g[i + 1])]
                    line.append((at[0], at[1]))
                    i += 2
            out.append((name, line, {keys[a]: values[b] for a, b in zip(t[::2], t[1::2])}))
    return out


def vector_tiles(lines: DataFrame, zoom: int, layer: str = "roads", extent: int = 4096) -> DataFrame:
    """(z, x, y, tile) of lines(id, points, name): each line in the tiles its points lie in, in tile units.

    A tile is one group; its size is bounded by choosing the zoom.
    """
    from waymesh.functions.geo import tile_xy

    p = lines.select("id", "name", F.posexplode("points").alias("pos", "p"))
    x, y = tile_xy(F.col("p.lat"), F.col("p.lon"), zoom)
    touched = p.select("id", x.alias("x"), y.alias("y")).distinct()
    n = 1 << zoom
    full = touched.join(lines.select("id", "name", "points"), "id")
    fx = F.transform("points", lambda q: (((q["lon"] + 180) / 360 * n - F.col("x")) * extent).cast("int"))
    fy = F.transform("points", lambda q: (((1 - F.ln(F.tan(F.radians(q["lat"])) + 1 / F.cos(F.radians(q["lat"]))) / 3.141592653589793) / 2 * n - F.col("y")) * extent).cast("int"))
    rows = full.select("x", "y", "id", F.coalesce("name", F.lit("")).alias("name"), fx.alias("px"), fy.alias("py"))

    def pack(key, df):  # noqa: ANN001, ANN202
        import pandas as pd

        df = df.sort_values("id")
        data = tile_bytes(layer, [list(zip(map(int, a), map(int, b))) for a, b in zip(df["px"], df["py"])], [{"name": v} if v else {} for v in df["name"]], extent)
        return pd.DataFrame({"z": [zoom], "x": [key[0]], "y": [key[1]], "tile": [data]})

    from waymesh.session import ship

    ship(lines.sparkSession)
    return rows.groupBy("x", "y").applyInPandas(pack, "z int, x bigint, y bigint, tile binary")
