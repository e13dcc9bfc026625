import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.operators import attributes
from waymesh.sources import feeds, osm

XML = """<?xml version="1.0"?><osm>
<node id="1" lat="47.0" lon="8.0"/><node id="2" lat="47.001" lon="8.0"><tag k="barrier" v="gate"/></node><node id="3" lat="47.002" lon="8.0"/><node id="4" lat="47.001" lon="8.001"/><node id="5" lat="47.001" lon="7.999"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="name" v="A;B"/></way>
<way id="11"><nd ref="5"/><nd ref="2"/><nd ref="4"/><tag k="highway" v="primary_link"/><tag k="maxspeed" v="30 mph"/><tag k="oneway" v="yes"/></way>
<way id="12"><nd ref="4"/><nd ref="99"/><tag k="building" v="yes"/></way>
<way id="-13"><nd ref="1"/><tag k="highway" v="path"/></way>
<relation id="20"><member type="way" ref="10" role="from"/><member type="node" ref="2" role="via"/><member type="way" ref="11" role="to"/><tag k="type" v="restriction"/><tag k="restriction" v="no_left_turn"/></relation>
<relation id="21"><member type="way" ref="10" role=""/><tag k="type" v="route"/><tag k="network" v="rcn"/></relation>
<relation id="22"><member type="way" ref="10" role=""/><tag k="type" v="route"/><tag k="network" v="ncn"/></relation>
</osm>"""


def check(tables):
    n = {r["id"]: r for r in tables["nodes"].collect()}
    assert len(n) == 5 and n[2]["tags"] == {"barrier": "gate"} and n[1]["tags"] == {} and abs(n[4]["lon"] - 8.001) < 1e-7
    w = {r["id"]: r for r in tables["ways"].collect()}
    assert w[10]["refs"] == [1, 2, 3] and w[11]["tags"]["maxspeed"] == "30 mph"
    nodes, edges = osm.graph(tables)
    e = {(r["way_id"], r["node_a"], r["node_b"]): r for r in edges.collect()}
    assert set(e) == {(10, 1, 2), (10, 2, 3), (11, 5, 2), (11, 2, 4)}
    assert abs(e[10, 1, 2]["dist_m"] - 111.19) < 0.1 and {r["node"] for r in nodes.collect()} == {1, 2, 3, 4, 5}
    rules = osm.restrictions(tables["relations"])
    ids = {v["edge"]: k for k, v in e.items()}
    turns = {(ids[r["from_edge"]], ids[r["to_edge"]]) for r in osm.forbidden_turns(edges, rules).collect()}
    assert turns == {((10, 1, 2), (11, 5, 2)), ((10, 1, 2), (11, 2, 4)), ((10, 2, 3), (11, 5, 2)), ((10, 2, 3), (11, 2, 4))}
    a = {r["way_id"]: r for r in attributes.derive(edges, ["road_class", "max_speed_fwd", "car_access_fwd", "car_access_bwd", "name", "foot_average_speed"]).collect()}
    assert a[10]["name"] == "A, B" and a[11]["road_class"] == "primary" and abs(a[11]["max_speed_fwd"] - 48.28) < 0.01
    assert a[11]["car_access_fwd"] and not a[11]["car_access_bwd"] and a[10]["car_access_bwd"] and a[10]["foot_average_speed"] == 5.0
    net = attributes.network_of_ways(tables["relations"]).collect()
    assert [(r["way_id"], r["network"]) for r in net] == [(10, "ncn")]


def test_osm_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text(XML)
    check(osm.read_xml(spark, str(tmp_path / "a.osm")))


def pbf():
    """The same elements in wire format."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(XML)
    strings = [""]
    s = lambda t: strings.index(t) if t in strings else (strings.append(t), len(strings) - 1)[1]
    var = lambda ns: b"".join(feeds.message((0, n))[1:] for n in ns)
    zig = lambda n: (n << 1) ^ (n >> 63)
    delta = lambda xs: var(zig(b - a) for a, b in zip([0, *xs], xs))
    tags = lambda e: [(s(t.get("k")), s(t.get("v"))) for t in e.iter("tag")]
    nodes = list(root.iter("node"))
    kv = [x for n in nodes for x in (*(i for p in tags(n) for i in p), 0)]
    deg = lambda n, c: round(float(n.get(c)) * 1e7)
    dense = feeds.message((1, delta([int(n.get("id")) for n in nodes])), (8, delta([deg(n, "lat") for n in nodes])), (9, delta([deg(n, "lon") for n in nodes])), (10, var(kv)))
    groups = [(2, feeds.message((2, dense)))]
    ways = [feeds.message((1, int(w.get("id"))), (2, var(a for a, _ in tags(w))), (3, var(b for _, b in tags(w))), (8, delta([int(x.get("ref")) for x in w.iter("nd")]))) for w in root.iter("way") if int(w.get("id")) > 0]
    groups.append((2, feeds.message(*[(3, w) for w in ways])))
    kinds = {"node": 0, "way": 1, "relation": 2}
    rels = [feeds.message((1, int(r.get("id"))), (2, var(a for a, _ in tags(r))), (3, var(b for _, b in tags(r))), (8, var(s(m.get("role")) for m in r.iter("member"))), (9, delta([int(m.get("ref")) for m in r.iter("member")])), (10, var(kinds[m.get("type")] for m in r.iter("member")))) for r in root.iter("relation")]
    groups.append((2, feeds.message(*[(4, r) for r in rels])))
    block = feeds.message((1, feeds.message(*[(1, t) for t in strings])), *groups)
    out = b""
    for kind, data in (("OSMHeader", b""), ("OSMData", block)):
        blob = feeds.message((2, len(data)), (3, zlib.compress(data)))
        head = feeds.message((1, kind), (3, len(blob)))
        out += struct.pack(">I", len(head)) + head + blob
    return out


def test_osm_pbf(spark, tmp_path):
    (tmp_path / "a.osm.pbf").write_bytes(pbf())
    check(osm.read_pbf(spark, str(tmp_path / "a.osm.pbf")))


def test_feed(spark, tmp_path):
    (tmp_path / "stop_times.txt").write_text("﻿trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,25:00:10,x,\"S,1\",3\n")
    (tmp_path / "calendar_dates.txt").write_text("service_id,date,exception_type\nA,20240229,1\nA,20230229,2\n")
    t = feeds.read_feed(spark, str(tmp_path))
    r = t["stop_times"].head()
    assert tuple(r) == ("T1", 90010, None, "S,1", 3)
    assert [str(x["date"]) for x in t["calendar_dates"].collect()] == ["2024-02-29", "None"]
    feeds.write_feed({"stop_times": t["stop_times"]}, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/stop_times"), header=True).count() == 1


def test_gpx_round_trip(spark, tmp_path):
    text = '<gpx xmlns="http://www.topografix.com/GPX/1/0"><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>7</ele><time>2024-01-02T03:04:05Z</time></trkpt><trkpt lat="1.6" lon="2.6"/></trkseg><trkseg/></trk></gpx>'
    (tmp_path / "a.gpx").write_text(text)
    (tmp_path / "b.gpx").write_text("<gpx><wpt lat='1' lon='1'/></gpx>")
    (tmp_path / "c.gpx").write_text("<gpx")
    rows = feeds.read_gpx(spark, str(tmp_path / "*.gpx")).orderBy("seq")
    got = rows.collect()
    assert [(r["lat"], r["lon"], r["ele"], r["ts"] is None) for r in got] == [(1.5, 2.5, 7.0, False), (1.6, 2.6, None, True)]
    out = feeds.gpx_text(rows).head()["gpx"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/again.gpx").write_text(out)
    again = feeds.read_gpx(spark, str(tmp_path / "d/*.gpx")).orderBy("seq").collect()
    assert [tuple(r)[3:] for r in again] == [tuple(r)[3:] for r in got]


def test_areas_round_trip(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    fc = {"type": "FeatureCollection", "features": [{"id": "a", "properties": {"k": "v", "n": 3}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}}, {"id": "p", "properties": None, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "x.json").write_text(json.dumps(fc))
    a = feeds.read_areas(spark, str(tmp_path / "x.json"))
    got = sorted((r["area_id"], len(r["rings"])) for r in a.collect())
    assert got == [("a", 1), ("x.json#1", 1), ("x.json#1", 2)]
    f = json.loads(feeds.geojson_features(a.filter("area_id = 'a'")).head()["feature"])
    assert f["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]] and f["properties"]["n"] == "3"


def test_elevation(spark, tmp_path):
    grid = np.arange(9, dtype=">i2").reshape(3, 3) * 10
    grid = grid.astype(">i2")
    grid[2, 2] = -32768
    (tmp_path / "N47E008.hgt").write_bytes(grid.tobytes())
    tiles = feeds.read_hgt(spark, str(tmp_path / "*.hgt"))
    pts = spark.createDataFrame([(1, 47.99, 8.01), (2, 47.5, 8.5), (3, 47.01, 8.99), (4, -3.2, -1.5)], "id bigint, lat double, lon double")
    assert {r["id"]: r["ele"] for r in feeds.elevations(pts, tiles).collect()} == {1: 0.0, 2: 40.0, 3: 0.0, 4: 0.0}
    assert feeds.tile_name(-4, -2) == "S04W002"


def test_graph_store(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 5)], "src bigint, dst bigint, w bigint")
    feeds.save_graph({"edges": e}, str(tmp_path / "g"), name="x")
    tables, info = feeds.load_graph(spark, str(tmp_path / "g"))
    assert tables["edges"].collect() == e.collect() and info == {"name": "x"}
    e.withColumn("w", F.col("w").cast("string")).write.mode("overwrite").parquet(str(tmp_path / "g/edges"))
    with pytest.raises(ValueError):
        feeds.load_graph(spark, str(tmp_path / "g"))


def test_realtime_and_tiles(spark, tmp_path):
    m = feeds.message
    stop = lambda n, d: m((1, n), (2, m((1, d))), (3, m((1, d + 5))))
    data = m((1, m((3, 1700000000))), (2, m((1, "e1"), (3, m((1, m((1, "T1"), (2, "07:00:00"))), (2, stop(2, -30)), (2, m((1, 3), (5, 1))))))))
    (tmp_path / "u.pb").write_bytes(data)
    got = [tuple(r) for r in feeds.read_updates(spark, str(tmp_path / "u.pb")).collect()]
    assert got == [(1700000000, "T1", "07:00:00", 0, 2, -30, -25, False), (1700000000, "T1", "07:00:00", 0, 3, None, None, True)]
    line = spark.createDataFrame([(1, [(47.0, 8.0), (47.0, 8.00001)], "A"), (2, [(47.0, 8.0), (47.2, 8.4)], None)], "id bigint, points array<struct<lat:double,lon:double>>, name string")
    tiles = feeds.vector_tiles(line, 12).collect()
    assert len(tiles) == 2
    both = [feeds.decode_tile(bytes(t["tile"])) for t in tiles]
    assert sorted(len(x) for x in both) == [1, 2]
    names = {tuple(sorted(a.items())) for t in both for _, _, a in t}
    assert names == {(("name", "A"),), ()}


def test_model_comments():
    assert feeds.read_model('{ // c\n "a": "x // y", /* z */ "b": 1 # d\n}') == {"a": "x // y", "b": 1}
