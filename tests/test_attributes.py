"""Attributes against values written by hand from the tagging scheme."""

import pytest
from pyspark.sql import functions as F

from waymesh.operators import attributes as a


def each(spark, column, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, tags map<string,string>")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_limits(spark):
    tags = [
        {"maxspeed": "50"}, {"maxspeed": "30 mph"}, {"maxspeed": " walk "}, {"maxspeed": "none"}, {"maxspeed": "none", "highway": "motorway"}, {"maxspeed": "none", "highway": "primary_link"}, {"maxspeed": "3"}, {"maxspeed": "180"},
        {"maxspeed": "50", "maxspeed:forward": "70"}, {"maxspeed": "50", "maxspeed:forward": "signals"}, {"maxspeed": "60 km/h"}, {"maxspeed": "60kph"}, {"maxspeed": "50;70"}, {"maxspeed": "3,5"}, {"maxspeed": "3 mph"}, {},
    ]
    got = each(spark, a.max_speed(True), tags)
    assert got == [50, pytest.approx(48.28032), 6, None, 150, None, None, 150, 70, 50, 60, 60, None, None, pytest.approx(4.828032), None]


def test_measures(spark):
    texts = ["4", "4.5 m", "12'6\"", "12' 6''", "6 in", "14ft", "350 cm", "~4", "approx 4 m", "3,5", "none", "default", "no_sign", "3-4", "4 meters", "4m.", "", "unrestricted", "4;5"]
    got = each(spark, a.metres(a.tag("x")), [{"x": t} for t in texts])
    want = [4, 4.5, 12 * 0.3048 + 6 * 0.0254, 12 * 0.3048 + 6 * 0.0254, 6 * 0.0254, 14 * 0.3048, 3.5, 3.2, 3.2, None, None, None, None, None, 4, 4, None, None, None]
    assert [x is None for x in got] == [x is None for x in want] and [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])
    texts = ["7.5", "7.5 t", "7500 kg", "2 tons", "16000lbs", "3 st", "3,5", "none", "7.5 mgw", "7.5t;8t"]
    got = each(spark, a.tons(a.tag("x")), [{"x": t} for t in texts])
    want = [7.5, 7.5, 7.5, 2, 16000 * 0.00045359237, 3 * 0.907194048807, None, None, 7.5, None]
    assert [x is None for x in got] == [x is None for x in want] and [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])


def test_weights_with_conditions(spark):
    tags = [{"maxweight": "7.5"}, {"hgv:conditional": "no @ (weight > 3.5)", "maxweight": "12"}, {"vehicle:conditional": "none @ weight>2"}, {"hgv:conditional": "delivery @ (weight > 3.5)", "maxweight": "3.5"}, {"maxweight:conditional": "none @ (destination)"}, {"maxweight:conditional": "no @ private"}]
    assert each(spark, a.max_weight(), tags) == [7.5, 3.5, 2, 3.5, None, None]
    assert each(spark, a.max_weight_except(), tags) == ["missing", "missing", "missing", "delivery", "destination", "delivery"]


def test_speeds(spark):
    tags = [{"highway": "motorway"}, {"highway": "motorway", "maxspeed": "none"}, {"highway": "primary", "surface": "sett"}, {"highway": "service", "surface": "sett"}, {"highway": "strange"}, {"highway": "track", "tracktype": "grade3"}, {"highway": "primary", "surface": "gravel:lanes"}, {"highway": "residential", "maxspeed": "50", "maxspeed:backward": "20"}, {}]
    assert each(spark, a.car_speed(), tags) == [100, 135, 30, 20, 10, 10, 30, 45, 10]
    assert each(spark, a.car_speed(False), tags)[7] == 18
    ferry = [{"route": "ferry", "duration": "01:00"}, {"route": "ferry"}, {"highway": "primary"}]
    assert each(spark, a.car_speed(True, F.lit(14_000.0)), ferry) == [10, 6, 65]
    assert each(spark, a.ferry_speed(F.lit(300.0)), [{}]) == [1]


def test_small_families(spark):
    assert each(spark, a.hazmat_tunnel(), [{"hazmat:adr_tunnel_cat": "C"}, {"tunnel": "yes", "hazmat:B": "no", "hazmat:D": "no"}, {"hazmat:D": "no"}, {}]) == ["C", "D", "A", "A"]
    assert each(spark, a.toll(F.lit("HUN")), [{"highway": "trunk"}, {"toll": "yes"}, {"toll:N3": "yes"}, {"toll": "no", "highway": "motorway"}, {}]) == ["hgv", "all", "hgv", "no", "no"]
    got = a.derive(spark.createDataFrame([({"horse_scale": "critical", "mtb:scale": "2+", "footway": "sidewalk"},), ({"horse_scale": "x", "mtb:scale": "2x", "footway": "?"},), (None,)], "tags map<string,string>"), ["horse_rating", "mtb_rating", "footway", "hazmat_water"]).drop("tags").collect()
    assert [tuple(r) for r in got] == [(4, 3, "sidewalk", "yes"), (0, 0, "missing", "yes"), (0, 0, "missing", "yes")]
    nodes = [[{}, {"railway": "level_crossing", "crossing:barrier": "full"}, {"crossing": "marked"}], [{"highway": "crossing"}, {"crossing": "UNCONTROLLED"}, {"x": "y"}], [{"crossing:signals": "yes"}, {"railway": "crossing"}], [{"crossing": "zebra"}], [], None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(nodes)], "i int, n array<map<string,string>>")
    assert [r["v"] for r in df.select("i", a.crossing(F.col("n")).alias("v")).orderBy("i").collect()] == ["railway_barrier", "uncontrolled", "traffic_signals", "missing", "missing", "missing"]
