"""Edge attributes out of tag maps: one column expression for each attribute.

``ATTRIBUTES`` names every attribute with its expression and what it depends
on; ``derive`` adds any of them to a table with a ``tags`` map in one
projection a level of dependency.  Attributes with two directions have two
columns, ending in ``_fwd`` and ``_bwd``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.text import clean_name, seconds_of_duration

# Fixed values of the tagging scheme.
ROAD_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "service", "road", "track", "bridleway", "steps", "cycleway", "path", "living_street", "footway", "pedestrian", "platform", "corridor", "construction", "busway")
SURFACES = ("paved", "asphalt", "concrete", "paving_stones", "cobblestone", "unpaved", "compacted", "fine_gravel", "gravel", "ground", "dirt", "grass", "sand", "wood")
SURFACE_SYNONYMS = {"metal": "paved", "sett": "cobblestone", "unhewn_cobblestone": "cobblestone", "earth": "dirt", "pebblestone": "gravel", "grass_paver": "grass", "mud": "dirt", "rock": "ground", "wood_chips": "ground"}
SMOOTHNESS = ("excellent", "good", "intermediate", "bad", "very_bad", "horrible", "very_horrible", "impassable")
TRACK_TYPES = ("grade1", "grade2", "grade3", "grade4", "grade5")
ACCESS_VALUES = ("yes", "destination", "customers", "delivery", "private", "agricultural", "forestry", "no")
ACCESS_KEYS = {"car": ("motorcar", "motor_vehicle", "vehicle", "access"), "bike": ("bicycle", "vehicle", "access"), "foot": ("foot", "access"), "bus": ("bus", "psv", "motor_vehicle", "vehicle", "access"), "hgv": ("hgv", "motor_vehicle", "vehicle", "access")}
CLOSED = ("no", "restricted", "military", "emergency", "private", "permit", "service")
CAR_ROADS = {"motorway": 100, "motorway_link": 70, "trunk": 70, "trunk_link": 65, "primary": 65, "primary_link": 60, "secondary": 60, "secondary_link": 50, "tertiary": 50, "tertiary_link": 40, "unclassified": 30, "residential": 30, "living_street": 6, "pedestrian": 6, "service": 20, "road": 20, "track": 15}
BIKE_SPEEDS = {"cycleway": 18, "path": 12, "residential": 18, "service": 14, "unclassified": 16, "track": 12, "tertiary": 18, "secondary": 18, "primary": 18, "living_street": 6, "pedestrian": 6, "footway": 6, "steps": 2}
TRACK_SPEEDS = {"grade1": 20.0, "grade2": 15.0, "grade3": 10.0}
BAD_SURFACES = ("cobblestone", "unhewn_cobblestone", "sett", "grass_paver", "gravel", "fine_gravel", "pebblestone", "sand", "paving_stones", "dirt", "earth", "ground", "wood", "grass", "unpaved", "compacted")
FOOT_ROADS = ("footway", "path", "steps", "pedestrian", "living_street", "track", "residential", "service", "platform", "unclassified", "tertiary", "secondary", "primary", "cycleway", "road", "bridleway")
MAX_SPEED_CAP, MAX_SPEED_FLOOR, WALK_SPEED, MPH, KNOT = 150.0, 4.8, 6.0, 1.609344, 1.852
NETWORK_RANK = {"icn": 1, "ncn": 2, "rcn": 3, "lcn": 4}
NO_VALUE = ("none", "unknown", "unsigned", "fixme", "small")
BAD_PARTS = ("unrestricted", "narrow", ";", ":", "(", ">", "<", "-", ",")
UNLIMITED_ROADS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary")
TUNNEL_CATEGORIES = ("A", "B", "C", "D", "E")
CROSSINGS = ("railway_barrier", "railway", "traffic_signals", "uncontrolled", "marked", "unmarked", "no")
FOOTWAYS = ("sidewalk", "crossing", "access_aisle", "link", "traffic_island", "alley")
HORSE_SCALE = ("common", "demanding", "difficult", "critical", "dangerous", "impossible")
# Countries whose roads bear a toll without a tag: toll of motorways, trunk roads, primary roads and all others.
COUNTRY_TOLLS = {
    ("ROU", "SVK", "SVN"): ("all", "all", "no", "no"),
    ("CHE",): ("all", "all", "hgv", "hgv"),
    ("LIE",): ("hgv", "hgv", "hgv", "hgv"),
    ("HUN",): ("all", "hgv", "hgv", "no"),
    ("DEU", "DNK", "EST", "LTU", "LVA"): ("hgv", "hgv", "hgv", "no"),
    ("BEL", "BLR", "LUX", "POL", "SWE"): ("hgv", "no", "no", "no"),
    ("BGR", "CZE", "FRA", "GRC", "HRV", "ITA", "PRT", "SRB", "ESP"): ("all", "no", "no", "no"),
}


def tag(key: str) -> Column:
    return F.col("tags")[key]


def first_tag(*keys: str) -> Column:
    """Value of the first key that is present."""
    return F.coalesce(*[tag(k) for k in keys])


def one_of(value: Column, allowed: tuple[str, ...], other: str, synonyms: dict[str, str] | None = None) -> Column:
    """``value`` if it is allowed, its synonym if it has one, else ``other``; null becomes ``other``, too."""
    c = F.when(value.isin(*allowed), value)
    for a, b in (synonyms or {}).items():
        c = c.when(value == a, b)
    return c.otherwise(other)


def number(text: Column) -> Column:
    """A text that is a number and nothing else, blanks around it ignored."""
    return F.when(F.trim(text).rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(text)).try_cast("double")


def speed_kmh(text: Column, unlimited: Column | None = None) -> Column:
    """Speed limit in km/h: plain, km/h, mph, knots, walk; below 4.8 missing, at most 150; 'none' is 150 where ``unlimited`` holds, else missing."""
    t = F.trim(text)
    unit = lambda sign, factor: F.when(F.instr(text, sign) > 1, number(F.substring_index(text, sign, 1)) * factor)
    kmh = F.when(t == "walk", WALK_SPEED).when(F.instr(text, "mp") > 1, unit("mp", MPH)).when(F.instr(text, "knots") > 1, unit("knots", KNOT)).when(F.instr(text, "km") > 1, unit("km", 1.0)).when(F.instr(text, "kph") > 1, unit("kph", 1.0)).otherwise(number(text))
    kmh = F.when(kmh >= MAX_SPEED_FLOOR, F.least(kmh, F.lit(MAX_SPEED_CAP)))
    return kmh if unlimited is None else F.when((t == "none") & F.coalesce(unlimited, F.lit(False)), MAX_SPEED_CAP).otherwise(kmh)


def max_speed(forward: bool) -> Column:
    """The limit of the direction if it can be read, else the general one."""
    free = tag("highway").isin(*UNLIMITED_ROADS)
    return F.coalesce(speed_kmh(tag("maxspeed:forward" if forward else "maxspeed:backward"), free), speed_kmh(tag("maxspeed"), free))


def unusable(v: Column) -> Column:
    """Whether a measure (in small letters) says nothing or something other than one value; a comma is no decimal point."""
    hit = (v == "") | v.isin(*NO_VALUE) | v.startswith("default") | v.startswith("〜")
    for part in BAD_PARTS:
        hit = hit | v.contains(part)
    return hit


def metres(text: Column) -> Column:
    """Length in metres: plain or m, ft, in, cm, feet with inches (12'6\"); about (~) is taken as 80 %."""
    v = F.regexp_replace(F.lower(text), "\\s", "")
    for pattern, unit in (("meters?|mtrs?|mt|m\\.", "m"), ("\"|''", "in"), ("'|feet", "ft")):
        v = F.regexp_replace(v, pattern, unit)
    about = v.startswith("~") | v.contains("approx")
    x = F.when(about, F.regexp_replace(v, "~|approx", "")).otherwise(v)
    inches = x.endswith("in")
    cutted = lambda k: F.regexp_extract(x, "^(.*?ft)?(.*)in$", k)
    offset = F.when(inches, number(cutted(2)) * 0.0254).otherwise(0.0)
    body = F.when(inches, cutted(1)).otherwise(x)
    factor = F.when(about, 0.8).otherwise(1.0)
    unit = F.regexp_extract(body, "(ft|cm|m)?$", 1)
    plain = F.regexp_replace(body, "(ft|cm|m)$", "")
    value = number(plain) * factor * F.when(unit == "ft", 0.3048).when(unit == "cm", 0.01).otherwise(1.0)
    return F.when(unusable(v), None).when(body == "", offset).otherwise(value + offset)


def tons(text: Column) -> Column:
    """Weight in metric tons: plain or t, kg, lbs, st (short tons)."""
    v = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "tons?|tonnes?", "t"), "mgw", ""))
    unit = F.regexp_extract(v, "(st|t|lbs|kg)$", 1)
    factor = F.when(unit == "st", 0.907194048807).when(unit == "lbs", 0.00045359237).when(unit == "kg", 0.001).otherwise(1.0)
    return F.when(unusable(v), None).otherwise(number(F.regexp_replace(v, "(st|t|lbs|kg)$", "")) * factor)


def conditional_tons(text: Column) -> Column:
    """The weight of a condition like ``no @ (weight > 7.5)``."""
    return tons(F.regexp_extract(text, "weight ?>([^)]+)", 1))


def max_weight() -> Column:
    """Weight limit: of the conditional bans of heavy vehicles the one of the most general key, else the plain tags."""
    bans = [F.when(tag(f"{k}:conditional").rlike("^no[^@]{0,3}@"), conditional_tons(tag(f"{k}:conditional"))) for k in ACCESS_KEYS["hgv"][::-1]]
    return F.coalesce(*bans, tons(first_tag("maxweight", "maxweightrating", "maxweightrating:hgv", "maxgcweight")))


def max_weight_except() -> Column:
    """Who may pass a weight limit: delivery, destination, forestry or missing."""
    named = lambda c: F.when(F.lower(c).isin("permit", "private"), "delivery").when(F.lower(c).isin("delivery", "destination", "forestry"), F.lower(c)).otherwise("missing")
    cond = F.split(tag("maxweight:conditional"), "@")
    who = F.regexp_replace(F.trim(F.get(cond, 1)), "^\\((.*)\\)$", "$1")
    found = F.when((F.size(cond) == 2) & F.trim(F.get(cond, 0)).isin("no", "none"), named(who))
    same = lambda c: F.coalesce(*[F.when(tons(tag(k)) == c, True) for k in ("maxweight", "maxweightrating:hgv", "maxgcweight")])
    for key in ACCESS_KEYS["hgv"]:
        v = tag(f"{key}:conditional")
        found = F.coalesce(found, F.when((F.instr(v, "@") > 1) & same(conditional_tons(v)), named(F.trim(F.substring_index(v, "@", 1)))))
    return F.coalesce(found, F.lit("missing"))


def hazmat_tunnel() -> Column:
    """Tunnel category A to E by its tag, else in tunnels the strictest that is barred; A if none is."""
    of = [F.when(tag(k).isin(*TUNNEL_CATEGORIES), tag(k)) for k in ("hazmat:adr_tunnel_cat", "hazmat:tunnel_cat")]
    barred = [F.when((tag("tunnel") == "yes") & (tag(f"hazmat:{c}") == "no"), c) for c in TUNNEL_CATEGORIES[::-1]]
    return F.coalesce(*of, *barred, F.lit(TUNNEL_CATEGORIES[0]))


def crossing(node_tags: Column) -> Column:
    """Crossing of an edge by the tags of its nodes (array of maps) in order: railways, signals and markings decide at once, later values replace earlier ones."""

    def step(now: Column, t: Column) -> Column:
        is_ = lambda k, v: F.coalesce(t[k] == v, F.lit(False))
        gate = F.coalesce(t["crossing:barrier"], F.lit("no"))
        value = F.coalesce(F.lower(t["crossing"]), F.lit(""))
        bare = (value == "") & (is_("crossing:signals", "no") | is_("crossing:markings", "no") | is_("highway", "crossing") | is_("footway", "crossing") | is_("cycleway", "crossing"))
        new = (
            F.when(is_("railway", "crossing") | is_("railway", "level_crossing"), F.struct(F.lit(True).alias("done"), F.when(gate.isin("no", ""), "railway").otherwise("railway_barrier").alias("v")))
            .when(is_("crossing:signals", "yes"), F.struct(F.lit(True).alias("done"), F.lit("traffic_signals").alias("v")))
            .when(is_("crossing:markings", "yes"), F.struct(F.lit(True).alias("done"), F.lit("marked").alias("v")))
            .when(bare, F.struct(F.lit(False).alias("done"), F.lit("unmarked").alias("v")))
            .when(value.isin(*CROSSINGS), F.struct(F.lit(False).alias("done"), value.alias("v")))
            .otherwise(now)
        )
        return F.when(now["done"], now).otherwise(new)

    start = F.struct(F.lit(False).alias("done"), F.lit("missing").alias("v"))
    return F.aggregate(F.coalesce(node_tags, F.array().cast("array<map<string,string>>")), start, step)["v"]


def lanes() -> Column:
    """First number of ``lanes``, kept in 1..6; 1 if missing."""
    n = F.split(tag("lanes"), "[;.]")[0].try_cast("int")
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(6), n)), F.lit(1))


def access(mode: str) -> Column:
    """Access by the most specific key present; ``yes`` if none is."""
    return one_of(first_tag(*ACCESS_KEYS[mode]), ACCESS_VALUES, "yes", {k: "no" for k in CLOSED if k not in ACCESS_VALUES} | {"designated": "yes", "permissive": "yes"})


def oneway(forward: bool) -> Column:
    """Whether driving in a direction is allowed by oneway, roundabout and motorway tags."""
    against = tag("oneway").isin("-1", "reverse")
    along = tag("oneway").isin("yes", "true", "1") | tag("junction").isin("roundabout", "circular") | (tag("highway") == "motorway")
    return ~F.coalesce(against if forward else along & ~F.coalesce(against, F.lit(False)) & (F.coalesce(tag("oneway"), F.lit("")) != "no"), F.lit(False))


def car_access(forward: bool) -> Column:
    road = tag("highway").isin(*[k for k in CAR_ROADS if k != "pedestrian"]) | ((tag("route") == "ferry") & F.coalesce(first_tag("motorcar", "motor_vehicle"), F.lit("yes")).isin("yes", "designated"))
    rough = (tag("highway") == "track") & tag("tracktype").isin("grade4", "grade5")
    closed = first_tag(*ACCESS_KEYS["car"]).isin(*CLOSED, "agricultural", "forestry", "delivery")
    ford = (tag("ford").isNotNull() | (tag("highway") == "ford")) & ~F.coalesce(first_tag("motorcar", "motor_vehicle").isin("yes"), F.lit(False))
    no = F.lit(False)
    return F.coalesce(road, no) & ~F.coalesce(rough, no) & ~F.coalesce(closed, no) & ~F.coalesce(ford, no) & oneway(forward)


def is_ferry() -> Column:
    return F.coalesce(tag("route").isin("ferry", "shuttle_train"), F.lit(False))


def car_speed(forward: bool = True, distance_m: Column | None = None) -> Column:
    """Usual speed by road, at most 30 on bad surfaces, and 90 % of the limit of the direction where one is given.

    Unknown roads have 10.  Ferries go by their own speed where the length of
    the edge is at hand.
    """
    base = F.lit(10.0)
    for k, v in CAR_ROADS.items():
        base = F.when(tag("highway") == k, float(v)).otherwise(base)
    for grade, v in TRACK_SPEEDS.items():
        base = F.when((tag("highway") == "track") & (tag("tracktype") == grade), v).otherwise(base)
    limit = max_speed(forward)
    bad = F.coalesce(F.substring_index(tag("surface"), ":", 1).isin(*BAD_SURFACES), F.lit(False))
    road = F.round(F.when(limit.isNotNull(), F.greatest(F.lit(1.0), limit * 0.9)).when(bad, F.least(base, F.lit(30.0))).otherwise(base), 1)
    return road if distance_m is None else F.when(is_ferry(), ferry_speed(distance_m)).otherwise(road)


def bike_speed() -> Column:
    """Usual speed by road, slower on rough ground, never above a speed limit."""
    base = F.lit(10.0)
    for k, v in BIKE_SPEEDS.items():
        base = F.when(tag("highway") == k, float(v)).otherwise(base)
    base = F.when(tag("surface").isin("gravel", "sand", "grass", "cobblestone"), F.least(base, F.lit(8.0))).otherwise(base)
    base = base * F.when(tag("smoothness").isin("bad", "very_bad"), 0.7).when(tag("smoothness").isin("horrible", "very_horrible", "impassable"), 0.3).otherwise(1.0)
    return F.round(F.least(base, F.coalesce(speed_kmh(tag("maxspeed")), F.lit(999.0))), 1)


def bike_priority() -> Column:
    """Preference 0..1.3: rules of higher order win, as if put into a sorted map and read from its end."""
    rules = [(0, F.lit(True), 1.0), (40, tag("highway").isin("cycleway", "living_street"), 1.2), (50, tag("highway").isin("primary", "trunk", "secondary"), 0.7), (60, tag("bicycle") == "use_sidepath", 0.5), (80, tag("class:bicycle").isin("2", "3"), 1.3), (100, tag("bicycle") == "no", 0.1)]
    best = F.array_max(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(o).alias("o"), F.lit(v).alias("v"))) for o, c, v in rules]))
    return best["v"]


def ferry_speed(distance_m: Column) -> Column:
    """Whole km/h from the duration, lengthened by 40 % for waiting; without a usable one 1 below 500 m, else 6."""
    kmh = distance_m / seconds_of_duration(tag("duration")) * 3.6
    return F.when(kmh >= 0.1, F.floor(kmh / 1.4 + 0.5).cast("double")).when(distance_m < 500, 1.0).otherwise(6.0)


def toll(country: Column) -> Column:
    """Toll tags, else the habit of the country for the class of road."""
    heavy = F.coalesce(*[F.when(tag(k) == "yes", True) for k in ("toll:hgv", "toll:N2", "toll:N3")], F.lit(False))
    t = F.when(tag("toll") == "yes", "all").when(heavy, "hgv").when(tag("toll") == "no", "no")
    for countries, kinds in COUNTRY_TOLLS.items():
        usual = F.lit(kinds[3])
        for road, kind in zip(("motorway", "trunk", "primary"), kinds):
            usual = F.when(tag("highway") == road, kind).otherwise(usual)
        t = t.when(country.isin(*countries), usual)
    return t.otherwise("no")


def environment() -> Column:
    """ferry before bridge before tunnel before ford; else road if there is a highway tag."""
    return F.when(tag("route").isin("ferry", "shuttle_train"), "ferry").when(F.coalesce(tag("bridge"), F.lit("no")) != "no", "bridge").when(F.coalesce(tag("tunnel"), F.lit("no")) != "no", "tunnel").when((tag("highway") == "ford") | tag("ford").isNotNull(), "ford").when(tag("highway").isNotNull(), "road").otherwise("other")


@dataclass(frozen=True)
class Attribute:
    make: Callable[[], Column]
    needs: tuple[str, ...] = ()


ATTRIBUTES: dict[str, Attribute] = {
    "road_class": Attribute(lambda: one_of(F.regexp_replace(tag("highway"), "_link$", ""), ROAD_CLASSES, "other")),
    "road_class_link": Attribute(lambda: F.coalesce(tag("highway").endswith("_link"), F.lit(False))),
    "road_environment": Attribute(environment),
    "surface": Attribute(lambda: one_of(tag("surface"), SURFACES, "missing" , SURFACE_SYNONYMS)),
    "smoothness": Attribute(lambda: one_of(tag("smoothness"), SMOOTHNESS, "missing")),
    "track_type": Attribute(lambda: one_of(tag("tracktype"), TRACK_TYPES, "missing")),
    "lanes": Attribute(lanes),
    "max_speed_fwd": Attribute(lambda: max_speed(True)),
    "max_speed_bwd": Attribute(lambda: max_speed(False)),
    "max_weight": Attribute(max_weight),
    "max_weight_except": Attribute(max_weight_except),
    "max_height": Attribute(lambda: metres(first_tag("maxheight", "maxheight:physical"))),
    "max_width": Attribute(lambda: metres(first_tag("maxwidth", "maxwidth:physical", "width"))),
    "max_length": Attribute(lambda: metres(tag("maxlength"))),
    "max_axle_load": Attribute(lambda: tons(tag("maxaxleload"))),
    "hgv": Attribute(lambda: one_of(tag("hgv"), ACCESS_VALUES, "missing", {"designated": "yes"})),
    "hazmat": Attribute(lambda: F.when(tag("hazmat") == "no", "no").otherwise("yes")),
    "hazmat_tunnel": Attribute(hazmat_tunnel),
    "hazmat_water": Attribute(lambda: F.when(tag("hazmat:water").isin("no", "permissive"), tag("hazmat:water")).otherwise("yes")),
    "footway": Attribute(lambda: one_of(F.lower(tag("footway")), FOOTWAYS, "missing")),
    "horse_rating": Attribute(lambda: F.when(tag("horse_scale").isNull(), 0).otherwise(F.array_position(F.array(*map(F.lit, HORSE_SCALE)), tag("horse_scale")).cast("int"))),
    "roundabout": Attribute(lambda: F.coalesce(tag("junction").isin("roundabout", "circular"), F.lit(False))),
    "get_off_bike": Attribute(lambda: F.coalesce((tag("bicycle") == "dismount") | (tag("highway").isin("steps", "footway", "pedestrian") & ~F.coalesce(tag("bicycle").isin("yes", "designated"), F.lit(False))), F.lit(False))),
    "hike_rating": Attribute(lambda: F.when(tag("sac_scale").isNull(), 0).otherwise(F.array_position(F.array(*map(F.lit, ("hiking", "mountain_hiking", "demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking"))), tag("sac_scale")).cast("int"))),
    "mtb_rating": Attribute(lambda: F.coalesce(F.regexp_extract(tag("mtb:scale"), "^([0-6])[+-]?$", 1).try_cast("int") + 1, F.lit(0))),
    "name": Attribute(lambda: clean_name(first_tag("name:en", "name"))),
    "ref": Attribute(lambda: clean_name(tag("ref"))),
    "road_access": Attribute(lambda: access("car")),
    "bike_road_access": Attribute(lambda: access("bike")),
    "foot_road_access": Attribute(lambda: access("foot")),
    "bus_access": Attribute(lambda: ~access("bus").isin("no", "private")),
    "car_access_fwd": Attribute(lambda: car_access(True)),
    "car_access_bwd": Attribute(lambda: car_access(False)),
    "bike_access_fwd": Attribute(lambda: ~access("bike").isin("no", "private") & F.coalesce(tag("highway") != "motorway", F.lit(True)) & (oneway(True) | F.coalesce(tag("oneway:bicycle") == "no", F.lit(False)))),
    "bike_access_bwd": Attribute(lambda: ~access("bike").isin("no", "private") & F.coalesce(tag("highway") != "motorway", F.lit(True)) & (oneway(False) | F.coalesce(tag("oneway:bicycle") == "no", F.lit(False)))),
    "foot_access": Attribute(lambda: F.coalesce(tag("highway").isin(*FOOT_ROADS) | first_tag("foot", "sidewalk").isin("yes", "both", "left", "right", "designated"), F.lit(False)) & ~access("foot").isin("no", "private")),
    "car_average_speed": Attribute(car_speed),
    "car_average_speed_bwd": Attribute(lambda: car_speed(False)),
    "bike_average_speed": Attribute(bike_speed),
    "bike_priority": Attribute(bike_priority),
    "foot_average_speed": Attribute(lambda: F.when(F.col("hike_rating") > 1, 2.0).otherwise(5.0), ("hike_rating",)),
    "car_time_s_per_km": Attribute(lambda: F.round(3600 / F.col("car_average_speed"), 3), ("car_average_speed",)),
}


def derive(ways: DataFrame, names: list[str]) -> DataFrame:
    """Add attributes by name, those they depend on first; unknown names raise KeyError.

    A null tag map has no tags.
    """
    unknown = [n for n in names if n not in ATTRIBUTES]
    if unknown:
        raise KeyError(f"unknown attributes: {unknown}")
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for k in ATTRIBUTES[n].needs:
                visit(k)
            order.append(n)

    for n in names:
        visit(n)
    level: dict[str, int] = {}
    for n in order:
        level[n] = 1 + max((level[k] for k in ATTRIBUTES[n].needs), default=-1)
    out = ways.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))
    for lv in sorted(set(level.values())):
        out = out.withColumns({n: ATTRIBUTES[n].make() for n in order if level[n] == lv})
    return out


def network_of_ways(relations: DataFrame) -> DataFrame:
    """(way_id, network, rank): of route relations(members, tags) the highest ranking network of each way."""
    m = relations.filter(tag("type") == "route").select(F.explode("members").alias("m"), F.coalesce(tag("network"), F.lit("lcn")).alias("network")).filter("m.type = 'way'")
    rank = F.lit(9)
    for k, v in NETWORK_RANK.items():
        rank = F.when(F.col("network") == k, v).otherwise(rank)
    return m.groupBy(F.col("m.ref").alias("way_id")).agg(F.min(F.struct(rank.alias("rank"), "network")).alias("b")).select("way_id", F.col("b.network").alias("network"), F.col("b.rank").alias("rank"))


def segments(ways: DataFrame) -> DataFrame:
    """Split ways(id, refs) at nodes used more than once and at their ends: (way_id, segment, nodes).

    A node used twice counts wherever it occurs, so loops are split, too.
    """
    uses = ways.select("id", F.posexplode("refs").alias("pos", "node"), F.size("refs").alias("n"))
    shared = uses.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.max(((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)).cast("int")).alias("end")).filter("c > 1 or end = 1").select("node", F.lit(1).alias("tower"))
    w = Window.partitionBy("id").orderBy("pos")
    u = uses.join(shared, "node", "left").withColumn("t", F.coalesce("tower", F.lit(0)))
    u = u.withColumn("s", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    inner = u.filter("pos > 0").select("id", "s", "pos", "node").unionByName(u.filter("t = 1 and pos < n - 1").select("id", (F.coalesce("s", F.lit(0)) + 1).alias("s"), "pos", "node"))
    return inner.groupBy(F.col("id").alias("way_id"), (F.col("s") - 1).alias("segment")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("nodes"))
