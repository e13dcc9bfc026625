"""Attributes, sequences, transit and matching over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions import text
from waymesh.operators import attributes, matching, sequences, transit
from waymesh.plans import derived
from waymesh.plans.derived import BASE_SQL
from waymesh.session import table

_HIGHWAYS = ("motorway", "primary_link", "residential", "track", "nonsense")
_SPEEDS = ("50", "30 mph", "walk", "none", "3", "20 knots", "sign")


def ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways with tags made of part rows, for attribute queries."""
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int") + 1)
    tags = F.map_from_arrays(F.array(*[F.lit(x) for x in ("highway", "maxspeed", "lanes", "oneway", "surface", "maxheight", "bicycle")]), F.array(pick(_HIGHWAYS), pick(_SPEEDS), F.concat((k % 9).cast("string"), F.lit(";x")), pick(("no", "yes", "-1", "maybe")), pick(("asphalt", "sett", "gravel", "?")), pick(("4.2", "12'6\"", "13 ft", "none")), pick(("no", "use_sidepath", "yes", "dismount", "x", "y"))))
    return table(spark, d, "part").select(k.alias("id"), tags.alias("tags"))


def _attrs(*names: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return attributes.derive(ways(spark, d), list(names)).select("id", *names)

    return run


def attr_json_tags(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).alias("n"))


_WEIGHTS = ("7.5", "7.5 t", "7500kg", "3,5", "none", "2 st", "16000 lbs", "5t;7t")
_MEASURES = ("4.2", "4.2 m", "14'", "14 ft", "13'6\"", "380cm", "~4.0", "3,8", "none", "below_default", "3.5-4.0", "4 metres")
_TOLLS = ("yes", "no", "")
_COUNTRIES = ("ROU", "CHE", "LIE", "HUN", "DEU", "POL", "FRA", "AUT")
_ROADS = ("motorway", "trunk", "primary", "residential")


def _pick(values: tuple[str, ...], by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _tagged(spark, d, **tags):
    k = F.col("p_partkey")
    pairs = [x for name, (values, step) in tags.items() for x in (F.lit(name.replace("__", ":")), _pick(values, F.floor(k / step)))]
    return table(spark, d, "part").select(k.alias("id"), F.create_map(*pairs).alias("tags"))


def attr_weights(spark, d):
    return attributes.derive(_tagged(spark, d, maxweight=(_WEIGHTS, 1), maxheight=(_MEASURES, 1)), ["max_weight", "max_height"]).select("id", F.round("max_weight", 6).alias("max_weight"), F.round("max_height", 6).alias("max_height"))


def attr_toll(spark, d):
    ways = _tagged(spark, d, toll=(_TOLLS, 1), highway=(_ROADS, 3))
    return ways.select("id", attributes.toll(_pick(_COUNTRIES, F.floor(F.col("id") / 12))).alias("toll"))


def attr_ferry_speed(spark, d):
    ways = _tagged(spark, d, duration=(("00:20", "01:30", "x"), 1))
    return ways.select("id", attributes.ferry_speed((F.col("id") * 37 % 40_000).cast("double")).alias("speed"))


def path_detail_islands(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return sequences.runs(e, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "run", "event_type", "first", "last", "rows")


def trace_gaps(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return sequences.sessions(e, ["user_id"], "ts", "event_id", 6 * 3600).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


def ascend_descend(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.floor("value").cast("bigint").alias("ele"))
    return sequences.climbs(e, ["user_id"], ["ts", "event_id"], "ele")


def cumulative_distance(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.floor("value").cast("bigint").alias("m"))
    return sequences.running_total(e, ["user_id"], ["ts", "event_id"], "m", "total").select("event_id", "total")


def moving_average_range(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("double").alias("v"))
    return sequences.moving_average(e, ["user_id"], "event_id", "v", 500, "mean").select("event_id", F.round("mean", 6).alias("mean"))


def stop_time_interpolation(spark, d):
    c = derived.calls(spark, d).select("trip", "seq", F.when((F.col("seq") % 3 == 1), F.col("arrival_s")).cast("double").alias("t"), (F.col("seq") * F.col("seq")).alias("m"))
    return sequences.interpolate(c, ["trip"], ["seq"], "t", "m").select("trip", "seq", F.round("t", 6).alias("t"))


def turn_sign_lag(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = (F.floor("value").cast("bigint") % 7 - 3) / 1.5
    return table(spark, d, "events").select("event_id", "user_id", "ts", a.alias("a")).select("event_id", sequences.turn_sign(F.col("a") - F.lag("a").over(w)).alias("sign"))


def trace_thinning(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return sequences.thin(e, ["user_id"], ["ts", "event_id"], "value", 25.0)


def service_days(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    cal = n.select(k.alias("service_id"), *[((k + i) % 3 == 0).cast("int").alias(w) for i, w in enumerate(transit.WEEKDAYS)], F.lit("2024-01-01").cast("date").alias("start_date"), F.date_add(F.lit("2024-01-01").cast("date"), k).alias("end_date"))
    exc = n.select(k.alias("service_id"), F.date_add(F.lit("2024-01-03").cast("date"), k % 5).alias("date"), (k % 2 + 1).alias("exception_type"))
    return transit.service_days(cal, exc).select("service_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


def frequency_expand(spark, d):
    s = table(spark, d, "supplier")
    f = s.select(F.col("s_suppkey").alias("trip_id"), F.lit(21_600).alias("start_s"), (F.lit(21_600) + F.col("s_suppkey").cast("int") * 37 % 7200).alias("end_s"), (F.col("s_suppkey").cast("int") % 20 * 60).alias("headway_secs"))
    return transit.expand_frequencies(f)


def next_departure_asof(spark, d):
    from waymesh.operators.relational import next_event

    c = derived.calls(spark, d)
    ask = table(spark, d, "supplier").select(F.col("s_suppkey").alias("stop"), (F.col("s_suppkey") * 701 % 80_000).alias("t"), F.col("s_suppkey").alias("ask"))
    return next_event(ask, c.select("stop", F.col("dep_s").alias("t"), F.col("dep_s").alias("dep"), "trip"), ["stop"], "t", ["dep", "trip"]).select("ask", "dep", "trip")


def pattern_grouping(spark, d):
    return transit.patterns(derived.calls(spark, d))


def trip_based_rounds(spark, d):
    c = derived.calls(spark, d)
    start = spark.createDataFrame([(1, 3, 20_000), (2, 7, 40_000)], "source bigint, stop bigint, at bigint")
    return transit.earliest_arrival(c, start, rounds=3, change_s=120)


def pareto_front(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").cast("bigint").alias("a"), F.floor("l_extendedprice").cast("bigint").alias("b"))
    return transit.pareto_front(p, ["g"], "a", "b")


def transfer_most_specific(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    rules = s.select((k % 5).alias("from_stop_id"), (k % 3).alias("to_stop_id"), F.when(k % 8 == 0, k % 2).alias("from_route_id"), F.when(k % 12 == 0, k % 2).alias("to_route_id"), k.alias("min_transfer_time"))
    wanted = table(spark, d, "nation").select((F.col("n_nationkey") % 5).cast("bigint").alias("from_stop"), (F.col("n_nationkey") % 3).cast("bigint").alias("to_stop"), (F.col("n_nationkey") % 2).cast("bigint").alias("from_route"), (F.col("n_nationkey") % 4 % 2).cast("bigint").alias("to_route")).distinct()
    return transit.most_specific_transfers(rules, wanted)


def cheapest_fare_sum(spark, d):
    li = table(spark, d, "lineitem")
    seg = li.select(F.col("l_orderkey").alias("journey"), F.col("l_linenumber").alias("segment"), (F.col("l_suppkey") % 10).alias("route_id")).distinct()
    fares = table(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("route_id"), F.floor(F.abs("s_acctbal")).cast("bigint").alias("price"), F.when(F.col("s_suppkey") % 2 == 0, "EUR").otherwise("CHF").alias("currency"))
    return transit.fare_totals(seg, fares)


def time_expanded_network(spark, d):
    return transit.network(derived.calls(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("dst_s") - F.col("src_s")).cast("bigint").alias("seconds"))


def realtime_overlay(spark, d):
    c = derived.calls(spark, d)
    u = c.filter("(trip + seq) % 3 = 0").select("trip", "seq", (F.col("seq") * 30).cast("bigint").alias("arrival_delay_s"), (F.col("seq") * 30 + 5).cast("bigint").alias("departure_delay_s"), (F.col("seq") % 4 == 3).alias("skipped"))
    return transit.overlay(c, u)


def _cand(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.floor("value").cast("bigint").alias("v"))
    from pyspark.sql import Window

    e = e.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return e.select(F.col("user_id").alias("trace"), "step", "v", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("candidate"))


def candidate_rank(spark, d):
    c = _cand(spark, d).select("trace", "step", "candidate", ((F.col("v") * 7 + F.col("candidate") * 13) % 50).alias("distance"))
    return matching.rank_candidates(c, 2).select("trace", "step", "candidate", "distance", "rank")


def emission_logprob(spark, d):
    e = table(spark, d, "events")
    x = F.round("value", 2)
    return e.select("event_id", F.round(matching.emission(x), 6).alias("emission"), F.round(matching.transition(x, F.lit(10.0)), 6).alias("transition"))


def viterbi_layers(spark, d):
    c = _cand(spark, d).select("trace", "step", "candidate", ((F.col("v") * 7 + F.col("candidate") * 13) % 50).alias("cost"))
    a = c.select("trace", (F.col("step") + 1).alias("step"), F.col("candidate").alias("a"))
    t = a.join(c.select("trace", "step", F.col("candidate").alias("b")), ["trace", "step"]).select("trace", "step", "a", "b", (F.abs(F.col("a") - F.col("b")) * 11 + F.col("step")).alias("cost"))
    got = matching.viterbi(c, t)
    return got.groupBy("trace").agg(F.max("step").alias("steps"), F.max("cost").alias("cost"))


def time_text(spark, d):
    c = derived.calls(spark, d)
    t = text.time_of_seconds(F.col("dep_s"))
    return c.select("trip", "seq", t.alias("text"), text.seconds_of_time(t).alias("back"))


def name_cleanup(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.clean_name(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(";")), F.lit("  "))).alias("clean"), text.camel_case(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("camel"), text.xml_escape(F.concat(F.lit("<"), "p_brand", F.lit("&'"))).alias("xml"))


QUERIES = {
    "attr_enum_lookup": _attrs("road_class", "road_class_link", "surface"),
    "attr_max_speed_units": _attrs("max_speed_fwd"),
    "attr_lanes_clamp": _attrs("lanes"),
    "attr_dimensions": _attrs("max_height"),
    "attr_access_oneway": _attrs("car_access_fwd", "car_access_bwd"),
    "attr_average_speed": _attrs("car_average_speed"),
    "attr_priority_order_wins": _attrs("bike_priority"),
} | {
    f.__name__: f
    for f in (
        attr_json_tags, attr_weights, attr_toll, attr_ferry_speed, path_detail_islands, trace_gaps, ascend_descend, cumulative_distance, moving_average_range, stop_time_interpolation, turn_sign_lag, trace_thinning, service_days, frequency_expand, next_departure_asof, pattern_grouping,
        trip_based_rounds, pareto_front, transfer_most_specific, cheapest_fare_sum, time_expanded_network, realtime_overlay, candidate_rank, emission_logprob, viterbi_layers, time_text, name_cleanup,
    )
}


def _list(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_WAYS = f"""ways AS (SELECT p_partkey AS id, ({_list(_HIGHWAYS)})[p_partkey % 5 + 1] AS highway, ({_list(_SPEEDS)})[p_partkey % 7 + 1] AS maxspeed, p_partkey % 9 AS lanes, (['no', 'yes', '-1', 'maybe'])[p_partkey % 4 + 1] AS oneway,
 (['asphalt', 'sett', 'gravel', '?'])[p_partkey % 4 + 1] AS surface, p_partkey % 4 AS h, (['no', 'use_sidepath', 'yes', 'dismount', 'x', 'y'])[p_partkey % 6 + 1] AS bicycle FROM part)"""
_KMH = "CASE maxspeed WHEN '50' THEN 50.0 WHEN '30 mph' THEN 30 * CAST(1.609344 AS DOUBLE) WHEN 'walk' THEN 6.0 WHEN 'none' THEN CASE WHEN highway = 'motorway' THEN 150.0 END WHEN '20 knots' THEN 20 * CAST(1.852 AS DOUBLE) END"
_RUNS = "(SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_W = f"WITH {_WAYS} "
_B = f"WITH {BASE_SQL} "
_STEPS = "st AS (SELECT user_id AS trace, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events), cand AS (SELECT trace, step, v, c AS candidate, (v * 7 + c * 13) % 50 AS cost FROM st, (SELECT unnest([0, 1, 2]) AS c))"

SQL = {
    "attr_enum_lookup": _W + "SELECT id, CASE highway WHEN 'primary_link' THEN 'primary' WHEN 'nonsense' THEN 'other' ELSE highway END AS road_class, highway = 'primary_link' AS road_class_link, CASE surface WHEN 'sett' THEN 'cobblestone' WHEN '?' THEN 'missing' ELSE surface END AS surface FROM ways",
    "attr_max_speed_units": _W + f"SELECT id, CAST({_KMH} AS DOUBLE) AS max_speed_fwd FROM ways",
    "attr_lanes_clamp": _W + "SELECT id, CAST(greatest(1, least(6, lanes)) AS INTEGER) AS lanes FROM ways",
    "attr_dimensions": _W + "SELECT id, CASE h WHEN 0 THEN CAST(4.2 AS DOUBLE) WHEN 1 THEN 12 * CAST(0.3048 AS DOUBLE) + 6 * CAST(0.0254 AS DOUBLE) WHEN 2 THEN 13 * CAST(0.3048 AS DOUBLE) END AS max_height FROM ways",
    "attr_access_oneway": _W + "SELECT id, highway <> 'nonsense' AND oneway <> '-1' AS car_access_fwd, highway <> 'nonsense' AND NOT (oneway = 'yes' OR (highway = 'motorway' AND oneway NOT IN ('no', '-1'))) AS car_access_bwd FROM ways",
    "attr_average_speed": _W + f"SELECT id, round(CAST(CASE WHEN {_KMH} IS NOT NULL THEN {_KMH} * 0.9 WHEN surface IN ('sett', 'gravel') THEN least(30, b) ELSE b END AS DOUBLE), 1) AS car_average_speed FROM (SELECT *, CASE highway WHEN 'motorway' THEN 100 WHEN 'primary_link' THEN 60 WHEN 'residential' THEN 30 WHEN 'track' THEN 15 ELSE 10 END AS b FROM ways)",
    "attr_priority_order_wins": _W + "SELECT id, CAST(CASE WHEN bicycle = 'no' THEN 0.1 WHEN bicycle = 'use_sidepath' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS bike_priority FROM ways",
    # values written by hand from the rules of the tagging scheme
    "attr_weights": "SELECT p_partkey AS id, round(CAST(([7.5, 7.5, 7.5, NULL, NULL, 1.814388097614, 7.25747792, NULL])[p_partkey % 8 + 1] AS DOUBLE), 6) AS max_weight, round(CAST(([4.2, 4.2, 4.2672, 4.2672, 4.1148, 3.8, 3.2, NULL, NULL, NULL, NULL, NULL])[p_partkey % 12 + 1] AS DOUBLE), 6) AS max_height FROM part",
    "attr_toll": """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'all' WHEN p_partkey % 3 = 1 THEN 'no'
 ELSE (CASE p_partkey // 12 % 8 WHEN 0 THEN ['all', 'all', 'no', 'no'] WHEN 1 THEN ['all', 'all', 'hgv', 'hgv'] WHEN 2 THEN ['hgv', 'hgv', 'hgv', 'hgv'] WHEN 3 THEN ['all', 'hgv', 'hgv', 'no']
 WHEN 4 THEN ['hgv', 'hgv', 'hgv', 'no'] WHEN 5 THEN ['hgv', 'no', 'no', 'no'] WHEN 6 THEN ['all', 'no', 'no', 'no'] ELSE ['no', 'no', 'no', 'no'] END)[p_partkey // 3 % 4 + 1] END AS toll FROM part""",
    "attr_ferry_speed": "SELECT id, CAST(CASE WHEN s IS NOT NULL AND m / s * 3.6 >= 0.1 THEN floor(m / s * 3.6 / 1.4 + 0.5) WHEN m < 500 THEN 1 ELSE 6 END AS DOUBLE) AS speed FROM (SELECT p_partkey AS id, CAST(p_partkey * 37 % 40000 AS DOUBLE) AS m, CASE p_partkey % 3 WHEN 0 THEN CAST(1200 AS DOUBLE) WHEN 1 THEN 5400 END AS s FROM part)",
    "attr_json_tags": "SELECT event_id, props->>'$.k' AS k, CAST(len(json_keys(props)) AS INTEGER) AS n FROM events",
    "path_detail_islands": f"SELECT user_id, CAST(run AS BIGINT) AS run, event_type, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last, count(*) AS rows FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM {_RUNS}) GROUP BY user_id, run, event_type",
    "trace_gaps": "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS least FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 THEN 1 ELSE 0 END AS c FROM events)) GROUP BY user_id, session",
    "ascend_descend": "SELECT user_id, CAST(sum(greatest(d, 0)) AS BIGINT) AS ascend, CAST(sum(greatest(-d, 0)) AS BIGINT) AS descend FROM (SELECT user_id, coalesce(v - lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS d FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events)) GROUP BY 1",
    "cumulative_distance": "SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events",
    "moving_average_range": "SELECT event_id, round(avg(floor(value)) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING), 6) AS mean FROM events",
    "stop_time_interpolation": _B + "SELECT trip, seq, round(coalesce(t, a.v + (b.v - a.v) * CAST(m - a.m AS DOUBLE) / (b.m - a.m)), 6) AS t FROM (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY trip ORDER BY seq) AS a, first_value(k IGNORE NULLS) OVER (PARTITION BY trip ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM (SELECT trip, seq, seq * seq AS m, CASE WHEN seq % 3 = 1 THEN CAST(arrival_s AS DOUBLE) END AS t, CASE WHEN seq % 3 = 1 THEN {'v': CAST(arrival_s AS DOUBLE), 'm': seq * seq} END AS k FROM calls))",
    "turn_sign_lag": "SELECT event_id, CASE WHEN t IS NULL THEN NULL ELSE CAST(sign(t) * CASE WHEN abs(t) < 0.2 THEN 0 WHEN abs(t) < 0.8 THEN 1 WHEN abs(t) < 1.8 THEN 2 ELSE 3 END AS INTEGER) END AS sign FROM (SELECT event_id, a - lag(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM (SELECT *, (CAST(floor(value) AS BIGINT) % 7 - 3) / 1.5 AS a FROM events))",
    "service_days": "WITH d AS (SELECT n_nationkey AS k, DATE '2024-01-01' + CAST(i AS INTEGER) AS date FROM nation, range(26) t(i) WHERE i <= n_nationkey), x AS (SELECT n_nationkey AS k, DATE '2024-01-03' + CAST(n_nationkey % 5 AS INTEGER) AS date, n_nationkey % 2 + 1 AS t FROM nation) SELECT k AS service_id, strftime(date, '%Y-%m-%d') AS date FROM ((SELECT k, date FROM d WHERE (k + isodow(date) - 1) % 3 = 0 UNION SELECT k, date FROM x WHERE t = 1) EXCEPT SELECT k, date FROM x WHERE t = 2)",
    "frequency_expand": "SELECT s_suppkey AS trip_id, CAST(unnest(range(21600, CAST(21600 + s_suppkey * 37 % 7200 AS BIGINT), CAST(s_suppkey % 20 * 60 AS BIGINT))) AS INTEGER) AS start_s FROM supplier WHERE s_suppkey % 20 > 0 AND s_suppkey * 37 % 7200 > 0",
    "next_departure_asof": _B + ", r AS (SELECT s_suppkey AS ask, dep_s, trip FROM supplier LEFT JOIN calls c ON c.stop = s_suppkey AND c.dep_s >= s_suppkey * 701 % 80000) SELECT ask, min(dep_s) AS dep, arg_min(trip, (dep_s, trip)) AS trip FROM r GROUP BY 1",
    "pattern_grouping": _B + "SELECT trip, min(trip) OVER (PARTITION BY stops) AS pattern FROM (SELECT trip, list(stop ORDER BY seq) AS stops FROM calls GROUP BY trip)",
    "trip_based_rounds": _B + """, c AS (SELECT * FROM calls), r0 AS (SELECT 1::BIGINT AS source, 3::BIGINT AS stop, 20000::BIGINT AS arrival UNION ALL SELECT 2, 7, 40000), """ + ", ".join(
        f"a{n} AS (SELECT b.source, c.stop, min(c.arrival_s) AS arrival FROM (SELECT r.source, c.trip, min(c.seq) AS s FROM r{n - 1} r JOIN c ON c.stop = r.stop AND c.dep_s >= r.arrival + {0 if n == 1 else 120} GROUP BY 1, 2) b JOIN c ON c.trip = b.trip AND c.seq > b.s GROUP BY 1, 2), "
        f"r{n} AS (SELECT a.* FROM a{n} a LEFT JOIN (SELECT source, stop, min(arrival) AS m FROM ({' UNION ALL '.join(f'SELECT * FROM r{k}' for k in range(n))}) GROUP BY 1, 2) p USING (source, stop) WHERE p.m IS NULL OR a.arrival < p.m)"
        for n in (1, 2, 3)
    ) + " " + " UNION ALL ".join(f"SELECT source, stop, CAST(arrival AS BIGINT) AS arrival, {n} AS trips FROM r{n}" for n in range(4)),
    "pareto_front": "WITH p AS (SELECT DISTINCT l_suppkey AS g, CAST(l_quantity AS BIGINT) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS b FROM lineitem) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.g = p.g AND q.a <= p.a AND q.b <= p.b AND (q.a < p.a OR q.b < p.b))",
    "transfer_most_specific": "WITH r AS (SELECT s_suppkey % 5 AS f, s_suppkey % 3 AS t, CASE WHEN s_suppkey % 8 = 0 THEN s_suppkey % 2 END AS fr, CASE WHEN s_suppkey % 12 = 0 THEN s_suppkey % 2 END AS tr, s_suppkey AS m FROM supplier), w AS (SELECT DISTINCT CAST(n_nationkey % 5 AS BIGINT) AS from_stop, CAST(n_nationkey % 3 AS BIGINT) AS to_stop, CAST(n_nationkey % 2 AS BIGINT) AS from_route, CAST(n_nationkey % 4 % 2 AS BIGINT) AS to_route FROM nation) SELECT from_stop, to_stop, from_route, to_route, arg_max(m, ((CASE WHEN fr IS NULL THEN 0 ELSE 2 END) + (CASE WHEN tr IS NULL THEN 0 ELSE 1 END), -m)) AS min_transfer_time FROM w JOIN r ON f = from_stop AND t = to_stop AND (fr IS NULL OR fr = from_route) AND (tr IS NULL OR tr = to_route) GROUP BY ALL",
    "cheapest_fare_sum": "WITH s AS (SELECT DISTINCT l_orderkey AS journey, l_linenumber AS segment, l_suppkey % 10 AS r FROM lineitem), f AS (SELECT s_suppkey % 10 AS r, CAST(floor(abs(s_acctbal)) AS BIGINT) AS price, CASE WHEN s_suppkey % 2 = 0 THEN 'EUR' ELSE 'CHF' END AS currency FROM supplier), c AS (SELECT journey, segment, currency, min(price) AS m FROM s JOIN f USING (r) GROUP BY 1, 2, 3), n AS (SELECT journey, count(DISTINCT segment) AS legs FROM s GROUP BY 1) SELECT journey, currency, CAST(sum(m) AS BIGINT) AS price FROM c JOIN n USING (journey) GROUP BY journey, currency, legs HAVING count(*) = legs",
    "time_expanded_network": _B + ", c AS (SELECT * FROM calls), t AS (SELECT DISTINCT stop, dep_s % 86400 AS t FROM c), e AS (SELECT 'hop' AS kind, lead(arrival_s) OVER (PARTITION BY trip ORDER BY seq) - dep_s AS s FROM c UNION ALL SELECT 'dwell', dep_s - arrival_s FROM c UNION ALL SELECT 'board', 0 FROM c UNION ALL SELECT 'alight', 0 FROM c UNION ALL SELECT CASE WHEN n IS NULL THEN 'overnight' ELSE 'wait' END, coalesce(n, f + 86400) - t FROM (SELECT t, lead(t) OVER (PARTITION BY stop ORDER BY t) AS n, min(t) OVER (PARTITION BY stop) AS f FROM t)) SELECT kind, count(*) AS edges, CAST(sum(s) AS BIGINT) AS seconds FROM e WHERE s IS NOT NULL GROUP BY 1",
    "realtime_overlay": _B + ", j AS (SELECT *, (trip + seq) % 3 = 0 AS u, last_value(CASE WHEN (trip + seq) % 3 = 0 THEN seq * 30 + 5 END IGNORE NULLS) OVER (PARTITION BY trip ORDER BY seq) AS d FROM calls) SELECT trip, CAST(seq AS INTEGER) AS seq, stop, arrival_s + CASE WHEN u THEN seq * 30 ELSE coalesce(d, 0) END AS arrival_s, dep_s + coalesce(d, 0) AS dep_s FROM j WHERE NOT (u AND seq % 4 = 3)",
    "candidate_rank": f"WITH {_STEPS} SELECT * FROM (SELECT trace, CAST(step AS INTEGER) AS step, CAST(candidate AS BIGINT) AS candidate, cost AS distance, CAST(row_number() OVER (PARTITION BY trace, step ORDER BY cost, candidate) AS INTEGER) AS rank FROM cand) WHERE rank <= 2",
    "emission_logprob": "SELECT event_id, round(ln(sqrt(2 * pi()) * 10) + x * x / 200, 6) AS emission, round(ln(2) + abs(x - 10) / 2, 6) AS transition FROM (SELECT event_id, round(value, 2) AS x FROM events)",
    "viterbi_layers": f"WITH RECURSIVE {_STEPS}, v(trace, candidate, step, cost) AS (SELECT trace, candidate, step, cost FROM cand WHERE step = 0 UNION ALL SELECT c.trace, c.candidate, c.step, min(p.cost + abs(p.candidate - c.candidate) * 11 + c.step + c.cost) FROM v p JOIN cand c ON c.trace = p.trace AND c.step = p.step + 1 GROUP BY 1, 2, 3) SELECT trace, CAST(max(step) AS INTEGER) AS steps, arg_max(m, step) AS cost FROM (SELECT trace, step, min(cost) AS m FROM v GROUP BY 1, 2) GROUP BY 1",
    "time_text": _B + "SELECT trip, CAST(seq AS INTEGER) AS seq, CAST(dep_s // 3600 AS VARCHAR) || ':' || lpad(CAST(dep_s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(dep_s % 60 AS VARCHAR), 2, '0') AS text, CAST(dep_s AS INTEGER) AS back FROM calls",
    "name_cleanup": "SELECT p_partkey, replace(p_name, ' ', ', ') AS clean, lower(substr(j, 1, 1)) || substr(j, 2) AS camel, '&lt;' || p_brand || '&amp;&apos;' AS xml FROM (SELECT *, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], '') AS j FROM part)",
}
