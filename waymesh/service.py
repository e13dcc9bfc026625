"""Batch-first entry points: each takes a table of requests and returns a table of answers.

A ``Network`` holds nodes(node, lat, lon) and edges(edge, node_a, node_b,
dist_m, points, tags); profiles are rule models over the attributes of
``waymesh.operators.attributes``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators import attributes, contours, matching, routes, search, snapping
from waymesh.plans import rules

#: Attributes a rule model may use, with their kinds.
MODEL_COLUMNS = {"road_class": "enum", "road_environment": "enum", "surface": "enum", "max_speed_fwd": "number", "lanes": "number", "roundabout": "boolean", "car_average_speed": "number", "bike_average_speed": "number", "foot_average_speed": "number", "car_access_fwd": "boolean", "car_access_bwd": "boolean", "bike_access_fwd": "boolean", "bike_access_bwd": "boolean", "foot_access": "boolean", "road_class_link": "boolean", "bike_priority": "number", "name": "text"}


@dataclass(frozen=True)
class Profile:
    """A way of travelling: its model, and the attributes that open an edge in either direction."""

    model: dict
    forward: str = "car_access_fwd"
    backward: str = "car_access_bwd"


CAR = Profile({"speed": [{"if": "true", "limit_to": "car_average_speed"}]})
BIKE = Profile({"speed": [{"if": "true", "limit_to": "bike_average_speed"}], "priority": [{"if": "true", "multiply_by": "bike_priority"}]}, "bike_access_fwd", "bike_access_bwd")
FOOT = Profile({"speed": [{"if": "true", "limit_to": "foot_average_speed"}]}, "foot_access", "foot_access")


@dataclass
class Network:
    """A road network and the profiles it is searched with."""

    nodes: DataFrame
    edges: DataFrame
    profiles: dict[str, Profile] = field(default_factory=lambda: {"car": CAR, "bike": BIKE, "foot": FOOT})

    def directed(self, profile: str, query_model: dict | None = None) -> DataFrame:
        """(base, adj, edge, w, ms, dist_m): edge keys 2 * rank + direction, weights in milliseconds-like units."""
        p = self.profiles[profile]
        m = rules.merge(p.model, query_model)
        e = attributes.derive(self.edges, [c for c in MODEL_COLUMNS if c in attributes.ATTRIBUTES])
        ctx = rules.Context(MODEL_COLUMNS, distance=F.col("dist_m"), rename={f"backward_{c}": c.replace("_fwd", "_bwd") for c in MODEL_COLUMNS})
        c = rules.compile_model(m, ctx)
        w = rules.edge_weight(c, F.col("dist_m"))
        cols = lambda a, b, open_, way: e.filter(F.col(open_)).select(F.col(a).alias("base"), F.col(b).alias("adj"), F.col("edge"), F.lit(way).alias("way"), F.round(w * 1000).cast("bigint").alias("w"), rules.edge_millis(c, F.col("dist_m")).alias("ms"), "dist_m")
        return cols("node_a", "node_b", p.forward, 0).unionByName(cols("node_b", "node_a", p.backward, 1)).filter("w is not null")

    def snap(self, points: DataFrame, tile_deg: float = 0.01) -> DataFrame:
        """points(id, lat, lon) with the nearest edge, its distance, and the nearer end of the edge as ``node``."""
        p = F.explode(F.expr("transform(sequence(0, size(points) - 2), i -> struct(points[i] as a, points[i + 1] as b))")).alias("s")
        lines = self.edges.select("edge", "node_a", "node_b", p).select("edge", "node_a", "node_b", F.col("s.a.lat").alias("lat_a"), F.col("s.a.lon").alias("lon_a"), F.col("s.b.lat").alias("lat_b"), F.col("s.b.lon").alias("lon_b"))
        near = snapping.nearest_edges(points, lines, tile_deg).join(self.edges.select("edge", "node_a", "node_b"), "edge")
        ends = near.join(points, "id").select("id", "edge", "distance_m", "lat", "lon", F.explode(F.array("node_a", "node_b")).alias("node"))
        at = self.nodes.select("node", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
        from waymesh.functions.geo import plane_distance_m

        d = plane_distance_m(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
        return ends.join(at, "node").groupBy("id", "edge", "distance_m").agg(F.min(F.struct(d.alias("d"), "node")).alias("m")).select("id", "edge", "distance_m", F.col("m.node").alias("node"))

    def spt(self, profile: str, sources: DataFrame, limit: int | None = None, reverse: bool = False) -> DataFrame:
        """Labels of shortest path trees from sources(source); ``reverse`` searches towards them."""
        e = self.directed(profile)
        e = e.select(F.col("adj" if reverse else "base").alias("base"), F.col("base" if reverse else "adj").alias("adj"), "edge", "w")
        return search.shortest(e, sources, limit)

    def matrix(self, profile: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """(source, target, w) between all sources(source) and targets(target); null where there is no way."""
        e = self.directed(profile).select("base", "adj", "edge", "w")
        labels = search.shortest(e, sources, shared=targets.select("target")).select("source", F.col("node").alias("target"), "w")
        return labels.join(targets.select("target").distinct(), "target", "left_semi")

    def isochrone(self, profile: str, sources: DataFrame, limits: list[float], cell_deg: float = 0.002) -> DataFrame:
        """Contours of the labels within the greatest limit, and a seventh beyond it so that they close."""
        labels = self.spt(profile, sources, int(max(limits) * 1.14)).join(self.nodes, "node")
        return contours.isochrones(labels.select("source", "lat", "lon", F.col("w").cast("double").alias("z")), limits, cell_deg)

    def route(self, profile: str, requests: DataFrame, language: str = "en") -> DataFrame:
        """(path, body): JSON answers to requests(path, source, target) between nodes."""
        e = self.directed(profile)
        labels = search.shortest(e.select("base", "adj", "edge", "w"), requests.select("source").distinct(), goals=requests.select("source", "target"))
        tree = search.parents(labels, e.select("base", "adj", "edge", "w"))
        steps = search.extract_paths(tree, requests.select("source", "target")).join(requests, ["source", "target"])
        best = e.groupBy("edge", "adj").agg(F.min(F.struct("w", "ms", "dist_m", "way")).alias("m")).select("edge", F.col("adj").alias("node"), "m.*")
        steps = steps.join(best, ["edge", "node"]).join(self.edges.select("edge", "points", F.col("tags")["name"].alias("name"), F.coalesce(F.col("tags")["junction"] == "roundabout", F.lit(False)).alias("roundabout")), "edge")
        # roads that leave a node other than the roundabout itself are its exits
        ring = F.coalesce(F.col("tags")["junction"] == "roundabout", F.lit(False))
        exits = e.join(self.edges.select("edge", ring.alias("ring")), "edge").filter("not ring").groupBy(F.col("base").alias("node")).agg(F.count_distinct("edge").cast("int").alias("out_edges"))
        steps = steps.withColumn("points", F.when(F.col("way") == 1, F.reverse("points")).otherwise(F.col("points")))
        steps = routes.bearings(steps).join(exits, "node", "left").withColumnsRenamed({"dist_m": "distance_m", "ms": "time_ms"})
        totals = requests.select("path").join(steps.groupBy("path").agg(F.sum("distance_m").alias("distance_m"), F.sum("time_ms").alias("time_ms"), (F.sum("w") / 1000).alias("weight")), "path", "left")
        line = steps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "points"))).alias("p"))
        # the joint of two edges is named once
        line = line.select("path", F.concat(F.array(F.col("p")[0]["points"][0]), F.flatten(F.transform("p", lambda x: F.slice(x["points"], 2, F.size(x["points"]))))).alias("points"))
        return routes.responses(totals, routes.instructions(steps), line, language)

    def match(self, profile: str, traces: DataFrame, candidates: int = 3, tile_deg: float = 0.01) -> DataFrame:
        """(trace, step, candidate, cost): the likeliest node of each observation of traces(trace, step, lat, lon).

        Candidates are the ends of the nearest edges; ways between candidates
        of neighbouring observations are priced together.
        """
        pts = traces.select(F.xxhash64("trace", "step").alias("id"), "trace", "step", "lat", "lon")
        at = self.nodes.select("node", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
        near = self.snap(pts.select("id", "lat", "lon"), tile_deg).join(pts, "id").join(self.edges.select("edge", "node_a", "node_b"), "edge")
        from waymesh.functions.geo import haversine_m

        c = near.select("trace", "step", "lat", "lon", F.explode(F.array("node_a", "node_b")).alias("candidate")).join(at.withColumnRenamed("node", "candidate"), "candidate")
        c = c.withColumn("distance", haversine_m(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon")))
        c = matching.rank_candidates(c, candidates).withColumn("cost", matching.emission(F.col("distance")))
        a = c.select("trace", (F.col("step") + 1).alias("step"), F.col("candidate").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
        pair = a.join(c.select("trace", "step", F.col("candidate").alias("b"), "lat", "lon"), ["trace", "step"])
        e = self.directed(profile).select("base", "adj", "edge", F.round(F.col("dist_m") * 1000).cast("bigint").alias("w"))
        # each candidate is searched only as far as the candidates that follow it
        goals = pair.select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()
        ways = search.shortest(e, goals.select("source").distinct(), goals=goals).select(F.col("source").alias("a"), F.col("node").alias("b"), (F.col("w") / 1000).alias("route"))
        t = pair.join(ways, ["a", "b"]).withColumn("cost", matching.transition(F.col("route"), haversine_m(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))))
        return matching.viterbi(c.select("trace", "step", "candidate", "cost"), t.select("trace", "step", "a", "b", "cost"))

    def info(self) -> dict:
        """Bounds, sizes and profiles."""
        b = self.nodes.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon"), F.count(F.lit(1))).head()
        return {"south": b[0], "north": b[1], "west": b[2], "east": b[3], "nodes": b[4], "edges": self.edges.count(), "profiles": sorted(self.profiles)}
