"""Contours of travel time: a triangulation of labels and the lines where it passes a limit.

Triangulating needs all labels of one source at hand, so it runs once for each
source over at most MAX_LABELS labels.  Up to that many distinct positions all count;
only larger label sets are thinned to the earliest label in each cell of a grid
first (``thin_labels``), which is exact for the cells' minima and loses what
lies late within a cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.session import cut, ship

MAX_LABELS = 20_000


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three positions) of distinct points in the plane, by insertion (Bowyer-Watson)."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    low, span = points.min(0), max(float(np.ptp(points, 0).max()), 1e-9)
    pts = np.vstack([(points - low) / span, [[-50, -50], [50, -50], [0, 100]]])
    tri = np.array([[n, n + 1, n + 2]])

    def circle(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = pts[t[:, 0]], pts[t[:, 1]], pts[t[:, 2]]
        d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
        d = np.where(np.abs(d) < 1e-18, 1e-18, d)
        sa, sb, sc = (a**2).sum(1), (b**2).sum(1), (c**2).sum(1)
        o = np.stack([(sa * (b[:, 1] - c[:, 1]) + sb * (c[:, 1] - a[:, 1]) + sc * (a[:, 1] - b[:, 1])) / d, (sa * (c[:, 0] - b[:, 0]) + sb * (a[:, 0] - c[:, 0]) + sc * (b[:, 0] - a[:, 0])) / d], 1)
        return o, ((a - o) ** 2).sum(1)

    centre, radius = circle(tri)
    for i in range(n):
        hit = ((pts[i] - centre) ** 2).sum(1) < radius * (1 + 1e-12)
        if not hit.any():
            continue
        sides = np.vstack([tri[hit][:, [0, 1]], tri[hit][:, [1, 2]], tri[hit][:, [2, 0]]])
        key = np.sort(sides, 1)
        _, first, times = np.unique(key, axis=0, return_index=True, return_counts=True)
        rim = sides[first[times == 1]]
        new = np.column_stack([rim, np.full(len(rim), i)])
        c, r = circle(new)
        tri, centre, radius = np.vstack([tri[~hit], new]), np.vstack([centre[~hit], c]), np.concatenate([radius[~hit], r])
    return tri[(tri < n).all(1)]


def contour_segments(points: np.ndarray, z: np.ndarray, limit: float) -> list[tuple[float, float, float, float]]:
    """Segments (x1, y1, x2, y2) where the triangulated surface passes ``limit``."""
    out = []
    for t in delaunay(points):
        inside = z[t] <= limit
        if inside.all() or not inside.any():
            continue
        cut = []
        for a, b in ((0, 1), (1, 2), (2, 0)):
            if inside[a] != inside[b]:
                za, zb = z[t[a]], z[t[b]]
                s = (limit - za) / (zb - za)
                cut.append(points[t[a]] + (points[t[b]] - points[t[a]]) * s)
        out.append((*map(float, cut[0]), *map(float, cut[1])))
    return out


def polygons(segments: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Segments chained end to end; closed chains repeat their first point."""
    key = lambda x, y: (round(x, 9), round(y, 9))
    at: dict[tuple, list[int]] = {}
    for i, (a, b, c, d) in enumerate(segments):
        at.setdefault(key(a, b), []).append(i)
        at.setdefault(key(c, d), []).append(i)
    used, out = set(), []
    starts = sorted(range(len(segments)), key=lambda i: (min(len(at[key(*segments[i][:2])]), len(at[key(*segments[i][2:])])), i))
    for s in starts:
        if s in used:
            continue
        a, b, c, d = segments[s]
        used.add(s)
        if len(at[key(c, d)]) == 1:
            a, b, c, d = c, d, a, b
        line = [(a, b), (c, d)]
        while True:
            nxt = next((i for i in at[key(*line[-1])] if i not in used), None)
            if nxt is None:
                break
            used.add(nxt)
            a, b, c, d = segments[nxt]
            line.append((c, d) if key(a, b) == key(*line[-1]) else (a, b))
        out.append(line)
    return out


def thin_labels(labels: DataFrame, cell_deg: float) -> DataFrame:
    """The earliest of labels(source, lat, lon, z) in each cell; ties by position."""
    cell = [F.floor(F.col(c) / cell_deg).alias(f"c{i}") for i, c in enumerate(("lat", "lon"))]
    return labels.groupBy("source", *cell).agg(F.min(F.struct("z", "lat", "lon")).alias("m")).select("source", F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon"), F.col("m.z").alias("z"))


def isochrones(labels: DataFrame, limits: list[float], cell_deg: float) -> DataFrame:
    """(source, bucket, limit, geometry): contour lines as GeoJSON MultiLineString text of labels(source, lat, lon, z).

    Every distinct position counts with its earliest label, framed by points
    out of reach two ``cell_deg`` away.  Sources of more than MAX_LABELS
    positions are thinned to cells of ``cell_deg``; more than MAX_LABELS cells
    raise ValueError.
    """
    known = cut(labels.filter("z is not null").groupBy("source", "lat", "lon").agg(F.min("z").alias("z")))
    wide = known.groupBy("source").count().filter(F.col("count") > MAX_LABELS).select("source")
    thin = cut(known.join(wide, "source", "left_anti").unionByName(thin_labels(known.join(wide, "source", "left_semi"), cell_deg)))
    most = thin.groupBy("source").count().agg(F.max("count")).head()[0] or 0
    if most > MAX_LABELS:
        raise ValueError(f"{most} cells for one source: choose larger ones")
    ship(labels.sparkSession)

    def run(df):  # noqa: ANN001, ANN202
        import json

        import pandas as pd

        df = df.sort_values(["lon", "lat"])  # the same triangles whatever the order of rows
        pts, z = df[["lon", "lat"]].to_numpy(float), df["z"].to_numpy(float)
        (x1, y1), (x2, y2) = pts.min(0) - 2 * cell_deg, pts.max(0) + 2 * cell_deg
        frame = np.array([(x, y) for x in np.linspace(x1, x2, 5) for y in (y1, y2)] + [(x, y) for x in (x1, x2) for y in np.linspace(y1, y2, 5)[1:-1]])
        pts, z = np.vstack([pts, frame]), np.concatenate([z, np.full(len(frame), 2 * max(limits) + 1)])
        rows = []
        for k, limit in enumerate(sorted(limits)):
            lines = polygons(contour_segments(pts, z, limit))
            rows.append((int(df["source"].iloc[0]), k, float(limit), json.dumps({"type": "MultiLineString", "coordinates": lines})))
        return pd.DataFrame(rows, columns=["source", "bucket", "limit", "geometry"])

    return thin.groupBy("source").applyInPandas(run, "source bigint, bucket int, limit double, geometry string")
