"""Queries of the general data problems and the SQL they are compared with.

Each query takes (spark, folder of parquet tables) and runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.operators import bad_rows, hierarchy, nesting, orphans, proximity, schema_drift
from waymesh.session import cut, table

NEAR_M = 30.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(schema_drift.correspondences(cut(schema_drift.file_schemas(table(spark, d, "route_responses"))), scored=False))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unify(table(spark, d, "route_responses"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.judge_lines(table(spark, d, "gtfs_lines"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.faulty_records(_judged(spark, d))


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.rejects(_judged(spark, d))


def _typed(file: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return bad_rows.typed_rows(bad_rows.judge_lines(table(spark, d, "gtfs_lines").filter(F.col("file") == file)), file)

    return run


def _tree(spark: SparkSession, d: str, paths: bool) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.tree_links(table(spark, d, "spt_labels")), paths)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    lost = _tree(spark, d, False).filter(F.col("cycle_id").isNotNull())
    return lost.select(F.col("group_id").alias("tree_id"), "label_id", F.col("cycle_id").alias("cycle_label_id"), F.col("depth").alias("steps"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, True).withColumnRenamed("group_id", "tree_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nesting.nested_items(table(spark, d, "route_responses"), table(spark, d, "matrix_responses"))


def _shredded(source: str, name: str, lists: dict[str, int]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, source)
        return nesting.shred(df, "body", nesting.plan(nesting.analyse(df, "body"), lists)[name], ["response_id"]).distinct()

    return run


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.close_by(table(spark, d, "locations"), table(spark, d, "areas"), NEAR_M)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.timetable_orphans({t: table(spark, d, t) for t in ("stop_times", "trips", "stops", "routes")})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_unified": p1_unified,
    "p2_found": p2_found,
    "p2_rejects": p2_rejects,
    **{f"p2_rows_{f}": _typed(f) for f in bad_rows.FILES},
    "p3_found": p3_found,
    "p3_hierarchy": p3_hierarchy,
    "p4_found": p4_found,
    "p4_paths": _shredded("route_responses", "paths[]", {"interval": 2}),
    "p4_instructions": _shredded("route_responses", "instructions[]", {"interval": 2}),
    "p4_hints": _shredded("matrix_responses", "hints[]", {"point_pairs[]": 2}),
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_report": p6_report,
}

_P1 = """
WITH files AS (SELECT series_id, file_id, min(exported_at) AS tm FROM route_responses WHERE series_id IS NOT NULL AND file_id IS NOT NULL GROUP BY 1, 2),
ordered AS (SELECT *, lag(file_id) OVER (PARTITION BY series_id ORDER BY tm, file_id) AS before FROM files),
paths AS (SELECT series_id, file_id, unnest(CAST(body->'$.paths' AS JSON[])) AS p FROM route_responses WHERE json_type(body->'$.paths') = 'ARRAY'),
members AS (SELECT series_id, file_id, p, unnest(json_keys(p)) AS field FROM paths WHERE json_type(p) = 'OBJECT'),
kinds AS (SELECT series_id, file_id, field, CASE json_type(p->field) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM members),
types AS (SELECT series_id, file_id, field, string_agg(DISTINCT kind, ',' ORDER BY kind) AS types FROM kinds WHERE kind IS NOT NULL GROUP BY ALL),
old AS (SELECT o.file_id, t.field, t.types FROM ordered o JOIN types t ON t.series_id = o.series_id AND t.file_id = o.before),
new AS (SELECT o.file_id, t.field, t.types FROM ordered o JOIN types t ON t.series_id = o.series_id AND t.file_id = o.file_id WHERE o.before IS NOT NULL),
gone AS (SELECT *, count(*) OVER (PARTITION BY file_id, types) AS n FROM old ANTI JOIN new USING (file_id, field)),
come AS (SELECT *, count(*) OVER (PARTITION BY file_id, types) AS n FROM new ANTI JOIN old USING (file_id, field))
SELECT file_id, field, 'retyped' AS change_kind FROM old JOIN new USING (file_id, field) WHERE old.types <> new.types
UNION SELECT g.file_id, g.field, 'renamed' FROM gone g JOIN come c USING (file_id, types) WHERE g.n = 1 AND c.n = 1
UNION SELECT g.file_id, g.field, 'removed' FROM gone g LEFT JOIN come c USING (file_id, types) WHERE g.n > 1 OR c.n IS NULL OR c.n > 1
UNION SELECT c.file_id, c.field, 'added' FROM come c LEFT JOIN gone g USING (file_id, types) WHERE c.n > 1 OR g.n IS NULL OR g.n > 1
"""

_P3_LINKS = """
WITH RECURSIVE l AS (SELECT DISTINCT tree_id, CAST(CASE WHEN traversal_mode = 'node_based' THEN node_id ELSE edge_id END AS BIGINT) AS id,
    CAST(CASE WHEN traversal_mode = 'node_based' THEN prev_node_id ELSE prev_edge_id END AS BIGINT) AS p FROM spt_labels),
up AS (SELECT l.tree_id, l.id, q.id AS up FROM l LEFT JOIN l q ON q.tree_id = l.tree_id AND q.id = l.p),
"""

_P3 = (
    _P3_LINKS
    + """
good(tree_id, id) AS (SELECT tree_id, id FROM up WHERE up IS NULL UNION SELECT u.tree_id, u.id FROM good g JOIN up u ON u.tree_id = g.tree_id AND u.up = g.id),
bad AS (SELECT * FROM up ANTI JOIN good USING (tree_id, id)),
walk(tree_id, id, tm, n) AS (SELECT tree_id, id, id, 0 FROM bad UNION SELECT w.tree_id, w.id, b.up, w.n + 1 FROM walk w JOIN bad b ON b.tree_id = w.tree_id AND b.id = w.tm WHERE w.n <= (SELECT max(c) FROM (SELECT count(*) AS c FROM bad GROUP BY tree_id))),
ring AS (SELECT DISTINCT tree_id, id FROM walk WHERE n > 0 AND tm = id),
low AS (SELECT w.tree_id, w.id, min(w.tm) AS low FROM walk w JOIN ring r USING (tree_id, id) GROUP BY 1, 2),
first AS (SELECT w.tree_id, w.id, min(w.n) AS steps, arg_min(w.tm, w.n) AS tm FROM walk w JOIN ring r ON r.tree_id = w.tree_id AND r.id = w.tm GROUP BY 1, 2)
SELECT f.tree_id, f.id AS label_id, l.low AS cycle_label_id, CAST(f.steps AS BIGINT) AS steps FROM first f JOIN low l ON l.tree_id = f.tree_id AND l.id = f.tm
"""
)

_P4 = """
WITH r AS (SELECT DISTINCT response_id, body FROM route_responses), m AS (SELECT DISTINCT response_id, CASE WHEN json_type(body->'$.solution') = 'OBJECT' THEN body->'$.solution' ELSE CAST(body AS JSON) END AS b FROM matrix_responses),
paths AS (SELECT response_id, i AS path_no, body->'$.paths'->CAST(i AS BIGINT) AS p FROM r, range(CAST(coalesce(json_array_length(body, '$.paths'), 0) AS BIGINT)) t(i)),
ins AS (SELECT response_id, path_no, i AS item_no, p->'$.instructions'->CAST(i AS BIGINT) AS x FROM paths, range(CAST(coalesce(json_array_length(p, '$.instructions'), 0) AS BIGINT)) t(i)),
hints AS (SELECT response_id, i AS hint_no, b->'$.hints'->CAST(i AS BIGINT) AS h FROM m, range(CAST(coalesce(json_array_length(b, '$.hints'), 0) AS BIGINT)) t(i)),
pairs AS (SELECT response_id, hint_no, i AS pair_no, h->'$.point_pairs'->CAST(i AS BIGINT) AS q, h->>'$.message' AS msg FROM hints, range(CAST(coalesce(json_array_length(h, '$.point_pairs'), 0) AS BIGINT)) t(i)),
dist AS (SELECT response_id, i AS row_no, b->'$.distances'->CAST(i AS BIGINT) AS d FROM m, range(CAST(coalesce(json_array_length(b, '$.distances'), 0) AS BIGINT)) t(i)),
cells AS (SELECT response_id, row_no, j AS col_no, d->>CAST(j AS BIGINT) AS v FROM dist, range(CAST(coalesce(json_array_length(d), 0) AS BIGINT)) t(j))
SELECT 'instructions' AS field, response_id, path_no AS parent_no, item_no, coalesce(CAST(x->>'$.interval[0]' AS BIGINT), -1) AS first_value, coalesce(CAST(x->>'$.interval[1]' AS BIGINT), -1) AS second_value, coalesce(x->>'$.text', '') AS label FROM ins
UNION SELECT 'point_pairs', response_id, hint_no, pair_no, CAST(q->>0 AS BIGINT), CAST(q->>1 AS BIGINT), coalesce(msg, '') FROM pairs
UNION SELECT 'distances', response_id, row_no, col_no, CAST(v AS BIGINT), -1, '' FROM cells WHERE v IS NOT NULL
"""

_P6_BASE = """
refs AS (
 SELECT 'stop_times' AS file, 'trips' AS parent, 'trip_id' AS field, feed_id, source_file_line, trip_id AS key, min(loaded_at) AS tm FROM stop_times GROUP BY ALL
 UNION ALL SELECT 'stop_times', 'stops', 'stop_id', feed_id, source_file_line, stop_id, min(loaded_at) FROM stop_times GROUP BY ALL
 UNION ALL SELECT 'trips', 'routes', 'route_id', feed_id, source_file_line, route_id, min(loaded_at) FROM trips GROUP BY ALL
 UNION ALL SELECT 'stops', 'stops', 'parent_station', feed_id, source_file_line, parent_station, min(loaded_at) FROM stops GROUP BY ALL),
vers AS (SELECT 'trips' AS parent, feed_id, trip_id AS key, loaded_at, deleted_at FROM trips UNION ALL SELECT 'stops', feed_id, stop_id, loaded_at, deleted_at FROM stops UNION ALL SELECT 'routes', feed_id, route_id, loaded_at, deleted_at FROM routes),
judged AS (SELECT r.file, r.field, r.feed_id, r.source_file_line, r.key, r.tm, count(v.key) AS n, coalesce(bool_or(v.loaded_at <= r.tm AND (v.deleted_at IS NULL OR v.deleted_at > r.tm)), false) AS valid, coalesce(bool_or(v.loaded_at > r.tm), false) AS later
 FROM refs r LEFT JOIN vers v ON v.parent = r.parent AND v.feed_id = r.feed_id AND v.key = r.key WHERE r.key IS NOT NULL AND r.key <> '' GROUP BY ALL),
found AS (SELECT DISTINCT feed_id, file, source_file_line, field, key AS affected_entity_id, CASE WHEN n = 0 THEN 'missing' WHEN later THEN 'late' ELSE 'deleted' END AS kind, strftime(tm, '%Y-%m') AS period FROM judged WHERE NOT valid)
"""

_P2_COLUMNS = ", ".join(
    f"('{file}', '{name}', '{kind}', {str(need).lower()}, {low if low is not None else 'NULL'}, {high if high is not None else 'NULL'})" for file, cols in bad_rows.FILES.items() for name, (kind, need, low, high) in cols.items()
)

_FIELD = r'("([^"]|"")*"|[^",]*)'
_P2 = rf"""
WITH spec(file, field, kind, need, low, high) AS (VALUES {_P2_COLUMNS}),
lines AS (SELECT DISTINCT feed_id, file, line, regexp_replace(regexp_replace(raw, '^\x{{FEFF}}', ''), '\r$', '') AS raw FROM gtfs_lines),
heads AS (SELECT feed_id, file, list_transform(string_split(raw, ','), lambda x: trim(replace(x, '"', ''))) AS names FROM lines WHERE line = 1),
body AS (SELECT l.*, names, regexp_full_match(raw, '(?s){_FIELD}(,{_FIELD})*') AS ok FROM lines l JOIN heads h ON h.feed_id = l.feed_id AND h.file = l.file WHERE line > 1),
cut AS (SELECT *, CASE WHEN ok THEN regexp_extract_all(',' || raw, '(?s),{_FIELD}', 1) END AS parts FROM body),
cells AS (SELECT feed_id, file, line, names[i] AS field, i, trim(CASE WHEN starts_with(parts[i], '"') THEN replace(substr(parts[i], 2, length(parts[i]) - 2), '""', '"') ELSE parts[i] END) AS v
  FROM cut, range(1, 20) t(i) WHERE ok AND len(parts) = len(names) AND i <= len(names)),
judged AS (SELECT c.*, CASE WHEN v = '' THEN CASE WHEN need THEN 'EmptyFieldError' END
  WHEN kind IN ('int', 'double') THEN CASE WHEN NOT regexp_full_match(v, CASE kind WHEN 'int' THEN '[+-]?[0-9]+' ELSE '[+-]?[0-9]+([.][0-9]+)?' END) THEN 'NumberParseError' WHEN NOT (CAST(v AS DOUBLE) BETWEEN low AND high) THEN 'RangeError' END
  WHEN kind = 'time' THEN CASE WHEN NOT regexp_full_match(v, '[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}') THEN 'TimeParseError' WHEN CAST(string_split(v, ':')[1] AS INTEGER) > 72 OR CAST(string_split(v, ':')[2] AS INTEGER) > 59 OR CAST(string_split(v, ':')[3] AS INTEGER) > 59 THEN 'RangeError' END
  WHEN kind = 'date' THEN CASE WHEN NOT regexp_full_match(v, '[0-9]{{8}}') OR try_strptime(v, '%Y%m%d') IS NULL THEN 'DateParseError' WHEN CAST(substr(v, 1, 4) AS INTEGER) NOT BETWEEN 2000 AND 2100 THEN 'RangeError' END
  WHEN kind = 'url' THEN CASE WHEN NOT regexp_full_match(v, 'https?://[^/?#: ]*[^/?#: .][.][^/?#: .][^/?#: ]*([:/?#].*)?') THEN 'URLParseError' END END AS why
  FROM cells c LEFT JOIN spec s ON s.file = c.file AND s.field = c.field)
SELECT feed_id, file, line, '' AS field, 'QuotingError' AS error_type FROM cut WHERE NOT ok
UNION SELECT feed_id, file, line, '', 'ColumnCountError' FROM cut WHERE ok AND len(parts) <> len(names)
UNION SELECT feed_id, file, line, arg_min(field, i), arg_min(why, i) FROM judged WHERE why IS NOT NULL GROUP BY 1, 2, 3
"""


def _bits(part: str) -> str:
    u = f"list_sum(list_transform(range(length({part})), lambda k: ((ascii(substr({part}, CAST(k + 1 AS INTEGER), 1)) - 63) & 31) * CAST(pow(32, k) AS BIGINT)))"
    return f"(CASE WHEN CAST({u} AS BIGINT) % 2 = 1 THEN -(CAST({u} AS BIGINT) // 2) - 1 ELSE CAST({u} AS BIGINT) // 2 END) / 1e5"


_ONE = "^([_-~]*[?-^])([_-~]*[?-^])$"
POSITIONS_SQL = f"""
WITH raw AS (SELECT DISTINCT location_id AS id, coordinates AS c, snapped_waypoints AS s, coordinate AS p FROM locations),
pos AS (SELECT id, CASE WHEN c IS NOT NULL THEN c[2] WHEN s IS NOT NULL THEN CASE WHEN regexp_matches(s, '{_ONE}') THEN {_bits(f"regexp_extract(s, '{_ONE}', 1)")} END ELSE p.lat END AS lat,
  CASE WHEN c IS NOT NULL THEN c[1] WHEN s IS NOT NULL THEN CASE WHEN regexp_matches(s, '{_ONE}') THEN {_bits(f"regexp_extract(s, '{_ONE}', 2)")} END ELSE p.lon END AS lon FROM raw),
ok AS (SELECT * FROM pos WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0))"""

INSIDE_SQL = """
ring AS (SELECT area_id, r, rings[r] AS pts FROM areas, range(1, 10) t(r) WHERE r <= len(rings)), side AS (SELECT area_id, r, pts[i] AS a, pts[i % len(pts) + 1] AS b FROM ring, range(1, 200) t(i) WHERE i <= len(pts)),
box AS (SELECT area_id, min(a.lon) AS x1, max(a.lon) AS x2, min(a.lat) AS y1, max(a.lat) AS y2 FROM side GROUP BY 1), hit AS (SELECT id, lat, lon, area_id FROM ok JOIN box ON lon BETWEEN x1 AND x2 AND lat BETWEEN y1 AND y2),
odd AS (SELECT id, h.area_id, r, count(*) FILTER (WHERE (a.lat > h.lat) <> (b.lat > h.lat) AND h.lon < (b.lon - a.lon) * (h.lat - a.lat) / (b.lat - a.lat) + a.lon) % 2 = 1 AS odd FROM hit h JOIN side s ON s.area_id = h.area_id GROUP BY ALL),
inside AS (SELECT id, area_id FROM odd GROUP BY id, area_id HAVING bool_or(odd AND r = 1) AND NOT bool_or(odd AND r > 1))"""

_P5 = f"""{POSITIONS_SQL}, {INSIDE_SQL},
cells AS (SELECT *, CAST(floor(lat * 1000) AS BIGINT) AS band FROM ok), look AS (SELECT id, lat, lon, band + d AS band FROM cells, (SELECT unnest([-1, 0, 1]) AS d)),
near AS (SELECT a.id AS x, b.id AS y FROM look a JOIN cells b ON a.band = b.band AND a.id < b.id AND 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 30)
SELECT 'near' AS relation, x AS location_id, CAST(y AS VARCHAR) AS other_id FROM near
UNION ALL SELECT 'inside', id, area_id FROM inside
"""

SQL = {
    "p1_found": _P1,
    "p2_found": _P2,
    "p3_found": _P3,
    "p4_found": _P4,
    "p5_found": _P5,
    "p6_found": f"WITH {_P6_BASE} SELECT * FROM found",
    "p6_report": f"WITH {_P6_BASE} SELECT file, field, kind, period, count(*) AS orphans, count(DISTINCT feed_id) AS feeds FROM found GROUP BY ALL",
}
