"""Delimited records that do not fit their file: kept apart with a reason, the rest loaded as typed rows.

A record is parsed at minimum cost: one dynamic program over the position, the
state of quoting and the column inserts and deletes quotes and delimiters until
the text is a list of well formed fields, as many as the header has.  Of the
repairs of least cost the one with fewest values that do not fit their column
holds, so typed values stay in their columns.  A record of cost zero with valid
values loads; for the others the edit operations state the reason.

Records that need no edit are recognised by compiled patterns, so the program
runs for the others only.  It is the same for records of any length.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.session import join_small, map_arrow, widen

BOM = "﻿"
BLANKS = " \t\r\n\f\v "

#: Columns of each file as (kind, required, least, most); other columns are free text.
FILES: dict[str, dict[str, tuple[str, bool, float | None, float | None]]] = {
    "stops": {
        "stop_id": ("text", True, None, None), "stop_name": ("text", True, None, None), "stop_desc": ("text", False, None, None),
        "stop_lat": ("double", True, -90, 90), "stop_lon": ("double", True, -180, 180), "zone_id": ("text", False, None, None),
        "stop_url": ("url", False, None, None), "location_type": ("int", False, 0, 4), "parent_station": ("text", False, None, None),
    },
    "stop_times": {
        "trip_id": ("text", True, None, None), "arrival_time": ("time", False, None, None), "departure_time": ("time", False, None, None),
        "stop_id": ("text", True, None, None), "stop_sequence": ("int", True, 0, 2147483647), "stop_headsign": ("text", False, None, None),
        "pickup_type": ("int", False, 0, 3), "drop_off_type": ("int", False, 0, 3), "shape_dist_traveled": ("double", False, 0, 1e9),
    },
    "calendar_dates": {"service_id": ("text", True, None, None), "date": ("date", True, None, None), "exception_type": ("int", True, 1, 2)},
    "frequencies": {"trip_id": ("text", True, None, None), "start_time": ("time", True, None, None), "end_time": ("time", True, None, None), "headway_secs": ("int", True, 1, 86400)},
    "routes": {
        "route_id": ("text", True, None, None), "agency_id": ("text", False, None, None), "route_short_name": ("text", False, None, None), "route_long_name": ("text", False, None, None),
        "route_type": ("int", True, 0, 1702), "route_url": ("url", False, None, None), "route_color": ("text", False, None, None),
    },
}

_INT = re.compile(r"[+-]?[0-9]+")
_DOUBLE = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?")
_TIME = re.compile(r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})")
_DATE = re.compile(r"[0-9]{8}")
_URL = re.compile(r"https?://(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::[0-9]*)?(?:[/?#]\S*)?", re.I)
_SCHEME = re.compile(r"https?://", re.I)
_FREE = ("text", False, None, None)


def value_error(text: str, column: tuple[str, bool, float | None, float | None]) -> str | None:
    """Why a value does not fit its column, or None.  Blanks around it are ignored."""
    kind, required, low, high = column
    v = text.strip(BLANKS)
    if not v:
        return "EmptyFieldError" if required else None
    if kind == "int" or kind == "double":
        if not (_INT if kind == "int" else _DOUBLE).fullmatch(v):
            return "NumberParseError"
        x = int(v) if kind == "int" and len(v) < 400 else float(v)
        return None if low <= x <= high else "RangeError"
    if kind == "time":
        m = _TIME.fullmatch(v)
        if not m:
            return "TimeParseError"
        return None if int(m[1]) <= 72 and int(m[2]) < 60 and int(m[3]) < 60 else "RangeError"
    if kind == "date":
        if not _DATE.fullmatch(v):
            return "DateParseError"
        try:
            year = dt.date(int(v[:4]), int(v[4:6]), int(v[6:])).year
        except ValueError:
            return "DateParseError"
        return None if 2000 <= year <= 2100 else "RangeError"
    if kind == "url":
        m = _URL.fullmatch(v)
        return None if m and "." in m[1].strip(".") else "URLParseError"
    return None


_TOKEN = re.compile(r'"|,|[^",]+')
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_WELL_FORMED = re.compile(f"{_FIELD}(?:,{_FIELD})*")
_ONE_FIELD = re.compile(f"({_FIELD})(?:,|$)")
_S, _P, _Q, _E = range(4)
_NEVER = 1 << 30


def split_fields(raw: str) -> list[str] | None:
    """Fields of a record whose quotes are well formed, else None."""
    if '"' not in raw:
        return raw.split(",")
    if not _WELL_FORMED.fullmatch(raw):
        return None
    fields, at = [], 0
    while at <= len(raw):
        m = _ONE_FIELD.match(raw, at)
        f = m[1]
        fields.append(f[1:-1].replace('""', '"') if f.startswith('"') else f)
        at += len(f) + 1
    return fields


def _costs(tokens: list[str], m: int) -> list[list[list[int]]]:
    """Fewest edits from each token, state and column to the end.

    States: S at the start of a field, P in a plain field, Q inside quotes, E
    just behind a closing quote, which may be the first half of a doubled one.
    """
    done = [[_NEVER] * m for _ in range(4)]
    for s in (_S, _P, _E):
        done[s][m - 1] = 0
    out = [done]
    for token in [None, *reversed(tokens)]:
        n = out[-1]
        if token is None:
            S, P, Q, E = n
            out = []
        elif token == '"':
            S = [min(a, b + 1) for a, b in zip(n[_Q], n[_S])]
            P = [a + 1 for a in n[_P]]
            Q = [min(a, b + 1) for a, b in zip(n[_E], n[_Q])]
            E = [min(a, b + 1) for a, b in zip(n[_Q], n[_E])]
        elif token == ",":
            nxt = [*n[_S][1:], _NEVER]
            S, P, E = ([min(a, b + 1) for a, b in zip(nxt, n[s])] for s in (_S, _P, _E))
            Q = n[_Q][:]
        else:
            S, P, Q, E = n[_P][:], n[_P], n[_Q][:], [_NEVER] * m
            P = P[:]
        up = _NEVER
        for j in range(m - 1, -1, -1):
            P[j] = min(P[j], up)
            e = min(E[j], up)
            Q[j] = min(Q[j], e + 1)
            E[j] = min(e, Q[j] + 1)
            S[j] = min(S[j], up, Q[j] + 1)
            up = S[j] + 1
        out.append([S, P, Q, E])
    return out[::-1]


def repair(raw: str, columns: list[tuple]) -> tuple[int, list[str], list[str]]:
    """Fewest insertions and deletions of quotes and delimiters that make ``raw`` a list of fields as long as ``columns``: (cost, values, edits).

    A delimiter taken out stays in its value as text.  Of repairs of equal cost
    the one with fewest unfit values holds; within a field the edits first
    found do.  The time grows with the length of the record times its columns:
    a value with a delimiter in it fits a text and no other kind, so where such
    a value began need not be remembered; only addresses may hold delimiters.
    """
    m = len(columns)
    tokens = _TOKEN.findall(raw)
    place = [0]
    for x in tokens:
        place.append(place[-1] + len(x))
    end = len(tokens)
    left = _costs(tokens, m)
    # nodes: (token, state, column, start of the value or -1 where it holds a delimiter)
    start = (0, _S, 0, 0)
    links: dict[tuple, tuple] = {start: (0, None, None, "", False)}
    best: dict[tuple, int] = {start: 0}
    finish: tuple | None = None
    least = _NEVER

    def value(node: tuple) -> str:
        parts = []
        while True:
            _, back, _, piece, opens = links[node]
            if opens or back is None:
                return "".join(reversed(parts))
            parts.append(piece)
            node = back

    def unfit(node: tuple) -> int:
        return 0 if node[3] < 0 else int(value_error(value(node), columns[node[2]]) is not None)

    levels: list[list[tuple]] = [[] for _ in range(end + 1)]
    levels[0].append(start)
    for t in range(end + 1):
        queue = levels[t]
        token = tokens[t] if t < end else None
        i = 0
        while i < len(queue):
            node = queue[i]
            i += 1
            _, s, j, began = node
            have, cost = best[node], left[t][s][j]

            def go(t2: int, s2: int, price: int, edit: str | None, piece: str = "", nxt: bool = False, comma: bool = False) -> None:
                j2 = j + nxt
                if j2 == m or left[t2][s2][j2] + price != cost:
                    return
                ways = [(t2 if nxt else began, have + unfit(node) if nxt else have)]
                if comma and began >= 0:
                    ways = [(-1, have + (columns[j][0] != "text"))]
                    if columns[j][0] == "url" and _SCHEME.match(value(node).lstrip(BLANKS)):
                        ways.append((began, have))
                for b2, u2 in ways:
                    to = (t2, s2, j2, b2)
                    if u2 < best.get(to, _NEVER):
                        if to not in best or t2 == t:
                            levels[t2].append(to)
                        best[to] = u2
                        links[to] = (u2, node, edit, piece, nxt)

            at = place[t]
            if token == '"':
                if s == _S:
                    go(t + 1, _Q, 0, None)
                elif s == _Q:
                    go(t + 1, _E, 0, None)
                    go(t + 1, _Q, 1, f"insert quote at {at}", '"')
                elif s == _E:
                    go(t + 1, _Q, 0, None, '"')
                go(t + 1, s, 1, f"delete quote at {at}")
            elif token == ",":
                if s == _Q:
                    go(t + 1, _Q, 0, None, ",", comma=True)
                else:
                    go(t + 1, _S, 0, None, nxt=True)
                    go(t + 1, s, 1, f"delete delimiter at {at}", ",", comma=True)
            elif token is not None and s != _E:
                go(t + 1, _P if s == _S else s, 0, None, token)
            if s == _S:
                go(t, _Q, 1, f"insert quote at {at}")
            if s == _Q:
                go(t, _E, 1, f"insert quote at {at}")
            else:
                go(t, _S, 1, f"insert delimiter at {at}", nxt=True)
            if s == _E:
                go(t, _Q, 1, f"insert quote at {at}", '"')
            if t == end and s != _Q and j == m - 1 and cost == 0 and have + unfit(node) < least:
                finish, least = node, have + unfit(node)
    values, edits, parts, node = [], [], [], finish
    while node is not None:
        _, back, edit, piece, opens = links[node]
        parts.append(piece)
        if edit:
            edits.append(edit)
        if opens or back is None:
            values.append("".join(reversed(parts)))
            parts = []
        node = back
    return left[0][_S][0], values[::-1], edits[::-1]


def parse_record(raw: str, names: list[str], columns: list[tuple]) -> tuple[list[str], str, str | None, int, list[str]]:
    """(values, field, error type, cost, edits) of one record; the error type is None for a valid one."""
    text = raw.removeprefix(BOM)
    text = text.removesuffix("\r")
    fields = split_fields(text)
    if fields is None or len(fields) != len(columns):
        cost, values, edits = repair(text, columns)
        return values, "", "QuotingError" if fields is None else "ColumnCountError", cost, edits
    for name, value, column in zip(names, fields, columns):
        if why := value_error(value, column):
            return fields, name, why, 1, [f"replace value of {name}"]
    return fields, "", None, 0, []


# Patterns of values that surely fit; whatever they miss is judged by value_error.
_SURE = {"time": r"(?:[0-6]?[0-9]:[0-5][0-9]:[0-5][0-9])", "date": r"(?:20[0-9][0-9](?:0[1-9]|1[0-2])(?:0[1-9]|1[0-9]|2[0-8]))", "url": r"(?:https?://[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/[a-zA-Z0-9/._-]*)?)"}


def _sure(column: tuple) -> str:
    kind, required, low, high = column
    if kind == "text":
        return r'(?:[^",\s][^",\r\n]*|"[^",\s][^"]*")' if required else r'(?:[^",\r\n]*|"[^"]*")'
    if kind == "int":
        top = int(high)
        body = rf"[1-{top}]" if low == 1 and top < 10 else rf"[0-{min(9, top)}]" if top < 10 else rf"[1-9][0-9]{{0,{len(str(top)) - 2}}}"
    elif kind == "double":
        body = r"-?[0-8]?[0-9](?:\.[0-9]{1,15})?" if low == -90 else r"-?(?:1[0-7][0-9]|[0-9]{1,2})(?:\.[0-9]{1,15})?" if low == -180 else r"[0-9]{1,8}(?:\.[0-9]{1,15})?"
    else:
        body = _SURE[kind]
    return f"(?:{body})" if required else f"(?:{body})?"


@lru_cache(maxsize=2048)
def _plan(file: str, header: str) -> tuple[list[str], list[tuple], re.Pattern]:
    text = header.removeprefix(BOM).removesuffix("\r")
    names = [x.strip(BLANKS) for x in split_fields(text) or text.replace('"', "").split(",")]
    columns = [FILES.get(file, {}).get(x, _FREE) for x in names]
    return names, columns, re.compile(",".join(map(_sure, columns)) + "\r?")


_OUT = pa.schema([("values", pa.list_(pa.string())), ("columns", pa.list_(pa.string())), ("field", pa.string()), ("error_type", pa.string()), ("cost", pa.int32()), ("edits", pa.list_(pa.string()))])
_KEPT = "feed_id string, file string, line bigint, raw string, received_at timestamp_ntz"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [[], [], [], [], [], []]
        for file, raw, header in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "raw", "header"))):
            if raw is None or header is None:
                row = ([], [], "", "MissingHeaderError" if header is None else "MissingRecordError", 0, [])
            else:
                names, columns, sure = _plan(file or "", header)
                if sure.fullmatch(raw):
                    row = (split_fields(raw.removesuffix("\r")), names, "", None, 0, [])
                else:
                    values, field, why, cost, edits = parse_record(raw, names, columns)
                    row = (values, names, field, why, cost, edits)
            for c, v in zip(cols, row):
                c.append(v)
        made = [pa.array(v, f.type) for v, f in zip(cols, _OUT)]
        keep = [b.column(b.schema.get_field_index(c)) for c in ("feed_id", "file", "line", "raw", "received_at")]
        yield pa.RecordBatch.from_arrays([*keep, *made], names=["feed_id", "file", "line", "raw", "received_at", *_OUT.names])


def judge_lines(lines: DataFrame) -> DataFrame:
    """Every record (line above 1) with its values, column names, error and edit operations.

    lines(feed_id, file, line, raw, received_at); the header of a (feed, file)
    is its line 1, the earliest received one.  error_type is null for valid
    records.  Records of a file without header get ``MissingHeaderError`` and
    null records ``MissingRecordError``; rows with a null line are dropped by
    neither: they count as records.  Files of unknown kind have free-text
    columns only.  Repeated rows stay repeated.  Other columns are ignored.
    """
    rows = lines.select("feed_id", "file", F.col("line").cast("bigint").alias("line"), "raw", F.col("received_at").cast("timestamp_ntz").alias("received_at"))
    heads = rows.filter((F.col("line") == 1) & F.col("raw").isNotNull()).groupBy(F.col("feed_id").alias("f2"), F.col("file").alias("k2")).agg(F.min_by("raw", F.struct("received_at", "raw")).alias("header"))
    body = widen(rows).filter(F.coalesce(F.col("line") > 1, F.lit(True)))
    # One header a file: where they fit a broadcast, the lines stay where they were read.
    joined = join_small(body, heads, F.col("feed_id").eqNullSafe(F.col("f2")) & F.col("file").eqNullSafe(F.col("k2"))).drop("f2", "k2")
    made = "values array<string>, columns array<string>, field string, error_type string, cost int, edits array<string>"
    return map_arrow(joined, _judge, f"{_KEPT}, {made}")


def faulty_records(judged: DataFrame) -> DataFrame:
    """Distinct (feed_id, file, line, field, error_type) of faulty records of files that have a header."""
    bad = judged.filter(F.col("error_type").isNotNull() & ~F.col("error_type").isin("MissingHeaderError", "MissingRecordError"))
    return bad.select("feed_id", "file", "line", "field", "error_type").distinct()


def rejects(judged: DataFrame) -> DataFrame:
    """Faulty records with the edit operations that would mend them, once each."""
    bad = judged.filter(F.col("error_type").isNotNull())
    return bad.select("feed_id", "file", "line", "raw", "field", "error_type", "cost", F.array_join("edits", "; ").alias("edits")).distinct()


def typed_rows(judged: DataFrame, file: str) -> DataFrame:
    """Valid records of ``file`` as typed columns; empty and absent optional values are null, times are seconds.

    A record delivered again under the same feed and line counts once; of a
    column name that a header repeats the first column holds.
    """
    rows = judged.filter((F.col("file") == file) & F.col("error_type").isNull()).dropDuplicates(["feed_id", "file", "line", "raw"])
    rows = rows.select("feed_id", "line", "columns", "values")
    out = []
    for name, (kind, *_) in FILES[file].items():
        cell = F.get("values", F.array_position("columns", name) - 1)
        v = F.trim(F.translate(cell, BLANKS, " " * len(BLANKS)))
        v = F.when(v != "", v)
        if kind == "int":
            v = v.cast("bigint")
        elif kind == "double":
            v = v.cast("double")
        elif kind == "time":
            p = F.split(v, ":")
            v = (p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")).cast("int")
        elif kind == "date":
            v = F.to_date(v, "yyyyMMdd")
        out.append(v.alias(name))
    return rows.select("feed_id", "line", *out)
