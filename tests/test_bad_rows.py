import datetime as dt
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymesh.operators import bad_rows as br

STOPS = "stop_id,stop_name,stop_lat,stop_lon,location_type,stop_url"


def judge(raw, header=STOPS, file="stops"):
    names, columns, sure = br._plan(file, header)
    out = br.parse_record(raw, names, columns)
    if sure.fullmatch(raw):
        assert out[2] is None and out[0] == br.split_fields(raw.removesuffix("\r")), raw
    return out[1], out[2]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("S1,Foo,1.5,2,0,", ("", None)),
        ('S1,"Foo, bar",1.5,2,,', ("", None)),
        ('S1,"Foo ""x"" bar",1.5,2,,\r', ("", None)),
        ('S1,"Foo\nbar",1.5,2,,', ("", None)),
        ('S1,Foo "x",1.5,2,,', ("", "QuotingError")),
        ('S1, "Foo",1.5,2,,', ("", "QuotingError")),
        ('S1,"Foo"x,1.5,2,,', ("", "QuotingError")),
        ('S1,"Foo,1.5,2,,', ("", "QuotingError")),
        ("S1,Foo,1.5,2,0", ("", "ColumnCountError")),
        ("", ("", "ColumnCountError")),
        ("S1,Foo,1.5,2,0,,", ("", "ColumnCountError")),
        (" ,Foo,1.5,2,0,", ("stop_id", "EmptyFieldError")),
        ("S1,Foo,x,2,9,", ("stop_lat", "NumberParseError")),
        ("S1,Foo,91,2,9,", ("stop_lat", "RangeError")),
        ("S1,Foo, +1.5 ,-180,5,", ("location_type", "RangeError")),
        ("S1,Foo,1.,2,0,", ("stop_lat", "NumberParseError")),
        ("S1,Foo,½,2,0,", ("stop_lat", "NumberParseError")),
        ("S1,Foo,1e1,2,0,", ("stop_lat", "NumberParseError")),
        ("S1,Foo,1,2,0.0,", ("location_type", "NumberParseError")),
        ("S1,Foo,1,2,,http://localhost/x", ("stop_url", "URLParseError")),
        ("S1,Foo,1,2,,https://a.example/x?y=1", ("", None)),
        ("S1,Foo,1,2,,ftp://a.example", ("stop_url", "URLParseError")),
    ],
)
def test_stops(raw, want):
    assert judge(raw) == want


@pytest.mark.parametrize("value, want", [("7:05:09", None), ("72:59:59", None), ("73:00:00", "RangeError"), ("07:60:00", "RangeError"), ("7:5:9", "TimeParseError"), ("123:00:00", "TimeParseError"), ("", "EmptyFieldError")])
def test_times(value, want):
    assert br.value_error(value, br.FILES["frequencies"]["start_time"]) == want


@pytest.mark.parametrize("value, want", [("20240229", None), ("20230229", "DateParseError"), ("19991231", "RangeError"), ("2024-01-01", "DateParseError"), ("20241301", "DateParseError"), ("00000101", "DateParseError")])
def test_dates(value, want):
    assert br.value_error(value, br.FILES["calendar_dates"]["date"]) == want


def strict(raw):
    """Plain reading of the quoting rule, by states."""
    i, n, fields = 0, len(raw), []
    while True:
        if i < n and raw[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return None
                if raw[i] == '"':
                    if i + 1 < n and raw[i + 1] == '"':
                        i += 2
                        continue
                    i += 1
                    break
                i += 1
            if i < n and raw[i] != ",":
                return None
            fields.append(None)
        else:
            j = i
            while i < n and raw[i] != ",":
                if raw[i] == '"':
                    return None
                i += 1
            fields.append(raw[j:i])
        if i >= n:
            return fields
        i += 1


def edits_brute(raw, m, most=3):
    """Fewest insertions and deletions of quotes and delimiters, by trying."""
    level, seen = {raw}, {raw}
    for k in range(most + 1):
        if any((f := strict(x)) is not None and len(f) == m for x in level):
            return k
        if k == most:
            break
        near = {x[:i] + x[i + 1 :] for x in level for i in range(len(x)) if x[i] in '",'} | {x[:i] + c + x[i:] for x in level for i in range(len(x) + 1) for c in '",'}
        level = near - seen
        seen |= level
    return most + 1


def applied(raw, edits):
    """The record with the edits made; positions are those of the record as it was."""
    ins = {}
    gone = set()
    for e in edits:
        what, kind, _, at = e.split(" ")
        if what == "delete":
            gone.add(int(at))
        else:
            ins.setdefault(int(at), []).append('"' if kind == "quote" else ",")
    out = []
    for i in range(len(raw) + 1):
        out += ins.get(i, [])
        if i < len(raw) and i not in gone:
            out.append(raw[i])
    return "".join(out)


TEXT = ("text", False, None, None)


def test_repair_is_minimal():
    for n in range(6):
        for t in itertools.product('",a', repeat=n):
            raw = "".join(t)
            fields = strict(raw)
            assert (br.split_fields(raw) is None) == (fields is None), raw
            if fields is not None:
                assert len(br.split_fields(raw)) == len(fields)
            for m in (1, 2, 3):
                cost, values, edits = br.repair(raw, [TEXT] * m)
                assert len(values) == m and len(edits) == cost, (raw, m, values, edits)
                made = strict(applied(raw, edits))
                assert made is not None and len(made) == m, (raw, m, edits)
                assert (cost == 0) == (fields is not None and len(fields) == m), raw
                if n < 5 and cost <= 3:
                    assert cost == edits_brute(raw, m, cost), (raw, m, cost, edits)


@settings(max_examples=60, deadline=None)
@given(st.text('",a1', min_size=6, max_size=8), st.integers(1, 3))
def test_repair_is_minimal_for_longer_records(raw, m):
    cost, values, edits = br.repair(raw, [TEXT, ("int", True, 0, 9), TEXT][:m])
    made = strict(applied(raw, edits))
    assert len(edits) == cost and len(made) == m
    assert edits_brute(raw, m, min(cost, 2)) >= min(cost, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_characters="\r", blacklist_categories=("Cs",)), max_size=8), min_size=1, max_size=5))
def test_quoted_round_trip(fields):
    raw = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert br.split_fields(raw) == fields
    assert br.repair(raw, [TEXT] * len(fields)) == (0, fields, [])


def test_quotes_and_delimiters_are_mended_together():
    assert br.repair('a,"b,c,d', [TEXT] * 3)[:2] == (1, ["a", "b,c", "d"])
    assert br.repair('a,b",c,"d,e', [TEXT] * 4)[0] == 2
    assert br.repair("x,1,2", [TEXT, ("int", True, 0, 5)])[:2] == (1, ["x,1", "2"])
    url = ("url", False, None, None)
    assert br.repair("x,https://a.example/p,q,3", [TEXT, url, ("int", True, 0, 9)])[:2] == (1, ["x", "https://a.example/p,q", "3"])


def test_repair_keeps_typed_values_in_place():
    _, columns, _ = br._plan("stop_times", "trip_id,arrival_time,departure_time,stop_id,stop_sequence")
    n, values, edits = br.repair("T1,07:00:00,S1,3", columns)
    assert n == 1 and values == ["T1", "", "07:00:00", "S1", "3"] or values == ["T1", "07:00:00", "", "S1", "3"]
    assert edits and edits[0].startswith("insert delimiter")
    n, values, edits = br.repair("T1,07:00:00,07:00:00,S,1,3", columns)
    assert (n, values, edits) == (1, ["T1", "07:00:00", "07:00:00", "S,1", "3"], ["delete delimiter at 22"])
    n, values, _ = br.repair(",".join(["x"] * 5000), columns)
    assert n == 2 and len(values) == 5  # two quotes around the surplus
    assert br.repair("", columns)[0] == 4
    columns = [TEXT, ("int", True, 0, 9), TEXT] + [TEXT] * 60
    n, values, _ = br.repair("a,b,5,c,d" + "," * 60, columns)
    assert (n, values[:2]) == (2, ["a,b", "5"])


def test_repair_tries_all_joins_of_long_records():
    number = ("int", True, 0, 9)
    n, values, edits = br.repair(",".join(["x"] * 30 + ["5"] + ["x"] * 39), [TEXT, number, TEXT])
    assert (n, len(edits), len(values)) == (2, 2, 3)
    assert br.repair('x"' * 2000, [TEXT])[0] == 2000


def test_repeated_column_names(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("f", "routes", 1, "route_id,route_id,route_type", at), ("f", "routes", 2, "A,B,3", at)]
    df = spark.createDataFrame(rows, "feed_id string, file string, line bigint, raw string, received_at timestamp_ntz")
    assert [(r["route_id"], r["route_type"], r["agency_id"]) for r in br.typed_rows(br.judge_lines(df), "routes").collect()] == [("A", 3, None)]


def test_tables(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("f", "stops", 1, br.BOM + '"stop_id",stop_name,stop_lat,stop_lon\r', at), ("f", "stops", 2, "A,x,1,2\r", at), ("f", "stops", 2, "A,x,1,2\r", at), ("f", "stops", 3, "B,x,1", at), ("f", "stops", 3, "B,x,1", at), ("f", "other", 1, "a,b", at), ("f", "other", 2, "1,2", at), ("g", "stops", 2, "A,x,1,2", at), ("f", "stops", 4, None, None), (None, "stops", 1, "stop_id", at), (None, "stops", 2, "", at), ("f", "stops", 5, "Z" * 300_000 + ',"x",1,2', at)]
    df = spark.createDataFrame(rows, "feed_id string, file string, line bigint, raw string, received_at timestamp_ntz").withColumn("values", br.F.lit(1))
    j = br.judge_lines(df)
    assert {tuple(r) for r in br.faulty_records(j).collect()} == {("f", "stops", 3, "", "ColumnCountError"), (None, "stops", 2, "stop_id", "EmptyFieldError")}
    t = br.typed_rows(j, "stops").orderBy("line").collect()
    assert [(r["line"], r["stop_name"], r["stop_lat"], r["zone_id"]) for r in t] == [(2, "x", 1.0, None), (5, "x", 1.0, None)]
    kinds = {(r["feed_id"], r["line"], r["error_type"]) for r in br.rejects(j).collect()}
    assert {("g", 2, "MissingHeaderError"), ("f", 4, "MissingRecordError")} <= kinds
    assert br.faulty_records(br.judge_lines(df.limit(0))).count() == 0
