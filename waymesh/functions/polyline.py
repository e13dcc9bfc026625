"""Encoded polylines: five bits a character, zigzag differences, a factor (1e5 by default)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _varint(text: Column) -> Column:
    """Signed number of one chunk of a polyline, as bigint."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    bits = F.aggregate(
        F.sequence(F.lit(0), F.length(text) - 1),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR((F.get(codes, i) - 63).bitwiseAND(31).cast("bigint") * F.pow(F.lit(32.0), i).cast("bigint")),
    )
    half = F.shiftrightunsigned(bits, 1)
    return F.when(bits % 2 == 1, -half - 1).otherwise(half)


def decode_point(text: Column, factor: float = 1e5) -> Column:
    """struct(lat, lon) of a polyline of exactly one point; null for any other text.

    Stays in the JVM: characters from '_' on continue a number, those below end it.
    """
    one = "^([_-~]{0,8}[?-^])([_-~]{0,8}[?-^])$"
    lat, lon = F.regexp_extract(text, one, 1), F.regexp_extract(text, one, 2)
    point = F.struct((_varint(lat) / factor).alias("lat"), (_varint(lon) / factor).alias("lon"))
    return F.when(text.rlike(one), point)


def decode(text: str | None, factor: float = 1e5) -> list[tuple[float, float]] | None:
    """Points (lat, lon) of one polyline; None if it is null or ends within a number or a point."""
    if text is None:
        return None
    values, acc, shift = [], 0, 0
    for ch in text:
        c = ord(ch) - 63
        if not 0 <= c < 64:
            return None
        acc |= (c & 31) << shift
        shift += 5
        if c < 32:
            values.append(~(acc >> 1) if acc & 1 else acc >> 1)
            acc = shift = 0
    if shift or len(values) % 2:
        return None
    out, lat, lon = [], 0, 0
    for a, b in zip(values[::2], values[1::2]):
        lat, lon = lat + a, lon + b
        out.append((lat / factor, lon / factor))
    return out


def encode(points: list[tuple[float, float]], factor: float = 1e5) -> str:
    """The polyline of ``points`` (lat, lon), each rounded to the nearest unit."""
    out, before = [], [0, 0]
    for point in points:
        for k, v in enumerate(point):
            unit = int(round(v * factor))
            d, before[k] = unit - before[k], unit
            d = ~(d << 1) if d < 0 else d << 1
            while d >= 32:
                out.append(chr((d & 31 | 32) + 63))
                d >>= 5
            out.append(chr(d + 63))
    return "".join(out)


def decode_points(text: Column) -> Column:
    """array<struct<lat,lon>> of a polyline of any length, in Arrow batches; null where ``decode`` gives None."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if (p := decode(t)) is None else [{"lat": a, "lon": b} for a, b in p])

    return F.pandas_udf(run, "array<struct<lat:double,lon:double>>")(text)


def encode_points(points: Column) -> Column:
    """The polyline of an array<struct<lat,lon>>, in Arrow batches; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda ps: None if ps is None else encode([(p["lat"], p["lon"]) for p in ps]))

    return F.pandas_udf(run, "string")(points)
