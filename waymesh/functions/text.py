"""Text functions: similarity of names, cleaning, times and durations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _jaro_winkler(a: str, b: str, weight: float = 0.1, most: int = 4) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    first = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    if not first:
        return 0.0
    second = [ch for ch, u in zip(b, used) if u]
    m, swaps = len(first), sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(most, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity in 0..1, in Arrow batches; null if either text is null.  Two empty texts are alike."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([None if p is None or q is None else _jaro_winkler(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def seconds_of_time(text: Column) -> Column:
    """H:MM:SS, hours beyond 24 allowed, as seconds; null for any other text."""
    p = F.split(F.trim(text), ":")
    return F.when(F.trim(text).rlike("^[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]$"), p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int"))


def time_of_seconds(seconds: Column) -> Column:
    """Seconds as H:MM:SS; hours may pass 24."""
    s = seconds.cast("int")
    return F.format_string("%d:%02d:%02d", F.expr("1") * F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), (s % 60).cast("int"))


def seconds_of_duration(text: Column) -> Column:
    """OSM durations: MM, HH:MM, HH:MM:SS or ISO 8601 PnDTnHnMnS as seconds; null for any other text."""
    t = F.trim(text)
    p = F.split(t, ":")
    iso = "^P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(t, iso, i).try_cast("bigint"), F.lit(0))
    return (
        F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint") * 60)
        .when(t.rlike("^[0-9]+:[0-9]{1,2}$"), p[0].try_cast("bigint") * 3600 + p[1].try_cast("bigint") * 60)
        .when(t.rlike("^[0-9]+:[0-9]{1,2}:[0-9]{1,2}$"), p[0].try_cast("bigint") * 3600 + p[1].try_cast("bigint") * 60 + F.get(p, F.lit(2)).try_cast("bigint"))
        .when(t.rlike(iso) & (F.length(t) > 1), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))
    )


def clean_name(text: Column) -> Column:
    """Separators ';' become commas, spaces are single; empty becomes null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, ";[ ]*", ", "), "\\s+", " "))
    return F.when(t != "", t)


def snake_case(text: Column) -> Column:
    """camelCase to snake_case."""
    return F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2"))


def camel_case(text: Column) -> Column:
    """snake_case to camelCase."""
    t = F.replace(F.initcap(F.translate(text, "_", " ")), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes that ends between characters."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most)
    sizes = F.transform(F.sequence(F.lit(0), F.least(F.length(text), F.lit(most))), lambda i: F.octet_length(F.substring(text, F.lit(1), i)))
    fits = F.size(F.filter(sizes, lambda n: n <= most)) - 1
    return F.when(F.octet_length(text) <= most, text).when(F.length(cut) > 0, F.substring(text, F.lit(1), fits)).otherwise("")
