"""Dates and durations as people and map tags write them."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months and weekdays in tags.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")


@dataclass(frozen=True)
class Moment:
    """A date of which year, month and day may be missing, or a weekday."""

    year: int | None = None
    month: int | None = None
    day: int | None = None
    weekday: int | None = None


def parse_moment(text: str) -> Moment | None:
    """``2024 Mar 5``, ``Mar 5``, ``Mar``, ``2024-03-05``, ``2024 Mar`` or a weekday; None for any other text."""
    t = text.strip().lower()
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", t):
        return Moment(*map(int, m.groups()))
    if t[:2] in DAYS and re.fullmatch(r"[a-z]{2,9}\.?", t):
        return Moment(weekday=DAYS.index(t[:2])) if t[:3] not in MONTHS else Moment(month=MONTHS.index(t[:3]) + 1)
    m = re.fullmatch(r"(?:(\d{4})[\s,]+)?([a-z]{3})[a-z]*\.?(?:\s+(\d{1,2}))?", t)
    if m and m[2] in MONTHS:
        return Moment(int(m[1]) if m[1] else None, MONTHS.index(m[2]) + 1, int(m[3]) if m[3] else None)
    return None


def in_range(text: str, day: dt.date) -> bool | None:
    """Whether a day lies in a range like ``Nov - Mar``, ``2023 Oct 23 - 2024 Jan 5`` or ``Mo - Fr``; None if unreadable.

    Ranges without year come back every year and may run over its end; single
    dates are ranges of themselves.  Public and school holidays (PH, SH) are
    not known and left out.
    """
    t = re.sub(r"\b(?:PH|SH)\b[,;]?", "", text.replace("–", "-")).strip(" ,;")
    parts = [t] if re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", t) else [p for p in re.split(r"\s+-\s+|(?<=[a-zA-Z0-9])-(?=[a-zA-Z])", t) if p]
    if not 1 <= len(parts) <= 2:
        return None
    a = parse_moment(parts[0])
    b = parse_moment(parts[-1])
    if b is None and a and a.month and re.fullmatch(r"\d{1,2}", parts[-1].strip()):
        b = Moment(a.year, a.month, int(parts[-1]))
    if a is None or b is None or (a.weekday is None) != (b.weekday is None):
        return None
    if a.weekday is not None:
        return (day.weekday() - a.weekday) % 7 <= (b.weekday - a.weekday) % 7
    low, high = (a.month, a.day or 1), (b.month, b.day or 31)
    at = (day.month, day.day)
    if a.year or b.year:
        return (a.year or b.year, *low) <= (day.year, *at) <= (b.year or a.year, *high)
    return low <= at <= high if low <= high else at >= low or at <= high


def conditional_value(text: str, day: dt.date) -> str | None:
    """Value of a conditional tag (``no @ (Nov - Mar); yes @ (Mo)``) on a day: of the last condition that holds."""
    out = None
    for m in re.finditer(r"([^@;]+)@\s*(?:\(([^)]*)\)|([^;]*))", text or ""):
        if in_range(m[2] or m[3] or "", day):
            out = m[1].strip()
    return out


def conditional_on(tag: Column, day: dt.date) -> Column:
    """``conditional_value`` of a column, in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: conditional_value(t, day) if t else None).astype(object)

    return F.pandas_udf(run, "string")(tag)


def spoken_distance(metres: Column, imperial: bool = False) -> Column:
    """Distance for announcements: rounded to 10 m or 50 ft below a kilometre or mile, else to a tenth."""
    far, near, unit, small, step = (1609.344, 0.3048, "mi", "ft", 50) if imperial else (1000.0, 1.0, "km", "m", 10)
    big = F.concat(F.regexp_replace(F.round(metres / far, 1).cast("string"), "\\.0$", ""), F.lit(f" {unit}"))
    return F.when(metres >= far, big).otherwise(F.concat((F.round(metres / near / step) * step).cast("int").cast("string"), F.lit(f" {small}")))


def stable_hash(text: Column) -> Column:
    """The 31-based polynomial hash of UTF-16 units as a signed int, for texts of ASCII letters the same in every engine."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    wrap = lambda v: F.pmod(v + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, c: wrap(acc * 31 + c)).cast("int")
