"""Date expressions over ISO strings: Column -> Column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that a free-form date may have, in the order they are tried.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd MMM yyyy", "MMMM d, yyyy", "yyyyMMdd")


def normalised(c: Column | str) -> Column:
    """A DATE from a string in one of FORMATS (a zone or fraction after the seconds is ignored); null if none fits."""
    t = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"(?<=:\d\d)([.]\d+)?(Z|[+-]\d\d:?\d\d)?$", "")
    return F.coalesce(*(F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in FORMATS))


def period(date: Column, unit: str) -> Column:
    """Key of a day, week (its Monday), month (its first), year, or `all`, as a string; null for a null date."""
    if unit == "all":
        return F.when(date.isNotNull(), F.lit("all"))
    if unit == "year":
        return F.year(date).cast("string")
    if unit not in ("day", "week", "month"):
        raise ValueError(unit)
    return F.date_format(F.date_trunc(unit, date), "yyyy-MM-dd")


def in_windows(date: Column | str, windows: Sequence[tuple[str, str]] | None) -> Column:
    """Inclusive, any of them; a null window list lets all pass, a null date none otherwise."""
    if windows is None:
        return F.lit(True)
    d = F.col(date) if isinstance(date, str) else date
    out = F.lit(False)
    for a, b in windows:
        out = out | d.between(a, b)
    return F.coalesce(out, F.lit(False))


def windows(ranges: Sequence[tuple[str, str]] = (), yearly: tuple[str, str] | None = None, years: Sequence[int] = ()) -> list[tuple[str, str]]:
    """Explicit ranges, and a yearly MM-DD range for each year; one that ends before it starts runs into the next year."""
    out = [(dt.date.fromisoformat(a).isoformat(), dt.date.fromisoformat(b).isoformat()) for a, b in ranges]
    if yearly:
        for y in years:
            out.append((f"{y}-{yearly[0]}", f"{y + (yearly[1] < yearly[0])}-{yearly[1]}"))
    return out


def placeholder(value: str, today: dt.date) -> str:
    """`today`, or an ISO date, as an ISO date."""
    return today.isoformat() if value.strip().lower() == "today" else dt.date.fromisoformat(value.strip()).isoformat()
