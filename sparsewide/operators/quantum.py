"""Time quantum: the views that cover a range, and range predicates on time-bucketed sets."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The legal quanta and the name pattern of each unit's views.
LEGAL = ("", "Y", "YM", "YMD", "YMDH", "M", "MD", "MDH", "D", "DH", "H")
NAMES = {"Y": "%Y", "M": "%Y%m", "D": "%Y%m%d", "H": "%Y%m%d%H"}
_TRUNC = {"Y": "YEAR", "M": "MONTH", "D": "DAY", "H": "HOUR"}


def _floor(t: datetime, unit: str) -> datetime:
    keep = "YMDH".index(unit) + 1
    parts = [t.year, t.month, t.day, t.hour][:keep]
    return datetime(*(parts + [1] * (3 - len(parts)) if keep < 3 else parts))


def _next(t: datetime, unit: str) -> datetime:
    if unit == "Y":
        return datetime(t.year + 1, 1, 1)
    if unit == "M":
        return datetime(t.year + t.month // 12, t.month % 12 + 1, 1)
    return t + (timedelta(days=1) if unit == "D" else timedelta(hours=1))


def views(field: str, quantum: str, t: datetime) -> list[str]:
    """The views that a bit with time t is written to."""
    _check(quantum)
    return [f"{field}_{t.strftime(NAMES[u])}" for u in quantum]


def _check(quantum: str) -> None:
    if quantum not in LEGAL:
        raise ValueError(f"invalid time quantum {quantum!r}")


def cover(field: str, quantum: str, start: datetime, end: datetime) -> list[str]:
    """A smallest list of views that covers [start, end); bounds are floored to the finest unit."""
    _check(quantum)
    if not quantum:
        return []
    fine = quantum[-1]
    at, end, out = _floor(start, fine), _floor(end, fine), []
    while at < end:  # the largest unit that starts here and ends in time
        unit = next(u for u in quantum if u == fine or (_floor(at, u) == at and _next(at, u) <= end))
        out.append(f"{field}_{at.strftime(NAMES[unit])}")
        at = _next(at, unit)
    return out


def in_range(ts: Column, start: str | None, end: str | None, unit: str = "H") -> Column:
    """start <= ts < end at the resolution of the quantum's finest unit."""
    out = F.lit(True)
    for bound, test in ((start, lambda v: F.date_trunc(_TRUNC[unit], ts) >= v), (end, lambda v: F.date_trunc(_TRUNC[unit], ts) < v)):
        if bound is not None:
            out = out & test(F.date_trunc(_TRUNC[unit], F.lit(bound).cast("timestamp")))
    return out


def has_member(name: str, value, start: str | None = None, end: str | None = None, unit: str = "H") -> Column:
    """Whether the time-bucketed set holds the value within the range."""
    return F.exists(name, lambda x: (x["value"] == F.lit(value)) & in_range(x["ts"], start, end, unit))


def members(name: str, start: str | None = None, end: str | None = None, unit: str = "H") -> Column:
    """Its distinct values within the range, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(name, lambda x: in_range(x["ts"], start, end, unit)), lambda x: x["value"])))


def parse_partial(text: str) -> datetime:
    """A time of which only the year must be given: 2024, 2024-05, 2024-05-06, 2024-05-06T07 or 2024-05-06T07:08; the rest is the earliest."""
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d{1,2})(?::(\d{1,2}))?)?)?)?", text)
    if not m:
        raise ValueError(f"cannot parse time {text!r}")
    year, month, day, hour, minute = (int(x) if x else None for x in m.groups())
    return datetime(year, month or 1, day or 1, hour or 0, minute or 0)


def _time_part(view: str) -> str:
    return view.rsplit("_", 1)[-1] if "_" in view else ""


_DIGITS = {"Y": 4, "M": 6, "D": 8, "H": 10}


def min_max_view(views: list[str], quantum: str) -> tuple[str, str]:
    """The first and last view of the coarsest unit of the quantum that occurs among the views; empty where there is none."""
    _check(quantum)
    times = {v: len(_time_part(v)) for v in views}
    for unit in quantum:
        if found := sorted(v for v, n in times.items() if n == _DIGITS[unit]):
            return found[0], found[-1]
    return "", ""


def view_time(view: str, end: bool = False) -> datetime | None:
    """The time that a view starts at, or the end of its unit; None for no view."""
    if not view:
        return None
    part = _time_part(view)
    unit = next((u for u, n in _DIGITS.items() if n == len(part) and part.isdigit()), None)
    if unit is None:
        raise ValueError(f"no time in view {view!r}")
    t = datetime.strptime(part, NAMES[unit])
    return _next(t, unit) if end else t
