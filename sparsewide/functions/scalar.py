"""The scalar functions of the SQL dialect, as expansions to Spark SQL text.

Each function takes its arguments as SQL text and returns SQL text of built-in functions, so everything
stays in generated code. `col(name, *args)` gives the same as a Column. String positions are 0-based
and count characters. NULL arguments give NULL. Arguments that are out of range raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date part codes.
UNITS = ("YY", "YD", "M", "D", "W", "WK", "HH", "MI", "S", "MS", "US", "NS")
_PART = {"YY": "year({0})", "YD": "dayofyear({0})", "M": "month({0})", "D": "day({0})", "W": "dayofweek({0}) - 1", "WK": "weekofyear({0})", "HH": "hour({0})", "MI": "minute({0})", "S": "second({0})"}
_SECOND = {"MS": "cast(date_format({0}, 'SSS') as int)", "US": "cast(date_format({0}, 'SSSSSS') as int)", "NS": "cast(date_format({0}, 'SSSSSS') as int) * 1000"}
_PREFIX = {"YY": "yyyy", "M": "yyyy-MM", "D": "yyyy-MM-dd", "HH": "yyyy-MM-dd''T''HH", "MI": "yyyy-MM-dd''T''HH:mm", "S": "yyyy-MM-dd''T''HH:mm:ss", "MS": "yyyy-MM-dd''T''HH:mm:ss.SSS", "US": "yyyy-MM-dd''T''HH:mm:ss.SSSSSS", "NS": "yyyy-MM-dd''T''HH:mm:ss.SSSSSS000"}
_MICROS = {"D": 86_400_000_000, "HH": 3_600_000_000, "MI": 60_000_000, "S": 1_000_000, "MS": 1_000, "US": 1}


def _guard(bad: str, message: str, value: str) -> str:
    return f"(CASE WHEN {bad} THEN raise_error('{message}') ELSE {value} END)"


def _unit(text: str, allowed) -> str:
    u = text.strip().strip("'").upper()
    if u not in allowed:
        raise ValueError(f"invalid date part {text}")
    return u


def char(i):
    return _guard(f"{i} < 0 OR {i} > 255", "CHAR takes 0 to 255", f"chr({i})")


def ascii_(s):
    return _guard(f"octet_length({s}) > 1", "ASCII takes one byte", f"ascii({s})")


def substring(s, start, n=None):
    end = f"length({s})" if n is None else f"({start}) + ({n})"
    bad = f"({start}) < 0 OR ({start}) >= length({s}) OR {end} > length({s})" + ("" if n is None else f" OR ({n}) < 0")
    return _guard(bad, "SUBSTRING out of range", f"substring({s}, ({start}) + 1" + (")" if n is None else f", {n})"))


def stringsplit(s, sep, pos="0"):
    return f"split_part({s}, {sep}, greatest({pos}, 0) + 1)"


def prefix(s, n):
    return _guard(f"({n}) < 0 OR ({n}) > length({s})", "PREFIX out of range", f"left({s}, {n})")


def suffix(s, n):
    return _guard(f"({n}) < 0 OR ({n}) > length({s})", "SUFFIX out of range", f"right({s}, {n})")


def replicate(s, n):
    return _guard(f"({n}) < 0", "REPLICATE takes no negative count", f"repeat({s}, {n})")


def charindex(sub, s, pos="0"):
    return _guard(f"({pos}) < 0 OR ({pos}) > length({s})", "CHARINDEX out of range", f"locate({sub}, {s}, ({pos}) + 1) - 1")


def format_(fmt, *args):
    return f"format_string({', '.join((fmt.replace('%v', '%s').replace('%t', '%b'), *args))})"


def str_(x, width="10", dec="0"):
    text = f"format_string('%{int(width)}.{int(dec)}f', cast({x} as double))"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN length({text}) > {int(width)} THEN repeat('*', {int(width)}) ELSE {text} END)"


def datetimepart(unit, ts):
    return f"({(_PART | _SECOND)[_unit(unit, UNITS)].format(ts)})"


def datetimename(unit, ts):
    u = _unit(unit, UNITS)
    return f"date_format({ts}, '{'MMMM' if u == 'M' else 'EEEE'}')" if u in ("M", "W") else f"cast({datetimepart(unit, ts)} as string)"


def date_trunc(unit, ts):
    return f"date_format({ts}, '{_PREFIX[_unit(unit, _PREFIX)]}')".replace("''", "\\'")


def datetimeadd(unit, n, ts):
    u = _unit(unit, ("YY", "M", *_MICROS, "NS"))
    if u in ("YY", "M"):  # days past the end of the month run on into the next one
        months = f"({n}) * 12" if u == "YY" else n
        return f"(cast(date_add(add_months(trunc({ts}, 'MM'), {months}), day({ts}) - 1) as timestamp) + ({ts} - date_trunc('DAY', {ts})))"
    micros = f"({n}) div 1000" if u == "NS" else f"cast({n} as bigint) * {_MICROS[u]}"
    return f"timestamp_micros(unix_micros(cast({ts} as timestamp)) + {micros})"


def datetimediff(unit, start, end):
    u = _unit(unit, ("YY", "M", *_MICROS, "NS"))
    if u == "YY":
        return f"(year({end}) - year({start}))"
    if u == "M":
        return f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"
    micros = f"(unix_micros(cast({end} as timestamp)) - unix_micros(cast({start} as timestamp)))"
    return f"({micros} * 1000)" if u == "NS" else f"({micros} div {_MICROS[u]})"


def datetimefromparts(y, mo, d, h, mi, s, ms):
    return _guard(f"({y}) < 0 OR ({y}) > 9999 OR ({ms}) < 0 OR ({ms}) > 999", "DATETIMEFROMPARTS out of range", f"make_timestamp({y}, {mo}, {d}, {h}, {mi}, ({s}) + cast({ms} as decimal(10, 3)) / 1000)")


def totimestamp(n, unit="'s'"):
    u = unit.strip().strip("'").lower()
    ways = {"s": f"timestamp_seconds({n})", "ms": f"timestamp_millis({n})", "us": f"timestamp_micros({n})", "\xb5s": f"timestamp_micros({n})", "ns": f"timestamp_micros(({n}) div 1000)"}
    if u not in ways:
        raise ValueError(f"invalid time unit {unit}")
    return ways[u]


def rangeq(q, start, end):
    """The members of a time-bucketed set with start <= ts < end; one bound may be NULL."""
    if start.upper() == end.upper() == "NULL":
        raise ValueError("RANGEQ needs a bound")
    tests = [f"x.ts {op} {v}" for op, v in ((">=", start), ("<", end)) if v.upper() != "NULL"]
    return f"filter({q}, x -> {' AND '.join(tests)})"


MACROS = {
    "REVERSE": lambda s: f"reverse({s})", "LOWER": lambda s: f"lower({s})", "UPPER": lambda s: f"upper({s})", "CHAR": char, "ASCII": ascii_, "SUBSTRING": substring,
    "REPLACEALL": lambda s, a, b: f"replace({s}, {a}, {b})", "STRINGSPLIT": stringsplit, "TRIM": lambda s: f"regexp_replace({s}, '(?U)^\\\\s+|\\\\s+$', '')",
    "RTRIM": lambda s: f"rtrim({s})", "LTRIM": lambda s: f"ltrim({s})", "PREFIX": prefix, "SUFFIX": suffix, "SPACE": lambda n: f"space({n})", "LEN": lambda s: f"length({s})",
    "REPLICATE": replicate, "FORMAT": format_, "CHARINDEX": charindex, "STR": str_, "DATETIMEPART": datetimepart, "DATETIMENAME": datetimename, "DATE_TRUNC": date_trunc,
    "DATETIMEADD": datetimeadd, "DATETIMEDIFF": datetimediff, "DATETIMEFROMPARTS": datetimefromparts, "TOTIMESTAMP": totimestamp,
    "SETCONTAINS": lambda c, v: f"array_contains({c}, {v})", "SETCONTAINSALL": lambda c, v: f"forall({v}, _m -> array_contains({c}, _m))", "SETCONTAINSANY": lambda c, v: f"arrays_overlap({c}, {v})",
    "RANGEQ": rangeq,
}


def expand(name: str, *args: str) -> str:
    return MACROS[name.upper()](*args)


def col(name: str, *args: str) -> Column:
    return F.expr(expand(name, *args))
