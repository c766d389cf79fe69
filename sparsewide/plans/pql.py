"""The call-tree query language: a small parser, and a compiler to Columns and DataFrames.

Calls that select records compile to one boolean Column, so a whole tree of them is one filter over one
scan. Only slices (Limit, All with a limit) and Shift make id tables; a tree around those uses set
operations on ids.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import mutate
from ..operators.quantum import in_range

_TOKEN = re.compile(
    r"\s*(?:(?P<time>\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d+)?Z?)?)|(?P<num>[-+]?(?:\d+\.?\d*|\.\d+))|(?P<str>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<op>><|==|!=|<=|>=|[<>=(),\[\]])|(?P<name>\$?[A-Za-z_][\w-]*))"
)
CONDITIONS = ("==", "!=", "<", "<=", ">", ">=", "><")


class PQLError(ValueError):
    pass


@dataclass
class Cond:
    """Tests of one field: [(op, value)], all of which must hold."""

    tests: list[tuple[str, object]]


@dataclass
class Call:
    name: str
    args: dict = field(default_factory=dict)
    children: list[Call] = field(default_factory=list)
    values: list = field(default_factory=list)


class Parser:
    def __init__(self, text: str, variables: dict | None = None):
        self.tokens, self.at, self.variables = [], 0, variables or {}
        pos, text = 0, text.rstrip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise PQLError(f"unexpected {text[pos : pos + 10]!r} at {pos}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            pos = m.end()

    def peek(self, k: int = 0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else (None, None)

    def take(self, want: str | None = None):
        kind, text = self.peek()
        if kind is None or (want is not None and text != want):
            raise PQLError(f"expected {want or 'more'}, found {text!r}")
        self.at += 1
        return kind, text

    def query(self) -> list[Call]:
        out = []
        while self.at < len(self.tokens):
            out.append(self.call())
        return out

    def call(self) -> Call:
        kind, name = self.take()
        if kind != "name":
            raise PQLError(f"expected a call, found {name!r}")
        call = Call(name.lower())
        self.take("(")
        while self.peek()[1] != ")":
            self.argument(call)
            if self.peek()[1] != ")":
                self.take(",")
        self.take(")")
        return call

    def argument(self, call: Call) -> None:
        (kind, text), (_, after) = self.peek(), self.peek(1)
        if kind == "name" and after == "(":
            call.children.append(self.call())
        elif kind == "name" and after == "=":
            self.at += 2
            self.put(call, text, self.value())
        elif kind == "name" and after in CONDITIONS:
            self.at += 2
            self.put(call, text, Cond([(after, self.value())]))
        elif kind in ("num", "time") and after in ("<", "<="):  # a <= f < b
            low, (_, op) = self.value(), self.take()
            name = self.take()[1]
            end = self.take()[1]
            if end not in ("<", "<="):
                raise PQLError(f"expected < or <=, found {end!r}")
            self.put(call, name, Cond([(">" if op == "<" else ">=", low), (end, self.value())]))
        else:
            call.values.append(self.value(bare=True))

    @staticmethod
    def put(call: Call, name: str, value) -> None:
        if name in call.args:
            raise PQLError(f"duplicate argument {name}")
        call.args[name] = value

    def value(self, bare: bool = False):
        kind, text = self.take()
        if kind == "num":
            number = Decimal(text) if "." in text else int(text)
            if isinstance(number, int) and not -(1 << 63) <= number < 1 << 64:
                raise PQLError(f"integer out of range {text}")
            return number
        if kind == "time":
            return text
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if text == "[":
            out = []
            while self.peek()[1] != "]":
                out.append(self.value())
                if self.peek()[1] != "]":
                    self.take(",")
            self.take("]")
            return out
        if kind == "name":
            if self.peek()[1] == "(":
                self.at -= 1
                return self.call()
            if text[0] == "$":
                return self.variables[text[1:]]
            return {"null": None, "true": True, "false": False}.get(text, text)
        raise PQLError(f"unexpected {text!r}")


def parse(text: str, variables: dict | None = None) -> list[Call]:
    """The calls of a query. A list variable in `field=$v` fans out into one value each, joined by Union."""
    return Parser(text, variables).query()


class _NeedsIds(Exception):
    pass


#: Arguments of row calls that name no field.
_OPTIONS = {"from", "to", "limit", "offset"}
#: Records of a shard are those whose id agrees but for this many low bits.
SHARD_BITS = 20
#: The arguments that calls take; a call that isn't here takes any, as fields.
_FIELD = {"field", "_field"}
ARGUMENTS = {
    "sum": _FIELD, "min": _FIELD, "max": _FIELD, "minrow": _FIELD, "maxrow": _FIELD, "difference": set(), "intersect": set(), "not": set(), "union": set(), "xor": set(), "unionrows": set(),
    "extract": set(), "fieldvalue": {"field", "column"}, "all": {"limit", "offset"}, "limit": {"limit", "offset"}, "shift": {"n"}, "constrow": {"columns"}, "options": {"shards"},
    "rows": _FIELD | {"limit", "column", "previous", "from", "to", "like", "valueidx", "in"}, "innerunionrows": _FIELD | {"from", "to", "rows"},
    "topn": _FIELD | {"n", "ids", "filter", "from", "to"}, "topk": _FIELD | {"k", "filter", "from", "to"}, "percentile": _FIELD | {"filter", "nth"},
    "groupby": {"filter", "limit", "offset", "previous", "aggregate", "having", "sort"}, "includescolumn": {"column"}, "sort": _FIELD | {"limit", "offset", "sort-desc"},
}
#: Arguments that take whole numbers from zero on, and those that take text.
_WHOLE, _TEXT = {"limit", "offset", "n", "k", "valueidx"}, {"like", "sort"}


def checked(call: Call) -> Call:
    """Raises for arguments that a call does not take, or of the wrong kind."""
    allowed = ARGUMENTS.get(call.name)
    for key, value in call.args.items():
        if allowed is not None and key not in allowed:
            raise PQLError(f"{call.name} takes no argument {key}")
        if allowed is not None and key in _WHOLE and not (key == "n" and call.name == "shift") and (not isinstance(value, int) or isinstance(value, bool) or value < 0):
            raise PQLError(f"{key} of {call.name} takes a whole number, not {value!r}")
        if allowed is not None and key in _TEXT and not isinstance(value, str):
            raise PQLError(f"{key} of {call.name} takes text, not {value!r}")
        for inner in value if isinstance(value, list) else [value]:
            if isinstance(inner, Call):
                checked(inner)
    for child in call.children:
        checked(child)
    return call


class Engine:
    """Runs calls over one table: a DataFrame with `_id` and fields (scalars, sets, or sets of (value, ts))."""

    def __init__(self, table: DataFrame, *, quantum: str = "H"):
        self.table, self.quantum, self.types = table, quantum, {f.name: f.dataType for f in table.schema}

    def query(self, text: str, variables: dict | None = None) -> list[DataFrame]:
        return [self.run(checked(c)) for c in parse(text, variables)]

    def one(self, text: str, variables: dict | None = None) -> DataFrame:
        (out,) = self.query(text, variables)
        return out

    # record sets

    def _kind(self, name: str) -> str:
        if name not in self.types:
            raise PQLError(f"no field {name}")
        t = self.types[name]
        return "plain" if not isinstance(t, T.ArrayType) else "quantum" if isinstance(t.elementType, T.StructType) else "set"

    def _test(self, name: str, value, start=None, end=None) -> Column:
        kind, c = self._kind(name), F.col(name)
        if isinstance(value, list):
            return self._any([self._test(name, v, start, end) for v in value])
        if not isinstance(value, Cond):
            if value is None:
                return c.isNull()
            if kind == "plain":
                return c == F.lit(value)
            if kind == "set":
                return F.array_contains(c, value)
            return F.exists(c, lambda x: (x["value"] == F.lit(value)) & in_range(x["ts"], start, end, self.quantum))
        out = F.lit(True)
        for op, v in value.tests:
            if v is None:
                out = out & (c.isNotNull() if op == "!=" else c.isNull())
            elif op == "><":
                out = out & c.between(*v)
            else:
                out = out & {"==": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]
        return out

    @staticmethod
    def _any(parts: list[Column]) -> Column:
        out = F.lit(False)
        for k, p in enumerate(parts):
            out = p if k == 0 else out | p
        return out

    def predicate(self, call: Call) -> Column:
        """The records of a call: those for which it is true. It may be null, so that plain tests reach the Parquet scan; only complements need a value."""
        n, kids = call.name, call.children
        if n in ("row", "range", "bitmap"):
            tests = [self._test(k, v, call.args.get("from"), call.args.get("to")) for k, v in call.args.items() if k not in _OPTIONS]
            out = F.lit(True)
            for k, t in enumerate(tests):
                out = t if k == 0 else out & t
            return out
        if n == "all" and not call.args:
            return F.lit(True)
        if n == "constrow":
            return F.col("_id").isin(call.args["columns"])
        if n == "unionrows":
            return self._any([self._in_rows(k) for k in kids])
        if n == "innerunionrows":
            return self._test(call.args["field"], list(call.args["rows"]), call.args.get("from"), call.args.get("to"))
        if n == "options":
            out = self.predicate(kids[0])
            return out & F.shiftright("_id", SHARD_BITS).isin(call.args["shards"]) if "shards" in call.args else out
        if n in ("union", "intersect", "difference", "xor", "not"):
            parts = [self.predicate(k) for k in kids]
            sure = lambda p: F.coalesce(p, F.lit(False))
            if n == "not":
                return ~sure(parts[0])
            if not parts:
                return F.lit(False)
            out = parts[0]
            for p in parts[1:]:
                out = out | p if n == "union" else out & p if n == "intersect" else out & ~sure(p) if n == "difference" else sure(out) != sure(p)
            return out
        if n in ("shift", "limit", "all", "sort", "distinct"):
            raise _NeedsIds
        raise PQLError(f"{call.name} selects no records")

    def ids(self, call: Call) -> DataFrame:
        try:
            return self.table.filter(self.predicate(call)).select("_id")
        except _NeedsIds:
            pass
        n, a = call.name, call.args
        if n == "unionrows":  # rows chosen by a limit or a record come first, then the records that hold one
            parts = []
            for k in call.children:
                name = self._field(k)
                held = self.table.select("_id", self._values(name, k.args).alias("value"))
                parts.append(held.join(self.rows(k), "value", "left_semi").select("_id"))
            return self._union(parts)
        kids = [self.ids(k) for k in call.children]
        every = self.table.select("_id")
        if n == "shift":
            return kids[0].select((F.col("_id") + int(a.get("n", 1))).alias("_id"))
        if n in ("limit", "all"):
            out = (kids[0] if kids else every).orderBy("_id").offset(int(a.get("offset", 0)))
            return out.limit(int(a["limit"])) if "limit" in a else out
        if n == "not":
            return every.join(kids[0], "_id", "left_anti")
        out = kids[0]
        for k in kids[1:]:
            both = out.intersect(k)
            out = {"union": out.union(k).distinct(), "intersect": both, "difference": out.join(k, "_id", "left_anti"), "xor": out.union(k).distinct().join(both, "_id", "left_anti")}[n]
        return out

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        out = self.table.select("_id").limit(0)
        for p in parts:
            out = out.union(p)
        return out.distinct()

    def records(self, call: Call | None) -> DataFrame:
        """The table's rows that a call selects."""
        if call is None:
            return self.table
        try:
            return self.table.filter(self.predicate(call))
        except _NeedsIds:
            return self.table.join(self.ids(call), "_id", "left_semi")

    # rows of a field

    def _field(self, call: Call, key: str = "field") -> str:
        name = call.args.get(key, call.args.get("_field", call.values[0] if call.values else None))
        if name is None:
            raise PQLError(f"{call.name} needs a field")
        self._kind(name)
        return name

    def _values(self, name: str, a: dict) -> Column:
        """The field's values as something to explode or select."""
        kind = self._kind(name)
        if kind == "plain":
            return F.col(name)
        if kind == "set":
            return F.explode(F.array_distinct(name))
        return F.explode(F.array_distinct(F.transform(F.filter(name, lambda x: in_range(x["ts"], a.get("from"), a.get("to"), self.quantum)), lambda x: x["value"])))

    def _rows_filter(self, a: dict, v: Column) -> Column:
        out = v.isNotNull()
        if "previous" in a:
            out = out & (v > a["previous"])
        if "like" in a:
            out = out & v.like(a["like"])
        if "in" in a:
            out = out & v.isin(a["in"])
        return out

    def rows(self, call: Call) -> DataFrame:
        """The field's rows; valueidx names them by one of the fields of a GroupBy's keys and only has a meaning there."""
        name, a = self._field(call), call.args
        df = self.table.filter(F.col("_id") == a["column"]) if "column" in a else self.table
        out = df.select(self._values(name, a).alias("value")).filter(self._rows_filter(a, F.col("value"))).distinct()
        return out.orderBy("value").limit(int(a["limit"])) if "limit" in a else out

    def _in_rows(self, call: Call) -> Column:
        name, a = self._field(call), call.args
        if "limit" in a or "column" in a:
            raise _NeedsIds
        if self._kind(name) == "plain":
            return self._rows_filter(a, F.col(name))
        at = (lambda x: x) if self._kind(name) == "set" else (lambda x: x["value"])
        inside = (lambda x: F.lit(True)) if self._kind(name) == "set" else (lambda x: in_range(x["ts"], a.get("from"), a.get("to"), self.quantum))
        return F.exists(name, lambda x: self._rows_filter(a, at(x)) & inside(x))

    # results

    def run(self, call: Call) -> DataFrame:
        n, a = call.name, call.args
        child = call.children[0] if call.children else None
        if n == "count":
            if child.name == "distinct":
                return self.run(child).agg(F.count("value").alias("count"))
            try:
                return self.records(child).agg(F.count(F.lit(1)).alias("count"))
            except PQLError:
                return self.run(child).agg(F.count(F.lit(1)).alias("count"))
        if n == "sum":
            f = self._field(call)
            return self.records(child).agg(F.sum(f).alias("value"), F.count(f).alias("count"))
        if n in ("min", "max"):
            f = self._field(call)
            rows = self.records(child).select(F.col(f).alias("value")).filter("value IS NOT NULL")
            best = rows.agg(F.min("value").alias("_best") if n == "min" else F.max("value").alias("_best"))  # one row
            return rows.join(F.broadcast(best), F.col("value") == F.col("_best")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        if n in ("minrow", "maxrow"):
            best = self._counts(self._field(call), self.records(child), a)
            return best.orderBy(F.asc("value") if n == "minrow" else F.desc("value")).limit(1)
        if n == "distinct":
            return self.records(child).select(self._values(self._field(call), a).alias("value")).filter("value IS NOT NULL").distinct()
        if n == "percentile":
            f = self._field(call)
            return self._percentile(self.records(a.get("filter", child)).select(F.col(f).alias("value")).filter("value IS NOT NULL"), a["nth"])
        if n == "rows":
            return self.rows(call)
        if n in ("topn", "topk"):
            rows = self.records(a.get("filter", child))
            best = self._counts(self._field(call), rows, a)
            if "ids" in a:
                best = best.filter(F.col("value").isin(a["ids"]))
            k = a.get("n", a.get("k"))
            best = best.orderBy(F.desc("count"), "value")
            return best.limit(int(k)) if k else best
        if n == "groupby":
            return self._group_by(call)
        if n == "extract":
            return self.records(child).select("_id", *[self._field(c) for c in call.children[1:]])
        if n == "includescolumn":
            return self.records(child).filter(F.col("_id") == a["column"]).limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
        if n == "fieldvalue":
            return self.table.filter(F.col("_id") == a["column"]).select(F.col(self._field(call)).alias("value"))
        if n == "sort":
            f = self._field(call)
            order = F.desc_nulls_last(f) if a.get("sort-desc") else F.asc_nulls_last(f)
            out = self.records(child).filter(F.col(f).isNotNull()).orderBy(order, "_id").select("_id", F.col(f).alias("value"))
            out = out.offset(int(a["offset"])) if "offset" in a else out
            return out.limit(int(a["limit"])) if "limit" in a else out
        if n in ("set", "setbit", "clear", "clearrow", "store", "delete"):
            return self.mutate(call)
        return self.ids(call)

    @staticmethod
    def _percentile(rows: DataFrame, nth) -> DataFrame:
        """The smallest value of which at least nth percent are no larger, with its count.

        Values are dealt to bands between approximate hundredths (a bounded sketch); sums of the bands tell the one that holds it, and only that one is ordered.
        """
        if not 0 <= nth <= 100:
            raise PQLError("nth goes from 0 to 100")
        cuts = rows.agg(F.percentile_approx("value", [k / 100 for k in range(1, 100)], 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_all"))  # one row
        counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("count")).join(F.broadcast(cuts))
        counts = counts.withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).withColumn("_rank", F.greatest(F.ceil(F.col("_all") * F.lit(Decimal(str(nth))) / 100), F.lit(1)))
        bands = counts.groupBy("_band").agg(F.sum("count").alias("_n"))  # a hundred rows at most
        before = bands.select(F.col("_band").alias("_b"), (F.sum("_n").over(Window.orderBy("_band")) - F.col("_n")).alias("_before"), F.col("_n"))
        inside = counts.join(F.broadcast(before), (F.col("_band") == F.col("_b")) & (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
        upto = F.sum("count").over(Window.partitionBy("_band").orderBy("value")) + F.col("_before")
        return inside.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("count") < F.col("_rank"))).select("value", "count")

    def _counts(self, name: str, rows: DataFrame, a: dict) -> DataFrame:
        return rows.select(self._values(name, a).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("count"))

    def _group_by(self, call: Call) -> DataFrame:
        a, by = call.args, [c for c in call.children if c.name == "rows"]
        rows, names = self.records(a.get("filter")), []
        agg, having = a.get("aggregate"), a.get("having")
        value = self._field(agg.children[0] if agg.name == "count" else agg) if isinstance(agg, Call) else None
        rows = rows.select("_id", *{n: None for n in [*(self._field(c) for c in by), *([value] if value else [])]}, *([F.col(value).alias("_agg")] if value else []))
        for c in by:
            name = self._field(c)
            names.append(name)
            rows = rows.withColumn(name, self._values(name, c.args)).filter(self._rows_filter(c.args, F.col(name)))
            if "limit" in c.args or "column" in c.args:  # a bounded number of rows, or those of one record
                rows = rows.join(self.rows(c).withColumnRenamed("value", "_row"), F.col(name) == F.col("_row"), "left_semi")
        out = [F.count(F.lit(1)).alias("count")]
        if value:
            out.append((F.count_distinct("_agg") if agg.name == "count" else {"sum": F.sum, "min": F.min, "max": F.max}[agg.name]("_agg")).alias("agg"))
        grouped = rows.groupBy(*names).agg(*out)
        if "previous" in a:  # groups after the given one, in the order of the keys
            if not isinstance(a["previous"], list) or len(a["previous"]) != len(names):
                raise PQLError("previous takes a value for each Rows")
            after, same = F.lit(False), F.lit(True)
            for name, v in zip(names, a["previous"]):
                after = after | (same & (F.col(name) > F.lit(v)))
                same = same & (F.col(name) == F.lit(v))
            grouped = grouped.filter(after)
        if isinstance(having, Call):
            for k, v in having.args.items():
                c = F.col("count" if k == "count" else "agg")
                for op, x in v.tests:
                    grouped = grouped.filter(c.between(*x) if op == "><" else {"==": c == x, "!=": c != x, "<": c < x, "<=": c <= x, ">": c > x, ">=": c >= x}[op])
        if "sort" in a or "limit" in a or "offset" in a:
            keys = [s.split() for s in str(a.get("sort", "")).split(",") if s.strip()]
            order = [F.asc("agg" if k[0] in ("sum", "aggregate") else k[0]) if k[-1] == "asc" else F.desc("agg" if k[0] in ("sum", "aggregate") else k[0]) for k in keys]
            grouped = grouped.orderBy(*order, *names)
            grouped = grouped.offset(int(a["offset"])) if "offset" in a else grouped
            grouped = grouped.limit(int(a["limit"])) if "limit" in a else grouped
        return grouped

    def mutate(self, call: Call) -> DataFrame:
        """The table after a write; the caller stores it."""
        fields = [(k, v) for k, v in call.args.items() if k not in _OPTIONS]
        if call.name == "delete":
            return mutate.delete(self.table, self.predicate(call.children[0]))
        (name, value), *_ = fields
        if call.name == "clearrow":
            return mutate.clear_row(self.table, name, value)
        if call.name == "store":
            return mutate.store(self.table, self.predicate(call.children[0]), name, value)
        column = call.values[0]
        if call.name == "clear":
            return mutate.clear(self.table, column, name, value)
        return mutate.set_(self.table, column, name, value, call.values[1] if len(call.values) > 1 else None)
