"""The SQL dialect: rewritten to Spark SQL text, then planned by Catalyst.

What differs from Spark SQL: TOP(n) and TOPN(n) in any block, LIKE without case, GLOB, MATCH, scalar functions by other names and with 0-based positions, set
literals `[a, b]` and tuples `{a, b}`, set equality (contains all), integer and fixed-scale division and multiplication, AVG, VAR, CORR and PERCENTILE with
truncated scales, CAST from integers, `!` for bitwise not, `@name` for parameters, and the table hint `WITH (flatten(col))`, which groups by the members of a
set. DDL, writes and SHOW go to the session's catalog; a write gives a new DataFrame, which the session holds under the table's name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mutate import upsert
from ..sources.catalog import Field, Table, Tables, read, write
from .expressions import DialectError, Rewriter, arguments, group, tokens

_STATEMENT = re.compile(
    r"(?is)\s*(EXPLAIN|SHOW|CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|DATABASE|FUNCTION)|ALTER\s+(?:TABLE|VIEW|DATABASE)|DROP\s+(?:TABLE|VIEW|DATABASE|FUNCTION)|BULK\s+(?:INSERT|REPLACE)|INSERT|REPLACE|UPDATE|DELETE|COPY)\b(.*)$"
)
#: Field types of CREATE TABLE.
FIELD_TYPES = ("int", "id", "bool", "decimal", "string", "timestamp", "idset", "stringset", "idsetq", "stringsetq")


def to_spark(text: str, **kw) -> str:
    """The statement as Spark SQL, as far as no type is needed."""
    rewriter = Rewriter(**kw)
    return rewriter.text(rewriter.query(tokens(text.strip().rstrip(";"))))


def _unquoted(text: str) -> str:
    return text[1:-1].replace("''", "'") if text[:1] == "'" else text


class Session:
    """Named tables and the statements over them."""

    def __init__(self, spark: SparkSession, tables=(), *, reference_like: bool = False):
        self.spark, self.tables, self.reference_like = spark, Tables(tables), reference_like
        self.specs: dict[str, Table] = {}
        self.functions: dict[str, Callable] = {}
        self.databases: dict[str, dict] = {"default": {}}

    def sql(self, text: str, **args) -> DataFrame:
        text = "".join(tokens(text.strip().rstrip(";"))).strip()
        m = _STATEMENT.match(text)
        if not m or (m[1].upper() == "REPLACE" and m[2].lstrip()[:1] == "("):
            return self._run(text, **args)
        word = " ".join(m[1].upper().replace("OR REPLACE", " ").split())
        return getattr(self, "_" + word.lower().replace(" ", "_"))(m[2].strip(), **args)

    # queries

    def _run(self, text: str, **args) -> DataFrame:
        """The query's DataFrame. Tables are bound as common table expressions, so no view of the caller's is touched."""
        toks = tokens(text)
        own = {t.lower() for k, t in enumerate(toks) if "".join(toks[k + 1 : k + 5]).replace(" ", "").lower().startswith("as(")}
        seen = {t.lower() for t in toks}
        used = {n: self.tables[n] for n in self.tables if n in seen and n not in own}
        sets = "[" in toks or any(isinstance(f.dataType, T.ArrayType) for df in used.values() for f in df.schema)
        rewriter = Rewriter(self.functions, sets=sets, reference_like=self.reference_like)
        query = rewriter.query(toks)
        names = {n: f"t_{uuid.uuid4().hex}" for n in used}
        bound = ", ".join(f"{n} AS (SELECT * FROM {v})" for n, v in names.items())

        def planned() -> DataFrame:
            body = rewriter.text(query).strip()
            if bound:
                body = f"WITH {bound}, {body[5:]}" if re.match(r"(?i)with\s", body) else f"WITH {bound} {body}"
            return self.spark.sql(body, args=args or None)

        for n, v in names.items():
            used[n].createOrReplaceTempView(v)
        try:
            while rewriter.open():
                rewriter.learn(planned()._jdf.queryExecution().analyzed())
            return planned()
        finally:
            for v in names.values():
                self.spark.catalog.dropTempView(v)

    def _explain(self, text: str, **args) -> DataFrame:
        query = re.sub(r"(?i)^QUERY\s+PLAN\b", "", text)
        return self.spark.createDataFrame([(self._run(query, **args)._jdf.queryExecution().toString(),)], "plan string")

    # catalog

    def _known(self, name: str) -> str:
        name = name.strip().lower()
        if name not in self.tables:
            raise DialectError(f"no table {name}")
        return name

    def _names(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.tables)], "name string")

    def _show(self, text: str) -> DataFrame:
        words = text.split()
        what = words[0].upper()
        if what == "DATABASES":
            return self.spark.createDataFrame([(n, o.get("comment"), o.get("units")) for n, o in sorted(self.databases.items())], "name string, comment string, units long")
        if what == "TABLES":
            return self._names()
        if what == "COLUMNS":
            return self.spark.createDataFrame(self.tables[self._known(words[2])].dtypes, "name string, type string")
        if [w.upper() for w in words[:2]] == ["CREATE", "TABLE"]:
            name = self._known(words[2])
            return self.spark.createDataFrame([((self.specs.get(name) or Table.of(name, self.tables[name])).ddl(),)], "ddl string")
        raise DialectError(f"SHOW {text}")

    def _create_table(self, text: str) -> DataFrame:
        m = re.match(r"(?is)(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\(", text)
        if not m:
            raise DialectError("CREATE TABLE takes a name and columns")
        name = m[2].lower()
        if name in self.tables:
            if m[1]:
                return self._names()
            raise DialectError(f"table {name} exists")
        toks = tokens(text)
        inner, end = group(toks, toks.index("("))
        options = _options(toks[end:], {"COMMENT": 1, "KEYPARTITIONS": 1})
        self.specs[name] = Table(name, [_field(a) for a in arguments(inner)], options)
        self.tables[name] = self.spark.createDataFrame([], self.specs[name].schema())
        return self._names()

    def _alter_table(self, text: str) -> DataFrame:
        m = re.match(r"(?is)(\w+)\s+(ADD|DROP|RENAME)\s+(?:COLUMN\s+)?(.*)$", text)
        if not m:
            raise DialectError("ALTER TABLE takes ADD, DROP or RENAME")
        name, what = self._known(m[1]), m[2].upper()
        spec, table = self.specs.get(name) or Table.of(name, self.tables[name]), self.tables[name]
        if what == "ADD":
            new = _field(tokens(m[3]))
            if new.name in table.columns:
                raise DialectError(f"column {new.name} exists")
            fields, table = [*spec.fields, new], table.withColumn(new.name, F.lit(None).cast(new.spark().dataType))
        elif what == "DROP":
            gone = m[3].strip()
            if gone not in table.columns or gone == "_id":
                raise DialectError(f"no column {gone} to drop")
            fields, table = [f for f in spec.fields if f.name != gone], table.drop(gone)
        else:
            r = re.fullmatch(r"(?is)(\w+)\s+TO\s+(\w+)", m[3].strip())
            if not r or r[1] not in table.columns or r[1] == "_id":
                raise DialectError(f"RENAME {m[3]}")
            fields = [Field(r[2], f.type, f.scale, f.options) if f.name == r[1] else f for f in spec.fields]
            table = table.withColumnRenamed(r[1], r[2])
        if name in self.specs:
            self.specs[name] = Table(name, fields, spec.options)
        self.tables[name] = table
        return self._names()

    def _drop_table(self, text: str) -> DataFrame:
        m = re.match(r"(?is)(IF\s+EXISTS\s+)?(\w+)", text)
        if m[2].lower() in self.tables or not m[1]:
            del self.tables[self._known(m[2])]
            self.specs.pop(m[2].lower(), None)
        return self._names()

    _drop_view = _drop_table

    def _create_view(self, text: str) -> DataFrame:
        m = re.match(r"(?is)(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+AS\s+(.*)$", text)
        if not m:
            raise DialectError("a view takes a name and a query")
        if not (m[1] and m[2].lower() in self.tables):
            self.tables[m[2].lower()] = self._run(m[3])
        return self._names()

    _alter_view = _create_view

    def _create_database(self, text: str) -> DataFrame:
        m = re.match(r"(?is)(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*(.*)$", text)
        if m[2] in self.databases and not m[1]:
            raise DialectError(f"database {m[2]} exists")
        self.databases.setdefault(m[2], {}).update(_options(tokens(re.sub(r"(?i)^WITH\b", "", m[3])), {"UNITS": 1, "COMMENT": 1}))
        return self._show("DATABASES")

    def _alter_database(self, text: str) -> DataFrame:
        m = re.match(r"(?is)(\w+)\s+(?:SET|WITH)\s+(.*)$", text)
        if not m or m[1] not in self.databases:
            raise DialectError("ALTER DATABASE takes a database and options")
        self.databases[m[1]].update(_options(tokens(m[2]), {"UNITS": 1, "COMMENT": 1}))
        return self._show("DATABASES")

    def _drop_database(self, text: str) -> DataFrame:
        m = re.match(r"(?is)(IF\s+EXISTS\s+)?(\w+)", text)
        if m[2] not in self.databases and not m[1]:
            raise DialectError(f"no database {m[2]}")
        self.databases.pop(m[2], None)
        return self._show("DATABASES")

    # functions

    def register_function(self, name: str, f: Callable, returns: str = "string") -> None:
        """A Python function for queries (a pandas UDF, or one of plain values)."""
        self.spark.udf.register(name, f) if hasattr(f, "evalType") else self.spark.udf.register(name, f, returns)

    def register_table_function(self, name: str, handler: type, returns: str) -> None:
        """A class whose `eval` yields rows, for FROM name(...)."""
        self.spark.udtf.register(name, F.udtf(handler, returnType=returns))

    def _create_function(self, text: str) -> DataFrame:
        """name(@a TYPE, ...) RETURNS TYPE AS (expression of @a): expanded in place, so it stays in generated code."""
        m = re.match(r"(?is)(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*?)\)\s+RETURNS\s+(\w+(?:\s*\([\d,\s]+\))?)\s+(?:LANGUAGE\s+SQL\s+)?AS\s+(.*?)(?:\s+LANGUAGE\s+SQL)?\s*$", text)
        if not m:
            raise DialectError("CREATE FUNCTION takes parameters, RETURNS and AS (expression)")
        name, params = m[2].upper(), [p.split()[0].lstrip("@").lower() for p in m[3].split(",") if p.strip()]
        if name in self.functions and m[1]:
            return self._functions()
        body = tokens(_unquoted(m[5].strip()))

        def expand(*args: str) -> str:
            if len(args) != len(params):
                raise DialectError(f"{name} takes {len(params)} arguments")
            given = dict(zip(params, args))
            return "(" + to_spark("".join(f"({given[t.lstrip('@').lower()]})" if t.lstrip("@").lower() in given else t for t in body)) + ")"

        self.functions[name] = expand
        return self._functions()

    def _drop_function(self, text: str) -> DataFrame:
        m = re.match(r"(?is)(IF\s+EXISTS\s+)?(\w+)", text)
        if m[2].upper() not in self.functions and not m[1]:
            raise DialectError(f"no function {m[2]}")
        self.functions.pop(m[2].upper(), None)
        return self._functions()

    def _functions(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.functions)], "name string")

    # writes

    def _put(self, name: str, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Rows replace those with the same _id; fields that aren't given are null."""
        table = self.tables[name]
        if len(columns) != len(rows.columns):
            raise DialectError(f"{len(columns)} columns, {len(rows.columns)} values")
        rows = rows.toDF(*columns)
        full = rows.select(*[(F.col(c) if c in columns else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
        full = self.specs[name].conform(full) if name in self.specs else full
        self.tables[name] = upsert(table, full)
        return self.tables[name]

    def _insert(self, text: str) -> DataFrame:
        m = re.match(r"(?is)INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*(VALUES\b.*|SELECT\b.*|WITH\b.*|\(\s*SELECT\b.*)$", text)
        if not m:
            raise DialectError("INSERT takes VALUES or a query")
        name = self._known(m[1])
        columns = [c.strip() for c in m[2].split(",")] if m[2] else self.tables[name].columns
        query = f"SELECT * FROM {m[3]}" if m[3][:6].upper() == "VALUES" else m[3]
        return self._put(name, self._run(query), columns)

    _replace = _insert

    def _update(self, text: str) -> DataFrame:
        toks = tokens(text)
        words = [t.upper() for t in toks]
        if "SET" not in words:
            raise DialectError("UPDATE takes SET")
        at, depth, where = words.index("SET"), 0, len(toks)
        for k in range(at, len(toks)):
            depth += toks[k] in ("(", "[", "{")
            depth -= toks[k] in (")", "]", "}")
            if depth == 0 and words[k] == "WHERE":
                where = k
                break
        name = self._known("".join(toks[:at]))
        table, new = self.tables[name], {}
        for a in arguments(toks[at + 1 : where]):
            k = a.index("=")
            new["".join(a[:k]).strip()] = "".join(a[k + 1 :]).strip()
        if bad := [c for c in new if c not in table.columns or c == "_id"]:
            raise DialectError(f"no column {bad[0]} to update")
        test = "".join(toks[where + 1 :]).strip()
        picked = [f"CASE WHEN {test} THEN {new[c]} ELSE {c} END AS {c}" if c in new and test else f"{new[c]} AS {c}" if c in new else c for c in table.columns]
        out = self._run(f"SELECT {', '.join(picked)} FROM {name}")
        out = out.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns])
        self.tables[name] = self.specs[name].conform(out) if name in self.specs else out
        return self.tables[name]

    def _delete(self, text: str) -> DataFrame:
        m = re.match(r"(?is)FROM\s+(\w+)(?:\s+WHERE\s+(.*))?$", text)
        name = self._known(m[1])
        self.tables[name] = self._run(f"SELECT * FROM {name} WHERE NOT coalesce(({m[2]}), false)") if m[2] else self.tables[name].filter("false")
        return self.tables[name]

    def _copy(self, text: str) -> DataFrame:
        """COPY t TO u makes a table; COPY t TO 'path' [WITH FORMAT 'CSV'] writes files."""
        m = re.match(r"(?is)(\w+)\s+TO\s+('(?:[^']|'')*'|\w+)\s*(?:WITH\s+(.*))?$", text)
        if not m:
            raise DialectError("COPY takes a table and a target")
        source = self.tables[self._known(m[1])]
        if m[2][0] == "'":
            options = _options(tokens(m[3] or ""), {"FORMAT": 1})
            write(source, _unquoted(m[2]), options.get("format", "parquet").lower())
        else:
            self.tables[m[2].lower()] = source
        return source

    def _bulk_insert(self, text: str) -> DataFrame:
        """INTO t (cols) MAP (source TYPE, ...) [TRANSFORM (@0, ...)] FROM 'path' WITH FORMAT 'CSV' [HEADER_ROW] [ROWSLIMIT n] [ALLOW_MISSING_VALUES] [BATCHSIZE n]

        CSV maps positions, NDJSON paths like '$.a.b', PARQUET and ORC column names. Spark reads in its own batches.
        """
        toks = tokens(text)
        at = {t.upper(): k for k, t in reversed(list(enumerate(toks))) if t.upper() in ("MAP", "TRANSFORM", "FROM", "WITH")}
        m = re.match(r"(?is)INTO\s+(\w+)\s*\(([^)]*)\)", text)
        if not m or not {"MAP", "FROM", "WITH"} <= at.keys():
            raise DialectError("BULK INSERT takes columns, MAP, FROM and WITH")
        name, columns = self._known(m[1]), [c.strip() for c in m[2].split(",")]
        bracket = lambda k: group(toks, next(j for j in range(k, len(toks)) if toks[j] == "("))[0]
        mapped = [[t for t in a if t != " "] for a in arguments(bracket(at["MAP"]))]
        path = next(_unquoted(t) for t in toks[at["FROM"] + 1 :] if t != " ")
        options = _options(toks[at["WITH"] + 1 :], {"FORMAT": 1, "BATCHSIZE": 1, "ROWSLIMIT": 1, "INPUT": 1, "HEADER_ROW": 0, "ALLOW_MISSING_VALUES": 0})
        fmt = str(options.get("format", "csv")).lower()
        if fmt == "csv":
            positions = [int(a[0]) for a in mapped]
            plain = T.StructType([T.StructField(f"v{k}", T.StringType()) for k in range(max(positions) + 1)])
            raw = read(self.spark, path, "csv", plain, header="header_row" in options, enforceSchema=True)
            found = [F.col(f"v{k}") for k in positions]
        elif fmt in ("json", "ndjson"):
            raw = read(self.spark, path, "text")
            found = [F.get_json_object("value", _unquoted(a[0])) for a in mapped]
        else:
            raw = read(self.spark, path, fmt)
            found = [F.col(_unquoted(a[0])) for a in mapped]
        kinds = [_field(["c", " ", *a[1:]]).spark().dataType for a in mapped]
        shaped = [F.from_json(c, k) if fmt in ("json", "ndjson") and isinstance(k, T.ArrayType) else c.cast(k) for c, k in zip(found, kinds)]
        rows = raw.select(*[c.alias(f"_c{k}") for k, c in enumerate(shaped)])
        if "allow_missing_values" not in options:
            rows = rows.filter(F.col("_c0").isNotNull())
        if "rowslimit" in options:
            rows = rows.limit(int(options["rowslimit"]))
        if "TRANSFORM" in at:
            parts = ["".join(a) for a in arguments(bracket(at["TRANSFORM"]))]
            own = Session(self.spark, {"_read": rows})
            own.functions = self.functions
            rows = own._run(f"SELECT {', '.join(parts)} FROM _read")
        return self._put(name, rows, columns)

    _bulk_replace = _bulk_insert


def _options(toks: list[str], takes: dict[str, int]) -> dict:
    """Options by lower-case name; takes says which have a value."""
    out, words = {}, [t for t in toks if t not in (" ", ",")]
    k = 0
    while k < len(words):
        key = words[k].upper()
        if key not in takes:
            raise DialectError(f"unknown option {words[k]}")
        value = _unquoted(words[k + 1]) if takes[key] and k + 1 < len(words) else True
        out[key.lower()] = int(value) if isinstance(value, str) and value.isdigit() else value
        k += 1 + takes[key]
    return out


def _field(toks: list[str]) -> Field:
    """A column of CREATE TABLE: name, type and options."""
    words = [t for t in toks if t != " "]
    name, kind, scale, k = words[0], words[1].lower(), 0, 2
    if kind not in FIELD_TYPES:
        raise DialectError(f"unknown type {words[1]}")
    if k < len(words) and words[k] == "(":
        scale, k = int(words[k + 1]), k + 3
    options: dict = {}
    takes = {"MIN", "MAX", "CACHETYPE", "SIZE", "TIMEUNIT", "EPOCH", "TIMEQUANTUM", "TTL", "COMMENT"}
    while k < len(words):
        key = words[k].upper()
        if key not in takes:
            raise DialectError(f"unknown option {words[k]}")
        sign = -1 if words[k + 1] == "-" else 1
        value = words[k + 2] if sign < 0 else words[k + 1]
        options[key.lower()] = sign * float(value) if re.fullmatch(r"\d+\.\d*", value) else sign * int(value) if value.isdigit() else _unquoted(value)
        k += 3 if sign < 0 else 2
    return Field(name, kind, scale, options)
