"""Tables by name: readers, table specs with field options, and the derived sparse frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "region nation customer supplier part orders lineitem events".split()
_TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "id": T.LongType(), "string": T.StringType(), "timestamp": T.TimestampType(), "idset": T.ArrayType(T.LongType()), "stringset": T.ArrayType(T.StringType())}
#: The types of plain columns by Spark's names.
_NAMES = {"boolean": "bool", "int": "int", "bigint": "int", "double": "decimal", "string": "string", "timestamp": "timestamp", "array<bigint>": "idset", "array<string>": "stringset"}
_MEMBER = {"idsetq": T.LongType(), "stringsetq": T.StringType()}


@dataclass
class Field:
    """A column: its type (bool, int, decimal, timestamp, id, string, idset, stringset, idsetq, stringsetq) and options."""

    name: str
    type: str
    scale: int = 0
    options: dict = field(default_factory=dict)

    def spark(self) -> T.StructField:
        if self.type == "decimal":
            kind = T.DecimalType(19, self.scale)
        elif self.type in _MEMBER:
            kind = T.ArrayType(T.StructType([T.StructField("value", _MEMBER[self.type]), T.StructField("ts", T.TimestampType())]))
        else:
            kind = _TYPES[self.type]
        return T.StructField(self.name, kind, self.name != "_id", {**self.options, "type": self.type})


@dataclass
class Table:
    """Fields of a table; the first is the key `_id`, an id or a string."""

    name: str
    fields: list[Field]
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, df: DataFrame) -> Table:
        """The spec that a DataFrame's schema amounts to."""
        fields = []
        for f in df.schema:
            t = f.dataType
            kind = f.metadata.get("type") or _NAMES.get(t.simpleString()) or ("decimal" if isinstance(t, T.DecimalType) else "stringsetq" if isinstance(t, T.ArrayType) else "string")
            fields.append(Field(f.name, kind, t.scale if isinstance(t, T.DecimalType) else 0, {k: v for k, v in f.metadata.items() if k != "type"}))
        return cls(name, fields)

    def ddl(self) -> str:
        """The CREATE TABLE statement."""
        quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
        tail = lambda o: "".join(f" {k.upper()} {quoted(v)}" for k, v in o.items())
        columns = ", ".join(f"{f.name} {f.type}{f'({f.scale})' if f.type == 'decimal' else ''}{tail(f.options)}" for f in self.fields)
        return f"CREATE TABLE {self.name} ({columns}){tail(self.options)}"

    def schema(self) -> T.StructType:
        if not self.fields or self.fields[0].name != "_id" or self.fields[0].type not in ("id", "string"):
            raise ValueError("the first field must be _id of type id or string")
        return T.StructType([f.spark() for f in self.fields])

    def conform(self, df: DataFrame) -> DataFrame:
        """df cast to the schema, sets sorted and distinct, MIN and MAX options enforced."""
        out = []
        for f in self.schema():
            c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
            if isinstance(f.dataType, T.ArrayType):
                c = F.array_sort(F.array_distinct(c))
            for key, bad in (("min", lambda v: F.col(f.name) < v), ("max", lambda v: F.col(f.name) > v)):  # noqa: B023
                if key in f.metadata:
                    c = F.when(bad(f.metadata[key]), F.raise_error(F.lit(f"{f.name} beyond its {key}"))).otherwise(c)
            out.append(c.alias(f.name, metadata=f.metadata))
        return df.select(*out)


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    """Parquet, CSV, JSON or ORC, read with a schema where one is given."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    df.write.format(fmt).mode(mode).save(path)


DERIVED = "part_tags part_nulls cust_dec flags cust_parts events_q".split()


def derived(t: Tables, name: str) -> DataFrame:
    """A sparse frame over the plain tables: sets, nulls, decimals, bools and time-bucketed sets."""
    tags = F.array_sort(F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_brand"))))
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    made = {
        "part_tags": lambda: t["part"].select(F.col("p_partkey").alias("_id"), tags.alias("tags"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"), F.col("p_type").alias("kind"), cents.alias("cents")),
        "part_nulls": lambda: t["part"].select(F.col("p_partkey").alias("_id"), F.expr("nullif(p_size % 7, 0)").alias("size_n"), F.expr("nullif(p_brand, 'Brand#2')").alias("name_n"), F.col("p_size").alias("size")),
        "cust_dec": lambda: t["customer"].select(F.col("c_custkey").alias("_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("bal"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")),
        "flags": lambda: t["orders"].select(F.col("o_orderkey").alias("_id"), (F.col("o_orderstatus") == "O").alias("is_open"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust")),
        "cust_parts": lambda: t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts")),
        "events_q": lambda: t["events"].groupBy(F.col("user_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("value"), "ts"))).alias("kinds")),
    }
    return made[name]()


class Tables(MutableMapping):
    """DataFrames by lower-case name; those given as functions are made when first asked for."""

    def __init__(self, tables=()):
        self._held = dict(tables._held) if isinstance(tables, Tables) else {n.lower(): df for n, df in dict(tables).items()}

    def __getitem__(self, name: str) -> DataFrame:
        found = self._held[name.lower()]
        if not isinstance(found, DataFrame) and isinstance(found, Callable):
            found = self._held[name.lower()] = found()
        return found

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self._held[name.lower()] = df

    def __delitem__(self, name: str) -> None:
        del self._held[name.lower()]

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and name.lower() in self._held

    def __iter__(self) -> Iterator[str]:
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)

    def rename(self, old: str, new: str) -> None:
        if new.lower() in self._held:
            raise ValueError(f"table {new} exists")
        self._held[new.lower()] = self._held.pop(old.lower())

    def names(self, prefix: str = "") -> list[str]:
        """The names that begin with the prefix, in order."""
        return sorted(n for n in self._held if n.startswith(prefix))

    def drop_prefix(self, prefix: str) -> int:
        """Drops all tables whose names begin with the prefix; how many they were."""
        found = self.names(prefix)
        for n in found:
            del self._held[n]
        return len(found)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The plain tables and the derived frames; only those that are used are opened."""
    plain = Tables({n: (lambda n=n: spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in TABLES})
    out = Tables(plain)
    for n in DERIVED:
        out._held[n] = lambda n=n: derived(plain, n)
    return out


def rows_of(df: DataFrame) -> Iterator[dict]:
    """A result as a stream of messages: its schema, its rows one by one, and the end; partitions are fetched one at a time."""
    yield {"schema": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]}
    n = 0
    for row in df.toLocalIterator():
        yield {"row": list(row)}
        n += 1
    yield {"done": n}
