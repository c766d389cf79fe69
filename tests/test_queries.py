"""Every query with SQL gives what DuckDB gives; parsers, functions, writes and streams on small frames."""

from datetime import datetime

import duckdb
import pytest

from sparsewide import registry
from sparsewide.functions import scalar
from sparsewide.operators import filters, mutate, quantum
from sparsewide.plans import pql
from sparsewide.plans.sql import Session, to_spark
from sparsewide.sources.catalog import TABLES, Field, Table, read, write
from sparsewide.streaming.ingest import append_stream

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    cur = duck.execute(registry.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = cur.fetchall()
    have = [tuple(r[c] for c in names) for r in got.collect()]
    text = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert text(have) == text(want)


def one(spark, name, *args):
    return spark.range(1).select(scalar.col(name, *args).alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "args", "want"), [
    ("CHAR", ("200",), "È"), ("SUBSTRING", ("'hello'", "1", "3"), "ell"), ("CHARINDEX", ("'z'", "'abc'"), -1), ("CHARINDEX", ("'c'", "'abcabc'", "3"), 5), ("STR", ("12345.678", "8", "1"), " 12345.7"),
    ("STR", ("12345", "3"), "***"), ("STRINGSPLIT", ("'a,b,c'", "','", "7"), ""), ("TRIM", ("' \t x\n '",), "x"), ("SPACE", ("-1",), ""), ("LEN", ("'çé'",), 2), ("FORMAT", ("'%v is %t'", "'x'", "true"), "x is true"),
    ("DATETIMEADD", ("'M'", "1", "TIMESTAMP '2024-01-31 05:06:07'"), datetime(2024, 3, 2, 5, 6, 7)), ("DATETIMEDIFF", ("'M'", "TIMESTAMP '2024-01-31'", "TIMESTAMP '2024-02-01'"), 1),
    ("DATETIMEDIFF", ("'HH'", "TIMESTAMP '2024-01-01 00:59:00'", "TIMESTAMP '2024-01-01 02:00:00'"), 1), ("DATE_TRUNC", ("'MI'", "TIMESTAMP '2024-01-07 03:04:05'"), "2024-01-07T03:04"),
    ("DATETIMEPART", ("'W'", "TIMESTAMP '2024-01-07'"), 0), ("DATETIMENAME", ("'M'", "TIMESTAMP '2024-01-07'"), "January"), ("DATETIMEPART", ("'US'", "TIMESTAMP '2024-01-07 00:00:00.123456'"), 123456),
    ("REVERSE", ("NULL",), None),
])
def test_scalar_functions(spark, name, args, want):
    assert one(spark, name, *args) == want


@pytest.mark.parametrize(("name", "args"), [("CHAR", ("256",)), ("ASCII", ("'ab'",)), ("SUBSTRING", ("'abc'", "3")), ("PREFIX", ("'abc'", "4")), ("REPLICATE", ("'a'", "-1")), ("CHARINDEX", ("'a'", "'abc'", "9")), ("DATETIMEFROMPARTS", ("2024", "13", "1", "0", "0", "0", "0"))])
def test_scalar_functions_raise(spark, name, args):
    with pytest.raises(Exception):  # noqa: B017
        one(spark, name, *args)


def test_call_parser():
    (c,) = pql.parse("GroupBy(Rows(a, limit=3), filter=Row(2 <= b < 31), having=Condition(count > 2), x=[1, 'two', $v])", {"v": 3})
    assert c.name == "groupby" and c.children[0].args == {"limit": 3} and c.children[0].values == ["a"]
    assert c.args["filter"].args["b"].tests == [(">=", 2), ("<", 31)] and c.args["x"] == [1, "two", 3]
    assert len(pql.parse("Set(12, colour=3, 2021-09-30T08:15) Count(Row(colour=3))")) == 2
    for bad in ("Row(a=1", "Row(a=1, a=2)", "Row(a=99999999999999999999)", "Row(a=1))", "1"):
        with pytest.raises(pql.PQLError):
            pql.parse(bad)


def test_record_set_algebra_is_set_algebra(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None, [i % 2, i % 7]) for i in range(60)], "_id long, a int, s array<int>")
    e = pql.Engine(df)
    ids = lambda q: {r["_id"] for r in e.one(q).collect()}
    a, s, every = {i for i in range(60) if i % 5 and i % 3 == 1}, {i for i in range(60) if 1 in (i % 2, i % 7)}, set(range(60))
    assert ids("Union(Row(a=1), Row(s=1))") == a | s and ids("Intersect(Row(a=1), Row(s=1))") == a & s
    assert ids("Difference(Row(a=1), Row(s=1))") == a - s and ids("Xor(Row(a=1), Row(s=1))") == a ^ s and ids("Not(Row(a=1))") == every - a
    assert ids("Intersect(Shift(Row(a=1), n=1), Not(Limit(Row(s=1), limit=9)))") == {i + 1 for i in a} & (every - set(sorted(s)[:9]))
    assert e.one("Percentile(field=a, nth=50)").first()["value"] == 1
    assert ids("Union()") == set()


def test_writes(spark):
    df = spark.createDataFrame([(1, "x", ["a"]), (2, "y", None)], "_id long, k string, s array<string>")
    got = lambda d: {r["_id"]: (r["k"], r["s"]) for r in d.collect()}
    assert got(mutate.set_(df, 2, "s", "b")) == {1: ("x", ["a"]), 2: ("y", ["b"])}
    assert got(mutate.set_(df, 3, "k", "n"))[3] == ("n", None)
    assert got(mutate.clear(df, 1, "s", "a"))[1] == ("x", [])
    assert got(mutate.store(df, filters.equals("k", "y"), "k", "x")) == {1: (None, ["a"]), 2: ("x", None)}
    s = Session(spark, {"t": df})
    s.sql("INSERT INTO t (_id, k) VALUES (2, 'z'), (5, 'w')")
    s.sql("DELETE FROM t WHERE k = 'x'")
    assert {r["_id"]: r["k"] for r in s.sql("SELECT _id, k FROM t").collect()} == {2: "z", 5: "w"}
    s.sql("CREATE VIEW v AS SELECT k FROM t WHERE _id = 5")
    assert s.sql("SELECT * FROM v").first()["k"] == "w" and {r["name"] for r in s.sql("SHOW TABLES").collect()} == {"t", "v"}
    assert "Project" in s.sql("EXPLAIN SELECT k FROM t").first()["plan"]


def test_dialect_text():
    assert to_spark("SELECT TOP(3) a FROM t WHERE a LIKE 'TOP(1)'") == "SELECT a FROM t WHERE a ILIKE 'TOP(1)' LIMIT 3"
    assert to_spark("SELECT SETCONTAINS(s, 1), x[0] FROM t") == "SELECT array_contains(s, 1) , x[0] FROM t"
    with pytest.raises(ValueError):
        to_spark("SELECT TOP 3 a FROM t LIMIT 2")


def test_quantum_cover():
    at = datetime
    assert quantum.cover("f", "YMDH", at(2023, 12, 31, 22), at(2025, 1, 2, 1)) == ["f_2023123122", "f_2023123123", "f_2024", "f_20250101", "f_2025010200"]
    assert quantum.cover("f", "YM", at(2024, 11, 1), at(2025, 2, 1)) == ["f_202411", "f_202412", "f_202501"]
    assert quantum.cover("f", "D", at(2024, 2, 28), at(2024, 3, 2)) == ["f_20240228", "f_20240229", "f_20240301"]
    assert quantum.views("f", "YMD", at(2024, 1, 2, 3)) == ["f_2024", "f_202401", "f_20240102"] and quantum.cover("f", "", at(2024, 1, 1), at(2025, 1, 1)) == []
    with pytest.raises(ValueError):
        quantum.cover("f", "YD", at(2024, 1, 1), at(2025, 1, 1))


def test_tables_sources_and_stream(spark, tmp_path):
    table = Table("t", [Field("_id", "id"), Field("n", "int", options={"min": 0}), Field("d", "decimal", 2), Field("tags", "stringset"), Field("q", "stringsetq")])
    df = table.conform(spark.createDataFrame([(1, 5, "1.25", ["b", "a", "b"])], "_id int, n int, d string, tags array<string>"))
    assert df.first()["tags"] == ["a", "b"] and df.schema["d"].dataType.simpleString() == "decimal(19,2)"
    with pytest.raises(Exception):  # noqa: B017
        table.conform(spark.createDataFrame([(1, -5)], "_id int, n int")).collect()
    with pytest.raises(ValueError):
        Table("t", [Field("x", "int")]).schema()
    for fmt in ("parquet", "json", "orc"):
        write(df, f"{tmp_path}/{fmt}", fmt)
        assert read(spark, f"{tmp_path}/{fmt}", fmt, table.schema()).first()["n"] == 5
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/parquet")
    append_stream(stream, table, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert read(spark, f"{tmp_path}/out").count() == 1
