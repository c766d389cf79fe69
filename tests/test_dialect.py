"""The SQL dialect's statements, its types and errors; checks of the call language and what reaches the scan."""

import json
import re
from datetime import datetime
from decimal import Decimal

import pytest
from sparsewide.operators import filters, mutate, quantum
from sparsewide.plans import pql
from sparsewide.plans.expressions import DialectError
from sparsewide.plans.sql import Session, to_spark


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [(1, 7, Decimal("-1.25"), "Anna", ["a", "b"], datetime(2024, 1, 2, 3)), (2, -7, Decimal("2.50"), "bob", ["b"], None), (3, None, None, None, None, None)],
        "_id long, n int, d decimal(9,2), s string, tags array<string>, ts timestamp",
    )


@pytest.fixture
def session(spark, frame):
    return Session(spark, {"t": frame})


def one(session, expression, where="_id = 1"):
    return session.sql(f"SELECT {expression} AS x FROM t WHERE {where}").first()["x"]


@pytest.mark.parametrize(("expression", "want"), [
    ("n / 2", 3), ("-n / 2", -3), ("n / 2 / 2", 1), ("d / 2", Decimal("-0.63")), ("d * 0.5", Decimal("-0.63")), ("n * 2 / 4", 3), ("!n", -8), ("n % -4", 3), ("CAST(n AS BOOL)", True), ("CAST(-n AS BOOL)", False),
    ("CAST(86400 AS TIMESTAMP) = TIMESTAMP '1970-01-02'", True), ("CAST(ts AS STRING)", "2024-01-02T03:00:00Z"), ("CAST('2024-01-02T03:04:05Z' AS TIMESTAMP)", datetime(2024, 1, 2, 3, 4, 5)),
    ("CAST(tags AS STRING)", '["a","b"]'), ("CAST('1.50' AS DECIMAL(1))", Decimal("1.5")), ("tags = ['b']", True), ("tags = ['b', 'c']", False), ("tags != ['c']", True), ("tags = ['b', 'a']", True),
    ("{n, s}.col2", "Anna"), ("s LIKE 'a%'", True), ("s GLOB 'A??[!b]'", True), ("s NOT REGEXP 'b'", True), ("CASE WHEN n / 2 = 3 THEN 'three' ELSE 'no' END", "three"), ("tags[0]", "a"), ("2 * (3 + n) / 4", 5),
    ("(SELECT MAX(n) / 2 FROM t)", 3), ("'it''s -- no comment'", "it's -- no comment"),
])
def test_expressions(session, expression, want):
    assert one(session, expression) == want


def test_names_of_tables_and_columns_in_any_case(spark, frame):
    assert Session(spark, {"Things": frame}).sql("SELECT N FROM THINGS WHERE S LIKE 'anna'").first()["N"] == 7


def test_aggregates(session):
    r = session.sql("SELECT AVG(n) AS a, AVG(d) AS b, VAR(n) AS v, CORR(n, d) AS c, PERCENTILE(d, 50) AS p, PERCENTILE(ts, 50) AS q, AVG(DISTINCT n) FILTER (WHERE n > 0) AS f FROM t").first()
    assert (r["a"], r["b"], r["v"], r["c"], r["p"], r["q"], r["f"]) == (0, Decimal("0.6250"), 49, -1, Decimal("-1.25"), datetime(2024, 1, 2, 3), 7)
    assert session.sql("SELECT AVG(n) AS a FROM t WHERE n < 0").schema["a"].dataType.simpleString() == "decimal(38,4)"
    rows = session.sql("SELECT s, AVG(d) OVER (PARTITION BY n > 0) AS a, n / 2 AS h FROM t GROUP BY s, d, n, n / 2").collect()
    assert {r["s"]: r["h"] for r in rows} == {"Anna": 3, "bob": -3, None: None}


@pytest.mark.parametrize("text", [
    "SELECT TOP(2) _id FROM t LIMIT 1", "SELECT TOP x _id FROM t", "SELECT PERCENTILE(n, 101) FROM t", "SELECT CAST(1.25 AS DECIMAL(1)) FROM t", "SELECT CAST('1.25' AS DECIMAL(1)) FROM t", "DROP TABLE none", "INSERT INTO none VALUES (1)",
    "INSERT INTO t (_id, n) VALUES (1)", "UPDATE t SET none = 1", "UPDATE t SET _id = 1", "CREATE TABLE x (a INT)", "CREATE TABLE t (_id ID)", "CREATE TABLE x (_id ID, a NOTYPE)", "CREATE TABLE x (_id ID, a INT BOGUS 1)",
    "ALTER TABLE t DROP COLUMN none", "SHOW NOTHING", "SELECT n FROM t WHERE (n = 1", "DROP DATABASE none", "DROP FUNCTION none", "SELECT _id, COUNT(*) FROM t", "SELECT none FROM t",
])
def test_errors(session, text):
    with pytest.raises(Exception):  # noqa: B017
        session.sql(text).collect()


def test_top_is_a_block_of_its_own(session):
    n = lambda q: session.sql(q).count()
    assert n("SELECT TOP(1) _id FROM t -- c") == 1 and n("SELECT TOP 2 _id FROM t UNION ALL SELECT _id FROM t") == 5
    assert n("SELECT x._id FROM (SELECT TOP(2) _id FROM t ORDER BY _id) x /* TOP 1 */") == 2 and n("WITH q AS (SELECT TOP 1 * FROM t) SELECT TOPN(5) * FROM q") == 1
    assert to_spark("SELECT a FROM t WHERE b = 'TOP 3'") == "SELECT a FROM t WHERE b = 'TOP 3'"


def test_a_session_leaves_the_callers_views_alone(spark, session):
    spark.range(5).createOrReplaceTempView("t")
    assert session.sql("SELECT * FROM t").count() == 3 and spark.table("t").count() == 5
    spark.catalog.dropTempView("t")
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("t_")]


def test_reference_like_takes_one_or_more_characters(spark):
    words = spark.createDataFrame([("ABBC",), ("abc",), ("ac",)], "s string")
    ask = lambda flag: {r["s"] for r in Session(spark, {"w": words}, reference_like=flag).sql("SELECT s FROM w WHERE s LIKE 'a_c'").collect()}
    assert ask(False) == {"abc"} and ask(True) == {"ABBC", "abc"}


def test_tables_and_writes(spark, session):
    session.sql("CREATE TABLE p (_id ID, n INT MIN 0 MAX 9, d DECIMAL(2), tags STRINGSET, seen STRINGSETQ TIMEQUANTUM 'YMD' TTL '0s', at TIMESTAMP TIMEUNIT 's') COMMENT 'points' KEYPARTITIONS 4")
    session.sql("INSERT INTO p (_id, n, tags) VALUES (1, 5, ['b', 'a', 'b']), (2, 6, NULL)")
    session.sql("INSERT INTO p (_id, n) SELECT _id, n FROM t WHERE n > 0")
    assert {r["_id"]: (r["n"], r["tags"]) for r in session.sql("SELECT * FROM p").collect()} == {1: (7, None), 2: (6, None)}
    before = session.tables["p"]
    with pytest.raises(Exception):  # noqa: B017
        session.sql("INSERT INTO p (_id, n) VALUES (3, 10)").collect()
    session.tables["p"] = before  # writes are lazy, so the caller goes back
    session.sql("UPDATE p SET n = n / 2, d = 1.5 WHERE _id = 1 OR n = 100")
    assert {r["_id"]: (r["n"], r["d"]) for r in session.sql("SELECT * FROM p").collect()} == {1: (3, Decimal("1.50")), 2: (6, None)}
    session.sql("UPDATE p SET n = 1")
    assert [r["n"] for r in session.sql("SELECT n FROM p").collect()] == [1, 1]
    ddl = session.sql("SHOW CREATE TABLE p").first()["ddl"]
    assert "n int MIN 0 MAX 9" in ddl and "TIMEQUANTUM 'YMD'" in ddl and ddl.endswith("COMMENT 'points' KEYPARTITIONS 4")
    again = Session(spark)
    again.sql(ddl)
    assert again.sql("SHOW CREATE TABLE p").first()["ddl"] == ddl
    session.sql("CREATE TABLE IF NOT EXISTS p (_id ID)")
    session.sql("DROP TABLE p")
    session.sql("DROP TABLE IF EXISTS p")
    assert [r["name"] for r in session.sql("SHOW TABLES").collect()] == ["t"]
    assert session.sql("SELECT n FROM t WHERE _id = @id", id=2).first()["n"] == -7


def test_bulk_insert_and_copy(spark, session, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,size\n1,x,5\n2,y,\n3,z,9\n,w,1\n")
    session.sql("CREATE TABLE c (_id ID, s STRING, n INT)")
    session.sql(f"BULK INSERT INTO c (_id, s, n) MAP (0 ID, 1 STRING, 2 INT) TRANSFORM (@0, UPPER(@1), @2 * 2) FROM 'file://{tmp_path}/a.csv' WITH BATCHSIZE 100 FORMAT 'CSV' INPUT 'FILE' HEADER_ROW")
    assert sorted((r["_id"], r["s"], r["n"]) for r in session.sql("SELECT * FROM c").collect()) == [(1, "X", 10), (2, "Y", None), (3, "Z", 18)]
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"k": k, "v": {"tags": ["q", str(k)]}}) for k in range(7, 10)))
    session.sql("CREATE TABLE j (_id ID, tags STRINGSET)")
    session.sql(f"BULK INSERT INTO j (_id, tags) MAP ('$.k' ID, '$.v.tags' STRINGSET) FROM 'file://{tmp_path}/b.json' WITH FORMAT 'NDJSON' ROWSLIMIT 2")
    assert {r["_id"]: r["tags"] for r in session.sql("SELECT * FROM j").collect()} == {7: ["7", "q"], 8: ["8", "q"]}
    session.sql(f"COPY c TO 'file://{tmp_path}/c' WITH FORMAT 'JSON'")
    assert spark.read.json(f"file://{tmp_path}/c").count() == 3
    session.sql("COPY c TO d")
    assert session.sql("SELECT COUNT(*) AS n FROM d").first()["n"] == 3


def test_functions(spark, session):
    session.sql("CREATE FUNCTION half(@x INT) RETURNS INT AS (@x / 2)")
    assert one(session, "half(20)") == 10
    session.register_function("shout", lambda s: s and s.upper() + "!", "string")
    assert one(session, "shout(s)") == "ANNA!"

    class Twice:
        def eval(self, x: int):
            yield (x,)
            yield (x * 2,)

    session.register_table_function("twice", Twice, "x: int")
    assert [r["x"] for r in session.sql("SELECT x FROM twice(4)").collect()] == [4, 8]
    session.sql("DROP FUNCTION half")
    with pytest.raises(DialectError):
        session.sql("DROP FUNCTION half")


# call language


@pytest.mark.parametrize("text", ["TopN(k, bogus=3)", "Sum(field=n, limit=2)", "Rows(s, limit='x')", "Limit(Row(n=1), limit=-1)", "Union(Row(n=1), limit=2)", "GroupBy(Rows(s), previous=['a', 'b'])", "Count(Shift(Row(n=1), m=2))", "Percentile(field=n, nth=200)"])
def test_arguments_are_checked(frame, text):
    with pytest.raises(pql.PQLError):
        pql.Engine(frame).one(text).collect()


def test_predicates_reach_the_scan(spark, frame, tmp_path):
    frame.select("_id", "n", "s").write.parquet(f"{tmp_path}/t")
    engine = pql.Engine(spark.read.parquet(f"{tmp_path}/t"))
    plan = engine.one("Intersect(Row(n > 3), Union(Row(s='Anna'), Row(s='bob')))")._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters: [") :].split("]")[0]
    assert "GreaterThan(n,3)" in pushed and "EqualTo(s,Anna)" in pushed
    ids = lambda q: sorted(r["_id"] for r in engine.one(q).collect())
    assert ids("Difference(All(), Row(n > 3))") == [2, 3] and ids("Xor(Row(n > 3), Row(s='bob'))") == [1, 2] and ids("Not(Row(n=7))") == [2, 3]


def test_repeated_members_count_once_and_shards_are_exact(spark):
    df = spark.createDataFrame([(1, ["x", "x"]), ((1 << 60) + 1, ["x"])], "_id long, k array<string>")
    e = pql.Engine(df)
    assert e.one("TopN(k)").first()["count"] == 2
    assert [r["_id"] for r in e.one(f"Options(All(), shards=[{(1 << 60) >> 20}])").collect()] == [(1 << 60) + 1]


def test_percentile_equals_sorted_values(spark):
    values = [(k * 7919) % 1009 // 3 for k in range(1500)]
    e = pql.Engine(spark.createDataFrame([(k, v, Decimal(v)) for k, v in enumerate(values)], "_id long, v int, d decimal(9,2)"))
    for nth in (0, 1, 33.3, 50, 99, 100):
        want = sorted(values)[max(1, -(-len(values) * int(nth * 10) // 1000)) - 1]
        r = e.one(f"Percentile(field=v, nth={nth})").first()
        assert (r["value"], r["count"]) == (want, values.count(want))
        assert e.one(f"Percentile(field=d, nth={nth})").first()["value"] == want
    assert pql.Engine(spark.createDataFrame([], "_id long, v int")).one("Percentile(field=v, nth=50)").collect() == []


def test_set_with_a_time(spark):
    df = spark.createDataFrame([(1, [("a", datetime(2024, 1, 1))])], "_id long, q array<struct<value:string,ts:timestamp>>")
    after = pql.Engine(df).one("Set(1, q='b', 2024-03-05T06:07)")
    assert [tuple(x) for x in after.first()["q"]] == [("a", datetime(2024, 1, 1)), ("b", datetime(2024, 3, 5, 6, 7))]
    with pytest.raises(ValueError):
        mutate.set_(spark.createDataFrame([(1, 2)], "_id long, n int"), 1, "n", 3, "2024-01-01")


#: Frames that Spark computes anew for each row.
_ANEW = r"specifiedwindowframe\(\w+, (?!unboundedpreceding)[^ ]+, unboundedfollowing"


def test_first_last_takes_each_row_once(spark):
    from sparsewide import registry

    plan = registry.QUERIES["first_last"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("specifiedwindowframe") == 2 and not re.search(_ANEW, plan)


def test_frames_to_the_end_equal_sql(spark):
    import duckdb

    rows = [(k, k % 3, None if k % 7 == 0 else k // 4, None if k % 5 == 0 else (k * 37) % 23) for k in range(60)]
    w = "PARTITION BY g ORDER BY "
    ends = "AND UNBOUNDED FOLLOWING"
    calls = [
        (f"LAST(x) OVER ({w}_id ROWS BETWEEN CURRENT ROW {ends})", None),
        (f"LAST(x) OVER ({w}_id DESC ROWS BETWEEN 2 FOLLOWING {ends})", None),
        (f"FIRST(x) OVER ({w}_id ROWS BETWEEN 3 PRECEDING {ends})", None),
        (f"FIRST(x) OVER ({w}_id ROWS BETWEEN 3 FOLLOWING {ends})", None),
        (f"LAST(x) IGNORE NULLS OVER ({w}_id ROWS BETWEEN CURRENT ROW {ends})", f"LAST(x IGNORE NULLS) OVER ({w}_id ROWS BETWEEN CURRENT ROW {ends})"),
        (f"FIRST(x, true) OVER ({w}_id ROWS BETWEEN 1 PRECEDING {ends})", f"FIRST(x IGNORE NULLS) OVER ({w}_id ROWS BETWEEN 1 PRECEDING {ends})"),
        (f"SUM(x) OVER ({w}_id DESC ROWS BETWEEN CURRENT ROW {ends})", None),
        (f"COUNT(*) OVER ({w}o NULLS LAST RANGE BETWEEN CURRENT ROW {ends})", None),
        (f"MIN(x) OVER ({w}o NULLS FIRST RANGE BETWEEN 2 PRECEDING {ends})", None),
        (f"MAX(x) OVER ({w}o DESC NULLS LAST RANGE BETWEEN 1 FOLLOWING {ends})", None),
        (f"COUNT(x) OVER ({w}o DESC NULLS FIRST, _id ROWS BETWEEN CURRENT ROW {ends})", None),
        (f"SUM(x) OVER ({w}o RANGE BETWEEN CURRENT ROW {ends})", f"SUM(x) OVER ({w}o NULLS FIRST RANGE BETWEEN CURRENT ROW {ends})"),
        ("coalesce(LAST(x) OVER v, -1)", None),
        ("COUNT(*) OVER (V)", "COUNT(*) OVER v"),
    ]
    tail = f"FROM t WINDOW u AS (ORDER BY o), v AS ({w}_id ROWS BETWEEN CURRENT ROW {ends}) ORDER BY _id"
    df = spark.createDataFrame(rows, "_id long, g int, o int, x int")
    got = Session(spark, {"t": df}).sql(f"SELECT _id, {', '.join(f'{c} AS c{k}' for k, (c, _) in enumerate(calls))} {tail}")
    assert not re.search(_ANEW, got._jdf.queryExecution().optimizedPlan().toString())
    con = duckdb.connect()
    con.execute("CREATE TABLE t (_id BIGINT, g INT, o INT, x INT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT _id, {', '.join(f'{duck or c} AS c{k}' for k, (c, duck) in enumerate(calls))} {tail}").fetchall()
    assert [tuple(r) for r in got.collect()] == want


# filter API and time quantum


def test_bitmaps_round_trip_and_clear(spark):
    ids = [1, 2, 7, 8, 9, 32767, 32768, 32769, 100_000]
    table = filters.bitmap(spark.createDataFrame([(x,) for x in ids], "_id long"))
    assert sorted(r["_id"] for r in filters.bitmap_ids(table).collect()) == ids
    gone = filters.bitmap(spark.createDataFrame([(8,), (32768,), (5,)], "_id long"))
    assert sorted(r["_id"] for r in filters.bitmap_ids(filters.bitmap_import(table, gone, clear=True)).collect()) == [x for x in ids if x not in (8, 32768)]


def test_bitmaps_hold_zero_and_negative_ids(spark):
    ids = [-(1 << 63), -65537, -32769, -32768, -32767, -1, 0, 1, 32768, (1 << 63) - 1]
    table = filters.bitmap(spark.createDataFrame([(x,) for x in ids], "_id long"))
    assert sorted(r["_id"] for r in filters.bitmap_ids(table).collect()) == ids
    gone = filters.bitmap(spark.createDataFrame([(0,), (-32768,), (5,)], "_id long"))
    assert sorted(r["_id"] for r in filters.bitmap_ids(filters.bitmap_import(table, gone, clear=True)).collect()) == [x for x in ids if x not in (0, -32768)]


def test_bitmap_ids_with_key_zero_equals_sql(spark, tmp_path):
    import duckdb

    from sparsewide import registry

    spark.createDataFrame([(k, "a b", "Brand#1", "LARGE", 26 if k % 2 == 0 else 25, 1.0) for k in range(5)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(r["_id"] for r in registry.QUERIES["bitmap_ids"](spark, str(tmp_path)).collect()) == sorted(x for (x,) in con.execute(registry.SQL["bitmap_ids"]).fetchall()) == [0, 2, 4]


def test_quantum_helpers():
    at = datetime
    assert quantum.parse_partial("2023") == at(2023, 1, 1) and quantum.parse_partial("2023-11") == at(2023, 11, 1) and quantum.parse_partial("2023-11-05T7") == at(2023, 11, 5, 7) and quantum.parse_partial("2023-11-05T07:30") == at(2023, 11, 5, 7, 30)
    for bad in ("", "23", "2023-1", "2023-11T05", "2023-11-05T", "2023-13-01"):
        with pytest.raises(ValueError):
            quantum.parse_partial(bad)
    views = ["f_2022", "f_202205", "f_2024", "f_2023", "f_20230101"]
    assert quantum.min_max_view(views, "YMD") == ("f_2022", "f_2024") and quantum.min_max_view(["f_20220531", "f_2022053123", "f_20220601"], "YMDH") == ("f_20220531", "f_20220601") and quantum.min_max_view(["f"], "YMD") == ("", "")
    assert quantum.view_time("f_202212", end=True) == at(2023, 1, 1) and quantum.view_time("f_2022123123", end=True) == at(2023, 1, 1) and quantum.view_time("f_20221231") == at(2022, 12, 31) and quantum.view_time("") is None
    with pytest.raises(ValueError):
        quantum.view_time("f_20x2")


def test_unused_tables_are_not_opened(spark, tmp_path):
    from sparsewide.sources.catalog import load

    spark.range(3).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    session = Session(spark, load(spark, str(tmp_path)))  # no other table exists
    assert session.sql("SELECT COUNT(*) AS n FROM part").first()["n"] == 3


def test_catalog_names_and_result_messages(spark):
    from sparsewide.sources.catalog import Tables, rows_of

    held = Tables({n: spark.range(k + 1) for k, n in enumerate(["a_1", "a_2", "b"])})
    held.rename("a_1", "c")
    assert held.names() == ["a_2", "b", "c"] and held.drop_prefix("a_") == 1 and held.names("b") == ["b"] and held["c"].count() == 1
    with pytest.raises(ValueError):
        held.rename("b", "c")
    assert list(rows_of(spark.range(2))) == [{"schema": [{"name": "id", "type": "bigint"}]}, {"row": [0]}, {"row": [1]}, {"done": 2}]
    ids = spark.createDataFrame([(3,), (5,), (9,)], "_id long")
    at = lambda *a, **k: [r["_id"] for r in filters.seek(ids, *a, **k).collect()]
    assert (at(), at(5), at(5, strict=True), at(4, back=True), at(3, back=True, strict=True), at(10)) == ([3], [5], [9], [3], [], [])
