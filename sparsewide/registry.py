"""All queries of the engine over its own operators, each with the SQL that DuckDB runs to the same result."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import aggregates as A
from .operators import filters as L
from .operators import mutate, quantum
from .plans.pql import Engine
from .plans.sql import Session
from .sources.catalog import load

QUERIES: dict = {}
SQL: dict = {}

#: The derived frames in DuckDB's SQL.
_FRAMES = {
    "part_tags": "SELECT p_partkey AS _id, list_sort(list_distinct(list_append(string_split(p_name, ' '), p_brand))) AS tags, p_brand AS brand, CAST(p_size AS BIGINT) AS size, p_type AS kind, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part",
    "part_nulls": "SELECT p_partkey AS _id, nullif(p_size % 7, 0) AS size_n, nullif(p_brand, 'Brand#2') AS name_n, p_size AS size FROM part",
    "cust_dec": "SELECT c_custkey AS _id, CAST(c_acctbal AS DECIMAL(18,2)) AS bal, c_mktsegment AS segment, c_nationkey AS nation FROM customer",
    "flags": "SELECT o_orderkey AS _id, o_orderstatus = 'O' AS is_open, o_orderpriority AS priority, o_custkey AS cust FROM orders",
    "cust_parts": "SELECT o_custkey AS _id, list_sort(list(DISTINCT l_partkey)) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    "ev": "SELECT user_id AS _id, event_type AS value, ts FROM events",
}


def _duck(text: str) -> str:
    used = [n for n in _FRAMES if re.search(rf"\b{n}\b", text)]
    body = text.strip()
    if not used:
        return body
    ctes = ", ".join(f"{n} AS ({_FRAMES[n]})" for n in used)
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def _sql(name: str, dialect: str, duck: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: Session(spark, load(spark, d)).sql(dialect)
    SQL[name] = _duck(duck or dialect)


def _script(name: str, duck: str, *statements: str) -> None:
    """The result of the last of some statements of one session."""

    def run(spark, d):
        session = Session(spark, load(spark, d))
        for statement in statements[:-1]:
            session.sql(statement.replace("{dir}", d))
        return session.sql(statements[-1])

    QUERIES[name], SQL[name] = run, _duck(duck)


def _pql(name: str, table: str, text: str, duck: str) -> None:
    QUERIES[name] = lambda spark, d: Engine(load(spark, d)[table]).one(text)
    SQL[name] = _duck(duck)


def _frame(name: str, duck: str):
    def add(f):
        QUERIES[name] = lambda spark, d: f(load(spark, d))
        SQL[name] = _duck(duck)
        return f

    return add


# scan, project, filter

_sql("scan_project", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
_sql("null_table", "SELECT 1 + 2 AS three, 'a' || 'b' AS ab")
_sql("filter_cmp", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 40 AND p_size != 20")
_sql("filter_in", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#13') AND p_size NOT IN (1, 2, 3)")
_sql("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9 OR p_size NOT BETWEEN 3 AND 47")
_sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%E%' AND p_name NOT LIKE 'S%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%E%' AND p_name NOT ILIKE 'S%'")
_sql("filter_isnull", "SELECT _id, name_n FROM part_nulls WHERE size_n IS NULL AND name_n IS NOT NULL")
_sql("filter_bool_algebra", "SELECT _id FROM part_nulls WHERE (size_n > 3 AND name_n = 'Brand#1') OR NOT (size > 10 OR size_n = 2)")
_sql("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part")
_sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code FROM orders")
_sql("bitwise_ops", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS b, shiftleft(p_size, 2) AS c, shiftright(p_size, 1) AS d, ~p_size AS e FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS b, p_size << 2 AS c, p_size >> 1 AS d, ~p_size AS e FROM part")
_sql("cast_matrix", "SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(CAST(p_size AS STRING) AS INT) AS n, CAST(p_size AS DECIMAL(2)) = p_size AS same, date_format(CAST(p_partkey * 3600 AS TIMESTAMP), 'yyyy-MM-dd HH') AS t FROM part",
     "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS BIGINT) AS n, true AS same, strftime(make_timestamp(p_partkey * 3600000000), '%Y-%m-%d %H') AS t FROM part")
_sql("cast_bool", "SELECT _id, CAST(size_n - 3 AS BOOL) AS b FROM part_nulls", "SELECT _id, size_n - 3 > 0 AS b FROM part_nulls")
_sql("cast_set_text", "SELECT _id, CAST(tags AS STRING) AS s FROM part_tags", """SELECT _id, '["' || array_to_string(tags, '","') || '"]' AS s FROM part_tags""")
_sql("cast_timestamp_text", "SELECT event_id, CAST(ts AS STRING) AS s FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS s FROM events")
_sql("int_divide", "SELECT p_partkey, (p_size - 25) / 4 AS d, (p_size - 25) % 4 AS e, 100 / p_size / 2 AS f FROM part",
     "SELECT p_partkey, CAST(trunc((p_size - 25) / 4.0) AS BIGINT) AS d, (p_size - 25) % 4 AS e, CAST(floor(floor(100.0 / p_size) / 2.0) AS BIGINT) AS f FROM part")
_sql("arith_int", "SELECT p_partkey, p_size + 3 AS a, p_size - 50 AS b, p_size * 7 AS c, -p_size AS d FROM part")
_sql("decimal_ops", "SELECT _id, CAST(bal + 1.25 AS DOUBLE) AS a, CAST(bal - 0.5 AS DOUBLE) AS b, bal > 100.5 AS c FROM cust_dec")
_sql("decimal_mul_div", "SELECT _id, CAST(bal * 1.5 AS DOUBLE) AS m, CAST(bal / 7 AS DOUBLE) AS d, CAST(bal / -0.3 AS DOUBLE) AS e FROM cust_dec",
     "SELECT _id, floor(CAST(bal * 100 AS BIGINT) * 15 / 10.0) / 100 AS m, floor(CAST(bal * 100 AS BIGINT) / 7.0) / 100 AS d, floor(CAST(bal * -100 AS BIGINT) / 0.3::DOUBLE + 1e-9) / 100 AS e FROM cust_dec")
_sql("bitwise_not", "SELECT p_partkey, !p_size AS a, p_size << 2 AS b, p_size >> 1 AS c, p_size & 6 | 8 AS d FROM part", "SELECT p_partkey, ~p_size AS a, p_size << 2 AS b, p_size >> 1 AS c, (p_size & 6) | 8 AS d FROM part")
_sql("pattern_ops", "SELECT p_partkey FROM part WHERE p_name REGEXP '^s.*[aeiou]$' OR p_brand GLOB '*#1?' OR p_type NOT MATCH 'A'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^s.*[aeiou]$') OR p_brand GLOB '*#1?' OR NOT regexp_matches(p_type, 'A')")
_sql("concat_op", "SELECT p_partkey, p_brand || '/' || p_type AS label FROM part")

# aggregates

_sql("count_star", "SELECT COUNT(*) AS n FROM lineitem")
_sql("count_col", "SELECT COUNT(size_n) AS n, COUNT(name_n) AS m FROM part_nulls")
_sql("count_distinct", "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem")
_sql("sum_int", "SELECT SUM(p_size) AS total FROM part", "SELECT CAST(SUM(p_size) AS BIGINT) AS total FROM part")
_sql("sum_decimal", "SELECT segment, CAST(SUM(bal) AS DOUBLE) AS total FROM cust_dec GROUP BY segment")
_sql("min_max", "SELECT MIN(p_size) AS a, MAX(p_size) AS b, MIN(p_name) AS c, MAX(p_name) AS d FROM part")
_sql("group_having", """SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS total, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem
WHERE l_quantity BETWEEN 5 AND 45 GROUP BY l_returnflag HAVING COUNT(*) > 100 ORDER BY l_returnflag""",
     """SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS total, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem
WHERE l_quantity BETWEEN 5 AND 45 GROUP BY l_returnflag HAVING COUNT(*) > 100 ORDER BY l_returnflag""")  # fmt: skip
_sql("group_multi_agg", "SELECT p_brand, p_type, COUNT(*) AS n, MIN(p_size) AS lo, MAX(p_size) AS hi, COUNT(DISTINCT p_size) AS sizes FROM part GROUP BY p_brand, p_type")
_sql("multi_aggregate", "SELECT COUNT(*) AS n, MIN(o_custkey) AS lo, MAX(o_custkey) AS hi, COUNT(DISTINCT o_orderstatus) AS kinds FROM orders")
_sql("agg_filter_clause", "SELECT p_brand, COUNT(*) FILTER (WHERE p_size > 25) AS large, COUNT(*) AS n FROM part GROUP BY p_brand")
_sql("grouping_rollup", "SELECT p_brand, p_type, COUNT(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")


_sql("sql_avg", "SELECT segment, CAST(AVG(bal) AS DOUBLE) AS mean, CAST(AVG(nation) FILTER (WHERE bal > 0) AS DOUBLE) AS nation FROM cust_dec GROUP BY segment",
     "SELECT segment, trunc(CAST(SUM(CAST(bal * 100 AS BIGINT)) AS BIGINT) * 100 / COUNT(bal)) / 10000 AS mean, trunc(SUM(nation) FILTER (WHERE bal > 0) * 10000 / COUNT(*) FILTER (WHERE bal > 0)) / 10000 AS nation FROM cust_dec GROUP BY segment")
_sql("sql_var", "SELECT CAST(VAR(p_size) AS DOUBLE) AS v FROM part", "SELECT trunc(var_pop(p_size) * 1000000) / 1000000 AS v FROM part")
_sql("sql_corr", "SELECT CAST(CORR(p_size, p_partkey) AS DOUBLE) AS r FROM part", "SELECT trunc(corr(p_size, p_partkey) * 1000000) / 1000000 AS r FROM part")
_sql("sql_percentile", "SELECT p_brand, PERCENTILE(p_size, 25) AS q25, PERCENTILE(p_size, 99.5) AS top FROM part GROUP BY p_brand", "SELECT p_brand, quantile_disc(p_size, 0.25) AS q25, quantile_disc(p_size, 0.995) AS top FROM part GROUP BY p_brand")
_sql("sql_percentile_time", "SELECT date_format(PERCENTILE(ts, 50), 'yyyy-MM-dd HH:mm:ss') AS t FROM events", "SELECT strftime(quantile_disc(ts, 0.5), '%Y-%m-%d %H:%M:%S') AS t FROM events")
_sql("min_max_time", "SELECT date_format(MIN(ts), 'yyyy-MM-dd HH:mm:ss') AS a, date_format(MAX(ts), 'yyyy-MM-dd HH:mm:ss') AS b FROM events", "SELECT strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS a, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS b FROM events")
_sql("first_last", "SELECT brand, FIRST(_id) OVER (PARTITION BY brand ORDER BY _id) AS a, LAST(_id) OVER (PARTITION BY brand ORDER BY _id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM part_tags",
     "SELECT brand, first(_id) OVER (PARTITION BY brand ORDER BY _id) AS a, last(_id) OVER (PARTITION BY brand ORDER BY _id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM part_tags")


@_frame("avg4", "SELECT segment, (CAST(SUM(CAST(bal * 100 AS BIGINT)) AS BIGINT) * 100 // COUNT(bal)) / 10000.0::DOUBLE AS mean FROM cust_dec GROUP BY segment")
def _(t):
    return t["cust_dec"].groupBy("segment").agg(A.avg4(F.col("bal"), 2).cast("double").alias("mean"))


@_frame("percentile_nth", "SELECT p_brand, quantile_disc(p_size, 0.25) AS q25, quantile_disc(p_size, 0.5) AS q50 FROM part GROUP BY p_brand")
def _(t):
    return t["part"].groupBy("p_brand").agg(A.percentile("p_size", 25).cast("int").alias("q25"), A.percentile("p_size", 50).cast("int").alias("q50"))


@_frame("corr6", "SELECT trunc(corr(p_size, p_partkey) * 1000000) / 1000000 AS r FROM part")
def _(t):
    return t["part"].agg(A.corr6(F.col("p_size").cast("double"), F.col("p_partkey").cast("double")).alias("r"))


@_frame("var6", "SELECT trunc(var_pop(p_size) * 1000000) / 1000000 AS v FROM part")
def _(t):
    return t["part"].agg(A.var6(F.col("p_size")).alias("v"))


# joins, subqueries, set operations

_sql("join_inner_equi", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3")
_sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'")
_sql("join_right", "SELECT n.n_name, s.s_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
_sql("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey")
_sql("join_using", "SELECT a.p_brand, b.n FROM part a JOIN (SELECT p_partkey, p_size AS n FROM part) b USING (p_partkey)")
_sql("join_theta", "SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey")
_sql("join_cross_small", "SELECT r_name, n_name FROM region, nation")
_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("wildcards", "SELECT n.*, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_sql("subquery_from", "SELECT b.p_brand, b.n FROM (SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand) b WHERE b.n > 3")
_sql("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_sql("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_sql("exists_subquery", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
_sql("scalar_subquery", "SELECT p_partkey FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)")
_sql("correlated_scalar", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
_sql("union_distinct", "SELECT p_brand AS x FROM part UNION SELECT p_type AS x FROM part")
_sql("intersect_except", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier) EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1")
_sql("with_cte", "WITH big AS (SELECT p_brand, p_size FROM part WHERE p_size > 40) SELECT p_brand, COUNT(*) AS n FROM big GROUP BY p_brand")
_sql("window_over", "SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM part",
     "SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r, CAST(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")

# distinct, sort, limit

_sql("distinct_row", "SELECT DISTINCT p_brand, p_type FROM part")
_sql("distinct_single", "SELECT DISTINCT o_orderpriority FROM orders")
_sql("order_multi", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey")
_sql("order_ordinal", "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, 1")
_sql("order_nulls", "SELECT _id, size_n FROM part_nulls ORDER BY size_n NULLS LAST, _id LIMIT 400")
_sql("top_n", "SELECT TOP(10) o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 10")
_sql("top_nested", """WITH small AS (SELECT TOP(40) p_partkey, p_size FROM part ORDER BY p_size, p_partkey), -- the smallest
large AS (SELECT TOPN(40) p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey)
SELECT TOP 30 x.p_partkey, x.p_size FROM (SELECT TOP 20 * FROM small ORDER BY p_partkey UNION ALL SELECT * FROM large) x ORDER BY x.p_partkey /* in all */""",
     """WITH small AS (SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 40), large AS (SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 40)
SELECT x.p_partkey, x.p_size FROM ((SELECT * FROM small ORDER BY p_partkey LIMIT 20) UNION ALL SELECT * FROM large) x ORDER BY x.p_partkey LIMIT 30""")  # fmt: skip
_sql("top_union", "SELECT COUNT(*) AS n FROM (SELECT TOP(3) p_partkey FROM part UNION ALL SELECT s_suppkey FROM supplier) x", "SELECT 3 + COUNT(*) AS n FROM supplier")
_sql("order_bool", "SELECT _id, is_open FROM flags ORDER BY is_open DESC, _id LIMIT 100")
_sql("order_nulls_default", "SELECT _id, size_n FROM part_nulls ORDER BY size_n, _id LIMIT 300", "SELECT _id, size_n FROM part_nulls ORDER BY size_n NULLS FIRST, _id LIMIT 300")
_sql("limit_after_order", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 25")

# string functions

_sql("fn_reverse", "SELECT p_partkey, REVERSE(p_name) AS x FROM part")
_sql("fn_upper_lower", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l FROM part")
_sql("fn_char_ascii", "SELECT p_partkey, CHAR(p_size + 64) AS c, ASCII(PREFIX(p_name, 1)) AS a FROM part", "SELECT p_partkey, chr(p_size + 64) AS c, ascii(left(p_name, 1)) AS a FROM part")
_sql("fn_substring", "SELECT p_partkey, SUBSTRING(p_name, 2) AS a, SUBSTRING(p_name, 0, 3) AS b FROM part", "SELECT p_partkey, substring(p_name, 3) AS a, substring(p_name, 1, 3) AS b FROM part")
_sql("fn_replaceall", "SELECT p_partkey, REPLACEALL(p_name, 'e', 'E') AS x FROM part", "SELECT p_partkey, replace(p_name, 'e', 'E') AS x FROM part")
_sql("fn_stringsplit", "SELECT p_partkey, STRINGSPLIT(p_name, ' ') AS a, STRINGSPLIT(p_name, ' ', 1) AS b, STRINGSPLIT(p_name, ' ', 9) AS c FROM part", "SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, split_part(p_name, ' ', 10) AS c FROM part")
_sql("fn_trim", "SELECT p_partkey, TRIM('  ' || p_brand || ' ') AS a, LTRIM('  ' || p_brand) AS b, RTRIM(p_brand || '  ') AS c FROM part")
_sql("fn_prefix_suffix", "SELECT p_partkey, PREFIX(p_name, 3) AS a, SUFFIX(p_name, 2) AS b FROM part", "SELECT p_partkey, left(p_name, 3) AS a, right(p_name, 2) AS b FROM part")
_sql("fn_space_replicate", "SELECT p_partkey, SPACE(3) || REPLICATE(p_brand, 2) AS x FROM part", "SELECT p_partkey, '   ' || repeat(p_brand, 2) AS x FROM part")
_sql("fn_len", "SELECT p_partkey, LEN(p_name) AS n FROM part", "SELECT p_partkey, length(p_name) AS n FROM part")
_sql("fn_format", "SELECT p_partkey, FORMAT('%v-%d', p_brand, p_size) AS x FROM part", "SELECT p_partkey, p_brand || '-' || p_size AS x FROM part")
_sql("fn_charindex", "SELECT p_partkey, CHARINDEX('e', p_name) AS a, CHARINDEX('e', p_name, 3) AS b FROM part",
     "SELECT p_partkey, strpos(p_name, 'e') - 1 AS a, CASE WHEN strpos(substring(p_name, 4), 'e') = 0 THEN -1 ELSE strpos(substring(p_name, 4), 'e') + 2 END AS b FROM part")
_sql("fn_str", "SELECT p_partkey, STR(p_size, 6) AS a, STR(p_partkey, 3) AS b FROM part", "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 6, ' ') AS a, CASE WHEN p_partkey > 999 THEN '***' ELSE lpad(CAST(p_partkey AS VARCHAR), 3, ' ') END AS b FROM part")

# date functions

_sql("fn_datetimepart", "SELECT event_id, " + ", ".join(f"DATETIMEPART('{u}', ts) AS {u.lower()}" for u in ("YY", "YD", "M", "D", "W", "WK", "HH", "MI", "S", "MS")) + " FROM events",
     "SELECT event_id, year(ts) AS yy, dayofyear(ts) AS yd, month(ts) AS m, day(ts) AS d, dayofweek(ts) AS w, weekofyear(ts) AS wk, hour(ts) AS hh, minute(ts) AS mi, second(ts) AS s, millisecond(ts) % 1000 AS ms FROM events")
_sql("fn_datetimename", "SELECT event_id, DATETIMENAME('M', ts) AS m, DATETIMENAME('W', ts) AS w, DATETIMENAME('YY', ts) AS y FROM events", "SELECT event_id, monthname(ts) AS m, dayname(ts) AS w, CAST(year(ts) AS VARCHAR) AS y FROM events")
_sql("fn_date_trunc", "SELECT event_id, DATE_TRUNC('M', ts) AS m, DATE_TRUNC('MI', ts) AS mi, DATE_TRUNC('D', ts) AS d FROM events", "SELECT event_id, strftime(ts, '%Y-%m') AS m, strftime(ts, '%Y-%m-%dT%H:%M') AS mi, strftime(ts, '%Y-%m-%d') AS d FROM events")
_sql("fn_datetimeadd", "SELECT event_id, date_format(DATETIMEADD('M', 1, ts), 'yyyy-MM-dd HH:mm') AS m, date_format(DATETIMEADD('HH', 30, ts), 'yyyy-MM-dd HH:mm') AS h, date_format(DATETIMEADD('YY', -1, ts), 'yyyy-MM-dd HH:mm') AS y FROM events",
     "SELECT event_id, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH + (ts - date_trunc('month', ts)), '%Y-%m-%d %H:%M') AS m, strftime(ts + INTERVAL 30 HOUR, '%Y-%m-%d %H:%M') AS h, strftime(date_trunc('month', ts) - INTERVAL 1 YEAR + (ts - date_trunc('month', ts)), '%Y-%m-%d %H:%M') AS y FROM events")
_sql("fn_datetimediff", "SELECT o_orderkey, DATETIMEDIFF('YY', o_orderdate, TIMESTAMP '2003-02-01 00:00:00') AS y, DATETIMEDIFF('M', o_orderdate, TIMESTAMP '2003-02-01 00:00:00') AS m, DATETIMEDIFF('D', o_orderdate, TIMESTAMP '2003-02-01 12:00:00') AS d FROM orders",
     "SELECT o_orderkey, date_diff('year', o_orderdate, TIMESTAMP '2003-02-01 00:00:00') AS y, date_diff('month', o_orderdate, TIMESTAMP '2003-02-01 00:00:00') AS m, (epoch_us(TIMESTAMP '2003-02-01 12:00:00') - epoch_us(o_orderdate)) // 86400000000 AS d FROM orders")
_sql("fn_datetimefromparts", "SELECT p_partkey, date_format(DATETIMEFROMPARTS(2020, p_size % 12 + 1, 3, 4, p_size, 6, 250), 'yyyy-MM-dd HH:mm:ss.SSS') AS x FROM part", "SELECT p_partkey, strftime(make_timestamp(2020, p_size % 12 + 1, 3, 4, p_size, 6.25), '%Y-%m-%d %H:%M:%S.%g') AS x FROM part")
_sql("fn_totimestamp", "SELECT p_partkey, date_format(TOTIMESTAMP(p_partkey * 86400), 'yyyy-MM-dd') AS a, date_format(TOTIMESTAMP(p_partkey * 3600000, 'ms'), 'yyyy-MM-dd HH') AS b FROM part", "SELECT p_partkey, strftime(make_timestamp(p_partkey * 86400000000), '%Y-%m-%d') AS a, strftime(make_timestamp(p_partkey * 3600000000), '%Y-%m-%d %H') AS b FROM part")

# sets

_sql("fn_setcontains", "SELECT _id FROM part_tags WHERE SETCONTAINS(tags, 'Brand#3')", "SELECT _id FROM part_tags WHERE list_contains(tags, 'Brand#3')")
_sql("fn_setcontainsall", "SELECT _id FROM part_tags WHERE SETCONTAINSALL(tags, ['Brand#1', 'large'])", "SELECT _id FROM part_tags WHERE list_has_all(tags, ['Brand#1', 'large'])")
_sql("fn_setcontainsany", "SELECT _id FROM part_tags WHERE SETCONTAINSANY(tags, ['Brand#1', 'Brand#2'])", "SELECT _id FROM part_tags WHERE list_has_any(tags, ['Brand#1', 'Brand#2'])")
_sql("set_equality", "SELECT _id FROM part_tags WHERE tags = ['Brand#1', 'large'] OR (tags != ['Brand#2'] AND size = 4)", "SELECT _id FROM part_tags WHERE list_has_all(tags, ['Brand#1', 'large']) OR (NOT list_has_all(tags, ['Brand#2']) AND size = 4)")
_sql("tuple_literal", "SELECT _id, {size, brand}.col1 AS size, {size, brand}.col2 AS brand FROM part_tags", "SELECT _id, size, brand FROM part_tags")
_sql("group_flatten", "SELECT tags, COUNT(*) AS n, SUM(size) AS total FROM part_tags WITH (flatten(tags)) GROUP BY tags", "SELECT tags, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS total FROM (SELECT unnest(tags) AS tags, size FROM part_tags) GROUP BY tags")
_sql("distinct_set_members", "SELECT DISTINCT tags FROM part_tags WITH (flatten(tags))", "SELECT DISTINCT unnest(tags) AS tags FROM part_tags")

# call language

_IDS = "SELECT _id FROM part_tags WHERE "
_pql("pql_row", "part_tags", "Row(tags='Brand#3')", _IDS + "list_contains(tags, 'Brand#3')")
_pql("pql_row_cond", "part_tags", "Row(10 <= size < 20)", _IDS + "size >= 10 AND size < 20")
_pql("pql_row_null", "part_nulls", "Intersect(Row(size_n == null), Row(name_n != null))", "SELECT _id FROM part_nulls WHERE size_n IS NULL AND name_n IS NOT NULL")
_pql("pql_intersect", "part_tags", "Intersect(Row(tags='Brand#3'), Row(size > 20))", _IDS + "list_contains(tags, 'Brand#3') AND size > 20")
_pql("pql_union", "part_tags", "Union(Row(brand='Brand#3'), Row(size=7))", _IDS + "brand = 'Brand#3' OR size = 7")
_pql("pql_difference", "part_tags", "Difference(Row(size > 5), Row(brand='Brand#3'), Row(size=9))", _IDS + "size > 5 AND NOT brand = 'Brand#3' AND NOT size = 9")
_pql("pql_xor", "part_tags", "Xor(Row(size > 25), Row(brand='Brand#3'))", _IDS + "(size > 25) != (brand = 'Brand#3')")
_pql("pql_not", "part_nulls", "Not(Row(size_n=3))", "SELECT _id FROM part_nulls WHERE NOT coalesce(size_n = 3, false)")
_pql("pql_shift", "part_tags", "Shift(Row(size=7), n=5)", "SELECT _id + 5 AS _id FROM part_tags WHERE size = 7")
_pql("pql_constrow", "part_tags", "ConstRow(columns=[1, 5, 99, 100000000])", _IDS + "_id IN (1, 5, 99, 100000000)")
_pql("pql_limit", "part_tags", "Limit(Row(size > 3), limit=20, offset=5)", _IDS + "size > 3 ORDER BY _id LIMIT 20 OFFSET 5")
_pql("pql_all", "part_tags", "All(limit=10, offset=3)", "SELECT _id FROM part_tags ORDER BY _id LIMIT 10 OFFSET 3")
_pql("pql_nested_limit", "part_tags", "Union(Limit(Row(size > 3), limit=20), Row(size=1))", _IDS + "size = 1 OR _id IN (SELECT _id FROM part_tags WHERE size > 3 ORDER BY _id LIMIT 20)")
_pql("pql_count", "part_tags", "Count(Intersect(Row(size > 10), Row(tags='Brand#1')))", "SELECT count(*) AS count FROM part_tags WHERE size > 10 AND list_contains(tags, 'Brand#1')")
_pql("pql_count_distinct", "part_tags", "Count(Distinct(Row(size > 10), field=tags))", "SELECT count(DISTINCT t) AS count FROM (SELECT unnest(tags) AS t FROM part_tags WHERE size > 10)")
_pql("pql_sum", "part_tags", "Sum(Row(brand='Brand#1'), field=cents)", "SELECT CAST(sum(cents) AS BIGINT) AS value, count(cents) AS count FROM part_tags WHERE brand = 'Brand#1'")
_pql("pql_min_max", "part_tags", "Max(Row(brand='Brand#1'), field=size)", "SELECT size AS value, count(*) AS count FROM part_tags WHERE brand = 'Brand#1' GROUP BY size ORDER BY size DESC LIMIT 1")
_pql("pql_min", "part_tags", "Min(field=size)", "SELECT size AS value, count(*) AS count FROM part_tags GROUP BY size ORDER BY size LIMIT 1")
_pql("pql_maxrow", "part_tags", "MaxRow(field=tags)", "SELECT t AS value, count(*) AS count FROM (SELECT unnest(tags) AS t FROM part_tags) GROUP BY t ORDER BY t DESC LIMIT 1")
_pql("pql_minrow", "part_tags", "MinRow(field=tags)", "SELECT t AS value, count(*) AS count FROM (SELECT unnest(tags) AS t FROM part_tags) GROUP BY t ORDER BY t LIMIT 1")
_pql("pql_bitmap", "part_tags", "Bitmap(brand='Brand#7')", _IDS + "brand = 'Brand#7'")
_pql("pql_range", "events_q", "Range(kinds='view', from=2024-01-08T00:00, to=2024-01-09T00:00)", "SELECT DISTINCT _id FROM ev WHERE value = 'view' AND ts >= '2024-01-08' AND ts < '2024-01-09'")
_pql("pql_distinct", "part_tags", "Distinct(Row(size < 9), field=tags)", "SELECT DISTINCT unnest(tags) AS value FROM part_tags WHERE size < 9")
_pql("pql_rows", "part_tags", "Rows(tags, previous='Brand#2', like='%r%', limit=30)", "SELECT DISTINCT t AS value FROM (SELECT unnest(tags) AS t FROM part_tags) WHERE t > 'Brand#2' AND t LIKE '%r%' ORDER BY t LIMIT 30")
_pql("pql_unionrows", "part_tags", "UnionRows(Rows(tags, in=['Brand#1', 'Brand#5']))", _IDS + "list_has_any(tags, ['Brand#1', 'Brand#5'])")
_pql("pql_unionrows_limit", "part_tags", "UnionRows(Rows(tags, limit=3), Rows(brand, column=17))",
     _IDS + "list_has_any(tags, (SELECT list(t) FROM (SELECT DISTINCT unnest(tags) AS t FROM part_tags ORDER BY t LIMIT 3))) OR brand IN (SELECT brand FROM part_tags WHERE _id = 17)")
_pql("pql_innerunionrows", "part_tags", "InnerUnionRows(field=tags, rows=['Brand#2', 'Brand#7'])", _IDS + "list_has_any(tags, ['Brand#2', 'Brand#7'])")
_pql("pql_topn", "part_tags", "TopN(tags, Row(size > 10), n=5)", "SELECT t AS value, count(*) AS count FROM (SELECT unnest(tags) AS t FROM part_tags WHERE size > 10) GROUP BY t ORDER BY count DESC, t LIMIT 5")
_pql("pql_topk", "part_tags", "TopK(brand, k=7, filter=Row(size < 40))", "SELECT brand AS value, count(*) AS count FROM part_tags WHERE size < 40 GROUP BY brand ORDER BY count DESC, brand LIMIT 7")
_pql("pql_groupby", "part_tags", "GroupBy(Rows(tags), Rows(kind), filter=Row(size > 10))", "SELECT tags, kind, count(*) AS count FROM (SELECT unnest(tags) AS tags, kind FROM part_tags WHERE size > 10) GROUP BY tags, kind")
_pql("pql_groupby_agg_having", "part_tags", "GroupBy(Rows(brand), Rows(kind), aggregate=Sum(field=size), having=Condition(count > 2), sort='count desc', limit=50)",
     "SELECT brand, kind, count(*) AS count, CAST(sum(size) AS BIGINT) AS agg FROM part_tags GROUP BY brand, kind HAVING count(*) > 2 ORDER BY count DESC, brand, kind LIMIT 50")
_pql("pql_groupby_previous", "part_tags", "GroupBy(Rows(brand), Rows(kind), previous=['Brand#2', 'M'])", "SELECT brand, kind, count(*) AS count FROM part_tags WHERE brand > 'Brand#2' OR (brand = 'Brand#2' AND kind > 'M') GROUP BY brand, kind")
_pql("pql_groupby_rows_limit", "part_tags", "GroupBy(Rows(tags, limit=5), Rows(brand, column=17))",
     "SELECT tags, brand, count(*) AS count FROM (SELECT unnest(tags) AS tags, brand FROM part_tags) WHERE tags IN (SELECT DISTINCT unnest(tags) AS t FROM part_tags ORDER BY t LIMIT 5) AND brand IN (SELECT brand FROM part_tags WHERE _id = 17) GROUP BY tags, brand")
_pql("pql_extract", "part_tags", "Extract(Row(tags='Brand#4'), Rows(size), Rows(kind))", "SELECT _id, size, kind FROM part_tags WHERE list_contains(tags, 'Brand#4')")
_pql("pql_sort", "part_tags", "Sort(Row(brand='Brand#4'), field=cents, limit=12, sort-desc=true)", "SELECT _id, cents AS value FROM part_tags WHERE brand = 'Brand#4' ORDER BY cents DESC, _id LIMIT 12")
_pql("pql_percentile", "part_tags", "Percentile(field=size, nth=75.0, filter=Row(brand='Brand#1'))",
     "SELECT size AS value, count(*) AS count FROM part_tags WHERE brand = 'Brand#1' AND size = (SELECT quantile_disc(size, 0.75) FROM part_tags WHERE brand = 'Brand#1') GROUP BY size")
_pql("pql_includescolumn", "part_tags", "IncludesColumn(Row(size > 0), column=17)", "SELECT count(*) > 0 AS result FROM part_tags WHERE size > 0 AND _id = 17")
_pql("pql_fieldvalue", "part_tags", "FieldValue(field=brand, column=17)", "SELECT brand AS value FROM part_tags WHERE _id = 17")
_pql("pql_options_shards", "part_tags", "Options(Row(size > 30), shards=[0])", _IDS + "size > 30 AND _id // 1048576 IN (0)")
_pql("pql_bool_row", "flags", "Count(Row(is_open=true))", "SELECT count(*) AS count FROM flags WHERE is_open")


@_frame("pql_store", "SELECT _id, CASE WHEN size IN (3, 4) THEN 'Brand#9' WHEN brand = 'Brand#9' THEN NULL ELSE brand END AS brand FROM part_tags")
def _(t):
    return Engine(t["part_tags"]).one("Store(Union(Row(size=3), Row(size=4)), brand='Brand#9')").select("_id", "brand")


@_frame("pql_set_time", "SELECT _id, count(*) + CAST(_id = 3 AS INT) AS n, count(*) FILTER (WHERE value = 'click' AND ts >= '2024-01-05' AND ts < '2024-01-06') + CAST(_id = 3 AS INT) AS day FROM ev GROUP BY _id")
def _(t):
    after = Engine(t["events_q"]).one("Set(3, kinds='click', 2024-01-05T23:59)")
    day = F.filter("kinds", lambda x: (x["value"] == "click") & (x["ts"] >= "2024-01-05") & (x["ts"] < "2024-01-06"))
    return after.select("_id", F.size("kinds").cast("long").alias("n"), F.size(day).cast("long").alias("day"))


@_frame("pql_writes", "SELECT _id, CASE WHEN _id = 3 THEN 'Brand#99' WHEN brand = 'Brand#1' THEN NULL ELSE brand END AS brand FROM part_tags WHERE size <= 45 UNION ALL SELECT -1, 'Brand#99'")
def _(t):
    df = t["part_tags"]
    for call in ("Delete(Row(size > 45))", "ClearRow(brand='Brand#1')", "Set(3, brand='Brand#99')"):
        df = Engine(df).one(call)
    df = df.filter("_id != 3 OR size <= 45")
    return mutate.set_(df, -1, "brand", "Brand#99").select("_id", "brand")


# time quantum

_pql("quantum_range", "events_q", "Row(kinds='click', from=2024-01-05T00:00, to=2024-01-10T00:00)", "SELECT DISTINCT _id FROM ev WHERE value = 'click' AND ts >= '2024-01-05' AND ts < '2024-01-10'")
_pql("quantum_rows_from_to", "events_q", "Rows(kinds, from=2024-01-05T00:00, to=2024-01-06T00:00)", "SELECT DISTINCT value FROM ev WHERE ts >= '2024-01-05' AND ts < '2024-01-06'")
_sql("rangeq_members", "SELECT _id, size(RANGEQ(kinds, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-10')) AS n FROM events_q", "SELECT _id, CAST(count(*) FILTER (WHERE ts >= '2024-01-05' AND ts < '2024-01-10') AS INT) AS n FROM ev GROUP BY _id")


@_frame("quantum_members", "SELECT _id, coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (WHERE ts >= '2024-01-05' AND ts < '2024-01-10'), '') AS members FROM ev GROUP BY _id")
def _(t):
    return t["events_q"].select("_id", F.array_join(quantum.members("kinds", "2024-01-05", "2024-01-10"), ",").alias("members"))


@_frame("quantum_views", "SELECT strftime(ts, 'kinds_%Y%m%d') AS view, count(DISTINCT _id) AS n FROM ev WHERE ts >= '2024-01-03' AND ts < '2024-01-07' GROUP BY 1")
def _(t):
    cover = quantum.cover("kinds", "YMD", datetime(2024, 1, 3), datetime(2024, 1, 7))
    ev = t["events"].select(F.col("user_id").alias("_id"), F.concat(F.lit("kinds_"), F.date_format("ts", "yyyyMMdd")).alias("view"))
    return ev.filter(F.col("view").isin(cover)).groupBy("view").agg(F.count_distinct("_id").alias("n"))


# filter API

@_frame("dsl_and_or", "SELECT _id, size FROM part_tags WHERE (brand = 'Brand#1' OR list_contains(tags, 'Brand#2')) AND size >= 10")
def _(t):
    return L.extract(t["part_tags"], L.all_of(L.any_of(L.equals("brand", "Brand#1"), L.contains("tags", "Brand#2")), L.compare("size", "GE", 10)), "size")


@_frame("dsl_string_eq_neq", "SELECT _id FROM part_nulls WHERE name_n != 'Brand#1'")
def _(t):
    return L.extract(t["part_nulls"], L.differs("name_n", "Brand#1"))


@_frame("dsl_regex", "SELECT _id, brand FROM part_tags WHERE regexp_full_match(brand, 'Brand#1.?') AND NOT regexp_full_match(brand, '.*[02468]')")
def _(t):
    return L.extract(t["part_tags"], L.matches("brand", "Brand#1.?") & L.differs_from_pattern("brand", ".*[02468]"), "brand")


@_frame("dsl_bsi_compare", "SELECT _id FROM part_nulls WHERE size_n < 4 AND size_n != 2")
def _(t):
    return L.extract(t["part_nulls"], L.compare("size_n", "LT", 4) & L.compare("size_n", "NEQ", 2))


@_frame("dsl_bsi_range", "SELECT _id FROM part_nulls WHERE size_n BETWEEN 2 AND 5")
def _(t):
    return L.extract(t["part_nulls"], L.compare("size_n", "RANGE", 2, 5))


@_frame("dsl_sum_count", "SELECT count(size_n) AS count, CAST(sum(size_n) AS BIGINT) AS sum FROM part_nulls WHERE name_n = 'Brand#1'")
def _(t):
    return L.sum_count(t["part_nulls"], "size_n", L.equals("name_n", "Brand#1"))


@_frame("dsl_rows_iter", "SELECT t AS value, count(DISTINCT _id) AS n, min(_id) AS first_id, max(_id) AS last_id FROM (SELECT _id, unnest(tags) AS t FROM part_tags) GROUP BY t")
def _(t):
    return L.rows_iter(t["part_tags"], "tags")


@_frame("dsl_row_ids", "SELECT DISTINCT brand AS value FROM part_tags WHERE brand >= 'Brand#2' AND size > 5")
def _(t):
    return L.row_ids(t["part_tags"], "brand", start="Brand#2", where=L.compare("size", "GT", 5))


# bitmaps

@_frame("bitmap_count_range", "SELECT count(*) AS n FROM part_tags WHERE _id >= 100 AND _id < 1500 AND size > 10")
def _(t):
    return L.bitmap(t["part_tags"].filter("_id >= 100 AND _id < 1500 AND size > 10")).agg(F.sum(F.bitmap_count("bits")).alias("n"))


@_frame("bitmap_and_or_count", "SELECT count(*) FILTER (WHERE size > 25 AND brand = 'Brand#1') AS n_and, count(*) FILTER (WHERE size > 25 OR brand = 'Brand#1') AS n_or FROM part_tags")
def _(t):
    a, b = (L.bitmap(t["part_tags"].filter(p)) for p in ("size > 25", "brand = 'Brand#1'"))
    n = lambda how, name: L.bitmap_combine(a, b, how).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))
    return n("and", "n_and").crossJoin(n("or", "n_or"))  # one row each


@_frame("ids_merge", "SELECT DISTINCT _id FROM part_tags WHERE brand = 'Brand#1' OR size < 9 ORDER BY _id LIMIT 50")
def _(t):
    df = t["part_tags"]
    return L.merge(df.filter("brand = 'Brand#1'"), df.filter("size < 9"), limit=50)


@_frame("offset_range", "SELECT _id - 100 + 5000 AS _id FROM part_tags WHERE _id >= 100 AND _id < 900 AND size > 25")
def _(t):
    return L.offset_range(t["part_tags"].filter("size > 25"), 5000, 100, 900)


@_frame("bitmap_import", "SELECT count(*) FILTER (WHERE size > 25 AND NOT brand = 'Brand#1') AS cleared, count(*) FILTER (WHERE size > 25 OR brand = 'Brand#1') AS added FROM part_tags")
def _(t):
    old, new = (L.bitmap(t["part_tags"].filter(p)) for p in ("size > 25", "brand = 'Brand#1'"))
    n = lambda clear, name: L.bitmap_import(old, new, clear).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))
    return n(True, "cleared").crossJoin(n(False, "added"))  # one row each


@_frame("bitmap_ids", "SELECT _id FROM part_tags WHERE size > 25")
def _(t):
    return L.bitmap_ids(L.bitmap(t["part_tags"].filter("size > 25")))


@_frame("dsl_blob", "SELECT _id FROM part_tags WHERE brand != 'Brand#1' AND kind = (SELECT min(kind) FROM part_tags)")
def _(t):
    df = t["part_tags"].withColumns({"b": F.col("brand").cast("binary"), "k": F.col("kind").cast("binary")})
    least = df.agg(F.min("kind")).first()[0].encode()
    return L.extract(df, L.differs("b", b"Brand#1") & L.equals("k", bytearray(least)))


# writes and catalog statements

_PART = "CREATE TABLE items (_id ID, name STRING, size INT MIN 0 MAX 1000, tags STRINGSET)"
_FILL = "INSERT INTO items (_id, name, size) SELECT p_partkey, p_name, p_size FROM part"
_script("sql_insert_select", "SELECT p_partkey AS _id, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part", _PART, _FILL, "SELECT _id, name, size FROM items")
_script("sql_update", "SELECT p_partkey AS _id, CASE WHEN p_size > 40 THEN p_size * 2 ELSE p_size END::BIGINT AS size, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS name FROM part",
        _PART, _FILL, "UPDATE items SET size = size * 2, name = UPPER(name) WHERE size > 40", "SELECT _id, size, name FROM items")
_script("sql_delete", "SELECT p_partkey AS _id FROM part WHERE NOT p_name ILIKE 's%'", _PART, _FILL, "DELETE FROM items WHERE name LIKE 's%'", "SELECT _id FROM items")
_script("sql_replace", "SELECT p_partkey AS _id, CASE WHEN p_partkey < 10 THEN 'new' ELSE p_name END AS name FROM part", _PART, _FILL, "REPLACE INTO items (_id, name) SELECT _id, 'new' FROM items WHERE _id < 10", "SELECT _id, name FROM items")
_script("sql_alter_table", "SELECT p_partkey AS _id, p_name AS title, NULL::BIGINT AS extra FROM part",
        _PART, _FILL, "ALTER TABLE items RENAME COLUMN name TO title", "ALTER TABLE items ADD COLUMN extra INT", "ALTER TABLE items DROP COLUMN size", "ALTER TABLE items DROP COLUMN tags", "SELECT * FROM items")
_script("sql_view", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand", "CREATE VIEW large AS SELECT * FROM part WHERE p_size > 20", "ALTER VIEW large AS SELECT * FROM part WHERE p_size > 10", "SELECT p_brand, COUNT(*) AS n FROM large GROUP BY p_brand")
_script("sql_show_tables", "SELECT unnest(['cust_dec', 'cust_parts', 'customer', 'events', 'events_q', 'flags', 'items', 'lineitem', 'nation', 'orders', 'part', 'part_nulls', 'part_tags', 'region', 'supplier']) AS name", _PART, "SHOW TABLES")
_script("sql_show_columns", "SELECT unnest(['_id', 'name', 'size', 'tags']) AS name, unnest(['bigint', 'string', 'bigint', 'array<string>']) AS type", _PART, "SHOW COLUMNS FROM items")
_script("sql_show_create_table", "SELECT 'CREATE TABLE items (_id id, name string, size int MIN 0 MAX 1000, tags stringset)' AS ddl", _PART, "SHOW CREATE TABLE items")
_script("sql_databases", "SELECT * FROM (VALUES ('default', NULL, NULL), ('lake', 'cold', 4)) x(name, comment, units)", "CREATE DATABASE lake WITH UNITS 2", "CREATE DATABASE gone", "ALTER DATABASE lake SET UNITS 4 COMMENT 'cold'", "DROP DATABASE gone", "SHOW DATABASES")
_script("sql_function", "SELECT p_partkey, p_size * 2 + 1 AS x FROM part", "CREATE FUNCTION twice(@n INT, @more INT) RETURNS INT AS (@n * 2 + @more)", "SELECT p_partkey, twice(p_size, 1) AS x FROM part")
_script("sql_copy", "SELECT count(*) AS n FROM part", "COPY part TO copied", "DROP TABLE part", "SELECT COUNT(*) AS n FROM copied")
_script("sql_bulk_insert", "SELECT p_partkey AS _id, upper(p_name) AS name, CAST(p_size AS BIGINT) AS size FROM part", "CREATE TABLE items (_id ID, name STRING, size INT)",
        "BULK INSERT INTO items (_id, name, size) MAP ('p_partkey' ID, 'p_name' STRING, 'p_size' INT) TRANSFORM (@0, UPPER(@1), @2) FROM '{dir}/part.parquet' WITH BATCHSIZE 1000 FORMAT 'PARQUET' INPUT 'FILE'", "SELECT _id, name, size FROM items")
_sql("implicit_coercion", "SELECT event_id, value > 10 AS large, event_id + 0.5 > 100 AS later FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-06T12:00:00'",
     "SELECT event_id, value > 10 AS large, event_id + 0.5 > 100 AS later FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 12:00:00'")


@_frame("sql_variable", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_brand = 'Brand#2'")
def _(t):
    return Session(t["part"].sparkSession, t).sql("SELECT p_partkey FROM part WHERE p_size > @least AND p_brand = @brand", least=40, brand="Brand#2")


@_frame("dsl_shards", "SELECT o_orderkey >> 20 AS shard, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return L.shards(t["orders"].select(F.col("o_orderkey").alias("_id")))


@_frame("cursor_seek", "SELECT (SELECT min(_id) FROM part_tags WHERE size > 40 AND _id >= 100) AS next, (SELECT max(_id) FROM part_tags WHERE size > 40 AND _id < 100) AS prev, (SELECT max(_id) FROM part_tags WHERE size > 40) AS last")
def _(t):
    ids = t["part_tags"].filter("size > 40")
    named = lambda df, n: df.select(F.col("_id").alias(n))
    return named(L.seek(ids, 100), "next").crossJoin(named(L.seek(ids, 100, back=True, strict=True), "prev")).crossJoin(named(L.seek(ids, back=True), "last"))  # one row each


@_frame("key_search", "SELECT DISTINCT t AS key FROM (SELECT unnest(tags) AS t FROM part_tags) WHERE regexp_full_match(t, '[a-m].*|Brand#1.')")
def _(t):
    return L.keys(t["part_tags"], "tags", pattern="[a-m].*|Brand#1.")
