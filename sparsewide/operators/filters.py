"""The composable filter API: every filter is one boolean Column, so a tree of them is one predicate of one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def noop() -> Column:
    return F.lit(False)


def all_of(*filters: Column) -> Column:
    """And; of nothing: the empty set."""
    return reduce(lambda a, b: a & b, filters) if filters else noop()


def any_of(*filters: Column) -> Column:
    return reduce(lambda a, b: a | b, filters) if filters else noop()


def not_(f: Column) -> Column:
    """Records not in the set: unknown counts as outside."""
    return ~F.coalesce(f, F.lit(False))


def equals(name: str, value) -> Column:
    return F.col(name) == F.lit(value)


def differs(name: str, value) -> Column:
    """Records that have a value, another one."""
    return F.col(name) != F.lit(value)


def matches(name: str, pattern: str) -> Column:
    """The whole string matches."""
    return F.col(name).rlike(f"^(?:{pattern})$")


def differs_from_pattern(name: str, pattern: str) -> Column:
    return ~matches(name, pattern)


def contains(name: str, value) -> Column:
    return F.array_contains(name, value)


_COMPARE = {"LT": lambda c, v: c < v, "LE": lambda c, v: c <= v, "EQ": lambda c, v: c == v, "NEQ": lambda c, v: c != v, "GE": lambda c, v: c >= v, "GT": lambda c, v: c > v}


def compare(name: str, op: str, value, to=None) -> Column:
    """LT, LE, EQ, NEQ, GE, GT, or RANGE with both ends."""
    return F.col(name).between(value, to) if op == "RANGE" else _COMPARE[op](F.col(name), value)


def extract(df: DataFrame, where: Column, *fields: str) -> DataFrame:
    return df.filter(where).select("_id", *fields)


def sum_count(df: DataFrame, name: str, where: Column) -> DataFrame:
    return df.filter(where).agg(F.count(name).alias("count"), F.sum(name).alias("sum"))


def row_ids(df: DataFrame, name: str, *, start=None, where: Column | None = None) -> DataFrame:
    """Distinct row ids (members, for sets) from `start` on, in order."""
    df = df if where is None else df.filter(where)
    value = F.explode(name) if dict(df.dtypes)[name].startswith("array") else F.col(name)
    out = df.select(value.alias("value")).distinct().filter("value IS NOT NULL")
    return (out if start is None else out.filter(F.col("value") >= start)).orderBy("value")


def rows_iter(df: DataFrame, name: str) -> DataFrame:
    """(value, number of records, smallest, largest record) in order of value; the sets stay distributed."""
    value = F.explode(name) if dict(df.dtypes)[name].startswith("array") else F.col(name)
    out = df.select(value.alias("value"), "_id").filter("value IS NOT NULL").groupBy("value")
    return out.agg(F.count_distinct("_id").alias("n"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id")).orderBy("value")


def bitmap(df: DataFrame, name: str = "_id") -> DataFrame:
    """(bucket, bits): the ids as bitmaps, one for each bucket."""
    return df.groupBy(F.bitmap_bucket_number(name).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(name)).alias("bits"))


def bitmap_combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """The union ('or') or intersection ('and') of two bitmap tables."""
    agg = F.bitmap_or_agg if how == "or" else F.bitmap_and_agg
    both = a.unionByName(b).groupBy("bucket").agg(agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return (both if how == "or" else both.filter("n = 2")).drop("n")


def merge(*ids: DataFrame, limit: int | None = None) -> DataFrame:
    """The sorted union of id tables, its first `limit` ids."""
    out = ids[0].select("_id")
    for other in ids[1:]:
        out = out.union(other.select("_id"))
    out = out.distinct().orderBy("_id")
    return out if limit is None else out.limit(limit)


def offset_range(ids: DataFrame, offset: int, start: int, end: int) -> DataFrame:
    """The ids of [start, end), moved so that `start` becomes `offset`."""
    return ids.filter((F.col("_id") >= start) & (F.col("_id") < end)).select((F.col("_id") - start + offset).alias("_id"))


def bitmap_import(old: DataFrame, new: DataFrame, clear: bool = False) -> DataFrame:
    """A bitmap table after the ids of another were set in it, or taken from it."""
    if not clear:
        return bitmap_combine(old, new, "or")
    both = old.join(new.withColumnRenamed("bits", "_gone"), "bucket", "left")
    # taking bits away: what is set in either, less what is set in the second, bucket by bucket
    ids = bitmap_ids(both.select("bucket", "bits")).join(bitmap_ids(both.select("bucket", F.col("_gone").alias("bits")).filter("bits is not null")), "_id", "left_anti")
    return bitmap(ids)


def bitmap_ids(bits: DataFrame) -> DataFrame:
    """The ids of a bitmap table, each once. Buckets from 1 on count up from their first id; those up to 0 hold 0 and negative ids and count down."""
    byte = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("bits")), lambda k: F.conv(F.hex(F.substring(F.col("bits"), k, F.lit(1))), 16, 10).cast("int"))).alias("at", "byte")
    each = bits.select("bucket", byte).filter("byte != 0").select("bucket", "at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.expr("byte").bitwiseAND(F.call_function("shiftleft", F.lit(1), b)) != 0)).alias("bit"))
    place = F.col("at") * 8 + F.col("bit")
    return each.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place).alias("_id"))


#: Bits of an id below its shard.
SHARD_BITS = 20


def shards(df: DataFrame) -> DataFrame:
    """(shard, n): the shards that hold records, and how many."""
    return df.groupBy(F.shiftright("_id", SHARD_BITS).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def seek(ids: DataFrame, at: int | None = None, *, back: bool = False, strict: bool = False) -> DataFrame:
    """The first id from `at` on (the last one up to `at`, if back), as one row or none; strict leaves `at` itself out. Without `at` the first or last of all."""
    c = F.col("_id")
    if at is not None:
        ids = ids.filter((c < at if strict else c <= at) if back else (c > at if strict else c >= at))
    return ids.agg((F.max if back else F.min)("_id").alias("_id")).filter("_id IS NOT NULL")


def keys(df: DataFrame, name: str, *, pattern: str | None = None) -> DataFrame:
    """The distinct keys of a field, or those that match a pattern as a whole; the files' own dictionaries translate them."""
    value = F.explode(name) if dict(df.dtypes)[name].startswith("array") else F.col(name)
    out = df.select(value.alias("key")).filter("key IS NOT NULL").distinct()
    return out if pattern is None else out.filter(F.col("key").rlike(f"^(?:{pattern})$"))
