"""Writes as DataFrame to DataFrame transforms; the caller appends or overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_set(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name].startswith("array")


def _put(df: DataFrame, name: str, value, ts=None) -> Column:
    """The field with the value put in; a member of a time-bucketed set has a time or null."""
    old, v = F.col(name), F.lit(value)
    if "struct<value" in dict(df.dtypes)[name]:
        v = F.struct(v.alias("value"), F.lit(ts).cast("timestamp").alias("ts"))
    elif ts is not None:
        raise ValueError(f"{name} takes no time")
    return F.array_sort(F.array_union(F.coalesce(old, F.array().cast(df.schema[name].dataType)), F.array(v).cast(df.schema[name].dataType))) if _is_set(df, name) else v.cast(df.schema[name].dataType)


def set_(df: DataFrame, column, name: str, value, ts=None) -> DataFrame:
    """Sets a record's field (adds to a set); a record that is new is added."""
    changed = df.withColumn(name, F.when(F.col("_id") == column, _put(df, name, value, ts)).otherwise(F.col(name)))
    spark = df.sparkSession
    new = spark.range(1).select(F.lit(column).cast(df.schema["_id"].dataType).alias("_id")).join(df.select("_id"), "_id", "left_anti")
    empty = new.select(*[F.col("_id") if c == "_id" else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    return changed.unionByName(empty.withColumn(name, _put(empty, name, value, ts)))


def clear(df: DataFrame, column, name: str, value) -> DataFrame:
    """Takes the value from a record's field."""
    rest = F.array_remove(name, value) if _is_set(df, name) else F.when(F.col(name) == F.lit(value), None).otherwise(F.col(name))
    return df.withColumn(name, F.when(F.col("_id") == column, rest).otherwise(F.col(name)))


def clear_row(df: DataFrame, name: str, value) -> DataFrame:
    """Takes the value from every record."""
    rest = F.array_remove(name, value) if _is_set(df, name) else F.when(F.col(name) == F.lit(value), None).otherwise(F.col(name))
    return df.withColumn(name, rest)


def store(df: DataFrame, where: Column, name: str, value) -> DataFrame:
    """The records where `where` holds, and only they, have the value."""
    cleared = clear_row(df, name, value)
    return cleared.withColumn(name, F.when(where, _put(df, name, value)).otherwise(F.col(name)))


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def upsert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those with the same _id and are added otherwise."""
    return df.join(rows.select("_id"), "_id", "left_anti").unionByName(rows)
