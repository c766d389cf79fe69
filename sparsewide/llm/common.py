"""What the training-data operators share: the shared folder, written tables, hashing helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a local one where there is but one machine and it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local"):
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete(spark, parent)


@contextmanager
def bucketed(df: DataFrame, key: str, tag: str, buckets: int | None = None) -> Iterator[DataFrame]:
    """df written once as a table bucketed by key (as many buckets as it has partitions, unless told), so that joins by the key don't move it; table and files go at the end."""
    spark = df.sparkSession
    name, path = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}", fresh_path(spark, tag)
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").option("path", path).bucketBy(buckets or max(1, df.rdd.getNumPartitions()), key).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside deletes its shuffle files as it ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
