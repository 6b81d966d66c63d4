"""Small helpers of the operators: reading a table, writing an intermediate table to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrank.session import ensure_checkpoint_dir, ship_package

MASK = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder, named by a run id, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of this run that nothing reads any more, through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The asked columns under the operator's own names, whatever else the table has."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


FILTER_BUCKETS = 1 << 20


def narrowed(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key isn't in the one column of `wanted`, so that they needn't be shuffled.

    What is broadcast are the hash buckets of the wanted keys, FILTER_BUCKETS at most whatever the data;
    rows that share a bucket with a wanted key stay, so a join must follow.
    """
    def bucket(c: str):
        return F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BUCKETS))

    buckets = wanted.select(bucket(wanted.columns[0]).alias("_bucket")).distinct()
    return rows.join(F.broadcast(buckets), bucket(key) == F.col("_bucket"), "left_semi")
