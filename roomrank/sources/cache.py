"""Read-through cache of prepared tables (A3) and the CSV sink (A4).

A prepared table is written once as parquet under ``roomrank.cache.dir`` (else the shared folder), in a
path that carries a digest of its parameters and of its input files (names, sizes, times), so later
sessions hit it and new input files miss it (the reference's pickle caches ignore both). Later reads are plain parquet scans with pushdown and pruning; the write
also cuts the lineage of a long plan, and the files outlive any executor.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from roomrank.session import shared_dir

CACHE_VERSION = "2"


def digest(params: dict) -> str:
    blob = json.dumps({"v": CACHE_VERSION, **params}, sort_keys=True, default=str)
    return hashlib.sha1(blob.encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def input_digest(spark: SparkSession, folder: str) -> str:
    """Digest of the names, sizes and modification times of all files below a folder, as Hadoop lists them."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    it = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    seen = []
    while it.hasNext():
        f = it.next()
        seen.append([f.getPath().toUri().getPath(), f.getLen(), f.getModificationTime()])
    return digest({"files": sorted(seen)})


def run_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def cache_path(spark: SparkSession, name: str, params: dict) -> str:
    return shared_dir(spark, f"cache/{name}-{digest(params)}")


def entry_path(spark: SparkSession, name: str, params: dict) -> str | None:
    """Folder of the published table ``name`` for ``params``; None if there is none."""
    entry = cache_path(spark, name, params)
    if not _exists(spark, entry + "/current"):
        return None
    lines = spark.read.text(entry + "/current").collect()  # one line: the name of the attempt that was published
    return f"{entry}/{lines[0][0]}"


def _publish(spark: SparkSession, entry: str, attempt: str) -> None:
    """Make ``attempt`` the entry's current table, by renaming a pointer folder that is already complete; if another
    application published first, its table stays."""
    jvm = spark.sparkContext._jvm
    pointer = f"{entry}/pointer-{attempt}"
    spark.createDataFrame([(attempt,)], "attempt string").coalesce(1).write.text(pointer)
    src, dst = jvm.org.apache.hadoop.fs.Path(pointer), jvm.org.apache.hadoop.fs.Path(entry + "/current")
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(dst):
        fs.rename(src, dst)  # should both come here, a second pointer ends up inside the first and is never read


def read_through(spark: SparkSession, name: str, params: dict, build) -> DataFrame:
    """Return the cached table ``name`` for ``params``; build and publish it when absent.

    Every build writes a folder of its own, which becomes the entry only when it is complete: a reader or a second
    builder sees a whole table or none, and what a killed build leaves behind is never read.
    """
    path = entry_path(spark, name, params)
    if path is None:
        attempt = f"attempt-{uuid.uuid4().hex[:12]}"
        entry = cache_path(spark, name, params)
        build().write.parquet(f"{entry}/{attempt}")
        _publish(spark, entry, attempt)
        path = entry_path(spark, name, params)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with a header line (A4); one directory of part files, as Spark writes."""
    (df.write.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read what ``write_csv`` wrote; rows are lines (columns of texts with line ends: ``tables.escape_lines``)."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("escape", '"').csv(path))
