"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that is an error,
    because executors would write to folders that no one else can read.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(sc, "_palimp_dir", None)
        if not found:
            found = sc._palimp_dir = "file://" + tempfile.mkdtemp(prefix="palimp-")
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which clean() deletes."""
    path = f"{shared_dir(spark)}/palimp-{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if not hasattr(sc, "_palimp_paths"):
        sc._palimp_paths = []
    sc._palimp_paths.append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Deletes all intermediate tables, layouts and archives that this Spark context has made so far; returns their number. To be called when the results are saved: DataFrames that read them no longer work."""
    paths = getattr(spark.sparkContext, "_palimp_paths", [])
    for path in paths:
        drop_path(spark, path)
    n = len(paths)
    paths.clear()
    return n


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path in whatever store it lies."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Where the shared folder is a mounted one, Hadoop's checksumming file system starts a chmod process for each file and for its checksum; the raw one starts none. Other stores don't read these options.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: this cuts the lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.options(**PLAIN).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimp_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_palimp_path", None)
    if path:
        drop_path(df.sparkSession, path)
