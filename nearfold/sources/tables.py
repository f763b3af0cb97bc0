"""Intermediate tables on storage that all executors share, which cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that is unset, a folder of our own in a session
    without other machines; RuntimeError in any other session, whose executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="nearfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The path of a new folder below the shared one."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


#: Where the tables of this driver's ``materialize`` lie, by the id of their frame.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(back)] = back, path
    return back


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        spark, (_, path) = table.sparkSession, _PATHS.pop(id(table))
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
