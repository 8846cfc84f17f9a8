"""Tables in the shared folder that carry results from one step to the next."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that must outlive an executor, named by ``spark.checkpoint.dir``.

    Only a single-machine session may leave it unset; it then gets one temporary
    folder per process.  A cluster without a shared folder is an error, since its
    executors would write to disks that nobody else sees.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="parapet-")
    return _local_folder


def new_path(spark: SparkSession, name: str = "step") -> str:
    return f"{shared_folder(spark)}/parapet-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step", codec: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder, with its lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames_or_paths: DataFrame | str) -> None:
    """Delete written steps that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for item in frames_or_paths:
        paths = [item] if isinstance(item, str) else {f.rsplit("/", 1)[0] for f in item.inputFiles()}
        for p in paths:
            if "/parapet-" in p:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)
