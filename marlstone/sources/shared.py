"""The folder that driver and executors share, and tables kept there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where that is unset, a temporary folder. On a cluster without it this raises."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint()


def new_place(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes when the application ends."""
    path = f"{use_shared_folder(spark)}/marlstone-{uuid.uuid4().hex}"
    place, files = _on_store(spark, path)
    files.deleteOnExit(place)
    return path


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file from the driver, in any store that Spark reaches."""
    place, files = _on_store(spark, path)
    out = files.create(place, False)
    out.write(bytearray(data))
    out.close()


def written(df: DataFrame) -> DataFrame:
    """Written to the shared folder once and read from there: for plans that must not run twice."""
    path = new_place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _on_store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
