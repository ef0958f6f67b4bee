"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may have one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="studyloom-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found


def keep(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder: reads take only the columns that they ask for, and no executor holds them."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Gives up the files of what keep gave."""
    context = df.sparkSession.sparkContext
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
