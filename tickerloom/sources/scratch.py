"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local master gets a new local folder, as in tests; a
    cluster gets an error, as its machines share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_FOLDERS[app]


def scratch_table(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
