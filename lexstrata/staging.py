"""Tables that a plan reads more than once: written to the folder that all executors see, and read back.

The folder is `spark.checkpoint.dir`; where the session names none, one is made in local mode only. Like checkpoints, staged
tables stay until that folder is cleared, or until they are handed to `unstage`.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="lexstrata-stage-")


def stage_dir(spark: SparkSession) -> str:
    place, own = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = _local_dir(own)
    return f"{place.rstrip('/')}/lexstrata-stage-{own}"


def new_stage(spark: SparkSession, name: str) -> str:
    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    path = new_stage(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
