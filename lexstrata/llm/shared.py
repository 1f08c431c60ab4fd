"""What the operators share: the shared folder, written tables, row structs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_ROWS = 1000
#: Spark's own setting: shuffle files go when the execution that made them has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _local_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="lexstrata-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. A local one is made only where the session names none and runs in one process (tests)."""
    place, own = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = _local_dir(own)
    return f"{place.rstrip('/')}/lexstrata-{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_CLEAN, None)
    try:
        conf.set(_CLEAN, "true")  # nothing reads these shuffles again: the table is what stays
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEAN, before) if before else conf.unset(_CLEAN)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    return _write(df, new_path(df.sparkSession, name))


class Scratch:
    """The intermediate tables of one call of an operator. They go with the call; `written` (above) makes tables that stay."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        out = _write(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            _, path = self.paths.pop(id(t))
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    tmp = Scratch(spark)
    try:
        yield tmp
    finally:
        tmp.drop(*(t for t, _ in list(tmp.paths.values())))


#: Cells of 64 bits that are broadcast at most (64 MB); beyond, `marked` marks all rows.
MOST_CELLS = 1 << 22


def marked(tmp: Scratch, rows: DataFrame, h: str, hashes: DataFrame) -> DataFrame:
    """rows with `may`: whether the long h may be among some hashes (column h); always if it is, seldom if not.

    The bitmap has 32 to 64 bits for each hash, and is broadcast, as a part of the plan that reads `may`; no rows are shuffled.
    """
    cells = 1 << max(6, hashes.count().bit_length())
    if cells > MOST_CELLS:
        return rows.withColumn("may", F.lit(True))
    at = F.pmod(F.col("h"), F.lit(cells * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    bits = hashes.select((at / 64).cast("long").alias("_cell"), bit.alias("_bit")).groupBy("_cell").agg(F.bit_or("_bit").alias("_bits"))
    at = F.pmod(F.col(h), F.lit(cells * 64))
    rows = rows.withColumn("_cell", (at / 64).cast("long")).join(F.broadcast(bits), "_cell", "left")
    return rows.withColumn("may", F.coalesce(F.call_function("shiftrightunsigned", F.col("_bits"), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop("_cell", "_bits")


def text_batches(df: DataFrame) -> DataFrame:
    """Texts are long: Arrow batches hold TEXT_ROWS rows where the session has the default of 10,000. Returns df."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(TEXT_ROWS))
    return df


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct `r`, so that added columns can't clash with the caller's names."""
    return text_batches(df).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))
