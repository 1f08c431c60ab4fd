"""Streams into elements and into datasets (an extension; nothing in the tables depends on it).

What goes into a dataset is committed batch by batch, with the batch's number in the same commit: a batch that is run again after a
failure changes nothing, and a stream that was stopped and started again leaves the rows that one batch over all input
gives. Keyed rows carry their own order (`seq`), so late ones lose to those that came before them; late snapshots take their place by
date, since versions are ordered when they are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import Dataset
from ..sources.uslm import parse_documents
from ..staging import staged, unstage

FILES = "path string, modificationTime timestamp, length long, content binary"


def documents(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """source, xml and date of the files of folder/<date>/*.xml; the date is the name of the file's folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("xml"), F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("date"))


def element_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Elements of the files of folder/<date>/*.xml, permissive."""
    return parse_documents(documents(spark, folder, files_per_trigger), "PERMISSIVE")


def ingest(spark: SparkSession, folder: str, elements: str, checkpoint: str) -> StreamingQuery:
    """Append to the Parquet table, exactly once, until what is there is done."""
    return element_stream(spark, folder).writeStream.format("parquet").option("path", elements).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _started(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_snapshots(dataset: Dataset, folder: str, checkpoint: str, source: str = "snapshots", files_per_trigger: int = 64) -> StreamingQuery:
    """Every file of folder/<date>/*.xml as a snapshot of its date, in order of names within a batch, whenever it comes.

    A batch has at most files_per_trigger snapshots, which are one commit. Files that can't be parsed give none.
    """

    def batch(files: DataFrame, number: int) -> None:
        if dataset.commits.marks().get(source, -1) >= number:
            return
        rows = staged(parse_documents(files, "PERMISSIVE").where("error IS NULL").withColumn("_date", F.regexp_extract("source", r"/([^/]+)/[^/]+$", 1)), "snapshots")
        found = rows.select("source", "_date").distinct().orderBy("_date", "source").collect()  # of this batch's files
        if found:
            dataset.add_versions([(r["_date"], rows.where(F.col("source") == r.source).drop("source", "error", "_date"), r.source.rpartition("/")[2]) for r in found], mark=(source, number))
        unstage(rows)

    return _started(documents(dataset.spark, folder, files_per_trigger), batch, checkpoint)


def ingest_upserts(dataset: Dataset, table: str, rows: DataFrame, checkpoint: str, source: str) -> StreamingQuery:
    """A stream of rows of a keyed table (members, sponsors, statuses), each with the number `seq` by which the last one wins."""
    return _started(rows, lambda batch, number: dataset.upsert(table, batch, mark=(source, number)), checkpoint)
