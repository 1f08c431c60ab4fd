"""Legislative XML as flat tables: a row per element, or per amendment.

Files are read as a distributed binary scan; each document is parsed where its row is, by events (`pull`), and its rows leave in
Arrow batches of CHUNK rows that may hold many documents or a part of one. Nothing recurses and no tree is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date as Date

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .. import schema
from ..functions import text as fn
from ..staging import staged
from . import pull
from .pull import UslmError

CHUNK = 5_000
#: Characters of text after which a batch is full, whatever its rows.
CHUNK_TEXT = 1 << 23


def parse_date_text(text: str) -> Date:
    """Three integer parts that make a date."""
    parts = text.split("-")
    try:
        if len(parts) != 3 or not all(p.isascii() and p.isdigit() for p in parts):
            raise ValueError
        return Date(*map(int, parts))
    except ValueError:
        raise UslmError("invalid_date", text) from None


def elements_of(xml: str | bytes | None, date: str | None, max_depth: int = pull.MAX_DEPTH) -> Iterator[dict]:
    """The elements of a document, each when it ends; an error is raised before the first one."""
    if date is None:
        raise UslmError("invalid_date", "no date")
    when = parse_date_text(date)
    for row in pull.elements(xml, max_depth):
        row["snapshot_date"] = when
        yield row


def flatten(xml: str | bytes, date: str) -> list[dict]:
    """The elements of a small document in preorder."""
    return sorted(elements_of(xml, date), key=lambda r: r["ord_path"])


def _batches(rows: Iterable[dict], into: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of any number of documents in batches of CHUNK rows or about CHUNK_TEXT characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, str))
        if len(held) == CHUNK or size > CHUNK_TEXT:
            yield pa.RecordBatch.from_pylist(held, into)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, into)


def _error_row(e: Exception, names: list[str]) -> dict:
    own = e if isinstance(e, UslmError) else UslmError("internal", f"{type(e).__name__}: {e}")
    return dict.fromkeys(names) | {"error": {"code": own.code, "message": own.message}}


def _raw(value: pa.Scalar) -> memoryview | None:
    """The UTF-8 bytes of a string where they are."""
    return memoryview(value.as_buffer()) if value.is_valid else None


def _parse(permissive: bool, max_depth: int, into: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for source, xml, date in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                try:
                    for row in elements_of(_raw(xml), date, max_depth):
                        row["source"] = source
                        yield row
                except Exception as e:  # of this document alone; it has given no row yet
                    if not permissive:
                        raise
                    yield _error_row(e, into.names) | {"source": source}

    return lambda batches: _batches(rows(batches), into)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def parse_documents(documents: DataFrame, mode: str = "FAILFAST", max_depth: int = pull.MAX_DEPTH) -> DataFrame:
    """Elements of documents (source, xml, date). PERMISSIVE gives one row with `error` for a document that can't be parsed.

    A null xml or date, and elements nested more than max_depth deep, are such errors.
    """
    ddl = f"{schema.ELEMENTS}, source string, error {schema.ERROR}"
    rows = documents.select("source", "xml", F.col("date").cast("string").alias("date"))
    return rows.mapInArrow(_parse(mode.upper() == "PERMISSIVE", max_depth, _arrow(ddl)), ddl)


def read_files(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """source (path of the file) and xml of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("xml"))


def read_uslm(spark: SparkSession, path: str, date: str, mode: str = "FAILFAST") -> DataFrame:
    """Elements of a file, or of each file of a folder, kept apart by `source`."""
    parse_date_text(date)
    return parse_documents(read_files(spark, path).withColumn("date", F.lit(date)), mode)


def read_uslm_folder(spark: SparkSession, path: str, date: str, mode: str = "FAILFAST") -> DataFrame:
    """Elements of all files of a folder under one root: children of the files follow each other in the order of file names.

    The parsed rows are a staged table, since their order and `shadowed` take several looks at them.
    """
    from ..operators.tree import reshadowed

    rows = staged(read_uslm(spark, path, date, mode).where("error IS NULL"), "folder")
    first = Window.orderBy("source")
    order = rows.where("depth = 1").groupBy("source").agg(F.max("ordinal").alias("top")).select("source", F.coalesce(F.sum(F.col("top") + 1).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("shift"))
    moved = rows.where("depth > 0").join(order, "source").withColumn("ord_path", F.concat(F.array(F.get("ord_path", F.lit(0)) + F.col("shift")), F.slice("ord_path", 2, 1 << 20))).withColumn("ordinal", F.element_at("ord_path", -1)).drop("shift")
    root = rows.where("depth = 0").groupBy("path").agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), "source").alias("r")).select("r.*")
    return reshadowed(root.unionByName(moved).drop("source", "error"))


def _bills(permissive: bool, into: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for bill_id, xml in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = pull.instructions(_raw(xml))
                except Exception as e:
                    if not permissive:
                        raise
                    found = [_error_row(e, into.names)]
                for row in found:
                    row["bill_id"] = bill_id
                    yield row

    return lambda batches: _batches(rows(batches), into)


def parse_bill_amendments(bills: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Amendments of bills (bill_id, xml): one per text of a bill, the last where texts repeat.

    PERMISSIVE adds `error`, and gives one row with it for a bill that can't be parsed.
    """
    permissive = mode.upper() == "PERMISSIVE"
    ddl = f"bill_id string, action_types array<string>, amending_text string, ordinal int, error {schema.ERROR}"
    rows = bills.select("bill_id", "xml").mapInArrow(_bills(permissive, _arrow(ddl)), ddl)
    rows = rows.withColumn("amendment_id", fn.amendment_id(F.col("bill_id"), F.col("amending_text")))
    own = ["action_types", "amending_text", "ordinal", *(["error"] if permissive else [])]
    return rows.groupBy("bill_id", "amendment_id").agg(F.max_by(F.struct(*own), F.coalesce("ordinal", F.lit(-1))).alias("r")).select("bill_id", "amendment_id", "r.*")


def read_bill_amendments(spark: SparkSession, path: str, bill_id: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Amendments of bill files; without bill_id it comes from each file's name."""
    files = read_files(spark, path)
    named = F.regexp_replace(F.regexp_extract("source", r"([^/]*)\.xml$", 1), r"^bill_", "")
    own = F.lit(bill_id) if bill_id is not None else F.when(named.rlike(r"^\d+_"), F.replace(named, F.lit("_"), F.lit("-"))).otherwise(named)
    return parse_bill_amendments(files.select(own.alias("bill_id"), "xml"), mode)


def failures(rows: DataFrame) -> int:
    """How many documents of a PERMISSIVE result could not be parsed."""
    return rows.where("error IS NOT NULL").count()


#: Microseconds, too, so that what is written can be read again as it was.
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as lines of JSON; `by` splits into a folder per value (one per source document, say)."""
    out = df.write.mode("errorifexists").option("ignoreNullFields", "false").option("timestampFormat", _STAMP)
    (out.partitionBy(by) if by else out).json(path)


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Typed rows of lines of JSON; a line that isn't of the schema is an error."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").option("timestampFormat", _STAMP).json(path)


def uslm_to_json(spark: SparkSession, path: str, date: str, to: str) -> None:
    """A file, or each file of a folder, as lines of JSON: a folder per file, named by its stem.

    Files that can't be parsed are left out; after the others are written, their number is raised as an error.
    """
    seen = Observation()
    bad = F.count(F.when(F.col("error").isNotNull(), 1)).alias("failures")
    rows = read_uslm(spark, path, date, "PERMISSIVE").observe(seen, bad).where("error IS NULL")
    write_json(rows.withColumn("stem", F.regexp_extract("source", r"([^/]*)\.[^./]*$", 1)).drop("error"), to, by="stem")
    if n := seen.get["failures"]:
        raise UslmError("unable_to_parse_element", f"{n} files could not be parsed")
