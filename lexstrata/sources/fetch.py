"""Members and bills over a REST transport, fetched in tasks: a function on a table of ids, and two data sources.

    fetch.bills(ids, partial(http_transport, base, key))              # ids: a table with bill_id
    fetch.register(spark)
    spark.read.format("congress_bills").option("ids", "119-hr-1,119-hr-2").option("base", ...).option("key", ...).load()
    spark.read.format("congress_members").option("ids", "A000001").option("transport", "my_module:factory").load()

A table of ids is dealt by hash over as many tasks as the session shuffles to (or `partitions`); a data source plans one partition for every `perTask` ids. A task makes its own
transport by the factory, so nothing that is open travels. Rate limits and broken connections are tried again with growing pauses.
With PERMISSIVE an id that can't be had is a row with `error` (code and message); else it ends the job.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from .congress import CongressClient, CongressError, ResponseCache, bill_path, http_transport

Transport = Callable[[str], tuple[int, str]]

BILLS = f"{schema.DOWNLOADS}, error {schema.ERROR}"
MEMBERS = f"bioguide_id string, json string, error {schema.ERROR}"
RETRIES = 3
PAUSE = 1.0
PER_TASK = 16
#: A batch of answers ends with so many characters.
BATCH_CHARS = 1 << 20
AGAIN = ("rate_limited", "http")


def patient(client: CongressClient, retries: int = RETRIES, pause: float = PAUSE) -> Callable[[str], str]:
    """client.fetch that is tried again after failures which may pass."""

    def fetch(path: str) -> str:
        for k in range(retries + 1):
            try:
                return client.fetch(path)
            except CongressError as e:
                if e.kind not in AGAIN or k == retries:
                    raise
                time.sleep(pause * 2**k)
        raise AssertionError

    return fetch


def _parsed(text: str, *path: str) -> object:
    """What a JSON text has at a path; None where there is nothing."""
    try:
        at = json.loads(text)
    except ValueError as e:
        raise CongressError("parse", str(e)) from None
    for name in path:
        at = at.get(name) if isinstance(at, dict) else None
    return at


def _each(found: object) -> Iterator[dict]:
    yield from (x for x in (found if isinstance(found, list) else []) if isinstance(x, dict))


def markup_url(text_json: str) -> str | None:
    """The url of the first legislative markup of a public-law text."""
    for version in _each(_parsed(text_json, "textVersions")):
        if version.get("type") == "Public Law":
            for form in _each(version.get("formats")):
                if form.get("type") == "United States Legislative Markup" and form.get("url") is not None:
                    return form["url"]
    return None


def bill_row(fetch: Callable[[str], str], bill_id: str | None) -> dict:
    """One row of the download table. Members that can't be had are left out; votes stay null."""
    at = bill_path(bill_id)
    sponsors, cosponsors, texts = fetch(at), fetch(f"{at}/cosponsors"), fetch(f"{at}/text")
    url = markup_url(texts)
    if url is None:
        raise CongressError("not_found", f"public-law text of {bill_id}")
    first = next((x.get("bioguideId") for x in _each(_parsed(sponsors, "bill", "sponsors"))), None)
    members = {}
    for who in dict.fromkeys([first or "", *((c.get("bioguideId") or "") for c in _each(_parsed(cosponsors, "cosponsors")))]):
        try:
            members[who] = fetch(f"member/{who}")
        except CongressError:
            continue
    return {"bill_id": bill_id, "bill_xml": fetch(url), "sponsors_json": sponsors, "cosponsors_json": cosponsors, "member_jsons": members, "votes_json": None}


def member_row(fetch: Callable[[str], str], bioguide_id: str | None) -> dict:
    if not bioguide_id:
        raise CongressError("parse", "no member id")
    return {"bioguide_id": bioguide_id, "json": fetch(f"member/{bioguide_id}")}


def rows_of(kind: str, ids: list[str | None], fetch: Callable[[str], str], permissive: bool) -> Iterator[dict]:
    one, key = (bill_row, "bill_id") if kind == "bills" else (member_row, "bioguide_id")
    for own in ids:
        try:
            yield one(fetch, own) | {"error": None}
        except CongressError as e:
            if not permissive:
                raise
            yield {key: own, "error": {"code": e.kind, "message": str(e)}}


def _in_tasks(ids: DataFrame, kind: str, key: str, ddl: str, factory: Callable[[], Transport], mode: str, partitions: int | None, retries: int, pause: float, cache: str | None) -> DataFrame:
    into = to_arrow_schema(T._parse_datatype_string(ddl))
    permissive = mode.upper() == "PERMISSIVE"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = patient(CongressClient(factory(), ResponseCache(cache) if cache else None), retries, pause)
        for batch in batches:
            held: list[dict] = []
            size = 0
            for row in rows_of(kind, batch.column(0).to_pylist(), fetch, permissive):
                held.append({n: row.get(n) for n in into.names})
                size += sum(len(x) for x in row.values() if isinstance(x, str))
                if size >= BATCH_CHARS:  # answers may be large
                    yield pa.RecordBatch.from_pylist(held, into)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, into)

    # a number is given, as ids are small and answers are not: by the bytes of the ids, one task would fetch all. It
    # stands before `distinct`, which else brings an exchange of its own that makes this one superfluous
    n = partitions or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ids.select(F.col(key).cast("string").alias(key)).repartition(n, key).distinct().mapInArrow(run, ddl)


def bills(ids: DataFrame, factory: Callable[[], Transport], mode: str = "FAILFAST", partitions: int | None = None, retries: int = RETRIES, pause: float = PAUSE, cache: str | None = None) -> DataFrame:
    """The download row of each different bill_id of a table. `cache` is a folder that the tasks see; `partitions` bounds how many ask at once."""
    return _in_tasks(ids, "bills", "bill_id", BILLS, factory, mode, partitions, retries, pause, cache)


def members(ids: DataFrame, factory: Callable[[], Transport], mode: str = "FAILFAST", partitions: int | None = None, retries: int = RETRIES, pause: float = PAUSE, cache: str | None = None) -> DataFrame:
    """bioguide_id and json of each different member; `congress.shred_members` reads them."""
    return _in_tasks(ids, "members", "bioguide_id", MEMBERS, factory, mode, partitions, retries, pause, cache)


# data sources


class Ids(InputPartition):
    def __init__(self, ids: list[str]):
        super().__init__(ids)


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict[str, str], names: list[str]):
        self.kind, self.names = kind, names
        self.options = {k.lower(): v for k, v in options.items()}
        if not self.options.get("ids"):
            raise ValueError("option ids: names separated by commas")

    def partitions(self) -> list[InputPartition]:
        ids = list(dict.fromkeys(x.strip() for x in self.options["ids"].split(",") if x.strip()))
        step = int(self.options.get("pertask", PER_TASK))
        return [Ids(ids[k : k + step]) for k in range(0, len(ids), step)]

    def read(self, partition: Ids) -> Iterator[tuple]:
        own = self.options
        if "transport" in own:
            module, _, name = own["transport"].partition(":")
            factory = getattr(importlib.import_module(module), name)
        else:
            factory = partial(http_transport, own["base"], own["key"])
        cache = ResponseCache(own["cache"]) if "cache" in own else None
        fetch = patient(CongressClient(factory(), cache), int(own.get("retries", RETRIES)), float(own.get("pause", PAUSE)))
        for row in rows_of(self.kind, partition.value, fetch, own.get("mode", "FAILFAST").upper() == "PERMISSIVE"):
            error = row["error"]
            yield tuple((error and (error["code"], error["message"])) if n == "error" else row.get(n) for n in self.names)


class BillSource(DataSource):
    """Options: ids; base and key, or transport (module:factory); perTask, retries, pause, cache, mode."""

    @classmethod
    def name(cls) -> str:
        return "congress_bills"

    def schema(self) -> str:
        return BILLS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader("bills", self.options, schema.names)


class MemberSource(DataSource):
    """Options as those of BillSource."""

    @classmethod
    def name(cls) -> str:
        return "congress_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader("members", self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BillSource)
    spark.dataSource.register(MemberSource)
