"""Members, sponsors and bill texts from JSON: built-in parsing of string columns, and a small client for the files.

The shredders are expressions, so a table of a million downloads is one scan. The client is plain Python, on the
driver or in the tasks of `fetch`; its transport is a parameter, so tests and offline folders need no network.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as fn

MEMBER = "member struct<bioguideId: string, firstName: string, lastName: string, directOrderName: string, partyHistory: array<struct<partyAbbreviation: string>>, terms: array<struct<chamber: string, congress: int, stateCode: string, district: int, startYear: int, endYear: int>>>"
BILL = "bill struct<sponsors: array<struct<bioguideId: string>>>"
COSPONSORS = "cosponsors array<struct<bioguideId: string, sponsorshipDate: string, sponsorshipWithdrawnDate: string>>"
TEXTS = "textVersions array<struct<type: string, date: string, formats: array<struct<type: string, url: string>>>>"


class CongressError(RuntimeError):
    """kind: rate_limited, unauthorized, not_found, http or parse."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind} {message}".strip())
        self.kind = kind


def shred_members(rows: DataFrame, column: str = "json", mode: str = "PERMISSIVE") -> DataFrame:
    """Members of JSON strings. Rows without bioguideId are dropped, or an error with FAILFAST."""
    m = F.from_json(column, MEMBER)["member"]
    text = lambda c: F.coalesce(c, F.lit(""))
    terms = F.transform(
        F.coalesce(F.col("m.terms"), F.array().cast("array<struct<chamber: string, congress: int, stateCode: string, district: int, startYear: int, endYear: int>>")),
        lambda t: F.struct(
            F.coalesce(t["congress"], F.lit(0)).alias("congress"), F.coalesce(fn.chamber(t["chamber"]), F.lit("House")).alias("chamber"), text(t["stateCode"]).alias("state"),
            t["district"].alias("district"), F.coalesce(t["startYear"], F.lit(0)).alias("start_year"), t["endYear"].alias("end_year"),
        ),
    )
    last = F.try_element_at("terms", F.lit(-1))
    rows = rows.select(m.alias("m")).withColumn("terms", terms)
    if mode.upper() == "FAILFAST":
        rows = rows.withColumn("m", F.when(F.col("m.bioguideId").isNotNull(), F.col("m")).otherwise(F.raise_error(F.lit("missing bioguideId"))))
    return rows.where("m.bioguideId IS NOT NULL").select(
        F.col("m.bioguideId").alias("bioguide_id"), F.coalesce("m.directOrderName", F.concat(text(F.col("m.firstName")), F.lit(" "), text(F.col("m.lastName")))).alias("name"),
        text(F.col("m.firstName")).alias("first_name"), text(F.col("m.lastName")).alias("last_name"), F.coalesce(fn.party(F.get("m.partyHistory", F.lit(0))["partyAbbreviation"]), F.lit("Unknown")).alias("party"),
        text(last["state"]).alias("state"), last["district"].alias("district"), F.coalesce(last["chamber"], F.lit("House")).alias("chamber"), "terms",
    )


def shred_sponsors(rows: DataFrame) -> DataFrame:
    """Sponsor and cosponsors of rows (bill_id, sponsors_json, cosponsors_json)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    found = F.coalesce(F.from_json("cosponsors_json", COSPONSORS)["cosponsors"], F.array().cast("array<struct<bioguideId: string, sponsorshipDate: string, sponsorshipWithdrawnDate: string>>"))
    each = F.transform(found, lambda c: F.struct(text(c["bioguideId"]).alias("bioguide_id"), text(c["sponsorshipDate"]).alias("date"), c["sponsorshipWithdrawnDate"].isNotNull().alias("withdrawn")))
    first = F.get(F.from_json("sponsors_json", BILL)["bill"]["sponsors"], F.lit(0))["bioguideId"]
    return rows.select("bill_id", text(first).alias("sponsor"), each.alias("cosponsors"))


def law_text_urls(rows: DataFrame) -> DataFrame:
    """bill_id and the url of the first legislative markup of a public-law text; rows (bill_id, text_json)."""
    versions = rows.select("bill_id", F.posexplode(F.from_json("text_json", TEXTS)["textVersions"]).alias("v", "version")).where("version.type = 'Public Law'")
    formats = versions.select("bill_id", "v", F.posexplode("version.formats").alias("f", "format")).where("format.type = 'United States Legislative Markup'")
    return formats.groupBy("bill_id").agg(F.min_by("format.url", F.struct("v", "f")).alias("url"))


def bill_id_parts(bill_id: Column) -> Column:
    """congress, type, number of congress-type-number; null if it isn't that."""
    p = F.split(bill_id, "-")
    congress, number = F.try_element_at(p, F.lit(1)).try_cast("int"), F.try_element_at(p, F.lit(3)).try_cast("long")
    return F.when((F.size(p) == 3) & congress.isNotNull() & number.isNotNull(), F.struct(congress.alias("congress"), F.get(p, F.lit(1)).alias("type"), number.alias("number")))


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """source and json of every file."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source"), F.col("value").alias("json"))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


class ResponseCache:
    """Files with a time to live."""

    def __init__(self, folder: str | Path, ttl: float = 24 * 3600):
        self.folder, self.ttl = Path(folder), ttl

    def _path(self, key: str) -> Path:
        return self.folder / re.sub(r"[/\\]", "_", key)

    def get(self, key: str) -> str | None:
        path = self._path(key)
        if not path.exists():
            return None
        if time.time() - path.stat().st_mtime > self.ttl:
            path.unlink()
            return None
        return path.read_text()

    def set(self, key: str, value: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self._path(key).write_text(value)

    def clear(self) -> None:
        for path in self.folder.glob("*"):
            path.unlink()


def http_transport(base: str, key: str, timeout: float = 30) -> Callable[[str], tuple[int, str]]:
    """A transport over HTTP: paths are taken below `base`, full urls as they are; the key goes with requests to `base` only."""

    def get(path: str) -> tuple[int, str]:
        whole = "://" in path
        request = urllib.request.Request(path if whole else f"{base.rstrip('/')}/{path}", headers={} if whole else {"X-Api-Key": key})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status, answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            return e.code, ""
        except OSError as e:
            raise CongressError("http", str(e)) from None

    return get


def bill_path(bill_id: str | None) -> str:
    """The place of congress-type-number."""
    parts = (bill_id or "").split("-")
    if len(parts) != 3 or not (parts[0].isdigit() and parts[2].isdigit()):
        raise CongressError("parse", f"bill id {bill_id}")
    return "bill/" + "/".join(parts)


class CongressClient:
    """transport(path) -> (status, body). Answers are cached; a status is mapped to CongressError."""

    def __init__(self, transport: Callable[[str], tuple[int, str]], cache: ResponseCache | None = None):
        self.transport, self.cache = transport, cache

    def fetch(self, path: str) -> str:
        if self.cache and (kept := self.cache.get(path)) is not None:
            return kept
        status, body = self.transport(path)
        kinds = {429: "rate_limited", 401: "unauthorized", 403: "unauthorized", 404: "not_found"}
        if status != 200:
            raise CongressError(kinds.get(status, "http"), f"{status} {path}")
        if self.cache:
            self.cache.set(path, body)
        return body

    def member(self, spark: SparkSession, bioguide_id: str) -> DataFrame:
        return shred_members(spark.createDataFrame([(self.fetch(f"member/{bioguide_id}"),)], "json string"), mode="FAILFAST")

    def bill_sponsors(self, spark: SparkSession, bill_id: str) -> DataFrame:
        at = self._bill(bill_id)
        return shred_sponsors(spark.createDataFrame([(bill_id, self.fetch(at), self.fetch(f"{at}/cosponsors"))], "bill_id string, sponsors_json string, cosponsors_json string"))

    def download_bill(self, spark: SparkSession, bill_id: str) -> DataFrame:
        """One row of the download table; `fetch.bills` fetches many, in tasks."""
        from .fetch import bill_row

        row = bill_row(self.fetch, bill_id)
        return spark.createDataFrame([tuple(row.values())], schema.DOWNLOADS)

    @staticmethod
    def _bill(bill_id: str) -> str:
        return bill_path(bill_id)
