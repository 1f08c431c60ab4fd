"""A dataset: tables under one folder, changed by commits.

Adding appends rows, keyed things (members, sponsors, statuses) are read as the last row of their key, and nothing is held on
the driver. What belongs together (a snapshot and its elements; amendments, sponsors and members of a download) is one commit
(`commits`): it is seen whole or not at all. Small commits are merged as they come.

Elements of a snapshot are a part of their own, in order of paths, with `top` (the path of depth 1 above a row, empty for the root)
and `tree_hash` (of all that a comparison looks at, from the row down). A difference first compares the hashes of the tops, and reads
texts of the parts that changed. With `buckets`, snapshots are stored in that many hash buckets of their paths: two of them are compared
without an exchange, and the history of an element reads one bucket of each. With `indexed`, each snapshot has an index of
the trigrams in its files (in the same commit), and a search reads the files that can hold a hit.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import annotations as notes
from ..operators import diff, match, textindex, tree, versions
from ..sources import congress, uslm
from ..staging import staged
from .commits import Commits

TABLES = {
    "metadata": "name string, description string, author string, seq long", "versions": schema.VERSIONS, "elements": f"{schema.ELEMENTS}, {diff.HASHES}, version string, seq long",
    "amendments": f"{schema.AMENDMENTS}, seq long", "bill_diffs": f"{schema.BILL_DIFFS}, generation long, seq long", "annotations": f"{schema.ANNOTATIONS}",
    "statuses": "annotation_id long, status string, seq long",
    "members": f"{schema.MEMBERS}, seq long", "sponsors": f"{schema.SPONSORS}, seq long",
}
#: Rows of a file of elements at most; what a search reads, it reads by files.
FILE_ROWS = 100_000


class VersionNotFound(ValueError):
    pass


class Dataset:
    def __init__(self, spark: SparkSession, path: str, name: str = "", description: str = "", author: str = "", buckets: int = 0, indexed: bool = False, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.buckets, self.indexed, self.file_rows = spark, path.rstrip("/"), buckets, indexed, file_rows
        if name:
            self._append("metadata", spark.createDataFrame([(name, description, author, self._seq())], TABLES["metadata"]))

    @staticmethod
    def _seq() -> int:
        return time.time_ns()

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, self.path)

    def table(self, name: str) -> DataFrame:
        return self.commits.read(name, TABLES[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        self._commit({name: rows})

    def _commit(self, rows: dict[str, DataFrame]) -> None:
        """Rows of one or more tables, in one step."""
        own = self.commits
        own.commit({name: [own.write(name, self._whole(name, df))] for name, df in rows.items()})
        for name in rows:
            if name != "elements":  # a part for each snapshot
                own.compact(name, TABLES[name])

    def _whole(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*self.spark.createDataFrame([], TABLES[name]).columns)

    # versions
    def add_version(self, date: str, elements: DataFrame, label: str | None = None) -> None:
        self.add_versions([(date, elements, label)])

    def add_versions(self, snapshots: list[tuple[str, DataFrame, str | None]], mark: tuple[str, int] | None = None) -> None:
        """Snapshots (date, elements, label) in one commit, in this order among those of one date."""
        commits, parts, grams, known = self.commits, [], [], []
        for date, elements, label in snapshots:
            own = self._seq()
            rows = self._whole("elements", diff.hashed(elements).withColumn("version", F.lit(date)).withColumn("seq", F.lit(own)))
            if self.buckets:
                parts.append(commits.write_buckets("elements", rows, "path", self.buckets, version=date, seq=own))
            else:
                parts.append(commits.write("elements", rows.repartitionByRange("path").sortWithinPartitions("path"), self.file_rows, version=date, seq=own))
            if self.indexed:
                stored = self.spark.read.schema(TABLES["elements"]).parquet(f"{self.path}/{parts[-1]['folder']}")
                grams.append(commits.write("grams", textindex.postings(stored), of=parts[-1]["folder"]))
            known.append((date, label, own))
        row = self.spark.createDataFrame(known, schema.VERSIONS)
        commits.commit({"elements": parts, "grams": grams, "versions": [commits.write("versions", row.coalesce(1))]}, mark=mark)
        commits.compact("versions", TABLES["versions"])

    def upsert(self, name: str, rows: DataFrame, mark: tuple[str, int] | None = None) -> None:
        """Rows of a keyed table (members, sponsors, statuses) with their own `seq`: of each key the highest is read, whenever it came."""
        if name not in ("members", "sponsors", "statuses"):
            raise ValueError(f"{name} has no key")
        commits = self.commits
        commits.commit({name: [commits.write(name, self._whole(name, rows))]}, mark=mark)
        commits.compact(name, TABLES[name])

    def add_uslm_xml(self, path: str, date: str, label: str | None = None) -> None:
        self.add_version(date, uslm.read_uslm(self.spark, path, date).drop("source", "error"), label)

    def add_uslm_folder(self, path: str, date: str, label: str | None = None) -> None:
        self.add_version(date, uslm.read_uslm_folder(self.spark, path, date), label)

    @property
    def versions(self) -> DataFrame:
        return self.table("versions").orderBy("snapshot_date", "seq")

    def elements(self, date: str) -> DataFrame:
        """Elements of the snapshot of a date, the one added first if there are several."""
        own = versions.by_date(self.table("versions"), date).first()
        if own is None:
            raise VersionNotFound(date)
        commits = self.commits
        parts = commits.latest()[1].get("elements", [])
        if whole := [p for p in parts if p.get("seq") == own.seq]:  # the part of this snapshot
            return commits.read_part(whole[0], TABLES["elements"]).drop("version", "seq")
        rows = commits.read("elements", TABLES["elements"], lambda part: "seq" not in part)
        return versions.elements_at(rows, self.spark.createDataFrame([own], schema.VERSIONS), date).drop("version", "seq")

    def all_elements(self) -> DataFrame:
        """Elements of all snapshots."""
        known = self.table("versions").select(F.col("snapshot_date").alias("version"), "seq")
        return self.table("elements").join(F.broadcast(known), ["version", "seq"], "left_semi").drop("version", "seq")  # a row for each snapshot

    def find_element(self, path: str) -> DataFrame:
        """The node in every snapshot that has it; of a snapshot in buckets, one bucket is read."""
        commits, found = self.commits, self.all_elements().where(F.col("path") == path)
        parts = commits.latest()[1].get("elements", [])
        if parts and all("buckets" in p for p in parts):
            found = reduce(DataFrame.unionByName, (commits.read_part(p, TABLES["elements"]).where(F.col("path") == path).drop("version", "seq") for p in parts))
        return tree.element_versions(found, path)

    def candidates(self, terms: list[str]) -> DataFrame:
        """Elements of all snapshots, without the files that can't hold a text with all terms."""
        commits, runs = self.commits, textindex.needed(self.spark, terms)
        tables = commits.latest()[1]
        of = {p["of"]: p for p in tables.get("grams", [])}
        if not runs or not of:
            return self.all_elements()
        folders = [f"{self.path}/{p['folder']}" for p in tables["elements"] if p["folder"] not in of]
        found = reduce(DataFrame.unionByName, (textindex.files_with(commits.read_part(p, textindex.POSTINGS), runs).select(F.lit(k).alias("of"), "file") for k, p in of.items()))
        folders += [f"{self.path}/{r['of']}/{r.file}" for r in found.collect()]  # names of files
        rows = self.spark.read.schema(TABLES["elements"]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES["elements"])
        known = self.table("versions").select(F.col("snapshot_date").alias("version"), "seq")
        return rows.join(F.broadcast(known), ["version", "seq"], "left_semi").drop("version", "seq")

    def search_text(self, query: str) -> DataFrame:
        return tree.search_text(self.candidates([query]), query)

    def containing_all(self, column: str, terms: list[str]) -> DataFrame:
        """Elements of all snapshots whose text has every term, in any case."""
        return tree.containing_all(self.candidates(terms), column, terms)

    def compute_diff(self, from_date: str, to_date: str, prune: str = "reference") -> diff.TreeDiff:
        return diff.compute_diff(self.elements(from_date), self.elements(to_date), prune)

    @staticmethod
    def pair_diff(spark: SparkSession, old: str, new: str, from_date: str, to_date: str, prune: str = "reference") -> diff.TreeDiff:
        """Difference of two files, without a dataset."""
        return diff.compute_diff(uslm.read_uslm(spark, old, from_date), uslm.read_uslm(spark, new, to_date), prune)

    # bills
    def add_bill(self, amendments: DataFrame) -> None:
        self._append("amendments", amendments.withColumn("seq", F.lit(self._seq())))

    def bill(self, bill_id: str) -> DataFrame:
        """Amendments of the bill as it was added first."""
        rows = self.table("amendments").where(F.col("bill_id") == bill_id)
        return rows.join(rows.agg(F.min("seq").alias("seq")), "seq", "left_semi").drop("seq")

    def amendment(self, amendment_id: str) -> DataFrame:
        return notes.amendment(self.table("amendments"), amendment_id).drop("seq")

    @property
    def bill_diffs(self) -> DataFrame:
        """Changes of amendments: of each, those since they were last replaced."""
        rows = self.table("bill_diffs")
        last = rows.groupBy("amendment_id").agg(F.max("generation").alias("generation"))
        return rows.join(last, ["amendment_id", "generation"], "left_semi").where("diff_ordinal IS NOT NULL")

    def add_bill_diff(self, amendment_id: str, added: list[str], removed: list[str]) -> bool:
        """Append a change to the first bill that has the amendment; False if none has it."""
        own = self.amendment(amendment_id).first()
        if own is None:
            return False
        last = self.table("bill_diffs").where(F.col("amendment_id") == amendment_id).orderBy(F.desc("generation"), F.desc_nulls_last("diff_ordinal")).first()
        at = (0, -1) if last is None else (last.generation, -1 if last.diff_ordinal is None else last.diff_ordinal)
        self._append("bill_diffs", self.spark.createDataFrame([(own.bill_id, amendment_id, at[1] + 1, added, removed, at[0], self._seq())], TABLES["bill_diffs"]))
        return True

    def replace_bill_diffs(self, amendment_id: str, changes: list[tuple[list[str], list[str]]]) -> bool:
        """Put these changes (added, removed) in the place of all that the amendment has; False if no bill has it."""
        own = self.amendment(amendment_id).first()
        if own is None:
            return False
        now = self._seq()
        rows = [(own.bill_id, amendment_id, k, added, removed, now, now) for k, (added, removed) in enumerate(changes)]
        self._append("bill_diffs", self.spark.createDataFrame(rows or [(own.bill_id, amendment_id, None, None, None, now, now)], TABLES["bill_diffs"]))
        return True

    def load_bill_downloads(self, downloads: DataFrame) -> None:
        """Amendments, sponsors and members of downloaded bills; members whose JSON can't be read are left out."""
        bills = uslm.parse_bill_amendments(downloads.select("bill_id", F.col("bill_xml").alias("xml")))
        people = congress.shred_members(downloads.select(F.explode(F.map_values("member_jsons")).alias("json")))
        found = {"amendments": bills, "sponsors": congress.shred_sponsors(downloads), "members": people}
        now = F.lit(self._seq())
        self._commit({name: rows.withColumn("seq", now) for name, rows in found.items()})

    def best_amendments(self, changes: diff.TreeDiff) -> DataFrame:
        return match.best_amendments(changes.field_changes, self.bill_diffs)

    def mentions(self, changes: diff.TreeDiff) -> DataFrame:
        return match.mentions(changes.nodes.select("path"), self.table("amendments"))

    # people
    def add_members(self, rows: DataFrame) -> None:
        self._append("members", rows.withColumn("seq", F.lit(self._seq())))

    def add_sponsors(self, rows: DataFrame) -> None:
        self._append("sponsors", rows.withColumn("seq", F.lit(self._seq())))

    @property
    def members(self) -> DataFrame:
        return notes.upserted(self.table("members"), ["bioguide_id"], "seq").drop("seq")

    @property
    def sponsors(self) -> DataFrame:
        return notes.upserted(self.table("sponsors"), ["bill_id"], "seq").drop("seq")

    def member(self, bioguide_id: str) -> DataFrame:
        """The member of an id, as added last; the id is a filter of the scan."""
        return notes.upserted(self.table("members").where(F.col("bioguide_id") == bioguide_id), ["bioguide_id"], "seq").drop("seq")

    def sponsor(self, bill_id: str) -> DataFrame:
        """Sponsor and cosponsors of a bill, as added last."""
        return notes.upserted(self.table("sponsors").where(F.col("bill_id") == bill_id), ["bill_id"], "seq").drop("seq")

    # annotations
    def annotate(self, from_date: str, to_date: str, operation: str, bill_id: str, amendment_id: str, paths: list[str], annotator: str, causative_text: str = "", confidence: float | None = None, notes_: str | None = None, reasoning: str | None = None) -> int:
        """A pending annotation, made now; its id."""
        low = schema.ACTION_ALIASES.get(operation.lower(), operation.lower())
        if low not in schema.ACTIONS:
            raise ValueError(f"unknown amending action: {operation}")
        own = self._seq()
        row = self.spark.range(1).select(
            F.lit(own).alias("annotation_id"), F.lit(from_date).alias("from_date"), F.lit(to_date).alias("to_date"), F.lit(low).alias("operation"), F.lit(bill_id).alias("bill_id"), F.lit(amendment_id).alias("amendment_id"),
            F.lit(causative_text).alias("causative_text"), F.array(*map(F.lit, paths)).cast("array<string>").alias("paths"), F.lit("Pending").alias("status"), F.lit(confidence).cast("float").alias("confidence"),
            F.lit(annotator).alias("annotator"), F.current_timestamp().alias("ts"), F.lit(notes_).cast("string").alias("notes"), F.lit(reasoning).cast("string").alias("reasoning"),
        )
        self._append("annotations", row)
        return own

    def add_annotations(self, rows: DataFrame) -> None:
        """Many annotations at once."""
        self._append("annotations", rows)

    def set_status(self, annotation_id: int, status: str) -> bool:
        """Store a new status; False if there is no such annotation."""
        if status not in schema.STATUSES:
            raise ValueError(f"unknown status: {status}")
        if self.table("annotations").where(F.col("annotation_id") == annotation_id).isEmpty():
            return False
        self._append("statuses", self.spark.createDataFrame([(annotation_id, status, self._seq())], TABLES["statuses"]))
        return True

    def set_statuses(self, updates: DataFrame) -> None:
        """Many updates (annotation_id, status) in one commit; unknown ids do nothing, other statuses are an error."""
        known = F.when(F.col("status").isin(*schema.STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))))
        self._append("statuses", updates.select("annotation_id", known.alias("status"), F.lit(self._seq()).alias("seq")))

    def all_annotations(self) -> DataFrame:
        return notes.with_updates(self.table("annotations"), self.table("statuses"))

    def annotations(self, from_date: str, to_date: str) -> DataFrame:
        return self.all_annotations().where((F.col("from_date") == from_date) & (F.col("to_date") == to_date))

    def unannotated_paths(self, from_date: str, to_date: str) -> DataFrame:
        with self.compute_diff(from_date, to_date) as changes:
            paths = notes.unannotated(changes.changed_nodes(), self.annotations(from_date, to_date)).select("path", "ord_path")
            return staged(paths, "unannotated").orderBy("ord_path").select("path")

    def sponsors_for_path(self, path: str) -> DataFrame:
        return notes.sponsors_for_path(self.all_annotations(), self.sponsors, self.members, path)

    def export_json(self, path: str) -> None:
        """Every table as lines of JSON."""
        for name in TABLES:
            uslm.write_json(self.table(name), f"{path}/{name}")

    @classmethod
    def load_json(cls, spark: SparkSession, json: str, path: str) -> Dataset:
        """A dataset from what `export_json` wrote, kept under a new path."""
        out = cls(spark, path)
        for name, ddl in TABLES.items():
            out._append(name, uslm.read_json(spark, f"{json}/{name}", ddl))
        return out
