"""Annotations, sponsors and members as joins and grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import STATUSES
from ..staging import staged


def exploded(annotations: DataFrame) -> DataFrame:
    return annotations.select("*", F.explode("paths").alias("path"))


def for_path(annotations: DataFrame, path: str) -> DataFrame:
    return annotations.where(F.array_contains("paths", path))


def for_bill(annotations: DataFrame, bill_id: str) -> DataFrame:
    return annotations.where(F.col("bill_id") == bill_id)


def annotated_paths(annotations: DataFrame) -> DataFrame:
    return annotations.select(F.explode("paths").alias("path")).distinct()


def unannotated(changed: DataFrame, annotations: DataFrame) -> DataFrame:
    """Changed paths without an annotation."""
    return changed.join(annotated_paths(annotations), "path", "left_anti")


def by_status(annotations: DataFrame, status: str) -> DataFrame:
    return annotations.where(F.coalesce("status", F.lit("Pending")) == status)


def status_counts(annotations: DataFrame) -> DataFrame:
    """A row per status, zeros too; other names aren't counted."""
    domain = annotations.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = annotations.groupBy(F.coalesce("status", F.lit("Pending")).alias("status")).agg(F.count("*").alias("n"))
    return domain.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def count_by_amendment(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("amendment_id").agg(F.count("*").alias("n"))


def count_by_path(annotations: DataFrame) -> DataFrame:
    return exploded(annotations).groupBy("path").agg(F.count("*").alias("n"))


def sponsors_for_path(annotations: DataFrame, sponsors: DataFrame, members: DataFrame, path: str | None = None) -> DataFrame:
    """(path, member columns): sponsor and cosponsors of each bill that an annotation of the path names, once per annotation.
    Unknown members are dropped. Without a path, all of them."""
    if path is None:
        return with_sponsors(annotations, sponsors, members).select("path", F.explode("people").alias("p")).select("path", "p.*")
    rows = exploded(annotations).select("path", "bill_id").where(F.col("path") == path)
    return rows.join(_people(sponsors), "bill_id").join(members, "bioguide_id").select("path", *members.columns)


def _people(sponsors: DataFrame) -> DataFrame:
    who = F.explode(F.concat(F.array("sponsor"), F.transform("cosponsors", lambda c: c["bioguide_id"])))
    return sponsors.select("bill_id", who.alias("bioguide_id"))


def with_sponsors(annotations: DataFrame, sponsors: DataFrame, members: DataFrame) -> DataFrame:
    """(path, people): a row for each path of an annotation, with the known members of its bill as an array, if there are any.

    Members are looked up once for each bill, not once for each annotation, and stay together in what is shuffled.
    """
    known = _people(sponsors).join(members, "bioguide_id").groupBy("bill_id").agg(F.collect_list(F.struct(*members.columns)).alias("people"))
    return exploded(annotations).select("path", "bill_id").join(known, "bill_id").select("path", "people")


def with_updates(annotations: DataFrame, updates: DataFrame) -> DataFrame:
    """Annotations with the status of their last update (annotation_id, status, seq), where they have any."""
    last = upserted(updates, ["annotation_id"], "seq").select("annotation_id", F.col("status").alias("_status"))
    return annotations.join(last, "annotation_id", "left").withColumn("status", F.coalesce("_status", "status")).select(*annotations.columns)


def with_texts(annotations: DataFrame, amendments: DataFrame) -> DataFrame:
    """Annotations with the text of their amendment, null where there is none."""
    texts = amendments.groupBy("amendment_id").agg(F.first("amending_text").alias("amending_text"))  # its id is a hash of it
    return annotations.join(texts, "amendment_id", "left")


def with_changes(annotations: DataFrame, changed: DataFrame) -> DataFrame:
    """A row per annotation and path, with what is known of the changed node (null columns where it isn't one)."""
    return exploded(annotations).join(changed, "path", "left")


def amendment(amendments: DataFrame, amendment_id: str) -> DataFrame:
    """The amendment of an id, as it was added first."""
    return amendments.where(F.col("amendment_id") == amendment_id).orderBy("seq").limit(1)


def replaced(bill_diffs: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes of bills, those of the amendments in `changes` replaced by the ones there."""
    return bill_diffs.join(changes.select("amendment_id").distinct(), "amendment_id", "left_anti").unionByName(changes)


def upserted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def owning_bill(ids: DataFrame, amendments: DataFrame) -> DataFrame:
    """The first bill that has each amendment, else unknown; amendments carry `seq`, the order in which bills were added."""
    first = amendments.groupBy("amendment_id").agg(F.min_by("bill_id", F.struct("seq", "bill_id")).alias("bill_id"))
    return ids.join(first, "amendment_id", "left").withColumn("bill_id", F.coalesce("bill_id", F.lit("unknown")))


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rank (from 1) of each row in an order, without all rows in one task; among equals, as they come.

    Rows are sorted by ranges; a row's rank is its place in its range and the sizes of the ranges before, of which there is one for
    each partition. The sorted rows are a staged table with their places in it, so a range that must be read or sorted again can't
    give other places.
    """
    placed = staged(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return out.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, "rank")


def node_order(nodes: DataFrame, scores: DataFrame, mentioned: DataFrame) -> DataFrame:
    """rank of each node for an amendment: best score, then mentioned, then document order (`ord`)."""
    rows = nodes.join(scores.select("path", "score"), "path", "left").join(mentioned.select("path").distinct().withColumn("mentioned", F.lit(True)), "path", "left")
    rows = rows.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("mentioned", F.coalesce("mentioned", F.lit(False)))
    return ranked(rows, F.desc("score"), F.desc("mentioned"), "ord")


def amendment_order(amendments: DataFrame, scores: DataFrame, mentioned: DataFrame) -> DataFrame:
    """weight of each amendment for a node: 2 for a mention, 1 for a score; rank by it, then document order (`ord`)."""
    flag = lambda df, name: df.select("amendment_id").distinct().withColumn(name, F.lit(1))
    rows = amendments.join(flag(scores, "s"), "amendment_id", "left").join(flag(mentioned, "m"), "amendment_id", "left")
    rows = rows.withColumn("weight", 2 * F.coalesce("m", F.lit(0)) + F.coalesce("s", F.lit(0))).drop("s", "m")
    return ranked(rows, F.desc("weight"), "ord")


#: Letters with their accents as a second difference, and small letters before capitals as a third one.
LOCALE_COLLATION = "UNICODE"


def by_first_path(annotations: DataFrame, collation: str = LOCALE_COLLATION) -> DataFrame:
    """In order of the first path, as the collation compares (a locale's name, or UTF8_BINARY for bytes); no path comes first."""
    return annotations.orderBy(F.collate(F.coalesce(F.get("paths", F.lit(0)), F.lit("")), collation))


def first_path_ranks(annotations: DataFrame, collation: str = LOCALE_COLLATION) -> DataFrame:
    """annotations with their rank in that order; among equals by annotation_id."""
    rows = annotations.withColumn("_first", F.collate(F.coalesce(F.get("paths", F.lit(0)), F.lit("")), collation))
    return ranked(rows, "_first", "annotation_id").drop("_first")
