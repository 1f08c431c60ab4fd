"""Operator 1: best-fit packing after Martello-Toth dominance reduction.

Only the length of a piece matters to the packing, and a length is one of `capacity` values. So the plan is made from the
number of pieces of each length (at most `capacity` numbers, whatever the corpus size): first sets of one, two or three
pieces that provably dominate all other fillings of a sequence with their largest piece are fixed, again and again,
then best fit (longest first) places what is left. The plan has slots (length, first rank, number of sequences, first
sequence, offset); Spark ranks the pieces of each length and each finds its slot by its rank.

Ranks: pieces of one length are dealt into salted groups, ranked there, and shifted by the sizes of the groups before, so a
length that a third of all pieces share is no single task.

Defined results: a null or empty text is one piece with the end id only; repeated rows are packed once each; a null doc_id
is kept; an empty table gives no pieces; extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared
from .encode import encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end: int, capacity: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in rows:
            out: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), own.all_ids(batch.column(1).to_pylist(), end), strict=True):
                ids = memoryview(raw)
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                out += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(edges, edges[1:]))]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The ids of each text and the end id, cut into pieces of `capacity`; the first piece takes what remains."""
    return shared.text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(path, end, capacity), PIECES)


class Plan:
    def __init__(self, counts: np.ndarray):
        """counts[n] pieces of length n, for n up to the capacity."""
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.capacity = len(counts) - 1
        self.fillings: list[tuple[tuple[int, ...], int]] = []
        self.reduce()
        self.fixed = len(self.fillings)
        self.reduced = self.sequences
        self.best_fit()

    def fix(self, sizes: tuple[int, ...]) -> None:
        """As many sequences of these sizes as there are pieces for."""
        times = min(int(self.left[s]) // sizes.count(s) for s in sizes)
        for s in sizes:
            self.left[s] -= times
        self.fillings.append((sizes, times))

    def dominating(self, j: int) -> tuple[int, ...] | None:
        """A filling with a piece of length j that dominates every other one with it; None if none is proved."""
        room = self.capacity - j
        have = self.left[: room + 1].copy()
        if j <= room:
            have[j] -= 1
        fit = np.flatnonzero(have > 0)
        if not len(fit):
            return (j,)
        k = int(fit[-1])
        low = np.repeat(fit[:3], np.minimum(have[fit[:3]], 3))[:3].tolist()
        if k == room or len(low) < 2 or low[0] + low[1] > room:
            return (j, k)  # an exact fit, or no two pieces fit beside j: the largest single one dominates
        if len(low) == 3 and sum(low) <= room:
            return None
        partner = np.searchsorted(fit, room - fit, side="right") - 1  # the largest that fits beside each
        alone = (partner >= 0) & (fit[np.maximum(partner, 0)] == fit) & (have[fit] < 2)
        partner = np.where(alone, partner - 1, partner)
        sums = np.where(partner >= 0, fit + fit[np.maximum(partner, 0)], 0)
        best = int(sums.max())
        if k >= best:
            return (j, k)  # at most two fit, and one piece is as large as any two
        i = int(sums.argmax())
        a, b = sorted((int(fit[i]), int(fit[partner[i]])), reverse=True)
        other = np.flatnonzero(sums > 0)
        larger, smaller = np.maximum(fit[other], fit[partner[other]]), np.minimum(fit[other], fit[partner[other]])
        if best == room and a >= k or (a >= max(k, int(larger.max())) and b >= int(smaller.max())):
            if a >= max(k, int(larger.max())) and b >= int(smaller.max()):
                return (j, a, b)
        return None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in range(self.capacity, 0, -1):
                while self.left[j] and (sizes := self.dominating(j)):
                    self.fix(sizes)
                    changed = True

    def best_fit(self) -> None:
        open_: list[list[list]] = [[] for _ in range(self.capacity + 1)]  # by room: [sizes, sequences]
        for s in range(self.capacity, 0, -1):
            n = int(self.left[s])
            while n:
                room = next((r for r in range(s, self.capacity + 1) if open_[r]), None)
                sizes, times = open_[room].pop() if room is not None else ((), n)
                room = self.capacity if room is None else room
                each = min(room // s, n)
                used = min(times, n // each)
                if sizes and used < times:
                    open_[room].append([sizes, times - used])
                open_[room - each * s].append([sizes + (s,) * each, used])
                n -= used * each
        self.fillings += [(sizes, times) for groups in open_ for sizes, times in groups]

    def slots(self) -> np.ndarray:
        """Sorted rows: length, first rank, sequences, first sequence, offset."""
        rank, sequence, out = [0] * (self.capacity + 1), 0, []
        for sizes, times in self.fillings:
            at = 0
            for s in sizes:
                out.append((s, rank[s], times, sequence, at))
                rank[s] += times
                at += s
            sequence += times
        return np.array(sorted(out), np.int64).reshape(-1, 5)

    @property
    def sequences(self) -> int:
        return sum(m for _, m in self.fillings)


def _place(slots: np.ndarray):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots[:, 0] * (1 << 48) + slots[:, 1]
        for batch in rows:
            n = len(batch.schema.names)
            length, rank = (batch.column(k).to_numpy() for k in (3, n - 1))
            i = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(slots[i, 3] + rank - slots[i, 1]), pa.array(slots[i, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = shared.written(pieces(docs, path, end, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")), "pieces")
    groups = shared.written(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("own", own).join(shift, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") - 1 + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(Plan(counts).slots()), PIECES + ", sequence_id long, offset long")
