"""Operator 4: token-id output, compressed by a Re-Pair grammar per shard.

Documents are dealt by ranges of doc_id and sorted, so the files hold them in ascending order. Each task cuts its
documents into shards of about `shard_ids` ids (whole documents). In a shard, frequent pairs of neighbouring symbols are
replaced by new symbols, until no pair (not across documents) occurs LEAST times: each round counts all pairs of the shard and
replaces up to `per_round` of the most frequent, runs of overlapping pairs from the left; a later round's rules may hold symbols
of earlier ones. Pairs are counted in hash slots, of which one pair each is replaced; once the frequent slots hold few places,
their pairs are counted by sorting, so that none is left behind.

File format: Parquet, a row per shard:
  part        first doc_id of the task's range; shards order by (part, seq)
  seq, start  number of the shard in its part, and ids of the part before it
  n_ids       ids in the shard
  doc_ids, doc_symbols   each document and the place where its symbols end
  rules       little-endian int32 pairs; rule k makes the symbol first_rule + k
  lengths     little-endian int32: how many ids each rule expands to
  symbols     little-endian symbols, uint16 if width is 2, else uint32
A document decodes alone: its symbols lie between two entries of doc_symbols, and `lengths` finds any id without expanding
what comes before.

Defined results: a null or empty text is the end id only; a null doc_id sorts first; repeated rows are written once each;
an empty table gives no rows; extra columns are dropped. A shard holds one document at least, so a task holds one document's
ids beyond the shard size.
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

SHARD_IDS = 1_000_000
PAIRS_PER_ROUND = 4096
LEAST = 8
#: Hash slots that pairs are counted in, and so many places are few enough to sort their pairs.
SLOTS = 1 << 18
FEW = 100_000
#: More writing tasks than this are joined to their shards without broadcast.
BROADCAST_PARTS = 100_000
FILES = "part long, seq int, start long, n_ids long, first_rule int, doc_ids array<long>, doc_symbols array<int>, rules binary, lengths binary, width int, symbols binary"


def _frequent(seq: np.ndarray, last: np.ndarray, per_round: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, places, numbers): frequent pairs, where they stand, and which one stands there.

    A pair is as frequent as its hash slot at most. So only the places of frequent slots are looked at: one pair of each slot, or,
    where FEW places are left or no slot gives a pair, all pairs by sorting.
    """
    slot = ((seq[:-1] * np.int32(40503) + seq[1:] * np.int32(9973)) & np.int32(SLOTS - 1)).astype(np.intp)
    slot[last[:-1]] = SLOTS
    often = np.bincount(slot, minlength=SLOTS + 1)[:-1]
    full = np.append(often >= least, False)
    at = np.flatnonzero(full[slot])
    if len(at) > FEW:
        bar = max(least, int(np.partition(often, -per_round)[-per_round]))
        few = at if bar == least else at[often[slot[at]] >= bar]
        own_slot, key = slot[few], (seq[few].astype(np.int64) << 32) | seq[few + 1]
        pair = np.zeros(SLOTS, np.int64)
        pair[own_slot] = key  # one pair stands for its slot; others that hash to it wait
        own = pair[own_slot] == key
        few, own_slot = few[own], own_slot[own]
        n = np.bincount(own_slot, minlength=SLOTS)
        chosen = _most(n, per_round, least)
        if len(chosen):
            number = np.full(SLOTS, -1, np.int32)
            number[chosen] = np.arange(len(chosen))
            which = number[own_slot]
            return pair[chosen], few[which >= 0], which[which >= 0]
    key, where, n = np.unique((seq[at].astype(np.int64) << 32) | seq[at + 1], return_inverse=True, return_counts=True)
    chosen = _most(n, per_round, least)
    number = np.full(len(key), -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    which = number[where]
    return key[chosen], at[which >= 0], which[which >= 0]


def _most(n: np.ndarray, per_round: int, least: int) -> np.ndarray:
    """Where the largest counts of `least` or more stand, largest first."""
    at = np.flatnonzero(n >= least)
    return at[np.argsort(-n[at], kind="stable")[:per_round]]


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int, per_round: int = PAIRS_PER_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends of documents in symbols, rules) for ids and the ends of documents in them."""
    seq = ids.astype(np.int32)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    made = 0
    while len(seq) > 1:
        chosen, at, which = _frequent(seq, last, per_round, least)
        if not len(chosen):
            break
        # pairs that overlap: from the left of each run, every other one
        begin = np.concatenate(([True], np.diff(at) != 1))
        keep = (at - at[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]) % 2 == 0
        at, which = at[keep], which[keep]
        seq[at] = first_rule + made + which
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        rules.append(np.stack((chosen >> 32, chosen & 0xFFFFFFFF), axis=1))
        made += len(chosen)
    return seq, np.flatnonzero(last) + 1, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def _runs(rules: np.ndarray, first_rule: int) -> Iterator[tuple[int, int]]:
    """Runs of rules (from, to) that only hold symbols of the runs before them: one for each round that made them."""
    needs, s = rules.max(axis=1, initial=-1) - first_rule, 0
    while s < len(rules):
        stop = np.flatnonzero(needs[s:] >= s)
        e = s + int(stop[0]) if len(stop) else len(rules)
        yield s, e
        s = e


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    size = np.ones(first_rule + len(rules), np.int64)
    for s, e in _runs(rules, first_rule):
        size[first_rule + s : first_rule + e] = size[rules[s:e]].sum(axis=1)
    return size[first_rule:]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids of some symbols."""
    # every symbol is a slice of one table: ids themselves, then the expansions of the rules in order
    size = np.concatenate((np.ones(first_rule, np.int64), lengths))
    begin = np.cumsum(size) - size
    table = np.zeros(int(size.sum()), np.int32)
    table[:first_rule] = np.arange(first_rule)

    def slices(of: np.ndarray) -> np.ndarray:
        n = size[of]
        ends = np.cumsum(n)
        return table[np.repeat(begin[of] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    for s, e in _runs(rules, first_rule):
        got = slices(rules[s:e].ravel())
        table[begin[first_rule + s] :][: len(got)] = got
    return slices(symbols)


def _write(path: str, end: int, first_rule: int, shard_ids: int):
    def shard(part, seq, start, docs, runs):
        ids = np.frombuffer(b"".join(runs), "<u4")
        ends = np.cumsum([len(x) // 4 for x in runs])
        symbols, doc_ends, rules = compress(ids, ends, first_rule)
        width = 2 if first_rule + len(rules) <= 1 << 16 else 4
        row = {"part": part, "seq": seq, "start": start, "n_ids": len(ids), "first_rule": first_rule, "doc_ids": docs, "doc_symbols": doc_ends.tolist(), "rules": rules.astype("<i4").tobytes(), "lengths": expansion_lengths(rules, first_rule).astype("<i4").tobytes(), "width": width, "symbols": symbols.astype(f"<u{width}").tobytes()}
        kinds = {"part": pa.int64(), "seq": pa.int32(), "start": pa.int64(), "n_ids": pa.int64(), "first_rule": pa.int32(), "doc_ids": pa.list_(pa.int64()), "doc_symbols": pa.list_(pa.int32()), "rules": pa.binary(), "lengths": pa.binary(), "width": pa.int32(), "symbols": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in kinds.items()], list(kinds))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        part, seq, start, docs, runs, size, begun = None, 0, 0, [], [], 0, False
        for batch in rows:
            for doc, raw in zip(batch.column(0).to_pylist(), own.all_ids(batch.column(1).to_pylist(), end), strict=True):
                if not begun:
                    part, begun = doc, True
                docs.append(doc)
                runs.append(raw)
                size += len(runs[-1]) // 4
                if size >= shard_ids:
                    yield shard(part, seq, start, docs, runs)
                    seq, start, docs, runs, size = seq + 1, start + size, [], [], 0
        if docs:
            yield shard(part, seq, start, docs, runs)

    return run


def write(docs: DataFrame, to: str, path: str, end: int = 1, first_rule: int = 1 << 16, shard_ids: int = SHARD_IDS) -> None:
    """Encode, compress and write all documents to the folder `to`, which all executors see."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = shared.text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.mapInArrow(_write(path, end, first_rule, shard_ids), FILES).write.option("compression", "zstd").parquet(to)


def _read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            rules, lengths = np.frombuffer(row["rules"], "<i4").reshape(-1, 2).astype(np.int64), np.frombuffer(row["lengths"], "<i4").astype(np.int64)
            symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.int64)
            first = row["first_rule"]
            size = np.where(symbols >= first, lengths[np.maximum(symbols - first, 0)] if len(lengths) else 1, 1)
            ends = np.concatenate(([0], np.cumsum(size)))[row["doc_symbols"]]
            ids = expand(symbols, rules, lengths, first).astype("<u4")
            starts = np.concatenate(([0], ends[:-1]))
            sums = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["at"]), pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(docs_dir: str, spark) -> DataFrame:
    """Per document, from the files: its place among all ids, its number of ids and their checksum."""
    files = spark.read.schema(FILES).parquet(docs_dir)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row per writing task
    before = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    small = parts.count() <= BROADCAST_PARTS
    at = files.join(F.broadcast(before) if small else before, F.col("part").eqNullSafe(F.col("p"))).select((F.col("before") + F.col("start")).alias("at"), "first_rule", "doc_ids", "doc_symbols", "rules", "lengths", "width", "symbols")
    return at.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _decode(doc: int | None, begin: int, end: int | None):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                rules, lengths = np.frombuffer(row["rules"], "<i4").reshape(-1, 2), np.frombuffer(row["lengths"], "<i4")
                symbols, first = np.frombuffer(row["symbols"], f"<u{row['width']}"), row["first_rule"]
                for k in (k for k, d in enumerate(row["doc_ids"]) if d == doc):
                    own = symbols[row["doc_symbols"][k - 1] if k else 0 : row["doc_symbols"][k]].astype(np.int64)
                    sizes = np.where(own >= first, lengths[np.maximum(own - first, 0)] if len(lengths) else 1, 1)
                    stops = np.cumsum(sizes)
                    to = int(stops[-1]) if end is None else min(end, int(stops[-1]))
                    lo, hi = np.searchsorted(stops, begin, "right"), np.searchsorted(stops, to, "left") + 1
                    out, todo = [], own[lo:hi].tolist()[::-1]
                    while todo:  # only the symbols that the range touches
                        x = todo.pop()
                        if x < first:
                            out.append(x)
                        else:
                            todo += rules[x - first].tolist()[::-1]
                    skip = begin - int(stops[lo - 1] if lo else 0)
                    ids = out[skip : skip + max(0, to - begin)] if lo < len(own) else []
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k]], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def decode(docs_dir: str, spark, doc: int | None, begin: int = 0, end: int | None = None) -> DataFrame:
    """Random access: doc_id and ids begin to end of one document; a row for each that has the id.

    The shard is found by its range of ids (the filter reaches the Parquet scan), and only the symbols of the range are expanded.
    """
    files = spark.read.schema(FILES).parquet(docs_dir)
    if doc is None:
        own = files.where("part IS NULL AND exists(doc_ids, x -> x IS NULL)")
    else:
        part = files.where(F.col("part") <= doc).agg(F.max("part")).first()[0]
        own = files.where(F.col("part").eqNullSafe(F.lit(part).cast("long")) & F.array_contains("doc_ids", F.lit(doc).cast("long")))
    return own.select("first_rule", "doc_ids", "doc_symbols", "rules", "lengths", "width", "symbols").mapInArrow(_decode(doc, begin, end), "doc_id long, ids array<int>")
