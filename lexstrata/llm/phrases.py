"""Operator 12: phrase collocation mining by hierarchical pair naming.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and those into words. Every level names the frequent
runs of one word more: a k-gram is a pair of the ids of two (k-1)-grams that begin one word apart, so its occurrences are the
places where both are frequent, and its id comes from a global count of such pairs, joined back to the places.

What travels is not the places but the different runs of a block of words: a task turns its texts into blocks of at most
BLOCK_WORDS words of one language, each with a sequence of numbers into the block's own list of runs. Words are exploded and counted
as rows, those with `least` occurrences get ids, and a join gives each block the ids of its words. Pairs are many more, so a block
sends them packed: its pairs of each hash bucket, sorted and compressed, are one row. A bucket's group adds up the counts of all
blocks, names the frequent pairs (bucket and place in it), and answers each block with the ids of the pairs that it sent. There are
as many buckets as keep one to about BUCKET_WORDS words, and a run that is everywhere has one entry for each block.

A k-gram's two ids are its parents: without the last word, and without the first. Frequencies of all its beginnings are those of its
first parent and its own; of all its ends, those of its second parent and its own; these give both sides of every cut. Of
the longer candidates around a candidate the most frequent has one word more, so the parents' ids give subsumption, too.

Defined results: null and empty texts have no words; a null language is `und`, as is one of that name; repeated rows count each;
a language without candidates has no rows; an empty table gives no rows; extra columns are ignored. A long
text may be in several blocks, which are only cut where a piece ends; a single piece must fit a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared
from .textkit import mix

LEAST = 30
LONGEST = 4
TOP = 2000
#: Percent of a candidate's occurrences that a longer one must have to take its place.
SUBSUMED = 80
BLOCK_WORDS = 1 << 20
BUCKET_WORDS = 1 << 21
CHUNK = 1 << 20
ROWS = 1 << 16
#: Parts of a language that are cut to the first rows before the language is ranked.
PARTS = 64

#: A-Z lower-cased; what ends a piece is a line feed, a tab is a space.
_BYTES = bytes(ord(" ") if b == 9 else 10 if 10 <= b <= 13 or b in b".,;:!?" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b"."  # can't be a word

#: A row for each word of a block, and one (number 0) with the block's sequence.
BLOCKS = "block long, lang string, number int, word string, n long, seq binary"
#: A block's sequence of numbers, and the id of each number (0 is none).
NAMED = "block long, seq binary, ids binary"
SENT = "bucket long, block long, pairs binary"
#: Names (a, b, f, id) and answers (block, ids) of a bucket.
COUNTED = "bucket long, a long, b long, f long, id long, block long, ids binary"


def squeezed(*columns: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, bytes of one weight together, compressed."""
    return pa.compress(b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), "zstd", asbytes=True)


def opened(raw: bytes, rows: int, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(pa.decompress(raw, 8 * rows * columns, "zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.reshape(8, rows).T).view("<i8").ravel() for c in flat.reshape(columns, 8 * rows)]


class Block:
    """Words of one language, numbered as they come; 0 is the end of a piece."""

    def __init__(self):
        self.index: defaultdict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.index[_END]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        parts = text.replace(b"\n", b" . ").split()
        parts.append(_END)
        self.parts.append(np.fromiter(map(self.index.__getitem__, parts), np.int32, len(parts)))
        self.size += len(parts)

    def table(self, number: int, lang: str) -> pa.Table:
        seq = np.concatenate(self.parts)
        words, m = list(self.index), len(self.index)
        n = np.bincount(seq, minlength=m)
        columns = [pa.array(np.full(m, number)), pa.array([lang]).take(pa.array(np.zeros(m, np.int32))), pa.array(np.arange(m, dtype=np.int32)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), _first(seq, m)]
        return pa.Table.from_arrays(columns, ["block", "lang", "number", "word", "n", "seq"])


def _first(seq: np.ndarray, rows: int) -> pa.Array:
    return pa.concat_arrays([pa.array([seq.tobytes()], pa.binary()), pa.nulls(rows - 1, pa.binary())])


def pieces(raw: bytes) -> Iterator[bytes]:
    """Runs of whole pieces of about CHUNK bytes; a longer piece is a run of its own."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\n", at + CHUNK)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end + 1


def _blocks(block_words: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        here: dict[str, Block] = {}

        def out(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang in langs:
                yield from here.pop(lang).table(task << 32 | made, lang).to_batches(ROWS)
                made += 1

        for batch in rows:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)
                lang = "und" if lang is None else lang
                for part in pieces(raw):
                    own = here.setdefault(lang, Block())
                    own.add(part)
                    if own.size >= block_words:
                        yield from out([lang])
                if sum(b.size for b in here.values()) >= 4 * block_words:
                    yield from out(list(here))
        yield from out(list(here))

    return run


def neighbours(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A sequence of numbers from 1 into the pairs of neighbours that both have ids (0 elsewhere); the pairs' ids and their numbers.

    A pair takes the place of its first member, so neighbouring pairs begin one word apart again.
    """
    there = ids[seq] > 0
    at = np.flatnonzero(there[:-1] & there[1:])
    key = seq[at].astype(np.int64) << 32 | seq[at + 1]
    pairs, number, n = np.unique(key, return_inverse=True, return_counts=True)
    out = np.zeros(max(len(seq) - 1, 0), np.int32)
    out[at] = number + 1
    return out, ids[pairs >> 32], ids[pairs & 0xFFFFFFFF], n


def _row(block: int, seq: np.ndarray, ids: np.ndarray) -> pa.Table:
    """A block whose numbers are those with ids alone."""
    number = np.zeros(len(ids), np.int32)
    known = np.flatnonzero(ids)
    number[known] = np.arange(1, len(known) + 1)
    ids = np.concatenate(([0], ids[known]))
    return pa.Table.from_arrays([pa.array([block], pa.int64()), pa.array([number[seq].tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], ["block", "seq", "ids"])


def _words(key: tuple, blocks: pa.Table, names: pa.Table) -> pa.Table:
    """A block with the ids of its words."""
    seq = np.frombuffer(blocks.column("seq")[0].as_py(), np.int32)
    ids = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
    ids[names.column("number").to_numpy()] = names.column("id").to_numpy()
    return _row(key[0].as_py(), seq, ids)


def dealt(seq: bytes, ids: bytes, buckets: int) -> tuple:
    """The next sequence, the ids a and b and the count of each pair, the order of pairs by bucket, and where each bucket begins."""
    out, a, b, n = neighbours(np.frombuffer(seq, np.int32), np.frombuffer(ids, np.int64))
    bucket = (mix(mix(a.astype(np.uint64)) + b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((b, a, bucket))
    found, cut = np.unique(bucket[order], return_index=True)
    return out, a, b, n, order, found, np.append(cut, len(order))


def _send(buckets: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for block, seq, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, a, b, n, order, found, cut = dealt(seq, ids, buckets)
                packed = [(int(e - s).to_bytes(8, "little") + squeezed(a[at], b[at], n[at])) for s, e in zip(cut, cut[1:], strict=False) for at in [order[s:e]]]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), block), pa.int64()), pa.array(packed, pa.binary())], ["bucket", "block", "pairs"])

    return run


def _count(least: int, answers: bool):
    def run(key: tuple, sent: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        parts = [opened(x[8:], int.from_bytes(x[:8], "little"), 3) for x in sent.column("pairs").to_pylist()]
        a, b, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((b, a))
        new = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))
        first = np.flatnonzero(new)
        f = np.add.reduceat(n[order], first)
        good = f >= least
        ids = np.where(good, bucket << 36 | np.cumsum(good), 0)
        at = order[first[good]]
        m, none = len(at), pa.nulls(len(at), pa.int64())
        columns = [pa.array(np.full(m, bucket)), pa.array(a[at]), pa.array(b[at]), pa.array(f[good]), pa.array(ids[good]), none, pa.nulls(m, pa.binary())]
        names = pa.Table.from_arrays(columns, [c.split(" ")[0] for c in COUNTED.split(", ")])
        if not answers:
            return names
        own = np.empty(len(a), np.int64)
        own[order] = ids[np.cumsum(new) - 1]
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        replies = [(k, squeezed(own[s:e])) for k, s, e in zip(sent.column("block").to_pylist(), cut, cut[1:], strict=False) if own[s:e].any()]
        m = len(replies)
        long = pa.nulls(m, pa.int64())
        columns = [pa.array(np.full(m, bucket)), long, long, long, long, pa.array([k for k, _ in replies], pa.int64()), pa.array([x for _, x in replies], pa.binary())]
        return pa.concat_tables([names, pa.Table.from_arrays(columns, names.column_names)])

    return run


def _answered(buckets: int):
    def run(key: tuple, blocks: pa.Table, replies: pa.Table) -> pa.Table:
        seq, a, _, _, order, found, cut = dealt(blocks.column("seq")[0].as_py(), blocks.column("ids")[0].as_py(), buckets)
        ids = np.zeros(len(a) + 1, np.int64)
        for bucket, raw in zip(replies.column("bucket").to_pylist(), replies.column("ids").to_pylist(), strict=True):
            k = int(np.searchsorted(found, bucket))
            at = order[cut[k] : cut[k + 1]]
            ids[at + 1] = opened(raw, len(at), 1)[0]
        return _row(key[0].as_py(), seq, ids)

    return run


def levels(tmp: shared.Scratch, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n), and for each length the frequent runs: id, f, and word and lang or the parents a and b."""
    blocks = tmp.written(shared.text_batches(docs).select("text", "lang").mapInArrow(_blocks(block_words), BLOCKS), "phrase-blocks")
    each = blocks.where("number > 0").select("block", "number", "lang", "word", "n")
    counted = each.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    names = [tmp.written(counted.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id() + 1), "phrase-names-1")]
    total = tmp.written(each.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-words")
    buckets = max(1, (total.agg(F.sum("n")).first()[0] or 0) // bucket_words)
    here = each.join(names[0], ["lang", "word"]).select(F.col("block").alias("of"), "number", "id")
    before, of = blocks, lambda df: df.groupBy("of")
    blocks = tmp.written(blocks.where("number = 0").select("block", "seq").groupBy("block").cogroup(of(here)).applyInArrow(_words, NAMED), "phrase-ids-1")
    tmp.drop(before)
    for k in range(2, longest + 1):
        pairs = blocks.mapInArrow(_send(buckets), SENT).groupBy("bucket").applyInArrow(_count(least, k < longest), COUNTED)
        pairs = tmp.written(pairs, f"phrase-names-{k}")
        names.append(pairs.where("id IS NOT NULL").select("id", "a", "b", "f"))
        if k < longest:
            replies = pairs.where("block IS NOT NULL").select(F.col("block").alias("of"), "bucket", "ids")
            before, blocks = blocks, tmp.written(blocks.groupBy("block").cogroup(of(replies)).applyInArrow(_answered(buckets), NAMED), f"phrase-ids-{k}")
            tmp.drop(before)
    tmp.drop(blocks)
    return total, names


def candidates(names: list[DataFrame]) -> DataFrame:
    """Frequent phrases of two words or more: lang, phrase, a, l, r and score of the lowest cut, and how often the most frequent longer one that holds it occurs."""
    big = lambda c: F.col(c).cast("decimal(20,0)")
    lower = names[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array(big("f")).alias("heads"), F.array(big("f")).alias("tails"))
    out = None
    for k, pairs in enumerate(names[1:], 2):
        first = lower.select(F.col("id").alias("a"), "lang", "phrase", "heads")
        second = lower.select(F.col("id").alias("b"), "last", "tails")
        own = pairs.join(first, "a").join(second, "b").withColumn("phrase", F.concat_ws(" ", "phrase", "last"))
        score = lambda j, k=k: F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * big("f"), F.get("heads", j - 1) + F.get("tails", k - 1 - j))
        cut = F.array_min(F.array(*(F.struct(score(j).alias("score"), F.lit(j).alias("j"), F.get("heads", j - 1).alias("l"), F.get("tails", k - 1 - j).alias("r")) for j in range(1, k))))
        over = F.lit(None).cast("long").alias("over")
        found = own.select("id", "lang", "phrase", F.col("f").alias("a"), cut.alias("cut"))
        if k < len(names):
            more = names[k].select(F.explode(F.array("a", "b")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("over"))
            found, over = found.join(more, "id", "left"), F.col("over")
        found = found.select("lang", "phrase", "a", F.col("cut.l").cast("long").alias("l"), F.col("cut.r").cast("long").alias("r"), "cut.score", over)
        out = found if out is None else out.unionByName(found)
        lower = own.select("id", "lang", "phrase", "last", F.array_append("heads", big("f")).alias("heads"), F.array_append("tails", big("f")).alias("tails"))
    return out


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, subsumed: int = SUBSUMED, block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` collocations."""
    tmp = shared.Scratch(docs.sparkSession)
    total, names = levels(tmp, docs, least, longest, block_words, bucket_words)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    rows = candidates(names).where(F.col("over").isNull() | (big("over") * 100 < big("a") * subsumed)).drop("over")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= top).drop("_part", "_r")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))  # of at most PARTS times `top` rows
    rows = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return rows.join(F.broadcast(total) if total.count() <= 4096 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
