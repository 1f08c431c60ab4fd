"""Operator 10: n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles (64-bit hashes). Two sets with Jaccard similarity t or more share one of
their first n - ceil(t n) + 1 elements in any fixed order. The order used here puts rare shingles first: they are counted in
BUCKETS hash buckets over all documents, and ordered by their bucket's count, then by hash.

  1. Equal sets form one class, named by its smallest doc_id.
  2. Classes with the same prefix and size collapse into one group, named by its smallest class. Lists of prefix elements hold
     a row for each group, not for its members.
  3. Star step: in the list of each prefix element the group with the most documents is the pivot; every group is held against
     the nearest of its pivots. Expanded: each member is held against one class of the pivot, and one class of its own group.
     That links most copies of a text with one comparison each.
  4. Rest: group pairs of a list of which members are not yet in one component. They pass the size, position and sketch filters, each
     pair once; then they are expanded to the members in different components. So no link between two components is missed,
     and no pairs within a component are made.
  5. Expanded pairs are held against wide sketches, then verified on the full sets, computed again from the texts in question.

The filters only drop pairs that can't link. At the first common element of a pair the overlap is at most what follows it, and
one, so a pair that links passes there; the symmetric difference of two sets has at least as many elements as their parity
sketches differ in bits. A group of several classes has no sketch of its own: its members' are compared when it is expanded.

Defined results: a text without words, or null, has size 0 and is linked with nothing; a text of fewer words than a shingle is
one shingle. A row without doc_id gets no links, and a null component. Rows that share a doc_id are one document; repeated rows
get a row each. An empty table gives an empty result. Extra columns are kept by `deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import components
from .textkit import SPACED, Words, batches

SHINGLE = 3
PERCENT = 90
#: Sizes that don't depend on the data: the counters of the shingle order (in rows of CELL), the parity sketch.
BUCKETS = 1 << 20
CELL = 1 << 14
SKETCH = 256
#: A bitmap of wanted ids has 16 bits for each; of more ids than this there is none, and the texts are joined with them.
BITMAP_IDS = 1 << 24

FEATURES = "doc_id long, n long, s1 long, s2 long, prefix array<long>, k0 long, k1 long, k2 long, k3 long, wide binary"


def sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, SPACED, True)
    at, h = w.grams(shingle)
    cut = np.searchsorted(at, w.cut)
    out = [np.unique(h[s:e]) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    for m in range(1, shingle):
        if (short := np.flatnonzero(w.counts == m)).size:
            at, h = w.grams(m)
            place = np.searchsorted(at, w.cut[short])
            for d, p in zip(short.tolist(), place.tolist(), strict=True):
                out[d] = h[p : p + 1]
    return out


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of CELL counters each, in as many bytes as the largest one needs; rows of zeros are left out."""
    for k, cell in enumerate(total.reshape(-1, CELL)):
        if (most := int(cell.max())):
            kind = np.min_scalar_type(most)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([cell.astype(kind).tobytes()], pa.binary())], ["cell", "width", "counts"])


def _count(shingle: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in rows:
            for _, raw in batches(batch.column(0).to_pylist()):
                np.add.at(total, bucket_of(np.concatenate(sets(raw, shingle))), 1)
        yield from _counts(total)

    return run


def _sum(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}  # BUCKETS counters at most
    for batch in rows:
        for k, width, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            total.setdefault(k, np.zeros(CELL, np.int64))
            total[k] += np.frombuffer(raw, f"<u{width}").astype(np.int64)
    for k, cell in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([8], pa.int32()), pa.array([cell.tobytes()], pa.binary())], ["cell", "width", "counts"])


def ranks(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """For each bucket a place that grows with its count: 2 * BUCKETS bytes, whatever the corpus."""
    kinds = "cell int, width int, counts binary"
    counts = docs.select("text").mapInArrow(_count(shingle), kinds).repartition("cell").mapInArrow(_sum, kinds)
    total = np.zeros((BUCKETS // CELL, CELL))
    for row in counts.select("cell", "counts").collect():  # BUCKETS counters
        total[row.cell] = np.frombuffer(row.counts, "<i8")
    return np.minimum(np.log2(total.ravel() + 1) * 1024, 65_535).astype(np.uint16)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
    return int(d[0]), int(d[1])


def sketch(s: np.ndarray, cells: int = SKETCH) -> np.ndarray:
    """Parity of the number of elements in each of some cells, as bits."""
    odd = np.bincount(((s >> np.uint64(8)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def wide(s: np.ndarray) -> bytes:
    """A sketch of one to two cells for each element: SKETCH cells at least, always a power of two."""
    return sketch(s, max(SKETCH, 1 << int(len(s)).bit_length())).tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Cells in which two sketches differ; the longer one is folded to the shorter one's size."""
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _features(order: np.ndarray, shingle: int, percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n, d, prefix, k, broad = [], [], [], [], []
            for _, raw in batches(batch.column(1).to_pylist()):
                for s in sets(raw, shingle):
                    n.append(len(s))
                    d.append(digest(s))
                    first = np.lexsort((s, order[bucket_of(s)]))[: prefix_size(len(s), percent)] if len(s) else []
                    prefix.append(s[first].astype(np.int64) if len(s) else np.zeros(0, np.int64))
                    k.append(sketch(s).view("<i8"))
                    broad.append(wide(s))
            d, k = np.array(d, np.int64).reshape(-1, 2), np.array(k, np.int64).reshape(-1, 4)
            edges = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists, *(pa.array(k[:, i]) for i in range(4)), pa.array(broad, pa.binary())], ["doc_id", "n", "s1", "s2", "prefix", "k0", "k1", "k2", "k3", "wide"])

    return run


def _wanted(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of hashed ids; it may let others pass, never drops one."""
    bit = F.pmod(F.xxhash64("node"), F.lit(bits))
    cell = ids.select(F.floor(bit / 32768).alias("cell"), (bit % 32768).alias("bit")).groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in cell.collect():  # bits / 32768 rows of 4096 bytes
        out[row.cell * 4096 : row.cell * 4096 + len(row.bits)] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _sets(bitmap: np.ndarray | None, shingle: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if bitmap is not None:
                bit = batch.column(2).to_numpy()
                batch = batch.take(pa.array(np.flatnonzero((bitmap[bit >> 3] >> (bit & 7)) & 1)))
            ids = batch.column(0).to_pylist()
            for lo, raw in batches(batch.column(1).to_pylist()):
                own = sets(raw, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + len(raw)], pa.int64()), pa.array([digest(s)[0] for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["node", "s1", "elements"])

    return run


def _verify(percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sift(percent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ok = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                need = -(-percent * (n + m) // (100 + percent))
                ok.append(apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= n + m - 2 * need)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def sifted(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide sketches allow a link; these sketches are a hundredth of the sets' size."""
    own = classes.select("node", "n", "wide")
    x, y = (own.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_sift(percent), "a long, b long").distinct()


def verified(tmp: shared.Scratch, pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of class names whose sets link, as a written table."""
    pairs = tmp.written(sifted(pairs, classes, percent), "sifted")
    nodes = tmp.written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    n = nodes.count()
    bits = max(1 << 15, 1 << (16 * n).bit_length())
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits)).alias("bit")).where("doc_id IS NOT NULL")
    if n > BITMAP_IDS:
        rows = rows.join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    found = tmp.written(rows.mapInArrow(_sets(_wanted(nodes, bits) if n <= BITMAP_IDS else None, shingle), "node long, s1 long, elements binary"), "sets")
    own = found.join(nodes, "node").join(classes.select("node", "s1").distinct(), ["node", "s1"]).select("node", "elements")
    x, y = own.select(F.col("node").alias("a"), F.col("elements").alias("x")), own.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    out = tmp.written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long").distinct(), name)
    tmp.drop(pairs, nodes, found)
    return out


SKETCHES = ["k0", "k1", "k2", "k3"]


def _apart():
    """Bits in which the sketches of a pair (l, r) differ; null where one has none."""
    return sum((F.bit_count(F.col(f"l.{k}").bitwiseXOR(F.col(f"r.{k}"))) for k in SKETCHES[1:]), F.bit_count(F.col("l.k0").bitwiseXOR(F.col("r.k0"))))


def _need(percent: int):
    """Common elements that a pair (l, r) must have to link."""
    return F.expr(f"({percent} * (l.n + r.n) + {100 + percent} - 1) div {100 + percent}")


def _may_link(percent: int):
    """What the sizes and sketches of a pair (l, r) must satisfy to link."""
    close = F.coalesce(_apart() <= F.col("l.n") + F.col("r.n") - 2 * _need(percent), F.lit(True))
    return (100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")) & close


def grouped(classes: DataFrame) -> DataFrame:
    """A row for each group of classes of the same size and prefix: g, n, prefix, weight (documents), members, sketch of a lone class."""
    own = classes.groupBy("n", "p1", "p2").agg(F.min("node").alias("g"), F.sum("copies").alias("weight"), F.count("*").alias("members"), F.first("prefix").alias("prefix"), *(F.min(k).alias(k) for k in SKETCHES))
    return own.select("g", "n", "p1", "p2", "weight", "members", "prefix", *(F.when(F.col("members") == 1, F.col(k)).alias(k) for k in SKETCHES))


def joined(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = shared.text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with shared.scratch(docs.sparkSession) as tmp:
        rows = tmp.written(docs.mapInArrow(_features(ranks(docs, shingle), shingle, percent), FEATURES), "features")
        keys = [F.xxhash64("prefix").alias("p1"), F.xxhash64(F.lit(1), "prefix").alias("p2")]
        classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("prefix").alias("prefix"), *(F.first(k).alias(k) for k in [*SKETCHES, "wide"]))
        classes = tmp.written(classes.select("*", *keys), "classes")
        groups = tmp.written(grouped(classes), "groups")
        # members of groups of several classes, but for the one that names the group
        more = tmp.written(classes.join(groups.where("members > 1").select("n", "p1", "p2", "g"), ["n", "p1", "p2"]).where("node != g").select("node", "g"), "members")

        # lists of prefix elements that two groups or more share
        entries = groups.select("g", "n", F.posexplode("prefix").alias("pos", "element")).repartition("element")
        # `least` keeps both sides of the join on one and the same exchange, so that the entries are made once
        common = entries.groupBy("element").agg(F.count("*").alias("size"), F.min("g").alias("least")).where("size > 1 AND least IS NOT NULL").select("element")
        entries = tmp.written(entries.join(common, "element"), "entries")
        lists = tmp.written(entries.join(groups.select("g", "n", "weight", *SKETCHES), ["g", "n"]), "lists")
        tmp.drop(entries)

        pivots = lists.groupBy("element").agg(F.max(F.struct("weight", "g", "n", *SKETCHES)).alias("p")).select("element", "p.*")
        stars = lists.alias("l").join(pivots.alias("r"), "element").where((F.col("l.g") != F.col("r.g")) & _may_link(percent))
        stars = stars.select(F.col("l.g").alias("a"), F.struct(_apart().alias("apart"), F.col("r.g").alias("b")).alias("near"))
        stars = tmp.written(stars.groupBy("a").agg(F.min("near").alias("near")).select("a", "near.b"), "stars")
        spread = more.select(F.col("node").alias("a"), F.col("g").alias("b")).unionByName(more.join(stars, F.col("g") == F.col("a")).select(F.col("node").alias("a"), "b"))
        linked = verified(tmp, stars.unionByName(spread), docs, classes, shingle, percent, "links")
        label = components(tmp, linked)

        # groups with the components that their members are in
        of = lambda rows, node: rows.join(label.withColumnRenamed("node", "_node"), F.col(node) == F.col("_node"), "left").withColumn("label", F.coalesce("label", node)).drop("_node")
        others = of(more, "node").select("g", "label").distinct()
        first = of(lists, "g")
        named = first.unionByName(lists.join(others, "g").select(*first.columns).join(of(groups.select("g"), "g"), ["g", "label"], "left_anti").select(*first.columns))
        named = tmp.written(named, "named")
        center = named.groupBy("element").agg(F.max(F.struct("weight", "g", "label")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("element", F.col("p.label").alias("center"))
        open_ = tmp.written(named.drop("weight").join(center, "element"), "open")
        tmp.drop(lists, named)
        left, right = open_.where("label != center").alias("l"), open_.alias("r")
        after = 1 + F.least(F.expr("l.n - l.pos - 1"), F.expr("r.n - r.pos - 1"))
        once = (F.col("r.label") == F.col("r.center")) | (F.col("l.g") < F.col("r.g")) | ((F.col("l.g") == F.col("r.g")) & (F.col("l.label") < F.col("r.label")))
        rest = left.join(right, "element").where((F.col("l.label") != F.col("r.label")) & once & _may_link(percent) & (after >= _need(percent)))
        rest = tmp.written(rest.select(F.least("l.g", "r.g").alias("g"), F.greatest("l.g", "r.g").alias("h")).distinct(), "rest")
        links = linked.unionByName(verified(tmp, expanded(tmp, rest, more, label, classes, percent), docs, classes, shingle, percent, "more-links"))

        # a doc_id with several texts is one document
        torn = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "s1")).alias("lo"), F.max(F.struct("n", "s1")).alias("hi")).where("lo != hi").select("doc_id")
        own = rows.join(torn, "doc_id").join(classes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        label = components(tmp, links.unionByName(own), "all-edges")

        # from classes to documents
        ids = classes.select("n", "s1", "s2", "node").join(label, "node", "left").select("n", "s1", "s2", F.coalesce("label", "node").alias("component_id"))
        out = rows.select("doc_id", "n", "s1", "s2").join(ids, ["n", "s1", "s2"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return shared.written(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "joined")


def expanded(tmp: shared.Scratch, rest: DataFrame, more: DataFrame, label: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components, from pairs (g, h) of groups, which may be equal."""
    several = more.select("g").distinct()
    lone = rest.join(several.select("g"), "g", "left_anti").join(several.select(F.col("g").alias("h")), "h", "left_anti")
    wide = rest.join(several, "g", "left_semi").unionByName(rest.join(several, "g", "left_anti").join(several.select(F.col("g").alias("h")), "h", "left_semi").select("g", "h"))
    members = more.unionByName(several.select(F.col("g").alias("node"), "g")).unionByName(rest.select(F.explode(F.array("g", "h")).alias("g")).distinct().join(several, "g", "left_anti").select(F.col("g").alias("node"), "g"))
    members = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).join(classes.select("node", "n", *SKETCHES), "node")
    members = tmp.written(members, "expanded")
    pairs = wide.join(members.select("g", F.struct("node", "label", "n", *SKETCHES).alias("l")), "g").join(members.select(F.col("g").alias("h"), F.struct("node", "label", "n", *SKETCHES).alias("r")), "h")
    pairs = pairs.where((F.col("l.label") != F.col("r.label")) & _may_link(percent))
    return lone.select(F.col("g").alias("a"), F.col("h").alias("b")).unionByName(pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns: the one whose doc_id names the group; rows without doc_id stay.

    Only rows that may go are shuffled: those of another name than their group's, and those of a doc_id with several rows.
    """
    named = F.col("doc_id") == F.col("component_id")
    counts = joined(docs, shingle, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum(F.when(named, 1).otherwise(0)).alias("n"))
    odd = shared.written(counts.where("n != 1").select(F.col("doc_id").alias("_odd"), "n"), "may-go")
    rows = shared.packed(docs).withColumn("h", F.xxhash64(F.col("r.doc_id").cast("long")))
    rows = shared.marked(shared.Scratch(docs.sparkSession), rows, "h", odd.select(F.xxhash64("_odd").alias("h")))
    hit = rows.where("may").join(odd, F.col("r.doc_id").cast("long") == F.col("_odd"), "left")
    stay = hit.where("n IS NULL").select("r").unionByName(hit.where("n > 1").dropDuplicates(["_odd"]).select("r"))
    return rows.where("NOT may").select("r").unionByName(stay).select("r.*")
