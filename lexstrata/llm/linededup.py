"""Operator 2: fuzzy line dedup, DataFrame functions only.

  1. Texts are cut into lines at newlines; a line is normalised (lower case, white space runs as one space, trimmed). Lines
     without a character left are no lines here: they are never removed.
  2. Equal normalised lines are one node, named by a 64-bit hash. A line whose second hash is not its node's is left alone.
  3. Lines meet on rare word triples: of the runs of three words, brought into one fixed order with rare ones first, each
     line enters the lists of as many as edits can destroy, and one more (see `prefix`). Two lines that are similar enough share one
     of these whatever the order is. The order only keeps lists short: all triples of all distinct lines are counted; triples that
     occur once come first and enter no list, since no line shares them; the others follow by their counts in BUCKETS hash
     buckets, then by hash. Pairs of words repeat by chance, and the more so the more lines there are; triples seldom do, so a
     line that has no similar one is in no list. SimHash blocks, the method first thought of, find few of the lines that are this
     similar. Counting shuffles a hash of 40 bits for each triple.
  4. Star step: in each list the smallest node is the pivot, and every line is held against its nearest pivot. Rest: lines that
     are not in the component of their nearest pivot are held against their other pivots, and those that are in none's against
     the list's lines in other components. So components are whole, and no pairs within one are made. Lengths and parities (of
     a line's words in 128 cells; in 512 for pairs without a pivot) drop pairs that can't be similar: an edit of one word
     changes two cells at most, and one cell for each word that the longer line has more.
  5. What is left is verified: an edit distance over words of at most 1 - SIMILARITY of the longer line's words. For it each
     word becomes one of 20,480 characters by hash, so that the built-in distance runs over words; where two words of
     a pair that passes have one character, it is taken again with one for each different word of the pair.
  6. Of each connected group the occurrence that comes first (doc_id, then line) stays; all others are removed.

A line of LEAST_WORDS - 1 words is similar to lines that have one word more, and to no other; it meets these by equality, since
each line of LEAST_WORDS words names what is left of it without each of its words. By the same names lines of LEAST_WORDS words
that differ in one word meet, whose triples that word may destroy. Shorter lines allow no edit and are held equal.

Defined results: a null text stays null, an empty one stays as it is; a text may lose all its lines and is then empty. Repeated
rows count as one document, each row gets the same result. Rows without doc_id come first in order. An empty table gives an
empty result. All columns, whatever their names, stay as they are but for the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import components

SIMILARITY = 0.8
LEAST_WORDS = 5
#: Words of a run, and bits of its hash.
RUN, HASH_BITS = 3, 40
#: Cells of 64 bits that mark repeated runs (32 MB at most), and counters of these. Full ones only make lists longer.
MOST_CELLS = 1 << 22
BUCKETS = 1 << 18
#: Labels of lines that are broadcast at most (2 MB); more are joined without.
SMALL = 1 << 17
#: Parts of 64 cells in the sketches of lines that are held against more than pivots: lines with a long passage in common are told apart.
WIDE = 8
#: Lists of a line, smallest first, by which a pair that shares several is made in the first of them only.
HEAD = 64


def normalised(low: Column) -> Column:
    """Of a lower-cased, trimmed line."""
    odd = F.contains(low, F.lit("  ")) | F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\r")) | F.contains(low, F.lit("\u00a0"))
    return F.when(odd, F.trim(F.regexp_replace(low, "[\\s\u00a0]+", " "))).otherwise(low)


def blanks(norm: Column) -> Column:
    """Spaces of a normalised line: one less than its words."""
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))


def _rows(docs: DataFrame) -> DataFrame:
    """Struct r, and a key of the document: its id and a hash of its id and text."""
    rows = shared.packed(docs)
    text = F.col("r.text").cast("string")
    return rows.select("r", F.col("r.doc_id").cast("long").alias("doc"), F.xxhash64("r.doc_id", "r.text").alias("key"), text.alias("text"))


def _single(tmp: shared.Scratch, rows: DataFrame, h: str) -> DataFrame:
    """rows without repetitions; only rows whose h may stand twice are shuffled."""
    twice = tmp.written(rows.groupBy(h).agg(F.count("*").alias("copies")).where("copies > 1").select(F.col(h).alias("h")), "repeated")
    return _distinct(tmp, rows, h, twice)


def _distinct(tmp: shared.Scratch, rows: DataFrame, h: str, twice: DataFrame) -> DataFrame:
    rows = shared.marked(tmp, rows, h, twice)
    return rows.where("NOT may").drop("may").unionByName(rows.where("may").drop("may").distinct())


def numbered(tmp: shared.Scratch, docs: DataFrame) -> DataFrame:
    """doc, key, pos, norm, node and a second hash of every line; norm is empty for lines without a character."""
    rows = _single(tmp, _rows(docs).select("doc", "key", "text"), "key")
    lines = rows.select("doc", "key", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).withColumn("low", F.trim(F.lower("line")))
    lines = lines.select("doc", "key", "pos", F.coalesce(normalised(F.col("low")), F.lit("")).alias("norm"))
    return lines.select("*", F.xxhash64("norm").alias("node"), F.xxhash64(F.lit(1), "norm").alias("second"))


def sketched(lines: DataFrame, parts: int = 2) -> DataFrame:
    """node, n (words) and the parities even0, even1, ... of distinct lines, each of the words in 64 cells of 64 * parts."""
    words = lines.select("node", F.explode_outer(F.split("norm", " ")).alias("word")).select("node", F.xxhash64("word").alias("h"))
    cell = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    part = _bits(F.col("h"), 6, parts)
    even = [F.coalesce(F.bit_xor(F.when(part == k, cell)), F.lit(0)).alias(f"even{k}") for k in range(parts)]
    return words.groupBy("node").agg(F.count("*").alias("n"), *even)


def most_edits(n: Column) -> Column:
    """Of two similar lines, the longer one of n words."""
    return F.floor(n * round(1 - SIMILARITY, 6))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_runs(words: Column) -> Column:
    """A hash for each run of RUN neighbouring words."""
    run = lambda w, i: _run_hash(w, *(F.get(words, i + k) for k in range(1, RUN)))
    return F.slice(F.transform(words, run), F.lit(1), F.greatest(F.size(words) - (RUN - 1), F.lit(0)))


def _run_hash(*words: Column) -> Column:
    return F.xxhash64(*words).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def repeated_runs(lines: DataFrame) -> DataFrame:
    """h and n of the runs of words that occur more than once in all lines; a row for each run goes through compiled code only."""
    later = lambda k: F.slice("w", F.lit(k + 1), F.greatest(F.size("w") - k, F.lit(0))).alias(f"w{k}")
    words = lines.select(F.split("norm", " ").alias("w")).select(F.inline(F.arrays_zip(*(later(k) for k in range(RUN)))))
    runs = words.where(F.col(f"w{RUN - 1}").isNotNull()).select(_run_hash(*(F.col(f"w{k}") for k in range(RUN))).alias("h"))
    return runs.repartition("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")  # few repeat within a task, so none are counted before the shuffle


def _bits(h: Column, at: int, size: int) -> Column:
    """A number below size, a power of two, from some bits of a hash."""
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit(size - 1))


def _dense(rows: DataFrame, size: int) -> DataFrame:
    """One row: an array `every` of the values v by id, 0 where there is no row, and their mean."""
    whole = rows.sparkSession.range(size).join(rows, "id", "left").select("id", F.coalesce("v", F.lit(0)).alias("v"))
    return whole.agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("e"), F.avg("v").alias("mean")).select(F.transform("e", lambda x: x["v"]).alias("every"), "mean")


def run_marks(repeated: DataFrame, cells: int) -> DataFrame:
    """One row: a bitmap of the repeated runs."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bits(F.col("h"), 0, 64).cast("int"))
    return _dense(repeated.groupBy(_bits(F.col("h"), 6, cells).alias("id")).agg(F.bit_or(bit).alias("v")), cells).select("every")


def run_ranks(repeated: DataFrame) -> DataFrame:
    """One row: for each bucket of repeated runs a number from 1 to 127 that grows with its count, relative to the mean."""
    counts = repeated.groupBy(_bits(F.col("h"), 22, BUCKETS).alias("id")).agg(F.sum("n").alias("v"))
    rank = lambda n: F.least(F.lit(127), 1 + F.floor(16 * F.log2(n / F.greatest("mean", F.lit(1e-9)) + 1))).cast("int")
    return _dense(counts, BUCKETS).select(F.transform("every", rank).alias("every"))


def destroyed(n: Column) -> Column:
    """How many runs of a line of n words the edits to a similar line can destroy.

    Of two lines of n and n + k words that are similar, k of at most e = most_edits(n + k) edits insert words into the shorter one.
    An insertion destroys RUN - 1 of its runs, another edit RUN: together RUN * e - k, the most of which over all k is at some k
    below RUN, since e grows once in five. Of the longer line RUN * e are destroyed at most.
    """
    return F.greatest(*(RUN * most_edits(n + k) - k for k in range(RUN)))


def prefix(words: Column, marks: Column, ranks: Column, cells: int) -> Column:
    """The first runs of a line, in the order of their ranks, then of their hashes, without those that occur once.

    From LEAST_WORDS + 1 words on, similar lines have a run that edits leave; so have those of LEAST_WORDS words and of one word more.
    The first shared run comes after destroyed ones only.
    """

    def repeated(h: Column) -> Column:
        return F.getbit(F.get(marks, _bits(h, 6, cells).cast("int")), _bits(h, 0, 64).cast("int")) == 1

    def ranked(h: Column) -> Column:
        return F.shiftleft(F.get(ranks, _bits(h, 22, BUCKETS).cast("int")).cast("long"), 56).bitwiseOR(h)

    def first(often: Column) -> Column:
        left = destroyed(F.size(words)) + 1 - (F.greatest(F.size(words) - (RUN - 1), F.lit(0)) - F.size(often))  # after those that occur once
        return F.when(left > 0, F.array_distinct(F.slice(F.sort_array(F.transform(often, ranked)), F.lit(1), F.greatest(left, F.lit(1)).cast("int"))))

    return once(F.filter(word_runs(words), repeated), first)


SKETCH = ["n", "even0", "even1"]


def _apart(parts: int = 2) -> Column:
    """Cells in which the parities of a pair (l, r) differ."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"l.even{k}").bitwiseXOR(F.col(f"r.even{k}"))) for k in range(parts)))


def _near(parts: int = 2) -> Column:
    """What a pair (l, r) must satisfy to be similar."""
    most, more = most_edits(F.greatest("l.n", "r.n")), F.greatest("l.n", "r.n") - F.least("l.n", "r.n")
    return (more <= most) & (_apart(parts) <= 2 * most - more)  # words that one line has more are edits of one cell


def symbols(norm: str) -> Column:
    """One character for each word."""
    code = F.transform(F.split(norm, " "), lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(20_480)) + 0x4E00))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def own_symbols(norm: str, words: Column) -> Column:
    """One character for each word: its place among the different words of a pair, from the first plane beyond the basic one on."""
    code = F.transform(F.split(norm, " "), lambda w: F.lpad(F.hex(F.array_position(words, w) + 0xFFFF), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def verified(tmp: shared.Scratch, pairs: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough, as a written table."""
    nodes = tmp.written(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct(), "nodes")
    found = shared.marked(tmp, lines, "node", nodes).where("may")
    texts = tmp.written(found.select("node", "norm", symbols("norm").alias("words")), "line-words")
    x, y = (texts.select(F.col("node").alias(k), F.col("norm").alias(f"{k}_norm"), F.col("words").alias(f"{k}_words")) for k in "ab")
    most = f"cast(floor(greatest(length(a_words), length(b_words)) * {round(1 - SIMILARITY, 6)}) as int)"
    maybe = pairs.join(x, "a").join(y, "b").where(F.expr(f"levenshtein(a_words, b_words, {most}) >= 0"))
    # hashed words are never further apart than the words; where no two words of a pair have one character, as far
    words = F.array_distinct(F.concat(F.split("a_norm", " "), F.split("b_norm", " ")))
    seen = F.size(F.array_distinct(F.split(F.concat("a_words", "b_words"), "")))
    again = lambda w: F.call_function("levenshtein", own_symbols("a_norm", w), own_symbols("b_norm", w), F.expr(most)) >= 0
    exact = once(words, lambda w: F.when(F.size(w) == seen, True).otherwise(again(w)))
    out = tmp.written(maybe.where(exact).select("a", "b").distinct(), name)
    tmp.drop(nodes, texts)
    return out


def lists_of(tmp: shared.Scratch, lines: DataFrame) -> DataFrame:
    """block, node, size and pivot: the lists of runs of words that two lines or more have in their prefixes, as a written table."""
    long = lines.where(blanks(F.col("norm")) >= LEAST_WORDS - 1)
    repeated = tmp.written(repeated_runs(long), "repeated-runs")
    cells = min(MOST_CELLS, 1 << max(6, (repeated.count() // 8).bit_length()))  # 8 to 16 bits for each
    marks, ranks = tmp.written(run_marks(repeated, cells), "run-marks"), tmp.written(run_ranks(repeated), "run-ranks")
    tmp.drop(repeated)
    # marks and ranks are one value for all rows: named once each, the optimizer puts them where they are used, and no row carries them
    keyed = long.withColumn("marks", marks.scalar()).withColumn("ranks", ranks.scalar())
    keyed = keyed.select("node", once(F.split("norm", " "), lambda w: prefix(w, F.col("marks"), F.col("ranks"), cells)).alias("blocks"))
    keyed = keyed.select("node", F.explode_outer("blocks").alias("block")).where("block IS NOT NULL").repartition("block")
    # `pivot` also keeps both sides of the join below on one and the same exchange, so that the pairs are made once
    common = keyed.groupBy("block").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1 AND pivot IS NOT NULL")
    out = tmp.written(keyed.join(common.hint("shuffle_hash"), "block"), "common-blocks")
    tmp.drop(marks, ranks)
    return out


def near_pivots(tmp: shared.Scratch, lists: DataFrame, lines: DataFrame) -> DataFrame:
    """a, b and apart: the lines of lists with those pivots that they may be similar to, each pair once, as a written table.

    Lines that are similar share many lists; sketches meet their pairs, not the rows of the lists.
    """
    pairs = tmp.written(lists.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pivot-pairs")
    nodes = tmp.written(pairs.select(F.col("a").alias("h")).unionByName(pairs.select("b").distinct().select(F.col("b").alias("h"))).distinct(), "common-nodes")
    sketches = tmp.written(sketched(shared.marked(tmp, lines, "node", nodes).where("may").select("node", "norm")), "sketches")
    of = lambda c, side: sketches.select(F.col("node").alias(c), F.struct(*SKETCH).alias(side))
    near = pairs.join(of("a", "l"), "a").join(of("b", "r"), "b").where(_near()).select("a", "b", _apart().alias("apart"))
    near = tmp.written(near, "near")
    tmp.drop(pairs, nodes, sketches)
    return near


def _without(words: Column, k: int) -> Column:
    return F.filter(words, lambda _, i: i != k)


def one_word_apart(tmp: shared.Scratch, lines: DataFrame) -> DataFrame:
    """(a, b): lines a of LEAST_WORDS words that are b with one word more, and those that differ from b in one word.

    A row for each word of the lines a, before the joins. Lines that are equal without their k-th word are all similar: each
    is linked with the smallest of them.
    """
    words, size = F.split("norm", " "), blanks(F.col("norm")) + 1
    lines = tmp.written(lines.where(size.isin(LEAST_WORDS - 1, LEAST_WORDS)).select("node", "norm"), "short-lines")
    short = lines.where(size == LEAST_WORDS - 1).select(F.col("node").alias("h"), "norm")
    less = F.array(*(F.array_join(_without(words, k), " ") for k in range(LEAST_WORDS)))
    own = lines.where(size == LEAST_WORDS)
    whole = own.select(F.col("node").alias("a"), F.explode(F.array_distinct(less)).alias("less")).withColumn("h", F.xxhash64("less"))
    found = whole.join(short, "h").where("less = norm")
    named = own.select(F.col("node").alias("a"), F.posexplode(less).alias("k", "less"))
    first = named.groupBy("k", "less").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = named.join(first, ["k", "less"]).where("a != b").select("a", "b").distinct()
    return found.select("a", F.col("h").alias("b")).unionByName(other)


def labels(tmp: shared.Scratch, linked: DataFrame) -> DataFrame:
    """(node, label) of what links connect, to be joined."""
    label = components(tmp, linked, "line-edges")
    return F.broadcast(label) if label.count() <= SMALL else label


def _apart_by(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends have different labels."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return pairs.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def open_pairs(tmp: shared.Scratch, lists: DataFrame, label: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b): pairs of a list's lines, without its pivot, that are in different components and may be similar.

    Near copies share nearly all their lists. A pair is left out where a smaller list holds both: that one makes it, since what
    else a pair must satisfy is the same in all. Only the first HEAD lists of a line are held against each other, so a row stays
    short however long its line is; two lines whose first shared list is none of these are made more than once.
    """
    own = lambda c: label.select(F.col("node").alias(f"_{c}"), F.col("label").alias(f"{c}_label"))
    members = lists.where("size > 2").select("block", "node", "pivot")  # a list of two has no other pair
    members = members.join(own("node"), F.col("node") == F.col("_node"), "left").join(own("pivot"), F.col("pivot") == F.col("_pivot"), "left")
    members = members.select("block", "node", "pivot", F.coalesce("node_label", "node").alias("label"), F.coalesce("pivot_label", "pivot").alias("center"))
    open_lists = members.where("label != center").select("block").distinct()
    members = tmp.written(members.where("node != pivot").join(open_lists, "block", "left_semi"), "open-lists")
    heads = tmp.written(members.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("block")), 1, HEAD).alias("head")), "open-nodes")
    wide = shared.marked(tmp, lines, "node", heads.select(F.col("node").alias("h"))).where("may").select("node", "norm")
    wide = tmp.written(sketched(wide, WIDE).join(heads, "node"), "wide-sketches")
    members = members.join(wide, "node")
    rest = members.where("label != center").alias("l").join(members.alias("r"), "block")
    once = (F.col("r.label") == F.col("r.center")) | (F.col("l.node") < F.col("r.node"))
    first = F.coalesce(F.array_min(F.array_intersect("l.head", "r.head")) >= F.col("block"), F.lit(True))
    rest = rest.where((F.col("l.label") != F.col("r.label")) & once & _near(WIDE) & first)
    return rest.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))


def links(tmp: shared.Scratch, lines: DataFrame) -> DataFrame:
    """(a, b): pairs of lines (node, norm) that connect all that similar lines connect, as a written table."""
    lists = lists_of(tmp, lines)
    near = near_pivots(tmp, lists, lines)
    stars = tmp.written(near.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("n")).select("a", "n.b"), "stars")
    linked = verified(tmp, stars, lines, "line-links")
    label = labels(tmp, linked)
    named = lambda: label.select(F.col("node").alias("a"), F.col("label").alias("b"))  # noqa: E731  in place of the links: of one step each
    # the other pivots of a line, where the nearest one has not led to them
    others = _apart_by(near.join(stars, ["a", "b"], "left_anti").select("a", "b").distinct(), label)
    linked = tmp.written(named().unionByName(verified(tmp, tmp.written(others, "other-pivots"), lines, "other-line-links")), "pivot-links")
    label = labels(tmp, linked)

    rest = tmp.written(open_pairs(tmp, lists, label, lines).distinct(), "rest")
    tmp.drop(lists, near)
    return tmp.written(named().unionByName(verified(tmp, rest, lines, "more-line-links")).unionByName(one_word_apart(tmp, lines)), "all-line-links")


def removed(tmp: shared.Scratch, docs: DataFrame) -> DataFrame:
    """doc, key and the positions `gone` of the lines to remove, for documents that lose any."""
    whole = tmp.written(numbered(tmp, docs), "line-texts")
    texts = whole.where("norm != ''")
    place = F.struct("doc", "key", "pos")
    nodes = texts.groupBy("node").agg(F.min(F.struct("doc", "key", "pos", "second")).alias("first"), F.count("*").alias("copies"))
    nodes = tmp.written(nodes, "distinct-lines")
    twice = tmp.written(nodes.where("copies > 1").select(F.col("node").alias("h")), "repeated-lines")
    # shorter lines are held equal; the others are read many times, so they are made distinct once
    lines = _distinct(tmp, texts.where(blanks(F.col("norm")) >= LEAST_WORDS - 2).select("node", "second", "norm"), "node", twice)
    lines = tmp.written(lines.select("node", "norm"), "lines")
    places = tmp.written(texts.select("doc", "key", "pos", "node", "second"), "line-places")  # of the texts, `lines` have all that is needed
    tmp.drop(whole)
    label = components(tmp, links(tmp, lines), "all-line-edges")
    tmp.drop(lines)

    named = tmp.written(label.select(F.col("node").alias("h")), "linked-lines")
    several = shared.marked(tmp, nodes.where("copies = 1"), "node", named).where("may").drop("may").unionByName(nodes.where("copies > 1"))
    known = several.join(label, "node", "left").where("copies > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "node"))
    kept = known.groupBy("label").agg(F.min("first").alias("kept"))
    known = known.select("node", F.col("first.second").alias("own"), "label").join(kept, "label").select("node", "own", F.struct("kept.doc", "kept.key", "kept.pos").alias("kept"))
    known = tmp.written(known, "kept")
    gone = shared.marked(tmp, places, "node", known.select(F.col("node").alias("h"))).where("may")
    gone = gone.join(known, "node").where((F.col("second") == F.col("own")) & ~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("doc", "key").agg(F.collect_set("pos").alias("gone"))


def judged(docs: DataFrame) -> DataFrame:
    """Struct r with all columns of docs, kept_text, n_lines and n_removed."""
    with shared.scratch(docs.sparkSession) as tmp:
        gone = shared.written(removed(tmp, docs), "gone")
    rows = shared.marked(shared.Scratch(docs.sparkSession), _rows(docs), "key", gone.select(F.col("key").alias("h")))
    gone = gone.select(F.col("doc").alias("d"), "key", "gone")
    rows = rows.withColumn("lines", F.split("text", "\n")).withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long"))
    hit = rows.where("may").join(gone, "key", "left").where("gone IS NULL OR doc <=> d")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    hit = hit.select("r", cut.alias("kept_text"), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return hit.unionByName(rows.where("NOT may").select("r", F.col("text").alias("kept_text"), "n_lines", F.lit(0).cast("long").alias("n_removed")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with the lines that stay, in all their columns."""
    done = judged(docs)
    return done.select(*(F.col("kept_text").alias("text") if c == "text" else F.col(f"r.`{c}`") for c in docs.columns))
