import random
import re
from collections import Counter

import cases
from pyspark.sql import functions as F
from lexstrata.llm import linededup, shared


def norm(line):
    return re.sub("[\\s\u00a0]+", " ", line.lower()).strip(" ")


def distance(x, y):
    while x and y and x[0] == y[0] and len(x) > 200:
        i = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        x, y = x[i:], y[i:]
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def naive(docs):
    """Kept texts by brute force over all pairs of lines."""
    occurrences = {}
    for i, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        for pos, line in enumerate((text or "").split("\n")):
            if norm(line):
                occurrences.setdefault(norm(line), []).append((i is not None, i or 0, text, pos))
    nodes = list(occurrences)
    bags = [Counter(x.split(" ")) for x in nodes]  # an edit takes one word away at most
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fuzzy = [i for i, x in enumerate(nodes) if len(x.split(" ")) >= 1]
    for k, i in enumerate(fuzzy):
        for j in fuzzy[:k]:
            a, b = len(nodes[i].split(" ")), len(nodes[j].split(" "))
            most = int(max(a, b) * 0.2)
            if abs(a - b) <= most and (bags[i] - bags[j]).total() <= most and distance(nodes[i].split(" "), nodes[j].split(" ")) <= most:
                root[find(i)] = find(j)
    keep = {}
    for i, x in enumerate(nodes):
        best = min(occurrences[x], key=lambda o: (o[0], o[1], o[3]))
        keep[find(i)] = min(keep.get(find(i), best), best, key=lambda o: (o[0], o[1], o[3]))
    kept = set(keep.values())
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for pos, x in enumerate(lines) if not norm(x) or (i is not None, i or 0, text, pos) in kept]
        out.append((i, None if text is None else "\n".join(stay)))
    return sorted(out, key=str)


def run(docs):
    return sorted(map(tuple, linededup.judged(docs).select("r.doc_id", "kept_text").collect()), key=str)


def test_near_and_equal_lines(spark):
    rng = random.Random(4)
    words = [f"w{i}{chr(97 + i % 26)}" for i in range(300)]
    pool = [rng.choices(words, k=rng.randint(1, 60)) for _ in range(40)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(pool))
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line).upper() if rng.random() < 0.2 else "  ".join(line))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = naive(rows)
    assert want != sorted(rows, key=str)
    assert run(docs) == want


def test_edge_cases(spark):
    docs = cases.table(spark)
    assert run(docs) == naive([r[:2] for r in cases.TEXTS])
    done = linededup.deduplicated(docs)
    assert done.columns == docs.columns and done.count() == len(cases.TEXTS)
    assert run(docs.limit(0)) == []


def test_repeated_row_and_near_line(spark):
    rng = random.Random(7)
    words = [f"w{i}{chr(97 + i % 26)}" for i in range(300)]
    rows = []
    while len(rows) < 24:
        line = rng.choices(words, k=40)
        near = [*line[:20], rng.choice(words), *line[21:]]
        if line != near:
            i = len(rows)
            rows += [(i, " ".join(line))] * 2 + [(i + 1, " ".join(near))]
    want = naive(rows)
    assert sum(text == "" for _, text in want) == len(rows) // 3
    assert run(rows_table := spark.createDataFrame(rows, "doc_id long, text string")) == want
    with shared.scratch(spark) as tmp:
        assert linededup.numbered(tmp, rows_table).count() == len(rows) * 2 // 3


def similar_only(docs):
    """Kept texts by brute force on edit similarity alone; ids are distinct and not null."""
    first = {}
    for i, text in docs:
        for pos, line in enumerate(text.split("\n")):
            first.setdefault(norm(line), (i, pos))
    nodes = list(first)
    words = [x.split(" ") for x in nodes]
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, x in enumerate(words):
        for j, y in enumerate(words[:k]):
            most = int(max(len(x), len(y)) * 0.2)
            if abs(len(x) - len(y)) <= most and distance(x, y) <= most:
                root[find(k)] = find(j)
    keep = {}
    for k, x in enumerate(nodes):
        keep[find(k)] = min(keep.get(find(k), first[x]), first[x])
    kept = set(keep.values())
    return sorted(((i, "\n".join(x for pos, x in enumerate(text.split("\n")) if (i, pos) in kept)) for i, text in docs), key=str)


def test_all_pairs_of_the_similarity(spark):
    rng = random.Random(11)
    words = [f"w{i}{chr(97 + i % 26)}" for i in range(60)]
    rows = []
    for n in [*range(1, 16), 19, 20, 24, 25, 33, 44, 60, 99, 100] * 2:
        line = rng.choices(words, k=n)
        near = list(line)
        edits = (n + 1) // 5 if rng.random() < 0.5 else n // 5
        for _ in range(edits):
            at, kind = rng.randrange(len(near)), rng.random()
            near[at : at + 1] = [rng.choice(words)] if kind < 0.5 else [near[at], rng.choice(words)] if kind < 0.8 else []
        rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(near))]
    want = similar_only(rows)
    assert sum(text == "" for _, text in want) > 20
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_plan_has_no_python(spark, sf):
    plan = linededup.judged(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_of_four_words(spark):
    """Equal to a line of five without one of its words; a word in the place of another is too much."""
    base = "alpha beta gamma delta"
    lines = [base, base + " epsilon", "alpha beta beta gamma delta", "new alpha beta gamma delta", "alpha beta gamma other", "alpha gamma beta delta", "a a a a", "a a a a a", "b b b", "b b b b", "alpha beta gamma"]
    rows = [(i, x) for i, x in enumerate(lines)] + [(90, base + " x"), (91, base + " x y")]
    want = similar_only(rows)
    assert [i for i, text in want if text == ""] == [1, 2, 3, 7, 90, 91]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_words_of_one_character_are_different(spark):
    """Three of ten words differ, two of which have the same character: too far apart, whatever the hash says."""
    words = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("w"))
    x, y = words.groupBy(linededup.symbols("w").alias("c")).agg(F.sort_array(F.collect_list("w")).alias("all")).where(F.size("all") > 1).orderBy("c").first()["all"][:2]
    same = "one two three four five six seven"
    rows = [(1, f"{same} {x} red blue"), (2, f"{same} {y} green grey"), (3, f"{same} {x} green blue")]
    kept = lambda rows: {r.doc_id: r.text for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept(rows[:2]) == dict(rows[:2])
    assert kept(rows[::2]) == {1: rows[0][1], 3: ""}
    assert kept(rows) == {1: rows[0][1], 2: "", 3: ""}  # by way of the third


def test_lines_around_one_passage(spark):
    """Most lines hold the same passage and are not similar; some are, and not by their nearest pivot alone."""
    rng = random.Random(8)
    words = [f"v{i}{chr(97 + i % 26)}" for i in range(400)]
    passage = rng.choices(words, k=30)
    lines = [rng.choices(words, k=rng.randint(8, 24)) + passage for _ in range(40)]
    lines += [[rng.choice(words) if rng.random() < 0.1 else w for w in x] + rng.choices(words, k=rng.randint(0, 3)) for x in lines[:20]]
    rows = [(i, " ".join(x)) for i, x in enumerate(lines)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == naive(rows) and 0 < sum(not text for _, text in got) <= 20


def test_sketches_never_drop_similar_lines(spark):
    """Edits and further words change as many cells of a sketch as the bound allows, at most."""
    rng = random.Random(9)
    words = [f"u{i}" for i in range(60)]
    pairs = []
    for _ in range(300):
        x = rng.choices(words, k=rng.randint(5, 60))
        y = list(x)
        for _ in range(rng.randint(1, len(x) // 5)):
            at, kind = rng.randrange(len(y)), rng.randrange(3)
            y[at : at + (kind > 0)] = [rng.choice(words)] if kind < 2 else []
        if distance(x, y) <= int(max(len(x), len(y)) * 0.2):
            pairs.append((2 * len(pairs), " ".join(x), " ".join(y)))
    lines = spark.createDataFrame([row for i, x, y in pairs for row in ((i, x), (i + 1, y))], "node long, norm string")
    for parts in (2, linededup.WIDE):
        rows = linededup.sketched(lines, parts)
        near = rows.alias("l").join(rows.alias("r"), F.col("r.node") == F.col("l.node") + 1).where(F.col("l.node") % 2 == 0).where(linededup._near(parts))
        assert near.count() == len(pairs) > 200


def test_lines_whose_word_pairs_repeat_by_chance_enter_no_list(spark):
    """All their pairs of words are common, but lines that are not similar share few triples; the counts are those of brute force."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    lines = [rng.choices(words, k=20) for _ in range(400)]
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "node long, norm string")
    pairs = Counter(p for x in lines for p in zip(x, x[1:]))
    assert sum(n == 1 for n in pairs.values()) < len(pairs) / 15
    with shared.scratch(spark) as tmp:
        assert linededup.lists_of(tmp, rows).count() < 40
    triples = Counter(p for x in lines for p in zip(x, x[1:], x[2:]))
    assert sorted(r.n for r in linededup.repeated_runs(rows).collect()) == sorted(n for n in triples.values() if n > 1)


def test_runs_are_counted_without_python(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c"), (3, "a b"), (4, "")], "node long, norm string")
    runs = linededup.repeated_runs(rows)
    assert not re.search("Python|Pandas|Arrow", runs._jdf.queryExecution().toString())
    # the runs of arrays (for the lists) and those of rows (for the counts) have the same hashes
    own = rows.select(F.explode(linededup.word_runs(F.split("norm", " "))).alias("h")).groupBy("h").count().where("count > 1")
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, own.collect())) and own.count() == 1


def test_lines_of_five_words_with_another_word_anywhere(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(500)]
    lines = [rng.choices(words, k=5) for _ in range(30)]
    lines += [[*x[: i % 5], rng.choice(words), *x[i % 5 + 1 :]] for i, x in enumerate(lines[:20])] + [x[:4] for x in lines[20:23]] + [[*x, "more"] for x in lines[15:28]]
    rows = [(i, " ".join(x)) for i, x in enumerate(lines)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == similar_only(rows) and sum(not text for _, text in got) == 36


def test_lines_meet_a_pivot_once_however_many_lists_they_share(spark):
    rng = random.Random(14)
    words = [f"w{i}" for i in range(5000)]
    lines = [rng.choices(words, k=40) for _ in range(20)]
    rows = [(100 * i + k, " ".join([*x[:k], "new", *x[k + 1 :]])) for i, x in enumerate(lines) for k in range(0, 40, 13)]
    lines = spark.createDataFrame(rows, "node long, norm string")
    with shared.scratch(spark) as tmp:
        lists = linededup.lists_of(tmp, lines)
        in_lists = lists.where("node != pivot").count()
        near = sorted((r.a, r.b) for r in linededup.near_pivots(tmp, lists, lines).collect())
    assert len(near) == len(set(near)) < in_lists / 4
    assert {a for a, _ in near} == {i for i, _ in rows if i % 100}


def test_pairs_of_open_lists_are_made_once(spark):
    """Near copies share many lists; a pair of two components comes from the first of them only, and none is lost."""
    rng = random.Random(15)
    words = [f"w{i}" for i in range(5000)]
    lines = []
    for _ in range(3):
        line = rng.choices(words, k=60)
        lines += [[rng.choice(words) if rng.random() < 0.1 else w for w in line] for _ in range(16)]
    texts = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "node long, norm string")
    label = spark.createDataFrame([], "node long, label long")  # no line is linked yet
    with shared.scratch(spark) as tmp:
        lists = linededup.lists_of(tmp, texts)
        held = {}
        for r in lists.where("node != pivot").collect():
            held.setdefault(r.block, []).append(r.node)
        got = sorted(map(tuple, linededup.open_pairs(tmp, lists, label, texts).collect()))
    shared_lists = Counter((a, b) for x in held.values() for a in x for b in x if a < b)
    near = sorted(p for p in shared_lists if distance(lines[p[0]], lines[p[1]]) <= 12)
    assert len(got) == len(set(got)) and set(near) <= set(got) <= set(shared_lists)
    assert len(near) > 100 and sum(shared_lists[p] for p in got) > 5 * len(got)
