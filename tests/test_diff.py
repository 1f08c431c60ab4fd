import random
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexstrata.functions import worddiff
from lexstrata.operators import annotations as notes
from lexstrata.operators import diff, match
from lexstrata.sources import uslm
from pyspark.sql import functions as F
from test_uslm import section, usc


def read(spark, folder: Path, xml: str, date: str):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "a.xml").write_text(xml)
    return uslm.read_uslm(spark, str(folder), date)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ab c\n ", max_size=30), st.text("ab c\n ", max_size=30))
def test_word_edits_are_shortest_and_rebuild_both(old, new):
    a, b = worddiff.tokens(old), worddiff.tokens(new)
    assert "".join(a) == old
    edits = worddiff.edits(a, b)
    gone, come = {e[1] for e in edits if e[3] == "delete"}, {e[2] for e in edits if e[3] == "insert"}
    assert [t for i, t in enumerate(a) if i not in gone] == [t for i, t in enumerate(b) if i not in come]
    assert len(edits) == len(a) + len(b) - 2 * lcs(a, b)
    assert all(v == (a[i] if t == "delete" else b[j]) for v, i, j, t in edits)


def test_a_rewritten_section_takes_linear_space():
    old, new = [[f"{side}{i // 2}" if i % 3 else " " for i in range(10_000)] for side in "ab"]
    began = time.process_time()
    edits = worddiff.edits(old, new)
    assert time.process_time() - began < 20 and len(edits) >= 2 * 6_600


def test_published_word_index():
    old = "In the case of a taxpayer's specified research or experimental expenditures"
    got = worddiff.edits(worddiff.tokens(old), worddiff.tokens(old.replace("specified", "foreign")))
    assert got == [("specified", 12, None, "delete"), ("foreign", None, 12, "insert")]


def test_changes_added_removed_and_pruning(spark, tmp_path):
    old = usc(section(1, "<content>one two</content>") + section(2) + section(3, section("3a")))
    new = usc(section(1, "<content>one 2</content>" + section("1a")) + section(2, section("2a")) + section(3) + section(4))
    a, b = read(spark, tmp_path / "a", old, "2025-07-18"), read(spark, tmp_path / "b", new, "2025-07-30")
    d = diff.compute_diff(a, b)
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(d.nodes) == ["uscode", "uscode/section_1"]
    assert paths(d.added) == ["uscode/section_1/section_1a", "uscode/section_4"] and paths(d.removed) == []
    change = d.field_changes.first()
    assert [(c.value, c.old_index, c.new_index, c.tag) for c in change.changes] == [("two", 2, None, "delete"), ("2", None, 2, "insert")]
    assert str(change.from_date) == "2025-07-18" and str(change.to_date) == "2025-07-30"
    full = diff.compute_diff(a, b, prune="complete")
    assert paths(full.added) == ["uscode/section_1/section_1a", "uscode/section_2/section_2a", "uscode/section_4"] and paths(full.removed) == ["uscode/section_3/section_3a"]
    assert paths(d.find("uscode/section_1")) == ["uscode/section_1"] and d.find("").count() == 0
    assert {r.path: (r.n_changes, r.n_added) for r in d.changed_nodes().collect()} == {"uscode": (0, 1), "uscode/section_1": (1, 1)}


def recursive(old, new):
    """The tree difference spelled out on nested nodes: {name: (text, [children])}, the last of equal names wins."""

    def go(path, a, b):
        own = {"changed": a[0] != b[0], "path": path, "added": [], "removed": [], "kids": []}
        x, y = dict(a[1]), dict(b[1])
        for k in x:
            if k not in y:
                own["removed"].append(f"{path}/{k}")
            elif (kid := go(f"{path}/{k}", x[k], y[k])) and (kid["changed"] or kid["kids"]):
                own["kids"].append(kid)
        own["added"] = [f"{path}/{k}" for k in y if k not in x]
        return own

    def flat(n):
        yield n
        for k in n["kids"]:
            yield from flat(k)

    nodes = list(flat(go("r", old, new)))
    return sorted(n["path"] for n in nodes), sorted(p for n in nodes for p in n["added"]), sorted(p for n in nodes for p in n["removed"])


def test_parts_read_one_table(spark, tmp_path):
    """Each part of a difference reads the compared rows; none joins the snapshots again."""
    a, b = (read(spark, tmp_path / n, usc(section(1, f"<content>{n}</content>")), "2025-07-18") for n in "ab")
    d = diff.compute_diff(a, b)
    for part in (d.nodes, d.added, d.removed, d.changed_nodes()):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan and "FullOuter" not in plan.split("InMemoryRelation")[0]
    d.release()


def test_ranks_of_many_ties(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("score"), "id").repartition(7)
    got = {r.id: r.rank for r in notes.ranked(rows, F.desc("score"), "id").collect()}
    want = sorted(range(5000), key=lambda i: (-(i % 3), i))
    assert [got[i] for i in want] == list(range(1, 5001))


def test_against_a_recursive_model(spark):
    rng = random.Random(8)

    def grow(depth):
        kids = [(f"k_{rng.randint(0, 3)}", grow(depth - 1)) for _ in range(rng.randint(0, 4))] if depth else []
        return rng.choice("xy"), kids

    def rows(n, node, date):
        out = []

        def go(path, node, up, at, shadowed):
            out.append((n, date, path, up[-1] if up else None, up, at, shadowed, "title", node[0]))
            last = {k: i for i, (k, _) in enumerate(node[1])}
            for i, (k, kid) in enumerate(node[1]):
                go(f"{path}/{k}", kid, [*up, path], [*at, i], shadowed or last[k] != i)

        go("r", node, [], [], False)
        return out

    ddl = "snapshot_date string, path string, parent_path string, ancestor_paths array<string>, ord_path array<int>, shadowed boolean, element_type string, content string"
    old, new, want = [], [], [[], [], []]
    for n in range(60):
        a, b = grow(3), grow(3)
        fix = lambda r, n: (r[1], f"{n}:{r[2]}", r[3] and f"{n}:{r[3]}", [f"{n}:{p}" for p in r[4]], *r[5:])
        old += [fix(r, n) for r in rows(n, a, "1")]
        new += [fix(r, n) for r in rows(n, b, "2")]
        for k, part in enumerate(recursive(a, b)):
            want[k] += [f"{n}:{p}" for p in part]
    blank = {c: F.lit(None).cast("string") for c in ("heading", "chapeau", "proviso", "continuation")}
    d = diff.compute_diff(*(spark.createDataFrame(r, ddl).withColumns(blank) for r in (old, new)))
    for part, expected in zip((d.nodes, d.added, d.removed), want):
        assert sorted(r.path for r in part.select("path").collect()) == sorted(expected)


def test_similarity(spark):
    change = lambda *words: [(w, None, 0, "insert") for w in words]
    changes = spark.createDataFrame([("p", change("Foreign", " ", "the", "domestic,")), ("q", change("nothing"))], "path string, changes array<struct<value: string, old_index: int, new_index: int, tag: string>>")
    diffs = spark.createDataFrame([("a1", 0, ["foreign"], []), ("a1", 1, ["FOREIGN"], ["domestic,"]), ("a2", 0, ["foreign", "domestic,"], []), ("a3", 0, ["the"], [])], "amendment_id string, diff_ordinal int, added array<string>, removed array<string>")
    got = match.best_amendments(changes, diffs).collect()
    assert [tuple(r) for r in got] == [("p", "a1", 1.0, 1.0, 1.0, 2, 2)]


@pytest.mark.parametrize("text,want", [("Section 45F(c)(1)(A)(iii) is", "Section 45F(c)(1)(A)(iii) "), ("Section 45F(", "Section 45F("), ("section 45F. Section 45F(c) x", "section 45F."), ("Section 45", None), ("in section45Fx", "section45Fx"), ("Section 45FG", "Section 45FG")])
def test_mentions(spark, text, want):
    paths = spark.createDataFrame([("uscode/title_26/section_45F/subsection_c/paragraph_1/subparagraph_A/clause_iii",), ("uscode/title_26",)], "path string")
    got = match.mentions(paths, spark.createDataFrame([("a", text)], "amendment_id string, amending_text string")).collect()
    assert [r.matched_text for r in got] == ([want] if want else [])
