from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from lexstrata import schema
from lexstrata.operators import diff
from lexstrata.plans import commits
from lexstrata.plans.catalog import Dataset
from lexstrata.sources import uslm
from pyspark.sql import functions as F
from test_uslm import section, usc

DDL = "k long"


def rows(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], DDL)


def values(c, table="t"):
    return sorted(r.k for r in c.read(table, DDL).collect())


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    c = commits.Commits(spark, str(tmp_path))
    assert c.latest() == (0, {}) and values(c) == []
    first = {"t": [c.write("t", rows(spark, 1, 2))], "u": [c.write("u", rows(spark, 9))]}
    assert values(c) == values(c, "u") == []
    assert c.commit(first) == 1 and values(c) == [1, 2] and values(c, "u") == [9]
    c.write("t", rows(spark, 3))  # and nothing after it
    bad = rows(spark, 4).select(F.raise_error(F.lit("broken")).cast("long").alias("k"))
    with pytest.raises(Exception, match="broken"):
        c.write("t", bad)
    (tmp_path / "_commits/.half").write_text("{")
    assert values(c) == [1, 2] and c.latest()[0] == 1
    with pytest.raises(commits.CommitConflict):
        c.commit({}, frozenset(["t/none"]))


def test_a_broken_snapshot_leaves_no_trace(spark, tmp_path):
    (tmp_path / "a.xml").write_text(usc(section(1)))
    d = Dataset(spark, str(tmp_path / "d"))
    whole = uslm.read_uslm(spark, str(tmp_path / "a.xml"), "2025-07-18").drop("source", "error")
    with pytest.raises(Exception, match="broken"):
        d.add_version("2025-07-18", whole.withColumn("heading", F.when(F.col("depth") == 1, F.raise_error(F.lit("broken"))).cast("string")))
    assert d.versions.count() == d.all_elements().count() == d.table("elements").count() == 0
    d.add_version("2025-07-18", whole)
    assert d.versions.count() == 1 and d.all_elements().count() == 2


def test_writers_that_meet(spark, tmp_path):
    c = commits.Commits(spark, str(tmp_path))
    parts = [c.write("t", rows(spark, k)) for k in range(6)]
    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(lambda p: commits.Commits(spark, str(tmp_path)).commit({"t": [p]}), parts))
    assert sorted(numbers) == list(range(1, 7)) and values(c) == list(range(6))


def test_many_updates_are_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits.Commits.compact, "__defaults__", (4,))
    d = Dataset(spark, str(tmp_path / "d"))
    own = d.annotate("f", "t", "amend", "b", "a1", ["p"], "human:me")
    for k in range(14):
        d.set_status(own, ("Verified", "Disputed")[k % 2])
    assert [r.status for r in d.all_annotations().collect()] == ["Disputed"]
    assert len(d.commits.latest()[1]["statuses"]) <= 5 and d.table("statuses").count() == 14
    assert len(d.table("statuses").inputFiles()) <= 5
    before = len(list(Path(tmp_path / "d/statuses").iterdir()))
    assert d.commits.vacuum(keep=1) > 0
    assert len(list(Path(tmp_path / "d/statuses").iterdir())) < before and d.table("statuses").count() == 14
    d.set_statuses(spark.createDataFrame([(own, "Rejected"), (5, "Verified")], "annotation_id long, status string"))
    assert [r.status for r in d.all_annotations().collect()] == ["Rejected"]
    with pytest.raises(Exception, match="unknown status"):
        d.set_statuses(spark.createDataFrame([(own, "Done")], "annotation_id long, status string"))


def title(n, *sections):
    return f'<title identifier="/t{n}"><num value="{n}">Title {n}</num>{"".join(sections)}</title>'


@pytest.fixture
def dataset(spark, tmp_path):
    """Five titles; the second one has a changed text, the third one lost a section, the fifth one a text that became empty."""
    word = lambda w: section(1, f"<content>{w}</content>")
    before = [title(1, word("a"), section(2)), title(2, word("b"), section(2)), title(3, word("c"), section(2)), title(4, word("d")), title(5, word(""))]
    after = [before[0], title(2, word("other"), section(2)), title(3, word("c")), before[3], title(5, section(1))]
    d = Dataset(spark, str(tmp_path / "d"))
    for date, titles in (("2025-07-18", before), ("2025-07-30", after)):
        (tmp_path / date).mkdir()
        (tmp_path / date / "t.xml").write_text(usc("".join(titles)))
        d.add_uslm_xml(str(tmp_path / date), date)
    return d


def test_equal_titles_are_not_compared(spark, dataset):
    old, new = dataset.elements("2025-07-18"), dataset.elements("2025-07-30")
    assert sorted(diff.differing_tops(old, new)) == ["uscode/title_2", "uscode/title_3"]
    changes = dataset.compute_diff("2025-07-18", "2025-07-30")
    plan = changes.compared._jdf.queryExecution().optimizedPlan().toString() + changes.nodes._jdf.queryExecution().executedPlan().toString()
    seen = {r.path for r in changes.compared.collect()}
    assert "top" in plan and seen == {"uscode"} | {f"uscode/title_{n}{s}" for n in (2, 3) for s in ("", "/section_1", "/section_2")}
    plain = diff.compute_diff(old.drop("tree_hash"), new.drop("tree_hash"))
    for part in ("nodes", "field_changes", "added", "removed", "errors"):
        assert sorted(map(str, getattr(changes, part).collect())) == sorted(map(str, getattr(plain, part).collect())), part
    assert sorted(map(str, changes.changed_nodes().collect())) == sorted(map(str, plain.changed_nodes().collect()))


def test_hashes_read_no_texts(spark, dataset):
    old = dataset.elements("2025-07-18")
    plan = old.where("depth = 1").select("path", "tree_hash")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "ReadSchema" in plan
    text = old.where(F.col("top").isin("", "uscode/title_2")).select("content")._jdf.queryExecution().executedPlan().toString()
    assert "In(top" in text.partition("PushedFilters")[2]


def test_many_tops_are_compared_whole(dataset, monkeypatch):
    monkeypatch.setattr(diff, "MOST_TOPS", 1)
    assert diff.differing_tops(dataset.elements("2025-07-18"), dataset.elements("2025-07-30")) is None
    with dataset.compute_diff("2025-07-18", "2025-07-30") as changes:
        assert [(r.path, r.new_value) for r in changes.field_changes.collect()] == [("uscode/title_2/section_1", "other")]
        assert [r.path for r in changes.removed.collect()] == []
    assert not changes.compared.is_cached


def test_snapshots_in_buckets_are_compared_where_they_are(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "d"), buckets=4)
    for date, word in (("2025-07-18", "a"), ("2025-07-30", "b")):
        (tmp_path / f"{date}.xml").write_text(usc("".join(title(n, *(section(k, f"<content>{word if k == 3 else 'same'}</content>") for k in range(9))) for n in range(3))))
        d.add_uslm_xml(str(tmp_path / f"{date}.xml"), date)
    assert spark.catalog.listTables() == []
    old, new = d.elements("2025-07-18"), d.elements("2025-07-30")
    assert old.count() == new.count() == 31 and len(old.inputFiles()) == 4
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = diff.matched(old, new)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with d.compute_diff("2025-07-18", "2025-07-30") as changes:
        assert sorted(r.path for r in changes.field_changes.collect()) == [f"uscode/title_{n}/section_3" for n in range(3)]
    history = d.find_element("uscode/title_1/section_3")
    assert [r.content for r in history.collect()] == ["a", "b"]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that plans say what they skip
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        assert d.find_element("uscode/title_1/section_3")._jdf.queryExecution().executedPlan().toString().count("SelectedBucketsCount: 1 out of 4") == 2
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    plain = Dataset(spark, str(tmp_path / "plain"))
    plain.add_version("2025-07-18", old)
    assert sorted(map(str, plain.elements("2025-07-18").collect())) == sorted(map(str, old.collect()))


def test_a_search_reads_the_files_that_can_hold_a_hit(spark, tmp_path):
    body = "".join(section(k, f"<heading>Über Straße {k} İx</heading><content>{'needle ' if k == 77 else ''}filler {'ab' * (k % 3)}</content>") for k in range(100, 130))
    body = body + section(77, "<content>The NEEDLE lies here \U0001f600\U0001f601\U0001f602</content>")
    (tmp_path / "a.xml").write_text(usc(body))
    plain, quick = Dataset(spark, str(tmp_path / "p")), Dataset(spark, str(tmp_path / "q"), indexed=True, file_rows=4)
    for d in (plain, quick):
        d.add_uslm_xml(str(tmp_path / "a.xml"), "2025-07-18")
        d.add_version("2025-07-30", d.elements("2025-07-18").where("path not like '%77'").withColumn("snapshot_date", F.lit("2025-07-30").cast("date")))
    assert len(quick.all_elements().inputFiles()) >= 14
    for query in ("needle", "NEEDLE lies", "über", "STRASSE", "straße 10", "İX", "i̇x", "ab", "x", "", "nowhere at all", "\U0001f600\U0001f601\U0001f602", "FILLER abab"):
        want, got = ([tuple(r) for r in d.search_text(query).collect()] for d in (plain, quick))
        assert got == want, query
    assert sum("/elements/" in f for f in quick.candidates(["needle"]).inputFiles()) == 1 and quick.candidates(["nowhere"]).count() == 0
    want, got = (sorted(r.path for r in d.containing_all("content", ["FILLER", "ABAB"]).collect()) for d in (plain, quick))
    assert got == want and len(got) == 20
    quick.indexed = False
    quick.add_version("2025-08-01", plain.elements("2025-07-18"))  # without an index it is read whole
    assert quick.search_text("needle").count() == 2


def test_a_member_and_a_sponsor_by_key(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "d"))
    for state in ("OH", "NY"):
        d.add_members(spark.createDataFrame([("A1", "A", "A", "A", "D", state, 1, "House", None), (f"B-{state}", "B", "B", "B", "R", state, 2, "House", None)], schema.MEMBERS))
        d.add_sponsors(spark.createDataFrame([("119-1-hr", f"A-{state}", []), (f"119-2-{state}", "B", [])], schema.SPONSORS))
    assert [(r.bioguide_id, r.state) for r in d.member("A1").collect()] == [("A1", "NY")] and d.member("C").isEmpty()
    assert [(r.bill_id, r.sponsor) for r in d.sponsor("119-1-hr").collect()] == [("119-1-hr", "A-NY")] and d.sponsor("119-3-hr").isEmpty()
