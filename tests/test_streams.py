import json

import pytest
from lexstrata.plans.catalog import Dataset
from lexstrata.streaming import ingest
from test_uslm import section, usc


def write(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("annotation_id", "status", "seq"), r, strict=True))) for r in rows))


def test_upserts_of_a_restarted_stream_are_those_of_one_batch(spark, tmp_path, monkeypatch):
    """Late rows lose; a batch that is run again after its commit changes nothing."""
    ddl = "annotation_id long, status string, seq long"
    parts = [[(1, "Verified", 5), (2, "Disputed", 1), (1, "Disputed", 4)], [(1, "Rejected", 3), (3, "Verified", 9)], [(2, "Verified", 7), (3, "Disputed", 8), (4, "Rejected", 1)]]
    d = Dataset(spark, str(tmp_path / "d"))
    ids = [1, 2, 3, 4]
    (tmp_path / "in").mkdir()
    d.add_annotations(spark.createDataFrame([(i, *[None] * 13) for i in ids], d.table("annotations").schema))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    start = lambda: ingest.ingest_upserts(d, "statuses", stream, str(tmp_path / "check"), "updates")
    write(tmp_path / "in", 0, parts[0])
    start().awaitTermination()
    write(tmp_path / "in", 1, parts[1])
    plain = Dataset.upsert

    def broken(self, *args, **kwargs):
        plain(self, *args, **kwargs)
        raise RuntimeError("after the commit")

    monkeypatch.setattr(Dataset, "upsert", broken)
    with pytest.raises(Exception, match="after the commit"):
        start().awaitTermination()
    monkeypatch.setattr(Dataset, "upsert", plain)
    write(tmp_path / "in", 2, parts[2])
    start().awaitTermination()
    assert d.table("statuses").count() == sum(map(len, parts)) and d.commits.marks() == {"updates": 2}
    whole = Dataset(spark, str(tmp_path / "whole"))
    whole.add_annotations(d.table("annotations"))
    whole.upsert("statuses", spark.createDataFrame([r for p in parts for r in p], ddl))
    got, want = ({r.annotation_id: r.status for r in x.all_annotations().collect()} for x in (d, whole))
    assert got == want == {1: "Verified", 2: "Verified", 3: "Verified", 4: "Rejected"}
    with pytest.raises(ValueError, match="no key"):
        d.upsert("annotations", d.table("annotations"))


def test_late_snapshots_take_their_place(spark, tmp_path):
    def drop(date, word, name="t.xml"):
        (tmp_path / "in" / date).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / date / name).write_text(usc(section(1, f"<content>{word}</content>")) if word else "<bad")

    d = Dataset(spark, str(tmp_path / "d"))
    start = lambda: ingest.ingest_snapshots(d, str(tmp_path / "in"), str(tmp_path / "check"))
    drop("2025-07-30", "new")
    drop("2025-07-29", None, "bad.xml")
    start().awaitTermination()
    drop("2025-07-18", "old")
    drop("2025-07-30", "again", "z.xml")
    start().awaitTermination()
    assert [(r.snapshot_date, r.label) for r in d.versions.collect()] == [("2025-07-18", "t.xml"), ("2025-07-30", "t.xml"), ("2025-07-30", "z.xml")]
    with d.compute_diff("2025-07-18", "2025-07-30") as changes:
        assert [(r.old_value, r.new_value) for r in changes.field_changes.collect()] == [("old", "new")]
    start().awaitTermination()
    assert d.versions.count() == 3 and d.table("elements").count() == 6
