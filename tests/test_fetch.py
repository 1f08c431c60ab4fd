import json
from pathlib import Path

import pytest
from lexstrata.plans.catalog import Dataset
from lexstrata.sources import congress, fetch


def offline():
    """Bills 119-hr-1 to 9 and members; 5 has no law text, 7 fails twice, then answers."""
    tries = {}

    def get(path):
        tries[path] = tries.get(path, 0) + 1
        if path.startswith("bill/119/hr/7") and tries[path] < 3:
            return (429, "")
        if path.startswith("member/"):
            who = path.rpartition("/")[2]
            return (404, "") if who == "GONE" else (200, json.dumps({"member": {"bioguideId": who, "firstName": "A", "lastName": who}}))
        if path.startswith("http"):
            return 200, f"<pLaw><p role='instruction'>amend {path[-1]}</p></pLaw>"
        n = path.split("/")[3]
        if path.endswith("/cosponsors"):
            return 200, json.dumps({"cosponsors": [{"bioguideId": "B1"}, {"bioguideId": "GONE"}]})
        if path.endswith("/text"):
            form = {"type": "United States Legislative Markup", "url": f"http://x/{n}"}
            return 200, json.dumps({"textVersions": [{"type": "Enrolled", "formats": [form]}, {"type": "Public Law" if n != "5" else "Other", "formats": [{"type": "PDF"}, form]}]})
        return 200, json.dumps({"bill": {"sponsors": [{"bioguideId": f"A{n}"}]}})

    return get


def test_data_source(spark):
    fetch.register(spark)
    bills = spark.read.format("congress_bills").option("transport", "test_fetch:offline").option("ids", "119-hr-1, 119-hr-2,119-hr-7,119-hr-1").option("perTask", 2).option("pause", 0).load()
    assert bills.rdd.getNumPartitions() == 2
    got = {r.bill_id: r for r in bills.collect()}
    assert sorted(got) == ["119-hr-1", "119-hr-2", "119-hr-7"] and all(r.error is None for r in got.values())
    assert sorted(got["119-hr-2"].member_jsons) == ["A2", "B1"] and "amend 2" in got["119-hr-2"].bill_xml
    members = spark.read.format("congress_members").option("transport", "test_fetch:offline").option("ids", "A1,GONE").option("mode", "permissive").load()
    assert [r.name for r in congress.shred_members(members).collect()] == ["A A1"]
    assert [r.error.code for r in members.where("error IS NOT NULL").collect()] == ["not_found"]
    with pytest.raises(Exception, match="not_found"):
        spark.read.format("congress_members").option("transport", "test_fetch:offline").option("ids", "GONE").load().collect()
    with pytest.raises(Exception, match="option ids"):
        spark.read.format("congress_members").load().collect()


def test_table_of_ids(spark, tmp_path):
    ids = spark.createDataFrame([(f"119-hr-{n}",) for n in (1, 2, 5, 7, 1)] + [("hr 1",), (None,)], "bill_id string")
    rows = fetch.bills(ids, offline, "PERMISSIVE", partitions=3, pause=0)
    assert rows.rdd.getNumPartitions() == 3
    got = {r.bill_id: r.error and r.error.code for r in rows.collect()}
    assert got == {"119-hr-1": None, "119-hr-2": None, "119-hr-5": "not_found", "119-hr-7": None, "hr 1": "parse", None: "parse"}
    with pytest.raises(Exception, match="rate_limited"):
        fetch.bills(ids.where("bill_id = '119-hr-7'"), offline, retries=1, pause=0).collect()
    d = Dataset(spark, str(tmp_path / "laws"), "laws")
    d.load_bill_downloads(rows.where("error IS NULL").drop("error"))
    assert d.bill("119-hr-2").first().amending_text == "amend 2" and d.members.count() == 4


def test_one_task_equals_the_client(spark):
    one = congress.CongressClient(offline()).download_bill(spark, "119-hr-1").first().asDict()
    many = fetch.bills(spark.createDataFrame([("119-hr-1",)], "bill_id string"), offline).drop("error").first().asDict()
    assert one == many


def test_cached_answers(spark, tmp_path):
    ids = spark.createDataFrame([("A1",), ("A2",)], "bioguide_id string")
    assert fetch.members(ids, offline, cache=str(tmp_path)).count() == 2
    assert sorted(p.name for p in Path(tmp_path).glob("*")) == ["member_A1", "member_A2"]


@pytest.mark.parametrize(("text", "want"), [("{}", None), ("[]", None), ('{"textVersions": [7, {"type": "Public Law", "formats": [{"type": "United States Legislative Markup"}]}]}', None)])
def test_odd_json(text, want):
    assert fetch.markup_url(text) == want
    with pytest.raises(congress.CongressError):
        fetch.markup_url("{")


def test_ids_of_few_bytes_are_dealt_over_all_tasks(spark):
    """Adaptive execution would join partitions by the bytes of the ids; answers are fetched in all of them."""
    from pyspark.sql import functions as F

    from lexstrata.queries import _answers

    ids = spark.range(1, 401).select(F.format_string("119-hr-%d", "id").alias("bill_id"))
    got = fetch.bills(ids.unionByName(ids), _answers, "PERMISSIVE").select("bill_id", F.spark_partition_id().alias("task")).collect()
    assert len(got) == len({r.bill_id for r in got}) == 400
    assert len({r.task for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
