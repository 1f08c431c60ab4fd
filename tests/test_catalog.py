import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from lexstrata.operators import diff, versions
from lexstrata.plans.catalog import Dataset, VersionNotFound
from lexstrata.sources import congress, uslm
from lexstrata.streaming.ingest import ingest
from pyspark.sql import functions as F
from test_uslm import section, usc

MEMBER = {"member": {"bioguideId": "L1", "firstName": "Pat", "lastName": "Lee", "partyHistory": [{"partyAbbreviation": "D"}], "terms": [{"chamber": "House", "congress": 1, "stateCode": "NY", "district": 3, "startYear": 1}, {"chamber": "Senate", "stateCode": "VT"}]}}


@pytest.fixture
def dataset(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "data"), "laws", "d", "a")
    for date, word in (("2025-07-30", "foreign"), ("2025-07-18", "specified")):
        (tmp_path / date).mkdir()
        (tmp_path / date / "t.xml").write_text(usc(section(174, f"<content>any {word} cost</content>") + section(175)))
        d.add_uslm_xml(str(tmp_path / date), date, "After" if word == "foreign" else "Before")
    return d


def test_versions_and_diff(dataset):
    assert [r.snapshot_date for r in dataset.versions.collect()] == ["2025-07-18", "2025-07-30"]
    v = dataset.table("versions")
    assert versions.next_version(v, "2025-07-18").first().label == "After" and versions.next_version(v, "2025-07-30").count() == 0
    assert versions.prev_version(v, "2025-07-30").first().label == "Before" and versions.prev_version(v, "x").count() == 0
    assert versions.first_two(v) == ("2025-07-18", "2025-07-30") and versions.by_label(v, "After").count() == 1
    assert dataset.find_element("uscode/section_174").count() == 2 and dataset.search_text("FOREIGN").count() == 1
    assert dataset.compute_diff("2025-07-18", "2025-07-30").field_changes.count() == 1
    with pytest.raises(VersionNotFound):
        dataset.compute_diff("2025-07-18", "2025-08-01")


def test_bills_annotations_and_sponsors(spark, dataset, tmp_path):
    bill = '<b><p role="instruction">Section 174 is amended<amendingAction type="amend"/></p></b>'
    row = ("119-hr-1", bill, '{"bill": {"sponsors": [{"bioguideId": "L1"}]}}', '{"cosponsors": [{"bioguideId": "X", "sponsorshipWithdrawnDate": "2025"}]}', {"a": json.dumps(MEMBER), "b": "{}"}, None)
    dataset.load_bill_downloads(spark.createDataFrame([row], congress.schema.DOWNLOADS))
    own = dataset.bill("119-hr-1").first()
    assert dataset.add_bill_diff(own.amendment_id, ["foreign"], ["specified"]) and not dataset.add_bill_diff("none", [], [])
    changes = dataset.compute_diff("2025-07-18", "2025-07-30")
    assert [(r.path, r.score) for r in dataset.best_amendments(changes).collect()] == [("uscode/section_174", 1.0)]
    assert [r.matched_text for r in dataset.mentions(changes).collect()] == ["Section 174 "]
    path = "uscode/section_174"
    assert [r.path for r in dataset.unannotated_paths("2025-07-18", "2025-07-30").collect()] == [path]
    dataset.annotate("2025-07-18", "2025-07-30", "strikeAndInsert", "119-hr-1", own.amendment_id, [path], "human:me", confidence=0.9)
    assert dataset.unannotated_paths("2025-07-18", "2025-07-30").count() == 0
    note = dataset.annotations("2025-07-18", "2025-07-30").first()
    assert (note.operation, note.status) == ("strike_and_insert", "Pending")
    assert [(r.name, r.party, r.state, r.chamber, r.district) for r in dataset.sponsors_for_path(path).collect()] == [("Pat Lee", "Democrat", "VT", "Senate", None)]
    with pytest.raises(ValueError, match="unknown amending action"):
        dataset.annotate("a", "b", "explain", "", "", [], "x")
    dataset.export_json(str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/annotations")).count() == 1


def test_snapshots_of_one_date(spark, dataset, tmp_path):
    """They are kept apart; lookups and differences take the one added first."""
    (tmp_path / "again").mkdir()
    (tmp_path / "again/t.xml").write_text(usc(section(174, "<content>other</content>") + section(175)))
    dataset.add_uslm_xml(str(tmp_path / "again"), "2025-07-18", "Again")
    assert dataset.elements("2025-07-18").count() == 3 and dataset.find_element("uscode/section_174").count() == 3
    assert [r.old_value for r in dataset.compute_diff("2025-07-18", "2025-07-30").field_changes.collect()] == ["any specified cost"]
    # a snapshot whose row is missing is not seen
    dataset._append("elements", dataset.elements("2025-07-18").selectExpr("*", "'2025-07-18' AS version", "7L AS seq"))
    assert dataset.find_element("uscode/section_174").count() == 3


def test_only_a_missing_table_is_empty(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "d"))
    assert d.table("members").count() == 0
    d.path = "nosuchscheme://x"
    with pytest.raises(Exception, match="(?i)scheme"):
        d.table("members").count()


def test_statuses_and_replaced_changes(spark, dataset):
    dataset.add_bill(spark.createDataFrame([("b", "a1", ["amend"], "t", 0)], congress.schema.AMENDMENTS))
    assert dataset.amendment("a1").first().bill_id == "b" and dataset.amendment("zz").count() == 0
    values = lambda: [(r.diff_ordinal, r.added) for r in dataset.bill_diffs.orderBy("diff_ordinal").collect()]
    assert dataset.add_bill_diff("a1", ["x"], []) and dataset.add_bill_diff("a1", ["y"], [])
    assert values() == [(0, ["x"]), (1, ["y"])]
    assert dataset.replace_bill_diffs("a1", [(["z"], ["w"])]) and not dataset.replace_bill_diffs("zz", [])
    assert dataset.add_bill_diff("a1", ["v"], []) and values() == [(0, ["z"]), (1, ["v"])]
    assert dataset.replace_bill_diffs("a1", []) and values() == []
    assert dataset.add_bill_diff("a1", ["u"], []) and values() == [(0, ["u"])]
    own = dataset.annotate("f", "t", "amend", "b", "a1", ["p"], "human:me")
    assert dataset.set_status(own, "Disputed") and dataset.set_status(own, "Verified") and not dataset.set_status(1, "Verified")
    assert [r.status for r in dataset.annotations("f", "t").collect()] == ["Verified"]
    with pytest.raises(ValueError, match="status"):
        dataset.set_status(own, "Done")
    dataset.add_annotations(dataset.all_annotations())
    assert dataset.annotations("f", "t").count() == 2


def test_save_and_load(spark, dataset, tmp_path):
    own = dataset.annotate("2025-07-18", "2025-07-30", "amend", "b", "a1", ["p"], "human:me", confidence=0.5)
    dataset.set_status(own, "Verified")
    dataset.export_json(str(tmp_path / "json"))
    again = Dataset.load_json(spark, str(tmp_path / "json"), str(tmp_path / "again"))
    for name in ("versions", "elements", "annotations", "statuses", "metadata", "members"):
        assert sorted(map(str, again.table(name).collect())) == sorted(map(str, dataset.table(name).collect()))
    assert again.compute_diff("2025-07-18", "2025-07-30").field_changes.count() == 1


def test_pair_and_roots(spark, tmp_path):
    for name, body in (("a", section(1, "<content>x</content>")), ("b", section(1, "<content>y</content>"))):
        (tmp_path / f"{name}.xml").write_text(usc(body))
    (tmp_path / "law.xml").write_text('<pLaw><meta><congress>119</congress><docNumber>21</docNumber></meta><preface><docNumber>119-21</docNumber></preface></pLaw>')
    d = Dataset.pair_diff(spark, str(tmp_path / "a.xml"), str(tmp_path / "b.xml"), "2025-07-18", "2025-07-30")
    assert [r.path for r in d.changed_nodes().collect()] == ["uscode/section_1"] and d.shallow("uscode").count() == 1
    d.release()
    with pytest.raises(diff.PathMismatch, match="uscode|publiclaw"):
        Dataset.pair_diff(spark, str(tmp_path / "a.xml"), str(tmp_path / "law.xml"), "2025-07-18", "2025-07-30")


def test_folder_to_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.xml").write_text(usc(section(1)))
    uslm.uslm_to_json(spark, str(tmp_path / "in"), "2025-07-18", str(tmp_path / "out"))
    assert uslm.read_json(spark, str(tmp_path / "out/stem=b"), "path string, snapshot_date date").count() == 2
    (tmp_path / "in/bad.xml").write_text("<bad")
    with pytest.raises(uslm.UslmError, match="1 files"):
        uslm.uslm_to_json(spark, str(tmp_path / "in"), "2025-07-18", str(tmp_path / "out2"))
    assert uslm.failures(uslm.read_uslm(spark, str(tmp_path / "in"), "2025-07-18", "PERMISSIVE")) == 1
    (tmp_path / "json").mkdir()
    for name, text in (("a", '{"x": 1}'), ("b", '{"x": ')):
        (tmp_path / f"json/{name}.json").write_text(text)
    rows = congress.read_json_rows(spark, str(tmp_path / "json"))
    assert rows.count() == 2 and [r.source[-6:] for r in rows.where(congress.is_json(F.col("json"))).collect()] == ["a.json"]


def test_http_transport():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.headers.get("X-Api-Key") == "k" and self.path == "/v3/bill"
            self.send_response(200 if ok else 403)
            self.end_headers()
            self.wfile.write(b"body" if ok else b"")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v3"
    assert congress.CongressClient(congress.http_transport(base, "k")).fetch("bill") == "body"
    for path in ("other", f"{base}/bill"):  # a full url gets no key
        with pytest.raises(congress.CongressError) as e:
            congress.CongressClient(congress.http_transport(base, "k")).fetch(path)
        assert e.value.kind == "unauthorized"
    server.shutdown()


def test_members(spark):
    rows = [{"member": {"bioguideId": "A"}}, {"member": {}}, {"member": {"bioguideId": "B", "directOrderName": "Bo", "partyHistory": [{"partyAbbreviation": "Green"}], "terms": [{"chamber": "Court", "congress": 2}]}}]
    frame = spark.createDataFrame([(json.dumps(r),) for r in rows], "json string")
    got = {r.bioguide_id: r for r in congress.shred_members(frame).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].name, got["A"].party, got["A"].state, got["A"].chamber, got["A"].terms) == (" ", "Unknown", "", "House", [])
    assert (got["B"].name, got["B"].party, got["B"].chamber) == ("Bo", "Green", "House")
    with pytest.raises(Exception, match="bioguideId"):
        congress.shred_members(frame, mode="FAILFAST").collect()


def test_client_and_cache(spark, tmp_path):
    texts = {"textVersions": [{"type": "Enrolled", "formats": []}, {"type": "Public Law", "formats": [{"type": "PDF", "url": "p"}, {"type": "United States Legislative Markup", "url": "u"}]}]}
    pages = {"bill/119/hr/1": '{"bill": {"sponsors": [{"bioguideId": "L1"}]}}', "bill/119/hr/1/cosponsors": '{"cosponsors": [{"bioguideId": "gone"}]}', "bill/119/hr/1/text": json.dumps(texts), "u": "<x/>", "member/L1": json.dumps(MEMBER), "limit": 429}
    calls = []

    def transport(path):
        calls.append(path)
        body = pages.get(path)
        return (404, "") if body is None else (body, "") if isinstance(body, int) else (200, body)

    cache = congress.ResponseCache(tmp_path / "cache", ttl=100)
    client = congress.CongressClient(transport, cache)
    row = client.download_bill(spark, "119-hr-1").first()
    assert row.bill_xml == "<x/>" and list(row.member_jsons) == ["L1"] and row.votes_json is None
    n = len(calls)
    client.member(spark, "L1").count()
    assert len(calls) == n
    for path in cache.folder.iterdir():
        os.utime(path, (time.time() - 200,) * 2)
    assert cache.get("member/L1") is None and not (cache.folder / "member_L1").exists()
    cache.clear()
    assert not list(cache.folder.iterdir())
    for path, kind in (("limit", "rate_limited"), ("none", "not_found")):
        with pytest.raises(congress.CongressError) as e:
            client.fetch(path)
        assert e.value.kind == kind
    with pytest.raises(congress.CongressError):
        client.download_bill(spark, "119-hr")


def test_stream(spark, tmp_path):
    (tmp_path / "in/2025-07-18").mkdir(parents=True)
    (tmp_path / "in/2025-07-18/a.xml").write_text(usc(section(1)))
    for name in ("b", "c"):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
        (tmp_path / f"in/2025-07-18/{name}.xml").write_text(usc(section(2)) if name == "b" else "<bad")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("error IS NULL").count() == 4 and got.where("error IS NOT NULL").count() == 1
