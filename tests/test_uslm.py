import pytest
from lexstrata.operators import tree
from lexstrata.sources import uslm

HEAD = '<uscDoc xmlns="urn:uslm" xmlns:dc="urn:dc"><meta><dc:type>USCTitle</dc:type><docNumber>26</docNumber></meta><main>'


def usc(body: str) -> str:
    return f"{HEAD}{body}</main></uscDoc>"


def section(n, inner="", attrs=""):
    return f'<section identifier="/us/usc/t26/s{n}" id="u{n}" {attrs}><num value="{n}">§ {n}.</num>{inner}</section>'


def rows(xml, date="2025-07-18"):
    return list(uslm.flatten(xml, date))


def test_tree_paths_names_and_texts():
    xml = usc(f'<title identifier="/us/usc/t26" id="a"><num value="26">Title 26</num><heading>“Tax”</heading>{section(174, "<chapeau>In the case of’s</chapeau><note><p>dropped</p></note>")}</title>')
    got = rows(xml)
    assert [r["path"] for r in got] == ["uscode", "uscode/title_26", "uscode/title_26/section_174"]
    assert [r["verbose_name"] for r in got] == ["US Code", "US Code Title 26", "US Code Title 26 § 174."]
    assert got[1]["heading"] == '"Tax"' and got[2]["chapeau"] == "In the case of's"
    assert got[2]["ancestor_paths"] == ["uscode", "uscode/title_26"] and got[2]["ord_path"] == [0, 0]
    assert got[2]["uslm_id"] == "/us/usc/t26/s174" and got[2]["uslm_uuid"] == "u174"


def test_only_the_first_text_of_a_field():
    cases = {"<content>one<i>two</i>three</content>": "one", "<content><i>one</i>two</content>": None, "<content>one<!-- c -->two</content>": "one", "<content><![CDATA[a < b]]></content>": "a < b", "<content/>": None}
    for xml, want in cases.items():
        assert rows(usc(section(1, xml)))[1]["content"] == want


def test_skipped_subtrees():
    dead = "".join(f'<section status="{s}"><paragraph/></section>' for s in ("repealed", "reserved"))
    assert len(rows(usc(dead + "<unheard><section/></unheard>" + section(1, attrs='status="changed"')))) == 2


def test_numbers():
    level = '<level id="L1"><paragraph identifier="/p"><num value="1"/></paragraph></level>'
    got = rows(usc(level))
    assert got[1]["path"] == "uscode/level_L1" and got[1]["uslm_id"] is None and got[1]["verbose_name"] == "US Code Level L1"
    assert got[2]["path"] == "uscode/level_L1/paragraph_1" and got[2]["number_display"] == ""
    for bad in ('<section identifier="/x"/>', '<section><num value="1"/></section>', "<level/>"):
        with pytest.raises(uslm.UslmError):
            rows(usc(bad))


def test_duplicate_paths_are_shadowed():
    pair = '<paragraph identifier="/a"><num>x</num>{}</paragraph>'
    inner = '<clause identifier="/c"><num value="1"/></clause>'
    got = rows(usc(section(1, pair.format(inner) + pair.format(""))))
    assert [(r["path"].rpartition("/")[2], r["shadowed"]) for r in got[2:]] == [("paragraph_", True), ("clause_1", True), ("paragraph_", False)]


def test_source_credits():
    credit = '<sourceCredit>(<ref href="/a">A</ref>, <ref>no</ref><ref href="/b">B; b</ref>; <ref href="/c"/>)</sourceCredit>'
    got = rows(usc(section(1, credit)))[1]["source_credits"]
    assert [[(p["ref_id"], p["description"]) for p in c["ref_pairs"]] for c in got] == [[("/a", "A"), ("/b", "B; b")], [("/c", "")]] or [[p["ref_id"] for p in c["ref_pairs"]] for c in got] == [["/a", "/b"], ["/c"]]


def test_public_law():
    xml = '<pLaw xmlns="urn:uslm"><meta><congress>119</congress><docNumber>21</docNumber></meta><preface><docNumber>119-21</docNumber></preface><title identifier="/t"><num value="I">TITLE I</num></title></pLaw>'
    got = rows(xml)
    assert [r["path"] for r in got] == ["publiclawdocument_119-21", "publiclawdocument_119-21/title_I"]
    assert got[0]["uslm_id"] == "/us/pl/119-21" and got[0]["document_type"] == {"kind": "bill", "usc_type": None, "bill_type": "public_law", "bill_id": "119-21"}


@pytest.mark.parametrize("xml", ["<other/>", "<uscDoc><meta/></uscDoc>", "<uscDoc><meta><type>Novel</type></meta></uscDoc>", "<pLaw/>", "<a", "<!DOCTYPE a [<!ENTITY b 'c'>]><uscDoc/>"])
def test_documents_that_are_refused(xml):
    with pytest.raises(uslm.UslmError):
        rows(xml)


@pytest.mark.parametrize("date", ["2025-07", "2025-07-18-1", "2025-00-01", "2025-13-01", "2025-02-30", "2025-02-29", "x-1-1", "2025-07-1a"])
def test_dates_that_are_refused(date):
    with pytest.raises(uslm.UslmError):
        uslm.parse_date_text(date)


def test_folder_and_permissive_mode(spark, tmp_path):
    for k, name in enumerate(["b.xml", "a.xml"]):
        (tmp_path / name).write_text(usc(section(k + 1) + section(9)))
    (tmp_path / "c.txt").write_text("no")
    got = uslm.read_uslm_folder(spark, str(tmp_path), "2025-7-5").orderBy("ord_path").collect()
    assert [(r.path, r.shadowed) for r in got] == [("uscode", False), ("uscode/section_2", False), ("uscode/section_9", True), ("uscode/section_1", False), ("uscode/section_9", False)]
    (tmp_path / "d.xml").write_text("<bad")
    both = uslm.read_uslm(spark, str(tmp_path), "2025-07-18", "PERMISSIVE")
    assert both.where("error IS NOT NULL").count() == 1 and both.where("error IS NULL").count() == 6
    with pytest.raises(Exception, match="xml"):
        uslm.read_uslm(spark, str(tmp_path), "2025-07-18").count()


def test_amendments(spark):
    xml = '<pLaw><p role="instruction">Strike “a” <amendingAction type="strikeAndInsert">x</amendingAction><p role="instruction">inner<AmendingAction type="Amend"/></p></p><q role="instruction">inner</q><amendingAction type="other"/></pLaw>'
    got = {r.amending_text: r for r in uslm.parse_bill_amendments(spark.createDataFrame([("119-1", xml)], "bill_id string, xml string")).collect()}
    assert got['Strike "a" xinner'].action_types == ["strike_and_insert", "amend"]
    assert got["inner"].action_types == [] and got["inner"].ordinal == 2 and len(got["inner"].amendment_id) == 64


def test_bill_files(spark, tmp_path):
    (tmp_path / "bill_119_hr_1.xml").write_text('<a role="instruction">t</a>')
    assert uslm.read_bill_amendments(spark, str(tmp_path)).first().bill_id == "119-hr-1"


def test_navigation_and_search(spark, tmp_path):
    (tmp_path / "a.xml").write_text(usc(section(1, "<heading>Income</heading><content>an INCOME tax</content>") + section(11)))
    rows = uslm.read_uslm(spark, str(tmp_path), "2025-07-18")
    assert [r.path for r in tree.subtree(rows, "uscode/section_1").collect()] == ["uscode/section_1"]
    assert tree.subtree(rows, "").count() == 0 and tree.subtree(rows, "uscode").count() == 3
    assert [r.path for r in tree.children(rows, "uscode").collect()] == ["uscode/section_1", "uscode/section_11"]
    assert [(r.field_name, r.snippet) for r in tree.search_text(rows, "income").collect()] == [("heading", "Income"), ("content", "an INCOME tax")]
    both = tree.merged(rows.drop("source", "error"), rows.drop("source", "error"))
    assert [r.shadowed for r in both.orderBy("ord_path").collect()] == [False, True, True, False, False]
