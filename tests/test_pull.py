"""The event reader against a reading of the whole tree, and what a tree could not do."""

import random
import time
import tracemalloc
import xml.etree.ElementTree as ET

import pytest
from lexstrata import schema
from lexstrata.operators import tree
from lexstrata.sources import pull, uslm

HEAD = '<uscDoc xmlns="urn:uslm"><meta><type>USCTitle</type><docNumber>26</docNumber></meta>'


def text_of(node):
    return node.text.translate(str.maketrans("‘’“”", "''\"\"")) if node is not None and node.text else None


def naive(xml):
    """(place, path, display, fields, shadowed, credits) of every element below <main>, from the whole tree."""
    root = ET.fromstring(xml, ET.XMLParser(target=ET.TreeBuilder(insert_comments=True, insert_pis=True)))
    tag = lambda n: n.tag.rpartition("}")[2] if isinstance(n.tag, str) else ""
    first = lambda n, name: next((c for c in n if tag(c) == name), None)
    out = []

    def credits(node):
        found = []
        for credit in (c for c in node if tag(c) == "sourceCredit"):
            group = []

            def run(text, found=found):
                nonlocal group
                if ";" in (text or "") and group:
                    found.append(group)
                    group = []

            def walk(n):
                for c in n:
                    if isinstance(c.tag, str):
                        if tag(c) == "ref" and c.get("href") is not None:
                            group.append((c.get("href"), c.text or ""))
                        run(c.text)
                        walk(c)
                    run(c.tail)

            run(credit.text)
            walk(credit)
            if group:
                found.append(group)
        return found

    def below(node, path, place, lost):
        alive = [c for c in node if isinstance(c.tag, str) and tag(c).lower() in schema.ELEMENT_TYPES and c.get("status") not in ("repealed", "reserved")]
        nums = [first(c, "num") for c in alive]
        paths = [f"{path}/{tag(c).lower()}_{n.get('value') or ''}" for c, n in zip(alive, nums, strict=True)]
        for k, (c, num, p) in enumerate(zip(alive, nums, paths, strict=True)):
            gone = lost or p in paths[k + 1 :]
            out.append(([*place, k], p, text_of(num) or "", [text_of(first(c, f)) for f in schema.TEXT_FIELDS], gone, credits(c)))
            below(c, p, [*place, k], gone)

    below(first(root, "main") if first(root, "main") is not None else root, "uscode", [], False)
    return out


def rows(xml):
    plain = lambda cs: [[(p["ref_id"], p["description"]) for p in c["ref_pairs"]] for c in cs]
    return [(r["ord_path"], r["path"], r["number_display"], [r[f] for f in schema.TEXT_FIELDS], r["shadowed"], plain(r["source_credits"])) for r in uslm.flatten(xml, "2025-07-18")[1:]]


def made(rng, depth=0):
    """An element with its parts in any order."""
    kind = rng.choice(["section", "Paragraph", "clause", "level", "part"])
    mixed = lambda: "".join(rng.choice(["", "a “b”", "; ", "<i>x</i>", "<!-- c -->", "<?p i?>", "<![CDATA[<d>]]>", "é&amp;"]) for _ in range(rng.randint(0, 4)))
    parts = [f'<num value="{rng.randint(0, 2)}">{mixed()}</num>']
    parts += [f"<{f}>{mixed()}</{f}>" for f in rng.sample(schema.TEXT_FIELDS, rng.randint(0, 5))]
    parts += [f"<heading>{mixed()}</heading><num/>"] if rng.random() < 0.1 else []
    refs = [rng.choice(['<ref href="/a">A</ref>', "<ref>n; o</ref>", '<ref href="/b">B; <i>b</i></ref>', '<ref href="/c"/>', "; ", ", <!-- ; -->", "<b><ref href='/d'>D<ref href='/e'/></ref>;</b>"]) for _ in range(rng.randint(0, 6))]
    parts += [f"<sourceCredit>{''.join(refs)}</sourceCredit>"] if rng.random() < 0.3 else []
    parts += [rng.choice(["<note><section/></note>", '<section status="repealed"><bad/></section>', "<!-- n -->", "text", '<heading status="reserved">r</heading>'])]
    if depth < 4:
        parts += [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    rng.shuffle(parts)
    return f'<{kind} identifier="/x" id="i">{"".join(parts)}</{kind}>'


@pytest.mark.parametrize("seed", range(40))
def test_random_documents_against_the_tree(seed):
    rng = random.Random(seed)
    body = "".join(made(rng) for _ in range(3))
    body = [f"<main>{body}</main>", body, f"<section/><main>{body}</main><section/><main>{made(rng)}</main>"][seed % 3]
    xml = f"{HEAD}{body}</uscDoc>"
    got = rows(xml)
    assert len(got) >= 3 and got == naive(xml)


def test_parts_of_any_size_give_the_same(monkeypatch):
    xml = f"{HEAD}<main>{''.join(made(random.Random(k)) for k in range(5))}</main></uscDoc>"
    whole = rows(xml)
    monkeypatch.setattr(pull, "BYTES", 7)
    assert rows(xml) == whole


def test_depth():
    """1,200 sections in each other, and 100,000 levels of markup that is no element."""
    deep = "".join(f'<section identifier="/s"><num value="{i}"/>' for i in range(1200)) + "</section>" * 1200
    got = uslm.flatten(f"{HEAD}<main>{deep}</main></uscDoc>", "2025-07-18")
    assert len(got) == 1201 and got[-1]["depth"] == 1200 and got[-1]["path"].endswith("/section_1199")
    markup = '<section identifier="/s"><num value="1"/><content>x' + "<i>" * 100_000 + "</i>" * 100_000 + "</content></section>"
    assert uslm.flatten(f"{HEAD}<main>{markup}</main></uscDoc>", "2025-07-18")[1]["content"] == "x"
    endless = '<section identifier="/s"><num value="1"/>' * 100_000
    with pytest.raises(uslm.UslmError, match="in each other"):
        next(uslm.elements_of(f"{HEAD}<main>{endless}", "2025-07-18"))
    assert len(pull.instructions('<a role="instruction">x' * 3000 + "</a>" * 3000)) == 3000


def test_memory_goes_with_what_is_open():
    section = '<section identifier="/s{0}"><num value="{0}">§ {0}</num><content>' + "word " * 100 + '</content><paragraph identifier="/p"><num value="a"/></paragraph></section>'
    raw = f"{HEAD}<main>{''.join(section.format(i) for i in range(12_000))}</main></uscDoc>".encode()
    tracemalloc.start()
    began = time.perf_counter()
    n = sum(1 for _ in uslm.elements_of(raw, "2025-07-18"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 24_001 and len(raw) > 7_000_000
    assert peak < len(raw) / 2 and time.perf_counter() - began < 60


def test_errors_are_rows(spark):
    good = f'{HEAD}<main><section identifier="/s"><num value="1"/></section></main></uscDoc>'
    late = f'{HEAD}<main><section identifier="/s"><num value="1"/></section><section/></main></uscDoc>'
    cases = [("good", good, "2025-07-18"), ("null", None, "2025-07-18"), ("date", good, None), ("late", late, "2025-07-18"), ("cut", good[:-5], "2025-07-18"), ("deep", HEAD + '<section identifier="/s"><num value="1"/>' * 9, "2025-07-18"), ("empty", "", "2025-07-18")]
    frame = spark.createDataFrame(cases, "source string, xml string, date string")
    got = uslm.parse_documents(frame, "PERMISSIVE", max_depth=8).collect()
    assert sorted((r.source, r.error.code) for r in got if r.error) == [("cut", "xml"), ("date", "invalid_date"), ("deep", "unable_to_parse_element"), ("empty", "xml"), ("late", "unable_to_parse_element"), ("null", "xml")]
    assert [r.path for r in got if not r.error] == ["uscode/section_1", "uscode"]
    assert uslm.failures(uslm.parse_documents(frame, "PERMISSIVE", max_depth=8)) == 6
    with pytest.raises(Exception, match="no document"):
        uslm.parse_documents(frame.where("source = 'null'")).count()
    bills = spark.createDataFrame([("a", None), ("b", '<x><p role="instruction">t</p>'), ("c", '<p role="instruction">t</p>')], "bill_id string, xml string")
    assert sorted((r.bill_id, r.error and r.error.code, r.amending_text) for r in uslm.parse_bill_amendments(bills, "PERMISSIVE").collect()) == [("a", "xml", None), ("b", "xml", None), ("c", None, "t")]


def test_batches_hold_rows_of_many_documents():
    into = uslm._arrow("a string, n int")
    sizes = [b.num_rows for b in uslm._batches(({"a": "x", "n": i} for i in range(uslm.CHUNK + 3)), into)]
    assert sizes == [uslm.CHUNK, 3]
    big = "x" * (uslm.CHUNK_TEXT // 2)
    assert [b.num_rows for b in uslm._batches(({"a": big, "n": i} for i in range(5)), into)] == [3, 2]


def test_a_folder_is_parsed_once(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.xml").write_text(f'{HEAD}<main><section identifier="/s"><num value="{k % 2}"/></section></main></uscDoc>')
    got = uslm.read_uslm_folder(spark, str(tmp_path), "2025-07-18")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan
    assert [(r.path, r.shadowed) for r in tree.children(got, "uscode").collect()] == [("uscode/section_0", True), ("uscode/section_1", False), ("uscode/section_0", False)]
