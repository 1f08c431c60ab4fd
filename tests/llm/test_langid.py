import math
import re
from collections import Counter, defaultdict

from lexstrata.llm import langid, queries


def test_accuracy_on_pages(spark, sf):
    """The addresses name the language; with and without the declared one."""
    pages, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "documents"))
    truth = {r.page_id: re.search(r"://[^/]*/([a-z]+)", r.url)[1] for r in pages.collect()}
    rows = langid.identified(pages, docs).collect()
    assert sum(r.lang == truth[r.page_id] for r in rows) >= 0.98 * len(rows)
    bare = spark.createDataFrame([(r.page_id, r.url, r.html.replace("<html lang=", "<html x=")) for r in pages.collect()], "page_id long, url string, html string")
    rows = langid.identified(bare, docs).collect()
    assert sum(r.lang == truth[r.page_id] for r in rows) >= 0.9 * len(rows)


def test_held_out_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 200").orderBy("doc_id").collect()
    models = langid.Models([(r.text, r.lang) for r in rows[::2]])
    right = [models.langs[int(models.likelihood(r.text).argmax())] == r.lang for r in rows[1::2]]
    assert sum(right) >= 0.9 * len(right)


def test_edge_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(1, None, None, "x"), (2, "", "", "x"), (2, "", "", "x"), (3, "http://h.de/", "<html lang='de-AT'>", "x"), (None, "http://h.de/", "<p>" + "und der " * 20000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang string")
    got = langid.identified(pages, docs).collect()
    assert len(got) == len(rows) and all(r.lang for r in got)
    assert {r.page_id: r.lang for r in got}[None] == "de"
    assert langid.identified(pages.limit(0), docs).count() == 0
    assert {r.lang for r in langid.identified(pages, docs.limit(0)).collect()} == {None}


def test_posterior_by_hand(spark):
    """One sure page of each language on one host: priors and tables spelled out."""
    docs = spark.createDataFrame([(1, "abcabc " * 50, "aa"), (2, "xyzxyz " * 50, "bb")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://h.t/", "<html lang=aa>" + "abcabc " * 90), (2, "http://h.t/", "<html lang=aa>" + "abcabc " * 90), (3, "http://h.t/", "<html lang=bb>" + "xyzxyz " * 90), (4, "http://h.t/", "<html lang=bb>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identified(pages, docs).collect()}
    assert [got[i].text_lang for i in (1, 2, 3, 4)] == ["aa", "aa", "bb", None]
    prior = [3 / 5, 2 / 5]
    domain = [(2 + 5 * prior[0]) / 8, (1 + 5 * prior[1]) / 8]
    host = [(2 + 5 * domain[0]) / 8, (1 + 5 * domain[1]) / 8]
    odds = [(0.5 / 7) * (2.5 / 7) * host[0], (1.5 / 6) * (1.5 / 6) * host[1]]
    assert got[4].lang == "bb" and abs(got[4].confidence - odds[1] / sum(odds)) < 1e-5


def test_rare_language_has_a_model(spark):
    big = spark.range(40000).selectExpr("id AS doc_id", "concat('the house and the tree ', id) AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    rare = spark.range(2).selectExpr("id + 50000 AS doc_id", "'le chat et la souris' AS text", "'fr' AS lang")
    models = langid.train(big.unionByName(rare), rows=100)
    assert models.langs == ["de", "en", "fr"]


def runs(text):
    """Buckets of trigrams, one character after the other."""
    code = [ord(c) if "a" <= c <= "z" or ord(c) >= 0xC0 else 32 for c in text.lower()]
    code = [c for k, c in enumerate(code) if c != 32 or k == 0 or code[k - 1] != 32]
    # fixed values: the multipliers of the operator's bucket hash
    return [((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) >> 7) % langid.BUCKETS for a, b, c in zip(code, code[1:], code[2:])]


def posteriors(pages, docs):
    """lang and confidence by page_id from all labelled documents."""
    langs = sorted({r.lang for r in docs})
    grams = {x: Counter(b for r in docs if r.lang == x for b in runs(r.text)) for x in langs}
    mass = {x: sum(grams[x].values()) + 0.1 * langid.BUCKETS for x in langs}
    read, counts = {}, defaultdict(Counter)
    for r in pages:
        host = r.url.split("://", 1)[1].split("/")[0].lower()
        domain, suffix = ".".join(["", "", *host.split(".")][-2:]), host.split(".")[-1]
        m = re.search(r"<html[^>]*?lang=[\"']?([A-Za-z-]+)", r.html, re.I)
        declared = m[1].lower().split("-")[0] if m else ""
        n = Counter(runs(langid.visible(r.html)))
        text = {x: langid.TEMPER * sum(k * math.log((grams[x][b] + 0.1) / mass[x]) for b, k in n.items()) for x in langs}
        first, second = sorted(text.values(), reverse=True)[:2]
        read[r.page_id] = (host, domain, suffix, declared, {x: v - first for x, v in text.items()})
        if first - second >= langid.DECISIVE:
            best = max(langs, key=text.get)
            for key in ("all", ("host", host), ("domain", domain), ("suffix", suffix), ("declared", declared)):
                counts[key][best] += 1
    every, out = counts["all"], {}
    up = lambda n, above: {x: (n[x] + langid.STRENGTH * above[x]) / (sum(n.values()) + langid.STRENGTH) for x in langs}
    given = lambda key, x: (counts[key][x] + 0.5) / (every[x] + langid.STRENGTH) if key in counts else 1.0
    for page, (host, domain, suffix, declared, text) in read.items():
        prior = {x: (every[x] + 1) / (sum(every.values()) + len(langs)) for x in langs}
        for key in (("domain", domain), ("host", host)):
            prior = up(counts[key], prior) if key in counts else prior
        odds = {x: math.exp(text[x]) * given(("declared", declared), x) * given(("suffix", suffix), x) * prior[x] for x in langs}
        best = max(langs, key=odds.get)
        out[page] = (best, odds[best] / sum(odds.values()))
    return out


def test_query_against_brute_force(spark, sf):
    pages, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "documents"))
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").collect()
    assert max(Counter(r.lang for r in known).values()) <= langid.TRAIN_ROWS // len({r.lang for r in known})  # so all are trained on
    want = posteriors(pages.collect(), known)
    got = queries.op8_language_id(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.lang == want[r.page_id][0] and abs(r.confidence - want[r.page_id][1]) < 2e-6, r
