import html
import random
import re
import time

import numpy as np
from lexstrata.llm import htmltext


def article(page):
    """The text of the first article element, as the test pages are built."""
    m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not m:
        return ""
    s = re.sub(r"</?(p|br|h1)>", "\n", m[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", s)).split())


def test_held_out_accuracy():
    model = htmltext.trained()
    rows = htmltext.samples(200, 99)
    marks = model.label([x for x, _ in rows])
    right = np.concatenate([m == (y > 0.5) for m, (_, y) in zip(marks, rows)])
    assert right.mean() > 0.985


def test_made_up_labels_follow_the_leaves():
    rng = random.Random(3)
    for _ in range(200):
        page, labels = htmltext.sample_page(rng)
        if page.endswith("</html>"):
            assert len(htmltext.leaves(page)) == len(labels)


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    model = htmltext.Labeller(3)
    x, mask = htmltext.padded([rng.standard_normal((n, htmltext.N_FEATURES)).astype(np.float32) for n in (4, 2)])
    y = (rng.random(mask.shape) > 0.5).astype(np.float32)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    _, grad = model.gradient(x, mask, y)
    for name in model.w:
        i = tuple(rng.integers(0, s) for s in model.w[name].shape)
        old = model.w[name][i]
        loss = []
        for d in (1e-4, -1e-4):
            model.w[name][i] = old + d
            loss.append(model.gradient(x, mask, y)[0])
        model.w[name][i] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - grad[name][i]) < 1e-3


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extracted(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_deep_pages_take_linear_time():
    n = 60_000
    for page in ("<div>x" * n, "<q1>x" * n, "<p><b1>" * n + "</i1>" * n, "<ul><li>x" * n, "</div>" * n):
        began = time.process_time()
        assert len(htmltext.leaves(page)) in (0, n)
        assert time.process_time() - began < 10
    assert htmltext.leaves("<div>a<p>b<div>c</div>d</div>") == [(("div",), "a", 0), (("div", "p"), "b", 0), (("div", "div"), "c", 0), (("div",), "d", 0)]


def test_edge_cases(spark):
    body = "<html><body><nav><a href=/x>Menu</a></nav><article><h1>A &amp;\n B</h1><p>One <b>two</b>three.<p>caf&eacute; &#x41; 1 &lt; 2<script>if (a < b) { '<p>' }</script> end</p>%s</article><footer>Foot</footer></body></html>"
    rows = [
        (1, None, None, "x"),
        (2, "u", "", "x"),
        (2, "u", "", "x"),
        (3, "u", "<nav><ul><li>only</li><li>menu</li></ul></nav>", "x"),
        (4, None, body % "", "x"),
        (5, "u", body % "<aside>side</aside><form><label>name</label></form><div class='comments'><p>me too</p></div><!-- gone <p>x</p> -->", "x"),
        (6, "u", "<article><p>" + "long text. " * 30000 + "</p></art", "x"),
        (None, "u", "<article><p>cut <a href='", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, htmltext.extracted(pages).collect()), key=str)
    text = "A & B One twothree. café A 1 < 2 end"
    want = [(1, None, ""), (2, "u", ""), (2, "u", ""), (3, "u", ""), (4, None, text), (5, "u", text), (6, "u", ("long text. " * 30000).strip()), (None, "u", "cut")]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)
    assert htmltext.extracted(pages.limit(0)).count() == 0
