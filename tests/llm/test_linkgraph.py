import re

from lexstrata.llm import linkgraph
from lexstrata.llm.queries import URL_RULES

PAGES = [
    (1, "http://A.Example.org/en/12?x#y", "<a href='https://b.net/'>"),
    (2, "https://example.org/es/", '<a href="//c.com/x">'),
    (3, None, None),
    (4, "no scheme", ""),
    (5, "http://b.net", '<a HREF = "http://Spam.com/de/1">x</a><a href=/local>'),
    (6, "http://spam.com/de/2", ""),
    (7, "http://spam.com?q=1://z", ""),
    (8, "http://x.spam.com/fr/1#t", "<a href=http://b.net>"),
    (9, "http://notorg/", ""),
    (9, "http://notorg/", ""),
    (10, "x://org", ""),
    (11, "http:///path", ""),
    (12, "http://bad.com/de/", ""),
    (13, "http://bad.com/x", "<a href=\"//worse.com\">"),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")


def naive(pages, rules):
    def cut(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]

    rows = []
    for i, url, html in pages:
        host, path = cut(url)
        fits = [(len(t), t, v) for v, t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[len(t.split("/")[0]) :])]
        rows.append((i, host, path, *(max(fits)[1:] if fits else (None, None)), html or ""))
    seeds, edges = {}, {}
    for _, host, _, _, v, html in rows:
        if host and v:
            seeds.setdefault(host, [0, 0])[v == "block"] += 1
        for dst in re.findall(r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)", html):
            if host and dst.lower() != host:
                edges[host, dst.lower()] = edges.get((host, dst.lower()), 0) + 1
    total = [max(1, sum(s[k] for s in seeds.values())) for k in (0, 1)]
    seeds = {h: [s[0] / total[0], s[1] / total[1]] for h, s in seeds.items()}
    now = {h: list(s) for h, s in seeds.items()}
    for _ in range(linkgraph.ROUNDS):
        new = {h: [0.15 * x for x in s] for h, s in seeds.items()}
        for (s, d), n in edges.items():
            out, into = (sum(m for e, m in edges.items() if e[k] == (s, d)[k]) for k in (0, 1))
            new.setdefault(d, [0, 0])[0] += 0.85 * n / out * now.get(s, [0, 0])[0]
            new.setdefault(s, [0, 0])[1] += 0.85 * n / into * now.get(d, [0, 0])[1]
        now = new
    out = []
    for i, host, path, rule, v, _ in rows:
        t, d = now.get(host, (0, 0))
        out.append((i, host, path, rule, v or ("block" if t + d and round(d / (t + d), 9) > linkgraph.BLOCK_SHARE else "allow")))
    return sorted(out, key=str)


def run(pages, rules=URL_RULES):
    return sorted(map(tuple, linkgraph.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def test_edge_cases(spark):
    want = naive(PAGES, URL_RULES)
    assert {x[4] for x in want} == {"allow", "block"}
    assert ("block" in {x[4] for x in want if x[3] is None}) and run(table(spark)) == want
    assert {x[4] for x in run(table(spark), [])} == {"allow"}
    assert run(table(spark).limit(0)) == []


def test_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert run(pages) == naive([tuple(r) for r in pages.select("page_id", "url", "html").collect()], URL_RULES)


def test_plan_has_no_python(spark, sf):
    plan = linkgraph.judged(spark.read.parquet(f"{sf}/pages.parquet"), URL_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
