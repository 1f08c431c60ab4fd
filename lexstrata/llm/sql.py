"""SQL (DuckDB) that gives the rows of those operators which SQL can express."""

from __future__ import annotations

from .linkgraph import BLOCK_SHARE, DAMPING, ROUNDS

_WORDS9 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS10 = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS9}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS9}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, i, m, item_id FROM pos JOIN win USING (m, g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS10}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS to_id FROM ends UNION SELECT r.doc_id, e.y FROM reach r JOIN ends e ON e.x = r.to_id),
comp AS (SELECT doc_id, min(to_id) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""


OP12 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
w AS (SELECT lang, pid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p)),
runs AS (SELECT lang, w AS p1, w || ' ' || lead(w, 1) OVER o AS p2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS p3, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS p4 FROM w WINDOW o AS (PARTITION BY pid ORDER BY i)),
g AS (SELECT lang, 1 AS m, p1 AS phrase, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, p2, count(*) FROM runs WHERE p2 IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 3, p3, count(*) FROM runs WHERE p3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, p4, count(*) FROM runs WHERE p4 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 30),
cut AS (SELECT c.lang, c.phrase, c.m, c.a, k, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ') AND x.m = k JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.m], ' ') AND y.m = c.m - k),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_runs AS (SELECT lang, array_to_string(w[i : i + q - 1], ' ') AS phrase, a FROM (SELECT lang, w, a, q, unnest(range(1, m - q + 2)) AS i FROM c, (VALUES (2), (3)) v(q) WHERE q < m)),
over_runs AS (SELECT lang, phrase, max(a) AS f FROM inner_runs GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM low LEFT JOIN over_runs o USING (lang, phrase) JOIN n USING (lang) WHERE o.f IS NULL OR 100 * o.f < 80 * a QUALIFY rank <= 2000
"""

#: The CRC of a word comes byte by byte from its hexadecimal form; it is only taken of different words.
OP13 = f"""
WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS9}') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS9}')) AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
words AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(w), 2), lambda i: ('0x' || substr(hex(w), i, 2))::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM dw UNION SELECT DISTINCT w FROM b), t),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN words USING (w) GROUP BY 1),
u AS (SELECT bucket, count(*) AS t FROM b JOIN words USING (w) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (alls + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (allt + 10000))))::BIGINT AS gain
  FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN u USING (bucket), (SELECT sum(s) AS alls FROM s), (SELECT sum(t) AS allt FROM u)),
weight AS (SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN words USING (w) JOIN gain USING (bucket) GROUP BY 1),
score AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weight USING (doc_id)),
top AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM score WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM score LEFT JOIN top USING (doc_id)
"""


def op5(rules: list[tuple[str, str]]) -> str:
    table = ", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '{t[len(t.partition('/')[0]) :]}')" for v, t in rules)
    rounds = ", ".join(
        f"""r{k} AS (SELECT host, sum(t) AS t, sum(b) AS b FROM (
  SELECT host, (1 - {DAMPING}) * t AS t, (1 - {DAMPING}) * b AS b FROM seeds
  UNION ALL SELECT dst, {DAMPING} * ahead * t, 0 FROM g JOIN {f"r{k - 1}" if k else "seeds"} s ON s.host = src
  UNION ALL SELECT src, 0, {DAMPING} * back * b FROM g JOIN {f"r{k - 1}" if k else "seeds"} s ON s.host = dst) GROUP BY 1)"""
        for k in range(ROUNDS)
    )
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
rules(v, rule, rh, rp) AS (VALUES {table}),
p AS (SELECT h.*, (SELECT max({{'n': length(rule), 'rule': rule, 'v': v}}) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM h),
tot AS (SELECT greatest(count(*) FILTER (best.v = 'allow' AND host <> ''), 1) AS a, greatest(count(*) FILTER (best.v = 'block' AND host <> ''), 1) AS b FROM p),
seeds AS (SELECT host, count(*) FILTER (best.v = 'allow') / any_value(a)::DOUBLE AS t, count(*) FILTER (best.v = 'block') / any_value(tot.b)::DOUBLE AS b FROM p, tot WHERE host <> '' AND best IS NOT NULL GROUP BY 1),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {_LOWER.format("unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']?\\s*(?:https?:)?//([^/?#\"''\\s<>]+)', 1))")} AS dst FROM p WHERE host <> '') WHERE src <> dst GROUP BY ALL),
g AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS ahead, n / sum(n) OVER (PARTITION BY dst) AS back FROM e),
{rounds}
SELECT page_id, p.host, path, best.rule AS rule, coalesce(best.v, CASE WHEN round(s.b / nullif(s.t + s.b, 0), 9) > {BLOCK_SHARE} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r{ROUNDS - 1} s ON s.host = p.host
"""
