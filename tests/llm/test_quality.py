import math
import re
from collections import Counter, defaultdict

import cases
from lexstrata.llm import quality


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def check(rows):
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == naive(r.text), r.text
        assert not (r.base_failed and r.kept)


def test_counts_against_brute_force(spark, sf):
    rows = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).select("r.text", *quality.FEATURES.names[:6], "kept").collect()
    check(rows)
    assert sum(r.kept for r in rows) > 100


def test_edge_cases(spark):
    docs = cases.table(spark)
    rows = quality.judged(docs).select("r.text", *quality.FEATURES.names[:6], "kept").collect()
    check(rows)
    assert len(rows) == len(cases.TEXTS)
    out = quality.clean(docs)
    assert out.columns == docs.columns and out.count() >= 1
    assert quality.judged(docs.limit(0)).count() == 0


def test_divergent_text_is_rejected(spark):
    good = [(i, " ".join(f"{c}a{k} the of{i} {c}b{k}" for k in range(60) for c in "xy"), "en") for i in range(30)]
    bad = (99, " ".join(f"$%&{i}#*|<>{i * 7}" for i in range(300)), "en")
    kept = {r.doc_id for r in quality.clean(cases.table(spark, [*good, bad, *cases.TEXTS[:2]])).collect()}
    assert kept == set(range(30))


def char_class(c):
    for k, some in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:!?", "'\"()-_/[]{}", "#*$%&|<>")):
        if c in some:
            return k
    return "wide" if ord(c) > 127 else "rest"


def shares(values):
    n = Counter(values)
    return {k: v / sum(n.values()) for k, v in n.items()}


def distance(p, q):
    total = sum(q.values())
    q = {k: v / total for k, v in q.items()}
    middle = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return math.sqrt(max(0, sum(v * math.log2(v / middle[k]) for x in (p, q) for k, v in x.items() if v) / 2))


def verdicts(docs):
    """kept and both distances of (text, lang) rows, one text after the other."""
    ascii_low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    common, hists, refs = set(quality.COMMON_WORDS), [], defaultdict(lambda: (Counter(), Counter()))
    for text, lang in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ascii_low))
        hists.append((len(words), naive(text)[-1], shares(map(char_class, text or "")), shares(w if w in common else None for w in words)))
        if not hists[-1][1] and len(words) >= quality.MIN_WORDS:
            for ref, own in zip(refs[lang], hists[-1][2:]):
                ref.update(own)
    for (_, lang), (n, failed, chars, words) in zip(docs, hists):
        x = distance(chars, refs[lang][0]) if chars and lang in refs else None
        y = distance(words, refs[lang][1]) if n >= quality.MIN_WORDS and lang in refs else None
        far = (x or 0) > quality.CHAR_LIMIT or (y or 0) > quality.WORD_LIMIT or (x is not None and y is not None and x + y > quality.SUM_LIMIT)
        yield not failed and not far, x, y


def test_verdicts_against_brute_force(spark, sf):
    odd = [(" ".join(f"$%&{i}#*|<>{i * 7}" for i in range(300)), "en"), ("ÄÖ über " * 120, None), (" ".join(f"é{i} the" for i in range(150)), "xx"), (None, "en"), ("", None)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").unionByName(spark.createDataFrame(odd, "text string, lang string"))
    rows = quality.judged(docs).select("r.text", "r.lang", "kept", "js_chars", "js_words").collect()
    near = lambda x, y: (x is None) == (y is None) and abs((x or 0) - (y or 0)) < 1e-9
    for r, (kept, x, y) in zip(rows, verdicts([(r.text, r.lang) for r in rows]), strict=True):
        assert near(r.js_chars, x) and near(r.js_words, y) and r.kept == kept, r.text
    assert any(not r.kept and r.js_chars is not None and r.js_chars > quality.CHAR_LIMIT for r in rows)
