"""Operator 3: main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open tags (names, classes, ids,
roles). Scripts, styles, comments and other markup are no text. Each leaf gets a vector: its tag path and its words, both
hashed, and a few measures. A bidirectional LSTM (numpy) reads the leaves of the whole page in both directions and labels
every one as main text or not; so a block is judged by all that surrounds it. The texts of main blocks are joined.

No page here carries labels. The model is trained on TRAIN_PAGES pages that `sample_page` makes up with known labels
(articles with menus, headers, footers, sidebars, notices, adverts, forms and comments around and inside them), from a fixed
seed, once per driver process, in seconds; it goes to the tasks as a few hundred kB. Tests measure it on held-out pages.

Defined results: a null or empty html gives an empty text of 0 characters; a null url stays null; truncated pages are read up to their
end, an unfinished tag at the end is markup; repeated rows get a row each; an empty table gives an empty result; extra columns
are dropped. Pages are labelled in runs of similar length, so a page with very many blocks is padded to its own length only.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

#: Open tags that a leaf's vector looks at, from the innermost out.
DEPTH = 16
TRAIN_PAGES = 700
EPOCHS = 14
PATH_BINS = 96
WORD_BINS = 24
HIDDEN = 16
N_FEATURES = PATH_BINS + WORD_BINS + 5

#: Fixed values of the HTML standard: elements without content, elements whose content isn't text, elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript title textarea select svg iframe".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: A start tag of the key ends an open element of these, up to the nearest container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_STOPS = frozenset("div article section main aside nav footer header form td th table ul ol dl blockquote body html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<[a-zA-Z/][^>]*(?:>|$)|([^<]+)|<", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


def leaves(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(innermost open tags with their names, text, characters inside links) of each leaf block, in page order.

    Steps are in proportion to the page: a tag is looked for among the open ones only if one of its name is open.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    run: list[str] = []
    linked = 0
    in_link = 0

    def flush():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append((tuple(label for _, label in stack[-DEPTH:]), text, linked))
            run.clear()
        linked = 0

    def shut(i: int):
        opened.subtract(name for name, _ in stack[i:])
        del stack[i:]

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        close, name, attrs, text = m.groups()
        if name is None:
            if text is not None or m[0] == "<":
                text = html.unescape(text) if text is not None else "<"
                run.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        name = name.lower()
        if not close and name in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "a":
            in_link = 0 if close else 1
        if name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        if close:
            if opened[name] > 0:
                shut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                in_link = 0
            continue
        ends = CLOSES.get(name, set()) | ({"p"} if name in _BLOCK_END_P else set())
        if any(opened[x] > 0 for x in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    shut(i)
                    break
                if stack[i][0] in _STOPS:
                    break
        label = name
        if attrs:
            for _, x, y, z in _ATTR.findall(attrs):
                label += " " + " ".join(_NAME.findall((x or y or z).lower()))
        stack.append((name, label))
        opened[name] += 1
    flush()
    return out


@lru_cache(1 << 16)
def _bin(token: str, bins: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % bins


@lru_cache(1 << 14)
def _path_bins(path: tuple[str, ...]) -> tuple[tuple[int, float], ...]:
    got: dict[int, float] = {}
    for depth, label in enumerate(reversed(path)):
        for i, token in enumerate(label.split()):
            if token not in ("html", "body"):
                b = _bin(("." if i else "") + token, PATH_BINS)
                got[b] = max(got.get(b, 0.0), 1.0 if depth < 4 else 0.7)
    return tuple(got.items())


def vectors(blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    x = np.zeros((len(blocks), N_FEATURES), np.float32)
    for k, (path, text, linked) in enumerate(blocks):
        for b, v in _path_bins(path):
            x[k, b] = v
        words = text.split()
        bins = [zlib.crc32(w.encode("utf-8", "replace")) % WORD_BINS for w in words]
        x[k, PATH_BINS:-5] = np.bincount(bins, minlength=WORD_BINS) / np.sqrt(len(words)) / 4
        n = len(text)
        x[k, -5:] = (min(np.log1p(n) / 8, 1.5), min(linked / n, 1), text.count(".") / n * 20, k / len(blocks), 1)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output; arrays only, so it pickles small."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, N_FEATURES
        self.w = {}
        for way in "fb":
            self.w[way + "x"] = (rng.standard_normal((d, 4 * h)) / np.sqrt(d) * 2).astype(np.float32)
            self.w[way + "h"] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.w[way + "b"] = bias
        self.w["o"] = (rng.standard_normal(2 * h) / np.sqrt(2 * h)).astype(np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def _pass(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: time, pages, features. States of every time; steps off the mask carry the state on."""
        t, n, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        pre = x @ self.w[way + "x"] + self.w[way + "b"]
        hs, saved = np.zeros((t, n, HIDDEN), np.float32), []
        for s in range(t) if way == "f" else range(t - 1, -1, -1):
            z = pre[s] + h @ self.w[way + "h"]
            i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN : 2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[s][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            if keep:
                saved.append((s, h, c, i, f, o, g, tc, m))
            h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
            hs[s] = h
        return hs, saved

    def _back(self, way: str, x: np.ndarray, dhs: np.ndarray, saved: list) -> dict[str, np.ndarray]:
        wh = self.w[way + "h"]
        gx, gh, gb = np.zeros_like(self.w[way + "x"]), np.zeros_like(wh), np.zeros_like(self.w[way + "b"])
        dh = dc = np.zeros(dhs.shape[1:], np.float32)
        for s, h, c, i, f, o, g, tc, m in reversed(saved):
            dh = dh + dhs[s]
            dh2, dc2 = dh * m, dc * m
            dct = dc2 + dh2 * o * (1 - tc * tc)
            dz = np.concatenate((dct * g * i * (1 - i), dct * c * f * (1 - f), dh2 * tc * o * (1 - o), dct * i * (1 - g * g)), axis=1)
            gx += x[s].T @ dz
            gh += h.T @ dz
            gb += dz.sum(axis=0)
            dh, dc = dh * (1 - m) + dz @ wh.T, dc * (1 - m) + dct * f
        return {way + "x": gx, way + "h": gh, way + "b": gb}

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = (self._pass(way, x, mask, False)[0] for way in "fb")
        return sigmoid(f @ self.w["o"][:HIDDEN] + b @ self.w["o"][HIDDEN:] + self.w["c"])

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        (f, fs), (b, bs) = (self._pass(way, x, mask, True) for way in "fb")
        p = sigmoid(f @ self.w["o"][:HIDDEN] + b @ self.w["o"][HIDDEN:] + self.w["c"])
        n = mask.sum()
        d = ((p - y) * mask / n).astype(np.float32)
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        grad = {"o": np.concatenate(((f * d[..., None]).sum((0, 1)), (b * d[..., None]).sum((0, 1)))), "c": d.sum(keepdims=True).reshape(1)}
        grad |= self._back("f", x, d[..., None] * self.w["o"][:HIDDEN], fs) | self._back("b", x, d[..., None] * self.w["o"][HIDDEN:], bs)
        return loss, grad

    def label(self, pages: list[np.ndarray], size: int = 64) -> list[np.ndarray]:
        """For each page, whether each of its leaves is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and e - s < size and len(pages[order[e]]) * (e - s) < 20_000:
                e += 1
            own = order[s:e]
            x, mask = padded([pages[k] for k in own])
            p = self.scores(x, mask)
            for j, k in enumerate(own):
                out[k] = p[: len(pages[k]), j] > 0.5
            s = e
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), N_FEATURES), np.float32), np.zeros((t, len(pages)), np.float32)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, 1
    return x, mask


#: What surrounds articles in the made-up pages: wrapper tags by kind, to be filled with short texts.
AROUND = {
    "menu": ["<nav>", '<ul class="menu">', '<div class="navigation">', '<div id="nav">', '<div role="navigation">', '<div class="breadcrumbs">', '<ul class="nav">', '<div class="navbar">'],
    "header": ["<header>", '<div class="header">', '<div id="header">', '<div class="masthead">', '<div class="topbar">', '<div role="banner">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<div role="contentinfo">'],
    "sidebar": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div class="related">', '<div role="complementary">', '<section class="related">'],
    "notice": ['<div class="notice">', '<div class="cookie">', '<div class="cookie-notice">', '<div class="alert">', '<div class="popup">', '<div id="cookie-banner">', '<div class="subscribe">', '<div class="newsletter">', '<div class="share">', '<div class="social">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="banner">', '<div class="promo">', '<div class="sponsored">', '<div id="ad-1">'],
    "form": ["<form>", '<form class="search">', '<div class="form">', '<form id="login">'],
    "comments": ['<div class="comments">', '<section class="comments">', '<div id="comments">', '<ol class="comment-list">', '<div class="comment">', '<div class="replies">', '<div id="disqus">', '<ul class="comments">'],
}
ARTICLE = ["<article>", "<article>", "<article>", "<article>", "<main>", '<div class="content">', '<div class="post">', '<div class="article">', '<div id="content">', '<div class="entry-content">', '<div class="story">', '<article class="post">', '<div role="main">', '<main><article>', '<div class="article-body">', '<div class="post-content">']


def _closing(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", opening)))


def sample_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A made-up page, and for each of its leaves whether it is main text."""
    labels: list[bool] = []

    def words(low: int, high: int) -> str:
        own = ["".join(rng.choices("etaoinshrdlucmfwypvbgkqjxz", k=rng.randint(1, 11))) for _ in range(rng.randint(low, high))]
        text = " ".join(w + rng.choice(["", "", "", "", ".", ","]) for w in own)
        return text[:1].upper() + text[1:]

    def leaf(main: bool, low: int, high: int) -> str:
        labels.append(main)
        text = words(low, high)
        if rng.random() < 0.2:
            text = f"<{(t := rng.choice(['b', 'a', 'em', 'span', 'strong']))}>{text}" + (f"</{t}>" if rng.random() < 0.8 else "")
        return text

    def around(kind: str) -> str:
        opening = rng.choice(AROUND[kind])
        out = opening
        if kind in ("menu",) or rng.random() < 0.2:
            n = rng.randint(1, 9)
            items = [f'<li><a href="/{k}">{leaf(False, 1, 3)}</a></li>' for k in range(n)]
            out += "".join(items) if opening.startswith(("<ul", "<ol")) else "<ul>" + "".join(items) + "</ul>"
        elif kind == "form":
            for _ in range(rng.randint(1, 3)):
                out += f"<p><label>{leaf(False, 1, 4)}</label><input type=text>" + ("<button>" + words(1, 2) + "</button></p>" if rng.random() < 0.4 else "</p>")
                if out.endswith("</button></p>"):
                    labels.append(False)
        else:
            low, high = (3, 60) if kind in ("comments", "sidebar") else (1, 30)
            for k in range(rng.randint(1, 4)):
                if k == 0 and rng.random() < 0.5:
                    out += leaf(False, low, high)
                else:
                    t = rng.choice(["p", "div", "p", "h3", "span", "h2"] if k else ["p", "h3", "h2", "h1", "p"])
                    if t == "span":
                        out += "<br>" + leaf(False, low, high)
                    else:
                        out += f"<{t}>{leaf(False, low, high)}</{t}>"
        return out + _closing(opening)

    def article() -> str:
        opening = rng.choice(ARTICLE)
        out = opening
        wrap = rng.random() < 0.15
        if wrap:
            out += rng.choice(["<div>", "<section>", '<div class="body">', '<div class="text">'])
        if rng.random() < 0.85:
            out += f"<h1>{leaf(True, 2, 14)}</h1>"
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.08:
                out += around(rng.choice(["advert", "sidebar", "comments", "form", "notice", "menu", "advert"]))
            elif r < 0.16:
                out += f"<{(t := rng.choice(['h2', 'h3', 'blockquote', 'pre']))}>{leaf(True, 2, 25)}</{t}>"
            elif r < 0.22:
                out += "<ul>" + "".join(f"<li>{leaf(True, 1, 20)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
            elif r < 0.26:
                out += "<table>" + "".join(f"<tr><td>{leaf(True, 1, 5)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>"
            elif r < 0.36:
                out += f"<p>{leaf(True, 1, 60)}<br>{leaf(True, 1, 40)}</p>"
            else:
                out += f"<p>{leaf(True, 1, 120)}" + ("</p>" if rng.random() < 0.85 else "")
        if rng.random() < 0.12:
            out += around("comments")
        return out + ("</div>" if wrap and rng.random() < 0.9 else "") + _closing(opening)

    parts = []
    before = rng.sample(["menu", "header", "advert", "notice", "sidebar", "form"], rng.randint(0, 4))
    after = rng.sample(["comments", "footer", "sidebar", "advert", "notice", "menu"], rng.randint(0, 4))
    for kind in before:
        parts.append(around(kind))
    if rng.random() < 0.97:
        parts.append(article())
    for kind in after:
        parts.append(around(kind))
    if rng.random() < 0.1:
        parts = ['<div class="wrapper">', *parts, "</div>"]
    page = "<!DOCTYPE html><html><head><title>" + words(1, 5) + "</title><style>p{x:y}</style></head><body>" + "".join(parts) + "</body></html>"
    if rng.random() < 0.15:
        page = page[: rng.randint(len(page) // 2, len(page))]
    return page, labels


def samples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out = random.Random(seed), []
    while len(out) < n:
        page, labels = sample_page(rng)
        found = leaves(page)
        if found and len(found) <= len(labels):
            out.append((vectors(found), np.array(labels[: len(found)], np.float32)))
    return out


@cache
def trained(seed: int = 1, pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    model, rows = Labeller(seed), samples(pages, seed)
    rng = np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in model.w.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(rows)).tolist(), key=lambda k: len(rows[k][0]) // 12)
        groups = [order[s : s + 32] for s in range(0, len(order), 32)]
        for g in rng.permutation(len(groups)).tolist():
            x, mask = padded([rows[k][0] for k in groups[g]])
            y = np.zeros_like(mask)
            for j, k in enumerate(groups[g]):
                y[: len(rows[k][1]), j] = rows[k][1]
            _, grad = model.gradient(x, mask, y)
            step += 1
            rate = 0.02 * (0.5 ** (epoch / 5))
            norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            for k, v in grad.items():
                v = v / max(1.0, norm)
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                model.w[k] = (model.w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    blocks = [leaves(p or "") for p in pages]
    marks = model.label([vectors(b) for b in blocks])
    return [" ".join(text for (_, text, _), main in zip(b, m.tolist(), strict=True) if main) for b, m in zip(blocks, marks, strict=True)]


def _extract(model: Labeller):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    return shared.text_batches(pages).selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_extract(trained()), "page_id long, url string, text string, n_chars long")
