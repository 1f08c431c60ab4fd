"""Vectorised word splitting and hashing over batches of texts (numpy, inside tasks).

All functions take UTF-8 bytes. Hashes are 64-bit: a polynomial over the word's bytes (one cumulative sum for a
whole batch, shifted back by the inverse power), passed through a finalizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text per numpy batch; the uint64 arrays of a batch take about 50 times as much at the peak.
BATCH_BYTES = 1 << 19

_BASE = 6364136223846793005
_U = np.uint64


def byte_table(chars: str | bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode("latin-1") if isinstance(chars, str) else chars)] = True
    return table


#: Words split at ASCII white space: [^\x20\x09-\x0D]+
SPACED = ~byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of ASCII letters and digits and anything beyond ASCII, for lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PLAIN = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = {_BASE: np.ones(1, _U), pow(_BASE, -1, 1 << 64): np.ones(1, _U)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        p = np.full(max(n, BATCH_BYTES * 5 // 4), base, _U)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(pow(_BASE, -1, 1 << 64), n)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """c with hash of b[s:e] = (c[e] - c[s]) * inverse(s)."""
    c = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * powers(_BASE, len(b)), out=c[1:])
    return c


def span_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((c[e] - c[s]) * inverse_powers(len(c))[s])


def batches(texts: list, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) in runs of about limit bytes; None counts as empty."""
    run, first, size = [], 0, 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(raw) > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


class Words:
    """The words of some texts: starts, ends (into `raw`), doc (index of the text), hashes, cut (first word of each text)."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool):
        self.bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = LOWER[b] if lower else b
        inside = table[self.raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = span_hash(prefix_hash(self.raw), self.starts, self.ends)
        self.cut = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.cut)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every n consecutive words of one text."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        h = np.full(len(at), n, _U)
        for k in range(n):
            h = mix(h * _U(3) + self.hashes[at + k])
        return at, h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    span = 1
    while span < w:
        step = min(span, w - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x
