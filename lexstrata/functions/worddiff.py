"""Word-level differences of two texts (Arrow UDF): the shortest edit script over tokens."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Unicode property White_Space, which neither str.isspace nor \s of re is equal to.
_SPACE = "\t-\r \x85\xa0  -     　"
_TOKEN = re.compile(f"[{_SPACE}]+|[^{_SPACE}]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def edits(old: list[str], new: list[str]) -> list[tuple[str, int | None, int | None, str]]:
    """Deletions and insertions (value, old index, new index, tag) of a shortest script, deletions first where both meet."""
    lo = 0
    while lo < min(len(old), len(new)) and old[lo] == new[lo]:
        lo += 1
    hi = 0
    while hi < min(len(old), len(new)) - lo and old[-1 - hi] == new[-1 - hi]:
        hi += 1
    a, b = old[lo : len(old) - hi], new[lo : len(new) - hi]
    gone, come = _script(a, b)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and i in gone:
            out.append((a[i], lo + i, None, "delete"))
            i += 1
        elif j < len(b) and j in come:
            out.append((b[j], None, lo + j, "insert"))
            j += 1
        else:
            i, j = i + 1, j + 1
    return out


def _script(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Indexes deleted from a and inserted into it to make b: all but a longest common subsequence.

    Divide and conquer in linear space: a is cut in the middle, b where the common subsequences of both halves are longest.
    """
    gone, come = set(range(len(a))), set(range(len(b)))
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            gone.discard(i)
            come.discard(j)
            i, j = i + 1, j + 1
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                gone.discard(i)
                come.discard(b.index(a[i], j, m))
            continue
        mid = (i + k) // 2
        both = _common(a[i:mid], b[j:m]) + _common(a[mid:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int(both.argmax())
        todo += [(i, mid, j, cut), (mid, k, cut, m)]
    return gone, come


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and each prefix of b, a bit of one integer for each step along b."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = rows = (1 << len(b)) - 1
    for x in a:
        if hit := where.get(x, 0) & rows:
            rows = (rows + hit | rows - hit) & full
    steps = np.unpackbits(np.frombuffer(rows.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)] == 0
    return np.concatenate(([0], np.cumsum(steps)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("old_index", T.IntegerType()), T.StructField("new_index", T.IntegerType()), T.StructField("tag", T.StringType())])))
def word_changes(old: pd.Series, new: pd.Series) -> pd.Series:
    """Null counts as empty. Filter equal texts out before: this is the one operator that leaves the JVM."""
    names = ("value", "old_index", "new_index", "tag")
    return pd.Series([[dict(zip(names, e, strict=True)) for e in edits(tokens(a or ""), tokens(b or ""))] for a, b in zip(old, new, strict=True)])
