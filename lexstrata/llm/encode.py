"""Texts to token ids with a public tokenizer file, word by word through a bounded memo.

The pre-tokenizers of the byte-level and of the word-end BPE files never join text across a space that a printable ASCII
or Latin character follows: a pre-token can begin with that space, never contain it. So a text may be cut before such
spaces and each part encoded alone; the ids are those of the whole text. Parts repeat (they are mostly single words), so each
worker keeps a memo of at most MEMO parts, and encodes what a run of texts lacks in a few calls. Any other white space stays
inside a part, but for newlines where the file takes all white space as one space.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np

MEMO = 1_000_000
#: A full memo is emptied once so many parts weren't in it, in case the texts have changed.
STALE = 10 * MEMO
LONGEST = 20
RUN_CHARS = 1 << 21
_SAFE = re.compile(r" (?=[!-~À-ÖØ-öø-ÿ])")
_OTHER = re.compile(r" (?![!-~À-ÖØ-öø-ÿ])")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Letters, then a few punctuation marks (no apostrophe): two pre-tokens.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,:;!?#$%&*]{1,3})")


@cache
def encoder(path: str) -> Encoder:
    """The worker process's own; `path` must be readable on the executors."""
    return Encoder(path)


class Encoder:

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.missed = 0
        a = self.tokenizer.encode_batch_fast(["Á", "á"], add_special_tokens=False)
        self.folds = a[0].ids == a[1].ids  # case doesn't matter to this file
        a = self.tokenizer.encode_batch_fast(["a b", "a\nb", "a \n\n b"], add_special_tokens=False)
        self.blanks = a[0].ids == a[1].ids == a[2].ids  # any white space is as good as one space
        self.marks: dict[str, bytes] = {}
        names = {i: t for t, i in self.tokenizer.get_vocab().items()}
        texts = [names.get(i, "") for i in range(max(names) + 1)]
        self.begins = np.array([t.startswith("\u0120") for t in texts])  # of a byte-level file: the space before a word
        self.ends = np.array([t.endswith("</w>") for t in texts])

    def encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of " word" for words of letters only, in one call: each is one pre-token, whose first or last id shows."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(self.begins[ids])
        edges = np.append(cut, len(ids)) if len(cut) else np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        if len(edges) != len(words) + 1 or edges[0] != 0 or edges[-1] != len(ids):
            return self.encode([" " + w for w in words])
        raw, edges = ids.tobytes(), (4 * edges).tolist()
        return [raw[s:e] for s, e in zip(edges, edges[1:], strict=False)]

    def lacking(self, parts: set[str]) -> dict[str, bytes]:
        """The ids of " part" for parts that the memo lacks."""
        marked = {p: m for p in parts if (m := _MARKED.fullmatch(p))}
        fold = str.lower if self.folds else str
        plain = {p: fold(p) for p in parts if p not in marked and _LETTERS.fullmatch(p)}
        stems = {p: fold(m[1]) for p, m in marked.items()}
        rest = [p for p in parts if p not in marked and p not in plain]
        memo = self.memo
        words = [w for w in {*plain.values(), *stems.values()} if w not in memo]
        got = dict(zip(words, self.words(words), strict=True))
        for p, w in plain.items():
            got[p] = got[w] if w in got else memo[w]
        for p, m in marked.items():
            if m[2] not in self.marks:
                self.marks[m[2]] = self.encode([m[2]])[0]
            w = stems[p]
            got[p] = (got[w] if w in got else memo[w]) + self.marks[m[2]]
        got |= dict(zip(rest, self.encode([" " + p for p in rest]), strict=True))
        return got

    def all_ids(self, texts: list[str | None], end: int) -> Iterator[bytes]:
        """For each text, little-endian unsigned 32-bit ids of the whole text, then `end`; null counts as empty."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last] or "") <= RUN_CHARS):
                size += len(texts[last] or "")
                last += 1
            yield from self._run(texts[first:last], end)
            first = last

    def _run(self, texts: list[str | None], end: int) -> Iterator[bytes]:
        parts: list[str] = []
        cuts = [0]
        heads = []
        for text in texts:
            if text:
                if self.blanks:
                    text = text.replace("\n", " ")
                    while "  " in text:
                        text = text.replace("  ", " ")
                own = _SAFE.split(text) if _OTHER.search(text) else text.split(" ")
                heads.append(own[0])
                own[0] = ""
                parts += own
            else:
                heads.append("")
                parts.append("")
            cuts.append(len(parts))
        memo = self.memo
        memo[""] = b""
        ids = list(map(memo.get, parts))
        lacking = [i for i, x in enumerate(ids) if x is None]
        if lacking:
            got = self.lacking({parts[i] for i in lacking})
            for i in lacking:
                ids[i] = got[parts[i]]
            if len(memo) + len(got) <= MEMO:
                memo.update((p, x) for p, x in got.items() if len(p) <= LONGEST)
            elif (missed := self.missed + len(got)) > STALE:
                memo.clear()
                self.missed = 0
            else:
                self.missed = missed
        tail = end.to_bytes(4, "little")
        for head, s, e in zip(self.encode(heads), cuts, cuts[1:], strict=False):
            yield b"".join([head, *ids[s:e], tail])


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
