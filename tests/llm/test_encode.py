import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexstrata.llm import encode

ODD = ["", "a  b", "x\n\n y", " lead", "trail ", "<|endoftext|> hi", " <|endoftext|>", "it's 'll  'S", "é à ñandú", " x 　y", "a ́b", "x\t y 12345 67", "日本 語 text", "\x1c \x1d a", None, "don't  stop <| a |>", "word, word. word? 5, a.", "İ ŞA ẞ"]
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {n: encode.Encoder(encode.public_path(n)) for n in NAMES}


def whole(e, text, end):
    return np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@pytest.mark.parametrize("name", NAMES)
def test_equals_whole_texts(name):
    e = ENCODERS[name]
    for _ in range(2):
        assert list(e.all_ids(ODD, 7)) == [whole(e, t, 7) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab AÉñ.,*&'\n\t1<|> ́日", max_size=40), max_size=6))
def test_equals_whole_texts_at_random(texts):
    for e in ENCODERS.values():
        assert list(e.all_ids(texts, 0)) == [whole(e, t, 0) for t in texts]


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(encode, "MEMO", 50)
    monkeypatch.setattr(encode, "STALE", 90)
    monkeypatch.setattr(encode, "RUN_CHARS", 40)
    e = encode.Encoder(encode.public_path(NAMES[0]))
    texts = [f"w{i} v{i} the" for i in range(300)]
    assert list(e.all_ids(texts, 0)) == [whole(e, t, 0) for t in texts]
    assert len(e.memo) <= 50


def test_words_of_a_large_vocabulary_are_encoded_once():
    """400,000 different words, in runs: a second pass finds all of them in the memo."""
    own = encode.Encoder(encode.public_path("word_bpe_49k.json"))
    texts = [" ".join(f"{a}{b}{c}{d}" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" for d in "abcdefghij") for a in ("".join(x) for x in zip("abcdefghij" * 10, "klmnopqrst" * 10, (chr(97 + i // 10) for i in range(100)), strict=True))]
    first = list(own.all_ids(texts, 1))
    lacked = []
    own.lacking = lacked.append
    assert list(own.all_ids(texts, 1)) == first and not lacked
