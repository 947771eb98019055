"""Pieces joined for the tokenizers library: the ids are those of whole texts, from few calls."""

import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm import tokens

ODD = [
    "İstanbul İİ İx ﬁne ŉx ΑΣ ΑΣΑ", "don't can't o'clock 'tis x's", "日本語 テキスド 한국어 한", "áb é é ñ̃",
    "ª º ǅ ʰ ⅷ ² ½ 12 3x x3 ٣", "</w> Ġ Ġa aĠ <|endoftext|> a</w>", "𝔘𝔫𝔦 🙂 a🙂 ‍x ­x ẞ", "  two  blanks \n\tx\ny ", None, "", " ",
    "\x00 x\x00y \x7f", "ՙ ߴ เสี क्षि ক", "Word word WORD, wórd; wórd! (wórd)",
]


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)

    def encode(self, *args, **options):
        return self.inner.encode(*args, **options)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("memo", [400_000, 150])
def test_joined_words(monkeypatch, name, memo):
    monkeypatch.setattr(tokens, "MEMO_PIECES", memo)
    e = tokens.PieceEncoder(tokens.tokenizer_path(name))
    made = ["".join(chr(97 + (i * k) % 26) for k in range(1, 3 + i % 7)) for i in range(2000)]
    texts = ODD + [" ".join(made[a : a + 50]) for a in range(0, 2000, 50)] + ODD[::-1]
    library = e.tokenizer
    e.tokenizer = Counted(library)
    for at in range(0, len(texts), 20):  # a small memo is emptied between batches
        some = texts[at : at + 20]
        ids, begin = e.encode(pa.array(some, pa.string()))
        for k, text in enumerate(some):
            expected = library.encode(text or "", add_special_tokens=False).ids
            assert ids[begin[k] : begin[k + 1]].tolist() == expected, text
    fresh = tokens.PieceEncoder(tokens.tokenizer_path(name))
    fresh.tokenizer = Counted(library)
    words = sorted(set(made))
    ids, begin = fresh.encode(pa.array([" x " + " ".join(words)]))
    assert ids.tolist() == library.encode(" x " + " ".join(words), add_special_tokens=False).ids
    assert fresh.tokenizer.texts < 10 < 100 < len(words)


def test_words_that_the_library_splits_are_encoded_one_by_one():
    e = tokens.PieceEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    words = ["İab", "abc", "xİ"] * 40 + ["de"] * 90  # İ becomes i and a mark, a piece of its own
    ids, lengths = e._joined(words)
    lists = [e.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert lengths.tolist() == [len(x) for x in lists]
    assert np.array_equal(ids, np.concatenate(lists))


def test_words_of_latin_letters_skip_the_steps_before_the_model():
    e = tokens.PieceEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    library = e.tokenizer
    e.tokenizer = Counted(library)
    words = ["Word", "WORD", "word", "éÀñ", "Straße", "ÿÞþ", "aæØ", "x", "É", "naïve"] + [f"{a}{b}t" for a in "aeÉü" for b in "rstÖ"]
    for blanks in (" ", "\n", " \t\r\n\x0b\x0c "):
        text = blanks.join(words) + blanks
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert e.tokenizer.texts == 0
    # A letter before a combining mark, beyond Latin-1 or with a mark of its own takes every step.
    for text in ("J\u030c j\u030c A\u030a", "ĳ ŉ Ā ſ ª º µ", "don't don'T a×b a÷b x's"):
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert e.tokenizer.texts > 0
    assert tokens.PieceEncoder(tokens.tokenizer_path("byte_bpe_50k.json")).short_ways == []
