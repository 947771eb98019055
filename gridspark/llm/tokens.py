"""Whole texts to token ids with the ``tokenizers`` library, each distinct piece encoded once.

Texts are cut where the tokenizer cuts anyway (at blanks), the pieces of a batch are dictionary
encoded by Arrow, and only pieces not met before by this worker go to the library. Most are words of
letters only; the library gets ``JOINED`` of them as one text, and their ids are told apart by the tokens
that open a word (byte level) or end one. Words of ASCII or Latin-1 letters, lower-cased here, are what the
normaliser and the word pattern of ``_WORD_BPE`` would hand on, so they go to the same model without those
two steps, which take half of the library's time. The result equals encoding the whole text; texts holding a
special token's string, or white space other than ASCII's, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridspark.llm.common import ASCII_SPACE, byte_class, text_bytes

MEMO_PIECES = 400_000
JOINED = 100  # words in one call; a text of some hundred ids takes the library least time a word
_MARK, _LETTER = byte_class(b".,;:!?|%*#$&"), byte_class(ascii_letters.encode())
_BLANKS = " \t\n\x0b\x0c\r"
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
# The steps before the model for which a lower-cased word of letters is its own only piece.
_WORD_BPE = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
_ASCII_WORD, _LATIN_WORD = r"\A[A-Za-z]+[ \t\n\v\f\r]*\z", r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+[ \t\n\v\f\r]*\z"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes batches of texts; keeps the ids of up to ``MEMO_PIECES`` pieces between batches."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # every core has a worker of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if plain_specials:  # their strings are ordinary text
            self.tokenizer.encode_special_tokens, self.special = True, []
        # A tokenizer with a normaliser here drops blanks; the byte-level one keeps them.
        self.keeps_blanks = self.tokenizer.normalizer is None
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that open or end a word
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.keeps_blanks else t.endswith("</w>"))]] = True
        self.short_ways = self._short_ways()
        self._forget()

    def _short_ways(self) -> list[tuple]:
        """Patterns of words that need no normaliser and no word pattern, each with a tokenizer without them."""
        from tokenizers import Tokenizer, pre_tokenizers as pre

        steps = json.loads(self.tokenizer.to_str())
        splits = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        if ((steps["normalizer"] or {}).get("normalizers"), splits and splits[0].get("pattern", {}).get("Regex")) != _WORD_BPE or [
            x["type"] for x in splits
        ] != ["Split", "ByteLevel"]:
            return []
        ascii_only, latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        ascii_only.pre_tokenizer = pre.WhitespaceSplit()  # an ASCII letter is its own byte-level character
        latin.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        return [(_ASCII_WORD, ascii_only), (_LATIN_WORD, latin)]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(MEMO_PIECES + 2, np.int32)
        self.used = 0

    def _is_word(self, piece: str) -> bool:
        """Whether it is one word of letters to the tokenizer; at byte level a space opens it."""
        return piece[0] == " " and piece[1:].isalpha() if self.keeps_blanks else piece.rstrip(_BLANKS).isalpha()

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths

    def _joined(self, words: list[str], short_way=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        texts = [("" if self.keeps_blanks else " ").join(group) for group in groups]
        if short_way:
            texts = [text.lower() for text in texts]
        parts = []
        for group, e in zip(groups, (short_way or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            bounds = np.flatnonzero(self.edge[ids])
            bounds = np.append(bounds, len(ids)) if self.keeps_blanks else np.append(0, bounds + 1)
            # Every word has an opening (ending) token, so as many as words means one each.
            whole = len(bounds) == len(group) + 1 and bounds[0] == 0 and bounds[-1] == len(ids)
            parts.append((ids, np.diff(bounds)) if whole else self._each(group))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _learn(self, pieces: np.ndarray) -> np.ndarray:
        """Keep the ids of these new pieces; returns their numbers."""
        at, rest, kinds = np.empty(len(pieces), np.int32), np.ones(len(pieces), bool), []
        if self.short_ways and len(pieces):
            column = pa.array(pieces, pa.large_string())
            for pattern, tokenizer in self.short_ways:
                mine = pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False) & rest
                kinds.append((lambda some, tokenizer=tokenizer: self._joined(some, tokenizer), np.flatnonzero(mine)))
                rest &= ~mine
        rest = np.flatnonzero(rest)
        is_word = np.fromiter(map(self._is_word, pieces[rest].tolist()), bool, len(rest))
        kinds += [(self._joined, rest[is_word]), (self._each, rest[~is_word])]
        for encode, kind in kinds:
            for start in range(0, len(kind), 20_000):
                where = kind[start : start + 20_000]
                some = pieces[where].tolist()
                at[where] = np.arange(len(self.known), len(self.known) + len(some))
                self._keep(some, *encode(some))
        return at

    def _keep(self, some: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        k = len(self.known)
        self.known.update(zip(some, range(k, k + len(some))))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(ids)), np.uint32)])
        if k + len(some) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(some)), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[k + 1 : k + len(some) + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)

    def _ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the kept pieces at these numbers, one after another, and how many each has."""
        first, length = self.starts[at], np.diff(self.starts)[at]
        ends = np.cumsum(length, dtype=np.int64)
        where = np.repeat((first - ends + length).astype(np.int32), length)
        where += np.arange(len(where), dtype=np.int32)
        return self.ids[where], length

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        blank = ASCII_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        if self.keeps_blanks:
            # One blank between two other characters starts a piece; a space opens the next word,
            # any other blank is a piece of its own.
            one = np.flatnonzero(blank[1:-1] & ~blank[:-2] & ~blank[2:]) + 1
            cut[one] = True
            cut[one[data[one] != 0x20] + 1] = True
        else:
            cut[1:-1] = ~blank[1:] & blank[:-1]
        cut[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]  # a mark after a letter is a piece anyway
        # Neighbours in another text don't count: around its ends a text isn't cut at a blank.
        if self.keeps_blanks:
            for edge in (offsets[1:-1] - 1, offsets[1:-1], offsets[1:-1] + 1):
                edge = edge[(edge > 0) & (edge < len(data))]
                cut[edge] = False
        cut[offsets] = True
        cut[-1] = True
        return np.flatnonzero(cut)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after another, and where each text's ids begin."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        cuts = self._cuts(data, offsets)
        pieces = pa.LargeStringArray.from_buffers(
            len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
        ).dictionary_encode()
        index = pieces.indices.to_numpy()
        words = pieces.dictionary.to_numpy(zero_copy_only=False)  # of str; to_pylist takes ten times as long
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.known) + len(new) > MEMO_PIECES:
            held = np.flatnonzero(at >= 0)
            ids, lengths = self._ids_of(at[held])
            self._forget()
            self._keep(words[held].tolist(), ids, lengths)
            at[held] = np.arange(len(held))
        at[new] = self._learn(words[new])
        out, length = self._ids_of(at[index])
        ends = np.cumsum(length, dtype=np.int64)
        begin = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]
        return self._whole(column, out, begin)

    def _whole(self, column: pa.Array, out: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put in the library's own ids for texts that can't be cut."""
        odd = [
            i
            for i, t in enumerate(column.to_pylist())
            if t and (_ODD.search(t) or any(s in t for s in self.special))
        ]
        if not odd:
            return out, begin
        parts = [out[begin[i] : begin[i + 1]] for i in range(len(begin) - 1)]
        texts = column.to_pylist()
        for i in odd:
            parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and file."""
    return PieceEncoder(path)


@lru_cache(maxsize=4)
def plain_encoder(path: str) -> PieceEncoder:
    """As :func:`encoder`, with the strings of special tokens as plain text."""
    return PieceEncoder(path, plain_specials=True)
