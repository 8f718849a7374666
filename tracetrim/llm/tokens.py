"""Token ids of whole texts by the ``tokenizers`` library, with each distinct piece encoded once.

A byte-level BPE never merges across its pre-tokens, and a pre-token never crosses a
single space between two non-blank characters.  So a text is cut at spaces, every
distinct piece (with its leading space) is encoded by the tokenizer's own model, and
the ids are put together from a bounded cache.  Texts for which that cut is not exact
(two or more blanks in a row around a space, characters whose class differs between
regex libraries, special-token strings) go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
_LITTLE = sys.byteorder == "little"
_ENCODERS: dict[str, "PieceEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def encoder(path: str | None) -> "PieceEncoder":
    """One encoder for each worker process and tokenizer file (null: the default file on that machine)."""
    path = path or default_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Learnt(dict):
    """A dict that fills itself: key -> ids by ``make``."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.make(key)
        return found


class PieceEncoder:
    #: Characters for which ``re`` and the tokenizer's regex agree on letter, number, blank and other.
    _ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ώА-я‐-‧]")
    _BLANKS = re.compile(r"\s \s|\s \Z|\A \s")
    _NEAR_BLANKS = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")
    _PRETOKEN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, path: str, cache_pieces: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.cache_pieces = cache_pieces
        self.letters = _byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Learnt(self._piece)  # what stands between two spaces -> ids of it with the space before
        self.words = _Learnt(self._word)  # other pre-tokens -> ids
        self.exact_cut = self._agrees()

    def _agrees(self) -> bool:
        """A trial on a fixed text: tokenizers of another kind than byte-level BPE are always given whole texts."""
        trial = "It's a  trial, isn't it?\nYes: 12 of 345 étés; we'll see _x_ ok"
        try:
            return self._cut(trial) == self._whole(trial)
        except Exception:  # noqa: BLE001 - its model can't take byte letters
            return False

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._word(" " + piece)
        return b"".join([self.pieces[w[1:]] if w[0] == " " and w[1:].isalpha() else self.words[w] for w in self._PRETOKEN.findall(" " + piece)])

    def _cut(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        head = b"".join(map(self.words.__getitem__, self._PRETOKEN.findall(first)))
        return head + b"".join(map(self.pieces.__getitem__, rest))

    def _by_pieces(self, text: str) -> bool:
        if self._ODD.search(text) or any(s in text for s in self.specials):
            return False
        return not (any(b in text for b in self._NEAR_BLANKS) and self._BLANKS.search(text))

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, as little-endian unsigned 32-bit integers."""
        if len(self.pieces) + len(self.words) > self.cache_pieces:
            self.pieces.clear()
            self.words.clear()
        ids = self._cut(text) if self.exact_cut and self._by_pieces(text) else self._whole(text)
        return ids if _LITTLE else np.frombuffer(ids, ">u4").astype("<u4").tobytes()
