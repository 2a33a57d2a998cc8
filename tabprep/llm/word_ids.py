"""Ids of whole texts by one store of words.

A text in common letters is cut into words by one pass of the vocabulary's pattern, and every word's ids come from the
store; a word that is met for the first time goes straight to the library's model. All other texts go through the general
encoder. Compared with a store of pieces between spaces, words with different punctuation around them share one entry.
"""

from __future__ import annotations

from array import array

from tabprep.llm.tokens import _COMMON, PieceEncoder

#: Words that a worker keeps; all are dropped when the number is reached. Longer words are not kept. Memory settings,
#: without effect on ids.
KEPT_WORDS, KEPT_LENGTH = 600_000, 64


class _Words(dict):
    """Ids of words as little-endian bytes, found by the model when first asked for."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.tokenize, self.letters, self.code = encoder.model.tokenize, encoder.letters, "H" if encoder.width.itemsize == 2 else "I"

    def __missing__(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()
        if len(word) <= KEPT_LENGTH:
            self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts with a tokenizer file; ids come as little-endian bytes of the given width."""

    def __init__(self, path: str, width: int):
        self.general = PieceEncoder(path, width)
        self.words, self.cut, self.lower = _Words(self.general), self.general.words.findall, self.general.kind == "word"

    def encode(self, text: str) -> bytes:
        if _COMMON.fullmatch(text) and not any(s in text for s in self.general.specials):
            if len(self.words) > KEPT_WORDS:
                self.words.clear()
            return b"".join(map(self.words.__getitem__, self.cut(text.lower() if self.lower else text)))
        return self.general.encode([text])[0]


_ENCODERS: dict[tuple, WordEncoder] = {}


def word_encoder(path: str, width: int) -> WordEncoder:
    """One encoder for each worker process and file."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = WordEncoder(path, width)
    return _ENCODERS[path, width]
