"""Whole texts encoded by the tokenizers library, word by word.

Both public vocabularies split a text before any merge, and a split never depends on what stands before a space that
follows a non-space. So a text is cut at such spaces, every different piece is encoded once by the library, and the ids
of the pieces are joined. A worker keeps the pieces it has met up to a fixed number, so memory does not follow the
corpus. Ids are those of encoding the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Pieces, and parts of pieces, that one worker keeps; all are dropped when the number is reached. Memory settings,
#: without effect on ids.
KEPT_PIECES, KEPT_PARTS = 600_000, 1_000_000

_INSIDE_RUN = re.compile(r"\s (?=\s|\Z)")
_SPLIT = re.compile(r"(?<=\S)(?= )")
#: Letters beyond ASCII of which every Unicode version says the same, and that no normalisation joins or takes apart.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_COMMON = re.compile(rf"[\x00-\x1b\x20-\x7f{_LATIN}]*")
#: How the two vocabularies split such text into words before merging.
_WORDS = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[^\sA-Za-z0-9{_LATIN}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\sa-z0-9{_LATIN}]+"),
}


def _letters() -> dict[int, str]:
    """For each byte the letter that stands for it in the vocabulary: visible Latin-1 as itself, the rest from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class PieceEncoder:
    """Encodes texts with a tokenizer file; ids come as little-endian bytes of the given width."""

    def __init__(self, path: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Byte-level vocabularies keep white space; the other drops it and lower-cases.
        self.kind = "byte" if self.tokenizer.normalizer is None else "word"
        self.words, self.letters, self.model = _WORDS[self.kind], _letters(), self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.dtype(f"<u{width}")
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        if self.kind == "word":
            return text.split(" ")
        if _INSIDE_RUN.search(text):
            return _SPLIT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _library(self, pieces: list[str]) -> None:
        for x, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.pieces[x] = np.array(e.ids, self.width).tobytes()

    def _words_of(self, piece: str) -> tuple[str, ...] | list[str]:
        if self.kind == "word":
            return (piece,) if piece.isalpha() else self.words.findall(piece)
        return (piece,) if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha() else self.words.findall(piece)

    def _learn(self, pieces: set[str], common: bool) -> None:
        """Words in common letters go straight to the library's model, all else through the whole of the library."""
        whole, cut = [], {}
        for x in pieces:
            if common or _COMMON.fullmatch(x) and not any(s in x for s in self.specials):
                cut[x] = self._words_of(x.lower() if self.kind == "word" else x)
            else:
                whole.append(x)
        self._library(whole)
        parts, tokenize, code = self.parts, self.model.tokenize, "H" if self.width.itemsize == 2 else "I"
        for words in cut.values():
            for x in words:
                if x not in parts:
                    letters = x.encode().decode("latin-1").translate(self.letters)
                    parts[x] = array(code, [t.id for t in tokenize(letters)]).tobytes()
        for x, words in cut.items():
            self.pieces[x] = parts[words[0]] if len(words) == 1 else b"".join([parts[y] for y in words])

    def _known(self, texts: list[str], common: bool) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 256):
            cut = [self._cut(t) for t in texts[at:at + 256]]
            if len(self.pieces) > KEPT_PIECES:
                self.pieces.clear()
            if len(self.parts) > KEPT_PARTS:
                self.parts.clear()
            if new := set().union(*cut) - self.pieces.keys():
                self._learn(new, common)
            get = self.pieces.__getitem__
            out += [b"".join(map(get, x)) for x in cut]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Texts in common letters only need no further look at their pieces, and may be lower-cased."""
        common = [bool(_COMMON.fullmatch(t)) and not any(s in t for s in self.specials) for t in texts]
        easy = [t.lower() if self.kind == "word" else t for t, c in zip(texts, common, strict=True) if c]
        easy, rest = iter(self._known(easy, True)), iter(self._known([t for t, c in zip(texts, common, strict=True) if not c], False))
        return [next(easy if c else rest) for c in common]


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, width: int = 4) -> PieceEncoder:
    """One encoder for each worker process and file."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = PieceEncoder(path, width)
    return _ENCODERS[path, width]


def id_width(path: str) -> int:
    """Bytes that hold every id of the vocabulary: 2 or 4."""
    from tokenizers import Tokenizer
    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
