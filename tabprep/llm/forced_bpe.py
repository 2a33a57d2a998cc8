"""Byte-pair encoding cut at forced boundaries, and decoding.

A pair of bytes that stands inside no vocabulary token can never be merged over, so a text may be cut there and the
fragments encoded on their own. The cut is used only where the vocabulary's word pattern cannot tell a fragment from the
whole text either: the byte before is visible ASCII, the byte after starts a character and is no apostrophe (which could
open a contraction). White space then stays whole, and both patterns split alike on either side of the cut.
Added tokens are found in the text before anything else, the leftmost and then the longest first.

Fragments repeat, so a worker keeps those it has met up to a fixed number.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabprep.llm.arrow import id_and_text, in_blocks, rows_batch, text_bytes

#: Fragments that one worker keeps; all but the added tokens are dropped when the number is reached. A memory setting, without effect on ids.
KEPT_FRAGMENTS = 500_000

#: Bytes from which a word is merged with a heap, and letters from which it is not kept. No effect on ids.
LONG_WORD = 64

#: Fixed value: the word pattern of byte-level vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary file: visible Latin-1 as itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


#: Rank of a pair that is never merged.
_NONE = (1 << 60, 0)


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level file, and the byte pairs that force a boundary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of, model = byte_letters(), file["model"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.single = [id_of.get(bytes([b])) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (model["vocab"][t] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            joined = id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.merges.setdefault((left, right), (rank, joined))
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.find_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.forced = self._forced()

    def _forced(self) -> np.ndarray:
        """Table over a * 256 + b: True where bytes a and b force a boundary."""
        inside = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            raw = np.frombuffer(token, np.uint8)
            inside[raw[:-1], raw[1:]] = True
        b = np.arange(256)
        before = (b > 0x20) & (b < 0x7F)
        after = ((b < 0x80) | (b >= 0xC2)) & (b != ord("'"))
        return (~inside & before[:, None] & after[None, :]).reshape(-1)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: always the pair merged first in training is merged next, at its leftmost place."""
        ids = [i for i in map(self.single.__getitem__, word) if i is not None]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        get = self.merges.get
        found = [get(p, _NONE) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) is not _NONE:
            at = found.index(best)
            ids[at:at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]), _NONE)
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs by rank and place, and a linked list: time grows little faster than the word."""
        n, get = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(at: int) -> None:
            pair = (ids[at], ids[after[at]])
            if (best := get(pair)) is not None:
                heappush(heap, (best[0], at, *pair, best[1]))

        for at in range(n - 1):
            offer(at)
        while heap:
            _, at, left, right, joined = heappop(heap)
            end = after[at]
            if ids[at] != left or end < 0 or ids[end] != right:
                continue  # one of the two has been merged since
            ids[at], ids[end] = joined, -1
            after[at] = after[end]
            if after[at] >= 0:
                before[after[at]] = at
                offer(at)
            if before[at] >= 0:
                offer(before[at])
        return [i for i in ids if i >= 0]

    def encode_fragment(self, fragment: bytes, words: dict[str, list[int]]) -> list[int]:
        out: list[int] = []
        for word in WORDS.findall(fragment.decode()):
            if (ids := words.get(word)) is None:
                ids = self.merge(word.encode())
                if len(word) <= LONG_WORD:
                    words[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class Codec:
    """Encodes batches of texts; for each text its ids, written as decimals joined by commas, and its decoded bytes."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.written: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        self.words: dict[str, list[int]] = {}
        self._keep_added()

    def _keep_added(self) -> None:
        """Added tokens are no ordinary text, so the store always has them."""
        for token, i in self.vocabulary.added.items():
            self.written[token.encode()] = str(i).encode()
            self.decoded[token.encode()] = self.vocabulary.bytes_of[i]

    def _learn(self, fragments: set[bytes]) -> None:
        if len(self.written) + len(fragments) > KEPT_FRAGMENTS:
            self.written.clear()
            self.decoded.clear()
            self._keep_added()
        if len(self.words) > KEPT_FRAGMENTS:
            self.words.clear()
        for x in fragments:
            if x not in self.written:
                ids = self.vocabulary.encode_fragment(x, self.words)
                self.written[x] = ",".join(map(str, ids)).encode()
                self.decoded[x] = self.vocabulary.decode(ids)

    def fragments(self, raw: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
        """Fragments of each text, added tokens left out of sight here."""
        pairs = raw[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= raw[1:]
        cuts = np.flatnonzero(self.vocabulary.forced[pairs]) + 1
        cuts, whole = np.unique(np.concatenate([cuts, offsets])), raw.tobytes()
        places, cuts = np.searchsorted(cuts, offsets).tolist(), cuts.tolist()
        return [[whole[a:b] for a, b in zip(cuts[i:j], cuts[i + 1:j + 1])] for i, j in zip(places, places[1:])]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        if not len(raw):
            yield from [(b"", b"")] * (len(offsets) - 1)
            return
        specials = [t.encode() for t in self.vocabulary.added]
        special = any(s in raw.tobytes() for s in specials)
        texts = self.fragments(raw, offsets)
        for at in range(0, len(texts), 128):
            block = texts[at:at + 128]
            if special:
                block = [self._around_added(raw[offsets[at + k]:offsets[at + k + 1]].tobytes(), x) for k, x in enumerate(block)]
            self._learn(set().union(*block))
            get, back = self.written.__getitem__, self.decoded.__getitem__
            for x in block:
                yield b",".join(filter(None, map(get, x))), b"".join(map(back, x))

    def _around_added(self, text: bytes, fragments: list[bytes]) -> list[bytes]:
        """Fragments of a text in which added tokens may occur: these stand alone, the text between them is cut anew."""
        string, out, at = text.decode(), [], 0
        found = list(self.vocabulary.find_added.finditer(string))
        if not found:
            return fragments
        for m in [*found, None]:
            between = string[at:m.start() if m else len(string)].encode()
            if between:
                raw = np.frombuffer(between, np.uint8)
                out += self.fragments(raw, np.array([0, len(raw)]))[0]
            if m:
                out.append(m.group().encode())
                at = m.end()
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_and_decode(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text",
                      with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimals joined by commas), decoded_sha256, ids and decoded text, for each row.

    A null text is an empty one, without ids; null or repeated document ids are kept as they are; an empty table stays
    empty; other columns are not read. Invalid byte sequences, which only foreign ids could give, decode to U+FFFD.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
              ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema(fields if with_ids else fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, 1):
            rows = []
            for written, decoded in codec(vocabulary_path).encode(*text_bytes(batch.column(1))):
                again = decoded.decode("utf-8", "replace")
                row = (written.count(b",") + bool(written), hashlib.sha256(written).hexdigest(),
                       hashlib.sha256(again.encode()).hexdigest())
                rows.append(row + (([int(i) for i in written.split(b",")] if written else [], again) if with_ids else ()))
            yield rows_batch(schema, batch.column(0), *(zip(*rows, strict=True) if rows else [[]] * (len(schema) - 1)))

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return id_and_text(docs, key, text).mapInArrow(run, kinds)
