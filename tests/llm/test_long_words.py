"""Words of any length in the forced-boundary codec."""

from __future__ import annotations

import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabprep.llm import forced_bpe
from tabprep.llm.arrow import text_bytes

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return forced_bpe.Vocabulary(BYTES)


@pytest.mark.parametrize("letters", ["ab", "aehinorst", "中文字的一是", "éèàß", "01", "=-_*", "aA"])
def test_the_heap_merges_like_the_short_way(vocabulary, monkeypatch, letters):
    rng = np.random.default_rng(len(letters))
    for n in (0, 1, 2, 3, 65, 300):
        word = "".join(rng.choice(list(letters), n)).encode()
        monkeypatch.setattr(forced_bpe, "LONG_WORD", 1 << 30)
        short = vocabulary.merge(word)
        monkeypatch.setattr(forced_bpe, "LONG_WORD", 0)
        assert vocabulary.merge(word) == short


def test_a_hundred_thousand_letters_without_a_space():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 100_000))), "a" * 100_000, "the" * 30_000 + " end"]
    started = time.process_time()
    got = list(forced_bpe.Codec(BYTES).encode(*text_bytes(pa.array(texts))))
    assert time.process_time() - started < 30
    library = Tokenizer.from_file(BYTES)
    for text, (written, decoded) in zip(texts, got, strict=True):
        assert written.decode() == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert decoded.decode() == text
