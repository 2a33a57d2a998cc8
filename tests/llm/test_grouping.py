"""Linear grouping: plans against brute force, rows against the tokenizers library."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabprep.llm import grouping, word_ids

WORDS = public_tokenizers.path("word_bpe_49k.json")


def expand(plan: grouping.Plan, counts: dict[int, int], window: int) -> dict[int, list[tuple[int, int]]]:
    """(offset, length) of every piece by window; checks that every number of every length has one place."""
    out = defaultdict(list)
    for length, n in counts.items():
        runs = sorted(plan.runs[length])
        for (first, each, start, offset), after in itertools.zip_longest(runs, [r[0] for r in runs[1:]], fillvalue=n):
            assert first < after
            for k in range(after - first):
                out[start + k // each].append((offset + k % each * length, length))
        assert runs[0][0] == 0
    return out


def check(plan, counts, window):
    placed = expand(plan, counts, window)
    assert sorted(placed) == list(range(plan.windows))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window


def fewest(lengths: tuple[int, ...], window: int) -> int:
    """Fewest windows by trying every first window of the pieces left."""
    if not lengths:
        return 0
    first, rest, best = lengths[0], lengths[1:], len(lengths)
    for n in range(len(rest) + 1):
        for some in itertools.combinations(range(len(rest)), n):
            if first + sum(rest[k] for k in some) <= window:
                best = min(best, 1 + fewest(tuple(x for k, x in enumerate(rest) if k not in some), window))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_small_plans_are_near_the_fewest_windows(seed):
    rng = np.random.default_rng(seed)
    lengths = tuple(sorted(rng.integers(1, 21, 8).tolist(), reverse=True))
    counts = Counter(lengths)
    plan = grouping.best_plan(counts, 20)
    check(plan, counts, 20)
    assert plan.windows <= fewest(lengths, 20) + 1


@pytest.mark.parametrize("low, high, n", [(1, 2048, 3000), (400, 1100, 5000), (500, 900, 20000), (1, 300, 5000), (2048, 2049, 9),
                                          (683, 684, 100), (1024, 1026, 51), (1, 2, 5000)])
def test_plans_place_every_piece_and_never_lose_to_best_fit(low, high, n):
    counts = Counter(np.random.default_rng(n).integers(low, high, n).tolist())
    plan = grouping.best_plan(counts, 2048)
    check(plan, counts, 2048)
    rooms = []
    for length in sorted(counts.elements(), reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= length] if n <= 5000 else []
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(2048 - length)
    assert plan.windows <= len(rooms)
    if (low, high) == (400, 1100):  # configurations are what best fit lacks
        assert plan.windows < 0.97 * len(rooms) and plan.windows < 1.01 * sum(k * m for k, m in counts.items()) / 2048 + 1


def test_a_plan_grows_with_lengths_not_with_documents():
    counts = Counter(np.random.default_rng(0).integers(1, 2048, 3000).tolist())
    many = grouping.best_plan({k: n * 10**9 for k, n in counts.items()}, 2048)
    assert sum(map(len, many.runs.values())) < 20_000
    assert many.windows < 1.03 * sum(k * n * 10**9 for k, n in counts.items()) / 2048


def test_groups_have_equal_cardinality_and_hold_their_pieces():
    counts = {k: 3 for k in range(100, 140)}
    groups = grouping.linear_groups(counts, 8)
    assert [n for _, n in groups] == [15] * 8 and [s for s, _ in groups] == list(range(139, 99, -5))
    assert grouping.linear_groups({}, 8) == []


def test_best_configuration_against_all_choices():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes, prices = np.sort(rng.choice(np.arange(5, 30), 4, replace=False)), rng.random(4)
        want = max(sum(p * c for p, c in zip(prices, use)) for use in itertools.product(range(9), repeat=4)
                   if sum(s * c for s, c in zip(sizes, use)) <= 40)
        use, value = grouping.best_configuration(sizes, prices, 40)
        assert abs(value - want) < 1e-9 and abs(prices @ use - want) < 1e-9 and sizes @ use <= 40


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_ids_equal_the_library(monkeypatch, name):
    monkeypatch.setattr(word_ids, "KEPT_WORDS", 40)
    rng = np.random.default_rng(8)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "É", "\u0301", "中", "\u00a0", "1", "23", "!", "<|endoftext|>", "Ÿ", "ŉ",
            "<|startoftext|>", "\x1c", "İ", "ß", "Σ", "½", "\u3000", "the", "'ll", "<|", "|>", "🙂", "\x85", "\r\n", "_", "ž", "×"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(3000)] + ["", "a" * 5000]
    texts += ["x " * 300 + "y" * 3000, " \n\n  a\t\t b  ", "    ", "it's we'll I'VE 12 345!? --- <|", "a\x0b \x0cb"]
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), word_ids.WordEncoder(path, 2)
    want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.encode(t) for t in texts] == want


def test_pack_rows(spark):
    texts = [None, "", "one", "Two words " * 700, "the quick brown fox " * 1500, "é中 🙂" * 40, "x", "x"] \
        + [f"word {k} " * (k % 90) for k in range(120)]
    rows = [(None if k == 6 else k if k != 7 else 2, t, None, k, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, number long, piece long")
    library = Tokenizer.from_file(WORDS)
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    got = grouping.pack(docs.repartition(3), WORDS).collect()
    want = Counter()
    for row, own in zip(rows, ids, strict=True):
        for piece, start in enumerate(range(0, len(own), 2048)):
            some = own[start:start + 2048]
            want[row[0], piece, start, len(some), zlib.crc32(np.array(some, "<u4")), tuple(some)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(windows) == -(-sum(map(len, ids)) // 2048)
    assert grouping.pack(docs.where("number < 0"), WORDS, with_ids=False).collect() == []
