"""License scan: phrases by their words, and short notices found fuzzily.

A notice of m letters that occurs with at most k edits keeps, by the pigeonhole principle, at least one of k + 1 parts
of it unchanged. The parts are searched exactly, which is cheap; every hit names a window of the text in which the notice
would have to stand. Bounded-error matching takes a fifth of a second where nine edits are allowed and nothing stands, so
edit distances, kept as bit vectors over the notice, first tell the ends of places within the bound. Only these go to the
regex library, with no more edits than needed; its bounded-error matching verifies them and reports the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
import re
from pyspark.sql import DataFrame

from tabprep.llm.arrow import id_and_text, rows_batch, texts_of

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and the labels that they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices and the labels that they give.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "licensed under the apache license, version 2.0": "apache",
    "this work is licensed under the gnu general public license, version 3": "gpl",
    "licensed under cc by-nc 4.0": "cc-by-nc",
    "licensed under cc by-sa 4.0": "cc-by-sa",
    "licensed under cc by 4.0": "cc-by",
    "redistribution and use in source and binary forms, with or without modification": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Span:
    """A notice found in a text: its characters, the edits and the likeness, 1 for an exact copy."""
    notice: str
    label: str
    start: int
    end: int
    edits: int
    score: float


class EditSearch:
    """Least edits between a pattern and any stretch of a text, for every end; a column of the table is two integers."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.full, self.top = (1 << self.size) - 1, 1 << self.size - 1
        self.places: dict[str, int] = {}
        for i, letter in enumerate(pattern):
            self.places[letter] = self.places.get(letter, 0) | 1 << i

    def edits(self, text: str, anchored: bool = False) -> Iterator[int]:
        """Edits for the stretch that ends behind each letter; anchored stretches all begin where the text does."""
        up, down, edits, full, top, places = self.full, 0, self.size, self.full, self.top, self.places.get
        for letter in text:
            equal = places(letter, 0)
            level = equal | down
            across = ((equal & up) + up ^ up) | equal
            more, fewer = down | full & ~(across | up), up & across
            edits += 1 if more & top else -1 if fewer & top else 0
            more = more << 1 | anchored
            up, down = full & (fewer << 1 | ~(level | more)), full & more & level
            yield edits


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], share: float):
        """``share``: edits allowed for each letter of a notice."""
        self.phrases = [(tuple(p.split(" ")), label) for p, label in phrases.items()]
        self.first_words = {p[0] for p, _ in self.phrases}
        self.notices, self.limits = list(notices.items()), []
        self.forward = [EditSearch(n) for n in notices]
        self.backward = [EditSearch(n[::-1]) for n in notices]
        self.patterns: dict[tuple[int, int], regex.Pattern] = {}
        self.seeds, places = ahocorasick.Automaton(), defaultdict(list)
        for k, (notice, _) in enumerate(self.notices):
            edits = int(share * len(notice))
            self.limits.append(edits)
            for i in range(edits + 1):
                a, b = len(notice) * i // (edits + 1), len(notice) * (i + 1) // (edits + 1)
                places[notice[a:b]].append((k, a))
        for seed, where in places.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice the merged stretches of the text in which a seed lets it stand."""
        found: dict[int, list[list[int]]] = defaultdict(list)
        for last, (length, where) in self.seeds.iter(text):
            for k, offset in where:
                start = last + 1 - length - offset
                window = [max(0, start - self.limits[k]), min(len(text), start + len(self.notices[k][0]) + self.limits[k])]
                if (own := found[k]) and window[0] <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], window[0]), max(own[-1][1], window[1])
                else:
                    own.append(window)
        return found

    def ends(self, k: int, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """(edits, end) of each place of the notice inside a window: the first end with the fewest edits of a run of ends."""
        found, last = [], -2
        for end, edits in enumerate(self.forward[k].edits(text[a:b]), a + 1):
            if edits <= self.limits[k]:
                if end - last > 1:
                    found.append((edits, end))
                elif edits < found[-1][0]:
                    found[-1] = edits, end
                last = end
        return found

    def verified(self, k: int, text: str, edits: int, end: int) -> Span | None:
        """The place that ends there, as the regex library matches it with no more than these edits."""
        notice, label = self.notices[k]
        behind = text[max(0, end - len(notice) - edits):end][::-1]
        start = end - next(i for i, n in enumerate(self.backward[k].edits(behind, True), 1) if n == edits)
        if (k, edits) not in self.patterns:
            self.patterns[k, edits] = regex.compile(f"(?:{regex.escape(notice)}){{e<={edits}}}")
        m = self.patterns[k, edits].fullmatch(text, start, end)
        return m and Span(notice, label, start, end, n := sum(m.fuzzy_counts), 1 - n / len(notice))

    def spans(self, text: str) -> list[Span]:
        """All notices of a lower-case text; of those that overlap, the likest, then the leftmost."""
        found = [s for k, windows in self.windows(text).items() for a, b in windows
                 for edits, end in self.ends(k, text, a, b) if (s := self.verified(k, text, edits, end))]
        found.sort(key=lambda s: (-s.score, s.start, s.label))
        kept: list[Span] = []
        for s in found:
            at = bisect_left(kept, s.start, key=lambda o: o.start)
            if not (at and kept[at - 1].end > s.start or at < len(kept) and kept[at].start < s.end):
                kept.insert(at, s)
        return kept

    def places(self, text: str) -> tuple[int, list[tuple[int, int, str]]]:
        """Number of words, and first word, last word and label of every place of a phrase."""
        words = _WORD.findall(text)
        found = []
        for phrase, label in self.phrases:
            at = -1
            for _ in range(words.count(phrase[0])):
                at = words.index(phrase[0], at + 1)
                if tuple(words[at:at + len(phrase)]) == phrase:
                    found.append((at, at + len(phrase) - 1, label))
        return len(words), found


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
         notices: dict[str, str] | None = None, share: float = 0.12) -> DataFrame:
    """One row for each document: n_words, n_base, first_word, last_word, base_labels, labels, score and the spans.

    ``first_word`` and ``last_word`` are the smallest and the largest start of a phrase, null without one. ``score`` is
    the largest likeness of a notice, 1 at least where a phrase stands whole, 0 if nothing is found. Spans count
    characters of the text. A null text is an empty one; null or repeated ids are kept; an empty table stays empty; other
    columns are not read.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    span = pa.struct([("notice", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("edits", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                        ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, share)
        for batch in batches:
            rows = []
            for t in texts_of(batch.column(1)):
                t = t.translate(_LOWER) if not t.isascii() else t.lower()
                n_words, places = scanner.places(t)
                spans = scanner.spans(t)
                base = {label for _, _, label in places}
                starts = [a for a, _, _ in places]
                rows.append((n_words, len(places), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(base)), ",".join(sorted(base | {s.label for s in spans})),
                             float(max([s.score for s in spans] + [1.0] * bool(places), default=0.0)),
                             [vars(s) for s in spans]))
            yield rows_batch(schema, batch.column(0), *(zip(*rows, strict=True) if rows else [[]] * 8))

    return id_and_text(docs, key, text).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
             "score double, spans array<struct<notice: string, label: string, start: long, end: long, edits: long, score: double>>")
