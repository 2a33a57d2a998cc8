"""The ten operators and the pipeline against brute force on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tabprep.llm import binary_ids, forced_bpe, forest, html, jaccard, licenses, packing, pseudo_lm, quality, suffix
from tabprep.llm.arrow import text_bytes
from tabprep.llm.components import components
from tabprep.llm.tokens import PieceEncoder
from tabprep.sources.storage import fresh_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"passage{k}" for k in range(60))
TEXTS = [None, "", " \n\t", "one", "Two words", PASSAGE, PASSAGE + " and more", "x " + PASSAGE, PASSAGE, "ab " * 400,
         "the quick  brown   fox's\n\njumps <|endoftext|> over é中 " * 5, "Released under the MIT License.\nmit license",
         " ".join(f"w{k % 7}" for k in range(3000)), "aaaa" * 200, "# * $ " * 80, "same line\n" * 70,
         " ".join(f"u{k}" for k in range(100)), " ".join(f"u{k}" for k in range(101)), "ünïcödé 🙂" * 30]
ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "É", "́", "中", " ", "1", "23", "!", "<|endoftext|>",
            "<|startoftext|>", "\x1c", "İ", "ß", "Σ", "½", "　", "the", "'ll", "<|", "|>", "🙂", "\x85", "\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns with names that the operators use themselves, nulls in any of them."""
    return spark.createDataFrame([(k, t, None, k) for k, t in enumerate(TEXTS)],
                                 "doc_id long, text string, text_a string, start long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    return ["".join(rng.choice(ALPHABET, rng.integers(0, 30))) for _ in range(3000)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_piece_encoder_equals_the_library(odd, path):
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)]
    assert PieceEncoder(path).encode(odd) == want


def test_forced_boundaries_equal_the_library(odd):
    library = Tokenizer.from_file(BYTES)
    want = [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]
    got = list(forced_bpe.Codec(BYTES).encode(*text_bytes(pa.array(odd))))
    assert [w for w, _ in got] == [",".join(map(str, x)).encode() for x in want]
    assert [d.decode() for _, d in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_forced_bpe_rows(spark, docs, empty):
    library = Tokenizer.from_file(BYTES)
    for r in forced_bpe.encode_and_decode(docs, BYTES).collect():
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == (TEXTS[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert forced_bpe.encode_and_decode(empty, BYTES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1001])
def test_rank_coding_round_trip(n):
    ranks = (np.random.default_rng(n).random(n) ** 4 * (2**32 - 1)).astype(np.uint32)
    control, data = (np.frombuffer(x, np.uint8) for x in binary_ids.pack_ranks(ranks))
    assert np.array_equal(binary_ids.unpack_ranks(control, data, n), ranks)


def test_token_files(spark, docs, empty):
    twice = docs.union(docs.where("doc_id = 3")).repartition(3)
    got = sorted(binary_ids.read_token_files(spark, binary_ids.write_token_files(twice, BYTES, fresh_path(spark, "t"))).collect(),
                 key=lambda r: r.start)
    library, at = Tokenizer.from_file(BYTES), 0
    assert [r.doc_id for r in got] == sorted([*range(len(TEXTS)), 3])
    for r in got:
        ids = [*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert binary_ids.read_token_files(spark, binary_ids.write_token_files(empty, BYTES, fresh_path(spark, "t"))).count() == 0


def test_token_files_null_id(spark, docs):
    rows = spark.createDataFrame([(None, "a b"), (1, "c")], "doc_id long, text string")
    got = binary_ids.read_token_files(spark, binary_ids.write_token_files(rows, BYTES, fresh_path(spark, "t"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1]


@pytest.mark.parametrize("room", [1, 7, 30])
def test_closest_multiset_is_the_best(room):
    rng = np.random.default_rng(room)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 12, 4)}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        taken = packing.closest_multiset(counts, room)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in taken.items())


def check_packing(rows, texts, window):
    library, sequences, pieces = Tokenizer.from_file(WORDS), defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing(docs, empty):
    for window in (16, 2048):
        rows = packing.pack(docs.repartition(3), WORDS, window=window).collect()
        check_packing(rows, dict(enumerate(TEXTS)), window)
    assert packing.pack(empty, WORDS).count() == 0


def test_quality(docs, empty):
    for r in quality.quality_table(docs).collect():
        text = TEXTS[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        where = defaultdict(list)
        for i in range(len(words) - 2):
            where[tuple(words[i:i + 3])].append(i)
        covered = {i + d for found in where.values() if len(found) > 1 for i in found for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered)), r
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality.quality_table(empty).count() == 0
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert {5, 16, 17} <= kept and not kept & {0, 1, 2, 3, 14, 15}


def test_cascade_order_puts_rejections_per_cost_first(docs):
    from pyspark.sql import functions as F
    rules = [quality.Rule("never", F.length("text") < 0), quality.Rule("always", F.lit(True))]
    assert [r.name for r in quality.cascade_order(docs, rules)] == ["always", "never"]


def brute_components(texts, width, p, q):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[k] = {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and q * both >= p * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def test_jaccard(spark, docs, empty):
    rng = np.random.default_rng(5)
    texts = dict(enumerate(TEXTS))
    base = [f"n{k}" for k in range(120)]
    for k in range(100, 160):  # a group of near copies with chains of links
        words = base[:]
        for i in rng.integers(0, 120, rng.integers(0, 6)):
            words[i] = f"z{rng.integers(0, 3)}"
        texts[k] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width, p in ((4, 85), (5, 80), (1, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(frame, width=width, p=p).collect()}
        assert got == brute_components(texts, width, p, 100)
    assert jaccard.join_components(empty).count() == 0
    assert {r.doc_id for r in jaccard.keep_smallest(docs, width=4, p=85).collect()} == \
        {k for k, (_, c) in brute_components(dict(enumerate(TEXTS)), 4, 85, 100).items() if c == k}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100}


@pytest.mark.parametrize("n, letters", [(1, 1), (300, 1), (2000, 2), (4000, 5)])
def test_suffix_array_and_common_prefixes(n, letters):
    text = np.random.default_rng(n).integers(97, 97 + letters, n).astype(np.uint8)
    text[n // 2:n // 2 + n // 5] = text[:n // 5]
    raw = text.tobytes()
    order, rank = suffix.suffix_array(text, 100)
    heads = [raw[i:i + 100] for i in order]
    assert sorted(order) == list(range(n)) and all(a <= b for a, b in zip(heads, heads[1:]))
    got = suffix.common_prefixes(text, order, rank, 100, lanes=64)
    for i in range(1, n):
        a, b = heads[i - 1], heads[i]
        assert got[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_removed(texts, length):
    seen, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        mark = np.zeros(len(raw), np.int64)
        for i in range(len(raw) - length + 1):
            window = raw[i:i + length]
            mark[i:i + length] |= window in seen
            seen.add(window)
        kept = bytes(x for x, m in zip(raw, mark) if not m)
        out[k] = (len(raw), int(mark.sum()), int((np.diff(mark, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("stretches", [suffix.ANCHOR_STRETCHES, 2])
def test_suffix_dedup(spark, docs, empty, monkeypatch, stretches):
    monkeypatch.setattr(suffix, "ANCHOR_STRETCHES", stretches)  # 2: anchors are spread, and their lists merged
    texts = dict(enumerate(TEXTS)) | {100 + k: f"start {k} " + PASSAGE[k:] + f" end {k}" for k in range(12)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for length in (100, 40):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(frame, length=length).collect()}
        assert got == brute_removed(texts, length)
    assert suffix.remove_repeats(empty).count() == 0


def test_lists_of_a_spread_anchor_meet_in_ranges(spark, monkeypatch):
    """One passage with different surroundings in all documents: no group of lists grows with their number."""
    monkeypatch.setattr(suffix, "ANCHOR_STRETCHES", 10)
    merge, sizes = suffix._merge, spark.sparkContext.accumulator(0)

    def counted(length):
        run = merge(length)

        def counting(frame):
            sizes.add(1)
            assert sum(map(len, frame["strings"])) <= 100 * 1000
            return run(frame)
        return counting

    monkeypatch.setattr(suffix, "_merge", counted)
    texts = {k: f"{k * 7919 % 100003:06d} " * 12 + PASSAGE[:40] + f" {k * 104729 % 1000003:07d}" * 12 for k in range(200)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(frame).collect()}
    assert got == brute_removed(texts, 100) and sizes.value >= 10
    strings = np.random.default_rng(0).integers(0, 256, (5000, 100)).astype(np.uint8)
    piece = suffix.string_ranges(strings, 20)
    assert np.bincount(piece, minlength=20).max() < 400 and (suffix.string_ranges(strings[:50], 20) == piece[:50]).all()


def test_suffix_dedup_repeated_rows(docs):
    rows = suffix.remove_repeats(docs.where("doc_id = 5").union(docs.where("doc_id = 5"))).collect()
    assert sorted(r.n_removed for r in rows) == [0, len(PASSAGE)]


def test_license_scan(spark, empty):
    texts = ["See the MIT License, and the mit license.", "Relesed under the MIT Licence.", "nothing here", None,
             "Licensed under the Apache License, Version 2.0.", "GNU General Public License", "permission is hereby granted, "
             "free of charge to any persn obtaining a copy", "mit", "x" * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 2, 6, "mit")
    assert got[1].n_base == 0 and got[1].labels == "mit" and 0.8 < got[1].score < 1
    assert texts[1][got[1].spans[0].start:got[1].spans[0].end].lower().startswith("relesed")
    assert got[4].labels == "apache" and got[4].score == 1 and got[5].base_labels == "gpl" and got[6].labels == "mit"
    assert all(got[k].labels == "" and got[k].score == 0 and got[k].first_word is None for k in (2, 3, 7, 8))
    assert licenses.scan(empty).count() == 0


def least_edits(pattern, text):
    """Fewest edits that turn the pattern into some stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, letter in enumerate(pattern, 1):
        above, row = row, [i]
        for j, other in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (letter != other)))
    return min(row)


def test_license_notices_within_the_bound_are_found():
    scanner, rng = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, 0.12), np.random.default_rng(4)
    for turn in range(200):
        k = turn % len(scanner.notices)
        notice, label = scanner.notices[k]
        letters = list(notice)
        for _ in range(rng.integers(0, scanner.limits[k] + 3)):
            letters[rng.integers(len(letters))] = str(rng.choice(["", "q", "xz", " "]))
        text = "words before it " + "".join(letters) + " and words behind it"
        edits = least_edits(notice, text)
        spans = scanner.spans(text)
        assert all(s.edits == least_edits(s.notice, text[s.start:s.end]) <= int(0.12 * len(s.notice)) for s in spans)
        assert edits > scanner.limits[k] or any(s.edits <= edits for s in spans)


def page(k, body, aside="menu one"):
    return (f"<html><head><title>T{k}</title><style>p{{}}</style></head><body><nav>{aside}</nav><div class='ad'>buy {k}</div>"
            f"<article><h1>Head &amp; {k}</h1><p>{body}<p>second<br>line</article><div id=comments>first!</div>"
            f"<footer>&copy; host</footer><script>var x = '<p>no</p>'</script></body></html>")


def test_template_extraction(spark):
    rows = [(k, f"http://h{k // 20}.example/{k}", page(k, f"body  text\n{k}")) for k in range(40)]
    rows += [(40, None, None), (41, "x", ""), (42, "y", "<p>plain <b>bo</b>ld</p><form>in</form>"), (43, "y", "<article><p>open &lt;b&gt;")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(frame).collect()}
    assert all(got[k] == f"Head & {k} body text {k} second line" or got[k] == f"Head & {k} body text {k}" for k in range(40))
    assert (got[40], got[41], got[42], got[43]) == ("", "", "plain bold", "open <b>")
    assert html.main_texts(frame.where("page_id < 0")).count() == 0
    template = {r.token for r in html.deduce_templates(frame.selectExpr("page_id as page", "url", "html")).collect()}
    assert any("nav" in t for t in template) and not any("body text" in t for t in template)


def test_text_that_repeats_on_a_host_stays(spark):
    """Headings and lines of all pages of a host, of copies and of repeated rows; by host size, nothing changes."""
    rows = [(k, "http://large.example/x", page(k, f"body {k}")) for k in range(20)]
    rows += [(100 + k, "http://small.example/x", page(k, f"body {k}")) for k in range(7)]
    rows += [(200 + k % 10, "http://copies.example/x", page(0, "Summary<p>long " + "text " * 60)) for k in range(20)]
    rows += [(300 + k, "http://bare.example/x", f"<div><p>Summary<p>text {k}</div>") for k in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html.main_texts(frame).collect())
    want = [(k, f"Head & {k} body {k} second line") for k in range(20)]
    want += [(100 + k, f"Head & {k} body {k} second line") for k in range(7)]
    want += [(200 + k // 2, "Head & 0 Summary long " + "text " * 60 + "second line") for k in range(20)]
    want += [(300 + k, f"Summary text {k}") for k in range(20)]
    assert got == want
    template = html.deduce_templates(frame.selectExpr("page_id as page", "url", "html"))
    assert {r.host for r in template.select("host").distinct().collect()} == {"large.example", "bare.example"}


def test_templates_are_ordered_and_nested():
    """Tokens that change their order leave a class, and a class that lies neither in nor around another one crosses it."""
    cells = [16 * k for k in range(1, 9)]
    a, b, c, x, y, z = cells[:6]
    classes, held = np.array([1, 1, 1, 2, 2], np.int64), np.array([a, b, c, x, y], np.int64)
    page_of = lambda *numbers: np.array(numbers, np.uint64)
    assert html.out_of_order(classes, held, page_of(a, x, y, x, y, b, z, c)) == []
    assert {k for k, in html.out_of_order(classes, held, page_of(a, x, c, y, b))} == {b, c}
    assert {k for k, in html.out_of_order(classes, held, page_of(a, x, x, y, y, b, c))} == {x, y}
    assert html.crossings(classes, held, page_of(a, x, y, x, y, b, c)) == []
    assert html.crossings(classes, held, page_of(x, a, b, c, y)) == []
    assert html.crossings(classes, held, page_of(a, x, b, y, c)) == [(1, 2)]


def test_extraction_goes_through_the_template(spark, monkeypatch):
    """The query's rows are cut at the tokens of the host's template, or of all pages' on small hosts; slots keep every text."""
    rows = [(k, f"http://h{k // 18}.example/{k}", page(k, f"body {k}")) for k in range(22)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: {x.token & 0xFFFFFFFFFFFFFFFF for x in r.members} for r in html._templates(frame.select("url", "html")).collect()}
    assert set(found) == {"h0.example", None}
    for host in found:
        cut = html.slots(rows[3][2], found[host])
        assert len(cut) > 10
        article = [" ".join(t for _, inside, t in texts if inside).split() for _, texts in cut]
        assert article.count(["Head", "&", "3"]) == 1 and sum(article, []) == "Head & 3 body 3 second line".split()
    taken = []
    monkeypatch.setattr(html, "_templates", lambda pages: taken.append(pages) or spark.createDataFrame(
        [], "host string, members array<struct<few:long,small:long,class_id:long,place:long,token:long>>"))
    assert html.main_texts(frame).count() == 22 and len(taken) == 1


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    vectors[100:160] = vectors[100]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (None, [1.0] * 16),
                                                                (5300, [1.0, 2.0]), (5400, [1.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in forest.nearest(frame, frame.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {*range(0, 3000, 100), 5300, 5400} and got[5300] == [(5400, 1.0)]
    hit = 0
    for q in range(0, 3000, 100):
        distance = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        distance[q] = np.inf
        hit += len({i for i, _ in got[q]} & set(np.lexsort((np.arange(3000), distance))[:10].tolist()))
    assert hit / 300 >= 0.9
    assert [i for i, _ in got[100]] == list(range(101, 111))
    assert forest.nearest(frame.where("vec_id < 0"), frame).count() == 0


def test_pseudo_likelihood(spark, docs, empty):
    rng = np.random.default_rng(2)
    regular = [" ".join("the cat sat on a mat and".split() * 30) for _ in range(30)]
    shuffled = [" ".join(rng.permutation(t.split())) for t in regular[:5]]
    frame = spark.createDataFrame(list(enumerate(regular + shuffled)), "doc_id long, text string").repartition(2)
    mean = {r.doc_id: r.mean for r in pseudo_lm.score(frame, rounds=2).collect()}
    assert min(mean[k] for k in range(30)) > max(mean[k] for k in range(30, 35))
    got = {r.doc_id: r for r in pseudo_lm.score(docs).collect()}
    assert len(got) == len(TEXTS) and got[0].log_likelihood == 0 and got[0].mean is None
    assert got[4].log_likelihood == pytest.approx(2 * got[4].mean) and got[4].mean < 0
    assert pseudo_lm.score(empty).count() == 0


def test_gradient():
    network = pseudo_lm.Network()
    network.parts = [p.astype(np.float64) for p in network.parts]
    rng = np.random.default_rng(0)
    around, ids = rng.integers(0, pseudo_lm.VOCABULARY, (6, 4)), rng.integers(0, pseudo_lm.VOCABULARY, 6)
    before = [p.copy() for p in network.parts]
    loss = lambda: -network.log_probabilities(around, ids).mean()
    network.step(around, ids, 1.0)
    steps, network.parts = [b - p for b, p in zip(before, network.parts)], [b.copy() for b in before]
    for part, step in zip(network.parts, steps):
        at = np.unravel_index(np.abs(step).argmax(), step.shape)
        part[at] += 1e-5
        up = loss()
        part[at] -= 2e-5
        assert step[at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3)
        part[at] += 1e-5


def test_shard_of_ordered_stretches(monkeypatch):
    """Bytes that an earlier window covers, as by brute force, from the joined text's order and from sorted places."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 99, 60).astype(np.uint8).tobytes() for _ in range(12)]
    rows = [(k, a, t[a:a + 40]) for k, t in enumerate(texts + texts[:4]) for a in (0, 33)]
    frame = pd.DataFrame(rows, columns=["doc", "start", "bytes"]).assign(spread=False, parts=1, anchor=1)
    assert suffix._in_order(frame, 8) and not suffix._in_order(frame.assign(start=0), 8)
    seen, want = {}, set()
    for doc, start, window in sorted((d, a + i, b[i:i + 8]) for d, a, b in rows for i in range(len(b) - 7)):
        if seen.setdefault(window, (doc, start)) != (doc, start):
            want |= {(doc, start + i) for i in range(8)}
    for ordered in (True, False):
        monkeypatch.setattr(suffix, "_in_order", lambda *_, ordered=ordered: ordered)
        found = suffix._shard(8)(frame.sample(frac=1, random_state=1))
        assert {(d, i) for d, a, b in zip(found["doc"], found["low"], found["high"]) for i in range(a, b)} == want


def test_large_logits_are_shifted():
    """Exponentials beyond single precision: probabilities and steps are those of double precision, and stay finite."""
    rng = np.random.default_rng(3)
    around, ids = rng.integers(0, pseudo_lm.VOCABULARY, (700, 4)), rng.integers(0, pseudo_lm.VOCABULARY, 700)
    for shift in (0, 200, -200):
        network, exact = pseudo_lm.Network(), pseudo_lm.Network()
        network.parts[3] += np.float32(shift)
        exact.parts = [p.astype(np.float64) for p in network.parts]
        for at in (slice(0, 700), slice(0, 40), slice(0, 0)):
            got, want = (x.log_probabilities(around[at], ids[at]) for x in (network, exact))
            assert got == pytest.approx(want, abs=1e-4)
        network.step(around, ids, 0.5)
        exact.step(around, ids, 0.5)
        assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(network.parts, exact.parts))


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = {k: " ".join(f"v{x}" for x in rng.integers(0, 900, 90)) for k in range(12)}
    texts |= {12: texts[0], 13: texts[1] + " extra", 14: texts[2][:200] + " " + PASSAGE, 15: PASSAGE + " " + texts[3][:150],
              16: "# $ % " * 60, 17: None, 18: "short"}
    frame = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {k: t for k, t in texts.items() if k not in (16, 17, 18)}
    firsts = {k: t for k, t in kept.items() if brute_components(kept, 5, 80, 100)[k][1] == k}
    assert set(firsts) == {*range(12), 14, 15}
    left = {}
    seen: set[bytes] = set()
    for k in sorted(firsts):
        raw, mark = firsts[k].encode(), np.zeros(len(firsts[k].encode()), bool)
        for i in range(len(raw) - 99):
            mark[i:i + 100] |= raw[i:i + 100] in seen
            seen.add(raw[i:i + 100])
        if text := bytes(x for x, m in zip(raw, mark) if not m).decode():
            left[k] = text
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), left, 2048)


def test_pipeline_keeps_null_ids_and_repeated_rows(spark, tmp_path):
    """Null ids, repeated ids and rows, genuine U+FFFD, characters broken at a cut, and columns with the stages' own names."""
    rng = np.random.default_rng(10)
    own = lambda n=90: " ".join(f"v{x}" for x in rng.integers(0, 900, n))
    first, second, third, fourth = own(), own(), own(), own()
    # Letters of two bytes around the passage that share a byte: the repeated bytes begin and end inside them.
    shared = [f"{own(60)} é{PASSAGE}é {own(60)} \ufffd", f"{own(60)} ĩ{PASSAGE}í {own(60)} \ufffd"]
    rows = [(None, first), (None, second + " " + PASSAGE), (1, third), (1, third), (2, fourth), (2, own(70) + " " + PASSAGE),
            (3, shared[0]), (4, shared[1])]
    frame = spark.createDataFrame([(k, t, "kept", 1, k, "s", k, k, 0) for k, t in rows],
                                  "doc_id long, text string, kept string, n_removed int, _id long, row string, cut_row long, _dropped long, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, str(tmp_path))
        assert found.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in found.collect()), key=lambda r: (r[0] or 0, r[1]))
    want = sorted([(None, first), (None, second + " " + PASSAGE), (1, third), (2, fourth)], key=lambda r: (r[0] or 0, r[1]))
    assert [r for r in got if r[1] in {t for _, t in want}] == want
    rest = {r[0]: r[1] for r in got if r not in want}
    assert len(got) == 7 and set(rest) == {2, 3, 4} and not any("passage30" in t for t in rest.values())
    assert all(rest[k].count("\ufffd") == 1 and rest[k].endswith("\ufffd") for k in (3, 4))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in packed if r.doc_id is not None) == [(False, k) for k in (1, 2, 2, 3, 4)]
    assert sum(r.doc_id is None for r in packed) == 2


def test_characters_broken_at_a_cut():
    raw = "aé中\ufffdb".encode()
    for low in range(len(raw) + 1):
        for high in range(low, len(raw) + 1):
            kept, spans = raw[:low] + raw[high:], [[low, high]]
            want = "".join(c for i, c in enumerate("aé中\ufffdb") if (e := len("aé中\ufffdb"[:i + 1].encode())) <= low or e - len(c.encode()) >= high)
            assert corpus_pipeline.whole_characters(kept, spans) == want
    assert corpus_pipeline.whole_characters("ab".encode() + "é".encode()[:1] + "中".encode()[1:], [[3, 9]]) == "ab"


def test_full_fragment_store_keeps_added_tokens(monkeypatch):
    monkeypatch.setattr(forced_bpe, "KEPT_FRAGMENTS", 3)
    texts = [f"some{k} words; (and) more<|endoftext|>then {k}" + "<|endoftext|>" * (k % 3) for k in range(300)]
    want = [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    got = list(forced_bpe.Codec(BYTES).encode(*text_bytes(pa.array(texts))))
    assert [[int(i) for i in ids.split(b",")] for ids, _ in got] == want
    assert [back.decode() for _, back in got] == texts


def test_pseudo_likelihood_tells_all_words_apart(spark, monkeypatch):
    """Words of one class cost what their counts say, by whichever way counts reach the tokens."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 5000) for _ in range(40)]
    texts += [None, "", texts[0], "  "]
    frame = spark.createDataFrame([(k % 42 or None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()
    counts = {r.word: r.n for r in pseudo_lm.word_table(frame).collect()}
    assert len(counts) == len({w for t in texts for w in (t or "").split()}) > pseudo_lm.WORDS + 500
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    words = np.sort(np.array(ranked[:pseudo_lm.WORDS]).view(np.uint64))
    totals = pseudo_lm.class_totals(pseudo_lm.word_table(frame), words)
    assert totals.sum() == sum(counts[w] for w in ranked[pseudo_lm.WORDS:])
    network = pseudo_lm.Network.read(pseudo_lm.train(frame, words))
    want = []
    for t in texts:
        raw = text_bytes(pa.array([t], pa.string()))
        ids, n = pseudo_lm.token_ids(*raw, words)
        logs = network.log_probabilities(pseudo_lm.windows(ids, n), ids).sum() if len(ids) else 0.0
        for i, h in zip(ids, pseudo_lm.word_hashes(*raw)[0].view(np.int64).tolist()):
            logs += np.log(counts[h] / totals[i - pseudo_lm.WORDS]) if i >= pseudo_lm.WORDS else 0
        want.append((len(ids), logs))
    for sent in (200_000, 300, 0):
        monkeypatch.setattr(pseudo_lm, "SENT_WORDS", sent)
        got = sorted((r.n_tokens, r.log_likelihood) for r in pseudo_lm.score(frame).collect())
        assert [n for n, _ in got] == [n for n, _ in sorted(want)]
        assert [x for _, x in got] == pytest.approx([x for _, x in sorted(want)], rel=1e-4)
