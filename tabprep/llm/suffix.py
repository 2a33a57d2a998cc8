"""Removing repeated passages with suffix arrays.

Which bytes can repeat at all. Every window of ``length`` bytes has an anchor: of the hashes of its ``GRAM``-byte strings
the smallest, at its leftmost place. Equal windows have equal anchors, so a window whose anchor's hash occurs once in the
corpus repeats nowhere. Consecutive windows with the same anchor make one stretch of text; only stretches whose anchor
occurs at least twice, in one stretch or in two, go on.

Shards. Stretches with the same anchor meet in one shard; an anchor with many stretches is spread over several shards.
Each shard joins its different stretches to one text and builds its suffix array by Larsson-Sadakane refinement (ranks of the
first 8 bytes, then doubling, where only groups that are not yet told apart are sorted again, until the wanted length is
told apart), and takes common prefixes of neighbours by Kasai's walk. Neighbours that share the wanted length form a
class; its earliest place stays, the others are removed.

Merging. A shard of a spread anchor also sends its classes' strings, each with its earliest place, in sorted lists cut by
ranges of the strings' hashes. An anchor has as many ranges as shards, so the lists of one range together hold about as
many strings as one shard, however often the anchor occurs. The lists of an anchor's range are merged, and places that
another shard has earlier are removed too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.arrow import id_and_text, in_blocks, ranges, rows_batch, text_bytes
from tabprep.llm.hashing import mix, powers
from tabprep.sources.storage import stored

#: Bytes of an anchor string.
GRAM = 24
#: Shards that stretches are dealt to are sized for so many bytes; no shard of one anchor takes many more.
SHARD_BYTES = 2 << 20
#: Stretches of one anchor that one shard takes.
ANCHOR_STRETCHES = 4_000

_BYTE_TABLE = np.random.default_rng(4711).integers(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes or more, and each suffix's rank (equal while not told apart).

    Ranks are the last index of a suffix's group, so a group that is alone keeps its rank for good and is not sorted again.
    Suffixes that end early come before those they begin; suffixes that are not told apart stand by their place.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros(n + 8, np.uint16)
    padded[:n] = text.astype(np.uint16) + 1
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven letters of nine bits
        key = (key << np.uint64(9)) | padded[k:k + n]
    order = np.argsort(key)
    ordered = key[order]
    rank, known = np.empty(n, np.int64), 7
    open_at = _regroup(order, rank, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])), 0, n)
    while len(open_at) and known < depth:
        suffix = order[open_at]
        ahead = suffix + known
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[suffix]
        again = np.argsort(group * (n + 1) + following)
        order[open_at] = suffix[again]
        group, following = group[again], following[again]
        new = np.ones(len(again), bool)
        new[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
        open_at = _refine(order, rank, open_at, np.flatnonzero(new))
        known *= 2
    order[open_at] = order[open_at][np.argsort(rank[order[open_at]] * (n + 1) + order[open_at])]
    return order, rank


def _regroup(order: np.ndarray, rank: np.ndarray, starts: np.ndarray, low: int, high: int) -> np.ndarray:
    return _refine(order, rank, np.arange(low, high), starts)


def _refine(order: np.ndarray, rank: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set the ranks of the groups that begin at places[starts]; the places of groups of two or more are returned."""
    ends = np.append(starts[1:], len(places))
    sizes = ends - starts
    rank[order[places]] = np.repeat(places[ends - 1], sizes)
    return places[np.repeat(sizes > 1, sizes)]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, limit: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to ``limit``, by Kasai's walk.

    Going through the text, a common prefix is at most one shorter than that of the place before. The text is cut into
    lanes that take this walk side by side: a lane starts anew, then carries its length along. In a step every lane
    compares on from what it carries, eight bytes at a time. Suffixes with the rank of the one before share ``limit``
    bytes without a look; nothing is carried on from them, since their order does not follow what comes behind.
    """
    n = len(text)
    before, out = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    tied = rank[order[1:]] == rank[order[:-1]]
    before[order[1:]] = np.where(tied, -1, order[:-1])
    out[order[1:]] = np.where(tied, limit, 0)
    padded = np.zeros(n + limit + 16, np.uint8)
    padded[:n] = text
    words = np.lib.stride_tricks.as_strided(padded.view(), (n + limit + 8, 8), (1, 1)).copy().view("<u8").reshape(-1)
    step = -(-n // max(1, min(lanes, n))) if n else 0
    starts = np.arange(0, n, step) if n else np.zeros(0, np.int64)
    carried = np.zeros(len(starts), np.int64)
    for k in range(step):
        at = starts + k
        live = np.flatnonzero(at < n)
        at = at[live]
        other = before[at]
        length = np.where(other >= 0, np.maximum(carried[live] - 1, 0), 0)
        going = np.flatnonzero(other >= 0)
        while len(going):
            a, b = at[going] + length[going], other[going] + length[going]
            differ = words[np.minimum(a, n + limit)] ^ words[np.minimum(b, n + limit)]
            equal = np.where(differ == 0, 8, _trailing_bytes(differ))
            room = np.minimum(limit, n - np.maximum(at[going], other[going])) - length[going]
            equal = np.minimum(equal, np.maximum(room, 0))
            length[going] += equal
            going = going[equal == 8]
        carried[live] = length
        out[at] = np.where(other >= 0, length, out[at])
    return out[order]


def _trailing_bytes(x: np.ndarray) -> np.ndarray:
    """Number of zero bytes below the lowest that is not zero."""
    lowest = x & (~x + np.uint64(1))
    exponent = (np.maximum(lowest, np.uint64(1)).astype(np.float64).view(np.int64) >> 52) - 1023  # of a power of two
    return exponent >> 3


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows, anchor hash of each stretch, and whether its anchor stands in it twice.

    The smallest hash in each window's grams is found by van Herk's scheme on blocks, with minima from both ends.
    """
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), np.zeros(0, bool))
    n, span = len(raw), length - GRAM + 1
    power = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_TABLE[raw] * power[:n], out=sums[1:])
    # The sum over a gram times the inverse power of its place depends on its bytes alone.
    inverse = np.full(n + 1, np.uint64(pow(int(power[1]), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n - GRAM + 1])
    blocks = -(-len(grams) // span)
    padded = np.full(blocks * span + span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(grams)] = grams
    table = padded.reshape(-1, span)
    left = np.minimum.accumulate(table, 1).reshape(-1)
    right = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].reshape(-1)
    text = np.repeat(np.arange(len(sizes)), windows)
    first = offsets[:-1][text] + ranges(windows)
    least = np.minimum(right[first], left[first + span - 1])
    new = np.ones(len(first), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    each, anchor = np.diff(np.append(starts, len(first))), least[starts]
    # Equal windows of one stretch have their anchors at different places, so the first and the last window differ in it.
    reach = np.lib.stride_tricks.sliding_window_view(padded, span)
    at = [k + (reach[k] == anchor[:, None]).argmax(1) for k in (first[starts], first[starts] + each - 1)]
    return text[starts], first[starts] - offsets[:-1][text[starts]], each, anchor, at[0] != at[1]


def _stretches(length: int):
    schema = pa.schema([("doc", pa.int64()), ("anchor", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()),
                        ("twice", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, 1):
            text, start, windows, anchor, twice = anchors(*text_bytes(batch.column(1)), length)
            yield rows_batch(schema, batch.column(0).to_numpy()[text], anchor.view(np.int64), start.astype(np.int32),
                             windows.astype(np.int32), twice)
    return run


def _cut(length: int):
    """Bytes of the stretches that may repeat: of each text's list (shard, part, anchor, start, windows)."""
    schema = pa.schema([("doc", pa.int64()), ("anchor", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("start", pa.int32()),
                        ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, 1):
            rows = []
            for doc, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                rows += [(doc, x["anchor"], x["part"], x["parts"], x["start"], raw[x["start"]:x["start"] + x["windows"] + length - 1]) for x in found]
            yield rows_batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 6))
    return run


def _classes(docs: np.ndarray, starts: np.ndarray, pieces: list[bytes], length: int):
    """Suffixes that are whole windows, in order: their doc, place, whether each begins a class, and the joined text."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    order, rank = suffix_array(text, length)
    prefix = common_prefixes(text, order, rank, length)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    place = np.arange(len(text)) - (ends - sizes)[piece]
    whole = place <= sizes[piece] - length
    ok = whole[order]
    kept = order[ok]
    # A common prefix with the window before is the least of those between.
    group = np.cumsum(prefix < length)[ok]
    new = np.ones(len(kept), bool)
    new[1:] = group[1:] != group[:-1]
    return docs[piece[kept]], starts[piece[kept]] + place[kept], new, kept, text


def _runs(docs: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges that the windows at the places cover: doc, from, to."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (places[1:] > places[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1
    return docs[first], places[first], places[last] + length if len(docs) else places


def _in_order(frame: pd.DataFrame, length: int) -> bool:
    """Whether the windows of the stretches, one stretch after the other, stand in ascending order of doc and place."""
    docs, starts = frame["doc"].to_numpy(), frame["start"].to_numpy().astype(np.int64)
    ends = starts + frame["bytes"].str.len().to_numpy().astype(np.int64) - length + 1
    return bool(((docs[1:] > docs[:-1]) | (docs[1:] == docs[:-1]) & (starts[1:] >= ends[:-1])).all())


def _shard(length: int):
    """Windows of a shard that an earlier place of the shard has too; and, for spread anchors, what stays."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # Of equal stretches the earliest stands for all; every window of the others is a repeat.
        frame = frame.sort_values(["doc", "start"], ignore_index=True)
        again = frame["bytes"].duplicated()
        copies, frame = frame[again], frame[~again]
        low = copies["start"].to_numpy().astype(np.int64)
        out = [pd.DataFrame({"doc": copies["doc"], "low": low, "high": low + copies["bytes"].str.len().to_numpy().astype(np.int64),
                             "piece": None, "strings": None, "places": None})] if len(copies) else []
        docs, places, new, at, text = _classes(frame["doc"].to_numpy(), frame["start"].to_numpy().astype(np.int64), list(frame["bytes"]), length)
        if not len(docs):
            return pd.DataFrame({"doc": [], "low": [], "high": [], "piece": [], "strings": [], "places": []})
        first = np.flatnonzero(new)
        if _in_order(frame, length):  # then a place is earlier if it is in the joined text
            least = np.minimum.reduceat(at, first)
            later = at != np.repeat(least, np.diff(np.append(first, len(at))))
            earliest = np.flatnonzero(~later)
        else:
            earliest = np.lexsort((places, docs, np.cumsum(new)))[first]
            later = np.ones(len(docs), bool)
            later[earliest] = False
        d, a, b = _runs(docs[later], places[later], length)
        out.append(pd.DataFrame({"doc": d, "low": a, "high": b, "piece": None, "strings": None, "places": None}))
        if frame["spread"].iloc[0]:
            strings = np.lib.stride_tricks.sliding_window_view(text, length)[at[np.flatnonzero(new)]]
            stay = np.stack([docs[earliest], places[earliest]], 1).astype("<i8")
            piece = string_ranges(strings, int(frame["parts"].iloc[0]))
            lists = [np.flatnonzero(piece == k) for k in np.unique(piece)]
            out.append(pd.DataFrame({"doc": -1, "low": frame["anchor"].iloc[0], "high": [len(x) for x in lists], "piece": np.unique(piece),
                                     "strings": [strings[x].tobytes() for x in lists], "places": [stay[x].tobytes() for x in lists]}))
        return pd.concat(out, ignore_index=True)
    return run


def string_ranges(strings: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges of the hash each string (a row of bytes) falls into."""
    weights = powers(strings.shape[1])
    sums = np.zeros(len(strings), np.uint64)
    for k in range(strings.shape[1]):
        sums += _BYTE_TABLE[strings[:, k]] * weights[k]
    return (mix(sums) % np.uint64(n)).astype(np.int64)


def _merge(length: int):
    """Of the sorted lists of one range of an anchor: places for which another list has an earlier one."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        strings = np.frombuffer(b"".join(frame["strings"]), f"S{length}")
        places = np.frombuffer(b"".join(frame["places"]), "<i8").reshape(-1, 2)
        docs, starts = places[:, 0], places[:, 1]
        order = np.argsort(strings, kind="stable")  # merges the lists
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(np.concatenate([[0], strings[order][1:] != strings[order][:-1]]))
        order = np.lexsort((starts, docs, group))
        beaten = order[np.flatnonzero(np.diff(group[order], prepend=-1) == 0)]
        d, a, b = _runs(docs[beaten], starts[beaten], length)
        return pd.DataFrame({"doc": d, "low": a, "high": b})
    return run


def _kept(schema_kinds: list[str], with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
              ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]
    schema = pa.schema(fields if with_text else fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, spans = (text or "").encode(), []
                for low, high in sorted((x["low"], x["high"]) for x in found or []):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                kept, at = [], 0
                for low, high in spans:
                    kept.append(raw[at:low])
                    at = high
                kept = b"".join([*kept, raw[at:]])
                row = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                rows.append(row + ((spans, kept) if with_text else ()))
            yield rows_batch(schema, batch.column(0), *(zip(*rows, strict=True) if rows else [[]] * (len(schema) - 1)))
    return run


def repeated_ranges(texts: DataFrame, length: int = 100) -> DataFrame:
    """(doc, low, high): byte ranges of texts (doc, text) that are covered by windows which an earlier place has too.

    ``doc`` numbers the texts in the order that makes a place earlier. Ranges of a text may overlap.
    """
    spark = texts.sparkSession
    found = stored(texts.mapInArrow(_stretches(length), "doc long, anchor long, start int, windows int, twice boolean"), "stretches")
    often = (found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice")
             .select("anchor", F.ceil(F.col("n") / ANCHOR_STRETCHES).cast("int").alias("parts")))
    repeated = found.join(often, "anchor").select(
        "doc", F.struct("anchor", "start", "windows", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc", "start"), F.col("parts")))
                        .otherwise(-1).cast("int").alias("part"), "parts").alias("x"))
    lists = repeated.groupBy("doc").agg(F.collect_list("x").alias("found"))  # no longer than the text
    pieces = (texts.join(lists, "doc").select("doc", "text", "found")
              .mapInArrow(_cut(length), "doc long, anchor long, part int, parts int, start int, bytes binary"))
    pieces = stored(pieces, "pieces")
    total = pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    shard = (F.when(F.col("part") >= 0, F.xxhash64("anchor", "part")).otherwise(F.pmod(F.col("anchor"), F.lit(shards))))
    dealt = pieces.withColumn("shard", shard).withColumn("spread", F.col("part") >= 0)
    local = stored(dealt.groupBy("shard", "spread").applyInPandas(
        _shard(length), "doc long, low long, high long, piece long, strings binary, places binary"), "local")
    across = (local.where("strings is not null").groupBy("low", "piece")
              .applyInPandas(_merge(length), "doc long, low long, high long"))
    return local.where("strings is null").select("doc", "low", "high").union(across)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans (bytes from, to) and the kept bytes.

    Texts are UTF-8 bytes; null texts are empty. Each byte is removed that a string of ``length`` bytes covers which also
    starts earlier: in a document with a smaller id, or in the same document at an earlier byte. Rows with a null id come
    first of all; rows with the same id are separate texts, the smaller text first, and repeated rows in an arbitrary order.
    Overlapping strings count. An empty table stays empty; other columns are not read. Kept bytes may break a character.
    """
    texts = id_and_text(docs, key, text)
    if texts.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        numbered = texts.withColumnRenamed("doc_id", "doc")
        named = numbered.withColumn("doc_id", F.col("doc"))
    else:
        named = stored(_numbered(texts), "numbered")
        numbered = named.select("doc", "text")
    ranges_ = repeated_ranges(numbered.where("text is not null"), length)
    lists = ranges_.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("found"))  # no longer than the text
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * with_text
    return (named.join(lists, "doc", "left").select("doc_id", "text", "found").mapInArrow(_kept([], with_text), kinds))


def _numbered(texts: DataFrame) -> DataFrame:
    """Texts numbered in ascending order of id and text: ranges of the order are numbered one by one, then shifted."""
    ordered = stored(texts.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
                     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
                     .withColumn("at", F.monotonically_increasing_id()), "ordered")
    return ordered.withColumnRenamed("at", "doc")
