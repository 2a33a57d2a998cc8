"""Packing documents into as few windows as possible by linear grouping.

Only documents longer than a window are cut. What decides the plan is how many pieces there are of each length, so the
driver plans on at most ``window`` counts, however large the corpus is:

1. Large pieces, longest first, are cut into groups of equal cardinality; every length is rounded up to its group's
   longest, which leaves few sizes.
2. A linear program over configurations (multisets of those sizes that fit a window) is solved by column generation: the
   basis inverse gives each size its price, and a knapsack over the window finds the configuration worth most.
3. Configurations are used as often as the whole part of the solution says, and actual pieces take their places. What a
   piece leaves of its rounded size is room for a longer piece in the window's next place, so windows end up nearly full.
4. The large pieces that are left over and all small ones go, longest first, to the window with the least room that
   holds them; a new window opens where none does. Windows of equal room are handled as one run.

The plan is a list of runs: pieces of one length with consecutive numbers, in windows of equal filling. A piece finds its
window and offset from its length and its running number within the length, without any further shuffle.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.arrow import id_and_text, in_blocks, rows_batch, texts_of
from tabprep.llm.tokens import id_width
from tabprep.llm.word_ids import word_encoder
from tabprep.sources.storage import stored

#: What is tried: (pieces longer than this share of the window are large, number of groups). The plan with the fewest
#: windows is taken. With one half every large piece has a window of its own before the rest is fitted.
SPLITS = ((1 / 2, 64), (1 / 3, 64), (1 / 4, 64), (1 / 8, 64))


@dataclass
class Plan:
    """Runs of pieces by length, and the number of windows."""

    #: length: (first number, pieces a window, first window, offset of the first piece in each window)
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    windows: int = 0
    #: room: (first window, windows) with exactly that room left
    open: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    def put(self, length: int, first: int, each: int, window: int, offset: int) -> None:
        self.runs[length].append((first, each, window, offset))


def best_configuration(sizes: np.ndarray, prices: np.ndarray, window: int) -> tuple[np.ndarray, float]:
    """How many of each size fit one window with the highest total price: a knapsack by number of pieces."""
    worth = np.flatnonzero(prices > 1e-12)
    counts = np.zeros(len(sizes), np.int64)
    if not len(worth):
        return counts, 0.0
    value, taken = np.zeros(window + 1), []
    for _ in range(window // int(sizes[worth].min())):
        offers = np.full((len(worth), window + 1), -1.0)
        for row, k in enumerate(worth):
            offers[row, sizes[k]:] = value[:window + 1 - sizes[k]] + prices[k]
        which = offers.argmax(0)
        offer = offers[which, np.arange(window + 1)]
        better = offer > value + 1e-12
        if not better.any():
            break
        taken.append(np.where(better, worth[which], -1))
        value = np.where(better, offer, value)
    room = window
    for choice in reversed(taken):
        if choice[room] >= 0:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return counts, float(value[window])


def configurations(sizes: Sequence[int], demand: Sequence[int], window: int,
                   rounds: int = 2_000) -> list[tuple[int, np.ndarray]]:
    """(times, pieces of each size) by the whole part of the configuration program's solution.

    The start is one configuration for each size, as many as fit. After ``rounds`` exchanges the solution at hand is
    used; it satisfies the demand as well, with windows to spare.
    """
    sizes, need = np.asarray(sizes, np.int64), np.asarray(demand, float)
    columns = np.diag(window // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ need
    for _ in range(rounds):
        entering, value = best_configuration(sizes, inverse.sum(0), window)
        if value <= 1 + 1e-9:
            break
        way = inverse @ entering
        ratio = np.where(way > 1e-9, amount / np.where(way > 1e-9, way, 1), np.inf)
        leaving = int(ratio.argmin())
        step = ratio[leaving]
        if not np.isfinite(step):
            break
        columns[:, leaving] = entering
        pivot = inverse[leaving] / way[leaving]
        inverse -= np.outer(way, pivot)
        inverse[leaving] = pivot
        amount = np.maximum(amount - way * step, 0)
        amount[leaving] = step
    left, out = np.asarray(demand, np.int64).copy(), []
    for k in np.argsort(-amount, kind="stable"):
        use = columns[:, k].astype(np.int64)
        some = use > 0
        times = min(int(amount[k] + 1e-6), int((left[some] // use[some]).min())) if some.any() else 0
        if times > 0:
            left -= use * times
            out.append((times, use))
    return out


def linear_groups(counts: Mapping[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded size, pieces) of each group of the pieces, longest first; groups of one size are one group."""
    lengths = sorted(counts, reverse=True)
    ends = np.cumsum([counts[k] for k in lengths])
    total = int(ends[-1]) if lengths else 0
    borders = sorted({total * g // groups for g in range(groups + 1)})
    out: list[tuple[int, int]] = []
    for low, high in zip(borders, borders[1:]):
        size = lengths[int(np.searchsorted(ends, low, "right"))]
        if out and out[-1][0] == size:
            out[-1] = (size, out[-1][1] + high - low)
        else:
            out.append((size, high - low))
    return out


def _substitute(plan: Plan, counts: Mapping[int, int], sizes: list[int], chosen: list[tuple[int, np.ndarray]],
                window: int) -> list[tuple[int, int, int]]:
    """Give the places of the configurations to actual pieces; returns (length, first number, pieces) left over.

    The places of a window are served longest first. Each takes the longest piece left that its rounded size and the room
    saved so far in the window allow, so what rounding up reserved is used by longer pieces. Windows that take the same
    lengths are served at once: every step uses up a configuration or a length.
    """
    left, used, lengths = dict(counts), dict.fromkeys(counts, 0), sorted(counts)
    for times, use in chosen:
        places = [s for s, n in zip(sizes, use) for _ in range(int(n))]
        while times and lengths:
            taken: dict[int, int] = {}
            spare = window - sum(places)
            for size in places:
                at = bisect_right(lengths, size + spare) - 1
                while at >= 0 and taken.get(lengths[at], 0) == left[lengths[at]]:
                    at -= 1
                if at >= 0:
                    taken[lengths[at]] = taken.get(lengths[at], 0) + 1
                spare += size - (lengths[at] if at >= 0 else 0)
            step, offset = min([times, *(left[k] // n for k, n in taken.items())]), 0
            for k, n in taken.items():
                plan.put(k, used[k], n, plan.windows, offset)
                offset, used[k], left[k] = offset + k * n, used[k] + n * step, left[k] - n * step
            plan.open[window - offset].append((plan.windows, step))
            plan.windows, times = plan.windows + step, times - step
            lengths = [k for k in lengths if left[k]]
    return [(k, used[k], left[k]) for k in lengths]


def _best_fit(plan: Plan, pieces: list[tuple[int, int, int]], window: int) -> None:
    """Put (length, first number, pieces) into the fullest windows that hold them, opening windows where none does.

    A piece that went into the window with the least room makes it the best for the next of its length, so a window
    takes as many as fit, and a run of equal windows is served at once.
    """
    rooms = sorted(r for r, runs in plan.open.items() if runs)

    def leave(room: int, first: int, n: int) -> None:
        if not plan.open[room]:
            rooms.insert(bisect_left(rooms, room), room)
        plan.open[room].append((first, n))

    for length, first, n in sorted(pieces, key=lambda x: (-x[0], x[1])):
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fresh = -(-n // (window // length))
                leave(window, plan.windows, fresh)
                plan.windows += fresh
                continue
            room = rooms[at]
            start, windows = plan.open[room].pop()
            if not plan.open[room]:
                rooms.pop(at)
            each = min(room // length, n)
            full = min(windows, n // each)
            plan.put(length, first, each, start, window - room)
            first, n = first + each * full, n - each * full
            if windows > full:
                leave(room, start + full, windows - full)
            leave(room - each * length, start, full)


def plan_windows(counts: Mapping[int, int], window: int, share: float, groups: int) -> Plan:
    """Places of all pieces of which ``counts`` gives the number by length, 1 to ``window``."""
    counts = {k: n for k, n in counts.items() if n > 0}
    plan = Plan()
    if full := counts.pop(window, 0):
        plan.put(window, 0, 1, 0, 0)
        plan.windows = full
    large = {k: n for k, n in counts.items() if k > window * share}
    grouped = linear_groups(large, groups)
    chosen = configurations([s for s, _ in grouped], [n for _, n in grouped], window) if grouped else []
    left = _substitute(plan, large, [s for s, _ in grouped], chosen, window)
    _best_fit(plan, left + [(k, 0, n) for k, n in counts.items() if k not in large], window)
    return plan


def best_plan(counts: Mapping[int, int], window: int, splits: Sequence[tuple[float, int]] = SPLITS) -> Plan:
    """The plan with the fewest windows over the given shares and numbers of groups."""
    return min((plan_windows(counts, window, *split) for split in splits), key=lambda p: p.windows)


def _cut(path: str, end_id: int, window: int, with_ids: bool, width: int):
    fields = [("task", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()),
              ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields if with_ids else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        end = np.array([end_id], f"<u{width}").tobytes()
        encode = word_encoder(path, width).encode
        for batch in in_blocks(batches, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = np.frombuffer(encode(text) + end, f"<u{width}").astype("<u4")
                for piece, start in enumerate(range(0, len(ids), window)):
                    some = ids[start:start + window]
                    n = len(some)
                    rows.append((task, seen[n], doc, piece, start, n, zlib.crc32(some))
                                + ((some.astype(np.int32),) if with_ids else ()))
                    seen[n] += 1
            yield rows_batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))
    return run


def _place(plan: Plan):
    """Window and offset of each piece by its length and its running number within the length."""
    runs = sorted((length, *run) for length, of_length in plan.runs.items() for run in of_length)
    lengths, firsts, each, windows, offsets = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs \
        else [np.zeros(0, np.int64)] * 5
    starts = np.searchsorted(lengths, np.arange(lengths.max(initial=0) + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.zeros(len(length), np.int64)
            for k in np.unique(length):
                some, low, high = length == k, starts[k], starts[k + 1]
                at[some] = low + np.searchsorted(firsts[low:high], number[some], "right") - 1
            within = number - firsts[at]
            kept = batch.drop_columns(["number"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(windows[at] + within // each[at]),
                 pa.array(offsets[at] + within % each[at] * length)],
                names=[*kept.schema.names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
         window: int = 2048, splits: Sequence[tuple[float, int]] = SPLITS, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    A document is its ids and then ``end_id``; one longer than ``window`` is cut into whole windows and a rest. Null and
    empty texts are one token; rows with a null or repeated id are packed as rows of their own; an empty table has no
    pieces; very long texts are read whole; other columns are not read and may have any name. Sequences count from 0
    without gaps; in each, offsets run from 0 without gaps. Pieces of equal length are interchangeable: which of them
    stands in which sequence follows the order in which tasks read the rows.
    """
    fields = "task long, nth long, doc_id long, piece int, start long, length long, ids_crc32 long" \
        + ", ids array<int>" * with_ids
    cut = _cut(tokenizer_path, end_id, window, with_ids, id_width(tokenizer_path))
    pieces = stored(id_and_text(docs, key, text).mapInArrow(cut, fields), "grouping-pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    numbered = (pieces.join(by_task.select("task", "length", earlier.alias("before")), ["task", "length"])
                .select(*names, (F.col("before") + F.col("nth")).alias("number")))
    kinds = ", ".join(f"{n} {dict(pieces.dtypes)[n]}" for n in names)
    return numbered.mapInArrow(_place(best_plan(counts, window, splits)), kinds + ", sequence_id long, offset long")
