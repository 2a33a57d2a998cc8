"""Packing documents into windows of a fixed number of tokens by minimum bin slack.

Every document is cut into full windows and one shorter rest. Only the number of rests of each length matters for the
plan, so the driver plans on at most ``window - 1`` counts, however large the corpus is: the longest rest that is left
opens a window, a bitset over the reachable sums finds the multiset of rests that comes closest to filling it, and the
pattern is used as often as the counts allow. Each rest then finds its place from its running number within its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.arrow import id_and_text, rows_batch, texts_of
from tabprep.llm.tokens import encoder, id_width
from tabprep.sources.storage import stored


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes as close to ``room`` as it can from below.

    ``reach`` has bit s set if some choice sums to s. Counts go in as powers of two; the sets before each step are kept,
    and walking back over them gives the numbers taken.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left > 0 and not reach >> room:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, chunk = left - take, chunk * 2
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += take
            total -= length * take
    return dict(taken)


def minimum_slack_plan(counts: dict[int, int], window: int) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths in order) that use up all rests; every pattern fits the window."""
    left, plan = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = closest_multiset(left, window - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[k] // n for k, n in taken.items())
        plan.append((times, [k for k in sorted(taken, reverse=True) for _ in range(taken[k])]))
        for k, n in taken.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _cut(path: str, end_id: int, window: int, with_ids: bool, width: int):
    fields = [("task", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
              ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields if with_ids else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, end = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            rows = []
            encoded = encoder(path, width).encode(texts_of(batch.column(1)))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = np.frombuffer(ids + end, f"<u{width}").astype("<u4")
                tokens = len(ids)
                for start in range(0, tokens, window):
                    piece = ids[start:start + window]
                    n = len(piece)
                    rows.append((task, int(seen[n]), doc, start, n, zlib.crc32(piece), tokens)
                                + ((piece.astype(np.int32),) if with_ids else ()))
                    seen[n] += 1
            yield rows_batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))
    return run


def _place(plan: list[tuple[int, list[int]]], window: int, full: int):
    """Sequence and offset of each piece by its length and its running number within the length."""
    table = defaultdict(list)  # length: (first number, pieces a window, first sequence, [offsets])
    used, sequence = defaultdict(int), full
    for times, lengths in plan:
        at, offsets = 0, defaultdict(list)
        for k in lengths:
            offsets[k].append(at)
            at += k
        for k, where in offsets.items():
            table[k].append((used[k], len(where), sequence, where))
            used[k] += times * len(where)
        sequence += times
    table = dict(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {k: np.array([r[0] for r in rows], np.int64) for k, rows in table.items()}
        for batch in batches:
            sequences, offsets = [], []
            for n, number in zip(batch.column("length").to_pylist(), batch.column("number").to_pylist(), strict=True):
                if n == window:
                    sequences.append(number)
                    offsets.append(0)
                else:
                    first, each, sequence, where = table[n][np.searchsorted(firsts[n], number, "right") - 1]
                    sequences.append(sequence + (number - first) // each)
                    offsets.append(where[(number - first) % each])
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["number"]).columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*batch.drop_columns(["number"]).schema.names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
         window: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is its ids and then ``end_id``. Null texts are empty (one token); rows with a null or repeated id are
    packed as rows of their own; an empty table has no pieces. Other columns are not read. Sequences count from 0 without
    gaps; in each, offsets run from 0 without gaps. Which rest stands in which sequence follows the order in which tasks
    read the rows.
    """
    fields = "task long, nth long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long" \
        + ", ids array<int>" * with_ids
    pieces = stored(id_and_text(docs, key, text).mapInArrow(_cut(tokenizer_path, end_id, window, with_ids, id_width(tokenizer_path)), fields), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = by_task.select("task", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("task"))
                                                    - F.col("n")).alias("before"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    full = counts.pop(window, 0)
    plan = minimum_slack_plan(counts, window)
    numbered = (pieces.join(before.drop("n"), ["task", "length"])
                .withColumn("number", F.col("before") + F.col("nth")).drop("task", "nth", "before"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    kinds = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return numbered.select(*names, "number").mapInArrow(_place(plan, window, full), kinds + ", sequence_id long, offset long")
