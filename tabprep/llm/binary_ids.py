"""Token ids as a binary table: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

File format: a folder with two Parquet tables.

* ``ranks`` (rank, id, n): the ids that occur, the most frequent first, ties by id.
* ``blocks`` (shard, block, before, n_docs, n_tokens, payload): documents in ascending order of their id. ``shard``
  counts the range partitions, ``block`` the blocks in one, ``before`` the tokens of the shard before the block.
  ``payload`` holds, little-endian, one after the other: n_docs bytes (1: the document has an id), n_docs signed 64-bit
  document ids, n_docs unsigned 32-bit token counts, the control bytes and the data bytes. A control byte has four
  two-bit fields, the first id in the lowest bits; a field plus one is the number of data bytes of an id's rank.

Null texts are empty; rows with a null id come first; rows with the same id stay separate rows, ordered by their tokens;
an empty table gives an empty folder. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprep.llm.arrow import id_and_text, in_blocks, rows_batch, texts_of
from tabprep.llm.tokens import id_width
from tabprep.llm.word_ids import word_encoder
from tabprep.sources.storage import fresh_path

#: Tokens after which a block is closed.
BLOCK_TOKENS = 1 << 18

#: Byte lengths of the four ids that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = np.asarray(ranks, np.uint32)
    fields = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = fields
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    in_use = np.arange(4) <= fields[:, None]
    return control.tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[in_use].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n numbers again: the lengths come from the table, the places from their running sum."""
    lengths = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    first = np.cumsum(lengths) - lengths
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    out = data[first].astype(np.uint32)
    for k in (1, 2, 3):
        if len(longer := np.flatnonzero(lengths > k)):
            out[longer] |= data[first[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(docs: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    return b"".join((np.array([d is not None for d in docs], np.uint8).tobytes(),
                     np.array([d or 0 for d in docs], "<i8").tobytes(), np.array(counts, "<u4").tobytes(), control, data))


def unpack_block(payload: bytes, n_docs: int, n_tokens: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and ranks of a block."""
    raw, at = np.frombuffer(payload, np.uint8), 13 * n_docs
    known, docs = raw[:n_docs], raw[n_docs:9 * n_docs].copy().view("<i8")
    counts, end = raw[9 * n_docs:at].copy().view("<u4"), at + -(-n_tokens // 4)
    return ([int(d) if k else None for d, k in zip(docs, known, strict=True)], counts.astype(np.int64),
            unpack_ranks(raw[at:end], raw[end:], n_tokens))


def _encode(path: str, end_id: int, width: int):
    """Compressed ids of each document, and as last row of a task how often each id occurred in it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end, counts = pa.Codec("zstd", 1), np.array([end_id], f"<u{width}").tobytes(), np.zeros(0, np.int64)
        encode = word_encoder(path, width).encode
        for batch in in_blocks(batches, 1):
            ids = [encode(x) + end for x in texts_of(batch.column(1))]
            more = np.bincount(np.frombuffer(b"".join(ids), f"<u{width}"), minlength=len(counts))
            more[:len(counts)] += counts
            counts = more
            yield rows_batch(schema, batch.column(0), [len(x) // width for x in ids],
                             [codec.compress(x, asbytes=True) for x in ids], [None] * len(ids))
        yield rows_batch(schema, [None], [0], [None], [counts.astype("<i8").tobytes()])
    return run


def _decompress(n: int, ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(ids, n * width, "zstd", asbytes=True), f"<u{width}")


def _count():
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts = np.frombuffer(raw, "<i8")
                seen = np.flatnonzero(counts)
                yield rows_batch(schema, seen, counts[seen])
    return run


def _blocks(rank_of: np.ndarray, width: int):
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        docs, counts, ids, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ranks = rank_of[np.concatenate(ids)] if ids else np.zeros(0, np.uint32)
            return rows_batch(schema, [shard], [block], [before], [len(docs)], [held], [pack_block(docs, counts, ranks)])

        for batch in batches:
            for doc, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs.append(doc)
                counts.append(n)
                ids.append(_decompress(n, packed, width))
                held += n
                if held >= BLOCK_TOKENS:
                    yield closed()
                    block, before = block + 1, before + held
                    docs, counts, ids, held = [], [], [], 0
        if docs:
            yield closed()
    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, key: str = "doc_id", text: str = "text",
                      end_id: int = 2) -> str:
    """Encode every whole text, append ``end_id`` to each, and write the file format into ``folder``.

    The texts are encoded once; the compressed ids go to the shared folder, since ranks need all counts first. Counts
    are summed for each id, so the driver sees no more rows than the vocabulary has ids.
    """
    spark, width = docs.sparkSession, id_width(tokenizer_path)
    encoded_path = fresh_path(spark, "token-ids")
    (id_and_text(docs, key, text)
     .mapInArrow(_encode(tokenizer_path, end_id, width), "doc_id long, n_tokens long, ids binary, counts binary")
     .write.option("compression", "uncompressed").parquet(encoded_path))
    stored = spark.read.parquet(encoded_path)
    counted = (stored.where("counts is not null").select("counts").mapInArrow(_count(), "id long, n long")
               .groupBy("id").agg(F.sum("n").alias("n"))).collect()
    encoded = stored.where("counts is null").select("doc_id", "n_tokens", "ids")
    ranked = sorted(counted, key=lambda r: (-r.n, r.id))
    rank_of = np.zeros(1 << 16 if width == 2 else max((r.id for r in ranked), default=0) + 1, np.uint32)
    rank_of[[r.id for r in ranked]] = np.arange(len(ranked), dtype=np.uint32)
    spark.createDataFrame([(k, r.id, r.n) for k, r in enumerate(ranked)], "rank long, id long, n long") \
        .coalesce(1).write.parquet(f"{folder}/ranks")
    (encoded.repartitionByRange(F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
     .mapInArrow(_blocks(rank_of, width), "shard long, block long, before long, n_docs long, n_tokens long, payload binary")
     .write.option("compression", "zstd").parquet(f"{folder}/blocks"))
    return folder


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of a folder: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, and their ids."""
    ranks = spark.read.parquet(f"{folder}/ranks").collect()  # as many rows as the vocabulary has ids, at most
    id_of = np.zeros(len(ranks), np.uint32)
    id_of[[r["rank"] for r in ranks]] = [r["id"] for r in ranks]
    fields = [("shard", pa.int64()), ("within", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()),
              ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields if with_ids else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, n_docs, n_tokens, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, counts, ranked = unpack_block(payload, n_docs, n_tokens)
                ids = id_of[ranked].astype("<u4")
                first = np.cumsum(counts) - counts
                crc = [zlib.crc32(ids[a:a + n]) for a, n in zip(first, counts, strict=True)]
                lists = [pa.ListArray.from_arrays(np.append(first, n_tokens).astype(np.int32), ids.astype(np.int32))]
                yield rows_batch(schema, [shard] * n_docs, before + first, docs, counts, crc, *(lists if with_ids else []))

    blocks = spark.read.parquet(f"{folder}/blocks")
    kinds = "shard long, within long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = blocks.select("shard", "before", "n_docs", "n_tokens", "payload").mapInArrow(run, kinds)
    # One row for each shard: a list as long as that of the files.
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    shards = totals.select("shard", (F.sum("held").over(Window.orderBy("shard")) - F.col("held")).alias("earlier"))
    return rows.join(shards, "shard").select("doc_id", (F.col("earlier") + F.col("within")).alias("start"), "n_tokens",
                                             "ids_crc32", *(["ids"] if with_ids else []))
