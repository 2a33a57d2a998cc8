"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample, each node splitting its sample by the middle of two of its points; then every row
of the table goes down every tree, so each (tree, leaf) holds all rows that belong there. A query keeps one priority
queue over all trees: the node with the largest margin is opened next, so one tree may give several leaves and another
none. Rows of the opened leaves are candidates, and their exact distances decide.

Equal vectors would fill a leaf without bound; of each different vector only the smallest ids can be in a result, as many
as results are asked for and one more for the query itself, so only these are indexed and nothing is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.arrow import plain, rows_batch
from tabprep.sources.storage import stored

#: Rows on which trees are grown; splits only, every row is indexed.
SAMPLE_ROWS = 20_000
SALTS = 32
#: Rows of a cell, about, that one group holds; fuller cells are cut into blocks.
CELL_ROWS = 2_000


class Tree:
    """Inner nodes have a normal vector, an offset and two children; a negative child is the leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        normals, offsets, children, self.leaves = [], [], [], 0
        pending = [(np.arange(len(sample)), None, 0)]
        while pending:
            rows, parent, side = pending.pop()
            split = self._split(sample, rows, rng) if len(rows) > leaf_rows else None
            if split is None:
                node, self.leaves = -1 - self.leaves, self.leaves + 1
            else:
                normal, offset, above = split
                node = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                pending += [(rows[~above], node, 0), (rows[above], node, 1)]
            if parent is None:
                self.root = node
            else:
                children[parent][side] = node
        width = sample.shape[1]
        self.normals = np.array(normals, np.float64).reshape(-1, width)
        self.offsets, self.children = np.array(offsets, np.float64), np.array(children, np.int64).reshape(-1, 2)

    @staticmethod
    def _split(sample, rows, rng):
        for _ in range(4):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            if not (size := np.linalg.norm(normal)):
                continue
            normal /= size
            along = sample[rows] @ normal
            offset = np.median(along)
            above = along > offset
            if 0 < above.sum() < len(rows):
                return normal, offset, above
        return None

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        node = np.full(len(vectors), self.root)
        while len(open_rows := np.flatnonzero(node >= 0)):
            at = node[open_rows]
            above = np.einsum("ij,ij->i", vectors[open_rows], self.normals[at]) > self.offsets[at]
            node[open_rows] = self.children[at, above.astype(np.int64)]
        return -1 - node


def search(trees: list[Tree], query: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """The first ``leaves`` leaves, as (tree, leaf), out of one queue over all trees, the largest margin first."""
    queue = [(-np.inf, t, tree.root) for t, tree in enumerate(trees)]
    margins = [tree.normals @ query - tree.offsets for tree in trees]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < leaves:
        bound, t, node = heapq.heappop(queue)
        if node < 0:
            found.append((t, -1 - node))
            continue
        margin, (below, above) = margins[t][node], trees[t].children[node]
        heapq.heappush(queue, (max(bound, -margin), t, int(above)))
        heapq.heappush(queue, (max(bound, margin), t, int(below)))
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: with an id, and a vector of finite components that are not all zero."""
    own = vectors.select(plain(key).cast("long").alias("vec_id"), plain(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where("vec_id is not null and size(v) > 0").where(finite & F.exists("v", lambda x: x != 0))


def indexed(rows: DataFrame, k: int) -> DataFrame:
    """Of each different vector the k + 1 smallest ids, found first within salts and then over them."""
    bits = rows.withColumn("same", F.sha2(F.array_join(F.transform("v", lambda x: F.hex(x.cast("string"))), ","), 256))
    salted = Window.partitionBy("same", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    few = bits.withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= k + 1)
    return (few.withColumn("nth", F.row_number().over(Window.partitionBy("same").orderBy("vec_id")))
            .where(F.col("nth") <= k + 1).drop("nth", "same"))


def _best_of_cell(k: int):
    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        matrix, ids, out = np.stack(held["v"]), held["vec_id"].to_numpy(), []
        for query, q in zip(asked["query_id"], asked["q"], strict=True):
            score = np.sqrt(np.square(matrix - q).sum(1))
            score[ids == query] = np.inf
            near = np.lexsort((ids, score))[:k]
            out += [(query, ids[i], score[i]) for i in near if ids[i] != query]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def _scored(asked: DataFrame, held: DataFrame, blocks: int, k: int) -> DataFrame:
    """The k nearest rows of each cell for each query that opened it; cells are cut into so many blocks of rows."""
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = held.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    cell = ["tree", "leaf", "block"]
    return asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInPandas(
        _best_of_cell(k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10,
            trees: int = 10, leaf_rows: int = 256, share: float = 0.1, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query by Euclidean distance, ties to smaller ids.

    ``share`` is the part of all leaves that a query opens. Rows of ``vectors`` and ``queries`` (same columns) whose id is
    null or whose vector is null, empty, zero or not finite take no part; a row with the query's own id is no candidate.
    Queries whose leaves hold fewer than k candidates, and vectors of another length than most, are compared with all
    rows of their length, in blocks. Rows that repeat an id and a vector count once. An empty table has no results.
    Distances are taken on the original vectors in double precision.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector).distinct()
    index = stored(indexed(rows, k), "vectors")
    asked = usable(queries, key, vector).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id").withColumnRenamed("v", "q")
    sizes = index.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = sizes[0]["size"], sizes[0]["count"]
    whole = index.where(F.size("v") == width)
    part = min(1.0, 1.2 * SAMPLE_ROWS / total)
    sample = np.array([r.v for r in whole.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < int(part * 1_000_000))
                       .select("v").limit(SAMPLE_ROWS).collect()] or [whole.first().v])
    forest = [Tree(sample, leaf_rows, seed + t) for t in range(trees)]
    leaves = sum(t.leaves for t in forest)
    opened_leaves = max(trees, -int(-share * leaves // 1))
    blocks = max(1, -(-total * trees // (leaves * CELL_ROWS)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])
        for batch in batches:
            matrix = _matrix(batch.column(1))
            for t, tree in enumerate(forest):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(matrix), t, np.int32)), pa.array(tree.leaf_of(matrix).astype(np.int32)),
                     batch.column(0), batch.column(1)], schema=schema)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("query_id", pa.int64()), ("q", pa.list_(pa.float64()))])
        for batch in batches:
            found = [(t, leaf, i) for i, q in enumerate(_matrix(batch.column(1))) for t, leaf in search(forest, q, opened_leaves)]
            take = pa.array([i for _, _, i in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _, _ in found], pa.int32()), pa.array([x for _, x, _ in found], pa.int32()),
                 batch.column(0).take(take), batch.column(1).take(take)], schema=schema)

    places = whole.mapInArrow(cells, "tree int, leaf int, vec_id long, v array<double>")
    wanted = asked.where(F.size("q") == width).mapInArrow(opened, "tree int, leaf int, query_id long, q array<double>")
    scored = stored(_scored(wanted, places, blocks, k).dropDuplicates(["query_id", "vec_id"]), "scored")
    enough = scored.groupBy("query_id").count().where(F.col("count") >= k)
    rest = stored(asked.join(enough, "query_id", "left_anti"), "rest")
    if not rest.isEmpty():
        of_size = lambda df, v: df.select(F.lit(-1).alias("tree"), F.size(v).alias("leaf"), *df.columns)
        exact = _scored(of_size(rest, "q"), of_size(index, "v"), max(1, -(-total // CELL_ROWS)), k)
        scored = scored.join(rest.select("query_id"), "query_id", "left_anti").unionByName(exact)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
