"""Centroid clustering with heap-ordered bounds.

A vector's gap is the distance to its second nearest centroid less that to its nearest, at the time both were computed.
While centroids drift, the gap of a vector of cluster c shrinks in each round by at most the drift of c plus the largest
drift of another centroid. Every cluster adds these up in one number, its offset, and a vector enters its cluster's heap
under its gap plus the offset of that time: it expires when the offset reaches its key. A round pops the expired vectors
from the top of each heap, compares only them with all centroids, exactly, and pushes them into the heaps of their
clusters. All others keep their centroid without being looked at.

Each block of vectors has its own heap for each cluster, stored in heap order, so heaps never grow beyond a block and
never leave their task. Blocks report what changed in the sums and counts of the clusters; the driver holds the
centroids, their sums and offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.arrow import rows_batch
from tabprep.llm.vector_blocks import (Rounds, blocks_of, finite_vectors, one_list, packed, squared_distances,
                                       unpacked, whole_numbers)
from tabprep.sources.storage import stored

#: Relative allowance for rounding in bounds, far above the error of a few sums of doubles. A vector within it is rescanned.
ALLOWANCE = 1e-9

_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("vectors", pa.binary()),
                    ("clusters", pa.binary()), ("heap_keys", pa.binary()), ("heap_members", pa.binary()),
                    ("heap_ends", pa.binary()), ("rescanned", pa.int64()), ("change", pa.list_(pa.int64()))])
_FIELDS = ("ids array<bigint>, width int, vectors binary, clusters binary, heap_keys binary, heap_members binary, "
           "heap_ends binary, rescanned bigint, change array<bigint>")


def scan(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest number of a nearest centroid for each row, and a lower bound of its gap."""
    far = squared_distances(points, centroids)
    rows = np.arange(len(points))
    cluster = far.argmin(1)
    near = np.sqrt(far[rows, cluster].astype(np.float64))
    if len(centroids) == 1:
        return cluster, np.full(len(points), np.inf)
    second = far.astype(np.float64)
    second[rows, cluster] = np.inf
    next_near = np.sqrt(second.min(1))
    return cluster, next_near - near - ALLOWANCE * (1 + next_near + near)


def added_offsets(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much each cluster's gaps may have shrunk when the centroids moved from ``before`` to ``after``."""
    drift = np.sqrt(((after - before).astype(np.float64) ** 2).sum(1)) * (1 + ALLOWANCE)
    if len(drift) < 2:
        return drift
    first, second = np.sort(drift)[[-1, -2]]
    others = np.full(len(drift), first)
    others[drift.argmax()] = second
    return drift + others


class Heaps:
    """The heaps of one block: (key, place in the block) for each cluster, turned into lists only when touched."""

    def __init__(self, keys: np.ndarray, members: np.ndarray, ends: np.ndarray):
        self.keys, self.members, self.ends = keys, members, ends
        self.open: dict[int, list[tuple[float, int]]] = {}

    @classmethod
    def of(cls, cluster: np.ndarray, keys: np.ndarray, clusters: int) -> Heaps:
        heaps = cls(np.zeros(0), np.zeros(0, np.int64), np.zeros(clusters, np.int64))
        for c in np.unique(cluster).tolist():
            members = np.flatnonzero(cluster == c)
            heaps.open[c] = list(zip(keys[members].tolist(), members.tolist(), strict=True))
            heapify(heaps.open[c])
        return heaps

    def _stored(self, c: int) -> slice:
        return slice(int(self.ends[c - 1]) if c else 0, int(self.ends[c]))

    def list_of(self, c: int) -> list[tuple[float, int]]:
        if c not in self.open:
            at = self._stored(c)
            self.open[c] = list(zip(self.keys[at].tolist(), self.members[at].tolist(), strict=True))
        return self.open[c]

    def expired(self, offsets: np.ndarray) -> np.ndarray:
        """Take the vectors whose gap may be used up from all heaps, in order of their places."""
        out = []
        for c, limit in enumerate((offsets * (1 + ALLOWANCE)).tolist()):
            at = self._stored(c)
            if c not in self.open and (at.start == at.stop or self.keys[at.start] > limit):
                continue
            heap = self.list_of(c)
            while heap and heap[0][0] <= limit:
                out.append(heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def push(self, cluster: np.ndarray, keys: np.ndarray, members: np.ndarray) -> None:
        for c, key, member in zip(cluster.tolist(), keys.tolist(), members.tolist(), strict=True):
            heappush(self.list_of(c), (key, member))

    def arrays(self) -> tuple[bytes, bytes, bytes]:
        keys, members, sizes = [], [], []
        for c in range(len(self.ends)):
            if c in self.open:
                heap = self.open[c]
                keys.append(np.array([k for k, _ in heap], np.float64))
                members.append(np.array([m for _, m in heap], np.int64))
            else:
                keys.append(self.keys[self._stored(c)])
                members.append(self.members[self._stored(c)])
            sizes.append(len(keys[-1]))
        return (np.concatenate(keys).astype("<f8").tobytes(), np.concatenate(members).astype("<i4").tobytes(),
                np.cumsum(sizes).astype("<i4").tobytes())


def _change(points: np.ndarray, before: np.ndarray | None, after: np.ndarray, clusters: int) -> np.ndarray:
    """Count and sums (cluster, 1 + dimension) that vectors bring to their new cluster and take from the old one."""
    out = np.zeros((clusters, 1 + points.shape[1]), np.int64)
    for sign, of in ((1, after), (-1, before)):
        if of is not None:
            np.add.at(out[:, 0], of, sign)
            np.add.at(out[:, 1:], of, sign * points)
    return out.ravel()


def _first(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks_of(batches):
            points = whole_numbers(batch.column("vector"), scale)
            cluster, gaps = scan(points, centroids)
            yield rows_batch(_STATE, one_list(batch.column("id")), *([x] for x in packed(points)),
                             [cluster.astype("<u2").tobytes()],
                             *([x] for x in Heaps.of(cluster, gaps, len(centroids)).arrays()), [len(points)],
                             [_change(points, None, cluster, len(centroids))])
    return run


def _again(centroids: np.ndarray, offsets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                width, vectors, clusters, keys, members, ends = (c[0].as_py() for c in row.columns[1:7])
                cluster = np.frombuffer(clusters, "<u2").astype(np.int64)
                heaps = Heaps(np.frombuffer(keys, "<f8"), np.frombuffer(members, "<i4"), np.frombuffer(ends, "<i4"))
                old = heaps.expired(offsets)
                points = unpacked(width, vectors, centroids.shape[1])[old]
                found, gaps = scan(points, centroids)
                heaps.push(found, gaps + offsets[found], old)
                moved = found != cluster[old]
                change = _change(points[moved], cluster[old[moved]], found[moved], len(centroids))
                cluster[old] = found
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:3], pa.array([cluster.astype("<u2").tobytes()], pa.binary()),
                     *(pa.array([x], pa.binary()) for x in heaps.arrays()), pa.array([len(old)], pa.int64()),
                     pa.array([change], pa.list_(pa.int64()))], schema=_STATE)
    return run


def _rows(centroids: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, width, vectors, clusters = (batch.column(c)[k] for c in ("ids", "width", "vectors", "clusters"))
                cluster = np.frombuffer(clusters.as_py(), "<u2").astype(np.int64)
                away = unpacked(width.as_py(), vectors.as_py(), centroids.shape[1]) - centroids[cluster]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(cluster, pa.int32()), pa.array((away * away).sum(1), pa.int64())], schema=schema)
    return run


def cluster_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dimension: int = 64,
                    clusters: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2,
                    rescans: list[tuple[int, int]] | None = None) -> DataFrame:
    """Cluster of each vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A component x becomes floor(scale * x). Centroids 0, 1, ... start as the vectors with the smallest sha256 of
    ``<seed>:<id>`` (as many as there are, if fewer than ``clusters``). A round gives each vector its nearest centroid,
    ties to the smaller number, and replaces every centroid in use by the floor of its vectors' means. ``distance`` is
    the squared distance to the centroid after the last round; inertias are its sums over a cluster and over all.
    ``rescans``, if given, receives for each pass the number of vectors compared with all centroids, and of all vectors.

    Rows whose vector is null, has another number of components, or holds a null or non-finite component are left out. A
    null id stays null and starts a centroid only after all others; rows that repeat an id are all clustered and start
    centroids in order of their vectors. An empty table gives no rows. Other columns are not read and may have any name.
    Components beyond 32 bits after scaling, or distances beyond 64, raise an error. What a worker holds is one block of
    vectors, what the driver holds are the centroids, their sums and offsets.
    """
    if clusters > 1 << 16:
        raise ValueError("at most 65536 clusters")
    spark = rows.sparkSession
    vectors = finite_vectors(rows, key, vector).where(F.size("vector") == dimension)
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last()
    seeds = [r.vector for r in vectors.orderBy(by_hash, "vector").select("vector").limit(clusters).collect()]
    centroids = whole_numbers(pa.array(seeds, pa.list_(pa.float64())), scale) if seeds else np.zeros((1, dimension), np.int64)
    k = len(centroids)
    state, totals, offsets = Rounds(spark, _FIELDS, "centroid-heaps"), np.zeros((k, 1 + dimension), np.int64), np.zeros(k)
    for done in range(rounds + 1):
        state.step(vectors if done == 0 else None, _first(centroids, scale) if done == 0 else _again(centroids, offsets))
        if rescans is not None:
            seen = state.state().agg(F.sum("rescanned"), F.sum(F.size("ids"))).first()
            rescans.append((seen[0] or 0, seen[1] or 0))
        if done < rounds:
            totals += state.change(totals.size).reshape(totals.shape)
            means = np.floor_divide(totals[:, 1:], np.maximum(totals[:, :1], 1))
            means[totals[:, 0] == 0] = centroids[totals[:, 0] == 0]
            offsets, centroids = offsets + added_offsets(centroids, means), means
    placed = stored(state.state().mapInArrow(_rows(centroids), "vec_id bigint, cluster int, distance bigint"), "clusters")
    sums = {r.cluster: r.total for r in placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    table = [(c, total, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, total in sums.items()]  # as many rows as clusters
    named = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                             "centroid_sha256")


def _assign_sql(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, min(d * 40 + cluster) AS best FROM (
    SELECT x.vec_id, c.cluster, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c ON c.pos = x.pos GROUP BY ALL)
  GROUP BY ALL)"""


def _update_sql(k: int) -> str:
    return f"""
c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, c.pos, coalesce((s.t - ((s.t % s.n) + s.n) % s.n) // s.n, c.v)::BIGINT AS v FROM c{k} c LEFT JOIN (
    SELECT a.best % 40 AS cluster, x.pos, sum(x.v) AS t, count(*) AS n FROM x JOIN a{k} a ON a.vec_id = x.vec_id
    GROUP BY ALL) s ON s.cluster = c.cluster AND s.pos = c.pos)"""


#: The production parameters in SQL: ids are unique.
CLUSTERS_SQL = f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT vec_id, i AS pos, floor(256 * embedding[i + 1]::DOUBLE)::BIGINT AS v FROM kept, range(64) r(i)),
c0 AS MATERIALIZED (
  SELECT n - 1 AS cluster, pos, v FROM x
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) AS n FROM kept) USING (vec_id) WHERE n <= 40),
{",".join(_assign_sql(k) + "," + _update_sql(k) for k in range(5))},{_assign_sql(5)},
named AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c5 GROUP BY cluster),
placed AS (SELECT vec_id, (best % 40)::INTEGER AS cluster, (best // 40)::BIGINT AS distance FROM a5)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM placed JOIN named USING (cluster)
"""
