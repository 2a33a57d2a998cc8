"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry; codebooks by Lloyd rounds
that compare active entries only.

Between two rounds a block keeps, for each part, its entry and the exact squared distance to it. An entry is active if
the last update moved it. A part whose own entry stayed has its distance already, and all entries that stayed were no
better then and are no better now, so it is compared with the active entries alone; ties still go to the lower index. A
part whose entry moved is compared with all entries. Blocks also keep what the round changes in the sums and counts of
the entries, so the driver only holds the codebooks: ``entries * dimension`` integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.arrow import rows_batch
from tabprep.llm.vector_blocks import (Rounds, blocks_of, finite_vectors, one_list, packed, squared_distances,
                                       unpacked, whole_numbers)
from tabprep.sources.storage import stored

#: Copies of each label's total that the last join meets, so that a label with a third of all rows has many tasks.
LABEL_SALTS = 32


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest index of a nearest entry for each row, and its squared distance."""
    far = squared_distances(points, entries)
    code = far.argmin(1)
    return code, far[np.arange(len(points)), code]


def active_entries(points: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray,
                   distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows with the entry and exact distance of the round before; ``moved`` marks entries changed since."""
    code, distance = code.copy(), distance.copy()
    lost = moved[code]
    active = np.flatnonzero(moved)
    if len(active) and not lost.all():
        rows = np.flatnonzero(~lost)
        found, far = nearest_entries(points[rows], entries[active])
        found = active[found]
        better = (far < distance[rows]) | ((far == distance[rows]) & (found < code[rows]))
        code[rows[better]], distance[rows[better]] = found[better], far[better]
    if lost.any():
        code[lost], distance[lost] = nearest_entries(points[lost], entries)
    return code, distance


def _change(points: np.ndarray, before: np.ndarray | None, after: np.ndarray, entries: int) -> np.ndarray:
    """Counts and sums (part, entry, 1 + width) that parts with a new entry bring to it and take from the old one."""
    n, parts, width = points.shape
    out = np.zeros((parts, entries, 1 + width), np.int64)
    for p in range(parts):
        rows = np.arange(n) if before is None else np.flatnonzero(before[:, p] != after[:, p])
        for sign, codes in ((1, after), (-1, before)):
            if codes is not None and len(rows):
                np.add.at(out[p, :, 0], codes[rows, p], sign)
                np.add.at(out[p, :, 1:], codes[rows, p], sign * points[rows, p])
    return out


def _assign(codebooks: np.ndarray, moved: np.ndarray | None, scale: int, kind: pa.DataType):
    """A pass over vectors (``moved`` is None) or over state blocks."""
    parts, entries, width = codebooks.shape
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(kind)), ("width", pa.int32()),
                        ("vectors", pa.binary()), ("codes", pa.binary()), ("distances", pa.binary()),
                        ("change", pa.list_(pa.int64()))])

    def assigned(points: np.ndarray, code: np.ndarray | None, distance: np.ndarray | None):
        each = [nearest_entries(points[:, p], codebooks[p]) if code is None else
                active_entries(points[:, p], codebooks[p], moved[p], code[:, p], distance[:, p]) for p in range(parts)]
        after, far = (np.stack(x, 1) for x in zip(*each, strict=True))
        return after.astype("<u2").tobytes(), far.astype("<i8").tobytes(), _change(points, code, after, entries).ravel()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks_of(batches):
            values = whole_numbers(batch.column("vector"), scale)
            codes, far, change = assigned(values.reshape(-1, parts, width), None, None)
            yield rows_batch(schema, one_list(batch.column("id")), one_list(batch.column("label")),
                             *([x] for x in packed(values)), [codes], [far], [change])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                size, vectors, codes, far = (row.column(c)[0].as_py() for c in ("width", "vectors", "codes", "distances"))
                points = unpacked(size, vectors, parts * width).reshape(-1, parts, width)
                code = np.frombuffer(codes, "<u2").astype(np.int64).reshape(-1, parts)
                codes, far, change = assigned(points, code, np.frombuffer(far, "<i8").reshape(-1, parts))
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:4], pa.array([codes], pa.binary()), pa.array([far], pa.binary()),
                     pa.array([change], pa.list_(pa.int64()))], schema=row.schema)
    return first if moved is None else again


def _rows(parts: int, digits: int, kind: pa.DataType):
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.string()), ("error", pa.int64()), ("label", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                codes = np.frombuffer(row.column("codes")[0].as_py(), "<u2").reshape(-1, parts)
                far = np.frombuffer(row.column("distances")[0].as_py(), "<i8").reshape(-1, parts)
                names = ["".join(f"{c:0{digits}x}" for c in code) for code in codes.tolist()]
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), pa.array(names, pa.string()),
                                                  pa.array(far.sum(1), pa.int64()), row.column("labels").flatten()],
                                                 schema=schema)
    return run


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4,
             entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Codes of all vectors: vec_id, code, error, label, label_error, codebooks_sha256.

    A component x becomes floor(scale * x). Part p's codebook starts as part p of the ``entries`` smallest ids (all, if
    there are fewer). A round gives every part its nearest entry, ties to the lower index, and replaces every entry in use
    by the floor of its parts' means. ``code`` has the entries after the last round in lowercase hexadecimal digits, as
    many for each as the largest index needs. ``label_error`` is the error summed over equal labels.

    Rows whose vector is null or holds a null or non-finite component are left out. So are vectors whose number of
    components is not that of the smallest id or is not a multiple of ``parts``, empty ones included. A null id counts as
    the largest and stays null; rows that repeat an id are all coded and start codebooks in order of id, then vector.
    Null labels are one label. An empty table gives no rows. Other columns are not read and may have any name.
    Components beyond 32 bits after scaling, or distances beyond 64, raise an error. What a worker holds is one block of
    vectors, what the driver holds are the codebooks.
    """
    if entries > 1 << 16:
        raise ValueError("at most 65536 entries a part")
    spark = rows.sparkSession
    vectors = finite_vectors(rows, key, vector, label=label).where(F.size("vector") > 0).where(F.size("vector") % parts == 0)
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    head = vectors.orderBy(*order).select("vector").limit(1).collect()
    dimension = len(head[0].vector) if head else parts
    vectors = vectors.where(F.size("vector") == dimension)
    seeds = [r.vector for r in vectors.orderBy(*order).select("vector").limit(entries).collect()]
    kind = vectors.select("label").limit(0).toArrow().schema.field("label").type
    named = vectors.schema["label"].dataType.simpleString()
    start = whole_numbers(pa.array(seeds, pa.list_(pa.float64())), scale) if seeds else np.zeros((1, dimension), np.int64)
    codebooks = start.reshape(-1, parts, dimension // parts).transpose(1, 0, 2).copy()
    state = Rounds(spark, f"ids array<bigint>, labels array<{named}>, width int, vectors binary, codes binary, "
                          "distances binary, change array<bigint>", "vector-codes")
    totals, moved = np.zeros((parts, codebooks.shape[1], 1 + dimension // parts), np.int64), None
    for done in range(rounds + 1):
        state.step(vectors if done == 0 else None, _assign(codebooks, moved, scale, kind))
        if done < rounds:
            totals += state.change(totals.size).reshape(totals.shape)
            used = totals[:, :, 0] > 0
            means = np.floor_divide(totals[:, :, 1:], np.maximum(totals[:, :, :1], 1))
            means[~used] = codebooks[~used]
            moved, codebooks = (means != codebooks).any(2), means
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    digits = max(2, len(f"{entries - 1:x}"))
    coded = stored(state.state().mapInArrow(_rows(parts, digits, kind), f"vec_id bigint, code string, error bigint, label {named}")
                   .withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_SALTS)).cast("int")), "codes")
    by_label = (coded.groupBy(F.col("label").alias("of"), "salt").agg(F.sum("error").alias("error"))
                .groupBy("of").agg(F.sum("error").alias("label_error"))
                .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1)))))
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy")))
            .select("vec_id", "code", "error", "label", "label_error", F.lit(digest).alias("codebooks_sha256")))


def _assign_sql(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, part, min(d * 256 + entry) AS best FROM (
    SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d
    FROM x JOIN c{k} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL)
  GROUP BY ALL)"""


def _update_sql(k: int) -> str:
    return f"""
c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, coalesce((s.t - ((s.t % s.n) + s.n) % s.n) // s.n, c.v)::BIGINT AS v FROM c{k} c LEFT JOIN (
    SELECT x.part, a.best % 256 AS entry, x.pos, sum(x.v) AS t, count(*) AS n
    FROM x JOIN a{k} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL) s
  ON s.part = c.part AND s.entry = c.entry AND s.pos = c.pos)"""


#: The production parameters in SQL: ids are unique, all vectors have 64 components.
CODES_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, i // 16 AS part, i % 16 AS pos, floor(1024 * embedding[i + 1]::DOUBLE)::BIGINT AS v
  FROM kept, range(64) r(i)),
c0 AS MATERIALIZED (
  SELECT part, n - 1 AS entry, pos, v FROM x
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM kept) USING (vec_id) WHERE n <= 256),
{",".join(_assign_sql(k) + "," + _update_sql(k) for k in range(4))},{_assign_sql(4)},
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c4),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', (best % 256)::INTEGER), '' ORDER BY part) AS code,
         sum(best // 256)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN books
"""
