"""Jaccard join of documents on word n-grams, with the global n-gram order cut into vertical fragments.

The global order runs from n-grams in thinly used cells of a fixed table of counts to those in crowded ones, then by
hash. Two sets with a Jaccard similarity of at least p/q can differ in few n-grams, so they share one among the first
few of the order; these first n-grams are the only ones that are indexed. Equal sets are one class with one member in
the search.

Candidates are verified by fragments: the order is cut into ranges, a task counts for each pair the overlap inside each
range, adds the counts up, and gives up a pair once the ranges that are left cannot make up for what is missing.

The first n-gram that two linked sets share cannot stand late in either: where all that precede it are missing from the
other set, too few are left. Only pairs with a shared n-gram early enough for their two sizes are ever made; of the smaller
set these are the inner part of its indexed n-grams. Two linked sets also share a known number of indexed n-grams, so
pairs that share fewer are never verified.

Links are found in two steps, so that a group of near copies never gives all its pairs. In rounds, the classes of each
n-gram that gives many more pairs than rows are compared with a few centres among them, at most ``CENTRES`` or so however
many hold it, as long as rounds leave markedly fewer pairs. Then only classes that are not yet in one component, but
share an n-gram early enough, are compared. Any link between components is among these, so the components are exact
however many rounds went before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.arrow import id_and_text, in_blocks, plain, rows_batch, text_bytes
from tabprep.llm.components import components
from tabprep.llm.hashing import distinct_by_text, mix, shingle_hashes, word_hashes
from tabprep.llm.rows import numbered_rows, unused
from tabprep.sources.storage import stored

#: Cells of the count table that orders n-grams, and the number of pieces it is summed in: 4 MB for any corpus.
CELLS, PIECES = 1 << 20, 64
#: Ranges of the global order in which overlaps are counted.
FRAGMENTS = 16
#: Ids, at most, that are sent to every task (8 bytes each); more are joined by key.
BROADCAST_IDS = 2_000_000
#: Mean numbers of texts, and of their bytes, in a bucket whose pairs with another bucket one cell verifies.
BUCKET_TEXTS, BUCKET_BYTES = 1_000, 4 << 20
#: An n-gram is crowded if its inner rows give more pairs between components than this for each row; a round compares a row
#: with as many centres as make a ``CROWDED``-th of these pairs, at most ``CENTRES`` on average. Rounds end when crowded
#: n-grams have fewer pairs than the index has rows, or when a round leaves more than this share of them. All of it only
#: weighs two exact ways against each other.
CROWDED, CENTRES, LEFT = 4, 16, 0.5


def _shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_by_text(*shingle_hashes(*word_hashes(*text_bytes(column)), width))


def _cell_counts(width: int):
    schema = pa.schema([("piece", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in in_blocks(batches, 0):
            hashes, _ = _shingles(batch.column(0), width)
            counts += np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        used = [np.flatnonzero(x) for x in counts.reshape(PIECES, -1)]
        held = [x[at] for x, at in zip(counts.reshape(PIECES, -1), used, strict=True)]
        yield rows_batch(schema, range(PIECES), [at.astype("<u2").tobytes() for at in used], [x.tobytes() for x in held])
    return run


def _add_cells(frames):
    import pandas as pd
    total = np.zeros(CELLS // PIECES, np.int64)
    for at, n in zip(frames["cells"], frames["counts"], strict=True):
        total[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.int64)
    return pd.DataFrame({"piece": frames["piece"].iloc[:1], "counts": [total.tobytes()]})


def crowded_cells(texts: DataFrame, width: int) -> np.ndarray:
    """One bit for each cell: whether it holds far more n-grams than chance puts into a cell.

    All texts are counted; each task sends the cells it has met, and these are added piece by piece.
    """
    rows = (texts.select("text").mapInArrow(_cell_counts(width), "piece int, cells binary, counts binary")
            .groupBy("piece").applyInPandas(_add_cells, "piece int, counts binary").collect())
    counts = np.zeros((PIECES, CELLS // PIECES), np.int64)
    for r in rows:
        counts[r.piece] = np.frombuffer(r.counts, np.int64)
    mean = counts.mean()
    return np.packbits(counts.reshape(-1) > mean + 6 * np.sqrt(mean) + 8)


def _prefixes(width: int, p: int, q: int, crowded: np.ndarray):
    """Set size, two hashes of the whole set, and the indexed n-grams of each text."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
              ("grams", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(crowded).astype(np.uint64)
        for batch in in_blocks(batches, 1):
            hashes, counts = _shingles(batch.column(1), width)
            ends = np.concatenate([[0], np.cumsum(counts)])
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(k)))]) for k in (0x5A5A, 0xC3C3)]
            whole = [(s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums]
            text = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((hashes, late[(hashes >> np.uint64(44)).astype(np.int64)], text))
            # A partner shares at least ceil(p/q * n) n-grams, so one of the first n - that + 1.
            take = np.where(counts > 0, counts - -(-p * counts // q) + 1, 0)
            place = np.arange(len(hashes)) - ends[:-1][text]
            kept = hashes[order][place < take[text]].view(np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(take)]).astype(np.int32), kept)
            yield rows_batch(schema, batch.column(0), counts, *whole, lists)
    return run


def _verified(width: int, p: int, q: int):
    """Pairs whose sets reach the similarity; overlaps are counted fragment by fragment.

    Rows are (cell, a, null, text) for the texts of a cell, then (cell, a, b, null) for its pairs, sorted.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    borders = (np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(60)) if FRAGMENTS == 16 else None

    def sets(column: pa.Array) -> list[np.ndarray]:
        hashes, counts = _shingles(column, width)
        return np.split(hashes, np.cumsum(counts)[:-1])

    def reaches(x: np.ndarray, y: np.ndarray) -> bool:
        needed = -(-p * (len(x) + len(y)) // (p + q))
        cut_x, cut_y = np.searchsorted(x, borders), np.searchsorted(y, borders)
        ends_x, ends_y = np.append(cut_x, len(x)), np.append(cut_y, len(y))
        parts = np.minimum(np.diff(ends_x, prepend=0), np.diff(ends_y, prepend=0))
        most, at_x, at_y = int(parts.sum()), 0, 0
        for ex, ey, part in zip(ends_x.tolist(), ends_y.tolist(), parts.tolist(), strict=True):
            if most < needed:
                return False
            both = np.concatenate([x[at_x:ex], y[at_y:ey]])
            both.sort()
            most -= part - int((both[1:] == both[:-1]).sum())
            at_x, at_y = ex, ey
        return most >= needed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, {}
        for batch in in_blocks(batches, 3):
            new, good = iter(sets(batch.column(3).filter(batch.column(2).is_null()))), []
            for cell, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if cell != current:
                    current, held = cell, {}
                if b is None:
                    held.setdefault(a, []).append(next(new))
                elif any(reaches(x, y) for x in held[a] for y in held[b]):
                    good.append((a, b))
            yield rows_batch(schema, [a for a, _ in good], [b for _, b in good])
    return run


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids. As long as the ids are few, the large side stays where it is."""
    ids = stored(ids, "ids")
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _check(pairs: DataFrame, texts: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that are links.

    Classes that stand in some pair are dealt to buckets of bounded size, and the pairs of two buckets are a cell. A text
    goes to a cell once, however many of the cell's pairs it stands in.
    """
    pairs = stored(pairs, "pairs")
    both = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(_texts_of(texts, both), "texts")
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    buckets = max(1, -(-n // BUCKET_TEXTS), -(-(size or 0) // BUCKET_BYTES))
    x, y = (F.pmod(F.xxhash64(k), F.lit(buckets)) for k in ("a", "b"))
    cells = pairs.select((F.least(x, y) * F.lit(buckets) + F.greatest(x, y)).alias("cell"), "a", "b")
    held = cells.select("cell", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rows = held.join(texts, "doc_id").select("cell", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text").union(
        cells.select("cell", "a", "b", F.lit(None).cast("string").alias("text")))
    return stored(rows.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())
                  .mapInArrow(_verified(width, p, q), "a long, b long"), "verified")


def _overlap(n: str, m: str, p: int, q: int) -> Column:
    """How many n-grams two linked sets of n and m n-grams share at least."""
    return F.ceil(p * (F.col(n) + F.col(m)) / F.lit(p + q))


def _early(p: int, q: int) -> Column:
    """Whether sets of n and m n-grams can link if the first one that they share stands at ``place`` and ``at``."""
    needed = _overlap("n", "m", p, q)
    return ((F.least("n", "m") * q >= F.greatest("n", "m") * p) & (F.col("place") <= F.col("n") - needed)
            & (F.col("at") <= F.col("m") - needed))


def _fewest_shared(p: int, q: int) -> Column:
    """How many indexed n-grams two linked sets of n and m n-grams share at least.

    Of the o n-grams that they share, n - o of the one set are not in the other. Of the set whose indexed part ends first
    in the order, all indexed n-grams but those stand in the other's indexed part.
    """
    return F.least(*(_overlap("n", "m", p, q) + 1 - F.ceil(p * F.col(k) / F.lit(q)) for k in ("n", "m")))


def _sharing(pairs: DataFrame, lists: DataFrame, p: int, q: int) -> DataFrame:
    """Of the pairs (a, b, n, m), as (a, b) those that share as many indexed n-grams as linked sets of n and m n-grams do."""
    x, y = (lists.select(F.col("doc_id").alias(k), F.col("grams").alias(f"grams_{k}")) for k in ("a", "b"))
    enough = F.size(F.array_intersect("grams_a", "grams_b")) >= _fewest_shared(p, q)
    return pairs.join(x, "a").join(y, "b").where(enough).select("a", "b").distinct()


def _open(index: DataFrame, round_no: int) -> DataFrame:
    """The rows whose n-gram several components share; whether the inner rows of the n-gram give many more pairs from
    different components than they are (``crowded``, with these pairs for each row), and whether the row's class is one of
    its centres in this round."""
    own = F.xxhash64("doc_id", F.lit(round_no))
    each = index.groupBy("gram", "part").agg(F.count_if("inner").cast("double").alias("c"), F.min(F.when(F.col("inner"), own)).alias("h"))
    grams = each.groupBy("gram").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("c").alias("held"),
        ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"), F.min("h").alias("h")).where("parts > 1 and held > 0")
    each_row = F.try_divide("pairs", "held")
    drawn = F.pmod(own, F.lit(1 << 30)) < F.least(each_row / CROWDED, F.lit(CENTRES)) * (1 << 30) / F.greatest("held", F.lit(1.0))
    return stored(index.join(grams, "gram").select(
        "gram", "place", "doc_id", "n", "inner", "part", F.when(F.col("inner") & (F.col("pairs") > CROWDED * F.col("held")), each_row).alias("crowded"),
        ((own == F.col("h")) | drawn).alias("centre")), "open")


def _crowded_pairs(index: DataFrame) -> tuple[float, int]:
    """Pairs of inner rows with the same crowded n-gram and different components, and the number of all rows."""
    row = index.agg(F.sum("crowded"), F.count(F.lit(1))).first()
    return row[0] or 0.0, row[1]


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, p: int = 85,
                    q: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest document with the same set), component_id, for each document.

    Documents link when q * intersection >= p * union of their sets of ``width``-word shingles, A-Z in lower case; a text
    with fewer words has its whole sequence as its one shingle. Null, empty and wordless texts have no shingle, link with
    nothing and are their own component. Rows with a null id link with nothing and have no component; rows that repeat an
    id count as one document whose texts link on their own. An empty table stays empty. Other columns are not read.
    Shingles are compared by 64-bit hashes.
    """
    texts = id_and_text(docs, key, text)
    known = texts.where("doc_id is not null")
    crowded = crowded_cells(known, width)
    sets = stored(known.mapInArrow(_prefixes(width, p, q, crowded),
                                   "doc_id long, n long, set_a long, set_b long, grams array<long>"), "sets")
    same = sets.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id"))
    members = stored(sets.where("n > 0").select("doc_id", "n", "set_a", "set_b").join(same, ["set_a", "set_b"])
                     .select("doc_id", "n", "class_id"), "members")
    first = members.where("doc_id = class_id").select("doc_id").distinct()
    index = sets.join(first, "doc_id", "left_semi").select("doc_id", "n", F.posexplode("grams").alias("place", "gram"))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    shared = stored(index.join(held.where("held > 1").select("gram"), "gram"), "shared")
    # a class is grouped with its own n-grams, never more than its indexed part
    lists = stored(shared.groupBy("doc_id").agg(F.collect_set("gram").alias("grams")), "lists")
    marked = shared.withColumn("inner", F.col("place") <= F.col("n") - _overlap("n", "n", p, q))
    found_links, before, round_no = [], float("inf"), 0
    open_index = _open(marked.withColumn("part", F.col("doc_id")), round_no)
    while True:
        pairs, rows = _crowded_pairs(open_index)
        if pairs <= rows or pairs > LEFT * before:
            break
        crowded = open_index.where("crowded is not null")
        centres = crowded.where("centre").select("gram", F.col("place").alias("at"), F.col("doc_id").alias("a"),
                                                 F.col("n").alias("m"), F.col("part").alias("part_a"))
        stars = (crowded.join(centres, "gram").where(F.col("part") != F.col("part_a")).where(_early(p, q))
                 .select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b"), "n", "m").distinct())
        found_links.append(_check(_sharing(stars, lists, p, q), known, width, p, q))
        before, round_no = pairs, round_no + 1
        parts = components(reduce(DataFrame.union, found_links))
        open_index = _open(open_index.join(parts, F.col("doc_id") == F.col("node"), "left").select(
            "gram", "place", "doc_id", "n", "inner", F.coalesce("component", "doc_id").alias("part")), round_no)
    small = open_index.where("inner").select("gram", F.col("place").alias("at"), F.col("doc_id").alias("b"), F.col("n").alias("m"),
                                             F.col("part").alias("part_b"))
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("part_b") < F.col("part")))
    across = (open_index.join(small, "gram").where(F.col("part") != F.col("part_b")).where(smaller).where(_early(p, q))
              .select(F.least("b", "doc_id").alias("a"), F.greatest("b", "doc_id").alias("b"), "n", "m").distinct())
    found_links.append(_check(_sharing(across, lists, p, q), known, width, p, q))
    copies = members.where("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    whole = components(reduce(DataFrame.union, found_links, copies))
    named = (sets.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
             .join(members.groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "doc_id", "left")
             .join(whole, F.col("doc_id") == F.col("node"), "left")
             .select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
                     F.coalesce("component", "doc_id").alias("component_id")))
    return (texts.select("doc_id").join(named, "doc_id", "left")
            .select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "class_id", "component_id"))


def keep_smallest(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The rows of ``docs`` but for those whose component has a smaller document; rows with a null id stay.

    Rows that repeat an id are documents of their own, the smaller text first, so of equal rows one stays.
    """
    row, dropped = unused("row", docs), unused("dropped", docs)
    numbered = numbered_rows(docs, row, key, text)
    known = numbered.where(plain(key).cast("long").isNotNull())
    found = join_components(known, row, text, width, p, q).where("component_id < doc_id").select(F.col("doc_id").alias(dropped))
    return numbered.join(found, F.col(row) == F.col(dropped), "left_anti").drop(row)
