"""A tree of bounded cells over points with gaps, and work that meets rows with the table of their cell.

Cells are cut at medians, the widest feature first; points without the feature go to a branch of their own. One round cuts
every crowded cell into up to ``CHILDREN`` pieces at once, by a tree over a bounded sample of its points, so a table of any
size needs few rounds, and neither the points nor the cells are ever held in one place. A cell whose sample shows no
difference is cut in the middle of its exact box, so every round makes progress until a cell holds equal points only.

``boxes`` describes every node: number of points, and for each feature how many points have it and between which values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.hashing import spread_number
from tabprep.sources.storage import stored

ROWS_PER_CELL = 5_000
CHILDREN = 1_024
SAMPLE_PER_CHILD = 16
#: a table of cells goes to every task up to this many numbers, beyond it rows and table are shuffled by cell
SHARED_NUMBERS = 1_000_000
#: rows of one cell that meet their table in one task
ROWS_PER_CHUNK = 20_000
#: node numbers: a node's children follow its number times _BASE, so five levels fit a long
_BASE, _DEPTH = 1 << 12, 5


@dataclass
class Cuts:
    """A tree as arrays: feature (-1 in a leaf), cut, and the nodes below, above and without the feature."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    none: np.ndarray

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Node number of the leaf of each point; NaN is a missing feature."""
        node = np.zeros(len(points), np.int64)
        inner = np.flatnonzero(self.feature[node] >= 0)
        while len(inner):
            at = node[inner]
            v = points[inner, self.feature[at]]
            node[inner] = np.where(np.isnan(v), self.none[at], np.where(v <= self.cut[at], self.below[at], self.above[at]))
            inner = inner[self.feature[node[inner]] >= 0]
        return node


def _worthiest(wide: np.ndarray, worth: np.ndarray | None) -> int:
    """The widest feature by its worth; features without worth only where no other differs."""
    weighted = wide if worth is None else wide * worth
    return int(np.argmax(weighted if weighted.max(initial=0) > 0 else wide))


def median_cuts(sample: np.ndarray, pieces: int, n: int, counts: np.ndarray, low: np.ndarray, high: np.ndarray,
                worth: np.ndarray | None = None) -> Cuts | None:
    """Cuts of a cell into about ``pieces`` by its sample; its exact size and box settle what the sample cannot.

    Features are preferred by width times ``worth``. None if all points of the cell are equal.
    """
    nodes: list[list] = [[-1, 0.0, 0, 0, 0]]
    todo = [(0, np.arange(len(sample)), pieces)]
    while todo:
        node, rows, want = todo.pop()
        if want < 2 or len(nodes) + 3 > _BASE - 1:
            continue
        values = sample[rows]
        has = ~np.isnan(values)
        share = has.mean(0) if len(rows) else np.zeros(sample.shape[1])
        some = np.flatnonzero(has.any(0)) if len(rows) else np.zeros(0, int)
        wide = np.zeros(sample.shape[1])
        if len(some):
            wide[some] = np.nanmax(values[:, some], 0) - np.nanmin(values[:, some], 0)
        j = _worthiest(wide * share, worth) if len(some) else 0
        if wide[j] > 0:
            v = values[has[:, j], j]
            cut = float(np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2])
            if cut == v.max():
                cut = float(v[v < cut].max())
            sides = [rows[has[:, j] & (values[:, j] <= cut)], rows[has[:, j] & (values[:, j] > cut)], rows[~has[:, j]]]
        elif len(rows) and ((share > 0) & (share < 1)).any():
            j = int(np.argmax((share > 0) & (share < 1)))
            cut, sides = np.inf, [rows[has[:, j]], rows[:0], rows[~has[:, j]]]
        else:
            continue
        at = len(nodes)
        below, above = at, at if cut == np.inf else at + 1
        none = max(below, above) + 1 if len(sides[2]) else below
        nodes[node] = [j, cut, below, above, none]
        for child, side in ((below, sides[0]), (above, sides[1]), (none, sides[2])):
            if child == len(nodes):
                nodes.append([-1, 0.0, 0, 0, 0])
                todo.append((child, side, round(want * len(side) / len(rows))))
    if len(nodes) == 1:
        wide = np.where(counts > 0, high - low, 0)
        mixed = (counts > 0) & (counts < n)
        if wide.max() > 0:
            j = _worthiest(wide, worth)
            middle = low[j] / 2 + high[j] / 2
            nodes = [[j, middle if middle < high[j] else low[j], 1, 2, 1]] + [[-1, 0.0, 0, 0, 0]] * 2
        elif mixed.any():
            nodes = [[int(mixed.argmax()), np.inf, 1, 1, 2]] + [[-1, 0.0, 0, 0, 0]] * 2
        else:
            return None
    return Cuts(*(np.array(c) for c in zip(*nodes, strict=True)))


def with_cell_tables(rows: DataFrame, tables: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                     schema: T.StructType, share: bool = True) -> DataFrame:
    """``run(rows, table)`` for the rows of each ``cell`` with the rows of ``tables`` that have the same ``cell``.

    Small tables go to every task and rows stay where they are. Beyond ``SHARED_NUMBERS`` both are shuffled by cell, and a
    cell with many rows is dealt into chunks that each meet the table. A cell without a table meets an empty one.
    """
    width = len(tables.columns)
    if share and (few := tables.limit(SHARED_NUMBERS // width + 1).toArrow()).num_rows * width <= SHARED_NUMBERS \
            and few.nbytes <= 32 * SHARED_NUMBERS:
        held = dict(list(few.to_pandas().groupby("cell")))
        empty = few.slice(0, 0).to_pandas()

        def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for cell, part in pdf.groupby("cell"):
                    yield run(part, held.get(cell, empty))

        return rows.mapInPandas(shared, schema)
    chunks = rows.groupBy("cell").agg((1 + F.floor(F.count("*") / ROWS_PER_CHUNK)).cast("int").alias("__chunks"))
    chunks = stored(chunks, "chunks")
    left = (rows.join(chunks, "cell")
            .withColumn("__chunk", F.pmod(F.xxhash64(*rows.columns), F.col("__chunks")).cast("int")).drop("__chunks"))
    right = (tables.join(chunks, "cell")
             .withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))).drop("__chunks"))
    return (left.groupBy("cell", "__chunk").cogroup(right.groupBy("cell", "__chunk"))
            .applyInPandas(lambda a, b: run(a.drop(columns="__chunk"), b.drop(columns="__chunk")), schema))


def children_of(boxes: DataFrame) -> DataFrame:
    """The boxes keyed by the node above them: ``cell`` is the parent, ``child`` the node itself."""
    return boxes.where("cell > 0").withColumnRenamed("cell", "child") \
        .withColumn("cell", F.floor((F.col("child") - 1) / _BASE).cast("bigint"))


def cell_tree(points: DataFrame, features: Sequence[str], counted: Sequence[str] = (),
              worth: Sequence[float] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Points with their ``cell``, the ``boxes`` of all nodes, and the depth of the tree.

    ``boxes`` has cell, n, c_<feature>, lo_<feature>, hi_<feature>, and c_<column> for the ``counted`` columns. The root
    is 0; cells that have no children are leaves. Features are doubles without NaN. ``worth`` says for each feature how
    useful cuts by it are, all alike without it.
    """
    worth = None if worth is None else np.array(worth, float)
    features = list(features)
    placed, depth, levels = points.withColumn("cell", F.lit(0).cast("bigint")).withColumn("__depth", F.lit(0)), 0, []
    plan_schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("node", T.LongType())] + [
        T.StructField(x, T.DoubleType() if x == "cut" else T.LongType()) for x in ("feature", "cut", "below", "above", "none")])
    while True:
        fresh = stored(
            placed.where(F.col("__depth") == depth).groupBy("cell").agg(
                F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in [*features, *counted]],
                *[F.min(f).alias(f"lo_{f}") for f in features], *[F.max(f).alias(f"hi_{f}") for f in features]), "boxes")
        levels.append(fresh)
        crowded = fresh.where(F.col("n") > ROWS_PER_CELL)
        if depth == _DEPTH or crowded.isEmpty():
            break
        pieces = F.least(F.ceil(F.col("n") * 2 / ROWS_PER_CELL), F.lit(CHILDREN)).cast("int")
        wanted = crowded.withColumn("__pieces", pieces)
        draw = spread_number(F.xxhash64("id"), depth) < F.col("__pieces") * SAMPLE_PER_CHILD / F.col("n")
        sample = (placed.join(wanted.select("cell", "n", "__pieces"), "cell").where(draw).select("cell", *features))

        def build(drawn: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
            b = box.iloc[0]
            exact = [np.array([b[f"{kind}_{f}"] for f in features], float) for kind in ("c", "lo", "hi")]
            cuts = median_cuts(drawn[features].to_numpy(float), int(b["__pieces"]), int(b["n"]), *exact, worth)
            out = pd.DataFrame({"node": [], **{x: [] for x in plan_schema.names[2:]}} if cuts is None else
                               {"node": range(len(cuts.feature)), **{x: getattr(cuts, x) for x in plan_schema.names[2:]}})
            out.insert(0, "cell", b["cell"])
            return out.astype({x: "float64" if x == "cut" else "int64" for x in plan_schema.names})

        plans = stored(sample.groupBy("cell").cogroup(wanted.groupBy("cell")).applyInPandas(build, plan_schema), "cuts")
        if plans.isEmpty():
            break

        def descend(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
            if len(plan):
                plan = plan.sort_values("node")
                cuts = Cuts(*(plan[x].to_numpy() for x in plan_schema.names[2:]))
                leaf = cuts.leaves(rows[features].to_numpy(float))
                rows = rows.assign(cell=rows["cell"].to_numpy() * _BASE + 1 + leaf, __depth=depth + 1)
            return rows[placed_schema.names]

        placed_schema = placed.schema
        # points of a cell side by side, since each batch of a later task handles its cells one by one
        placed = stored(with_cell_tables(placed, plans, descend, placed_schema).sortWithinPartitions("cell"), "cells")
        depth += 1
    boxes = levels[0]
    for level in levels[1:]:
        boxes = boxes.union(level)
    return placed.drop("__depth"), boxes, depth


class Boxes:
    """Boxes of some cells as arrays, with lower bounds of the distance from queries to any of their points."""

    def __init__(self, table: pd.DataFrame, features: Sequence[str]):
        self.n = table["n"].to_numpy(float)
        self.counts, self.low, self.high = (table[[f"{kind}_{f}" for f in features]].to_numpy(float) for kind in ("c", "lo", "hi"))

    def bounds(self, q: np.ndarray, metric: str = "euclidean") -> np.ndarray:
        """A value not above the squared nan-euclidean distance from each query to each point; inf if none compares.

        A feature that only some points of a cell have may or may not count, so the mean over the features they all have
        is taken together with any number of the smallest others.
        """
        out = np.empty((len(q), len(self.n)))
        step = max(1, 2_000_000 // max(1, self.counts.size))
        for at in range(0, len(q), step):
            out[at:at + step] = self._bounds(q[at:at + step], metric)
        return out

    def _bounds(self, q: np.ndarray, metric: str) -> np.ndarray:
        every = q.shape[1]
        total, used = np.zeros((len(q), len(self.n))), np.zeros((len(q), len(self.n)))
        largest, compares = np.zeros_like(total), np.zeros(total.shape, bool)
        loose = []
        for j in range(every):
            with np.errstate(invalid="ignore"):
                gap = np.maximum(np.maximum(self.low[None, :, j] - q[:, j, None], q[:, j, None] - self.high[None, :, j]), 0) ** 2
            there = ~np.isnan(q[:, j, None]) & (self.counts[:, j] > 0)[None, :]
            always = there & (self.counts[:, j] == self.n)[None, :]
            if metric == "max":
                np.maximum(largest, np.where(always, np.sqrt(gap), 0), out=largest)
                compares |= there
                continue
            total += np.where(always, gap, 0)
            used += always
            if (some := there & ~always).any():
                loose.append(np.where(some, gap, np.inf))
        if metric == "max":
            return np.where(compares, largest, np.inf) * (1 - 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            best = np.where(used > 0, total * every / used, np.inf)
            if loose:
                for k, gap in enumerate(np.sort(np.stack(loose), 0), 1):
                    total = total + gap
                    best = np.minimum(best, np.where(np.isfinite(total), total * every / (used + k), np.inf))
        return best * (1 - 1e-12)
