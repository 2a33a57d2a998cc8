"""Categorical encoders: label, ordinal, one-hot, dummies, frequency, target, clusters, bins."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabprep.base import Fitted, Step, read_side_table, write_side_table
from tabprep.functions.columns import (
    as_double, col, free_name, lookup, non_numeric_columns, replace_columns, small_table)
from tabprep.functions.joins import salted_join
from tabprep.functions.order_stats import quantiles
from tabprep.sources.storage import stored

#: category tables up to this many rows and bytes are held as parameters and broadcast
MAX_PARAMETER_ROWS = 200_000
MAX_PARAMETER_BYTES = 8 << 20
MAX_KEY_BYTES = 256
#: one-hot output columns per source column; more categories become one sparse vector column
MAX_ONE_HOT = 1_000
HIGH_CARDINALITY = ("frequency", "clustering", "target", "none")
UNKNOWN = ("ignore", "error", "impute")
NULL_CLASS = "nan"


def text(c: str) -> Column:
    return col(c).cast("string")


def category_counts(df: DataFrame, c: str) -> DataFrame:
    """``key, n`` of the non-null values, combined before the shuffle."""
    return (df.where(col(c).isNotNull()).groupBy(text(c).alias("key"))
            .agg(F.count("*").alias("n")))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(*[F.count_distinct(col(c)) for c in columns]).first()
    return dict(zip(columns, row, strict=True))


def sorted_categories(df: DataFrame, c: str, limit: int) -> list[str]:
    rows = df.where(col(c).isNotNull()).select(text(c).alias("key")).distinct().limit(limit + 1)
    found = sorted(r["key"] for r in rows.collect())
    if len(found) > limit:
        raise ValueError(f"column {c!r} has more than {limit} categories")
    return found


def listed_categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values of columns that are known to have few, from one scan."""
    if not columns:
        return {}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), text(c).alias("v")) for i, c in enumerate(columns)])))
    rows = long.where(F.col("v").isNotNull()).distinct().collect()
    return {c: sorted(r["v"] for r in rows if r["c"] == i) for i, c in enumerate(columns)}


def numbered(categories: DataFrame) -> DataFrame:
    """``key, code`` with the 0-based rank of each distinct key.

    The keys are range-partitioned and the partition of each key is written down with it, so
    that the rank inside the partition and the offset before it always belong together.
    """
    spread = categories.select("key").repartitionByRange("key")
    fixed = stored(spread.withColumn("part", F.spark_partition_id()), "keys")
    sizes = sorted((r["part"], r["n"]) for r in
                   fixed.groupBy("part").agg(F.count("*").alias("n")).collect())
    offsets, total = {}, 0
    for part, n in sizes:
        offsets[part], total = total, total + n
    table = small_table(categories.sparkSession, {
        "part": pa.array(list(offsets), pa.int32()),
        "offset": pa.array(list(offsets.values()), pa.int64())})
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return (fixed.join(F.broadcast(table), "part")
            .select("key", (rank + F.col("offset")).cast("double").alias("value")))


@dataclass
class CategoryMap:
    """Category -> number, as parameters if few and short, else as a side table that is saved with the step."""

    values: dict = field(default_factory=dict)
    table: str | None = None

    @staticmethod
    def learn(table: DataFrame) -> CategoryMap:
        """From a ``key, value`` DataFrame."""
        rows = table.select("key", F.col("value").cast("double").alias("value"))
        # a long key comes as NULL, so what reaches the driver is bounded in bytes as well
        few = rows.select(F.when(F.octet_length("key") <= MAX_KEY_BYTES, F.col("key")).alias("key"), "value") \
            .limit(MAX_PARAMETER_ROWS + 1).toArrow()
        if few.num_rows <= MAX_PARAMETER_ROWS and not few["key"].null_count and few.nbytes <= MAX_PARAMETER_BYTES:
            return CategoryMap(dict(zip(few["key"].to_pylist(), few["value"].to_pylist(), strict=True)))
        return CategoryMap(table=write_side_table(rows, "categories"))

    def add(self, df: DataFrame, source: Column, out: str) -> DataFrame:
        if self.table is None:
            return lookup(df, source, self.values, out)
        table = read_side_table(df.sparkSession, self.table)
        return salted_join(df, table.select(F.col("key").alias("__key"), F.col("value").alias(out)), [source], ["__key"])


def category_codes(df: DataFrame, c: str, out: str) -> DataFrame:
    """Add the 0-based rank of the value among the sorted distinct values."""
    return CategoryMap.learn(numbered(category_counts(df, c))).add(df, text(c), out)


def category_summary(df: DataFrame, columns: Sequence[str] | None = None, first: int = 5) -> DataFrame:
    """Distinct count and the first few values in sorted order, per column."""
    names = non_numeric_columns(df) if columns is None else list(columns)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), text(c).alias("v")) for c in names])))
    values = long.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.lit(1).alias("one"))
    ranked = values.withColumn(
        "r", F.row_number().over(Window.partitionBy("column").orderBy("v")))
    shown = (ranked.where(F.col("r") <= first).groupBy("column")
             .agg(F.array_sort(F.collect_list("v")).alias("l"))
             .select("column", F.array_join("l", ", ").alias("first_values")))
    counts = values.groupBy("column").agg(F.count("*").alias("unique_values"))
    # one row per profiled column on both sides
    return counts.join(F.broadcast(shown), "column")


@dataclass
class CategoryVector:
    """Category -> sparse 0/1 vector, from an index table of any size that is joined by key.

    ``nulls`` gives NULL the last place; otherwise, like an unseen category, it is all zeros. Places below ``first`` are
    left out.
    """

    index: CategoryMap
    size: int
    nulls: bool = False
    first: int = 0

    @staticmethod
    def learn(df: DataFrame, c: str, nulls: bool = False, first: int = 0) -> CategoryVector:
        table = numbered(category_counts(df, c))
        return CategoryVector(CategoryMap.learn(table), table.count() + int(nulls), nulls, first)

    def add(self, df: DataFrame, c: str, out: str, check: Callable[[Column], Column] = lambda code: code) -> DataFrame:
        """``df`` with the vector ``out``; ``check`` may raise on the place of a row (NULL if it has none)."""
        place = free_name("__place", df.columns)
        coded = self.index.add(df, text(c), place)
        width = max(self.size - self.first, 1)
        if self.nulls:
            coded = coded.withColumn(place, F.when(col(c).isNull(), F.lit(float(self.size - 1))).otherwise(col(place)))
        moved = (check(col(place)) - F.lit(float(self.first))).cast("int")
        # the vector by its parts: the encoder of Spark ML holds a name for each place, several times, on the driver. A
        # struct cannot be cast to a vector, but JSON text is read as one
        one = F.array_compact(F.array(F.when((moved >= 0) & (moved < width), moved)))
        parts = F.struct(F.lit(0).alias("type"), F.lit(width).alias("size"), one.alias("indices"),
                         F.transform(one, lambda _: F.lit(1.0)).alias("values"))
        read = F.from_json(F.to_json(F.struct(parts.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))
        return coded.withColumn(out, read["v"].alias(out, metadata={"ml_attr": {"num_attrs": width}})).drop(place)


def encode_dummies(df: DataFrame, c: str, drop_first: bool = True) -> DataFrame:
    """0/1 columns per category but the first; NULL gives zeros; appended last.

    A column with more than MAX_ONE_HOT categories gives one sparse vector ``{c}_dummies`` instead.
    """
    if distinct_counts(df, [c])[c] > MAX_ONE_HOT:
        vector = CategoryVector.learn(df, c, first=int(drop_first))
        return vector.add(df, c, f"{c}_dummies").drop(col(c))
    found = sorted_categories(df, c, MAX_ONE_HOT)
    marks = [F.coalesce(text(c) == v, F.lit(False)).cast("int").alias(f"{c}_{v}")
             for v in found[1 if drop_first else 0:]]
    return df.select(*[col(x) for x in df.columns if x != c], *marks)


@dataclass
class FittedFrequency(Fitted):
    """Relative frequency of each category; unseen ones give NULL."""

    column: str
    shares: CategoryMap

    @classmethod
    def restore(cls, params: dict) -> FittedFrequency:
        return cls(params["column"], CategoryMap(**params["shares"]))

    @property
    def costly(self) -> bool:
        return self.shares.table is not None

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.shares.add(df, text(self.column), "__f")
        return out.select(*[F.col("__f").alias(c) if c == self.column else col(c) for c in df.columns])


def fit_frequency(df: DataFrame, c: str) -> FittedFrequency:
    total = df.agg(F.count(col(c))).first()[0]
    shares = category_counts(df, c).select("key", (F.col("n") / F.lit(float(total))).alias("value"))
    return FittedFrequency(c, CategoryMap.learn(shares))


@dataclass
class FittedQuantileBins(Fitted):
    """Left-closed quantile bins of numeric columns."""

    edges: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, edges in self.edges.items():
            if c in df.columns:
                above = F.lit(0.0)
                for e in edges[1:-1]:
                    above = above + (as_double(c) >= F.lit(e)).cast("double")
                new[c] = above
        return replace_columns(df, new)


@dataclass
class QuantileBinEncoder(Step):
    columns: Sequence[str]
    bins: int = 10

    def fit(self, df: DataFrame, target: str | None = None) -> FittedQuantileBins:
        counts = distinct_counts(df, self.columns)
        out = {}
        for bins in sorted({min(self.bins, n) for n in counts.values() if n}):
            names = [c for c in self.columns if counts[c] and min(self.bins, counts[c]) == bins]
            for c, q in quantiles(df, names, [i / bins for i in range(bins + 1)]).items():
                # bins of (nearly) no width are removed
                out[c] = [q[0], *[b for a, b in zip(q, q[1:], strict=False) if b - a > 1e-8]]
        return FittedQuantileBins(out)


@dataclass
class FittedEncoder(Fitted):
    """Encoding kind and learned categories per column."""

    kinds: dict = field(default_factory=dict)
    classes: dict = field(default_factory=dict)
    maps: dict = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)
    handle_unknown: str = "ignore"
    unknown_value: float = -1
    cardinality: dict = field(default_factory=dict)
    one_hot_last: bool = False
    vectors: dict = field(default_factory=dict)

    @classmethod
    def restore(cls, params: dict) -> FittedEncoder:
        maps = {c: CategoryMap(**m) for c, m in params["maps"].items()}
        vectors = {c: CategoryVector(**{**v, "index": CategoryMap(**v["index"])}) for c, v in params["vectors"].items()}
        return cls(**{**params, "maps": maps, "vectors": vectors})

    @property
    def costly(self) -> bool:
        return any(m.table is not None for m in [*self.maps.values(), *(v.index for v in self.vectors.values())])

    def of_kind(self, kind: str) -> list[str]:
        return [c for c, k in self.kinds.items() if k == kind]

    def _unknown(self, c: str, code: Column, value: Column, known: Column, impute: bool) -> Column:
        """Value for categories not seen in fit, by policy."""
        if self.handle_unknown == "error":
            fault = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "),
                                           F.coalesce(value, F.lit("NULL"))))
            return F.when(known, code).otherwise(fault.cast("double"))
        return F.when(known, code).otherwise(
            F.lit(float(self.unknown_value)) if impute else F.lit(None).cast("double"))

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        have = set(df.columns)
        new: dict[str, Column] = {}
        for c in self.of_kind("binary"):
            if c in have:
                value = F.coalesce(text(c), F.lit(NULL_CLASS))
                out = lookup(out, value, self.classes[c], f"__e_{c}")
                code = col(f"__e_{c}")
                new[c] = self._unknown(c, code, value, code.isNotNull(),
                                       self.handle_unknown == "impute").cast("int")
        for c in self.of_kind("ordinal"):
            if c in have and c in self.classes:
                out = lookup(out, text(c), self.classes[c], f"__e_{c}")
                code = F.coalesce(col(f"__e_{c}"), F.lit(float(self.unknown_value)))
                new[c] = F.when(col(c).isNotNull(), code)
        for c in self.maps:
            if c in have:
                out = self.maps[c].add(out, text(c), f"__e_{c}")
                default = self.defaults.get(c)
                new[c] = col(f"__e_{c}") if default is None else F.coalesce(
                    col(f"__e_{c}"), F.lit(default))
                if self.kinds[c] == "ordinal":
                    new[c] = F.when(col(c).isNotNull(), new[c])
        one_hot: dict[str, list[Column]] = {}
        for c in self.of_kind("onehot"):
            if c in have and c in self.vectors:
                out = self.vectors[c].add(out, c, f"__v_{c}", self._known_place(c))
                one_hot[c] = [col(f"__v_{c}").alias(f"{c}_onehot")]
            elif c in have:
                one_hot[c] = self._one_hot(c)
        if not one_hot and not self.of_kind("ordinal"):
            return out.select(*[new.get(c, col(c)).alias(c) for c in df.columns])
        if self.one_hot_last:
            rest = [c for c in df.columns if c not in one_hot]
            return out.select(*[new.get(c, col(c)).alias(c) for c in rest],
                              *[m for c in one_hot for m in one_hot[c]])
        first = [c for c in self.of_kind("ordinal") if c in have]
        rest = [c for c in df.columns if c not in first and c not in one_hot]
        return out.select(*[new[c].alias(c) for c in first],
                          *[m for c in one_hot for m in one_hot[c]],
                          *[new.get(c, col(c)).alias(c) for c in rest])

    def _known_place(self, c: str) -> Callable[[Column], Column]:
        if self.handle_unknown == "ignore":
            return lambda code: code
        fault = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.coalesce(text(c), F.lit("NULL"))))
        return lambda code: F.coalesce(code, fault.cast("double"))

    def _one_hot(self, c: str) -> list[Column]:
        classes = list(self.classes[c])
        value = F.coalesce(text(c), F.lit(NULL_CLASS)) if NULL_CLASS in classes else text(c)
        marks = []
        known = F.coalesce(value.isin(classes), F.lit(False))
        for v in classes:
            mark = F.coalesce(value == v, F.lit(False)).cast("double")
            if self.handle_unknown != "ignore":
                fault = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "),
                                               F.coalesce(value, F.lit("NULL"))))
                mark = F.when(known, mark).otherwise(fault.cast("double"))
            marks.append(mark.alias(f"{c}_{v}"))
        return marks

    def summary(self, df: DataFrame) -> DataFrame:
        """``feature, unique_values, encoding`` per encoded column."""
        return small_table(df.sparkSession, {
            "feature": pa.array(list(self.kinds), pa.string()),
            "unique_values": pa.array([self.cardinality[c] for c in self.kinds], pa.int64()),
            "encoding": pa.array(list(self.kinds.values()), pa.string())})


@dataclass
class CategoricalEncoder(Step):
    """Picks an encoding per non-numeric column: ordinal if a mapping is given, binary with two
    values, high cardinality above ``max_cardinality`` (None: never), else one-hot; explicit choices win.

    ``one_hot`` "columns" makes a 0/1 column ``{column}_{value}`` per category, "vector" one sparse vector column
    ``{column}_onehot`` with the same places, and "auto" columns up to MAX_ONE_HOT categories and a vector beyond.
    """

    column_encoding_strategy: Mapping[str, str] = field(default_factory=dict)
    ordinal_features_map: Mapping[str, Sequence[str] | Mapping[str, float]] = field(default_factory=dict)
    max_cardinality: int | None = 20
    high_cardinality_strategy: str = "frequency"
    handle_unknown: str = "ignore"
    unknown_value: float = -1
    random_state: int = 42
    two_values_are_binary: bool = True
    one_hot_last: bool = False
    one_hot: str = "auto"

    def __post_init__(self):
        if self.max_cardinality is not None and (not isinstance(self.max_cardinality, int) or self.max_cardinality <= 0):
            raise ValueError("the cardinality limit is a whole number above 0, or None")
        if self.high_cardinality_strategy not in HIGH_CARDINALITY:
            raise ValueError(f"many categories: choose from {HIGH_CARDINALITY}")
        if self.one_hot not in ("auto", "columns", "vector"):
            raise ValueError(f"one-hot as {self.one_hot!r} is unknown")
        if self.handle_unknown not in UNKNOWN:
            raise ValueError(f"unknown categories: choose from {UNKNOWN}")

    def detect(self, df: DataFrame, target: str | None = None) -> dict[str, tuple[str, int]]:
        """``{column: (kind, distinct values)}``."""
        return {c: (self._kind(c, n), n) for c, (n, _) in self._counted(df, target).items()}

    def _counted(self, df: DataFrame, target: str | None) -> dict[str, tuple[int, int]]:
        """``{column: (distinct values, NULLs)}``, from one scan."""
        names = non_numeric_columns(df, [target] if target else [])
        row = df.agg(F.lit(0), *[a for c in names for a in (F.count_distinct(col(c)), F.count_if(col(c).isNull()))]).first()
        return {c: (row[1 + 2 * i], row[2 + 2 * i]) for i, c in enumerate(names)}

    def _kind(self, c: str, distinct: int) -> str:
        chosen = self.column_encoding_strategy.get(c)
        if chosen:
            if chosen.lower() not in ("binary", "ordinal", "onehot", "high_cardinality"):
                raise ValueError(f"column {c!r} cannot be encoded as {chosen!r}")
            return chosen.lower()
        if c in self.ordinal_features_map:
            return "ordinal"
        if distinct == 2 and self.two_values_are_binary:
            return "binary"
        limit = self.max_cardinality
        return "high_cardinality" if limit is not None and distinct > limit else "onehot"

    def fit(self, df: DataFrame, target: str | None = None) -> FittedEncoder:
        if self.high_cardinality_strategy == "target" and target is None:
            raise ValueError("target encoding needs a target column")
        counted = self._counted(df, target)
        found = {c: (self._kind(c, n), n) for c, (n, _) in counted.items()}
        kinds = {c: k for c, (k, _) in found.items()}
        classes: dict[str, dict[str, float]] = {}
        listed = [c for c, k in kinds.items() if k in ("binary", "onehot")
                  or (k == "ordinal" and c not in self.ordinal_features_map)]
        maps, defaults, vectors = {}, {}, {}
        as_vector = [c for c in listed if kinds[c] == "onehot" and (
            self.one_hot == "vector" or self.one_hot == "auto" and found[c][1] > MAX_ONE_HOT)]
        columns = [c for c in listed if kinds[c] == "onehot" and c not in as_vector]
        values_of = listed_categories(df, [c for c in listed if c in columns or found[c][1] <= MAX_ONE_HOT and c not in as_vector])
        for c in listed:
            missing = counted[c][1]
            if c in as_vector:
                vectors[c] = CategoryVector.learn(df, c, nulls=bool(missing))
                continue
            if found[c][1] > MAX_ONE_HOT and c not in columns:  # codes in the order of the values, as a table
                maps[c], defaults[c] = CategoryMap.learn(numbered(category_counts(df, c))), float(self.unknown_value)
                continue
            values = values_of[c]
            if missing and kinds[c] == "binary":
                values = sorted([*values, NULL_CLASS])
            elif missing and kinds[c] == "onehot":
                values = [*values, NULL_CLASS]
            classes[c] = {v: float(i) for i, v in enumerate(values)}
        for c in [c for c, k in kinds.items() if k == "ordinal" and c in self.ordinal_features_map]:
            given = self.ordinal_features_map[c]
            classes[c] = ({str(k): float(v) for k, v in given.items()} if isinstance(given, Mapping)
                          else {str(v): float(i) for i, v in enumerate(given)})
        if self.high_cardinality_strategy != "none":
            for c in [c for c, k in kinds.items() if k == "high_cardinality"]:
                maps[c], default = self._high(df, c, target, found[c][1])
                if default is not None:
                    defaults[c] = default
        return FittedEncoder(kinds, classes, maps, defaults, self.handle_unknown, self.unknown_value,
                             {c: n for c, (_, n) in found.items()}, self.one_hot_last, vectors)

    def _high(self, df: DataFrame, c: str, target: str | None,
              distinct: int) -> tuple[CategoryMap, float | None]:
        if self.high_cardinality_strategy == "frequency":
            return fit_frequency(df, c).shares, None
        if self.high_cardinality_strategy == "clustering":
            return cluster_map(df, c, distinct, self.random_state), None
        return target_map(df, c, target, self.unknown_value)


def target_map(df: DataFrame, c: str, target: str, unknown_value: float = -1) -> tuple[CategoryMap, float]:
    """Mean of the target per category; unseen ones get the mean of these means."""
    means = (df.where(col(c).isNotNull()).groupBy(text(c).alias("key"))
             .agg(F.avg(as_double(target)).alias("value")))
    learned = CategoryMap.learn(means)
    overall = means.agg(F.avg("value")).first()[0]
    return learned, float(unknown_value if overall is None else overall)


def cluster_map(df: DataFrame, c: str, distinct: int, seed: int) -> CategoryMap:
    """K-means over the category codes, each weighted with its rows: k = min(10, max(2, sqrt(n)))."""
    k = min(10, max(2, math.isqrt(distinct)))
    counts = category_counts(df, c)
    coded = numbered(counts).join(counts, "key")
    points = VectorAssembler(inputCols=["value"], outputCol="features").transform(coded)
    model = KMeans(k=k, seed=seed, weightCol="n").fit(points.select("features", "n"))
    placed = model.transform(points).select("key", F.col("prediction").alias("value"))
    return CategoryMap.learn(placed)

