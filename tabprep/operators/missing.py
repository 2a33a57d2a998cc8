"""Missing values: profile, column dropping, imputation, flags, reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabprep.base import Fitted, Step, read_side_table, write_side_table
from tabprep.functions.columns import (
    any_of, as_double, col, free_name, number, numeric_columns, present, replace_columns, text_columns)
from tabprep.functions.moments import correlation, measure, profile
from tabprep.functions.neighbours import nearest
from tabprep.functions.order_stats import quantiles
from tabprep.functions.running import bucketed

_MEASURES = ("n", "min", "max", "mean")
BANDS = ("All NaNs", "<5%", "5–30%", ">30%")


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: count and share of missing values, and the band the share falls in."""
    names = df.columns if columns is None else list(columns)
    row = df.agg(F.count("*").alias("n"),
                 *[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(names)])
    n = F.col("n")
    items = []
    for i, c in enumerate(names):
        m = F.col(f"m{i}")
        pct = F.try_divide(m * F.lit(100.0), n)
        band = (F.when((m == n) & (n > 0), BANDS[0]).when(pct < 5, BANDS[1])
                .when(pct <= 30, BANDS[2]).otherwise(BANDS[3]))
        items.append(F.struct(F.lit(c).alias("column"), m.alias("missing_count"),
                              pct.alias("missing_pct"), (m > 0).cast("int").alias("has_missing"),
                              band.alias("band")))
    return row.select(F.inline(F.array(*items)))


def missing_row_flag(df: DataFrame, columns: Sequence[str] | None = None,
                     name: str = "Missing_Flag") -> DataFrame:
    names = df.columns if columns is None else columns
    return df.withColumn(name, any_of([present(df, c).isNull() for c in names]).cast("int"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count("*"), *[F.count(present(df, c)) for c in columns]).first()
    return row[0], {c: row[0] - row[i + 1] for i, c in enumerate(columns)}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest one on ties.

    Value counts are combined before the shuffle, so a hot value is one row per task, and the best
    value per column is again a combinable minimum.
    """
    found: dict[str, object] = {c: None for c in columns}
    by_type: dict[T.DataType, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType, []).append(c)
    for names in by_type.values():
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("c"), present(df, c).alias("v")) for c in names])))
        best = (long.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count("*").alias("n"))
                .groupBy("c").agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("best")))
        found.update({r["c"]: r["best"]["v"] for r in best.collect()})
    return found


@dataclass
class FittedKnn(Fitted):
    """Donors of a table as a side table, and the column means for rows that no donor compares with."""

    columns: list
    features: list
    k: int
    donors: str
    means: dict
    plan: str = "auto"

    @property
    def costly(self) -> bool:
        return True

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill every missing value of the columns; they become doubles.

        Rows with equal features get equal fills, so each combination of features that has a gap is searched once.
        """
        names = [c for c in self.columns if c in df.columns]
        seen = [c for c in self.features if c in df.columns]
        if not names or not seen:
            return df
        spark = df.sparkSession
        f = {c: f"f{i}" for i, c in enumerate(self.features)}
        marks = [F.coalesce(number(c).cast("string"), F.lit("")) for c in seen]
        gap = any_of([number(c).isNull() for c in names])
        key = free_name("__knn_key", df.columns)
        # rows without a gap get keys that match nothing and lie in no single partition
        spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(*[number(c) for c in seen]), F.lit(4_096)).cast("string"))
        keyed = df.withColumn(key, F.when(gap, F.concat_ws(",", *marks)).otherwise(spread))
        lacking = F.filter(F.array(*[F.when(number(c).isNull(), F.lit(self.columns.index(c))) for c in names]),
                           lambda i: i.isNotNull())
        asked = (keyed.where(gap).select(
            F.col(key).alias("id"), lacking.alias("lacks"),
            *[(number(c) if c in seen else F.lit(None).cast("double")).alias(f[c]) for c in self.features])
            .groupBy("id", *f.values()).agg(F.array_distinct(F.flatten(F.collect_set("lacks"))).alias("lacks"))
            .select("id", F.explode("lacks").alias("want"), *f.values()))
        payloads = [f.get(c, f"p{i}") for i, c in enumerate(self.columns)]
        pairs = nearest(asked, read_side_table(spark, self.donors), list(f.values()), self.k, payloads, self.plan)
        fills = (pairs.groupBy("id", "want").agg(F.avg("payload").alias("fill")).groupBy("id").agg(*[
            F.max(F.when(F.col("want") == i, F.col("fill"))).alias(f"__fill{i}") for i in range(len(self.columns))])
            .withColumnRenamed("id", "__filled"))
        new = {c: F.coalesce(number(c), F.col(f"__fill{self.columns.index(c)}"), F.lit(self.means.get(c)).cast("double"))
               for c in names}
        return (keyed.join(fills, col(key) == F.col("__filled"), "left")
                .select(*[new[c].alias(c) if c in new else col(c) for c in df.columns]))


@dataclass
class KnnImputer(Step):
    """Mean of the ``k`` nearest rows that have the value (nan-euclidean over the features) per missing value.

    ``key`` settles equal distances, by the smaller key; without it an arbitrary but fixed order does. The donors are all
    rows of the fitted table that have any of the columns. Rows of any table are filled: a value that is missing is never
    its own donor. A row without any comparable donor gets the column mean. ``plan`` is that of ``neighbours.nearest``.
    """

    columns: Sequence[str] | None = None
    features: Sequence[str] | None = None
    k: int = 5
    key: str | None = None
    plan: str = "auto"

    def fit(self, df: DataFrame, target: str | None = None) -> FittedKnn:
        features = list(self.features) if self.features is not None else numeric_columns(df, [self.key, target])
        columns = list(self.columns) if self.columns is not None else features
        means = {c: m["mean"] for c, m in profile(df, columns, ["mean"]).items()}
        extra = [number(c).alias(f"p{i}") for i, c in enumerate(columns) if c not in features]
        own = F.monotonically_increasing_id() if self.key is None else col(self.key)
        some = any_of([number(c).isNotNull() for c in columns])
        donors = df.where(some).select(own.alias("id"), *[number(c).alias(f"f{i}") for i, c in enumerate(features)], *extra)
        return FittedKnn(columns, features, self.k, write_side_table(donors, "donors"), means, self.plan)


@dataclass
class FittedImputer(Fitted):
    """Fill values, dropped columns and flag columns learned from a table."""

    fills: dict = field(default_factory=dict)
    fractional: list = field(default_factory=list)
    dropped: list = field(default_factory=list)
    flags: list = field(default_factory=list)
    methods: dict = field(default_factory=dict)
    rows: int = 0
    nulls: dict = field(default_factory=dict)
    knn: FittedKnn | None = None

    @classmethod
    def restore(cls, params: dict) -> FittedImputer:
        return cls(**{**params, "knn": FittedKnn(**params["knn"]) if params.get("knn") else None})

    @property
    def costly(self) -> bool:
        return self.knn is not None

    def _filled(self, df: DataFrame, c: str) -> Column:
        value = number(c) if c in self.fractional else present(df, c)
        fill = self.fills.get(c)
        return value if fill is None else F.coalesce(value, F.lit(fill))

    def transform(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        kept = [c for c in df.columns if c not in self.dropped]
        flags = {c: f"{c}_Missing_Flag" for c in self.flags if c in have and f"{c}_Missing_Flag" not in have}
        marked = df.select(*[col(c) for c in kept],
                           *[present(df, c).isNull().cast("int").alias(f) for c, f in flags.items()])
        if self.knn is not None:
            marked = self.knn.transform(marked)
        return marked.select(*[self._filled(marked, c).alias(c) for c in kept], *[col(f) for f in flags.values()])

    def report(self, df: DataFrame) -> DataFrame:
        """Method per column with counts of missing values before and after, from one pass over the data."""
        names = list(self.nulls)
        was = {c: free_name(f"__was_{c}", df.columns) for c in names}
        both = df.select(*[col(c) for c in df.columns], *[present(df, c).isNull().alias(w) for c, w in was.items()])
        if self.knn is not None:
            both = self.knn.transform(both)
        row = both.agg(*[F.count_if(col(was[c])).alias(f"b{i}") for i, c in enumerate(names)],
                       *[F.count_if(self._filled(both, c).isNull()).alias(f"a{i}") for i, c in enumerate(names)])
        items = [F.struct(
            F.lit(c).alias("column"),
            F.lit("dropped" if c in self.dropped else self.methods.get(c, "none")).alias("method"),
            F.col(f"b{i}").alias("missing_before"),
            (F.lit(None).cast("bigint") if c in self.dropped else F.col(f"a{i}")).alias("missing_after"),
            F.lit(int(c in self.flags)).alias("flagged")) for i, c in enumerate(names)]
        return row.select(F.inline(F.array(*items)))


@dataclass
class MissingValueHandler(Step):
    """Learn fills per column: mean, median, most_frequent, constant or knn; drop sparse columns.

    NULL and NaN are both missing. ``knn`` fills the numeric columns that have gaps from the nearest rows over these same
    columns; ``key`` then names rows, see ``KnnImputer``, and is neither filled nor compared.
    """

    numeric_strategy: str = "median"
    categorical_strategy: str = "most_frequent"
    add_missing_flag: bool = True
    drop_high_missing_threshold: float = 0.4
    strictly_above: bool = False
    numeric_fill: float = 0.0
    text_fill: str = "missing_value"
    knn_neighbors: int = 5
    key: str | None = None

    def __post_init__(self):
        if self.numeric_strategy not in ("mean", "median", "most_frequent", "constant", "knn"):
            raise ValueError(f"unknown numeric strategy {self.numeric_strategy!r}")
        if self.categorical_strategy not in ("most_frequent", "constant"):
            raise ValueError(f"unknown categorical strategy {self.categorical_strategy!r}")
        if not 0 <= self.drop_high_missing_threshold <= 1:
            raise ValueError("drop_high_missing_threshold must lie in 0..1")

    def _sparse(self, missing: int, rows: int) -> bool:
        ratio = missing / rows if rows else 0.0
        limit = self.drop_high_missing_threshold
        return ratio == 1 or (ratio > limit if self.strictly_above else ratio >= limit)

    def fit(self, df: DataFrame, target: str | None = None) -> FittedImputer:
        names = [c for c in df.columns if c not in (target, self.key)]
        # one scan for the counts of all columns and the measures of the numeric ones
        all_numbers = [c for c in numeric_columns(df) if c in names]
        row = df.agg(F.count("*"), *[F.count(present(df, c)) for c in names],
                     *[measure(m, number(c)) for c in all_numbers for m in _MEASURES]).first()
        rows, nulls = row[0], {c: row[0] - n for c, n in zip(names, row[1:], strict=False)}
        values = iter(row[1 + len(names):])
        seen = {c: {m: next(values) for m in _MEASURES} for c in all_numbers}
        dropped = [c for c in names if rows and self._sparse(nulls[c], rows)]
        kept = [c for c in names if c not in dropped]
        numbers = [c for c in all_numbers if c in kept]
        texts = [c for c in text_columns(df) if c in kept]
        fills: dict = {}
        if self.numeric_strategy == "mean":
            fills |= {c: seen[c]["mean"] for c in numbers}
        elif self.numeric_strategy == "median":
            fills |= {c: q[0] for c, q in quantiles(df, numbers, [0.5], seen).items()}
        elif self.numeric_strategy == "constant":
            fills |= {c: float(self.numeric_fill) for c in numbers}
        if self.categorical_strategy == "constant":
            fills |= {c: self.text_fill for c in texts
                      if isinstance(df.schema[c].dataType, T.StringType)}
        by_mode = [c for c in numbers if self.numeric_strategy == "most_frequent"]
        by_mode += [c for c in texts if self.categorical_strategy == "most_frequent"]
        if by_mode:
            fills |= modes(df, by_mode)
        gaps, knn = [c for c in numbers if nulls[c]], None
        if self.numeric_strategy == "knn" and gaps:
            knn = KnnImputer(gaps, gaps, self.knn_neighbors, self.key).fit(df)
        methods = {c: self.numeric_strategy for c in numbers if nulls[c]}
        methods |= {c: self.categorical_strategy for c in texts if nulls[c]}
        return FittedImputer(
            fills=fills, dropped=dropped, methods=methods, rows=rows, nulls=nulls,
            fractional=[c for c in numbers if self.numeric_strategy in ("mean", "median", "constant")],
            flags=[c for c in kept if nulls[c]] if self.add_missing_flag else [], knn=knn)


def impute_knn(df: DataFrame, key: str, columns: Sequence[str] | None = None,
               features: Sequence[str] | None = None, k: int = 5, plan: str = "auto") -> DataFrame:
    """Mean of the ``k`` nearest donors (nan-euclidean over all numeric columns) per missing value of this table.

    ``key`` identifies a row and settles equal distances. A row without any comparable donor gets
    the column mean. One exact search serves all columns; see ``KnnImputer``.
    """
    features = list(features) if features is not None else numeric_columns(df, [key])
    rows, nulls = null_counts(df, list(columns) if columns is not None else features)
    gaps = [c for c, n in nulls.items() if 0 < n < rows]
    return KnnImputer(gaps, features, k, key, plan).fit_transform(df) if gaps else df


@dataclass
class FittedKnnVote(Fitted):
    """Donors of a text column as a side table, and the codes by which text features are compared."""

    column: str
    numbers: list
    codes: dict
    k: int
    donors: str
    plan: str = "auto"

    @property
    def costly(self) -> bool:
        return True

    @classmethod
    def restore(cls, params: dict) -> FittedKnnVote:
        from tabprep.operators.encoding import CategoryMap
        return cls(**{**params, "codes": {c: CategoryMap(**m) for c, m in params["codes"].items()}})

    def placed(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """``df`` with its features as doubles under the given names; a text not seen in the fit is a missing feature."""
        out = df
        for c, name in zip([*self.numbers, *self.codes], names, strict=True):
            known = c in df.columns
            if c in self.codes and known:
                out = self.codes[c].add(out, col(c).cast("string"), name)
            else:
                out = out.withColumn(name, number(c) if known else F.lit(None).cast("double"))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill missing values of the column by the most frequent one among the nearest rows, the smallest on ties.

        Rows with equal features get equal fills and are searched once; a row without a comparable donor keeps its gap.
        """
        names = [f"f{i}" for i in range(len(self.numbers) + len(self.codes))]
        own = [free_name(f"__{n}", df.columns) for n in names]
        key, gap = free_name("__vote_key", df.columns), col(self.column).isNull()
        marks = [F.coalesce(col(n).cast("string"), F.lit("")) for n in own]
        spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(*[col(n) for n in own]), F.lit(4_096)).cast("string"))
        keyed = self.placed(df, own).withColumn(key, F.when(gap, F.concat_ws(",", *marks)).otherwise(spread))
        asked = keyed.where(gap).select(col(key).alias("id"), *[col(o).alias(n) for o, n in zip(own, names, strict=True)]).distinct()
        pairs = nearest(asked, read_side_table(df.sparkSession, self.donors), names, self.k, plan=self.plan)
        votes = (pairs.groupBy("id", "payload").agg(F.count("*").alias("n")).groupBy(F.col("id").alias("__voted"))
                 .agg(F.min(F.struct(-F.col("n"), F.col("payload"))).alias("__best")))
        value = F.coalesce(col(self.column), F.col("__best.payload"))
        return (keyed.join(votes, col(key) == F.col("__voted"), "left")
                .select(*[value.alias(c) if c == self.column else col(c) for c in df.columns]))


@dataclass
class KnnVoter(Step):
    """Majority vote of the ``k`` nearest rows that have the text column, per missing value.

    Features are numeric or text columns; a text is placed by its rank among the sorted distinct values of the fitted
    table. ``key`` settles equal distances, as in ``KnnImputer``.
    """

    column: str
    features: Sequence[str]
    k: int = 5
    key: str | None = None
    plan: str = "auto"

    def fit(self, df: DataFrame, target: str | None = None) -> FittedKnnVote:
        from tabprep.operators.encoding import CategoryMap, category_counts, numbered
        numeric = numeric_columns(df)
        numbers = [c for c in self.features if c in numeric]
        codes = {c: CategoryMap.learn(numbered(category_counts(df, c))) for c in self.features if c not in numeric}
        fitted = FittedKnnVote(self.column, numbers, codes, self.k, "", self.plan)
        own = F.monotonically_increasing_id() if self.key is None else col(self.key)
        names = [f"f{i}" for i in range(len(self.features))]
        known = df.where(col(self.column).isNotNull()).withColumn("__donor", own)
        taken = [free_name(f"__{n}", known.columns) for n in names]
        donors = fitted.placed(known, taken).select(
            F.col("__donor").alias("id"), *[col(t).alias(n) for t, n in zip(taken, names, strict=True)],
            col(self.column).alias("payload"))
        fitted.donors = write_side_table(donors, "donors")
        return fitted


def impute_knn_text(df: DataFrame, key: str, column: str, features: Sequence[str],
                    k: int = 5, plan: str = "auto") -> DataFrame:
    """``KnnVoter`` fitted on this table and applied to it; ``key`` identifies a row."""
    return KnnVoter(column, features, k, key, plan).fit_transform(df)


def fill_in_time(df: DataFrame, time_col: str, tie_col: str, columns: Sequence[str] | None = None,
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """Forward fill, then backward fill, in time order over the whole table (or per partition).

    Rows are put in range buckets of bounded size; the last and first known value of each bucket
    are carried over the bucket borders, so neither a long series nor one hot timestamp has to
    fit in a task.
    """
    columns = [c for c in (columns if columns is not None else df.columns)
               if c not in (time_col, tie_col, *partition_by)]
    parts = list(partition_by)
    df = replace_columns(df, {c: present(df, c) for c in columns})
    spread, order = bucketed(df, [time_col, tie_col])
    by = [*parts, "__bucket"]
    before = (Window.partitionBy(*[col(c) for c in by]).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.struct(*[x for c in (time_col, tie_col) for x in (col(c).isNull(), col(c))])  # NULLs last here as well
    ends = spread.groupBy(*[col(c) for c in by]).agg(*[
        f(col(c), F.when(col(c).isNotNull(), place)).alias(f"__{n}{i}")
        for i, c in enumerate(columns) for n, f in (("last", F.max_by), ("first", F.min_by))])
    # one row per partition and bucket: the number of buckets is bounded by ``bucketed``
    over = Window.partitionBy(*[col(c) for c in parts]).orderBy("__bucket")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # rows that a forward fill leaves empty precede every known value of their partition, so what a
    # backward fill gives them is the first known value of the partition
    carried = ends.select(*[col(c) for c in by], *[
        F.last(F.col(f"__last{i}"), True).over(earlier).alias(f"__in{i}")
        for i in range(len(columns))], *[
        F.first(F.col(f"__first{i}"), True).over(whole).alias(f"__start{i}")
        for i in range(len(columns))])
    joined = _null_safe_join(spread, carried, by)
    new = {c: F.coalesce(F.last(col(c), True).over(before), F.col(f"__in{i}"), F.col(f"__start{i}"))
           for i, c in enumerate(columns)}
    return joined.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def _null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    renamed = right.select(*[col(c).alias(f"__by{i}") for i, c in enumerate(by)],
                           *[col(c) for c in right.columns if c not in by])
    on = None
    for i, c in enumerate(by):
        same = col(c).eqNullSafe(F.col(f"__by{i}"))
        on = same if on is None else on & same
    return left.join(renamed, on, "left").drop(*[f"__by{i}" for i in range(len(by))])


@dataclass
class FittedRegression(Fitted):
    column: str
    predictors: list
    coefficients: list
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.predictors:
            return df
        guess = F.lit(self.intercept)
        for c, b in zip(self.predictors, self.coefficients, strict=True):
            guess = guess + F.lit(b) * number(c)
        return replace_columns(df, {self.column: F.coalesce(number(self.column), guess)})


@dataclass
class RegressionImputer(Step):
    """Least squares on the numeric columns whose absolute correlation exceeds the threshold.

    Without such a column, or without a row that has all values, the fitted step has no predictors and changes nothing.
    """

    column: str
    corr_threshold: float = 0.5
    candidates: Sequence[str] | None = None

    def fit(self, df: DataFrame, target: str | None = None) -> FittedRegression:
        names = [c for c in (self.candidates or numeric_columns(df)) if c not in (self.column, target)]
        nothing = FittedRegression(self.column, [], [], 0.0)
        if not names:
            return nothing
        row = df.agg(*[correlation(number(self.column), number(c)) for c in names]).first()
        strong = [c for c, r in zip(names, row, strict=True)
                  if r is not None and abs(r) > self.corr_threshold]
        if not strong:
            return nothing
        return self._solve(df, strong)

    def _solve(self, df: DataFrame, strong: list[str]) -> FittedRegression:
        known = df.where(~any_of([number(c).isNull() for c in [self.column, *strong]]))
        y = number(self.column)
        xs = [number(c) for c in strong]
        d = len(xs)
        # centred sums: covariances are stable where raw sums of squares are not
        aggs = [F.avg(y), *[F.avg(x) for x in xs], *[F.covar_pop(x, y) for x in xs],
                *[F.covar_pop(xs[i], xs[j]) for i in range(d) for j in range(i, d)]]
        row = known.agg(*aggs).first()
        if row[0] is None:
            return FittedRegression(self.column, [], [], 0.0)
        gram = np.zeros((d, d))
        upper = iter(row[1 + 2 * d:])
        for i in range(d):
            for j in range(i, d):
                gram[i, j] = gram[j, i] = next(upper)
        beta = np.linalg.lstsq(gram, np.array(row[1 + d:1 + 2 * d], dtype=float), rcond=None)[0]
        intercept = row[0] - float(beta @ np.array(row[1:1 + d], dtype=float))
        return FittedRegression(self.column, strong, [float(b) for b in beta], intercept)

