"""Profiles and the aggregated data behind the usual plots."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.columns import (
    as_double, col, is_numeric, number, numeric_columns, small_table, text_columns)
from tabprep.functions.joins import salted_join
from tabprep.functions.moments import correlation, profile
from tabprep.functions.order_stats import quantiles
from tabprep.functions.selection import quantile_table

QUARTILES = (0.25, 0.5, 0.75)
MAX_PIVOT = 1_000


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, std, min, quartiles, max."""
    names = numeric_columns(df) if columns is None else list(columns)
    seen = profile(df, names, ["n", "mean", "std", "min", "max"])
    quarts = quantiles(df, names, QUARTILES, seen)
    doubles = {"mean": "mean", "std": "std", "min": "min"}
    data = {"column": pa.array(names, pa.string()),
            "count": pa.array([seen[c]["n"] for c in names], pa.int64())}
    data |= {k: pa.array([seen[c][v] for c in names], pa.float64()) for k, v in doubles.items()}
    data |= {f"q{int(p * 100)}": pa.array([quarts[c][i] for c in names], pa.float64())
             for i, p in enumerate(QUARTILES)}
    data["max"] = pa.array([seen[c]["max"] for c in names], pa.float64())
    return small_table(df.sparkSession, data)


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: count, distinct values, the most frequent value (smallest on ties)
    and how often it occurs."""
    names = text_columns(df) if columns is None else list(columns)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in names])))
    counts = long.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count("*").alias("n"))
    return (counts.groupBy("column")
            .agg(F.sum("n").alias("count"), F.count("*").alias("unique"),
                 F.min(F.struct(-F.col("n"), F.col("v"))).alias("best"))
            .select("column", "count", "unique", F.col("best.v").alias("top"),
                    (-F.col("best.col1")).alias("freq")))


def describe_all(df: DataFrame) -> DataFrame:
    """Numeric and text columns in one report; measures that do not apply are NULL."""
    return describe_numeric(df).unionByName(describe_text(df), allowMissingColumns=True)


def compare_profiles(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Raw and processed numeric profiles side by side, by column."""
    a, b = describe_numeric(raw), describe_numeric(processed)
    left = a.select("column", *[F.col(c).alias(f"raw_{c}") for c in a.columns[1:]])
    right = b.select("column", *[F.col(c).alias(f"processed_{c}") for c in b.columns[1:]])
    return left.join(right, "column", "full")


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Non-null values with counts, most frequent first."""
    return (df.where(col(c).isNotNull()).groupBy(col(c)).agg(F.count("*").alias("count"))
            .orderBy(F.col("count").desc(), col(c)))


def value_percent(df: DataFrame, c: str) -> DataFrame:
    """Value counts with the share of all non-null rows in percent, two decimals."""
    total = df.agg(F.count(col(c))).first()[0]
    share = F.round(F.col("count") * F.lit(100.0) / F.lit(float(total or 1)), 2)
    return value_counts(df, c).withColumn("percent", share)


def histogram(df: DataFrame, c: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with counts; the last bin is closed on both sides, empty bins are kept."""
    seen = profile(df, [c], ["min", "max"])[c]
    lo = seen["min"] if seen["min"] is not None else 0.0
    width = ((seen["max"] if seen["max"] is not None else 0.0) - lo) / bins
    spot = F.least(F.lit(bins - 1), F.floor((as_double(c) - F.lit(lo)) / F.lit(width or 1.0)).cast("int"))
    counts = (df.where(col(c).isNotNull()).groupBy(spot.alias("bin")).agg(F.count("*").alias("n")))
    axis = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), (F.lit(lo) + F.col("id") * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("bin_end"))
    # the counts have at most ``bins`` rows
    return (axis.join(F.broadcast(counts), "bin", "left")
            .select("bin", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
            .orderBy("bin"))


def box_stats(df: DataFrame, c: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (the farthest values within 1.5 interquartile ranges) and outlier count, over the table or per
    category. There may be any number of categories of any size: quartiles come from the distributed search as a table,
    which is joined with salted keys, and whiskers from a combinable aggregate."""
    group = F.lit("all") if by is None else col(by)
    source = df if by is None else df.where(col(by).isNotNull())
    if by is None:
        seen = profile(df, [c], ["n", "min", "max"])
        quarts = quantiles(df, [c], QUARTILES, seen)[c]
        found = df.sparkSession.range(1 if seen[c]["n"] else 0).select(
            F.struct(group.alias("category")).alias("g"), F.lit(seen[c]["n"]).cast("bigint").alias("n"),
            *[F.lit(q).cast("double").alias(f"q{i}") for i, q in enumerate(quarts)])
    else:
        found = quantile_table(source, c, [group.alias("category")], QUARTILES)
    reach = (F.col("q2") - F.col("q0")) * 1.5
    fences = found.select(
        F.col("g.category").alias("__group"), F.col("n").alias("__n"), F.col("q0").alias("__q1"), F.col("q1").alias("__q2"),
        F.col("q2").alias("__q3"), (F.col("q0") - reach).alias("__lo"), (F.col("q2") + reach).alias("__hi"))
    rows = source.select(group.alias("category"), number(c).alias("x")).where(F.col("x").isNotNull())
    joined = salted_join(rows, fences, ["category"], ["__group"], "inner")
    inside = (F.col("x") >= F.col("__lo")) & (F.col("x") <= F.col("__hi"))
    return joined.groupBy("category", F.col("__n").alias("n"), F.col("__q1").alias("q1"), F.col("__q2").alias("median"),
                          F.col("__q3").alias("q3")).agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"))


def pair_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of two columns, three decimals."""
    return df.agg(F.round(correlation(as_double(a), as_double(b)), 3).alias("corr"))


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by ``a`` and ``b`` in long form, for any number of values on both sides."""
    return df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a), col(b)).agg(F.count("*").alias("count"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by ``a`` (rows) and ``b`` (one column per value, MAX_PIVOT of them; see ``crosstab_counts`` for more)."""
    found = df.where(col(b).isNotNull()).select(col(b)).distinct().limit(MAX_PIVOT + 1).collect()
    if len(found) > MAX_PIVOT:
        raise ValueError(f"column {b!r} has more than {MAX_PIVOT} values")
    values = sorted(r[0] for r in found)
    return (df.where(col(a).isNotNull()).groupBy(col(a)).pivot(b, values).agg(F.count(F.lit(1)))
            .na.fill(0, [str(v) for v in values]))


def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, and the column names by type family, on one row."""
    numbers = [f.name for f in df.schema if is_numeric(f.dataType)]
    others = [c for c in df.columns if c not in numbers]
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        F.lit(", ".join(numbers)).alias("numeric_columns"),
        F.lit(", ".join(others)).alias("other_columns"))
