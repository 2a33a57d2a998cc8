"""Nearest-neighbour estimators of mutual information, without pairs and without a column in one task.

The distance of a value to its k-th nearest value of the same class is read off its 2k neighbours in sorted order: rows
lie in range partitions, and each partition also gets the k rows before and after it. How many values of the whole column
lie within that distance comes from running counts: the two ends of every interval are sorted in between the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabprep.functions.columns import col, number
from tabprep.functions.math import digamma, digamma_value
from tabprep.functions.moments import profile
from tabprep.functions.neighbours import nearest
from tabprep.functions.running import bucketed
from tabprep.sources.storage import stored

#: An interval ends this much (relatively) before the k-th neighbour, which itself must not count, however it is rounded.
SHRINK = 1e-9


def _indexed(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``bucket`` and 0-based place ``g`` in the order of all rows, and the first and last place of each
    bucket. Equal rows stand in an arbitrary, fixed order."""
    spread, by = bucketed(df, order)
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*by)) - 1
    placed = stored(spread.withColumn("__place", place.cast("bigint")), "placed")
    # one row per bucket
    ends = F.sum("n").over(Window.orderBy("__bucket"))
    buckets = stored(placed.groupBy("__bucket").agg(F.count("*").alias("n"))
                     .select("__bucket", (ends - F.col("n")).alias("start"), ends.alias("end")), "bucket-ends")
    return placed.join(buckets, "__bucket").withColumn("g", F.col("start") + F.col("__place")).drop("__place"), buckets


def _with_halo(rows: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """All rows, and copies (``halo``) of the k rows before and after each bucket with that bucket's number.

    A row lies in the halo of every bucket whose first or last place is at most k away, also beyond buckets that are
    shorter than k; only rows within k of their own bucket's ends can.
    """
    near = rows.where((F.col("g") - F.col("start") < k) | (F.col("end") - F.col("g") <= k)).drop("__bucket", "start", "end")
    names = [c for c in rows.columns if c not in ("__bucket", "start", "end")]
    before = near.withColumn("__at", F.explode(F.sequence(F.col("g") + 1, F.col("g") + k)))
    after = near.withColumn("__at", F.explode(F.sequence(F.col("g") - (k - 1), F.col("g"))))
    out = rows.select("__bucket", *names, F.lit(False).alias("halo"))
    for side, end in ((before, "start"), (after, "end")):
        border = buckets.select("__bucket", F.col(end).alias("__at"))
        out = out.union(side.join(border, "__at").select("__bucket", *names, F.lit(True).alias("halo")))
    return out


def class_radii(long: DataFrame, k: int) -> DataFrame:
    """``f, x, r`` of ``long`` rows (f, y, x): distance to the k-th nearest x of the same f and y, or to the farthest if
    the class has fewer. Rows that are alone in their class are left out."""
    rows, buckets = _indexed(long, ["f", "y", "x"])
    window = Window.partitionBy("__bucket").orderBy("g")
    steps = [getter(F.struct("f", "y", "x"), j).over(window) for j in range(1, k + 1) for getter in (F.lag, F.lead)]
    seen = _with_halo(rows, buckets, k).withColumn("near", F.array(*steps)).where(~F.col("halo"))
    same = F.filter("near", lambda s: s.isNotNull() & (s["f"] == F.col("f")) & s["y"].eqNullSafe(F.col("y")))
    far = F.array_sort(F.transform(same, lambda s: F.abs(s["x"] - F.col("x"))))
    return (seen.withColumn("far", far).where(F.size("far") > 0)
            .select("f", "x", F.element_at("far", F.least(F.lit(k), F.size("far"))).alias("r")))


def counts_within(points: DataFrame) -> DataFrame:
    """``f, i, m``: how many x of the same f lie within s of the x of each row (f, i, x, s), itself included."""
    low, high = (F.col("x") + sign * F.col("s") for sign in (-1, 1))
    ends = points.select("f", F.inline(F.array(
        F.struct(low.alias("v"), F.lit(0).alias("kind"), F.col("i").alias("i")),
        F.struct(F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("i")),
        F.struct(high.alias("v"), F.lit(2).alias("kind"), F.col("i").alias("i")))))
    spread, by = bucketed(ends, ["f", "v", "kind"])
    is_value = (F.col("kind") == 1).cast("bigint")
    # all values up to an end, equal ones before an upper end and after a lower one
    inside = F.sum(is_value).over(Window.partitionBy("__bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    totals = spread.groupBy("__bucket").agg(F.sum(is_value).alias("n"))
    earlier = totals.select("__bucket", (F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).alias("earlier"))
    counted = spread.withColumn("c", inside).where("kind <> 1").join(earlier, "__bucket")
    up_to = (F.col("c") + F.col("earlier")) * F.when(F.col("kind") == 2, 1).otherwise(-1)
    return counted.groupBy("f", "i").agg(F.sum(up_to).alias("m"))


def _shrunk(r: Column) -> Column:
    return (r * (1 - SHRINK)).alias("s")


def mutual_information_with_classes(df: DataFrame, columns: Sequence[str], target: str, k: int = 3) -> dict[str, float]:
    """Mutual information (nats) between each numeric column and a discrete target of any number of classes.

    digamma(N) + mean digamma(k) - mean digamma(class size) - mean digamma(m), where m counts the values of the whole
    column nearer than the k-th neighbour inside the class, the value itself included; with fewer than k others in the
    class, the farthest. Classes of one row take no part. Rows with a missing value in the column or target are left out.
    Never below 0; 0 for a column without values.
    """
    long = stored(df.select(col(target).alias("y"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("f"), number(c).alias("x")) for i, c in enumerate(columns)])))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("f", "y", "x"), "columns")
    n = F.col("n")
    sizes = (long.groupBy("f", "y").agg(F.count("*").alias("n")).where("n > 1").groupBy("f").agg(
        F.sum("n").alias("all"), F.sum(n * (digamma(F.least(F.lit(k), n - 1)) - digamma(n))).alias("part")).collect())
    points = stored(class_radii(long, k).select("f", "x", F.monotonically_increasing_id().alias("i"), _shrunk(F.col("r"))), "radii")
    means = {r["f"]: r["mean"] for r in counts_within(points).groupBy("f").agg(F.avg(digamma(F.col("m"))).alias("mean")).collect()}
    out = dict.fromkeys(columns, 0.0)
    for r in sizes:  # one row per column
        whole = digamma_value(r["all"]) + r["part"] / r["all"] - means[r["f"]]
        out[columns[r["f"]]] = max(0.0, whole)
    return out


def mutual_information_with_numbers(df: DataFrame, columns: Sequence[str], target: str, k: int = 3,
                                    plan: str = "auto") -> dict[str, float]:
    """Mutual information (nats) between each numeric column and a continuous target.

    Both are divided by their population standard deviation. digamma(N) + digamma(k) - mean digamma(a) - mean digamma(b),
    where a and b count the values of the column and of the target nearer than the k-th neighbour in the plane, where the
    larger of both differences is the distance. Rows with a missing value in the column or target are left out. Never
    below 0; 0 if either is constant or fewer than k + 1 rows are left.
    """
    out = dict.fromkeys(columns, 0.0)
    for c in columns:
        both = df.select(number(c).alias("x"), number(target).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
        seen = profile(both, ["x", "y"], ["n", "std_pop"])
        n, spread = seen["x"]["n"], [seen[v]["std_pop"] for v in ("x", "y")]
        if n <= k or not all(spread):
            continue
        plane = stored(both.select(F.monotonically_increasing_id().alias("id"), (F.col("x") / F.lit(spread[0])).alias("x"),
                                   (F.col("y") / F.lit(spread[1])).alias("y")), "plane")
        # a point is its own first neighbour, or one that equals it
        pairs = nearest(plane, plane.withColumn("payload", F.lit(1)), ["x", "y"], k + 1, plan=plan, metric="max")
        radii = pairs.groupBy("id").agg(_shrunk(F.max("dist2")))
        near = stored(plane.join(radii, "id").select("s", F.col("id").alias("i"), F.inline(F.array(
            F.struct(F.lit(0).alias("f"), F.col("x").alias("x")), F.struct(F.lit(1).alias("f"), F.col("y").alias("x"))))), "intervals")
        both_means = counts_within(near).agg(F.sum(digamma(F.col("m")))).first()[0] / n
        out[c] = max(0.0, digamma_value(n) + digamma_value(k) - both_means)
    return out

