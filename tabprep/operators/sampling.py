"""Splits, samples, class weights and synthetic minority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.functions.columns import as_double, col, free_name, numeric_columns, present
from tabprep.functions.hashing import hash_number, mark_lowest
from tabprep.functions.joins import salted_join
from tabprep.functions.neighbours import nearest
from tabprep.functions.selection import order_text, value_at
from tabprep.sources.storage import stored

#: synthetic rows that one task makes at a time from one row
COPIES_PER_BLOCK = 10_000


def stratified_split(df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = 42,
                     name: str = "split") -> DataFrame:
    """Add ``split`` = test / train with the rounded share of every class in test.

    Rows of a class are taken in the order of the seeded hash of the key. The cuts of all classes are one table, joined
    with salted keys, so neither the number of classes nor the size of one has a limit. Rows without a class are train.
    """
    mark = free_name("__test", df.columns)
    marked = mark_lowest(df, key, seed, lambda n: F.floor(n * F.lit(test_size) + 0.5), mark, target)
    return marked.select(*[col(c) for c in df.columns], F.when(col(mark), "test").otherwise("train").alias(name))


def split_head(df: DataFrame, cutoff: int, order: str, tie: str | None = None,
               name: str = "split") -> DataFrame:
    """Add ``split`` = head for the first ``cutoff`` rows in the given order, else tail.

    ``tie`` must be unique among rows of equal ``order``; without it all rows that equal the last one are head. Values are
    compared in their own type, whatever it is. Rows with a missing ``order`` are tail.
    """
    if cutoff <= 0:
        return df.withColumn(name, F.lit("tail"))
    cut = value_at(df, order, cutoff - 1)
    if cut is None:
        return df.withColumn(name, F.when(present(df, order).isNotNull(), "head").otherwise("tail"))
    k = free_name("__order", df.columns)
    keyed = df.withColumn(k, order_text(df, order))
    head = col(k) <= F.lit(cut[0])
    if tie is not None and cut[1] + 1 < cut[2]:
        t = free_name("__tie", keyed.columns)
        keyed = keyed.withColumn(t, order_text(df, tie))
        last = value_at(df.withColumn(k, order_text(df, order)).where(col(k) == F.lit(cut[0])), tie, cut[1])
        head = (col(k) < F.lit(cut[0])) | ((col(k) == F.lit(cut[0])) & (col(t) <= F.lit(last[0])))
    return keyed.select(*[col(c) for c in df.columns], F.when(head, "head").otherwise("tail").alias(name))


def sample_rows(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """``n`` rows, those with the smallest seeded hash of the key; one comparison per row, whatever n is."""
    mark = free_name("__sampled", df.columns)
    return mark_lowest(df, key, seed, lambda _: n, mark).where(col(mark)).drop(mark)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``class, n, weight`` with weight = rows / (classes * rows of the class), for any number of classes."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n"), F.count("*")).first()
    weight = F.lit(float(whole[0] or 0)) / (F.lit(float(whole[1])) * F.col("n"))
    return counts.withColumn("weight", weight)


def with_class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class; rows without a class get none."""
    weights = class_weights(df, target).select(F.col("class").alias("__class"), F.col("weight").alias(name))
    return salted_join(df, weights, [target], ["__class"])


def smote(df: DataFrame, target: str, minority, key: str, features: Sequence[str] | None = None,
          k: int = 5, seed: int = 42) -> DataFrame:
    """The table with synthetic minority rows added until the class is as frequent as the most
    frequent one.

    A synthetic row lies between a minority row and one of its ``k`` nearest minority rows. Which
    neighbour and where between them comes from hashes of the key and the copy number. Every
    minority row serves equally often; the remainder goes to the rows with the smallest hashes.
    Output columns: features (double), target, ``synthetic`` 0/1.
    """
    names = list(features) if features is not None else numeric_columns(df, [key, target])
    sizes = df.groupBy(col(target).alias("c")).agg(F.count("*").alias("n")).agg(
        F.sum(F.when(F.col("c") == minority, F.col("n"))).alias("few"), F.max("n").alias("most")).first()
    few, most = sizes["few"] or 0, sizes["most"] or 0
    real = df.select(*[as_double(c).alias(c) for c in names], col(target), F.lit(0).alias("synthetic"))
    if few < 2 or few == most:
        return real
    each, extra = divmod(most - few, few)
    own = df.where(col(target) == minority)
    more = free_name("__more", own.columns)
    points = stored(mark_lowest(own, key, seed, lambda _: extra, more).select(
        col(key).alias("id"), *[as_double(c).alias(f"f{i}") for i, c in enumerate(names)],
        (F.lit(each) + col(more).cast("int")).alias("copies")), "minority")
    fs = [f"f{i}" for i in range(len(names))]
    used = min(k, few - 1)
    pairs = nearest(points.select("id", *fs),
                    points.select("id", *fs, F.col("id").alias("payload")), fs, used + 1)
    others = (pairs.where(F.col("id") != F.col("donor"))
              .groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist2", "donor"))), 1, used)
                                .alias("near")))
    copy = F.concat_ws("#", F.col("id").cast("string"), F.col("copy").cast("string"))
    choice = (hash_number(copy, f"{seed}n") % F.lit(float(used))).cast("int") + 1
    gap = hash_number(copy, f"{seed}g") / F.lit(float(16 ** 13))
    # copies in blocks that are dealt over all tasks, so a row with very many copies is no single task's work
    last = F.col("copies") - 1
    blocks = (points.join(others, "id").where(F.col("copies") > 0)
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {COPIES_PER_BLOCK}")))))
    first = F.col("block") * COPIES_PER_BLOCK
    drawn = (blocks.repartition("id", "block")
             .withColumn("copy", F.explode(F.sequence(first, F.least(last, first + (COPIES_PER_BLOCK - 1)))))
             .select(*fs, gap.alias("u"), F.element_at("near", choice)["donor"].alias("donor")))
    ends = points.select(F.col("id").alias("__donor"), *[F.col(f).alias(f"{f}_to") for f in fs])
    made = salted_join(drawn, ends, ["donor"], ["__donor"], "inner").select(
        *[(F.col(f) + F.col("u") * (F.col(f"{f}_to") - F.col(f))).alias(c)
          for f, c in zip(fs, names, strict=True)],
        F.lit(minority).cast(df.schema[target].dataType).alias(target), F.lit(1).alias("synthetic"))
    return real.union(made)

