"""Order statistics of values of any sortable type, in any number of groups, digit by digit.

A value becomes a text whose byte order is the value's own order, without going through a double: integers, dates and
times as the 16 hexadecimal digits of their shifted number, decimals as all their digits, doubles as their shifted bits,
text as its bytes. A pass counts, for each group, the values by the next digits, finds the digits that hold each wanted
rank from running counts, and keeps only the rows that share them. A prefix that holds one value is settled, so repeated
values end the search at once. Counts, prefixes and results are tables throughout: the driver only asks whether any search
is still open, so the number of groups has no limit. Once no open prefix holds many rows, one pass takes all digits left.
"""

from __future__ import annotations

import os.path
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabprep.functions.columns import col, number
from tabprep.functions.joins import salted_join
from tabprep.sources.storage import discard, stored, stored_at

#: digits of one pass: a group has at most 16 ** DIGITS prefixes at a time
DIGITS = 4
#: rows of a group and prefix up to which all digits left are taken at once, and so rows of one window
FINISH_ROWS = 100_000
_SIGN = -(1 << 63)


def order_text(df: DataFrame, name: str) -> Column:
    """A text that sorts like the column; NULL for NULL and NaN. Select it before aggregating it."""
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, T.DecimalType):
        digits = F.lpad(F.regexp_replace(c.cast("string"), "[-.]", ""), 39, "0")  # abs() rounds to 34 digits
        below = F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"))
        return F.when(c < 0, below).when(c.isNotNull(), F.concat(F.lit("1"), digits))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.concat(F.hex(c), F.lit("!"))  # "!" sorts before all digits, so a prefix comes first
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        plain = number(name) + F.lit(0.0)  # -0.0 equals 0.0
        bits = F.when(plain.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("bigint"))
        whole = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    elif isinstance(kind, T.TimestampType):
        whole = F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c)
        whole = F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + (seconds * 1_000_000).cast("bigint")
    elif isinstance(kind, T.DateType):
        whole = F.unix_date(c).cast("bigint")
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        whole = c.cast("bigint")
    else:
        raise TypeError(f"column {name!r} of type {kind.simpleString()} has no order")
    return F.lpad(F.hex(whole.bitwiseXOR(F.lit(_SIGN))), 16, "0")


def select_ranks(keys: DataFrame, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """``g, rank, k, place, equal``: the key at every wanted 0-based rank of its group.

    ``keys`` has the group ``g`` and the order text ``k`` (NULLs are left out), ``wanted`` has ``g`` and ``rank``. ``equal``
    rows of the group have this key, and the rank is number ``place`` among them. Ranks beyond a group are left out. ``most``
    is the number of rows of the largest group, if the caller knows it.
    """
    rows = keys.where(F.col("k").isNotNull()).select("g", "k").withColumn("prefix", F.lit(""))
    if most is None:
        most = rows.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    common = ""
    if most > FINISH_ROWS:
        ends = rows.agg(F.min("k").alias("lo"), F.max("k").alias("hi")).first()
        common = os.path.commonprefix([ends["lo"], ends["hi"]])
    done = len(common)
    active = wanted.select("g", F.col("rank").cast("bigint").alias("rank"), F.col("rank").cast("bigint").alias("left"),
                           F.lit("").alias("prefix"))
    found: list[DataFrame] = []
    scratch: list[str] = []
    while True:
        last = most <= FINISH_ROWS
        chunk = F.substring("k", done + 1, (1 << 31) - 1 if last else DIGITS)
        counts = rows.groupBy("g", "prefix", chunk.alias("chunk"))
        if last:  # all digits are known: the least and greatest text of strings would be a sort of all rows
            key = F.concat(F.lit(common), "prefix", "chunk")
            counts = counts.agg(F.count("*").alias("n")).withColumns({"lo": key, "hi": key})
        else:
            counts = counts.agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        # at most 16 ** DIGITS or FINISH_ROWS rows in a window
        ahead = F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("chunk")) - F.col("n")
        placed = counts.withColumn("ahead", ahead).withColumnsRenamed({"g": "__g", "prefix": "__prefix"})
        at = (F.col("g").eqNullSafe(F.col("__g")) & (F.col("prefix") == F.col("__prefix"))
              & (F.col("ahead") <= F.col("left")) & (F.col("left") < F.col("ahead") + F.col("n")))
        hits = stored(active.join(placed, at).select("g", "rank", (F.col("left") - F.col("ahead")).alias("left"),
                                                     "prefix", "chunk", "n", "lo", "hi"), "ranks")
        found.append(hits.where("lo = hi").select("g", "rank", F.col("lo").alias("k"), F.col("left").alias("place"),
                                                  F.col("n").alias("equal")))
        active = hits.where("lo < hi").select("g", "rank", "left", F.concat("prefix", "chunk").alias("prefix"), "n")
        most = active.agg(F.max("n")).first()[0]
        if most is None:
            break
        active = active.drop("n")
        kept = (active.select(F.col("g").alias("__g"), F.col("prefix").alias("__prefix")).distinct()
                .withColumn("__open", F.lit(True)))
        narrowed = salted_join(rows.withColumn("prefix", F.concat("prefix", chunk)), kept, ["g", "prefix"],
                               ["__g", "__prefix"], "inner").drop("__open")
        rows, path = stored_at(narrowed, "narrowed")
        scratch.append(path)
        done += DIGITS
    for path in scratch:
        discard(keys.sparkSession, path)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def lowest_keys(keys: DataFrame, quota: Callable[[Column], Column]) -> DataFrame:
    """``g, n, quota, k``: the highest key among the ``quota(n)`` lowest of each group; NULL where the quota is 0.

    Keys must differ inside a group.
    """
    sizes = (keys.where(F.col("k").isNotNull()).groupBy("g").agg(F.count("*").alias("n"))
             .withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), quota(F.col("n")))).cast("bigint")))
    sizes = stored(sizes, "quotas")
    cuts = stored(select_ranks(keys, sizes.where("quota > 0").select("g", (F.col("quota") - 1).alias("rank"))), "cuts")
    if not cuts.where("equal > 1").isEmpty():
        raise ValueError("the key column must identify rows")
    named = cuts.select(F.col("g").alias("__g"), "k")
    return sizes.join(named, F.col("g").eqNullSafe(F.col("__g")), "left").drop("__g")


def rank_key(keys: DataFrame, rank: Callable[[int], int]) -> tuple[str, int, int] | None:
    """(key, number among equal keys, equal keys) at the 0-based ``rank(n)`` of all n keys ``k``; None outside 0 to n - 1.

    One group needs no tables: the driver sees the counts of one pass, 16 ** DIGITS or FINISH_ROWS of them at most.
    """
    ends = keys.agg(F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    left = rank(ends["n"])
    if not 0 <= left < ends["n"]:
        return None
    low, high, most = ends["lo"], ends["hi"], ends["n"]
    prefix = os.path.commonprefix([low, high])
    while low != high:
        chunk = F.substring("k", len(prefix) + 1, DIGITS if most > FINISH_ROWS else (1 << 31) - 1)
        counts = (keys.where(F.col("k").startswith(prefix)).groupBy(chunk.alias("chunk"))
                  .agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
                  .toArrow().sort_by("lo").to_pydict())
        at = 0
        while left >= counts["n"][at]:
            left -= counts["n"][at]
            at += 1
        prefix, low, high, most = prefix + counts["chunk"][at], counts["lo"][at], counts["hi"][at], counts["n"][at]
    return low, left, most


def value_at(df: DataFrame, name: str, rank: int) -> tuple[str, int, int] | None:
    """(order text, number among equal values, equal values) of the value at a 0-based rank; None beyond the end."""
    return rank_key(df.select(order_text(df, name).alias("k")), lambda n: rank)


def quantile_table(df: DataFrame, column: str, by: Sequence[Column], probs: Sequence[float]) -> DataFrame:
    """``g, n, q0, q1, ...``: linear-interpolation quantiles of a numeric column in every group, as a table.

    ``g`` is a struct of the group columns. Values are doubles; NaN and NULL are left out.
    """
    base = stored(df.select(F.struct(*by).alias("g"), number(column).alias("x")).where(F.col("x").isNotNull()), "values")
    keys = base.select("g", order_text(base, "x").alias("k"))
    spots = base.groupBy("g").agg(F.count("*").alias("n")).select("g", "n", F.posexplode(F.array(*[(F.col("n") - 1) * F.lit(float(p)) for p in probs])).alias("i", "spot"))
    low = F.floor("spot").cast("bigint")
    spots = stored(spots.withColumn("low", low).withColumn("high", F.least(F.col("n") - 1, low + 1)), "spots")
    ranks = spots.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    cuts = select_ranks(keys, ranks, spots.agg(F.max("n")).first()[0] or 0)
    at = cuts.select("g", "rank", _value_of(F.col("k")).alias("v"))
    pick = spots
    for side in ("low", "high"):
        named = at.select(F.col("g").alias(f"__g_{side}"), F.col("rank").alias(f"__r_{side}"), F.col("v").alias(f"v_{side}"))
        pick = pick.join(named, F.col("g").eqNullSafe(F.col(f"__g_{side}")) & (F.col(side) == F.col(f"__r_{side}")))
    value = F.col("v_low") + (F.col("v_high") - F.col("v_low")) * (F.col("spot") - F.col("low"))
    return pick.groupBy("g", "n").agg(*[F.max(F.when(F.col("i") == i, value)).alias(f"q{i}") for i in range(len(probs))])


def _value_of(k: Column) -> Column:
    """The double that a key of 16 digits stands for."""
    high, low = (F.conv(F.substring(k, s, 8), 16, 10).cast("bigint") for s in (1, 9))
    shifted = (F.shiftleft(high, 32).bitwiseOR(low)).bitwiseXOR(F.lit(_SIGN))
    bits = F.when(shifted < 0, shifted.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(shifted)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")
