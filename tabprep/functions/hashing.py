"""Seeded pseudo-random order of rows by key, the same wherever and whenever it is computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.functions.columns import col
from tabprep.functions.joins import salted_join
from tabprep.functions.selection import lowest_keys, rank_key

#: 13 hex digits are 52 bits, exact in a double
_DIGITS = 13


def hash_text(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def hash_number(key: Column, seed: int | str, digits: int = _DIGITS) -> Column:
    """Leading hex digits of the hash as a number; ordered like the hash text."""
    return F.conv(F.substring(hash_text(key, seed), 1, digits), 16, 10).cast("double")


def spread_number(number: Column, seed: int) -> Column:
    """A number from 0 up to 1 for a 64-bit number, for bounded samples; not for results."""
    return F.pmod(F.xxhash64(number, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mark_lowest(df: DataFrame, key: str, seed: int | str, quota: Callable, name: str,
                by: str | None = None) -> DataFrame:
    """Add the flag ``name`` for exactly ``quota(n)`` rows of each group of n: those with the smallest hash of the key.

    ``quota`` is given a number, or with ``by`` the Column of the groups' sizes. The key identifies rows. The cut of a group is an exact order statistic of the whole hash, found for all groups at
    once, and joined; so a group of any size is decided by one comparison per row, and there may be any number of groups.
    Rows whose group is NULL are not chosen.
    """
    if by is None:
        cut = rank_key(df.select(hash_text(col(key), seed).alias("k")), lambda n: min(n, quota(n)) - 1)
        if cut is not None and cut[2] > 1:
            raise ValueError(f"column {key!r} must identify rows")
        chosen = F.lit(False) if cut is None else F.coalesce(hash_text(col(key), seed) <= F.lit(cut[0]), F.lit(False))
        return df.withColumn(name, chosen)
    cuts = lowest_keys(df.where(col(by).isNotNull()).select(col(by).alias("g"), hash_text(col(key), seed).alias("k")), quota)
    table = cuts.select(F.col("g").alias("__g"), F.col("k").alias("__cut"))
    chosen = F.coalesce(hash_text(col(key), seed) <= F.col("__cut"), F.lit(False))
    return salted_join(df, table, [by], ["__g"]).withColumn(name, chosen).drop("__cut")
