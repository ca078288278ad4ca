"""Joins that stay spread out when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salt(*columns: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is by shuffle and merge. Spark estimates a side by the compressed files below it, without what explode or decoding add,
    so one that grows with the input can pass for small and be gathered by the driver to be broadcast."""
    return df.hint("merge")


def lookup(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = SALTS, how: str = "left") -> DataFrame:
    """left with the columns of right, which has at most one row for each key.

    left's rows of one key are dealt to salts tasks by a hash of the column spread. right isn't copied for every salt,
    only for those that occur with its key: the pairs (key, salt) of left are made distinct, map side first, and joined to right.
    A null key finds nothing.
    """
    salted = left.withColumn("_salt", salt(spread, salts=salts))
    pairs = salted.where(F.col(key).isNotNull()).select(key, "_salt").distinct().join(shuffled(right), key, "inner")
    return salted.join(shuffled(pairs), [key, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The least value for each key that isn't null; a hot key is reduced on the map side."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(name))
