"""Splits, caps, quotas, weights and order of samples.

All chance comes from md5 of a seed and a key, so the same rows come out on any engine and any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import hash_fraction
from sievework.operators.running import running_sums


def draw(seed: int, *keys: str) -> Column:
    """A hash that orders rows by chance."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))


def hash_split(df: DataFrame, key: Column, share: float) -> DataFrame:
    """side: test for the given share of keys, else train; rows with one key go together."""
    return df.withColumn("side", F.when(hash_fraction(key) < share, "test").otherwise("train"))


def cap(df: DataFrame, group: list[str], most: int, order: list[Column]) -> DataFrame:
    """The first `most` rows of each group. The limit is applied on the map side first, so a hot group ships no more than that from a task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def group_split(df: DataFrame, group: str, stratum: str, share: float, seed: int = 0) -> DataFrame:
    """Whole groups to val, by stratum, in order of chance until share of the stratum's rows is reached; the rest is train.

    A group's stratum is its least. Groups are few or many: their sizes are running sums over range partitions.
    """
    groups = df.groupBy(group).agg(F.min(stratum).alias("_stratum"), F.count(F.lit(1)).alias("_rows"))
    totals = groups.groupBy("_stratum").agg(F.sum("_rows").alias("_total"))
    target = F.when((F.lit(share) <= 0) | (F.col("_total") <= 1), 0).otherwise(F.least(F.col("_total"), F.greatest(F.lit(1), F.bround(F.col("_total") * share).cast("bigint"))))
    ordered = running_sums(groups.withColumn("_draw", draw(seed, group)), ["_stratum"], [F.col("_draw"), F.col(group)], {"_upto": "_rows"})
    picked = ordered.join(totals, ordered["_stratum"].eqNullSafe(totals["_stratum"])).select(F.col(group).alias("_group"), F.when(F.col("_upto") - F.col("_rows") < target, "val").otherwise("train").alias("side"))
    return df.join(picked, df[group].eqNullSafe(picked["_group"])).drop("_group")


def quotas(df: DataFrame, source: str, target: int, floor: int, most: int) -> DataFrame:
    """Seats of each source: the floor first, then one by one to the source with the most rows a seat, none above `most` or its rows; ties to the later name.

    As seats are given by rows / (seats + 1), the order in which a source gets them is known beforehand: all seats are ranked at once. Sources are few.
    """
    pools = df.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("pool"))
    seats = pools.select("source", "pool", F.explode(F.sequence(F.lit(0), F.least("pool", F.greatest(F.lit(most), F.lit(floor))) - 1)).alias("seat")).where((F.col("seat") < floor) | (F.col("seat") < most))
    ranked = seats.withColumn("rank", F.row_number().over(Window.orderBy((F.col("seat") < floor).cast("int").desc(), F.when(F.col("seat") < floor, F.col("seat")), F.desc(F.col("pool") / (F.col("seat") + 1)), F.desc("source"))))
    return pools.join(ranked.where(F.col("rank") <= target).groupBy("source").agg(F.count(F.lit(1)).alias("quota")), "source", "left").select("source", "pool", F.coalesce("quota", F.lit(0)).alias("quota"))


def stratified(df: DataFrame, source: str, key: str, target: int, floor: int, most: int, seed: int = 0) -> DataFrame:
    """Rows chosen by chance up to each source's quota."""
    ranked = cap(df.withColumn("_draw", draw(seed, source, key)), [source], max(floor, most), [F.col("_draw"), F.col(key)])
    q = quotas(df, source, target, floor, most).select(F.col("source").alias("_source"), "quota")
    return ranked.join(q, F.col(source) == F.col("_source")).where("rank <= quota").drop("_source", "_draw", "quota")


def round_robin(df: DataFrame, source: str, order: list[Column]) -> DataFrame:
    """Place of each row when sources take turns: first rows of all sources by name, then second ones."""
    ranked = running_sums(df, [source], order, {}).withColumnRenamed("_n", "turn")
    return running_sums(ranked, [], [F.col("turn"), F.col(source)], {}).withColumnRenamed("_n", "place")


def temperature_weights(df: DataFrame, group: list[str], source: str, temperature: float) -> DataFrame:
    """Share of each source in its group when counts are raised to 1 / temperature."""
    n = df.groupBy(*group, source).agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.pow("n", F.lit(1 / temperature)))
    return n.select(*group, source, "n", F.round(F.col("w") / F.sum("w").over(Window.partitionBy(*group)), 9).alias("share"))


def resampling(df: DataFrame, kind: str, slots: int) -> DataFrame:
    """By kind: rows, slots in equal parts, the last kind takes the rest, and how often a row is drawn."""
    n = df.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("pool"))
    w = Window.orderBy("kind")
    ranked = n.withColumns({"i": F.row_number().over(w), "k": F.count(F.lit(1)).over(Window.partitionBy())})
    share = F.floor(F.lit(slots) / F.col("k"))
    got = F.when(F.col("i") == F.col("k"), F.lit(slots) - share * (F.col("k") - 1)).otherwise(share)
    return ranked.select("kind", "pool", got.cast("bigint").alias("slots"), F.round(got / F.col("pool"), 9).alias("factor"))


def shards(df: DataFrame, key: str, count: int) -> DataFrame:
    """Rows dealt to shards by hash; equal keys together."""
    return df.withColumn("shard", F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint"), F.lit(count)).cast("int"))
