"""Running totals over a whole ordered group, without putting the group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut


def running_sums(df: DataFrame, group: list[str], order: list, measures: dict[str, str], least_before: dict[str, str] | None = None) -> DataFrame:
    """df with inclusive running sums of measures (new column: column) in each group, in the given order, their _n, the row's rank from 1, and the minima of least_before over earlier rows only.

    order must decide every tie. Rows are range partitioned by group and order; each part is summed by a window, and the sums of
    the parts before it, a row per part and group, are added. A group that holds all rows is still spread over all parts.
    """
    keys, least = [F.col(g) for g in group], least_before or {}
    parts = cut(df.withColumn("_one", F.lit(1)).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = {**measures, "_n": "_one"}
    whole = parts.groupBy(*group, "_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.min(c).alias(n) for n, c in least.items()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(*group, "_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums), *(F.min(n).over(before).alias(f"_before_{n}") for n in least))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.select("*", *(F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()), *(F.min(c).over(earlier).alias(f"_in_{n}") for n, c in least.items()))
    joined = summed.alias("s").join(offsets.alias("o"), [F.col(f"s.{g}").eqNullSafe(F.col(f"o.{g}")) for g in [*group, "_part"]])
    kept = [F.col(f"s.{c}") for c in df.columns]
    return joined.select(*kept, *((F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums), *(F.least(f"_in_{n}", f"_before_{n}").alias(n) for n in least))


def running_last(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with name: the last value that isn't null at or before each row of its group. Spread out like running_sums."""
    parts = cut(df.repartitionByRange(*(F.col(c) for c in [*group, *order])).withColumn("_part", F.spark_partition_id()))
    ends = parts.where(F.col(value).isNotNull()).groupBy(*group, "_part").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    every = parts.select(*group, "_part").distinct().alias("p").join(ends.alias("e"), [F.col(f"p.{g}").eqNullSafe(F.col(f"e.{g}")) for g in [*group, "_part"]], "left").select(*(F.col(f"p.{g}") for g in [*group, "_part"]), "_end")
    carried = every.select(*group, "_part", F.last("_end", ignorenulls=True).over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = parts.withColumn("_near", F.last(value, ignorenulls=True).over(inside)).alias("s")
    joined = near.join(carried.alias("o"), [F.col(f"s.{g}").eqNullSafe(F.col(f"o.{g}")) for g in [*group, "_part"]])
    return joined.select(*(F.col(f"s.{c}") for c in df.columns), F.coalesce("_near", "_carried").alias(name))
