"""Joins that Spark has no strategy for, and other general operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.questions import _numbers
from sievework.operators.running import running_last, running_sums
from sievework.session import cut

QUERY_BLOCK = 10_000


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """left with values of the last right row of the same `by` whose `on` is at or before left's; null without one.

    Both sides are merged in range partitions and the last right row is carried on, over partitions too, so a hot key is many tasks.
    Of right rows at the same place the greatest values win.
    """
    packed = F.struct(*values)
    lefts = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType)})
    reduced = right.groupBy(*by, on).agg(F.max(packed).alias("_v")).withColumn("_side", F.lit(0))
    both = running_last(lefts.unionByName(reduced, allowMissingColumns=True), by, [on, "_side"], "_v", "_last")
    return both.where("_side = 1").select(*left.columns, *(F.col(f"_last.{v}").alias(f"right_{v}") for v in values))


def band_join(left: DataFrame, right: DataFrame, left_size: str, right_size: str, low: float, high: float) -> DataFrame:
    """Pairs with low * left_size <= right_size <= high * left_size, sizes 1 or more: an equi-join on the bucket of log2, right meeting the buckets that left's band covers."""
    bucket = lambda c: F.floor(F.log2(c)).cast("int")
    lefts = left.where(F.col(left_size) >= 1).withColumn("_bucket", F.explode(F.sequence(bucket(F.greatest(F.col(left_size) * low, F.lit(1.0))), bucket(F.greatest(F.col(left_size) * high, F.lit(1.0))))))
    rights = right.where(F.col(right_size) >= 1).withColumn("_bucket", bucket(F.col(right_size)))
    return lefts.join(rights, "_bucket").where(F.col(right_size).between(F.col(left_size) * low, F.col(left_size) * high)).drop("_bucket")


def nearest_vectors(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """The k vectors of df with the greatest cosine to each query, exactly: query_id, id, cosine, rank; ties to the lesser id, a vector is not its own neighbour.

    Queries are a stated set; they are broadcast in blocks of QUERY_BLOCK, and each partition keeps its best k for each query. Null and zero vectors are left out.
    """
    spark = df.sparkSession
    out = None
    block: list = []

    def searched(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block])
        matrix = np.array([r[1] for r in block], np.float64)
        norm = np.linalg.norm(matrix, axis=1)
        sent = spark.sparkContext.broadcast((ids[norm > 0], matrix[norm > 0] / norm[norm > 0, None]))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, unit = sent.value
            top, there = np.full((len(wanted), k), -np.inf), np.full((len(wanted), k), np.iinfo(np.int64).max)
            for batch in batches:
                rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None]
                if not rows or not len(wanted):
                    continue
                mine = np.array([v for _, v in rows], np.float64)
                size = np.linalg.norm(mine, axis=1)
                ids = np.array([i for i, _ in rows])[size > 0]
                scores = unit @ (mine[size > 0] / size[size > 0, None]).T
                scores[wanted[:, None] == ids[None, :]] = -np.inf
                if scores.shape[1] > k:  # what can be among the best of this batch, ties at the edge included
                    edge = np.partition(scores, -k, axis=1)[:, -k]
                    most = int((scores >= edge[:, None] - 1e-12).sum(axis=1).max())
                    near = np.argpartition(-scores, min(most, scores.shape[1] - 1), axis=1)[:, :most]
                else:
                    near = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
                both = np.concatenate([top, np.take_along_axis(scores, near, axis=1)], axis=1)
                both_ids = np.concatenate([there, ids[near]], axis=1)
                order = np.lexsort((both_ids, -np.round(both, 12)), axis=1)[:, :k]
                top, there = np.take_along_axis(both, order, axis=1), np.take_along_axis(both_ids, order, axis=1)
            q, at = np.nonzero(np.isfinite(top))
            yield pa.RecordBatch.from_arrays([pa.array(wanted[q], pa.int64()), pa.array(there[q, at], pa.int64()), pa.array(top[q, at], pa.float64())], names=["query_id", "id", "cosine"])

        return df.select(F.col(id_col).cast("bigint"), vector).mapInArrow(best, "query_id bigint, id bigint, cosine double")

    for row in queries.select(F.col(id_col).cast("bigint"), vector).where(F.col(vector).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            out, block = searched(block) if out is None else out.unionByName(searched(block)), []
    if block or out is None:
        if not block:
            return spark.createDataFrame([], "query_id bigint, id bigint, cosine double, rank int")
        out = searched(block) if out is None else out.unionByName(searched(block))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def band_donors(df: DataFrame, key: str, size: str, own: Column, low: float, high: float, seed: int, draws: int = 24) -> DataFrame:
    """For each row another of about its size (low to high times it) with another `own`, drawn by hash: key, donor (null if none of the draws fits; all are tried where there are no more than draws).

    Rows are numbered by size, so those of a band are a stretch of numbers, and a row looks up some of them. No pairs of a band are made.
    """
    rows = df.where(F.col(size) >= 1).select(F.col(key).alias("row_no"), F.col(size).alias("size"), F.coalesce(own, F.lit("")).alias("own"))
    numbered = cut(running_sums(rows, [], [F.col("size"), F.col("row_no")], {}))
    ends = numbered.groupBy("size").agg(F.max("_n").alias("upto")).agg(F.array_sort(F.collect_list(F.struct("size", "upto"))).alias("ends"))  # as many as there are sizes
    below = lambda most: F.coalesce(F.array_max(F.transform(F.filter("ends", lambda e: e["size"] <= most), lambda e: e["upto"])), F.lit(0))
    banded = numbered.crossJoin(ends).select("row_no", "own", below(F.ceil(F.col("size") * low) - 1).alias("low"), below(F.floor(F.col("size") * high)).alias("high"))  # one row
    asked = banded.select("row_no", "own", F.posexplode(F.transform(_numbers(F.col("high") - F.col("low"), F.lit(draws), f"{seed}:band"), lambda i: i + F.col("low"))).alias("turn", "n"))
    met = asked.join(numbered.select(F.col("_n").cast("bigint").alias("n"), F.col("row_no").alias("donor"), F.col("own").alias("theirs")), "n").where("theirs <> own")
    return rows.select("row_no").join(met.groupBy("row_no").agg(F.min_by("donor", "turn").alias("donor")), "row_no", "left").select(F.col("row_no").alias(key), "donor")


def changed_fields(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field-wise difference of two tables by key: key, field, before, after; a row that is only on one side differs in all its fields that aren't null."""
    a, b = left.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields)), right.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    both = a.join(b, key, "full")
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("before"), F.col(f"b_{f}").alias("after")) for f in fields))
    return both.select(key, F.explode(entries).alias("e")).select(key, "e.*").where(~F.col("before").eqNullSafe(F.col("after")))


def stub_scores(df: DataFrame, id_col: str, options: Column) -> DataFrame:
    """Scores without a model: each option gets 1 and the first 16 bits of a hash, divided by the sum. For tests of whatever takes scores."""
    weights = F.transform(options, lambda k: (1 + F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), k)), 1, 4), 16, 10).cast("bigint")).cast("double"))
    scored = df.withColumn("_w", weights)
    whole = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("probs", F.transform("_w", lambda x: x / whole)).drop("_w")


def with_scores(df: DataFrame, scorer, schema: str, columns: list[str]) -> DataFrame:  # noqa: ANN001
    """df's columns given to a scorer, batch by batch; scorer takes a dict of lists and gives one, of the schema's columns. It's made once a worker if it is a function without arguments that returns one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = scorer()
        for batch in batches:
            yield pa.RecordBatch.from_pydict(predict(batch.to_pydict()))

    return df.select(*columns).mapInArrow(run, schema)
