"""Filling fixed-capacity containers with texts (problem 6).

Method: optimal length buckets. Dynamic programming over the global histogram of item sizes chooses the bucket boundaries
that minimise padding; token-budget batches form inside each bucket. What a batch leaves unused is then offered to the
smaller buckets, best fit first, because batches of one bucket alone leave an eighth of the space unused (see the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.forms import token_counts
from sievework.session import cut

#: Items packed by one task.
SHARD_ITEMS = 50_000


def bucket_bounds(histogram: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most so many buckets that minimise padding, ascending; histogram[s] items have size s.

    Padding of an item is its bucket's bound less its size. The last bound is the largest size there is; an empty histogram gives none.
    Takes time of buckets * n log n and memory of n numbers a bucket, for n different sizes.
    """
    sizes = np.flatnonzero(histogram)
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return []
    count = np.concatenate([[0.0], np.cumsum(histogram[sizes], dtype=np.float64)])
    mass = np.concatenate([[0.0], np.cumsum(histogram[sizes] * sizes, dtype=np.float64)])
    n = len(sizes)
    # cost of a bucket of sizes i..j-1: sizes[j-1] * (count[j] - count[i]) - (mass[j] - mass[i]). It is a Monge cost, so the best i grows with j
    best, backs = np.concatenate([[0.0], np.full(n, np.inf)]), []
    for _ in range(min(buckets, n)):
        now, back = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        low, high, least, most = (np.array([x]) for x in (1, n, 0, n - 1))  # all stretches of j of one depth, and where their best i can lie
        while len(low):
            mid = (low + high) // 2
            last = np.minimum(most, mid - 1)
            many = last - least + 1
            first = np.cumsum(many) - many
            i = np.repeat(least - first, many) + np.arange(int(many.sum()))
            j = np.repeat(mid, many)
            value = best[i] + sizes[j - 1] * (count[j] - count[i]) - (mass[j] - mass[i])
            smallest = np.minimum.reduceat(value, first)
            at = np.flatnonzero(value == np.repeat(smallest, many))
            chosen = i[at[np.searchsorted(at, first)]]
            now[mid], back[mid] = smallest, chosen
            low, high, least, most = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (least, chosen), (chosen, most)))
            live = low <= high
            low, high, least, most = low[live], high[live], least[live], most[live]
        best = now
        backs.append(back)
    bounds, j = [], n
    for back in reversed(backs):
        bounds.append(int(sizes[j - 1]))
        j = int(back[j])
        if j == 0:
            break
    return sorted(bounds)


def fill(sizes: np.ndarray, bounds: list[int], capacity: int, top_up: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Container number and place of each item, all sizes in 1..capacity.

    Buckets go from the largest down. Batches form inside each: items are taken in order until the next would exceed the budget.
    With top_up, an item first goes to the earlier container with the least free space that still holds it.
    """
    bucket = np.searchsorted(np.asarray(bounds), sizes)
    order = np.lexsort((np.arange(len(sizes)), -sizes, -bucket))
    container, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n, last, current = 0, 0, -1, -1
    free: list[int] = []
    for i in order.tolist():
        size = int(sizes[i])
        if bucket[i] != last:
            last = bucket[i]
            if current >= 0 and top_up and free[current]:
                by_room[free[current]].append(current)
                rooms |= 1 << free[current]
            current = -1
        found = -1
        if current >= 0 and free[current] >= size:
            found = current
        elif top_up and (fits := rooms >> size):
            room = size + (fits & -fits).bit_length() - 1
            found = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            if current >= 0 and top_up and free[current]:
                by_room[free[current]].append(current)
                rooms |= 1 << free[current]
            free.append(capacity)
            found = current = n
            n += 1
        container[i], place[i] = found, capacity - free[found]
        free[found] -= size
        if top_up and found != current and free[found]:
            by_room[free[found]].append(found)
            rooms |= 1 << free[found]
    return container, place


def items(df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per item: a text, or each part of a text larger than a container. Columns doc_id, part, first_token, tokens.

    A larger text is split into full containers and one rest. A text without tokens (null, empty, blank) is one item of size 0.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = token_counts(batch.column(1))
            parts = np.maximum(1, -(-tokens // capacity))
            row = np.repeat(np.arange(len(tokens)), parts)
            part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            first = part * capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(part, pa.int32()), pa.array(first, pa.int64()), pa.array(np.minimum(tokens[row] - first, capacity), pa.int32())],
                names=["doc_id", "part", "first_token", "tokens"],
            )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(cut_up, f"doc_id {kind}, part int, first_token bigint, tokens int")


def pack(df: DataFrame, capacity: int, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text", top_up: bool = True) -> DataFrame:
    """The container of every text, or part of a text larger than a container.

    Columns: doc_id, part (from 0), first_token, tokens, bucket (upper bound), container, place (tokens before it in the container).
    Only a text with more than capacity tokens is split. No container holds more than capacity tokens; no item is left out.
    A text without tokens needs no space: its bucket is 0, its container and place are null. Rows with equal ids are separate items.
    The histogram has at most capacity + 1 rows, whatever the input; items are spread over tasks by a hash of id and part, SHARD_ITEMS or so to a task. A task
    that would get more than twice as many, because ids repeat, is split. Only (id, part, size) is shuffled, never text.
    """
    sized = cut(items(df, capacity, id_col, text_col))
    histogram = np.zeros(capacity + 1, np.int64)
    for tokens, n in sized.groupBy("tokens").count().toLocalIterator():
        histogram[tokens] = n
    bounds = bucket_bounds(histogram, buckets)
    shards = max(1, -(-int(histogram.sum()) // SHARD_ITEMS))
    home = F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int")
    crowded = [(s, -(-n // SHARD_ITEMS)) for s, n in sized.groupBy(home.alias("s")).count().where(F.col("count") > 2 * SHARD_ITEMS).toLocalIterator()]  # at most half as many as shards
    all_shards = shards * max([1, *(w for _, w in crowded)])
    kind = df.schema[id_col].dataType.simpleString()

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("part", "ascending"), ("first_token", "ascending")])
        sizes = group["tokens"].to_numpy().astype(np.int64)
        real = np.flatnonzero(sizes > 0)
        number, place = fill(sizes[real], bounds, capacity, top_up)
        shard = group["shard"][0].as_py()
        to = np.zeros(len(sizes), np.int64)
        at = np.zeros(len(sizes), np.int64)
        bucket = np.zeros(len(sizes), np.int64)
        to[real], at[real] = number * all_shards + shard, place
        if len(real):
            bucket[real] = np.asarray(bounds)[np.searchsorted(np.asarray(bounds), sizes[real])]
        blank = sizes == 0
        return pa.table({
            "doc_id": group["doc_id"], "part": group["part"], "first_token": group["first_token"], "tokens": group["tokens"],
            "bucket": pa.array(bucket, pa.int32()), "container": pa.array(to, pa.int64(), mask=blank), "place": pa.array(at, pa.int32(), mask=blank),
        })

    salted = sized.withColumn("shard", home)
    if crowded:
        table = df.sparkSession.createDataFrame(crowded, "shard int, ways int").withColumn("base", F.lit(shards))
        salted = salted.withColumn("spread", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int")).join(F.broadcast(table), "shard", "left")  # a row for each crowded shard
        salted = salted.withColumn("shard", F.coalesce(F.col("shard") + F.col("base") * (F.col("spread") % F.col("ways")), "shard")).drop("spread", "ways", "base")
    return salted.groupBy("shard").applyInArrow(packed, f"doc_id {kind}, part int, first_token bigint, tokens int, bucket int, container bigint, place int")


def fills(packed: DataFrame, capacity: int) -> DataFrame:
    """Of each container: number of items, tokens held, tokens unused."""
    return (
        packed.where(F.col("container").isNotNull())
        .groupBy("container")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("used"))
        .withColumn("unused", F.lit(capacity) - F.col("used"))
    )


def fill_report(df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How full containers are with the top-up, and of buckets alone: top_up, containers, items, used, fill (share of the space; null without a container)."""
    parts = []
    for top_up in (True, False):
        f = fills(pack(df, capacity, id_col=id_col, text_col=text_col, top_up=top_up), capacity)
        parts.append(f.agg(F.lit(top_up).alias("top_up"), F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used"), F.round(F.sum("used") / F.nullif(F.count(F.lit(1)) * capacity, F.lit(0)), 6).alias("fill")))
    return parts[0].unionByName(parts[1])


def totals(packed: DataFrame, capacity: int) -> DataFrame:
    """What must hold of a packing, in one row: texts, tokens, split (texts in several parts), crowded (containers above capacity), torn (parts of a text that needn't be split)."""
    over = fills(packed, capacity).where(F.col("used") > capacity).agg(F.count(F.lit(1)).alias("crowded"))
    parts = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("tokens"))
    each = parts.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum((F.col("parts") > 1).cast("int")), F.lit(0)).alias("split"), F.coalesce(F.sum(((F.col("parts") > 1) & (F.col("tokens") <= capacity)).cast("int")), F.lit(0)).alias("torn"))
    return each.crossJoin(over)  # one row each
