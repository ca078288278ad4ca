"""Splits that keep related records together (problem 5).

Method: largest-differencing balance. Rows that share a group of one source, or a state, form components. Components are dealt
to shards; in each the two partial partitions that differ most inside are combined, over and over, largest bin with smallest,
until one partition into many nearly equal bins is left; the shards' partitions are combined in the same way. Whole bins then go to splits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.forms import form, form_array
from sievework.operators.components import connected_components
from sievework.operators.skew import first_per_key, lookup
from sievework.session import cut

#: Bins, and components that one task balances.
BINS = 200
SHARD_COMPONENTS = 20_000
#: Shards whose bins one task, and in the end the driver, combines; it holds no more than this many times BINS numbers.
MOST_SHARDS = 2_000


def split_name(column: Column | str) -> Column:
    """A split's name: trimmed, lower case, val, dev and valid read as validation; null and blank are no split."""
    name = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^\s+|\s+$", ""))
    return F.when(name.isin("val", "dev", "valid"), "validation").when(name != "", name)


def difference_bins(partitions: list[list[tuple[int, int]]], bins: int) -> list[tuple[int, list[int]]]:
    """Combine partitions into one of at most so many bins, by largest differencing.

    A partition is a list of (weight, member) with one bin each. Always the two with the largest differences between
    their heaviest and lightest bins are combined, the heaviest bin of one with the lightest of the other.
    Returns the bins as (weight, members), heaviest first. Ties go to the partition that came first.
    """
    tick = count()
    children: list[tuple[int, ...]] = []  # a bin is a leaf (member,) or two earlier bins

    def leaf(member: int) -> int:
        children.append((member,))
        return len(children) - 1

    def entry(slots: list[tuple[int, int]]) -> tuple[int, int, list[tuple[int, int]]]:
        slots.sort(key=lambda x: -x[0])
        return (-(slots[0][0] - (slots[-1][0] if len(slots) == bins else 0)), next(tick), slots)

    heap = [entry([(w, leaf(m)) for w, m in slots]) for slots in partitions if slots]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = max(0, len(a) + len(b) - bins)
        merged = a[: len(a) - shared] + b[: len(b) - shared]
        # the lightest bins of a meet the lightest of b crosswise, heavier with lighter
        for (w, x), (v, y) in zip(a[len(a) - shared :], reversed(b[len(b) - shared :])):
            children.append((x, y))
            merged.append((w + v, len(children) - 1))
        heapq.heappush(heap, entry(merged))
    out = []
    for weight, root in heap[0][2] if heap else []:
        members, stack = [], [root]
        while stack:
            inner = children[stack.pop()]
            if len(inner) == 1:
                members.append(inner[0])
            else:
                stack += inner
        out.append((weight, members))
    return out


def allocate(bins: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, str]:
    """Bins (weight, name), whole, to splits: heaviest first, each to the split that lacks most of its share. Ties go to the first name."""
    total = sum(w for w, _ in bins)
    want = {s: share / (sum(shares.values()) or 1) * total for s, share in sorted(shares.items()) if share > 0}
    out = {}
    for weight, name in sorted(bins, key=lambda x: (-x[0], x[1])):
        to = max(want, key=lambda s: want[s])
        want[to] -= weight
        out[name] = to
    return out


def sets(df: DataFrame, id_col: str = "row_no", source_col: str = "source", group_col: str = "group_key", state_col: str = "state", split_col: str = "split") -> DataFrame:
    """The set of each row. Columns: row_no, first_row (the least row_no of the set), split (normalised, may be null).

    Rows belong together when the forms of source and group are both equal, or those of state, and so on along chains.
    An empty group or state (null, or without letters and digits) joins nothing; a null source is a source of empty form.
    Other columns are not read; row_no must be unique; an empty table gives no rows. A group may hold any part of the rows: the rows'
    keys are reduced on the map side, and rows are dealt to several tasks when they look their set up.
    """

    @F.arrow_udf("binary")
    def key_of(parts: pa.Array, sources: pa.Array) -> pa.Array:
        """128-bit key of a form, together with the form of a source where there is one; null for an empty form."""
        out = []
        for text, source in zip(form_array(parts).to_pylist(), sources.to_pylist()):
            out.append(xxhash.xxh3_128_digest(text if source is None else f"{form(source)}\0{text}") if text else None)
        return pa.array(out, pa.binary())

    rows = cut(
        df.select(
            F.col(id_col).cast("bigint").alias("row_no"),
            split_name(split_col).alias("split"),
            key_of(F.col(state_col), F.lit(None).cast("string")).alias("state_key"),
            key_of(F.col(group_col), F.coalesce(F.col(source_col), F.lit(""))).alias("group_key"),
        )
    )
    with_state = lookup(rows, first_per_key(rows, "state_key", "row_no", "by_state"), "state_key", "row_no")
    reps = cut(lookup(with_state, first_per_key(rows, "group_key", "row_no", "by_group"), "group_key", "row_no").select("row_no", "split", F.coalesce("by_state", "by_group", "row_no").alias("rep"), F.coalesce("by_group", "by_state", "row_no").alias("other")))
    found = connected_components(reps.where("rep <> other").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    named = lookup(reps.select("row_no", "split", "rep"), found.select(F.col("node").alias("rep"), "component"), "rep", "row_no")
    return named.select("row_no", F.coalesce("component", "rep").alias("first_row"), "split")


def torn(sets_df: DataFrame) -> DataFrame:
    """Members other than the least of the sets whose rows carry two or more splits: first_row, row_no."""
    sets_df = cut(sets_df)
    bad = sets_df.groupBy("first_row").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("first_row", F.lit(True).alias("torn"))
    return lookup(sets_df, bad, "first_row", "row_no", how="inner").where("row_no <> first_row").select("first_row", "row_no")


def _by_shard(rows: Iterable[tuple[int, int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """Rows (shard, bin, weight) as one list of (weight, number of shard and bin) for each shard, in order."""
    out: dict[int, list[tuple[int, int]]] = {}
    for shard, number, weight in sorted(rows):
        out.setdefault(shard, []).append((weight, shard * bins + number))
    return list(out.values())


def assign(sets_df: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """The new split of every row: row_no, first_row, old_split, split. Rows of a set get the same.

    targets: split, share; shares are taken in proportion. Components are dealt by hash to shards of SHARD_COMPONENTS or so,
    each balanced by one task into bins. The bins of MOST_SHARDS shards are combined by a task in the same way, level by level, until the driver can combine
    what is left: at most MOST_SHARDS times bins weights, never components.
    A set heavier than a bin has its bin to itself but for what balancing adds; it stays whole, so shares can be missed by its excess.
    """
    shares = {name: share for name, share in targets.select(split_name("split"), "share").toLocalIterator() if name and share}
    if not shares:
        raise ValueError("no split has a share")
    spark = sets_df.sparkSession
    sets_df = cut(sets_df)
    weights = cut(sets_df.groupBy("first_row").agg(F.count(F.lit(1)).alias("weight")))
    shards = max(1, -(-weights.count() // SHARD_COMPONENTS))

    def balanced(group: pa.Table) -> pa.Table:
        group = group.sort_by([("weight", "descending"), ("first_row", "ascending")])
        members = group["first_row"].to_pylist()
        found = difference_bins([[(w, i)] for i, w in enumerate(group["weight"].to_pylist())], bins)
        number = {m: b for b, (_, inner) in enumerate(found) for m in inner}
        return pa.table({
            "shard": pa.array([group["shard"][0].as_py()] * len(members), pa.int32()), "bin": pa.array([number[i] for i in range(len(members))], pa.int32()),
            "first_row": pa.array(members, pa.int64()), "weight": group["weight"].cast(pa.int64()),
        })

    spread = weights.withColumn("shard", F.pmod(F.xxhash64("first_row"), F.lit(shards)).cast("int"))
    binned = cut(spread.groupBy("shard").applyInArrow(balanced, "shard int, bin int, first_row bigint, weight bigint"))

    def combined(group: pa.Table) -> pa.Table:
        by_shard = _by_shard(zip(*(group[c].to_pylist() for c in ("shard", "bin", "weight"))), bins)
        rows = [(member // bins, member % bins, group["upper"][0].as_py(), b, w) for b, (w, inner) in enumerate(difference_bins(by_shard, bins)) for member in inner]
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(("shard", "bin", "upper", "upper_bin", "share_of"), zip(*rows))})

    level = binned.groupBy("shard", "bin").agg(F.sum("weight").alias("weight")).select(F.col("shard").cast("bigint").alias("shard"), F.col("bin").cast("bigint").alias("bin"), "weight")
    levels = []
    while shards > MOST_SHARDS:
        shards = -(-shards // MOST_SHARDS)
        up = cut(level.withColumn("upper", F.pmod("shard", F.lit(shards))).groupBy("upper").applyInArrow(combined, "shard bigint, bin bigint, upper bigint, upper_bin bigint, share_of bigint"))
        levels.append(up.select("shard", "bin", "upper", "upper_bin"))
        level = up.select(F.col("upper").alias("shard"), F.col("upper_bin").alias("bin"), F.col("share_of").alias("weight")).distinct()
    whole = difference_bins(_by_shard(level.orderBy("shard", "bin").toLocalIterator(), bins), bins)
    to = allocate([(w, i) for i, (w, _) in enumerate(whole)], shares)
    table = [(member // bins, member % bins, to[i]) for i, (_, inner) in enumerate(whole) for member in inner]
    chosen = spark.createDataFrame(table, "shard bigint, bin bigint, new_split string")
    for up in reversed(levels):
        chosen = up.join(chosen.select(F.col("shard").alias("upper"), F.col("bin").alias("upper_bin"), "new_split"), ["upper", "upper_bin"]).select("shard", "bin", "new_split")
    chosen = binned.join(chosen, ["shard", "bin"]).select("first_row", "new_split")
    return lookup(sets_df, chosen, "first_row", "row_no").select("row_no", "first_row", F.col("split").alias("old_split"), F.col("new_split").alias("split"))
