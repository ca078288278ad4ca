"""MinHash signatures, banded candidates decided by exact similarity, near-duplicate clusters and order-dependent dedup.

Similarity is that of the sets of five-character substrings of two texts; a shorter text is one substring. Bands propose pairs, the estimate of
a signature four standard errors below the threshold leaves most of them out, and the exact similarity decides the rest. A pair at 0.7 is
missed by all of 32 bands of 4 rows with a chance of 2e-4 and by the estimate with one of 3e-5; at 0.8 both are below 1e-7.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.forms import _mixed, form_column, gram_hashes
from sievework.operators.components import connected_components
from sievework.operators.skew import lookup, shuffled
from sievework.session import cut, release, stored

PERMUTATIONS, BANDS, THRESHOLD = 128, 32, 0.7
#: Members of a bucket that a task compares with as many others.
BUCKET_BLOCK = 1000
#: Rows of buckets up to which texts are sent to all of them at once; more are sent in WAVES, so that not all lie on disk together.
WAVE_ROWS, WAVES = 500_000, 4


def prefilter(threshold: float, permutations: int = PERMUTATIONS) -> float:
    """The estimate below which a pair isn't compared exactly: four standard errors below the threshold, not below 0."""
    return max(0.0, threshold - 4 * math.sqrt(max(threshold * (1 - threshold), 0.0) / permutations))


def _multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(text: str, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """Least values of a text's grams under as many hash functions, 32 bits of each."""
    h = np.unique(gram_hashes(text))
    out = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(h), 1024):
        np.minimum(out, (h[s : s + 1024, None] * times + plus).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signed(df: DataFrame, id_col: str, text: Column | None = None, permutations: int = PERMUTATIONS, bands: int = BANDS, seed: int = 1, sketch: bool = False) -> DataFrame:
    """Distinct texts that aren't empty, by their least id: id, text, signature (bytes), buckets (a hash of each band). text: what is compared, by default the form of the column state.

    sketch: of each value of a signature its last byte only, a quarter of the bytes; one pair of unequal values in 256 then passes for equal."""
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), (form_column("state") if text is None else text).alias("text")).where("text <> ''").groupBy("text").agg(F.min("id").alias("id"))
    rows = permutations // bands

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _multipliers(permutations, seed)
        for batch in batches:
            signs = [signature(t, times, plus) for t in batch.column(1).to_pylist()]
            parts = [_mixed((s.astype(np.uint64) + np.repeat(np.arange(bands, dtype=np.uint64) << np.uint64(32), rows)), 1).reshape(bands, rows) for s in signs]
            buckets = [(p * (2 * np.arange(rows, dtype=np.uint64) + np.uint64(1))).sum(axis=1, dtype=np.uint64).view(np.int64) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([(s.astype(np.uint8) if sketch else s).tobytes() for s in signs], pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["id", "text", "signature", "buckets"])

    return texts.select("id", "text").mapInArrow(made, "id bigint, text string, signature binary, buckets array<bigint>")


#: What is made of one bucket: signatures (a row each), a function giving the exact similarity of two rows, the rows' roles; gives pairs of rows.
Compare = Callable[[np.ndarray, Callable[[int, int], float], np.ndarray], list[tuple[int, int]]]


def _in_buckets(reps: DataFrame, compare: Compare, value: type = np.uint32) -> DataFrame:
    """compare's pairs of ids (a, b) for all buckets of two and more. reps: as signed() gives them, and role; value: what a signature is made of.

    Buckets of the same members make the same pairs, so one of them is compared. A bucket of many is dealt to blocks of BUCKET_BLOCK, each pair of which
    is a piece of work of its own; a task holds one at a time.
    """
    spark = reps.sparkSession
    release(spark)
    members = reps.select("id", F.explode("buckets").alias("bucket")).where("bucket IS NOT NULL").repartition("bucket")  # one shuffle for both uses
    sets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")).where("n > 1")
    several = sets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks"))
    dealt = members.join(shuffled(several), "bucket").withColumns({"mine": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    works = cut(dealt.select("id", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("work")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        work = None

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                signs = np.stack([np.frombuffer(h[1], value) for h in held])
                grams: dict[int, np.ndarray] = {}

                def exact(i: int, j: int) -> float:
                    a, b = (grams[k] if k in grams else grams.setdefault(k, np.unique(gram_hashes(held[k][2]))) for k in (i, j))
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    return common / (len(a) + len(b) - common)

                pairs = compare(signs, exact, np.array([h[3] for h in held]))
                yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in pairs], pa.int64()), pa.array([held[j][0] for _, j in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if row[0] != work:
                    yield from close()
                    work, held = row[0], []
                held.append(row[1:])
        yield from close()

    def pairs(of: DataFrame) -> DataFrame:
        keyed = of.join(shuffled(reps.drop("buckets")), "id").select("work", "id", "signature", "text", "role")
        return keyed.repartition("work").sortWithinPartitions("work", "id").mapInArrow(compared, "a bigint, b bigint")

    release(spark)
    if works.count() <= WAVE_ROWS:
        return pairs(works)
    found = spark.createDataFrame([], "a bigint, b bigint")
    for wave in range(WAVES):
        found = found.unionByName(cut(pairs(works.where(F.pmod("work", F.lit(WAVES)) == wave))))
        release(spark)
    return found


def clusters(df: DataFrame, id_col: str, text: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The near-duplicate cluster of every row: id, cluster (its least id). Rows without a text have none; one without partners is a cluster of its own.

    Chains count: near to near is one cluster. Of a bucket's pairs those whose rows are joined already aren't compared, so what leaves a task
    is a forest, not all pairs of a cluster. Rows of equal text are one; id must be unique.
    """
    least = prefilter(threshold)

    def forest(signs: np.ndarray, exact: Callable[[int, int], float], role: np.ndarray) -> list[tuple[int, int]]:
        root = np.arange(len(signs))
        out = []
        for i in range(len(signs) - 1):
            for j in (np.flatnonzero((signs[i + 1 :] == signs[i]).mean(axis=1) >= least) + i + 1).tolist():
                if root[i] != root[j] and exact(i, j) >= threshold:
                    root[root == root[j]] = root[i]
                    out.append((i, j))
        return out

    text = form_column("state") if text is None else text
    named = cut(df.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.md5(text)).alias("key"), (text != "").alias("some")).where("some").drop("some"))
    reps = stored(signed(df, id_col, text, sketch=True).withColumn("role", F.lit(0)))
    found = connected_components(_in_buckets(reps, forest, np.uint8).toDF("src", "dst"))
    of = reps.select(F.col("id").alias("node"), F.unhex(F.md5("text")).alias("key")).join(shuffled(found), "node", "left").select("key", F.coalesce("component", "node").alias("cluster"))
    return lookup(named, of, "key", "id", how="inner").select("id", "cluster")


def near_any(df: DataFrame, id_col: str, held: Column, text: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Ids of rows that aren't held whose text equals or is near that of a held row: id, equal. A row is compared with the held rows of its buckets until one is near."""
    least = prefilter(threshold)

    def first(signs: np.ndarray, exact: Callable[[int, int], float], role: np.ndarray) -> list[tuple[int, int]]:
        mine = np.flatnonzero(role == 1)
        out = []
        if len(mine):
            for i in np.flatnonzero(role == 0).tolist():
                able = mine[(signs[mine] == signs[i]).mean(axis=1) >= least].tolist()
                hit = next((j for j in able if exact(i, j) >= threshold), None)
                if hit is not None:
                    out.append((i, hit))
        return out

    text = form_column("state") if text is None else text
    rows = cut(df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.coalesce(held, F.lit(False)).alias("held")).where("text <> ''").withColumn("key", F.unhex(F.md5("text"))))
    theirs = rows.where("held").select("key").distinct().withColumn("equal", F.lit(True))
    rest = lookup(rows.where("NOT held").select("id", "key"), theirs, "key", "id")
    open_ = rest.where("equal IS NULL").select("id").join(shuffled(rows.select("id", "text")), "id").withColumn("held", F.lit(False))
    both = open_.select("id", "text", F.lit(0).alias("role")).unionByName(rows.where("held").select("id", "text", F.lit(1).alias("role")))
    # a text on either side is compared once, under its least id
    sides = [signed(both.where(F.col("role") == r), "id", F.col("text"), sketch=True).withColumn("role", F.lit(r)) for r in (0, 1)]
    hits = _in_buckets(stored(sides[0].unionByName(sides[1])), first, np.uint8).select(F.col("a").alias("id")).distinct()
    near = lookup(open_.select("id", F.unhex(F.md5("text")).alias("key")), hits.join(shuffled(rows.select("id", "key")), "id").select("key", F.lit(True).alias("hit")), "key", "id", how="inner")
    return rest.where("equal").select("id", F.lit(True).alias("equal")).unionByName(near.select("id", F.lit(False).alias("equal")))


#: Texts of a cluster that one task goes through in order; larger clusters are decided in rounds.
PASS_TEXTS = 5_000


def greedy_kept(df: DataFrame, id_col: str, text: Column | None = None, threshold: float = THRESHOLD, pass_texts: int = PASS_TEXTS) -> DataFrame:
    """Ids that first-wins near-dedup keeps, in order of id: one is dropped if it is near an earlier one that is kept. Rows without a text are not kept; of rows of one text the first may be.

    Near is decided by the estimate, for texts that share a band, as in the pass that this follows; it isn't one per cluster. Texts that aren't tied by chains of
    near ones don't bear on each other, so each cluster is decided for itself: one of at most pass_texts by one ordered pass, a larger one in rounds.
    """

    def forest(signs: np.ndarray, exact: Callable[[int, int], float], role: np.ndarray) -> list[tuple[int, int]]:
        root = np.arange(len(signs))
        out = []
        for i in range(len(signs) - 1):
            for j in (np.flatnonzero((signs[i + 1 :] == signs[i]).mean(axis=1) >= threshold) + i + 1).tolist():
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    out.append((i, j))
        return out

    def passed(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        signs = np.stack([np.frombuffer(s, np.uint32) for s in group["signature"].to_pylist()])
        bands = np.stack(group["buckets"].to_numpy())
        kept: list[int] = []
        for i in range(len(signs)):
            if not kept or not ((signs[kept] == signs[i]).mean(axis=1) >= threshold)[(bands[kept] == bands[i]).any(axis=1)].any():
                kept.append(i)
        return pa.table({"id": group["id"].take(pa.array(kept))})

    reps = cut(signed(df, id_col, text).withColumns({"text": F.lit(""), "role": F.lit(0)}))  # the estimate needs no text
    tied = connected_components(_in_buckets(reps, forest).toDF("src", "dst"))
    sized = cut(tied.join(shuffled(tied.groupBy("component").agg(F.count(F.lit(1)).alias("n"))), "component").select(F.col("node").alias("id"), "component", "n"))
    alone = reps.select("id").join(shuffled(sized.select("id")), "id", "left_anti")
    small = sized.where(F.col("n") <= pass_texts).join(shuffled(reps.select("id", "signature", "buckets")), "id").select("component", "id", "signature", "buckets")
    out = alone.unionByName(small.groupBy("component").applyInArrow(passed, "id bigint"))
    large = reps.join(shuffled(sized.where(F.col("n") > pass_texts).select("id")), "id", "left_semi")
    return out.unionByName(_in_rounds(cut(large.select("id", "signature", "buckets")), threshold))


def _in_rounds(reps: DataFrame, threshold: float) -> DataFrame:
    """What an ordered pass keeps, whatever the size. In each round the ids that are least among the undecided of all their buckets are kept, and those near
    to them in a bucket are dropped: all that could drop such an id is decided by then. A bucket's members meet its least only, never each other."""
    left = cut(reps.select("id", F.explode("buckets").alias("bucket")))
    kept: list[DataFrame] = []

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([float((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean()) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    while not left.isEmpty():
        marked = cut(left.join(shuffled(left.groupBy("bucket").agg(F.min("id").alias("head"))), "bucket"))
        now = cut(marked.groupBy("id").agg(F.bool_and(F.col("id") == F.col("head")).alias("first")).where("first").select("id"))
        kept.append(now)
        pairs = marked.where("id <> head").join(shuffled(now.withColumnRenamed("id", "head")), "head").select("id", "head").distinct()
        near = pairs.join(shuffled(reps.select("id", "signature")), "id").join(shuffled(reps.select(F.col("id").alias("head"), F.col("signature").alias("head_signature"))), "head").where(alike("signature", "head_signature") >= threshold).select("id")
        left = cut(left.join(shuffled(now.unionByName(near).distinct()), "id", "left_anti"))
    out = reps.sparkSession.createDataFrame([], "id bigint")
    for now in kept:
        out = out.unionByName(now)
    return out
