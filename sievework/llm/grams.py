"""Sets of character grams in a common order, rarest first: what the similarity joins of problems 3 and 4 work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.forms import grams_of

#: Grams are counted in so many buckets. The counts only order them, so shared buckets cost time, not results.
ORDER_BITS = 20


def frequency_ranks(df: DataFrame, column: str) -> np.ndarray:
    """For each of 2**ORDER_BITS buckets of grams, how frequent it is among the forms in a column: 0..255, steps of an eighth of an octave.

    Counts cover all rows. Each partition sends one sum per bucket at most; the result is a megabyte, whatever the input.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                sums += np.bincount(bucket(ordered(texts)[0]), minlength=1 << ORDER_BITS)
        at = np.flatnonzero(sums)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000], pa.int32()), pa.array(sums[at[i : i + 100_000]], pa.int64())], names=["bucket", "n"])

    sums = df.select(column).mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    table = sums.toArrow()
    ranks = np.zeros(1 << ORDER_BITS, np.uint8)
    ranks[table["bucket"].to_numpy()] = np.minimum(255, np.log2(table["n"].to_numpy()) * 8)
    return ranks


def slices(texts: pa.Array, characters: int = 500_000) -> Iterator[list[str]]:
    """Forms, so many characters at a time; null as the empty form."""
    held, size = [], 0
    for text in texts.to_pylist():
        held.append(text or "")
        size += len(held[-1])
        if size > characters:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def ordered(texts: list[str], ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of each form as 64-bit keys, ascending: rarest first, the same order for every text. All keys, and how many each form has.

    A key is the gram's rank and 56 bits of its hash, so equal grams have equal keys. Without ranks a key is the whole hash.
    """
    keys, n = grams_of(texts)
    if ranks is not None:
        rank = ranks[bucket(keys)].astype(np.uint64)
        keys >>= np.uint64(8)
        keys |= rank << np.uint64(56)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        keys[a:b].sort()
    if not len(keys):
        return keys, n
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[(ends - n)[n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return keys[new], kept[ends] - kept[ends - n]


def ordered_set(text: str, ranks: np.ndarray) -> np.ndarray:
    return ordered([text], ranks)[0]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common elements of two ascending sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
