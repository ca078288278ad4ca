"""Size blocks: how a similarity join's sets meet, each query with those blocks only whose sizes allow the similarity.

Sets are ranged by size into blocks of at most INDEX_GRAMS elements. Each set is stored once, in its block's files in the shared folder; a task is told
which blocks to read: one as its index, and of others the queries, QUERY_GRAMS or so. A set meets more blocks the more there are, but it is read
again, not copied or shuffled: the disk that a join takes follows its sets. No task's input grows with the data, a size that many sets share
is split over several blocks, and no pair of sets is dropped: what can't be similar by size never meets, all else does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.grams import ordered, slices
from sievework.session import new_folder, qualified

INDEX_GRAMS = 15_000_000
QUERY_GRAMS = 45_000_000
#: Greatest size in a block over its least. Bounds that hold for a whole block are as good as this is small.
RATIO = 1.3

#: A task: forms and row numbers of its index, and batches of the same of its queries, which are read as they are asked for; gives batches.
Queries = Iterator[tuple[pa.Array, np.ndarray]]
Work = Callable[[Iterator[pa.Array], np.ndarray, Queries], Iterator[pa.RecordBatch]]


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: compressed columns, no lineage."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_size(column: str):  # noqa: ANN201
    """Number of distinct grams of a form."""

    @F.arrow_udf("int")
    def of(forms: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(ordered(texts)[1] for texts in slices(forms))]), pa.int32())

    return of(F.col(column))


def _sizes(df: DataFrame) -> dict[int, int]:
    return dict(sorted((n, c) for n, c in df.groupBy("n").count().toLocalIterator()))


def _blocks(sizes: dict[int, int], most: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Blocks as (least size, greatest size), and (size, its first block, number of its blocks): a size with more sets than a block holds has blocks of its own."""
    blocks: list[tuple[int, int]] = []
    own: list[tuple[int, int, int]] = []
    held, waiting = 0, []

    def close() -> None:
        nonlocal held, waiting
        if waiting:
            own.extend((n, len(blocks), 1) for n in waiting)
            blocks.append((waiting[0], waiting[-1]))
        held, waiting = 0, []

    for n, c in sizes.items():
        if held + c * n > most or (waiting and n > RATIO * waiting[0]):
            close()
        if c * n > most:
            many = -(-c * n // most)
            own.append((n, len(blocks), many))
            blocks.extend([(n, n)] * many)
        else:
            waiting.append(n)
            held += c * n
    close()
    return blocks, own


def _stored(df: DataFrame, own: list[tuple[int, int, int]], blocks: int) -> str:
    """Where the sets of df lie, each once, by block."""
    spark = df.sparkSession
    path = qualified(spark, new_folder(spark, "blocks"))
    spread = F.pmod(F.xxhash64("row_no"), F.lit(1 << 30)).cast("int")
    places = F.broadcast(spark.createDataFrame(own, "n int, own_block int, own_blocks int"))  # a row per size
    placed = df.join(places, "n").select("row_no", "form", "n", (F.col("own_block") + spread % F.col("own_blocks")).alias("block"))
    placed.repartitionById(blocks, F.col("block")).write.partitionBy("block").parquet(path)
    return path


def _read(folder: str, block: int) -> Iterator[pa.RecordBatch]:
    """row_no, form, n of a block's sets."""
    files, path = fs.FileSystem.from_uri(folder)
    for info in sorted(files.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(8_192, columns=["row_no", "form", "n"], use_threads=False)


def join_by_blocks(index: DataFrame, queries: DataFrame, reach: Callable[[int], tuple[float, float]], work: Work, schema: str, index_grams: int = INDEX_GRAMS, query_grams: int = QUERY_GRAMS) -> DataFrame:
    """work for every task. index, queries: row_no, form, n (number of distinct grams).

    reach(n): least and greatest size of index sets that a query of n grams can be similar to.
    The driver holds one number per set size, of which there are no more than the longest text has characters, and the blocks of each task.
    """
    spark = index.sparkSession
    there = _sizes(index)
    asked = there if queries is index else _sizes(queries)
    blocks, own = _blocks(there, index_grams)
    if not blocks or not asked:
        return spark.createDataFrame([], schema)
    ask_blocks, ask_own = (blocks, own) if queries is index else _blocks(asked, index_grams)
    lows, highs = np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
    load = np.zeros((len(blocks), len(ask_blocks)))
    least, most = np.full(len(blocks), np.iinfo(np.int32).max), np.zeros(len(blocks), np.int64)
    for n, first, many in ask_own:
        low, high = reach(n)
        a, b = int(np.searchsorted(highs, low - 1e-6)), int(np.searchsorted(lows, high + 1e-6, side="right"))
        if a < b:
            load[a:b, first : first + many] += asked[n] * n / many
            np.minimum(least[a:b], n, out=least[a:b])
            np.maximum(most[a:b], n, out=most[a:b])
    # a task: an index block, query blocks, the least and the greatest size of its queries
    tasks: list[tuple[int, int, list[int], int, int]] = []
    for i in range(len(blocks)):
        meets = np.flatnonzero(load[i])
        if len(meets):
            chunk = (np.cumsum(load[i, meets]) - load[i, meets] / 2) * max(1, -(-load[i].sum() // query_grams)) // load[i].sum()
            tasks += [(len(tasks) + k, i, meets[chunk == c].tolist(), int(least[i]), int(most[i])) for k, c in enumerate(np.unique(chunk))]
    if not tasks:
        return spark.createDataFrame([], schema)
    index_at = _stored(index, own, len(blocks))
    asked_at = index_at if queries is index else _stored(queries, ask_own, len(ask_blocks))

    def asking(of: list[int], low: int, high: int) -> Queries:
        for block in of:
            for batch in _read(asked_at, block):
                n = batch.column(2).to_numpy()
                fits = batch.filter(pa.array((n >= low) & (n <= high)))
                if fits.num_rows:
                    yield fits.column(1), fits.column(0).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                indexed = list(_read(index_at, task["index_block"]))
                if indexed:
                    yield from work((b.column(1) for b in indexed), np.concatenate([b.column(0).to_numpy() for b in indexed]), asking(task["query_blocks"], task["low"], task["high"]))

    told = spark.createDataFrame(tasks, "task int, index_block int, query_blocks array<int>, low int, high int")
    return told.repartitionById(len(tasks), F.col("task")).mapInArrow(run, schema)


def query_batches(queries: Queries, size: int) -> Iterator[tuple[list[str], np.ndarray]]:
    for forms, rows in queries:
        for start in range(0, len(rows), size):
            yield forms.slice(start, size).to_pylist(), rows[start : start + size]


class Sets:
    """Many ascending sets in one array."""

    def __init__(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        keys, sizes = zip(*parts)
        self.all, self.sizes = np.concatenate(keys), np.concatenate(sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.all[self.starts[i] : self.starts[i + 1]]

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(self.__getitem__, range(len(self)))

    def of(self, values: np.ndarray, i: int) -> np.ndarray:
        """The i-th set's part of values, one for each element of all sets."""
        return values[self.starts[i] : self.starts[i + 1]]

    def part(self, first: int, last: int) -> Sets:
        """The sets from first up to last, without copying elements."""
        out = object.__new__(Sets)
        out.all, out.sizes = self.all[self.starts[first] : self.starts[last]], self.sizes[first:last]
        out.starts = self.starts[first : last + 1] - self.starts[first]
        return out

    def overlaps(self, keys: np.ndarray, which: np.ndarray, at_once: int = 2_000_000) -> np.ndarray:
        """Number of elements that the ascending keys share with each of the sets at which, so many elements at a time."""
        out = np.zeros(len(which), np.int64)
        edges = np.unique(np.append(np.searchsorted(np.cumsum(self.sizes[which]), np.arange(0, int(self.sizes[which].sum()) + 1, at_once)), len(which)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            n = self.sizes[which[a:b]]
            first = np.cumsum(n) - n
            theirs = self.all[np.repeat(self.starts[which[a:b]] - first, n) + np.arange(int(n.sum()))]
            at = np.searchsorted(keys, theirs)
            at[at == len(keys)] = 0
            out[a:b] = np.add.reduceat((keys[at] == theirs).astype(np.int64), first)
        return out

    def firsts(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first so many elements of each set: the elements, whose they are, their places."""
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        return self.all[self.starts[owner] + place], owner, place
