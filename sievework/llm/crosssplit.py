"""Same or near-same records across splits (problem 4).

Method: weighted cosine join. A state is a vector of term weights of length 1, its terms the grams of its form in one order, rarest first.
The train side is indexed by inverted lists of (vector, weight); a validation or test state adds up partial dot products over its
rarest terms. Bounds say how many terms either side needs, and which candidates are left: the greatest weight that any vector of the block has
(maximum weight), and the length of a vector without its first terms (residual norm). A partial dot product and the residual of either side
that still don't reach the threshold end a pair; what is left gets its exact dot product.

With equal weights inside a state the dot product of a and b is |a & b| / sqrt(|a| |b|), so a Jaccard similarity of t means a cosine of at
least 2t / (1 + t), and the exact dot product gives the Jaccard similarity back: near is decided exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.forms import form_column
from sievework.llm.blocks import INDEX_GRAMS, QUERY_GRAMS, Queries, Sets, join_by_blocks, kept, query_batches, set_size
from sievework.llm.grams import frequency_ranks, ordered, slices
from sievework.llm.groupsplit import split_name
from sievework.operators.skew import lookup
from sievework.session import cut

#: Dot product that a candidate must have gathered from the indexed terms alone. More means longer lists and fewer candidates.
MARGIN = 0.045
SLOT_BITS = 22
#: Postings that are read, and sums that are held, at once.
POSTINGS, CELLS = 8_000_000, 6_000_000
#: Queries of a batch.
BATCH = 128
_ROUND = 1e-9


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class CosineIndex:
    """Inverted lists of (vector, weight) over the rarest terms of unit vectors, for pairs with a dot product of at least threshold.

    vectors: ascending keys in the common order; weights: one for each of their elements, positive, each vector of length 1.
    query_largest: greatest weight that a term of a query can have. margin: what is kept of the threshold for the indexed terms at least.
    """

    def __init__(self, vectors: Sets, weights: np.ndarray, threshold: float, query_largest: float = 1.0, margin: float = MARGIN) -> None:
        self.vectors, self.weights, self.threshold, self.margin = vectors, weights, threshold, margin
        self.largest = float(weights.max())
        counts, self.residual = self.needed(vectors, weights, query_largest)
        terms, docs, place = vectors.firsts(counts)
        terms = _slots(terms)
        order = np.argsort(terms, kind="stable")
        self.docs = docs[order].astype(np.uint32)
        self.list_weights = weights[vectors.starts[docs] + place][order].astype(np.float32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=1 << SLOT_BITS))])

    def needed(self, vectors: Sets, weights: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
        """How many of each vector's first terms are needed, and the bound of what the others add. Of the terms beyond, either the residual norm, or their sum times the
        greatest weight on the other side, keeps the dot product below the threshold less the margin."""
        end = np.repeat(vectors.starts[1:], vectors.sizes)
        upto = np.concatenate([[0.0], np.cumsum(weights**2)])
        bound = np.sqrt(np.maximum(upto[end] - upto[:-1], 0))
        upto = np.concatenate([[0.0], np.cumsum(weights)])
        np.minimum(bound, (upto[end] - upto[:-1]) * largest, out=bound)
        open_ = np.concatenate([[0], np.cumsum(bound >= self.threshold - self.margin - _ROUND)])
        counts = open_[vectors.starts[1:]] - open_[vectors.starts[:-1]]
        at = np.minimum(vectors.starts[:-1] + counts, max(0, len(bound) - 1))
        return counts, np.where(counts < vectors.sizes, bound[at], 0.0)

    def candidates(self, queries: Sets, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) that the bounds leave. The terms that both have lie in both first parts, or beyond the one that ends first: so a pair's
        dot product is at most what it gathers here and the greater of the two residuals."""
        counts, residual = self.needed(queries, weights, self.largest)
        terms, query, place = queries.firsts(counts)
        terms = _slots(terms)
        length = self.ends[terms + 1] - self.ends[terms]
        n, load = len(self.vectors), np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum(counts)
        per = np.concatenate([[0], load[ends]])
        edges = np.unique(np.concatenate([[0], np.searchsorted(per, np.arange(POSTINGS, per[-1], POSTINGS)), np.arange(0, len(queries), max(1, CELLS // n)), [len(queries)]])).tolist()
        mine, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(edges[:-1], edges[1:]):
            s = slice(int(ends[a - 1]) if a else 0, int(ends[b - 1]))
            many = length[s]
            total = int(many.sum())
            if not total:
                continue
            at = np.repeat(self.ends[terms[s]] - (np.cumsum(many) - many), many) + np.arange(total)
            cell = np.repeat((query[s].astype(np.int64) - a) * n, many) + self.docs[at]
            gathered = np.bincount(cell, weights=np.repeat(weights[queries.starts[query[s]] + place[s]], many) * self.list_weights[at], minlength=(b - a) * n)
            hit = np.flatnonzero(gathered >= self.margin - 1e-6)
            q, d = hit // n + a, hit % n
            enough = gathered[hit] + np.maximum(residual[q], self.residual[d]) >= self.threshold - 1e-6
            mine.append(q[enough])
            other.append(d[enough])
        return np.concatenate(mine), np.concatenate(other)

    def dots(self, query: np.ndarray, weights: np.ndarray, which: np.ndarray, at_once: int = 2_000_000) -> np.ndarray:
        """Exact dot products of one query (ascending terms and their weights) with the vectors at which, so many elements at a time."""
        out = np.zeros(len(which))
        edges = np.unique(np.append(np.searchsorted(np.cumsum(self.vectors.sizes[which]), np.arange(0, int(self.vectors.sizes[which].sum()) + 1, at_once)), len(which)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            n = self.vectors.sizes[which[a:b]]
            first = np.cumsum(n) - n
            place = np.repeat(self.vectors.starts[which[a:b]] - first, n) + np.arange(int(n.sum()))
            at = np.searchsorted(query, self.vectors.all[place])
            at[at == len(query)] = 0
            out[a:b] = np.add.reduceat(np.where(query[at] == self.vectors.all[place], weights[at] * self.weights[place], 0.0), first)
        return out


def _even(sets: Sets) -> np.ndarray:
    return np.repeat(1 / np.sqrt(np.maximum(sets.sizes, 1)), sets.sizes)


def near_forms(train: DataFrame, held: DataFrame, threshold: float, index_grams: int = INDEX_GRAMS, query_grams: int = QUERY_GRAMS) -> DataFrame:
    """Pairs of a train form and a held-out form with a Jaccard similarity of at least threshold: train_rep, held_rep, similarity.

    train, held: row_no, form, n, each form once on its side. Exact; equal forms are pairs too.
    """
    spark = train.sparkSession
    ranks = spark.sparkContext.broadcast(frequency_ranks(train.select("form").unionByName(held.select("form")), "form"))  # a megabyte
    cosine = 2 * threshold / (1 + threshold)

    def work(forms: Iterator[pa.Array], rows: np.ndarray, asked: Queries) -> Iterator[pa.RecordBatch]:
        vectors = Sets(ordered(texts, ranks.value) for column in forms for texts in slices(column))
        index = CosineIndex(vectors, _even(vectors), cosine, 1 / np.sqrt(max(1.0, threshold * vectors.sizes.min())))
        for query_forms, query_rows in query_batches(asked, BATCH):
            queries = Sets([ordered(query_forms, ranks.value)])
            weights = _even(queries)
            mine, other = index.candidates(queries, weights)
            ends = np.searchsorted(mine, np.arange(len(queries) + 1))
            for q in np.unique(mine).tolist():
                n, which = len(queries[q]), other[ends[q] : ends[q + 1]]
                size = vectors.sizes[which]
                fits = np.minimum(size, n) >= threshold * np.maximum(size, n) - 1e-6
                which, size = which[fits], size[fits]
                if len(which):
                    common = np.rint(index.dots(queries[q], queries.of(weights, q), which) * np.sqrt(n * size.astype(np.float64)))
                    value = common / (n + size - common)
                    near = value >= threshold - 1e-12
                    yield pa.RecordBatch.from_arrays([pa.array(rows[which[near]], pa.int64()), pa.array(np.full(int(near.sum()), query_rows[q]), pa.int64()), pa.array(value[near], pa.float64())], names=["train_rep", "held_rep", "similarity"])

    return join_by_blocks(train, held, lambda n: (threshold * n, n / threshold), work, "train_rep bigint, held_rep bigint, similarity double", index_grams, query_grams)


#: Rows of one form that a join task takes.
ROWS_PER_SALT = 5_000


def _compared(df: DataFrame, threshold: float, id_col: str, state_col: str, split_col: str, source_col: str, sizes: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with a form and a split (row_no, form, split, source, held, key); one row per form and side (row_no, the least, n, rows); near pairs of these."""
    base = kept(
        df.select(F.col(id_col).cast("bigint").alias("row_no"), form_column(state_col).alias("form"), split_name(split_col).alias("split"), F.col(source_col).alias("source"))
        .where("form <> '' AND split IN ('train', 'validation', 'test')")
        .withColumns({"held": F.col("split") != "train", "key": F.unhex(F.md5("form"))})
    )
    per_form = kept(base.groupBy("form", "held").agg(F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("rows")).withColumns({"n": set_size("form"), "key": F.unhex(F.md5("form"))}))
    pairs = cut(near_forms(per_form.where("NOT held").select("row_no", "form", "n"), per_form.where("held").select("row_no", "form", "n"), threshold, **sizes))
    return base, per_form.drop("form"), pairs


def overlaps(df: DataFrame, threshold: float = 0.7, id_col: str = "row_no", state_col: str = "state", split_col: str = "split", source_col: str = "source", **sizes: int) -> DataFrame:
    """All pairs of a train row and a validation or test row with near or equal states.

    Columns: train_row, held_row, split (of the held-out row), train_source, held_source (forms), similarity.
    Splits are compared by name (val, dev, valid are validation); rows of another or no split, and states without letters and digits
    (null too), are in no pair. Each form is compared once on a side; pairs of rows come from joining the rows back, a form of many
    rows on either side dealt to several tasks in every join. Other columns are not read; row_no must be unique; an empty table gives no rows.
    """
    base, per_form, pairs = _compared(df, threshold, id_col, state_col, split_col, source_col, sizes)
    salts = F.ceil(F.col("rows") / ROWS_PER_SALT).cast("int")

    def members(held: bool, rep: str, row: str, source: str) -> tuple[DataFrame, DataFrame]:
        """Rows of the forms in pairs by (rep, salt), and the number of salts of each rep."""
        reps = pairs.select(F.col(rep).alias("row_no")).distinct().join(per_form.where(F.col("held") == held), "row_no").select(F.col("row_no").alias(rep), "key", salts.alias("salts"))
        rows = base.where(F.col("held") == held).select(F.col("row_no").alias(row), "key", F.col("source").alias(source), "split")
        joined = lookup(rows, reps, "key", row, how="inner").select(rep, F.pmod(F.xxhash64(row), F.col("salts")).cast("int").alias(f"{rep}_salt"), row, form_column(source).alias(source), F.col("split").alias(f"{rep}_split"))
        return joined, reps.select(rep, F.col("salts").alias(f"{rep}_salts"))

    train_rows, train_salts = members(False, "train_rep", "train_row", "train_source")
    held_rows, held_salts = members(True, "held_rep", "held_row", "held_source")
    spread = (
        pairs.join(train_salts, "train_rep").join(held_salts, "held_rep")
        .withColumn("train_rep_salt", F.explode(F.sequence(F.lit(0), F.col("train_rep_salts") - 1)))
        .withColumn("held_rep_salt", F.explode(F.sequence(F.lit(0), F.col("held_rep_salts") - 1)))
    )
    return (
        spread.join(train_rows, ["train_rep", "train_rep_salt"]).join(held_rows, ["held_rep", "held_rep_salt"])
        .select("train_row", "held_row", F.col("held_rep_split").alias("split"), "train_source", "held_source", "similarity")
    )


def overlaps_found(pairs: DataFrame) -> DataFrame:
    """row_a, row_b: the smaller and the greater row_no of each pair."""
    return pairs.select(F.least("train_row", "held_row").alias("row_a"), F.greatest("train_row", "held_row").alias("row_b"))


def counts(df: DataFrame, threshold: float = 0.7, id_col: str = "row_no", state_col: str = "state", split_col: str = "split", source_col: str = "source", **sizes: int) -> DataFrame:
    """Per split and source (form) of the held-out rows: pairs, pairs of equal states, held-out rows with a partner, train rows they have.

    Counted from pairs of forms and how many rows each form has, so copies aren't expanded into pairs. Rows are treated as in overlaps().
    """
    base, per_form, pairs = _compared(df, threshold, id_col, state_col, split_col, source_col, sizes)
    held = (
        base.where("held").groupBy("key", "split", "source").agg(F.count(F.lit(1)).alias("held_n"))
        .groupBy("key", "split", form_column("source").alias("source")).agg(F.sum("held_n").alias("held_n"))
        .join(per_form.where("held").select("key", F.col("row_no").alias("held_rep")), "key").select("held_rep", "split", "source", "held_n")
    )
    train = per_form.where("NOT held").select(F.col("row_no").alias("train_rep"), F.col("rows").alias("train_n"))
    both = cut(pairs.join(train, "train_rep").join(held, "held_rep"))
    each = both.groupBy("split", "source").agg(F.sum(F.col("train_n") * F.col("held_n")).alias("pairs"), F.sum(F.when(F.col("similarity") == 1, F.col("train_n") * F.col("held_n")).otherwise(0)).alias("equal_pairs"))
    held_rows = both.select("split", "source", "held_rep", "held_n").distinct().groupBy("split", "source").agg(F.sum("held_n").alias("held_rows"))
    train_rows = both.select("split", "source", "train_rep", "train_n").distinct().groupBy("split", "source").agg(F.sum("train_n").alias("train_rows"))
    return each.join(held_rows, ["split", "source"]).join(train_rows, ["split", "source"])
