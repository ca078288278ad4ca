"""Splitting oversized texts at natural boundaries (problem 8).

Method: dynamic programming over boundary positions. Boundaries are headings, paragraphs, lines and sentence ends,
each with a penalty; inside a stretch without any that is longer than a piece may be, every token start is one, with a high penalty.
Among all sequences of boundaries whose pieces keep within the limit, the one with the least sum of penalties and size imbalance is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.forms import token_counts, token_starts

#: Penalty of a cut before a heading, a paragraph, a line, a sentence, any other token; and the weight of size imbalance.
PENALTIES = (0.0, 0.2, 0.5, 1.0, 8.0)
IMBALANCE = 4.0

_HEADING = re.compile(r"(?:\r\n|\r|\n)(?=[ \t]*(?:#{1,6}[ \t]|[^\r\n]{1,80}(?:\r\n|\r|\n)[ \t]*(?:={3,}|-{3,})[ \t]*(?:[\r\n]|$)))")
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*)+")
_LINE = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*[ \t 　]+|[。！？][”’」』）]*[ \t　]*")


def boundaries(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural cuts of a text as ascending token indexes with their penalties; a cut is before that token. Neither 0 nor the end is among them."""
    best = np.full(len(starts) + 1, np.inf)
    for pattern, penalty in ((_SENTENCE, PENALTIES[3]), (_LINE, PENALTIES[2]), (_PARAGRAPH, PENALTIES[1]), (_HEADING, PENALTIES[0])):
        at = np.searchsorted(starts, np.fromiter((m.end() for m in pattern.finditer(text)), np.int64))
        best[at] = np.minimum(best[at], penalty)
    at = np.flatnonzero(np.isfinite(best[1:-1])) + 1
    return at, best[at]


def plan(n_tokens: int, at: np.ndarray, penalty: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces as (first token, token after the last), in order.

    at, penalty: natural cuts. Each piece but the first begins overlap tokens before the cut that ends the one before;
    no piece has more than limit tokens, its overlap included. Of equally good plans that with the earlier cuts is taken.
    """
    if n_tokens <= limit:
        return [(0, n_tokens)] if n_tokens else []
    step = limit - overlap
    stops = np.concatenate([[0], at, [n_tokens]])
    cost = np.concatenate([[0.0], penalty, [0.0]])
    wide = np.diff(stops) > step
    if wide.any():  # a stretch without a natural cut: every token may be one
        many = np.append(np.where(wide, np.diff(stops), 1), 1)
        first = np.repeat(np.cumsum(many) - many, many)
        inside = np.arange(int(many.sum())) - first
        cost = np.where(inside == 0, np.repeat(cost, many), PENALTIES[4])
        stops = np.repeat(stops, many) + inside
    total = np.full(len(stops), np.inf)
    back = np.zeros(len(stops), np.int64)
    total[0] = 0.0
    low = np.searchsorted(stops, stops - step)
    for j in range(1, len(stops)):
        sizes = stops[j] - stops[low[j] : j] + overlap
        each = total[low[j] : j] + IMBALANCE * (1 - sizes / limit) ** 2
        if stops[j] <= limit:  # the first piece has no overlap, so it may be longer
            each = np.concatenate([[IMBALANCE * (1 - stops[j] / limit) ** 2], each[int(low[j] == 0) :]])
            k = int(np.argmin(each))
            back[j] = 0 if k == 0 else (low[j] if low[j] else 1) + k - 1
        else:
            k = int(np.argmin(each))
            back[j] = low[j] + k
        total[j] = each[k] + cost[j]
    cuts = [len(stops) - 1]
    while cuts[-1]:
        cuts.append(int(back[cuts[-1]]))
    cuts = cuts[::-1]
    return [(max(0, int(stops[a]) - (overlap if a else 0)), int(stops[b])) for a, b in zip(cuts, cuts[1:])]


def cut_texts(df: DataFrame, max_tokens: int, overlap_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the texts with more than max_tokens basic tokens.

    Columns: doc_id, piece_no (from 0), begin and end (code points, end exclusive), tokens, text.
    A piece has at most max_tokens tokens; each but the first begins exactly overlap_tokens tokens before the end of the one before it.
    Pieces join up: the first begins at 0 and the last ends with the text. Null, empty, blank and short texts give no piece;
    rows with equal ids are cut each for itself; other columns are not read. Needs 0 <= overlap_tokens < max_tokens.
    No row leaves its partition: there is no shuffle.
    """
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    kind = df.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in ("row", "piece_no", "begin", "end", "tokens", "text")}
            for row in np.flatnonzero(token_counts(batch.column(1)) > max_tokens).tolist():
                text = batch.column(1)[row].as_py()
                starts = token_starts(text)
                spans = plan(len(starts), *boundaries(text, starts), max_tokens, overlap_tokens)
                edges = np.concatenate([starts, [len(text)]])
                edges[0] = 0
                for i, (a, b) in enumerate(spans):
                    begin, end = int(edges[a]), int(edges[b])
                    for name, x in zip(rows, (row, i, begin, end, b - a, text[begin:end])):
                        rows[name].append(x)
            of = batch.column(0).take(pa.array(rows.pop("row"), pa.int64()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([of, *(pa.array(x, k) for x, k in zip(rows.values(), kinds))], names=["doc_id", *rows])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(pieces, f"doc_id {kind}, piece_no int, begin bigint, end bigint, tokens int, text string")


def oversized(pieces: DataFrame) -> DataFrame:
    """Ids of the texts that had to be cut, one row each."""
    return pieces.where(F.col("piece_no") == 0).select("doc_id").distinct()
