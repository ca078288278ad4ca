"""Evaluation texts leaking into training text (problem 1).

Method: latent semantic retrieval. Passages of all documents are TF-IDF vectors over the words of the held-out items. A distributed randomised
decomposition gives each word a place: every passage of every document is added, with a random sign, to one of SKETCH_ROWS rows (a sparse
embedding of the passage-word matrix), the rows are summed over the cluster, weighted by inverse frequency and decomposed; a word's
place is its row of the right singular vectors, and RESIDUAL directions of what these leave out. A passage's place is the sum of its words'.
Passages of documents are candidates for those passages of items to which their cosine is high enough; an index of cells, opened by an exact bound, finds
them. Then words are compared: consecutive equal words for verbatim stretches; for paraphrases the longest common subsequence of the
aligned stretches, and the words that carry the item's answer.

A word that no item has is orthogonal to every item: it adds to a passage's length (as much as an average word), not to any dot product. The
vocabulary is thus that of the items; items of more than ITEM_WORDS words are taken in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.forms import forms, words
from sievework.llm.blocks import kept

#: Words of items whose passages are broadcast at a time.
ITEM_WORDS = 1_000_000
#: Directions of the decomposition, of what it leaves out, and rows of the sketch.
DIMENSIONS, RESIDUAL, SKETCH_ROWS = 48, 16, 256
#: Words of a passage that the space is fitted on, and of one that is searched for paraphrases.
FIT_WORDS, PASSAGE_WORDS = 10, 16
#: Cells of the items' passages, times the square root of their number.
CELLS = 4
#: Partial sketches that are added up by one task.
SUMMANDS = 64
_BATCH_WORDS, _CHUNK = 400_000, 20_000
_UNKNOWN, _NOTHING, _BETWEEN_ITEMS = -1, -2, -3


@dataclass(frozen=True)
class Space:
    """number: of each word of the vocabulary; idf: its weight; place: its place; passages: how many were counted."""

    number: dict[str, int]
    idf: np.ndarray
    place: np.ndarray
    passages: int


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _several(items: Iterator[tuple], size: Callable[[tuple], int], most: int) -> Iterator[list[tuple]]:
    """Items in lists of about so much size."""
    held, n = [], 0
    for item in items:
        held.append(item)
        n += size(item)
        if n > most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _tokenised(documents: DataFrame, number: dict[str, int], doc_id: str, text_col: str) -> DataFrame:
    """One pass over the documents, kept in the shared folder: their words as numbers, and each partition's sums over its passages.

    Columns: doc_id, words (numbers as bytes, _UNKNOWN for other words), part (a row of the sketch, -1 for the frequencies, null for documents), partition, block.
    """
    spark, size = documents.sparkSession, len(number)
    shared = spark.sparkContext.broadcast(number)
    kind, narrow = documents.schema[doc_id].dataType.simpleString(), np.dtype("<i2" if size < 1 << 15 else "<i4")
    schema = f"doc_id {kind}, words binary, part int, partition int, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, ids_type = shared.value.get, None
        frequency, sketch = np.zeros(size + 1, np.int64), np.zeros(SKETCH_ROWS * size, np.int32)

        def count(held: list[tuple[int, np.ndarray]]) -> None:
            lengths = np.array([len(n) for _, n in held])
            word = np.concatenate([n for _, n in held])
            of = np.repeat(np.arange(len(held)), lengths)
            inside = (np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // FIT_WORDS
            many = -(-lengths // FIT_WORDS)
            passage = (np.cumsum(many) - many)[of] + inside
            frequency[-1] += int(many.sum())
            once = np.unique((passage * size + word)[word >= 0])
            p, w = once // size, once % size
            frequency[:size] += np.bincount(w, minlength=size)
            draw = _mixed(np.repeat(np.array([s for s, _ in held], np.int64).view(np.uint64), many) + np.uint64(0x9E3779B97F4A7C15) * (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + 1).astype(np.uint64))
            row, sign = (draw % np.uint64(SKETCH_ROWS)).astype(np.int64), np.where(draw >> np.uint64(63), 1.0, -1.0)
            sketch[:] += np.bincount(row[p] * size + w, weights=sign[p], minlength=len(sketch)).astype(np.int32)

        def numbered(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            for seed, text in zip(batch.column(2).to_pylist(), forms(batch.column(1).to_pylist())):
                found = text.split(" ") if text else []
                yield seed, np.fromiter((get(w, _UNKNOWN) for w in found), narrow, len(found))

        for batch in batches:
            ids_type, out = batch.schema.field(0).type, []
            for held in _several(numbered(batch), lambda x: len(x[1]), _BATCH_WORDS):
                out += [n.tobytes() for _, n in held]
                if size:
                    count(held)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "words", "part", "partition", "block"])
        if ids_type is not None:
            rows = [frequency.tobytes(), *(r.tobytes() for r in sketch.reshape(SKETCH_ROWS, size))]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, ids_type), pa.nulls(n, pa.binary()), pa.array(range(-1, n - 1), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(rows, pa.binary())],
                names=["doc_id", "words", "part", "partition", "block"],
            )

    return kept(documents.select(doc_id, text_col, F.xxhash64(doc_id)).mapInArrow(run, schema))


def _summed(table: DataFrame) -> dict[int, np.ndarray]:
    """The partitions' blocks added up by part, SUMMANDS at a time; at most SKETCH_ROWS + 1 of a vocabulary's length come to the driver."""

    def add(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        total = sum(np.frombuffer(b, np.int64 if part < 0 else np.int32) for b in group["block"].to_pylist())
        return pa.table({"part": pa.array([part], pa.int32()), "partition": pa.array([group["partition"][0].as_py() // SUMMANDS], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    now, left = table.where("part IS NOT NULL").select("part", "partition", "block"), table.select(F.max("partition")).first()[0] or 0
    while True:
        now = now.groupBy("part", (F.col("partition") / SUMMANDS).cast("int").alias("several")).applyInArrow(add, "part int, partition int, block binary")
        left //= SUMMANDS
        if not left:
            break
    rows = now.toArrow()
    return {p: np.frombuffer(b, np.int64 if p < 0 else np.int32) for p, b in zip(rows["part"].to_pylist(), rows["block"].to_pylist())}


def _space(number: dict[str, int], sums: dict[int, np.ndarray], seed: int) -> Space:
    size = len(number)
    frequency = sums.get(-1, np.zeros(size + 1, np.int64))
    passages = int(frequency[-1])
    idf = np.log((passages + 1) / (frequency[:-1] + 1)) + 1
    sketch = np.zeros((SKETCH_ROWS, size))
    for part, row in sums.items():
        if part >= 0:
            sketch[part] = row
    _, values, right = np.linalg.svd(sketch * idf, full_matrices=False)
    rank = min(DIMENSIONS, int((values > 1e-9 * max(values.max(initial=0.0), 1e-300)).sum()))
    basis = right[:rank].T
    latent = np.zeros((size, DIMENSIONS))
    latent[:, :rank] = basis * idf[:, None] / np.maximum(values[:rank], 1e-300)
    draw = np.random.default_rng(seed).choice([-1.0, 1.0], (size, RESIDUAL)) / np.sqrt(RESIDUAL)
    rest = (draw - basis @ (basis.T @ draw)) * idf[:, None]
    # both parts of a word's place count as much as the parts of its vector
    own = np.linalg.norm(basis * idf[:, None], axis=1).mean() if size else 0.0
    latent *= own / max(np.linalg.norm(latent, axis=1).mean() if size else 0.0, 1e-300)
    return Space(number, idf, np.hstack([latent, rest]).astype(np.float32), passages)


class CellIndex:
    """Places of passages in cells of similar ones, found by cosine without loss.

    A cell has a centre and the greatest angle of a member to it. By the triangle inequality of angles a place can have the cosine asked for to a
    member only if its angle to the centre is at most that of the cosine and the cell's together; only such cells are opened, and all their members compared.
    """

    def __init__(self, places: np.ndarray, cosine: float, seed: int = 3) -> None:
        self.cosine = cosine
        unit = _unit(places)
        n = len(unit)
        self.centres = unit[np.random.default_rng(seed).permutation(n)[: int(np.ceil(CELLS * np.sqrt(n)))]]
        for _ in range(4):
            cell, near = self._nearest(unit)
            sums = np.zeros(self.centres.shape)
            np.add.at(sums, cell, unit)
            used = np.bincount(cell, minlength=len(sums)) > 0
            self.centres = np.where(used[:, None], _unit(sums), self.centres).astype(np.float32)
        cell, near = self._nearest(unit)
        self.order = np.argsort(cell, kind="stable")
        self.members = unit[self.order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(self.centres)))])
        least = np.ones(len(self.centres))
        np.minimum.at(least, cell, near)
        angle = np.arccos(np.clip(least, -1, 1)) + np.arccos(min(cosine, 1.0)) + 1e-3
        self.reach = np.where(angle < np.pi, np.cos(np.minimum(angle, np.pi)), -2.0).astype(np.float32)

    def _nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, near = np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for s in range(0, len(unit), _CHUNK):
            score = unit[s : s + _CHUNK] @ self.centres.T
            cell[s : s + _CHUNK] = score.argmax(axis=1)
            near[s : s + _CHUNK] = score.max(axis=1)
        return cell, near

    def near(self, places: np.ndarray, lengths: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (row of places, row of the index, cosine), each once. lengths, 1 at least: what a place's length is to be multiplied by."""
        unit = _unit(places)
        least = np.broadcast_to(np.float32(self.cosine - 1e-5) * lengths, len(unit)).astype(np.float32)
        opened = self.centres @ unit.T >= self.reach[:, None]
        mine, other, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for cell in np.flatnonzero(opened.any(axis=1)).tolist():
            rows = np.flatnonzero(opened[cell])
            first = int(self.ends[cell])
            score = unit[rows] @ self.members[first : self.ends[cell + 1]].T
            a, b = np.nonzero(score >= least[rows, None])
            mine.append(rows[a])
            other.append(self.order[first + b])
            value.append(score[a, b])
        at = np.concatenate(mine)
        return at, np.concatenate(other), np.concatenate(value) / np.broadcast_to(lengths, len(unit))[at]


def _unit(places: np.ndarray) -> np.ndarray:
    return (places / np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class _Items:
    """A block of items: all their words, the passages that are searched for, and whose they are."""

    def __init__(self, block: list[tuple], number: dict[str, int], width: int, step: int, short: bool) -> None:
        line, starts, sizes, owner, bounds = [np.full(width, _BETWEEN_ITEMS)], [], [], [], []
        at = width
        for i, (_, text, *_) in enumerate(block):
            numbers = np.array([number[w] for w in words(text)], np.int64)
            n = len(numbers)
            if n >= width or (short and n):
                own = np.unique(np.append(np.arange(0, max(1, n - width + 1), step), max(0, n - width)))
                starts.append(at + own)
                sizes.append(np.full(len(own), min(n, width)))
                owner.append(np.full(len(own), i))
            line += [numbers, np.full(width, _BETWEEN_ITEMS)]
            bounds.append((at, at + n))
            at += n + width
        self.line, self.bounds = np.concatenate(line), bounds
        self.starts, self.sizes, self.owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, owner))

    def places(self, place: np.ndarray, width: int) -> np.ndarray:
        return _sums(self.line, self.starts, place, width)


def _sums(line: np.ndarray, starts: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Places of passages of width words; numbers below 0 add nothing."""
    padded = np.vstack([place, np.zeros((1, place.shape[1]), np.float32)])
    out = np.zeros((len(starts), place.shape[1]), np.float32)
    for j in range(width):
        out += padded[np.maximum(line[starts + j], -1)]
    return out




def _retrieved(table: DataFrame, space: Space, items: _Items, width: int, step: int, cosine: float, short: bool, check: Callable[..., dict[str, list]], schema: str) -> DataFrame:
    """check()'s rows for all candidates: passages of documents and of items whose cosine reaches the one asked for."""
    spark = table.sparkSession
    index = CellIndex(items.places(space.place, width), cosine)
    sent = spark.sparkContext.broadcast((space.place, index))
    narrow = np.dtype("<i2" if len(space.number) < 1 << 15 else "<i4")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, index = sent.value
        for batch in batches:
            texts = ((i, np.frombuffer(b, narrow)) for i, b in enumerate(batch.column(1).to_pylist()) if b)
            for held in _several(texts, lambda x: len(x[1]), _BATCH_WORDS):
                lengths = np.array([len(n) for _, n in held])
                line = np.concatenate([np.full(width, _NOTHING), *(x for _, n in held for x in (n, np.full(width, _NOTHING)))])
                begin = width + np.cumsum(lengths + width) - (lengths + width)
                fits = lengths >= width
                many = np.where(fits, (lengths - width) // step + 1 + ((lengths - width) % step > 0), int(short))
                doc = np.repeat(np.arange(len(held)), many)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                starts = begin[doc] + np.minimum(k * step, np.maximum(lengths[doc] - width, 0))
                known = np.concatenate([[0], np.cumsum(line >= 0)])
                known = known[starts + width] - known[starts]
                total = np.minimum(lengths[doc], width)
                # a cosine of what is known, times the square root of its share
                able = np.flatnonzero((known > 0) & (known >= cosine**2 * total - 1e-9))
                rows: dict[str, list] = {}
                for s in range(0, len(able), _CHUNK):
                    some = able[s : s + _CHUNK]
                    mine, other, value = index.near(_sums(line, starts[some], place, width), np.sqrt(total[some] / known[some]))
                    for name, column in check(line, begin, lengths, doc[some[mine]], starts[some[mine]], other, value).items():
                        rows.setdefault(name, []).extend(column)
                if rows.get("doc_id"):
                    ids = batch.column(0).take(pa.array([held[d][0] for d in rows["doc_id"]], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(rows[c], pa.string() if c == "item_id" else pa.float64()) for c in names[1:])], names=names)

    return table.where("part IS NULL AND words IS NOT NULL").select("doc_id", "words").mapInArrow(search, schema)


def _blocks(documents: DataFrame, items: DataFrame, columns: list[str], doc_id: str, text_col: str, seed: int = 11) -> Iterator[tuple[list[tuple], DataFrame, Space]]:
    """The items, a block at a time, with the documents' words in their vocabulary and the space fitted on them."""
    rows = items.select(*columns).where(F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull()).orderBy(*columns).toLocalIterator()
    for block in _several(map(tuple, rows), lambda r: len(r[1]) // 5 + 1, ITEM_WORDS):
        vocabulary = sorted({w for r in block for w in words(r[1])})
        if vocabulary:
            number = {w: i for i, w in enumerate(vocabulary)}
            table = _tokenised(documents, number, doc_id, text_col)
            yield block, table, _space(number, _summed(table), seed)


def verbatim(documents: DataFrame, items: DataFrame, least_words: int = 10, cosine: float = 0.95, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "id", item_text: str = "state") -> DataFrame:
    """Documents that contain at least least_words consecutive words of an item, by form: doc_id, item_id, one row per pair.

    Documents' passages, a third of least_words apart, are long enough for any such stretch to hold one of them whole; items' passages start at every word. A pair
    of passages with the cosine asked for is a candidate; words before, in and after it are then compared. A passage
    that a stretch holds whole has a cosine of 1, so none is missed, whatever the cosine asked for. Null and empty texts and items, and
    items of fewer words, give no rows; repeated rows of documents or items give a pair once; other columns are not read. No text
    leaves its partition but as numbers in the shared folder.
    """
    step = max(1, least_words // 3)
    width = least_words + 1 - step
    kind = documents.schema[doc_id].dataType.simpleString()
    out = documents.sparkSession.createDataFrame([], f"doc_id {kind}, item_id string")
    for block, table, space in _blocks(documents, items, [item_id, item_text], doc_id, text_col):
        own = _Items(block, space.number, width, 1, False)
        names = np.array([r[0] for r in block], object)

        def check(line, begin, lengths, doc, start, other, value, own=own, names=names):  # noqa: ANN001, ANN202
            q = own.starts[other]
            same = np.ones(len(q), bool)
            for j in range(width):
                same &= line[start + j] == own.line[q + j]
            doc, start, q, other = doc[same], start[same], q[same], other[same]
            run = np.full(len(q), width)
            for way, edge in ((-1, 0), (1, width - 1)):
                on = np.ones(len(q), bool)
                for j in range(1, least_words - width + 1):
                    on &= line[start + edge + way * j] == own.line[q + edge + way * j]
                    run += on
            enough = run >= least_words
            pairs = sorted(set(zip(doc[enough].tolist(), own.owner[other[enough]].tolist())))
            return {"doc_id": [d for d, _ in pairs], "item_id": [names[i] for _, i in pairs]}

        if len(own.starts):
            out = out.unionByName(_retrieved(table, space, own, width, step, cosine, False, check, f"doc_id {kind}, item_id string"))
    return out.distinct()


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & whole
    return len(a) - v.bit_count()


def paraphrases(documents: DataFrame, items: DataFrame, cosine: float = 0.8, common: float = 0.6, answer: float = 0.5, least_words: int = 8, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "id", item_text: str = "state", answer_col: str | None = None) -> DataFrame:
    """Documents with a stretch that says what a stretch of an item says, word for word or not.

    Columns: doc_id, item_id, passages (pairs of passages found), cosine, common, answer_share (the best of each).
    Passages of PASSAGE_WORDS words, four apart in documents and two apart in items, are candidates if their cosine reaches cosine; shorter texts are one passage. The item's passage is
    then aligned with the document's words from half a passage before to half a passage after. It counts if the longest common
    subsequence covers at least common of the item's passage and has least_words words (or all, if it has fewer), and if at least answer of the words that carry the answer
    stand in the document's stretch: the words of answer_col if given and not empty, else the rarest quarter of the different words of the item's passage. So a leak
    of a part of an item counts as one of the whole, and neither check depends on how large the corpus is. Nulls, empty texts, repeated
    rows and other columns are treated as in verbatim().
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id string, cosine double, common double, answer_share double"
    out = documents.sparkSession.createDataFrame([], schema)
    width, step = PASSAGE_WORDS, PASSAGE_WORDS // 4
    for block, table, space in _blocks(documents, items, [item_id, item_text, *([answer_col] if answer_col else [])], doc_id, text_col):
        own = _Items(block, space.number, width, PASSAGE_WORDS // 8, True)
        pieces = [own.line[s : s + n].tolist() for s, n in zip(own.starts.tolist(), own.sizes.tolist())]
        carriers = []
        for piece, i in zip(pieces, own.owner.tolist()):
            told = {space.number[w] for w in words(block[i][2]) if w in space.number} if answer_col else set()
            inside = np.unique(piece)
            weight = space.idf[inside]
            carriers.append(told or set(inside[weight >= np.sort(weight)[-max(1, len(weight) // 4)] - 1e-9].tolist()))
        names = [block[i][0] for i in own.owner.tolist()]

        def check(line, begin, lengths, doc, start, other, value, pieces=pieces, carriers=carriers, names=names):  # noqa: ANN001, ANN202
            rows: dict[str, list] = {"doc_id": [], "item_id": [], "cosine": [], "common": [], "answer_share": []}
            low = np.maximum(start - width // 2, begin[doc])
            high = np.minimum(start + width + width // 2, (begin + lengths)[doc])
            for d, a, b, q, c in zip(doc.tolist(), low.tolist(), high.tolist(), other.tolist(), value.tolist()):
                stretch = line[a:b].tolist()
                there, piece = set(stretch), pieces[q]
                carried = len(carriers[q] & there) / len(carriers[q])
                if carried < answer or sum(w in there for w in piece) < common * len(piece):
                    continue
                shared = lcs_length(piece, stretch)
                if shared >= common * len(piece) and shared >= min(least_words, len(piece)):
                    for name, x in zip(rows, (d, names[q], c, shared / len(piece), carried)):
                        rows[name].append(x)
            return rows

        if len(own.starts):
            out = out.unionByName(_retrieved(table, space, own, width, step, cosine, True, check, schema))
    return out.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("passages"), F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.max("answer_share").alias("answer_share")
    )
