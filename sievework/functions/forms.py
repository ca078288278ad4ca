"""Forms, words, character grams and basic tokens of texts, a batch at a time.

Unicode normalisation and full case folding have no Spark built-in, so these run on Arrow batches in Python.
Every function takes nulls (as the empty text) and whole texts of any length.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 5

_WORD = re.compile(r"[^\W_]+")  # on every code point the same as categories L and N; a test holds the two together
_BLANK, _ALNUM, _IDEOGRAPH, _SYMBOL, _DROPPED = range(5)
# fixed values: the blocks that the public BERT basic tokenizer takes for CJK ideographs
IDEOGRAPHS = (
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2F800, 0x2FA1F),
)


@lru_cache(1)
def _format_characters() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf") + "]")


def words(text: str | None) -> list[str]:
    """The words of a text's form; none for a null text."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    if _format_characters().search(text):
        text = _format_characters().sub("", text)
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def form(text: str | None) -> str:
    """Drop format characters, NFKC, full case folding, runs of anything but letters and digits to one space, trimmed."""
    return " ".join(words(text))


_END = "\ue000"  # not a letter, and left alone by normalisation and folding; in a text it's as good as a space


def forms(texts: list[str | None]) -> list[str]:
    """form() of many texts at once."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size > 1_000_000:
            out += _forms(held)
            held, size = [], 0
    return out + _forms(held) if held else out


def _forms(texts: list[str]) -> list[str]:
    whole = "".join(texts)
    if whole.isascii():
        points = code_points(_END.join(texts).lower())
    else:
        if _END in whole:
            texts = [t.replace(_END, " ") for t in texts]
        whole = _END.join(texts)
        hidden = _formats()[code_points(whole)]
        if hidden.any():
            whole = code_points(whole)[~hidden].tobytes().decode("utf-32-le", "surrogatepass")
        points = code_points(unicodedata.normalize("NFKC", whole).casefold())
    end = np.flatnonzero(points == ord(_END))
    kept = _letters()[points]
    at = np.flatnonzero(kept)
    if not len(at):
        return [""] * len(texts)
    # texts' ends among the kept characters
    ends = np.concatenate([np.searchsorted(at, end), [len(at)]])
    opens = np.empty(len(at), bool)
    opens[0] = False
    opens[1:] = at[1:] != at[:-1] + 1
    begins = np.concatenate([[0], ends[:-1]])
    opens[begins[begins < len(at)]] = False
    place = np.cumsum(opens)
    place += np.arange(len(at))
    line = np.full(place[-1] + 1, ord(" "), np.uint32)
    line[place] = points[at]
    text = line.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[place[a] : place[b - 1] + 1] if b > a else "" for a, b in zip(begins.tolist(), ends.tolist())]


def form_array(texts: pa.Array) -> pa.Array:
    return pa.array(forms(texts.to_pylist()), pa.string())


def form_column(column: Column | str) -> Column:
    """The form of a string column; null has the empty form."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return form_array(texts)

    return of(F.col(column) if isinstance(column, str) else column)


def folded_words(text: str) -> str:
    """NFC, full case folding, runs of anything but letters and digits (underscores and combining marks too) to one space, trimmed."""
    return " ".join(_WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).casefold()))


def folded_column(column: Column | str) -> Column:
    """folded_words() of a string column; null stays null."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else folded_words(t) for t in texts.to_pylist()], pa.string())

    return of(F.col(column) if isinstance(column, str) else column)


def key_hashes(word_lists: list[list[str]], n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of n words, and the row of each. short: a list of fewer words is one run.

    Equal runs have equal hashes on any machine. Two different runs share one with a chance of 2**-64.
    """
    lengths = np.array([len(w) for w in word_lists], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = pd.util.hash_array(np.array([w for ws in word_lists for w in ws], object))
    starts = np.cumsum(lengths) - lengths
    out, owner = [], []
    if len(flat) >= n:
        every = _mixed(flat, n)
        many = np.maximum(lengths - n + 1, 0)
        at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out.append(every[at])
        owner.append(np.repeat(np.arange(len(lengths)), many))
    if short:
        for i in np.flatnonzero((lengths > 0) & (lengths < n)).tolist():
            out.append(_mixed(flat[starts[i] : starts[i] + lengths[i]], int(lengths[i])))
            owner.append(np.array([i]))
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(points: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all substrings of a length."""
    n = len(points) - length + 1
    h = points[:n] + np.uint64(length)
    for i in range(1, length):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a form's substrings of GRAM characters, in text order with repeats; of a shorter form, one hash of the whole."""
    points = code_points(text).astype(np.uint64)
    return _mixed(points, min(GRAM, len(points))) if len(points) else points


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """gram_hashes() of many forms, one after the other, and how many each has."""
    points = code_points("".join(texts)).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lengths) - lengths
    n = np.maximum(lengths - GRAM + 1, np.minimum(lengths, 1))
    if len(points) < GRAM:
        return np.concatenate([gram_hashes(t) for t in texts]) if texts else points, n
    every = np.concatenate([_mixed(points, GRAM), np.zeros(GRAM - 1, np.uint64)])
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    out = every[at]
    for i in np.flatnonzero((lengths > 0) & (lengths < GRAM)).tolist():
        out[n[:i].sum()] = gram_hashes(texts[i])[0]
    return out, n


@lru_cache(1)
def _formats() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == "Cf" for c in range(0x110000)])


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, _SYMBOL, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            table[c] = _ALNUM
        elif kind[0] == "Z" or chr(c) in "\t\n\r\v\f" or chr(c).isspace():
            table[c] = _BLANK
        elif kind in ("Cc", "Cf") or c == 0xFFFD:
            table[c] = _DROPPED
    for low, high in IDEOGRAPHS:
        table[low : high + 1] = _IDEOGRAPH
    return table


def _starts(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens start. first: the texts' first positions. Dropped characters neither are nor break a token."""
    kept = np.flatnonzero(kinds != _DROPPED) if (kinds == _DROPPED).any() else None
    k = kinds if kept is None else kinds[kept]
    after = np.zeros(len(k), bool)
    after[1:] = k[:-1] == _ALNUM
    if kept is None:
        after[first[first < len(k)]] = False
    else:
        at = np.searchsorted(kept, first)
        after[at[at < len(k)]] = False
    start = (k == _IDEOGRAPH) | (k == _SYMBOL) | ((k == _ALNUM) & ~after)
    if kept is None:
        return start
    out = np.zeros(len(kinds), bool)
    out[kept] = start
    return out


def token_starts(text: str) -> np.ndarray:
    """Code-point positions at which the text's basic tokens start."""
    return np.flatnonzero(_starts(_classes()[code_points(text)], np.zeros(1, np.int64))) if text else np.zeros(0, np.int64)


def token_counts(texts: pa.Array) -> np.ndarray:
    """Number of basic tokens of each text: an ideograph is one, another run of letters and digits is one, any other non-blank character is one."""
    out: list[np.ndarray] = []
    rows, held = [], 0
    for t in texts.to_pylist():
        rows.append(t or "")
        held += len(rows[-1])
        if held > 4_000_000:
            out.append(_count(rows))
            rows, held = [], 0
    return np.concatenate([*out, _count(rows)])


def _count(rows: list[str]) -> np.ndarray:
    if not rows:
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    total = np.concatenate([[0], np.cumsum(_starts(_classes()[code_points("".join(rows))], first[:-1]))])
    return total[first[1:]] - total[first[:-1]]


def token_count_column(column: Column | str) -> Column:
    """Basic tokens of a string column as bigint; 0 for null and blank texts."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(token_counts(texts), pa.int64())

    return of(F.col(column) if isinstance(column, str) else column)
