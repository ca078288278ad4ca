"""Duplicates hidden by formatting differences (problem 2).

Method: every pair of a normalised field name and its value is hashed; the hashes of a record's fields are combined by
addition modulo 2**128, which doesn't depend on their order; records are grouped by this fingerprint, and each copy is
compared with the first of its group field by field: fields are looked up, never sorted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.forms import form
from sievework.operators.skew import lookup
from sievework.session import cut

#: Rows of one group that a task compares.
PART_ROWS = 5_000
_ALL = (1 << 128) - 1
_NOTHING = object()


def _parsed(question: str | None) -> Any:
    """The JSON value of a question, or _NOTHING if it's null or doesn't parse."""
    if question is None:
        return _NOTHING
    try:
        return json.loads(question, parse_float=Decimal, parse_int=Decimal, parse_constant=_refuse)
    except (ValueError, RecursionError, ArithmeticError):
        return _NOTHING


def _refuse(name: str) -> None:
    raise ValueError(name)


_short_form = lru_cache(100_000)(form)


def _form(text: str) -> str:
    return _short_form(text) if len(text) < 64 else form(text)


def _hash(kind: bytes, data: bytes) -> int:
    return xxhash.xxh3_128_intdigest(kind + data)


def _number(value: Decimal) -> str:
    """One text for each number, whatever zeros it was written with."""
    sign, digits, exponent = value.as_tuple()
    plain = "".join(map(str, digits)).lstrip("0")
    short = plain.rstrip("0")
    return f"{sign}:{short}:{exponent + len(plain) - len(short)}" if short else "0"


def value_hash(value: Any) -> int:
    """128-bit hash of a JSON value: of an object the same for any order of its fields, of an array not; strings and names by form."""
    if isinstance(value, str):
        return _hash(b"s", _form(value).encode("utf-8", "surrogatepass"))
    if isinstance(value, dict):
        total = len(value)
        for name, inner in value.items():
            total += _hash(b"f", _form(name).encode("utf-8", "surrogatepass") + b"\0" + value_hash(inner).to_bytes(16, "big"))
        return _hash(b"o", (total & _ALL).to_bytes(16, "big"))
    if isinstance(value, list):
        return _hash(b"a", b"".join(value_hash(x).to_bytes(16, "big") for x in value))
    if value is None or value is True or value is False:
        return _hash(b"c", str(value).encode())
    return _hash(b"n", _number(value).encode())


def same_value(a: Any, b: Any) -> bool:
    """Whether two JSON values are equal, strings and names by form. Fields are looked up, not sorted."""
    if isinstance(a, str) or isinstance(b, str):
        return isinstance(a, str) and isinstance(b, str) and _form(a) == _form(b)
    if isinstance(a, list) or isinstance(b, list):
        return isinstance(a, list) and isinstance(b, list) and len(a) == len(b) and all(map(same_value, a, b))
    if isinstance(a, dict) or isinstance(b, dict):
        if not (isinstance(a, dict) and isinstance(b, dict) and len(a) == len(b)):
            return False
        there: dict[str, list[Any]] = {}
        for name, inner in b.items():
            there.setdefault(_form(name), []).append(inner)
        for name, inner in a.items():
            left = there.get(_form(name), [])
            k = next((i for i, x in enumerate(left) if same_value(inner, x)), None)
            if k is None:
                return False
            left.pop(k)
        return True
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
        return a is b
    return a == b


def fingerprint(state: str | None, question: str | None) -> bytes | None:
    """Fingerprint of a record; None if it can't have copies: no words in its state, or a question that is null or doesn't parse."""
    words = form(state)
    value = _parsed(question) if words else _NOTHING
    if value is _NOTHING:
        return None
    try:
        total = _hash(b"state\0", words.encode("utf-8", "surrogatepass")) + _hash(b"question\0", value_hash(value).to_bytes(16, "big"))
    except RecursionError:  # nested deeper than Python goes: as good as not parsing
        return None
    return (total & _ALL).to_bytes(16, "big")


class _Records:
    """The different records among rows of one fingerprint, the first of each; rows come in order of their number."""

    def __init__(self) -> None:
        self.key: Any = None
        self.firsts: list[tuple[int, str, Any]] = []

    def of(self, key: Any, row_no: int, state: str | None, question: str | None) -> int:
        """The first row that is equal to this one: itself, if there is none."""
        if key != self.key:
            self.key, self.firsts = key, []
        words, value = form(state), _parsed(question)
        for first, there, other in self.firsts:
            if there == words and same_value(value, other):
                return first
        self.firsts.append((row_no, words, value))
        return row_no


def records(df: DataFrame, id_col: str = "row_no", state_col: str = "state", question_col: str = "question", bits: int = 128, part_rows: int = PART_ROWS) -> DataFrame:
    """The record that each row is a copy of. Columns: row_no, first_row (the least row_no of the copies), comparable.

    Copies have equal forms of their states and equal questions as JSON, names and strings compared by form, field order left aside.
    A row without words in its state, or whose question is null or doesn't parse, is not comparable: it is a record of its own.
    Numbers are compared by value (1 and 1.0 are equal, 1 and true aren't); of equal names in one object the last counts.
    Other columns are not read; row_no must be unique. An empty table gives no rows.
    bits: of the fingerprint that are used; fewer only make more work for the comparison, the result stays.

    Groups are counted by fingerprint alone. All texts are shuffled once, to find those of groups of two and more; these are shuffled once more, to
    parts of part_rows rows or so of one group, the group's first row to each of its parts. In a part rows are compared with the first, field by field. Rows that
    share a fingerprint by accident are records of their own: found at once in a group of one part, else in another round over such rows.
    """

    @F.arrow_udf("binary")
    def print_of(states: pa.Array, questions: pa.Array) -> pa.Array:
        out = (fingerprint(s, q) for s, q in zip(states.to_pylist(), questions.to_pylist()))
        return pa.array([x if x is None or bits == 128 else (int.from_bytes(x, "big") >> (128 - bits)).to_bytes(16, "big") for x in out], pa.binary())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Records()
        for batch in batches:
            prints, part, parts, first, row_no, state, question = (c.to_pylist() for c in batch.columns)
            equal = [seen.of(key, *row) for key, row in zip(zip(prints, part), zip(row_no, state, question))]
            # of a group in several parts only what is equal to its first row is known
            known = [e if n == 1 or e == f else None for e, n, f in zip(equal, parts, first)]
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(known, pa.int64()), batch.column(0)], names=["row_no", "first_row", "print"])

    base = df.select(F.col(id_col).cast("bigint").alias("row_no"), F.col(state_col).alias("state"), F.col(question_col).alias("question"))
    prints = cut(base.select("row_no", print_of("state", "question").alias("print")))
    open_, found = prints.where("print IS NOT NULL"), []
    while True:
        # rows of a hot group are counted on the map side, and find their group by a salted join
        groups = open_.groupBy("print").agg(F.min("row_no").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        copies = lookup(open_, groups, "print", "row_no", how="inner").withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
        mine = F.when(F.col("row_no") == F.col("first"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row_no"), F.col("parts")).cast("int")))
        texts = base.join(copies, "row_no").select("print", F.explode(mine).alias("part"), "parts", "first", "row_no", "state", "question")
        checked = cut(texts.repartition("print", "part").sortWithinPartitions("print", "part", "row_no").mapInArrow(compared, "row_no bigint, first_row bigint, print binary"))
        found.append(checked.where("first_row IS NOT NULL AND first_row <> row_no").select("row_no", "first_row"))
        open_ = checked.where("first_row IS NULL").select("row_no", "print")
        if open_.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return prints.select("row_no", F.col("print").isNotNull().alias("comparable")).join(every, "row_no", "left").select("row_no", F.coalesce("first_row", "row_no").alias("first_row"), "comparable")


def copies_found(records_df: DataFrame) -> DataFrame:
    """One row per copy other than the first: first_row, row_no."""
    return records_df.where("first_row <> row_no").select("first_row", "row_no")


def collapsed(records_df: DataFrame) -> DataFrame:
    """One row per distinct record: first_row, copies, comparable."""
    return records_df.groupBy("first_row").agg(F.count(F.lit(1)).alias("copies"), F.bool_and("comparable").alias("comparable"))
