"""The block join stores each set once, however many blocks it meets, and shuffles none to its tasks."""

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import blocks


@pytest.fixture
def stored(monkeypatch):
    """Folders that sets are stored in."""
    seen = []

    def new_folder(spark, kind, make=blocks.new_folder):
        seen.append(make(spark, kind))
        return seen[-1]

    monkeypatch.setattr(blocks, "new_folder", new_folder)
    return seen


SIZES = [(i, 10 + i % 4 * 3) for i in range(40)] + [(99, 1000)]


def able(n, m):
    return 0.7 * m <= n <= m


@pytest.mark.parametrize("apart", [False, True])
def test_sets_are_stored_once_and_all_that_can_be_near_meet_once(spark, stored, apart):
    def met(forms, rows, queries):
        for _, asked in queries:
            a, b = np.meshgrid(rows, asked)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(b.ravel())], names=["a", "b"])

    made = spark.createDataFrame([(i, "x" * n, n) for i, n in SIZES], "row_no bigint, form string, n int")
    asked = made.where("row_no % 2 = 0") if apart else made
    got = blocks.join_by_blocks(made, asked, lambda n: (0.7 * n, n), met, "a bigint, b bigint", 50, 60)
    assert "form" not in got._jdf.queryExecution().executedPlan().toString()
    assert [spark.read.parquet(x).count() for x in stored] == [made.count(), asked.count()][: 1 + apart]
    assert spark.read.parquet(stored[0]).select("block").distinct().count() > 10
    pairs = [(r.a, r.b) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    ask = {i: n for i, n in SIZES if not apart or i % 2 == 0}
    assert {(i, j) for i, n in SIZES for j, m in ask.items() if able(n, m)} <= set(pairs)
