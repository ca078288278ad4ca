"""The registered queries on the smallest tables; p8_found against its SQL."""

import sys
from pathlib import Path

import brute
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from checks import connection, rows  # noqa: E402

from sievework.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    pdf = got.toPandas()
    if name in queries.ORACLES:
        assert rows(pdf) == rows(duck.sql(queries.ORACLES[name]).df())
    table = lambda sql: duck.sql(sql).fetchall()
    want = {
        "p1_found": lambda: brute.p1(table("SELECT doc_id, text FROM documents"), table("SELECT id, state FROM eval_items")),
        "p2_found": lambda: brute.p2(table("SELECT row_no, state, question FROM corpus_records")),
        "p3_found": lambda: brute.p3(table("SELECT row_no, state FROM typed_questions UNION ALL SELECT row_no, state FROM corpus_records")),
        "p4_found": lambda: brute.p4(table("SELECT row_no, state, split FROM typed_questions")),
        "p5_found": lambda: brute.p5(table("SELECT row_no, source, group_key, state, split FROM typed_questions")),
    }.get(name)
    if want:
        columns = {"p1_found": ["doc_id", "item_id"], "p4_found": ["row_a", "row_b"]}.get(name, ["first_row", "row_no"])
        assert got.columns == columns
        assert sorted(pdf.itertuples(index=False, name=None)) == sorted(want())
