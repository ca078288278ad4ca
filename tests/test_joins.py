"""Joins whose sides grow with the input, on tables that Spark's estimate takes for small: none may be gathered by the driver."""

import pytest
from checks import broadcast_joins
from pyspark.sql import functions as F

from sievework import session
from sievework.operators import clusters, components, items, minhash, texts


@pytest.fixture
def broadcasts(monkeypatch):
    """Broadcast joins of each table that is cut."""
    seen = []

    def cut(df):
        seen.append(broadcast_joins(df))
        return session.cut(df)

    for module in (clusters, components, minhash):
        monkeypatch.setattr(module, "cut", cut)
    return seen


@pytest.fixture
def few(spark, tmp_path):
    """Three questions in a file; two of the states are near each other."""
    state = "The first report names one valve. It was closed at noon, and nobody opened it again before the evening."
    rows = [(1, state, "Which valve was closed?", "a"), (2, state.replace("noon", "nine"), "Who opened it?", "b"), (3, "Another text. It says nothing of a pump.", "Which pump?", "a")]
    spark.createDataFrame(rows, "row_no bigint, state string, instructions string, source string").write.parquet(f"{tmp_path}/few.parquet")
    return spark.read.parquet(f"{tmp_path}/few.parquet")


def test_support_sentences(few):
    got = texts.support_sentences(few, "row_no", "state", "instructions")
    assert broadcast_joins(got) == 0
    assert {(r.id, r.place) for r in got.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_evidence_removed(few):
    got = items.without_support(few, "row_no", "state", "instructions", 1)
    assert broadcast_joins(got) == 0
    assert {(r.key, r.place) for r in got.collect()} == {(1, 0), (2, 1), (3, 1)}


def test_near_clusters(few, broadcasts):
    got = minhash.clusters(few, "row_no", F.col("state"))
    assert broadcast_joins(got) == sum(broadcasts) == 0
    assert {(r.id, r.cluster) for r in got.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_components_in_rounds(spark, tmp_path, broadcasts):
    spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "src bigint, dst bigint").write.parquet(f"{tmp_path}/edges.parquet")
    got = components.connected_components(spark.read.parquet(f"{tmp_path}/edges.parquet"), 0)
    assert broadcast_joins(got) == sum(broadcasts) == 0
    assert {(r.node, r.component) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}


def test_buckets_of_the_same_members_are_compared_once(spark):
    reps = spark.createDataFrame([(1, "abcdef", b"0000", [5, 6, 7], 0), (2, "abcdeg", b"0000", [5, 6, 8], 0), (3, "x", b"1111", [8], 0)], "id bigint, text string, signature binary, buckets array<bigint>, role int")
    pairs = minhash._in_buckets(reps, lambda signs, exact, role: [(0, 1)]).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(1, 2), (2, 3)]


def test_report(few, broadcasts):
    by_source, shared = clusters.report(few, "row_no", F.col("state"))
    assert broadcast_joins(by_source) == broadcast_joins(shared) == sum(broadcasts) == 0
    assert {tuple(r) for r in by_source.collect()} == {("a", 1, 1, 1), ("b", 1, 1, 1)}
    assert [tuple(r) for r in shared.collect()] == [("a", "b", 1)]


def test_cluster_split_and_leakage(few, broadcasts):
    split = clusters.cluster_split(few, "row_no", F.col("state"), "source")
    leakage = clusters.split_leakage(split)
    assert broadcast_joins(split) == broadcast_joins(leakage) == sum(broadcasts) == 0
    assert {(r.id, r.domain, r.cluster) for r in split.collect()} == {(1, "a", 1), (2, "b", 1), (3, "a", 3)}
    assert {(r.domain, r.n, r.clusters, r.torn) for r in leakage.collect()} == {("a", 2, 2, 0), ("b", 1, 1, 0)}


@pytest.mark.parametrize("pass_texts", [1, 10])
def test_greedy(few, broadcasts, pass_texts):
    got = minhash.greedy_kept(few, "row_no", F.col("state"), pass_texts=pass_texts)
    assert broadcast_joins(got) == sum(broadcasts) == 0
    assert {r.id for r in got.collect()} == {1, 3}


def test_clusters_in_waves(spark, few, broadcasts, monkeypatch):
    monkeypatch.setattr(minhash, "WAVE_ROWS", 0)
    seen = []

    def in_buckets(reps, *more, made=minhash._in_buckets):
        seen.append(max(len(r.signature) for r in reps.collect()))
        return made(reps, *more)

    monkeypatch.setattr(minhash, "_in_buckets", in_buckets)
    leakage = clusters.split_leakage(clusters.cluster_split(few, "row_no", F.col("state"), "source"))
    assert broadcast_joins(leakage) == sum(broadcasts) == 0
    assert {(r.domain, r.n, r.clusters, r.torn) for r in leakage.collect()} == {("a", 2, 2, 0), ("b", 1, 1, 0)}
    assert seen == [minhash.PERMUTATIONS]  # a byte for each value, not four
    assert len(broadcasts) == 4 + minhash.WAVES  # each wave's pairs are cut
