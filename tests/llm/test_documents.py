"""Problems 6 to 8."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.forms import token_starts
from sievework.llm import cutting, mixing, packing


def text(rng, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(["word", "x", "中", "文字", "42", "it's"]) + rng.choice([" ", " ", " ", ". ", "。", "\n", "\n\n", "\r\n\r\n", "\n## Head\n"]))
    return "".join(out)


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(3)
    sizes = [int(rng.paretovariate(0.9) * 5) % 3000 for _ in range(300)]
    rows = [(i, text(rng, n), rng.choice(["Big", "big ", "BIG", "mid", "small", None, "unlisted"])) for i, n in enumerate(sizes)]
    rows += [(900, None, "big"), (901, "", "big"), (902, " \n", "mid"), (903, "a" * 50_000, "mid"), (904, "中" * 7000, "small"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4).withColumns({"tokens": F.lit("clash"), "part": F.lit("clash"), "bin": F.lit("clash")})
    return rows, df


@pytest.mark.parametrize(("limit", "overlap"), [(100, 10), (64, 0), (8, 7), (1, 0)])
def test_cut(documents, limit, overlap):
    rows, df = documents
    pieces = cutting.cut_texts(df, limit, overlap).toPandas()
    by_id = {}
    for d, t, _ in rows:
        by_id.setdefault(d, t)
    over = {d for d, t in by_id.items() if len(token_starts(t or "")) > limit}
    assert set(pieces.doc_id) == over and over
    for d, group in pieces[pieces.doc_id != 5].groupby("doc_id"):
        t, starts = by_id[d], token_starts(by_id[d])
        group = group.sort_values("piece_no")
        assert group.piece_no.tolist() == list(range(len(group)))
        assert group.begin.iloc[0] == 0 and group.end.iloc[-1] == len(t)
        assert (group.tokens <= limit).all()
        for r in group.itertuples():
            assert r.text == t[r.begin : r.end] and len(token_starts(r.text)) == r.tokens
        for a, b in itertools.pairwise(group.itertuples()):
            assert ((starts >= b.begin) & (starts < a.end)).sum() == overlap


def best_plan(n, at, penalty, limit, overlap):
    """Least cost over all sets of cuts."""
    best = float("inf")
    for r in range(len(at) + 1):
        for chosen in itertools.combinations(range(len(at)), r):
            stops = [0, *(at[i] for i in chosen), n]
            sizes = [b - a + (overlap if a else 0) for a, b in itertools.pairwise(stops)]
            if max(sizes) <= limit:
                best = min(best, sum(penalty[i] for i in chosen) + sum(cutting.IMBALANCE * (1 - s / limit) ** 2 for s in sizes))
    return best


def test_plan_is_the_best():
    rng = random.Random(8)
    for _ in range(60):
        n, limit = rng.randrange(12, 60), rng.randrange(10, 30)
        overlap = rng.randrange(0, 4)
        at = np.array(sorted(rng.sample(range(1, n), min(n - 1, 9))))
        if max(np.diff([0, *at, n])) > limit - overlap:
            continue
        penalty = np.array([rng.choice([0.0, 0.2, 0.5, 1.0]) for _ in at])
        spans = cutting.plan(n, at, penalty, limit, overlap)
        if n <= limit:
            assert spans == [(0, n)]
            continue
        cost = sum(cutting.IMBALANCE * (1 - (b - a) / limit) ** 2 for a, b in spans) + sum(penalty[list(at).index(b)] for _, b in spans[:-1])
        assert cost == pytest.approx(best_plan(n, at, penalty, limit, overlap))


def test_boundaries():
    t = "One two. Three\nfour\n\nfive\n# Head\nsix"
    at, penalty = cutting.boundaries(t, token_starts(t))
    words = [t[s : s + 3] for s in token_starts(t)]
    assert {(words[a], p) for a, p in zip(at, penalty)} == {("Thr", 1.0), ("fou", 0.5), ("fiv", 0.2), ("# H", 0.0), ("six", 0.5)}


def test_bad_overlap(documents):
    with pytest.raises(ValueError):
        cutting.cut_texts(documents[1], 10, 10)


@pytest.mark.parametrize("shard", [40, 50_000])
@pytest.mark.parametrize("top_up", [True, False])
def test_pack(documents, shard, top_up, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", shard)
    rows, df = documents
    capacity = 256
    got = packing.pack(df, capacity, 16, top_up=top_up).toPandas()
    sizes = {d: len(token_starts(t or "")) for d, t, _ in rows}
    assert got.groupby("doc_id").tokens.sum().to_dict() == {d: n * (2 if d == 5 else 1) for d, n in sizes.items()}
    whole = got[got.container.notna()]
    assert (got[got.container.isna()].tokens == 0).all() and (whole.tokens > 0).all()
    assert whole.groupby("container").tokens.sum().max() <= capacity
    assert (got[got.doc_id.map(sizes) <= capacity].part == 0).all()
    for _, group in whole.groupby("container"):
        group = group.sort_values("place")
        assert group.place.tolist() == [0, *np.cumsum(group.tokens)[:-1]]
    if top_up and shard > 1000:
        assert whole.tokens.sum() / (whole.container.nunique() * capacity) > 0.97


def test_bucket_bounds_are_the_best():
    rng = np.random.default_rng(6)
    for _ in range(20):
        h = rng.integers(0, 4, 14)
        h[0] = 5
        k = int(rng.integers(1, 5))
        sizes = [s for s in range(1, 14) if h[s]]
        cost = lambda bounds: sum(h[s] * (min(b for b in bounds if b >= s) - s) for s in sizes)  # noqa: B023, E731
        least = min((cost(c) for r in range(1, min(k, len(sizes)) + 1) for c in itertools.combinations(sizes, r) if max(c) == max(sizes)), default=0)
        bounds = packing.bucket_bounds(h, k)
        assert len(bounds) <= k and (cost(bounds) == least if sizes else bounds == [])


def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("gone", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")


def test_mix(spark, documents):
    rows, df = documents
    plans = mixing.plan_mix(df, targets(spark))
    got = mixing.mix(df, plans).toPandas()
    assert got.position_key.is_monotonic_increasing and set(got.source) == {"big", "mid", "small"}
    assert {p.source: p.tokens for p in plans}["gone"] == 0
    cap = {p.source: p.max_repeats for p in plans}
    assert (got.repeats <= got.source.map(cap)).all() and (got["copy"] < got.repeats).all() and (got.tokens > 0).all()
    for p in plans:
        used = got[got.source == p.source].tokens.sum()
        biggest = max([len(token_starts(t or "")) for _, t, s in rows if (s or "").strip().lower() == p.source], default=0)
        assert abs(used - p.goal) <= biggest * max(1, p.max_repeats)
    shown = {r.source: r for r in mixing.shares(df, plans).collect()}
    assert sum(r.actual_share for r in shown.values()) == pytest.approx(1) and shown["gone"].used_tokens == 0
    assert mixing.mix(df, plans).select("doc_id", "copy").toPandas().equals(got[["doc_id", "copy"]])


def test_mix_of_an_exact_size(spark, documents):
    plans = mixing.plan_mix(documents[1], targets(spark))
    exact = mixing.largest_exact(plans)
    again = mixing.plan_mix(documents[1], targets(spark), exact)
    live = sum(p.share for p in again if p.tokens)
    assert all(p.goal == pytest.approx(exact * p.share / live) for p in again if p.tokens)


def test_fill_shares():
    assert mixing.fill_shares({"a": 1.0, "b": 1.0}, {"a": 2.0, "b": 100.0}, 10) == {"a": 2.0, "b": 8.0}
    assert mixing.fill_shares({"a": 1.0, "b": 0.5}, {"a": 2.0, "b": 1.0}, 10) == {"a": 2.0, "b": 1.0}
    assert mixing.fill_shares({"a": 1.0}, {"a": 0.0}, 10) == {"a": 0.0}


def test_thresholds_grow_with_the_mean():
    last = [1.0] * 3
    for mean in (0.0, 0.1, 0.5, 1, 2, 5, 50, float("inf")):
        now = mixing.poisson_thresholds(mean, 3)
        assert all(a <= b for a, b in zip(now, last)) and now == sorted(now)
        last = now


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    blank = spark.createDataFrame([(1, None, None), (2, "", "big")], none.schema)
    for df in (none, blank):
        assert cutting.oversized(cutting.cut_texts(df, 10, 2)).count() == 0
        report = packing.fill_report(df, 10).collect()
        assert {r.top_up for r in report} == {True, False} and all(r.containers == 0 and r.fill is None for r in report) and packing.totals(packing.pack(df, 10), 10).first().tokens == 0
        assert packing.pack(df, 10).where("container IS NOT NULL").count() == 0 and packing.pack(df, 10).count() == df.count()
        plans = mixing.plan_mix(df, targets(spark))
        assert mixing.mix(df, plans).count() == 0 and mixing.shares(df, plans).count() == 4
