"""Problems 1 to 5 against all pairs, on tables with nulls, empty and long texts, ties, repeats and columns of clashing names."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import blocks, crosssplit, formatdup, groupsplit, leakage, neardup

WORDS = "amber brook cedar delta ember flint grove harbor island jasper kettle lumen meadow north otter pebble quartz river stone timber umber velvet willow yarrow zephyr Straße naïve 中文 текст".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text):
    words = text.split(" ")
    for _ in range(rng.randrange(1, 4)):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], [rng.choice(WORDS)], [words[i], rng.choice(WORDS)]])
    if rng.random() < 0.3:
        k = rng.randrange(len(words))
        words = words[k:] + words[:k]
    return rng.choice([str.upper, str.lower, lambda t: t.replace(" ", " -- "), str])(" ".join(words) or "x")


def states(rng, n):
    out = [None, "", " -- ", "a", "ab", "abc de", "x" * 3000, "x" * 3000 + " y"]
    while len(out) < n:
        out.append(edited(rng, rng.choice(out[8:])) if len(out) > 20 and rng.random() < 0.6 else sentence(rng, rng.randrange(3, 40)))
    return out


CLASHING = ["n", "key", "task", "role", "form", "salt", "held", "print"]


def with_clashes(df):
    return df.withColumns({c: F.lit("other") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(11)
    rows = []
    for i, s in enumerate(states(rng, 160)):
        split = rng.choice(["train", " Train", "val", "dev ", "TEST", "validation", None, "", "held back"])
        group = rng.choice([None, "", "G-1", "g 1", "hub", "hub", "hub", f"g{i}"])
        rows.append((1000 - i, s, split, rng.choice(["src", "SRC ", "other", None]), group))
    df = spark.createDataFrame(rows, "row_no bigint, state string, split string, source string, group_key string").repartition(5)
    return rows, with_clashes(df)


SMALL = [{}, {"index_grams": 2000, "query_grams": 3000}, {"index_grams": 200, "query_grams": 300}]


@pytest.mark.parametrize("sizes", SMALL)
@pytest.mark.parametrize("extra", [1, 16])
def test_near_groups(spark, questions, sizes, extra):
    rows, df = questions
    half = df.where("row_no % 2 = 0"), df.where("row_no % 2 = 1")
    reps = neardup.representatives(*((h, "row_no", "state") for h in half))
    got = neardup.near_groups(reps, 0.7, extra=extra, **sizes)
    want = brute.p3([(r[0], r[1]) for r in rows])
    assert {(r.first_row, r.row_no) for r in neardup.near_found(got).collect()} == want and len(want) > 20
    assert got.count() == len({brute.form(r[1]) for r in rows} - {""})
    linked = {r.row_no for r in got.where("links > 0").collect()}
    assert linked == {x for pair in want for x in pair}


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_links_at_other_thresholds(spark, questions, threshold):
    rows, df = questions
    reps = neardup.representatives((df, "row_no", "state"))
    got = {(r.a, r.b) for r in neardup.links(reps, threshold, index_grams=3000).collect()}
    forms = {r.row_no: r.form for r in reps.collect()}
    assert got == {(a, b) for a in forms for b in forms if a < b and brute.jaccard(forms[a], forms[b]) >= threshold}


@pytest.mark.parametrize("sizes", SMALL)
def test_overlaps(spark, questions, sizes, monkeypatch):
    monkeypatch.setattr(crosssplit, "ROWS_PER_SALT", 2)
    rows, df = questions
    copies = df.where("row_no > 900").withColumn("row_no", F.col("row_no") + 5000).withColumn("split", F.lit("train"))
    every = df.unionByName(copies)
    got = crosssplit.overlaps(every, 0.7, **sizes)
    want = brute.p4([(r[0], r[1], r[2]) for r in rows] + [(r[0] + 5000, r[1], "train") for r in rows if r[0] > 900])
    found = [(r.row_a, r.row_b) for r in crosssplit.overlaps_found(got).collect()]
    assert set(found) == want and len(found) == len(want) > 20
    counts = {(r.split, r.source): (r.pairs, r.equal_pairs, r.held_rows, r.train_rows) for r in crosssplit.counts(every, 0.7, **sizes).collect()}
    by = got.toPandas().groupby(["split", "held_source"])
    assert counts == {k: (len(g), int((g.similarity == 1).sum()), g.held_row.nunique(), g.train_row.nunique()) for k, g in by} and {k[0] for k in counts} <= {"validation", "test"}


@pytest.mark.parametrize("salts", [1, 16])
def test_sets_and_torn(spark, questions, salts):
    rows, df = questions
    sets = groupsplit.sets(df)
    assert {(r.first_row, r.row_no) for r in groupsplit.torn(sets).collect()} == brute.p5([(r[0], r[3], r[4], r[1], r[2]) for r in rows])
    assert sets.count() == len(rows)


@pytest.mark.parametrize("most", [2_000, 2])
def test_assignment(spark, questions, monkeypatch, most):
    _, df = questions
    targets = spark.createDataFrame([("train", 0.6), ("val", 0.2), ("test", 0.2), (None, 0.5)], "split string, share double")
    singles = spark.range(10_000, 13_000).select(F.col("id").alias("row_no"), F.concat(F.lit("state "), "id").alias("state"), F.lit("train").alias("split"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("group_key"))
    monkeypatch.setattr(groupsplit, "SHARD_COMPONENTS", 500)
    monkeypatch.setattr(groupsplit, "MOST_SHARDS", most)
    sets = groupsplit.sets(df.select(*singles.columns).unionByName(singles))
    got = groupsplit.assign(sets, targets).toPandas()
    assert got.groupby("first_row").split.nunique().max() == 1 and got.row_no.is_unique and len(got) == 3160
    shares = got.split.value_counts(normalize=True)
    assert abs(shares["train"] - 0.6) < 0.02 and abs(shares["validation"] - 0.2) < 0.02 and abs(shares["test"] - 0.2) < 0.02


def test_differencing():
    rng = random.Random(4)
    weights = [rng.randrange(1, 50) for _ in range(300)] + [400]
    bins = groupsplit.difference_bins([[(w, i)] for i, w in enumerate(weights)], 10)
    assert sorted(m for _, inner in bins for m in inner) == list(range(301))
    assert all(w == sum(weights[i] for i in inner) for w, inner in bins)
    assert bins[0][0] - bins[-1][0] <= 2
    assert groupsplit.difference_bins([], 5) == []
    assert sum(len(x) for _, x in groupsplit.difference_bins([[(5, 0)], [(1, 1)]], 8)) == 2


QUESTIONS = [
    '{"type": "choice", "criteria": {"a": "One.", "b": "Two"}}', '{"criteria": {"B": "two", "A": "one"}, "TYPE": "Choice"}', '{"type": "choice", "criteria": {"a": "Two", "b": "One."}}',
    '{"type": "score", "criteria": ["x", "y"]}', '{"type": "score", "criteria": ["y", "x"]}', '{"n": 1}', '{"n": 1.0}', '{"n": true}', '{"n": "1"}', '{"n": null}', '{"n": 1e400}', '{"n": NaN}', "{\"n\": ", "[]", "{}", "null", '""', None, "",
    '{"a": 1, "A": 2}', '{"A": 2, "a": 1}', '{"a": 2, "A": 1}', '{"a": {"b": [1, {"c": "D"}]}}', '{"A": {"B": [1.0, {"C": "d"}]}}', "[" * 5000,
]


@pytest.mark.parametrize(("bits", "part_rows"), [(128, 5000), (3, 5000), (0, 5000), (128, 3)])
def test_records(spark, bits, part_rows):
    rng = random.Random(7)
    texts = ["The Case", "the  case!", "ｔｈｅ case", "other", None, "", "--", "long " * 5000]
    rows = [(i, rng.choice(texts), q) for i, q in enumerate(rng.choice(QUESTIONS) for _ in range(400))]
    df = with_clashes(spark.createDataFrame(rows, "row_no bigint, state string, question string"))
    got = formatdup.records(df, bits=bits, part_rows=part_rows)
    strict = [(r, s, None if q in ('{"n": NaN}', "[" * 5000) else q) for r, s, q in rows]
    assert {(r.first_row, r.row_no) for r in formatdup.copies_found(got).collect()} == brute.p2(strict)
    assert got.count() == 400
    assert sum(r.copies for r in formatdup.collapsed(got).collect()) == 400


def test_records_under_one_fingerprint_in_several_parts(spark):
    rows = [(i, "abc"[i % 3], "{}") for i in range(40)]
    got = formatdup.records(spark.createDataFrame(rows, "row_no bigint, state string, question string"), bits=0, part_rows=10)
    assert {(r.row_no, r.first_row) for r in got.collect()} == {(i, i % 3) for i in range(40)}


def test_fingerprint_ignores_field_order_only():
    a, b, c = (formatdup.fingerprint("s", q) for q in ('{"x": 1, "y": [1, 2]}', '{"y": [1, 2], "x": 1}', '{"x": 1, "y": [2, 1]}'))
    assert a == b != c and formatdup.fingerprint(" ", "{}") is None


def test_verbatim(spark):
    rng = random.Random(9)
    items = [(f"i{k}", sentence(rng, rng.randrange(8, 40))) for k in range(30)] + [("short", "one two"), ("none", None), ("empty", ""), ("i0-again", None)]
    items[-1] = ("i0-again", items[0][1])
    docs = []
    for d in range(200):
        _, s = rng.choice(items[:30])
        w = s.split(" ")
        a = rng.randrange(len(w))
        piece = w[a : a + rng.randrange(5, 25)]
        if rng.random() < 0.2:
            rng.shuffle(piece)
        docs.append((d, sentence(rng, rng.randrange(20)) + "\n" + rng.choice([str.upper, str])(" - ".join(piece)) + ". " + sentence(rng, rng.randrange(20))))
    docs += [(500, None), (501, ""), (502, "word " * 50_000 + items[3][1]), (3, items[5][1])]
    df = with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    it = with_clashes(spark.createDataFrame([*items, items[1]], "id string, state string"))
    got = [(r.doc_id, r.item_id) for r in leakage.verbatim(df, it).collect()]
    want = brute.p1(docs, [(i, s) for i, s in items])
    assert set(got) == want and len(got) == len(want) > 20


def test_verbatim_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_WORDS", 20)
    items = [(f"i{k}", " ".join(f"w{k}{j}" for j in range(12))) for k in range(5)]
    df = spark.createDataFrame([(k, s + " end") for k, (_, s) in enumerate(items)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.verbatim(df, spark.createDataFrame(items, "id string, state string")).collect()} == {(k, f"i{k}") for k in range(5)}


def test_paraphrases(spark):
    rng = random.Random(2)
    fill = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(40))
    items = [(f"i{k}", fill()) for k in range(20)]
    near = items[3][1].split(" ")
    near[5:5], near[20] = ["inserted"], "changed"
    docs = [(k, fill()) for k in range(300)] + [(900, " ".join(near)), (901, None), (902, "")]
    got = leakage.paraphrases(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "id string, state string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(900, "i3")] and got[0].common > 0.9


def test_paraphrases_of_parts_are_found(spark):
    """Stretches of 24 words of an item, one word in six changed, dropped or preceded by another, at any place of a document."""
    rng = random.Random(5)
    fill = lambda n: [f"w{int(400 * rng.random() ** 2)}" for _ in range(n)]
    items = [(f"i{k}", " ".join(fill(90))) for k in range(30)]
    docs = [(k, " ".join(fill(rng.randrange(20, 300)))) for k in range(400)]
    planted = set()
    for k in range(100):
        name, text = rng.choice(items)
        a = rng.randrange(66)
        stretch = text.split(" ")[a : a + 24]
        for i in range(0, 24, 6):
            j = i + rng.randrange(6)
            stretch[j] = rng.choice([f"new{k}", stretch[j] + f" new{k}", *fill(1)])
        before, after = fill(rng.randrange(60)), fill(rng.randrange(60))
        docs.append((1000 + k, " ".join([*before, *stretch, *after])))
        planted.add((1000 + k, name))
    got = {(r.doc_id, r.item_id) for r in leakage.paraphrases(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "id string, state string")).collect()}
    assert len(got & planted) >= 0.9 * len(planted) and len(got - planted) <= 0.02 * len(docs)


@pytest.mark.parametrize("cosine", [0.7, 0.95])
def test_cells_lose_nothing(cosine):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 64))
    places = (base[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 64))).astype(np.float32)
    asked = (base[rng.integers(0, 40, 500)] + 0.4 * rng.standard_normal((500, 64))).astype(np.float32)
    asked[:50] = places[:50]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit(asked.astype(float)) @ unit(places.astype(float)).T
    mine, other, value = leakage.CellIndex(places, cosine).near(asked)
    got = set(zip(mine.tolist(), other.tolist()))
    assert {tuple(x) for x in np.argwhere(score >= cosine + 1e-4).tolist()} <= got <= {tuple(x) for x in np.argwhere(score >= cosine - 1e-4).tolist()} and len(got) >= 50
    assert np.allclose(value, score[mine, other], atol=1e-4)


def test_lcs():
    assert leakage.lcs_length([1, 2, 3, 4, 5], [2, 9, 4, 5, 1]) == 3 and leakage.lcs_length([], [1]) == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "row_no bigint, state string, split string, source string, group_key string, question string, doc_id bigint, text string, id string")
    some = spark.createDataFrame([(1, "a", "train", "s", "g", "{}", 1, "text", "i")], none.schema)
    assert formatdup.records(none).count() == 0
    assert neardup.near_groups(neardup.representatives((none, "row_no", "state"))).count() == 0
    assert crosssplit.overlaps(none).count() == crosssplit.overlaps(some).count() == 0
    assert groupsplit.torn(groupsplit.sets(none)).count() == 0
    assert groupsplit.assign(groupsplit.sets(none), spark.createDataFrame([("train", 1.0)], "split string, share double")).count() == 0
    assert leakage.verbatim(none, some).count() == leakage.verbatim(some, none).count() == leakage.paraphrases(none, some).count() == leakage.paraphrases(some, none).count() == 0


def test_kept_lies_in_the_shared_folder(spark):
    from sievework.session import shared_folder

    df = blocks.kept(spark.createDataFrame([(1, None)], "a int, b string"))
    assert all(shared_folder(spark).removeprefix("file://") in f for f in df.inputFiles()) and df.collect()[0].b is None
