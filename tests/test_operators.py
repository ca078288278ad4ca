import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators import calibration, components, corpus, metrics, minhash, relational, running, sampling, skew, texts


def components_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("task_edges", [0, 3, 1000])
def test_components(spark, task_edges):
    rng = random.Random(task_edges)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (500, 500), (3, 2), (3, 2)]
    df = spark.createDataFrame([*edges, (None, 4), (5, None)], "src bigint, dst bigint")
    got = {r.node: r.component for r in components.connected_components(df, task_edges).collect()}
    assert got == components_of(edges)


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).collect() == []


def test_lookup_keeps_rows(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None, "clash") for i in range(60)] + [(99, "alone", "clash")], "row_no bigint, key string, value2 string")
    right = spark.createDataFrame([("hot", 7)], "key string, value int")
    got = skew.lookup(left, right, "key", "row_no").collect()
    assert len(got) == 61 and {r.value for r in got if r.key == "hot"} == {7} and all(r.value is None for r in got if r.key != "hot")


def test_running_sums(spark):
    pdf = pd.DataFrame({"g": ["a"] * 50 + [None] * 10, "k": list(range(60)), "v": [1.0] * 60})
    got = running.running_sums(spark.createDataFrame(pdf), ["g"], [F.desc("k")], {"s": "v"}).toPandas().sort_values("k")
    assert got[got.g == "a"]._n.tolist() == list(range(50, 0, -1))
    assert got[got.g.isna()].s.tolist() == list(range(10, 0, -1))


def test_known_metrics(spark):
    rows = [("i1", "r", "noul", True, None, None, [0.3, 0.7], ["no", "yes"]), ("i2", "r", "choice", None, "b", None, [0.2, 0.5, 0.3], ["a", "b", "c"]), ("i3", "r", "choice", None, "zz", None, [0.2, 0.8], ["a", "b"]), ("i4", "r", "score", None, None, 2.5, [0.1, 0.1, 0.8], ["0", "1", "2"]), ("i5", "r", "score", None, None, None, None, None)]
    s = metrics.scored(spark.createDataFrame(rows, "item_id string, run_name string, q_type string, label_bool boolean, label_key string, label_level double, probs array<double>, option_keys array<string>"))
    got = {r.item_id: r for r in s.collect()}
    assert set(got) == {"i1", "i2", "i4"}
    assert got["i1"].brier == pytest.approx(0.09) and got["i2"].brier == pytest.approx(0.04 + 0.25 + 0.09)
    assert got["i4"].gold == 2 and got["i4"].correct == 1


def test_column_functions(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], ["b", "a", "c"])], "p array<double>, k array<string>")
    r = df.select(
        C.argmax(F.col("p")).alias("first"), C.argmax_by_key(F.col("p"), F.col("k")).alias("by_key"), C.has_tie(F.col("p")).alias("tie"), C.margin(F.col("p")).alias("margin"), C.gold_rank(F.col("p"), F.lit(0)).alias("rank"),
        C.rps(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), F.lit(2)).alias("rps"), C.interval_relation(C.interval(F.lit(0.5)), C.interval(F.lit(0.6))).alias("rel"),
        F.size(C.word_shingles(F.lit("a b c d e f g h i"))).alias("nine"), F.size(C.word_shingles(F.lit("a b c"))).alias("three"), C.char_grams(F.lit("abc")).alias("short"), C.base_id(F.lit("x-1-unans-cut-2")).alias("base"),
        C.normal_words(F.lit("a_b-C")).alias("n1"), C.normal_words_keeping_underscores(F.lit("a_b-C")).alias("n2"),
    ).first()
    assert (r.first, r.by_key, r.tie, r.margin, r["rank"], r.rel) == (0, 1, True, 0.0, 2, "increase")
    assert r.rps == pytest.approx(0.5)
    assert (r.nine, r.three, r.short, r.base, r.n1, r.n2) == (2, 0, ["abc"], "x-1", "a b c", "a_b c")


def test_confidence_map_is_monotone(spark):
    rng = np.random.default_rng(2)
    x = np.sort(rng.random(400))
    y = (rng.random(400) < x).astype(float)
    points = list(zip(x.tolist(), y.tolist(), [1.0] * 400))
    pooled = calibration.pool_adjacent(points)
    assert np.allclose(pooled, calibration.pool_adjacent([*calibration.pool_adjacent(points[:150]), *calibration.pool_adjacent(points[150:])]))
    rates = [h / n for _, h, n in pooled]
    assert rates == sorted(rates) and sum(b[2] for b in pooled) == 400
    big = calibration.without_small(pooled, 20)
    assert min(b[2] for b in big) >= 20 and sum(b[2] for b in big) == 400
    mapped = calibration.shrunk_map(points, 20.0, 20)
    assert [r for _, r, _ in mapped] == sorted(r for _, r, _ in mapped) and sum(n for *_, n in mapped) == 400
    s = spark.createDataFrame([("r", float(a), int(b)) for a, b in zip(x, y)], "run_name string, confidence double, correct int").repartition(5)
    got = sorted((r.upto, r.rate, r.n) for r in calibration.confidence_map(s, ["run_name"]).collect())
    assert np.allclose(got, mapped)
    held = calibration.apply_map(spark.createDataFrame([("r", 0.0), ("r", 1.0)], "run_name string, confidence double"), calibration.confidence_map(s, ["run_name"]), ["run_name"]).collect()
    assert sorted(r.calibrated for r in held) == pytest.approx([mapped[0][1], mapped[-1][1]])


def test_fits(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 2))
    y = 3 * x[:, 0] - x[:, 1] + 2 + 0.1 * rng.standard_normal(300)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    fit = calibration.least_squares(df, [F.col("a"), F.col("b")], F.col("y"))
    assert np.allclose(fit["weights"], np.linalg.lstsq(np.c_[x, np.ones(300)], y, rcond=None)[0]) and fit["n"] == 300
    z = (x - x.mean(0)) / x.std(0)
    ridge = np.linalg.solve(np.c_[z, np.ones(300)].T @ np.c_[z, np.ones(300)] + np.diag([5.0, 5.0, 0.0]), np.c_[z, np.ones(300)].T @ y)
    assert np.allclose(calibration.least_squares(df, [F.col("a"), F.col("b")], F.col("y"), 5.0, True)["weights"], ridge)
    assert calibration.least_squares(df, [F.col("a"), F.col("a")], F.col("y")) is None and calibration.least_squares(df.limit(0), [F.col("a")], F.col("y")) is None
    probs = rng.dirichlet([1, 1, 1], 400)
    true = np.exp(0.5 * np.log(probs) + np.array([1.0, 0.0, -1.0]))
    gold = [int(rng.choice(3, p=t / t.sum())) for t in true]
    rows = spark.createDataFrame([(g, p.tolist()) for g, p in zip(gold, probs)], "gold int, probs array<double>")
    f = calibration.fit_temperature_bias(rows, 3)
    assert 1.4 < f["temperature"] < 3 and f["bias"][0] - f["bias"][2] == pytest.approx(2, abs=0.6) and f["nll_after"] < f["nll_before"]
    with pytest.raises(ValueError):
        calibration.fit_temperature_bias(rows, 2)


def test_power_and_screens(spark):
    assert calibration.detectable_delta(111, 0.324) == pytest.approx(0.157, abs=0.002)  # a published figure
    n = calibration.items_for_power(0.3, 0.1)
    assert calibration.power(n, 0.3, 0.1) >= 0.8 and calibration.items_for_power(0.3, 0.0001, most=50) is None
    rows = [(f"i{i}", run, 1 if run == "b" or i % 3 else 0, 4) for i in range(90) for run in "ab"]
    s = spark.createDataFrame([(i, r, c, k, None, [0.5]) for i, r, c, k in rows], "item_id string, run_name string, correct int, k int, scored_at timestamp, probs array<double>")
    got = calibration.screens(s).first()
    assert (got.wins, got.losses, got.n, got.screen, got.improvement) == (0, 30, 90, "material_regression", "none") and got.delta_pp == pytest.approx(-100 / 3 / 0.75)


def test_running_minima_and_caps(spark):
    from sievework.operators import selection

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.random() < 0.6) for i in range(200)]
    df = spark.createDataFrame(rows, "row_no bigint, g string, zero boolean").repartition(6)
    for share in (0.1, 0.25, 0.5):
        want, state = {}, {"a": [0, 0], "b": [0, 0]}
        for i, g, zero in rows:
            took = not zero or state[g][1] + 1 <= -(-share * (state[g][0] + 1) // 1)
            want[i] = took
            state[g][0] += took
            state[g][1] += took and zero
        assert {r.row_no: r.taken for r in selection.running_cap(df, ["g"], [F.col("row_no")], F.col("zero"), share).collect()} == want
    assert selection.allocate(10, {"x": 0.5, "y": 0.3, "z": 0.2}, {"x": 2, "y": 9, "z": 9}) == {"x": 2, "y": 5, "z": 3}
    assert sum(selection.allocate(1000, {"x": 0.5, "y": 0.5}, {"x": 10, "y": 20}).values()) == 30


def test_texts_and_pairs(spark):
    from sievework.operators import items

    assert items.entity_spans("Did Acme Corp sue Jackie Evancho in Paris, in May? The end.") == ["Acme Corp", "Jackie Evancho", "Paris"]
    df = spark.createDataFrame([(1, "boolq", "Passage: One. Two.\n\nQuestion: who?"), (2, "mnli", "no layout"), (3, "fever", "Claim: c\n\nEvidence:\ne1")], "k int, source string, state string").withColumn("p", items.laid_out(F.col("state"), F.col("source")))
    got = {r.k: r.p for r in df.collect()}
    assert (got[1].prefix, got[1].support, got[1].suffix, got[1].query) == ("Passage: ", "One. Two.", "\n\nQuestion: who?", "who?") and got[2] is None and (got[3].support, got[3].query) == ("e1", "c")
    s = spark.createDataFrame([(1, "Dr. Bell of the U.S. met Ann. She left."), (2, None)], "k int, t string")
    assert [r.sentence for r in items.sentences(s, "k", "t").collect()] == ["Dr. Bell of the U.S. met Ann.", "She left."]
    base = dict(id="a", question="q", source="s", group_key="g", answerable=True, reason=None, teacher_probs=None, parts=("p", "x", "s", "q"))
    kind = "struct<id:string,question:string,source:string,group_key:string,answerable:boolean,reason:string,teacher_probs:string,parts:struct<prefix:string,support:string,suffix:string,query:string>>"
    good = {**base, "id": "a-unans-cut-1", "answerable": False, "reason": "cut", "parts": ("p", "y", "s", "q")}
    cases = [good, {**good, "question": "r"}, {**good, "answerable": None}, {**good, "reason": None}, {**good, "parts": ("p", "z", "s", "q")}, {**good, "id": "b"}, {**good, "parts": None}]
    made = spark.createDataFrame([(i, base, c) for i, c in enumerate(cases)], f"i int, b {kind}, a {kind}")
    assert [r.e for r in made.select("i", items.pair_error("b", "a", F.lit("y")).alias("e")).orderBy("i").collect()] == [None, "question changed", "variant is not withheld", "reason is missing", "evidence is not what was made", "id is not the original's", "state no longer parses"]


def test_conversations(spark):
    from sievework.operators import items

    call = lambda tool, **a: ("function_call", '{"name": "%s", "arguments": %s}' % (tool, str(a).replace("'", '"').replace("True", "true")))
    tools = '[{"name": "find", "description": "Find it", "parameters": {"properties": {"where": {"enum": ["here", "there"]}}}}, {"name": "send"}, {"name": "find", "description": "again"}]'
    rows = [
        (1, "Policy", tools, [("human", "hi"), call("find", where="here", n=2, ok=True), ("observation", "found"), ("gpt", "I cannot do that.")]),
        (2, None, tools, [("human", "hi"), ("gpt", "Let me check."), ("gpt", "Which one?")]), (3, None, tools, [("human", "hi"), call("think"), ("observation", "o"), call("send")]), (4, None, "no json", [("human", "hi"), ("gpt", "Sure, one moment.")]),
        (5, None, tools, [call("find", n=2.5), ("tool", "x"), call("other")]), (6, None, None, None), (7, None, tools, [("function_call", "no json")]), (8, None, tools, []),
    ]
    df = spark.createDataFrame(rows, "k int, system string, tools string, conv array<struct<`from`:string,value:string>>")
    got = {r.key: (r.label, r.allowed, r.state) for r in items.action_items(df, "k", "system", "conv").collect()}
    assert got == {1: ("call_tool", True, "System: Policy\n\nhuman: hi"), 2: ("clarify", None, "human: hi\n\ngpt: Let me check."), 4: ("answer", None, "human: hi")}
    assert {r.key: (r.label, r["keys"]) for r in items.tool_items(df, "k", "system", "conv", "tools", 2).collect()} == {1: ("find", ["find", "send"])}
    nxt = {r.key: (r.reason, r.label) for r in items.next_action_items(df, "k", "system", "conv", "tools").collect()}
    assert nxt == {1: (None, "refuse"), 2: ("no_observation", None), 3: ("think_before_observation", None), 4: ("no_observation", None), 5: ("call_not_in_tools", None), 6: ("no_conversations", None), 7: ("no_observation", None), 8: ("no_observation", None)}
    made = {(r.key, r.arg): (r.reason, r.q_type, r.label, r["keys"]) for r in items.argument_items(df, "k", "conv", "tools", 3).collect()}
    assert made == {(1, "where"): (None, "choice", "here", ["here", "there"]), (1, "n"): (None, "choice", "2", ["2", "2.5"]), (1, "ok"): (None, "noul", "true", None), (5, "n"): (None, "choice", "2.5", ["2.5", "2"])}
    long = df.where("k = 1").select(items.rendered_state(F.lit("a\n" * 50), F.col("conv"), F.lit(1), 20).alias("s")).first().s
    assert len(long) <= 20 and not long.endswith("\n")


def test_strict_values(spark):
    from sievework.functions import values as V

    df = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), ('{"a":1} x',), ("1, 2",), (None,), ("",), ("{",), ('"s"',), ("plain",)], "t string")
    assert [r[0] for r in df.select(C.strict_json("t")).collect()] == ['{"a":[1,2],"b":1}', None, None, None, None, None, '"s"', None]
    assert [r[0] for r in df.select(C.canonical_value("t")).collect()] == ['{"a":[1,2],"b":1}', '"{\\"a\\":1} x"', '"1, 2"', None, '""', '"{"', '"s"', '"plain"']
    fenced = spark.createDataFrame([('<think>no</think>```json\n{"x": 1}\n```',), ("``` \nnot\n```",), ('{"x":2}',)], "t string")
    assert [r[0] for r in fenced.select(V.lenient_json(F.col("t"))).collect()] == ['{"x":1}', None, '{"x":2}']
    ids_ = spark.createDataFrame([("synthetic-law-0001-cf-noul-1",), ("synthetic-law-0001-score-1",), ("a-b",), (None,)], "i string")
    assert [tuple(r) for r in ids_.select(V.stage_of(F.col("i")), V.type_of(F.col("i"))).collect()] == [("cf", "noul"), ("base", "score"), ("base", "unknown"), (None, None)]



def test_exact_tests():
    assert calibration.mcnemar_p(0, 0) == 1 and calibration.mcnemar_p(5, 0) == pytest.approx(0.0625)
    assert calibration.power(40, 0.3, 0.0) < 0.06 < calibration.power(40, 0.3, 0.25)


def test_contamination_rules(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    docs = spark.createDataFrame([(1, "ONE two, three four five six seven eight nine ten eleven twelve"), (2, "x " + " ".join(words[:10])), (3, " ".join(words[:9]) + " y"), (4, None), (5, "")], "doc_id bigint, text string")
    probes = spark.createDataFrame([("p", " ".join(words))], "id string, state string")
    got = {r.doc_id: r.reason for r in corpus.contamination_pairs(docs, probes).collect()}
    assert got == {1: "state", 2: "shingle"}


def test_minhash_clusters(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the deep dark wood"
    rows = [(1, base), (2, base + " now"), (3, base.upper()), (4, "nothing at all like that text, it speaks of ships and sealing wax"), (5, None), (6, "")]
    got = {r.id: r.cluster for r in minhash.clusters(spark.createDataFrame(rows, "row_no bigint, state string"), "row_no").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    kept = {r.id for r in minhash.greedy_kept(spark.createDataFrame(rows, "row_no bigint, state string"), "row_no").collect()}
    assert kept == {1, 4}


def test_greedy_pass_and_rounds(spark):
    """The ordered pass over texts that share a band, against clusters by pass and in rounds; clusters against all pairs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts_ = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    for _ in range(60):
        w = rng.choice(texts_).split(" ")
        for _ in range(rng.randrange(8)):
            w[rng.randrange(60)] = rng.choice(words)
        texts_.append(" ".join(w))
    df = spark.createDataFrame([*enumerate(texts_), (900, ""), (901, None)], "row_no bigint, state string")
    reps = sorted((r.id, np.frombuffer(r.signature, np.uint32), set(r.buckets)) for r in minhash.signed(df, "row_no").collect())
    want = []
    for i, s, b in reps:
        if not any(b & b2 and (s == s2).mean() >= 0.7 for _, s2, b2 in want):
            want.append((i, s, b))
    for size in (5_000, 0, 3):
        assert sorted(r.id for r in minhash.greedy_kept(df, "row_no", pass_texts=size).collect()) == [i for i, _, _ in want]
    grams = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in enumerate(texts_)}
    near = [(i, j) for i in grams for j in grams if i < j and len(grams[i] & grams[j]) >= 0.7 * len(grams[i] | grams[j])]
    of = components_of(near)
    assert {r.id: r.cluster for r in minhash.clusters(df, "row_no").collect()} == {i: of.get(i, i) for i in grams}
    held = {i for i in grams if i % 5 == 0}
    got = {r.id: r.equal for r in minhash.near_any(df, "row_no", F.col("row_no") % 5 == 0).collect()}
    assert set(got) == {x for pair in near for x, y in (pair, pair[::-1]) if x not in held and y in held}


def test_asof_and_band(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, t int, v int")
    got = {(r.k, r.t): r.right_v for r in relational.asof(left, right, "t", ["k"], ["v"]).collect()}
    assert got == {("a", 5): 50, ("a", 1): None, ("b", 9): None}
    sizes = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 7, 8, 9, 100]], "s int")
    pairs = {(r.s, r.o) for r in relational.band_join(sizes, sizes.select(F.col("s").alias("o")), "s", "o", 0.5, 2.0).collect()}
    assert pairs == {(a, b) for a in [1, 2, 3, 7, 8, 9, 100] for b in [1, 2, 3, 7, 8, 9, 100] if a / 2 <= b <= 2 * a}


def test_scoring_contract(spark):
    def scorer():
        return lambda batch: {"id": batch["id"], "p": [float(len(t or "")) for t in batch["text"]]}

    df = spark.createDataFrame([(1, "ab"), (2, None)], "id bigint, text string")
    assert {(r.id, r.p) for r in relational.with_scores(df, scorer, "id bigint, p double", ["id", "text"]).collect()} == {(1, 2.0), (2, 0.0)}


def test_quotas_by_loop(spark):
    pools = {"a": 40, "b": 7, "c": 3, "d": 100}
    df = spark.createDataFrame([(s,) for s, n in pools.items() for _ in range(n)] + [(None,)], "source string")
    quota = {s: min(n, 5) for s, n in pools.items()}
    while sum(quota.values()) < 60:
        room = [s for s in pools if quota[s] < min(pools[s], 30)]
        if not room:
            break
        quota[max(room, key=lambda s: (pools[s] / (quota[s] + 1), s))] += 1
    assert {r.source: r.quota for r in sampling.quotas(df, "source", 60, 5, 30).collect()} == quota


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "row_no bigint, id string, source string, state string, question string, label string, corpus string, priority int, pos bigint")
    assert corpus.first_wins(empty).count() == corpus.duplicate_metrics(empty).count() == corpus.id_suffixes(empty).count() == 0
    assert texts.tool_calls(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), "doc_id", "text").count() == 0
