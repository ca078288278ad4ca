"""Cases that the queries' SQL can't see, since it takes the same short cut or the tables lack them."""

import random

from sievework.operators import corpus
from sievework.operators import questions as Q
from sievework.plans import corpus as corpus_plans
from sievework.plans import general, items
from sievework.streaming import events as E


def test_answer_types_every_cell(spark, tmp_path):
    spark.createDataFrame([(0, "| 处方 | Naipreamere | 329 |\nno table\n| yes | AB-1234 |"), (1, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.kind: r.n for r in items.answer_types(spark, str(tmp_path)).collect()}
    assert got == {"entity": 2, "date": 1, "number": 1, "yes_no": 1}


def test_padding_draws_from_all_texts(spark):
    make = lambda i, source, *texts: (i, "choice", source, [(str(j), t) for j, t in enumerate(texts)])
    data = [make(i, "many", f"Text {i}", f" text {(i * 7) % 300}") for i in range(300)]
    data += [make(300, "few", "x", "y"), make(301, None, "z", "Text 5"), make(302, "few", "x", None), make(303, "many", *"abcdefgh"), (304, "noul", "many", None)]
    data = [(*r, "0") for r in data]
    df = spark.createDataFrame(data, "row_no bigint, q_type string, source string, options array<struct<key:string,text:string>>, label_key string")
    have = {r[0]: {t.strip().lower() for _, t in r[3] if t} for r in data if r[3]}
    added = {r.row_no: r.added for r in Q.pad(df, 8, 2).collect()}
    assert set(added) == set(range(303))
    for i, texts in added.items():
        norms = {t.strip().lower() for t in texts}
        assert len(texts) == len(norms) == 6 and not norms & have[i]
    assert added[302][0] == "y"
    many = {t.strip().lower() for r in data[:300] + data[303:304] for _, t in r[3]}
    used = {t.strip().lower() for i in range(300) for t in added[i]}
    assert used <= many and len(used) > 250
    few = Q.pad(df.where("row_no IN (300, 301)"), 8, 2).collect()
    assert {r.row_no: sorted(t.lower() for t in r.added) for r in few} == {300: ["text 5", "z"], 301: ["x", "y"]}


def test_states_fold_whole_unicode(spark, tmp_path):
    left = "Cafe\u0301 \ufb01nds \u1e9e in \u039f\u03b4\u03cc\u03c2 one two three four five six seven"
    right = "CAF\u00c9 FINDS ss IN \u039f\u0394\u039f\u0301\u03a3 one_two three four five six seven"
    records = [(i, f"s{i}", "id", 0, "c", i, text, "q", "l") for i, text in enumerate([left, right, None])]
    rows = spark.createDataFrame(records, "row_no bigint, source string, id string, priority int, corpus string, pos bigint, state string, question string, label string")
    rows.write.parquet(f"{tmp_path}/corpus_records.parquet")
    documents = spark.createDataFrame([(0, left), (1, right)], "doc_id bigint, text string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.row_no: r.verdict for r in corpus.first_wins(rows).collect()} == {0: "kept", 1: "record", 2: "id"}
    assert sorted((r.source, r.verdict, r.n) for r in corpus_plans.first_wins_counts(spark, str(tmp_path)).collect()) == [("s0", "kept", 1), ("s1", "record", 1), ("s2", "id", 1)]
    one = corpus.duplicate_metrics(rows.where("row_no < 2").drop("source").selectExpr("*", "'s' AS source")).first()
    assert (one.n, one.states, one.records) == (2, 1, 1)
    assert [tuple(r) for r in corpus_plans.cross_source(spark, str(tmp_path)).collect()] == [("s0", "s1", 1)]
    assert [tuple(r) for r in corpus_plans.documents_first(spark, str(tmp_path)).collect()] == [(0, 2)]
    probes = spark.createDataFrame([("whole", right), ("part", right + " and more")], "id string, state string")
    pairs = {(r.doc_id, r.item_id, r.reason) for r in corpus.contamination_pairs(documents, probes).collect()}
    assert pairs == {(0, "whole", "state"), (1, "whole", "state")}
    pairs = {(r.doc_id, r.item_id, r.reason) for r in corpus.contamination_pairs(documents, probes.where("id = 'part'")).collect()}
    assert pairs == {(0, "part", "shingle"), (1, "part", "shingle")}
    assert {r.doc_id for r in corpus.contamination_pooled(documents, probes).collect()} == {0, 1}


def test_streaks_of_a_hot_user(spark, tmp_path):
    chance = random.Random(1)
    kinds = [chance.choice(["error", "error", "view"]) for _ in range(25_000)] + ["view", "error", "error", "error"]
    want, run = [], 0
    for kind in kinds:
        if kind == "error":
            run += 1
        else:
            want += [run] * (run >= 3)
            run = 0
    rows = [(i, 7, kind, i // 2) for i, kind in enumerate(kinds)]
    chance.shuffle(rows)
    made = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, second bigint").selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(second) AS ts", "1.0D AS value")
    path = f"{tmp_path}/events.parquet"
    made.coalesce(3).write.parquet(path)
    for df in (E.error_streaks(spark.read.parquet(path)), E.drained(E.error_streaks(E.stream(spark, path)))):
        assert sorted(r.streak for r in df.collect()) == sorted(want)
    assert [tuple(r) for r in general.streaks(spark, str(tmp_path)).collect()] == [(7, len(want), max(want))]
