import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.sources import adapters, tables


def test_questions_round_trip(spark, tmp_path):
    row = {"id": "a", "state": "s", "q_type": "choice", "options": [{"key": "x", "text": "X"}], "teacher_probs": {"flat": {"x": 1.0}}, "label_key": "x"}
    (tmp_path / "in.jsonl").write_text(json.dumps(row) + "\n")
    df = tables.read_questions(spark, str(tmp_path / "in.jsonl"))
    tables.write_lines(df, str(tmp_path / "out"))
    back = [json.loads(line.value) for line in spark.read.text(str(tmp_path / "out")).collect()]
    assert back == [row]


def test_strict_and_lenient(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n{"id": \n\n{"id": "a"}\n')
    with pytest.raises(Exception):  # noqa: B017
        tables.read_questions(spark, str(tmp_path / "bad.jsonl")).collect()
    r = tables.profile_questions(spark, str(tmp_path / "bad.jsonl")).first()
    assert (r.lines, r.bad, r.blank, r.ids) == (4, 1, 1, 1)


def test_zip_lock_log(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.jsonl", "1\n2\n")
        z.writestr("y.txt", "no")
    assert [(r.member, r.line_no, r.line) for r in tables.read_zipped_lines(spark, str(tmp_path / "a.zip")).collect()] == [("x.jsonl", 1, "1"), ("x.jsonl", 2, "2")]
    files = tmp_path / "files"
    files.mkdir()
    (files / "ok").write_text("abc")
    (files / "odd").write_text("abc")
    (files / "more").write_text("abc")
    lock = spark.createDataFrame([("ok", 3, hashlib.sha256(b"abc").hexdigest()), ("odd", 3, "0"), ("gone", 1, "0")], "name string, bytes bigint, sha256 string")
    assert {r.name: r.verdict for r in tables.verify_files(spark, str(files), lock).collect()} == {"ok": "ok", "odd": "digest", "gone": "missing", "more": "unlisted"}
    (tmp_path / "run.log").write_text("start\nepoch 3 loss=0.25 acc=0.5\n")
    assert {(r.epoch, r.name, r.value) for r in tables.parse_log(spark, str(tmp_path / "run.log")).collect()} == {(3, "loss", 0.25), (3, "acc", 0.5)}


def test_union_and_missing(spark):
    a = spark.createDataFrame([("1", "s")], "id string, source string")
    both = tables.ordered_union(("first", a), ("second", a))
    assert {(r.corpus, r.priority) for r in both.collect()} == {("first", 1), ("second", 2)}
    config = spark.createDataFrame([("s", False), ("t", False), ("u", True)], "source string, allow_missing boolean")
    assert [r.source for r in tables.missing_sources(config, both).collect()] == ["t"]


def test_rendered_state(spark):
    got = [r.s for r in spark.createDataFrame([('{"a": 1}',), ("plain",), (None,), ("{broken",)], "s string").select(tables.rendered_state("s").alias("s")).collect()]
    assert got == ['{\n  "a": 1\n}', "plain", None, "{broken"]


RAW = {
    "sst2": ("sentence string, label int", [("good", 1), ("?", -1)], [("sst2-test-00007", "label_bool", True, "sst2-7")]),
    "mnli": ("premise string, hypothesis string, label int, genre string", [("p", "h", 2, "fiction"), ("p", "h", -1, "x")], [("mnli-test-00007", "label_bool", False, "fiction")]),
    "boolq": ("passage string, question string, answer boolean", [("p", "q", True), ("", "q", True)], [("boolq-validation-00007", "label_bool", True, "boolq-7")]),
    "multirc": ("paragraph string, question string, answer string, label int, idx struct<paragraph:int>", [("p", "q", "a", 1, (3,))], [("multirc-validation-00007", "label_bool", True, "multirc-p3")]),
    "tabfact": ("table_text string, table_caption string, statement string, label int, table_id string", [("t", "c", "s", 0, None)], [("tabfact-validation-00007", "label_bool", False, "tabfact-7")]),
    "fever": ("claim string, evidence array<array<string>>, label string", [("c", [["x", "s1"], ["y", "s2"]], "SUPPORTS"), ("c", [["x"]], "OTHER")], [("fever-validation-00007", "label_key", "supports", "fever-7")]),
    "mednli": ("sentence1 string, sentence2 string, gold_label string", [("a", "b", "neutral"), ("a", "b", "-")], [("mednli-validation-00007", "label_bool", False, "mednli-7")]),
    "contractnli": ("premise string, hypothesis string, label int", [("a", "b", 1), ("a", "b", 3)], [("contractnli-part-validation-00007", "label_bool", True, "contractnli-part")]),
    "anli": ("premise string, hypothesis string, label int", [("a", "b", 0)], [("anli-validation-validation-00007", "label_bool", True, "anli-validation")]),
    "banking77": ("text string, label int", [("t", 1), ("t", 99)], [("banking77-validation-00007", "label_key", "age_limit", "banking77-7"), ("banking77-validation-00007", "label_key", "99", "banking77-7")]),
    "agnews": ("text string, label int", [("t", 2)], [("agnews-validation-00007", "label_key", "business", "agnews-7")]),
    "arc": ("question string, choices struct<label:array<string>,text:array<string>>, answerKey string", [("q", (["A", "B"], ["x", "y"]), "B"), ("q", (["A"], ["x"]), "Z")], [("arc-part-validation-00007", "label_key", "B", "arc-part")]),
    "commonsenseqa": ("question string, choices struct<label:array<string>,text:array<string>>, answerKey string", [("q", (["A", "B"], ["x", "y"]), "A"), ("q", (["A", "B"], ["x"]), "A")], [("commonsenseqa-validation-00007", "label_key", "A", "commonsenseqa-7")]),
    "race": ("article string, question string, options array<string>, answer string", [("a", "q", ["1", "2", "3", "4"], "C"), ("a", "q", ["1"], "A")], [("race-part-validation-00007", "label_key", "C", "race-part")]),
    "hellaswag": ("activity_label string, ctx string, endings array<string>, label string", [("act", "c", ["1", "2", "3", "4"], "2"), ("", "c", ["1", "2", "3", "4"], "0"), ("", "c", ["1"], "")], [("hellaswag-validation-00007", "label_key", "2", "act"), ("hellaswag-validation-00007", "label_key", "0", "hellaswag-7")]),
    "swag": ("startphrase string, ending0 string, ending1 string, ending2 string, ending3 string, label int, `video-id` string", [("s", "a", "b", "c", "d", 3, "v"), ("s", "a", "", "c", "d", 0, "v")], [("swag-validation-00007", "label_key", "D", "v")]),
    "mmlu": ("question string, choices array<string>, answer int, subject string", [("q", ["1", "2", "3", "4"], 1, "high_school"), ("q", ["1"], 0, "x")], [("mmlu-validation-00007", "label_key", "B", "mmlu-high_school")]),
    "winogrande": ("sentence string, option1 string, option2 string, answer string", [("s", "a", "b", "2"), ("s", "a", "b", "")], [("winogrande-validation-00007", "label_key", "2", "winogrande-7")]),
    "piqa": ("goal string, sol1 string, sol2 string, label int", [("g", "a", "b", 1), ("g", "a", "b", -1)], [("piqa-validation-00007", "label_key", "B", "piqa-7")]),
    "logiqa": ("context string, query string, options array<string>, correct_option int", [("", "q", ["1", "2", "3", "4"], 0)], [("logiqa-validation-00007", "label_key", "A", "logiqa-7")]),
    "quality": ("article string, question string, options array<string>, answer int, set_unique_id string", [("a", "q", ["1", "2", "3", "4"], 4, "u")], [("quality-validation-00007", "label_key", "D", "quality-u")]),
    "stsb": ("sentence1 string, sentence2 string, label double", [("a", "b", 2.5), ("a", "b", -1.0)], [("stsb-validation-00007", "label_level", 2.0, "stsb-7")]),
    "sst5": ("text string, label int", [("t", 4)], [("sst5-validation-00007", "label_level", 4.0, "sst5-7")]),
    "yelp": ("text string, label int", [("t", 0), ("", 1)], [("yelp-validation-00007", "label_level", 0.0, "yelp-7")]),
    "helpsteer": ("prompt string, response string, helpfulness int, correctness int, coherence int, complexity int, verbosity int", [("p", "r", 1, 2, 3, 4, None)], [(f"helpsteer-test-00007-{n}", "label_level", x, "helpsteer-7") for n, x in (("helpfulness", 1.0), ("correctness", 2.0), ("coherence", 3.0), ("complexity", 4.0))]),
    "wmt_da": ("src string, mt string, raw string, year string, lp string", [("s", "m", "99.5", "2022", "de-en"), ("s", "m", "x", "2021", "de-en")], [("wmt-da-test-00007", "label_level", 4.0, "wmt-da-de-en")]),
    "ultrafeedback": ("prompt string, prompt_id string, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>, score_chosen double, score_rejected double", [("p", "u", [("assistant", "yes")], [("user", "no")], 10.0, 1.0)], [("ultrafeedback-test-00007-chosen", "label_level", 4.0, "ultrafeedback-u")]),
}
PLACE = ", split string, pos bigint, config string"


@pytest.mark.parametrize("name", sorted(RAW))
def test_adapters(spark, name):
    schema, rows, want = RAW[name]
    got = adapters.adapt(spark.createDataFrame([(*r, "validation", 7, "part") for r in rows], schema + PLACE), name)
    assert tuple(got.columns) == adapters.COLUMNS
    made = got.collect()
    assert sorted(((r.id, c, r[c], r.group_key) for r in made for c in ("label_bool", "label_key", "label_level") if r[c] is not None), key=repr) == sorted(want, key=repr)
    assert {r.split for r in made} == {"validation" if name in ("banking77", "agnews", "yelp") else "test"} and all(r.instructions and r.source == name for r in made)
    assert all(r.label_key in {o.key for o in r.options} or r.label_key == "99" for r in made if r.label_key) and all(0 <= r.label_level < len(r.levels) for r in made if r.label_level is not None)


def test_every_adapter_has_a_fixture():
    assert set(RAW) == set(adapters.ADAPTERS)


def test_drop(spark):
    rows = [("passage", "q?", (["12"],)), ("passage", "q?", (["0.5"],)), ("passage", "q?", (["red"],)), ("passage", "q?", (["tan"],)), ("passage", "q?", ([],)), ("", "q?", (["sky"],))]
    df = spark.createDataFrame([(*r, "validation", i) for i, r in enumerate(rows)], "passage string, question string, answers_spans struct<spans:array<string>>, split string, pos bigint")
    got = {r.id: r for r in adapters.adapt_drop(df).collect()}
    assert {i.removeprefix("drop-validation-0000"): (r.label_level, r.label_bool) for i, r in got.items()} == {
        "0-score-0": (2.0, None), "0-score-1": (1.0, None), "0-score-2": (0.0, None), "1-score-0": (2.0, None), "1-score-1": (1.0, None), "1-score-2": (0.0, None), "2-noul-pos": (None, True), "2-noul-neg-0": (None, False), "3-noul-pos": (None, True), "3-noul-neg-0": (None, False),
    }
    assert [got[f"drop-validation-00000-score-{i}"].instructions.split("\n")[0] for i in range(3)] == ["Candidate answer: 12", "Candidate answer: 13", "Candidate answer: 43"]
    assert [got[f"drop-validation-00001-score-{i}"].instructions.split("\n")[0] for i in range(3)] == ["Candidate answer: 0.5", "Candidate answer: 0.525", "Candidate answer: 8.5"]
    assert "'red'" not in got["drop-validation-00002-noul-neg-0"].instructions


def test_hotpotqa_code_decisions_probes(spark):
    context = (["T"], [["One.", " Two."]])
    df = spark.createDataFrame([("q", "Yes", context, "comparison", "train", 0), ("q", "Rome", context, None, "train", 1), ("q", "Oslo", context, None, "train", 2)], "question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>, type string, split string, pos bigint")
    got = {r.id: r for r in adapters.adapt_hotpotqa(df).collect()}
    assert {"hotpotqa-train-00000", "hotpotqa-train-00001-t", "hotpotqa-train-00002-t"} <= set(got) and got["hotpotqa-train-00000"].label_bool and got["hotpotqa-train-00000"].state == "T: One. Two.\n\nQuestion: q"
    assert all(not r.label_bool for i, r in got.items() if i.endswith("-f"))
    code = spark.createDataFrame([("python", "train", i, f"doc {i}", f"code {i % 5}") for i in range(12)], "config string, split string, pos bigint, func_documentation_string string, func_code_string string")
    made = adapters.adapt_codesearchnet(code).collect()
    assert len(made) == 12 and all(len(r.options) == 4 and next(o.text for o in r.options if o.key == r.label_key) == f"code {int(r.state.split()[-1]) % 5}" and sum(o.text == f"code {int(r.state.split()[-1]) % 5}" for o in r.options) == 1 for r in made)
    questions = json.dumps({"a": {"type": "choice", "instructions": "i", "criteria": {"x": "X", "y": "Y"}}, "b": {"type": "score", "instructions": "i", "criteria": ["l", "m"]}, "c": {"type": "noul", "instructions": "i"}, "d": {"instructions": "i"}})
    td = spark.createDataFrame([("s", questions, json.dumps({"a": {"label": "y"}, "b": {"label": 1}, "d": {"label": 1}}), None, "train", 4)], "state string, questions string, gold string, workflow string, split string, pos bigint")
    assert {(r.id, r.label_key, r.label_level, r.group_key) for r in adapters.adapt_typed_decisions(td).collect()} == {("typed_decisions-train-00004-a", "y", None, "td-4"), ("typed_decisions-train-00004-b", None, 1.0, "td-4")}
    probes = spark.createDataFrame([("easy-1", "s", ("noul", "i", None), "yes", None, "f"), ("hard-1", "s", ("score", "i", '["l", "m"]'), "1", "g", "f")], "id string, state string, question struct<type:string,instructions:string,criteria:string>, expected string, `group` string, family string")
    assert {(r.id, r.label_bool, r.label_level, r.group_key) for r in adapters.adapt_probes(probes).collect()} == {("easy-1", True, None, "f"), ("hard-1", None, 1.0, "g")}
    intents = spark.createDataFrame([(i, f"t{i}", i % 3) for i in range(9)], "pos bigint, text string, intent int")
    few = adapters.intent_items(intents, ["a_b", "oos", "c"], 4, classes=2).collect()
    assert len(few) == 4 and {r.label_key for r in few} <= {"a_b", "c"} and few[0].options[0].text == "a b"
    with pytest.raises(ValueError):
        adapters.intent_items(intents, ["a", "oos"], 4)


def test_examples(spark):
    hot = spark.createDataFrame([("7", "q", " Rome ", (["A", "B"], [["x.", "y."], ["z."]]), (["B"],), "bridge", "train"), ("8", "", "a", (["A"], [["x"]]), ([],), None, "train")], "id string, question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>>, type string, split string")
    got = adapters.example(hot, "hotpotqa").collect()
    assert [(r.id, r.answer, [tuple(p) for p in r.paragraphs], r.supporting) for r in got] == [("hotpotqa-long-7", "Rome", [("A", "x. y."), ("B", "z.")], ["B"])]
    race = spark.createDataFrame([("e", "art", "q", ["1 ", "2", "3", "4"], "b", "test"), ("f", "art", "q", ["1", "", "3", "4"], "A", "test")], "example_id string, article string, question string, options array<string>, answer string, split string")
    got = adapters.example(race, "race")
    assert [(r.id, r.answer, r.answer_index) for r in got.collect()] == [("race-e", "2", 1)] and {r.text for r in adapters.answer_pool(got).collect()} == {"1", "2", "3", "4"}
    bench = spark.createDataFrame([("1", "qasper", "ctx", "q", ["", " one ", "two"], "test")], "_id string, subset string, context string, input string, answers array<string>, split string")
    assert [(r.id, r.answer, r.aliases, r.group) for r in adapters.example(bench, "longbench").collect()] == [("longbench-qasper-1", "one", ["two"], "qasper")]
    mus = spark.createDataFrame([("1", "q", "a", ["b "], [("T", " text ", True), ("U", "", False)], ["x", "y"], True, "train"), ("2", "q", "a", [], [("T", "t", True)], [], False, "train")], "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<string>, answerable boolean, split string")
    assert [(r.id, r.group, r.supporting, r.aliases) for r in adapters.example(mus, "musique").collect()] == [("musique-long-1", "2hop", ["T"], ["b"])]
    pro = spark.createDataFrame([("1", "q", ["x", "y "], 1, "law", "test"), ("2", "q", ["x"], 3, "law", "test")], "question_id string, question string, options array<string>, answer_index int, category string, split string")
    assert [(r.id, r.answer, r.group) for r in adapters.example(pro, "mmlu_pro").collect()] == [("mmlu-pro-1", "y", "short_reasoning:law")]
    wiki = spark.createDataFrame([("1", "q", "a", [("T", ["s", "t"])], [("T", 0)], None, "train")], "_id string, question string, answer string, context array<struct<title:string,sentences:array<string>>>, supporting_facts array<struct<title:string,place:int>>, type string, split string")
    assert [(r.id, r.group, r.paragraphs[0].text) for r in adapters.example(wiki, "twowiki").collect()] == [("2wiki-long-1", "unknown", "s t")]


def test_corpora_and_locks(spark, tmp_path):
    a = spark.createDataFrame([("1", "s")], "id string, source string")
    assert [r.corpus for r in tables.load_all({"x": a, "y": a}, ["y"]).collect()] == ["y"]
    with pytest.raises(ValueError, match="unknown"):
        tables.load_all({"x": a}, ["z"])
    assert {(r.corpus, r.n, r.missing) for r in tables.coverage(tables.load_all({"x": a}), ["x", "z"]).collect()} == {("x", 1, False), ("z", 0, True)}
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{"id": \n')
    assert [(r.line_no, r.line) for r in tables.bad_lines(spark, str(tmp_path / "bad.jsonl")).collect()] == [(3, '{"id": ')]
    names = spark.createDataFrame([("d/base_probs_x.jsonl",), ("law_families.jsonl",), ("law_labels.jsonl",), ("other.jsonl",)], "f string")
    assert [r[0] for r in names.select(tables.file_kind("f")).collect()] == ["probs", "families", "labels", "typed"]
    lock = {"repo": "r", "revision": "0" * 40, "files": {"a/x.jsonl": {"sha256": "0" * 64, "bytes": 1}, "b.txt": {"sha256": "1" * 64, "bytes": 2}}}
    assert list(tables.select_files(tables.check_lock(lock), ["a/*"])) == ["a/x.jsonl"]
    for bad in ({**lock, "revision": "main"}, {**lock, "files": {"../x": {"sha256": "0" * 64, "bytes": 1}}}, {**lock, "files": {"x": {"sha256": "0", "bytes": 1}}}, {"repo": "r"}):
        with pytest.raises(ValueError):
            tables.check_lock(bad)
    with pytest.raises(ValueError):
        tables.select_files(lock["files"], ["c/*"])
    assert tables.merged_shards([a, a.withColumn("id", F.lit("2"))], "id").count() == 2
    with pytest.raises(ValueError):
        tables.merged_shards([a, a], "id")
    a.coalesce(1).write.parquet(str(tmp_path / "t" / "p1"))
    a.withColumn("extra", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "t" / "p2"))
    assert sorted(r.extra is None for r in tables.sharded(spark, str(tmp_path / "t")).collect()) == [False, True]
