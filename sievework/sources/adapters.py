"""Public datasets to typed questions: a line or two of expressions each, one adapter for all.

The raw rows are those of the datasets' own public releases, staged as files; nothing is downloaded here. Beside its own columns a raw
frame has split (the release's name of the split), pos (the row's number in it, from 0) and, where a release has several parts, config.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.questions import _numbers
from sievework.operators.running import running_sums
from sievework.operators.skew import lookup

COLUMNS = ("id", "state", "q_type", "instructions", "options", "levels", "label_bool", "label_key", "label_level", "source", "split", "group_key")
#: SQL of the split that a release's split goes to, and of a row's number as it stands in ids.
OUT = "CASE WHEN split LIKE 'train%' OR split = 'auxiliary_train' THEN 'train' ELSE 'test' END"
NO = "format_string('%05d', pos)"


@dataclass(frozen=True)
class Adapter:
    """SQL expressions over a raw row. label: boolean, key or level by kind; options: array of (key, text); levels: texts of a score; keep: rows that are used; each: array to make a row of each element `e`;
    train_rows, test_rows: at most so many raw rows of a side, drawn by hash."""

    kind: str
    state: str
    label: str
    instructions: str
    group: str
    options: str = ""
    levels: tuple[str, ...] = ()
    keep: str = "true"
    each: str = ""
    id: str = f"concat_ws('-', name, split, {NO})"
    out: str = OUT
    train_rows: int | None = None
    test_rows: int | None = None


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fixed(options: dict[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('key', {_quoted(k)}, 'text', {_quoted(t)})" for k, t in options.items()) + ")"


def _lettered(*texts: str) -> str:
    return "array(" + ", ".join(f"named_struct('key', '{'ABCDEFGH'[i]}', 'text', {t})" for i, t in enumerate(texts)) + ")"


def _letters(texts: str) -> str:
    return f"transform({texts}, (t, i) -> named_struct('key', substr('ABCDEFGH', i + 1, 1), 'text', t))"


def _every(n: int) -> str:
    return f"concat(name, '-', pmod(pos, {n}))"


def _given(*columns: str) -> str:
    return " AND ".join(f"coalesce({c}, '') <> ''" for c in columns)


_ZIPPED = "transform(arrays_zip(choices.label, choices.text), c -> named_struct('key', c.label, 'text', c.text))"
_PAIR = "concat('Premise: ', {0}, '\\nHypothesis: ', {1})"
_ENTAILS = "'Does the premise entail the hypothesis?'"

# fixed values: names of classes and levels, as the releases or their questions have them
BANKING_INTENTS = (
    "activate_my_card age_limit apple_pay_or_google_pay atm_support automatic_top_up balance_not_updated_after_bank_transfer balance_not_updated_after_cheque_or_cash_deposit beneficiary_not_allowed cancel_transfer card_about_to_expire "
    "card_acceptance card_arrival card_delivery_estimate card_linking card_not_working card_payment_fee_charged card_payment_not_recognised card_payment_wrong_exchange_rate card_swallowed cash_withdrawal_charge cash_withdrawal_not_recognised "
    "change_pin compromised_card contactless_not_working country_support declined_card_payment declined_cash_withdrawal declined_transfer direct_debit_payment_not_recognised disposable_card_limits edit_personal_details exchange_charge "
    "exchange_rate exchange_via_app extra_charge_on_statement failed_transfer fiat_currency_support freeze_card get_disposable_virtual_card get_physical_card getting_spare_card getting_virtual_card lost_or_stolen_card lost_or_stolen_phone "
    "order_physical_card passcode_forgotten pending_card_payment pending_cash_withdrawal pending_top_up pending_transfer pin_blocked receiving_money Refund_not_showing_up request_refund reverted_card_payment? signing_up spare_card "
    "supported_cards_and_currencies terminate_account top_up_by_bank_transfer_charge top_up_by_card_charge top_up_by_cash_or_cheque top_up_failed top_up_limits top_up_reverted topping_up_by_card transaction_charged_twice transfer_fee_charged "
    "transfer_into_account transfer_not_received_by_recipient transfer_timing unable_to_verify_identity verify_my_identity verify_source_of_funds verify_top_up virtual_card_not_working visa_or_mastercard why_verify_identity "
    "wrong_amount_of_cash_received wrong_exchange_rate_for_cash_withdrawal"
).split()
_BANKING = "array(" + ", ".join(_quoted(x) for x in BANKING_INTENTS) + ")"
NEWS = {"world": "World news and international affairs", "sports": "Sports news and athletics", "business": "Business and financial news", "science_technology": "Science and technology news"}
VERDICTS = {"supports": "The evidence supports the claim", "refutes": "The evidence refutes or contradicts the claim", "nei": "There is not enough information to verify the claim"}
SIMILARITY = ("No similarity", "Slight similarity", "Moderate similarity", "Good similarity", "Strong similarity", "Perfect similarity")
SENTIMENT = ("Very negative", "Negative", "Neutral", "Positive", "Very positive")
STARS = ("1 star — Terrible", "2 stars — Poor", "3 stars — Average", "4 stars — Good", "5 stars — Excellent")
QUALITY = ("Very poor", "Poor", "Fair", "Good", "Excellent")
ATTRIBUTES = {
    "helpfulness": ("How helpful is the response to the prompt?", ("Not helpful at all", "Slightly helpful", "Moderately helpful", "Very helpful", "Extremely helpful")),
    "correctness": ("How factually correct is the response?", ("Completely incorrect", "Mostly incorrect", "Partially correct", "Mostly correct", "Completely correct")),
    "coherence": ("How coherent and well organized is the response?", ("Incoherent", "Poorly organized", "Somewhat coherent", "Coherent", "Highly coherent")),
    "complexity": ("How complex is the response?", ("Very simple", "Simple", "Moderately complex", "Complex", "Very complex")),
    "verbosity": ("How verbose is the response?", ("Very concise", "Concise", "Moderately verbose", "Verbose", "Very verbose")),
}
ANSWER_LEVELS = ("Incorrect: the candidate is not the answer in the passage", "Close: the candidate is approximately correct but not exact", "Exact: the candidate matches the answer in the passage exactly")

ADAPTERS = {
    "sst2": Adapter("noul", "sentence", "label = 1", "'Is the sentiment of this sentence positive?'", _every(50), keep="label IN (0, 1)", id=f"concat_ws('-', name, {OUT}, {NO})"),
    "mnli": Adapter("noul", _PAIR.format("premise", "hypothesis"), "label = 0", _ENTAILS, f"coalesce(genre, {_every(50)})", keep="label <> -1", id=f"concat_ws('-', name, {OUT}, {NO})"),
    "boolq": Adapter("noul", "concat('Passage: ', passage, '\n\nQuestion: ', question)", "answer", "'Based on the passage, is the answer yes?'", _every(100), keep=f"answer IS NOT NULL AND {_given('passage', 'question')}"),
    "multirc": Adapter("noul", "concat('Passage: ', paragraph, '\n\nQuestion: ', question, '\n\nAnswer: ', answer)", "label = 1", "'Is this answer correct for the given question and passage?'", "concat('multirc-p', coalesce(idx.paragraph, pmod(pos, 50)))", keep=f"label IN (0, 1) AND {_given('paragraph', 'question', 'answer')}"),
    "tabfact": Adapter("noul", "concat('Table: ', coalesce(table_caption, ''), '\n', coalesce(table_text, ''), '\n\nStatement: ', statement)", "label = 1", "'Is the statement entailed by the table?'", f"coalesce(table_id, {_every(200)})"),
    "fever": Adapter(
        "choice", "concat('Claim: ', claim, '\n\nEvidence:\n', coalesce(nullif(array_join(transform(filter(evidence, e -> size(e) >= 2), e -> try_element_at(e, -1)), '\n'), ''), '(no evidence)'))",
        "try_element_at(map('SUPPORTS', 'supports', 'REFUTES', 'refutes', 'NOT ENOUGH INFO', 'nei'), label)", "'Based on the evidence, what is the verdict on this claim?'", _every(200), options=_fixed(VERDICTS),
    ),
    "mednli": Adapter("noul", _PAIR.format("sentence1", "sentence2"), "gold_label = 'entailment'", _ENTAILS, _every(50), keep=f"gold_label IN ('entailment', 'contradiction', 'neutral') AND {_given('sentence1', 'sentence2')}"),
    "contractnli": Adapter("noul", "concat('Contract clause: ', premise, '\n\nProposition: ', hypothesis)", "label = 1", "'Does the contract clause entail the proposition?'", "concat('contractnli-', config)", keep=f"label IN (0, 1, 2) AND {_given('premise', 'hypothesis')}", id=f"concat_ws('-', name, config, split, {NO})"),
    "anli": Adapter("noul", _PAIR.format("premise", "hypothesis"), "label = 0", _ENTAILS, "concat('anli-', element_at(split(split, '_'), -1))", keep="label IN (0, 1, 2)", id=f"concat_ws('-', name, element_at(split(split, '_'), -1), element_at(split(split, '_'), 1), {NO})"),
    "banking77": Adapter("choice", "text", f"coalesce(get({_BANKING}, label), cast(label AS string))", "'Which banking intent category does this customer message belong to?'", _every(100), options=f"transform({_BANKING}, k -> named_struct('key', k, 'text', replace(k, '_', ' ')))", out="split"),
    "agnews": Adapter("choice", "text", "coalesce(get(array('world', 'sports', 'business', 'science_technology'), label), cast(label AS string))", "'Which news category does this article belong to?'", _every(200), options=_fixed(NEWS), out="split"),
    "arc": Adapter("choice", "question", "answerKey", "'Which answer is correct?'", "concat('arc-', lower(config))", options=_ZIPPED, keep="exists(choices.label, k -> k = answerKey)", id=f"concat_ws('-', name, lower(config), split, {NO})"),
    "commonsenseqa": Adapter("choice", "question", "answerKey", "'Answer this commonsense reasoning question.'", _every(100), options=_ZIPPED, keep="size(choices.label) = size(choices.text) AND exists(choices.label, k -> k = answerKey)"),
    "race": Adapter("choice", "article", "answer", "concat('Based on the passage above, answer: ', question)", "concat('race-', config)", options=_letters("options"), keep="size(options) = 4 AND answer IN ('A', 'B', 'C', 'D')", id=f"concat_ws('-', name, config, split, {NO})"),
    "hellaswag": Adapter("choice", "CASE WHEN activity_label <> '' THEN concat(activity_label, ': ', ctx) ELSE ctx END", "cast(label AS string)", "'Which ending most naturally completes the context?'", f"coalesce(nullif(activity_label, ''), {_every(100)})", options="transform(endings, (t, i) -> named_struct('key', cast(i AS string), 'text', t))", keep="size(endings) = 4 AND cast(label AS string) IN ('0', '1', '2', '3')"),
    "swag": Adapter("choice", "startphrase", "substr('ABCD', label + 1, 1)", "'Which ending most naturally completes the sentence?'", f"coalesce(`video-id`, {_every(100)})", options=_lettered("ending0", "ending1", "ending2", "ending3"), keep=f"label BETWEEN 0 AND 3 AND {_given('startphrase', 'ending0', 'ending1', 'ending2', 'ending3')}"),
    "mmlu": Adapter(
        "choice", "question", "substr('ABCD', answer + 1, 1)", "CASE WHEN coalesce(subject, '') NOT IN ('', 'unknown') THEN concat('Answer this ', replace(subject, '_', ' '), ' question.') ELSE 'Answer this multiple-choice question.' END",
        "concat('mmlu-', coalesce(nullif(subject, ''), 'unknown'))", options=_letters("choices"), keep="size(choices) = 4 AND answer BETWEEN 0 AND 3",
    ),
    "winogrande": Adapter("choice", "sentence", "cast(answer AS string)", "'Which option best fills the blank in the sentence?'", _every(100), options="array(named_struct('key', '1', 'text', option1), named_struct('key', '2', 'text', option2))", keep=f"cast(answer AS string) IN ('1', '2') AND {_given('sentence')}"),
    "piqa": Adapter("choice", "goal", "substr('AB', label + 1, 1)", "'Which solution best achieves the goal?'", _every(100), options=_lettered("sol1", "sol2"), keep=f"label IN (0, 1) AND {_given('goal', 'sol1', 'sol2')}"),
    "logiqa": Adapter("choice", "CASE WHEN context <> '' THEN concat(context, '\n\nQuestion: ', query) ELSE query END", "substr('ABCD', correct_option + 1, 1)", "'Which answer is correct based on logical reasoning?'", _every(100), options=_letters("options"), keep="size(options) = 4 AND correct_option BETWEEN 0 AND 3"),
    "quality": Adapter(
        "choice", "concat(article, '\n\nQuestion: ', question)", "substr('ABCD', CASE WHEN answer BETWEEN 0 AND 3 THEN answer + 1 ELSE answer END, 1)", "'Which answer is correct based on the passage?'", "concat('quality-', coalesce(set_unique_id, cast(pos AS string)))",
        options=_letters("options"), keep=f"size(options) = 4 AND answer BETWEEN 0 AND 4 AND {_given('article', 'question')}",
    ),
    "stsb": Adapter("score", "concat('Sentence A: ', sentence1, '\nSentence B: ', sentence2)", "cast(least(5, greatest(0, bround(label))) AS double)", "'How semantically similar are these two sentences?'", _every(50), levels=SIMILARITY, keep="label >= 0"),
    "sst5": Adapter("score", "text", "cast(label AS double)", "'What is the sentiment of this sentence?'", _every(50), levels=SENTIMENT),
    "yelp": Adapter("score", "text", "cast(label AS double)", "'What star rating does this review correspond to?'", _every(200), levels=STARS, keep=_given("text"), out="split", train_rows=20_000),
    "helpsteer": Adapter(
        "score", "concat('Prompt: ', prompt, '\n\nResponse: ', response)", "cast(e.value AS double)", "e.question", _every(100), levels=("e.levels",), keep=f"e.value BETWEEN 0 AND 4 AND {_given('prompt', 'response')}", id=f"concat_ws('-', name, {OUT}, {NO}, e.name)", train_rows=5_000, test_rows=1_000,
        each="array(" + ", ".join(f"named_struct('name', '{n}', 'value', {n}, 'question', {_quoted(q)}, 'levels', array({', '.join(map(_quoted, ls))}))" for n, (q, ls) in ATTRIBUTES.items()) + ")",
    ),
    "wmt_da": Adapter(
        "score", "concat('Source: ', src, '\n\nTranslation: ', mt)", "cast(least(4, greatest(0, floor(try_cast(raw AS double) / 20))) AS double)", "'How well does the translation preserve the meaning and quality of the source text?'", "concat('wmt-da-', coalesce(lp, 'unknown'))",
        levels=QUALITY, keep=f"try_cast(raw AS double) IS NOT NULL AND {_given('src', 'mt')}", out="CASE WHEN cast(year AS string) = '2022' THEN 'test' ELSE 'train' END", id=f"concat_ws('-', 'wmt-da', CASE WHEN cast(year AS string) = '2022' THEN 'test' ELSE 'train' END, {NO})", train_rows=25_000, test_rows=2_000,
    ),
    "ultrafeedback": Adapter(
        "score", "concat('Instruction: ', prompt, '\n\nResponse: ', try_element_at(filter(e.messages, m -> m.role = 'assistant'), -1).content)", "cast(least(4, greatest(0, int((e.score - 1) / 9 * 5))) AS double)", "'How well does the response satisfy the instruction?'",
        "concat('ultrafeedback-', coalesce(prompt_id, cast(pos AS string)))", levels=QUALITY, keep=f"score_chosen IS NOT NULL AND score_rejected IS NOT NULL AND {_given('prompt')} AND exists(e.messages, m -> m.role = 'assistant') AND try_element_at(filter(e.messages, m -> m.role = 'assistant'), -1).content <> ''",
        each="array(named_struct('name', 'chosen', 'messages', chosen, 'score', score_chosen), named_struct('name', 'rejected', 'messages', rejected, 'score', score_rejected))", id=f"concat_ws('-', name, {OUT}, {NO}, e.name)", train_rows=12_500, test_rows=1_000,
    ),
}


def question(kind: str, *, id: Column, state: Column, instructions: Column, label: Column, source: Column, split: Column, group: Column, options: Column | None = None, levels: Column | None = None) -> list[Column]:  # noqa: A002
    """The columns of a typed question of a kind: noul (with options as other wordings, if given), choice or score."""
    nothing = lambda t: F.lit(None).cast(t)
    return [
        id.alias("id"), state.alias("state"), F.lit(kind).alias("q_type"), instructions.alias("instructions"), (options if options is not None else nothing("array<struct<key:string,text:string>>")).alias("options"), (levels if levels is not None else nothing("array<string>")).alias("levels"),
        (label.cast("boolean") if kind == "noul" else nothing("boolean")).alias("label_bool"), (label.cast("string") if kind == "choice" else nothing("string")).alias("label_key"), (label.cast("double") if kind == "score" else nothing("double")).alias("label_level"),
        source.alias("source"), split.alias("split"), group.alias("group_key"),
    ]


def sampled(df: DataFrame, most: int | None, seed: int = 42) -> DataFrame:
    """At most so many rows, drawn by hash of split and pos."""
    return df if most is None else df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "split", F.col("pos").cast("string"))), "pos").limit(most)


def adapt(df: DataFrame, name: str) -> DataFrame:
    """Raw rows of a dataset as questions, the columns of COLUMNS. A row without a state or a label is left out. config may be missing where an adapter doesn't read it."""
    a = ADAPTERS[name]
    rows = df.withColumn("name", F.lit(name))
    if a.train_rows or a.test_rows:
        side = F.expr(a.out) == "train"
        rows = sampled(rows.where(side), a.train_rows).unionByName(sampled(rows.where(~side), a.test_rows))
    if a.each:
        rows = rows.withColumn("e", F.explode(F.expr(a.each)))
    levels = None if not a.levels else F.expr(a.levels[0]) if a.each and a.levels[0].startswith("e.") else F.array(*map(F.lit, a.levels))
    made = rows.where(a.keep).select(*question(a.kind, id=F.expr(a.id), state=F.expr(a.state), instructions=F.expr(a.instructions), label=F.expr(a.label), source=F.lit(name), split=F.expr(a.out), group=F.expr(a.group).cast("string"), options=F.expr(a.options) if a.options else None, levels=levels))
    return made.where("state IS NOT NULL AND coalesce(cast(label_bool AS string), label_key, cast(label_level AS string)) IS NOT NULL")


def adapt_hotpotqa(df: DataFrame, seed: int = 42, train_rows: int | None = 10_000) -> DataFrame:
    """Multi-hop rows: a yes or no answer is a noul question; another is asked about as it is (true), and once more with an answer drawn by hash from all rows of the split (false), unless that is the same."""
    rows = sampled(df.where("split LIKE 'train%'"), train_rows, seed).unionByName(df.where("NOT split LIKE 'train%'"))
    rows = rows.where(f"{_given('question', 'answer')} AND size(context.sentences) > 0").withColumn("row_no", F.concat_ws(":", "split", F.col("pos").cast("string")))
    paragraphs = F.expr("array_join(transform(arrays_zip(context.title, context.sentences), p -> concat(p.title, ': ', array_join(p.sentences, ''))), '\n\n')")
    base = rows.select("row_no", "split", "pos", F.concat(paragraphs, F.lit("\n\nQuestion: "), "question").alias("state"), "answer", F.lower("answer").isin("yes", "no").alias("polar"), F.concat(F.lit("hotpotqa-"), F.coalesce("type", F.lit("bridge"))).alias("group"))
    pool = running_sums(base.where("NOT polar").select("split", "pos", F.col("answer").alias("wrong")), ["split"], [F.col("pos")], {})
    sizes = pool.groupBy("split").agg(F.max("_n").alias("most"))
    asked = base.where("NOT polar").join(sizes, "split").withColumn("at", F.struct("split", F.element_at(_numbers(F.col("most"), F.lit(1), f"{seed}:hotpotqa"), 1).alias("n")))
    wrong = lookup(asked, pool.select(F.struct("split", F.col("_n").cast("bigint").alias("n")).alias("at"), "wrong"), "at", "row_no", how="inner").where(F.lower("wrong") != F.lower("answer"))
    number = F.concat_ws("-", F.lit("hotpotqa"), "split", F.format_string("%05d", "pos"))
    told = lambda c: F.concat(F.lit("Based on the passages, is '"), c, F.lit("' the correct answer?"))
    made = lambda part, suffix, text, label: part.select(*question("noul", id=F.concat(number, F.lit(suffix)), state=F.col("state"), instructions=text, label=label, source=F.lit("hotpotqa"), split=F.expr(OUT), group=F.col("group")))
    polar = made(base.where("polar"), "", F.concat(F.lit("Based on the passages, is the answer '"), F.lower("answer"), F.lit("'?")), F.lower("answer") == "yes")
    return polar.unionByName(made(base.where("NOT polar"), "-t", told(F.col("answer")), F.lit(True))).unionByName(made(wrong, "-f", told(F.col("wrong")), F.lit(False)))


#: Answers of one length that are tried as a wrong one.
_TRIED = 8


def adapt_drop(df: DataFrame) -> DataFrame:
    """Reading rows with short answers. A number becomes three score questions, about itself (exact), a close and a far number; another answer two noul questions, about itself (true) and about one of the same length,
    or one more or less (false): of those of a length in row order, the first that is another, counting on from the row's number. Up to _TRIED of each length are tried."""
    gold = F.trim(F.try_element_at("answers_spans.spans", F.lit(1)))
    rows = df.where("size(answers_spans.spans) > 0").select("split", "pos", "passage", "question", gold.alias("gold")).where("gold <> ''")
    rows = rows.withColumns({"row_no": F.concat_ws(":", "split", F.col("pos").cast("string")), "len": F.length("gold"), "value": F.expr("try_cast(replace(gold, ',', '') AS double)")})
    usable = rows.where(_given("passage", "question"))
    number = F.concat_ws("-", F.lit("drop"), "split", F.format_string("%05d", "pos"))
    state = F.concat("passage", F.lit("\n\nQuestion: "), "question")
    v = F.col("value")
    whole = v == F.floor(v)
    as_text = lambda c: F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.round(c, 6).cast("string"), r"\.0$", ".0"))
    close = F.when(whole, v + 1).otherwise(F.when(F.round(v * 1.05, 6) == v, v + 1).otherwise(F.round(v * 1.05, 6)))
    graded = F.array(*(F.struct(F.lit(x).alias("label"), as_text(c).alias("candidate"), F.lit(i).alias("i")) for i, (x, c) in enumerate(((2.0, v), (1.0, close), (0.0, v * 3 + 7)))))
    scores = usable.where("value IS NOT NULL").withColumn("e", F.explode(graded)).select(*question(
        "score", id=F.concat(number, F.lit("-score-"), F.col("e.i").cast("string")), state=state, instructions=F.concat(F.lit("Candidate answer: "), "e.candidate", F.lit("\nIs this candidate answer supported by the passage?")), label=F.col("e.label"), source=F.lit("drop"), split=F.expr(OUT), group=number, levels=F.array(*map(F.lit, ANSWER_LEVELS)),
    ))
    words = usable.where("value IS NULL")
    numbered = running_sums(rows.select("split", "len", "pos", F.col("gold").alias("other")), ["split", "len"], [F.col("pos")], {})
    sizes = numbered.groupBy("split", "len").agg(F.max("_n").alias("size"))
    lengths = F.array(*(F.struct(F.lit(i).alias("turn"), (F.col("len") + d).alias("length")) for i, d in enumerate((0, 1, -1))))
    asked = words.select("row_no", "split", "pos", "gold", F.explode(lengths).alias("e")).select("row_no", "split", "pos", "gold", "e.*").join(sizes.withColumnRenamed("len", "length"), ["split", "length"])
    tried = asked.withColumn("offset", F.explode(F.sequence(F.lit(1), F.least(F.lit(_TRIED), F.col("size")).cast("int")))).withColumn("at", F.struct("split", "length", (F.pmod(F.col("pos") + F.col("offset"), F.col("size")) + 1).cast("bigint").alias("n")))
    met = lookup(tried, numbered.select(F.struct("split", F.col("len").alias("length"), F.col("_n").cast("bigint").alias("n")).alias("at"), "other"), "at", "row_no", how="inner").where("other <> gold")
    wrong = met.groupBy("row_no").agg(F.min_by("other", F.struct("turn", "offset")).alias("wrong"))
    told = lambda c: F.concat(F.lit("Based on the passage, is '"), c, F.lit("' the correct answer to the question?"))
    made = lambda part, suffix, text, label: part.select(*question("noul", id=F.concat(number, F.lit(suffix)), state=state, instructions=text, label=label, source=F.lit("drop"), split=F.expr(OUT), group=number))
    return scores.unionByName(made(words, "-noul-pos", told(F.col("gold")), F.lit(True))).unionByName(made(words.join(wrong, "row_no"), "-noul-neg-0", told(F.col("wrong")), F.lit(False)))


def adapt_codesearchnet(df: DataFrame, seed: int = 42, train_rows: int | None = 3_000) -> DataFrame:
    """Which code a documentation string is of: the row's, and three others of its language (config) and split, drawn by hash, at a place drawn by hash. Rows whose draws give no three other codes are left out."""
    rows = df.select("config", "split", "pos", F.trim("func_documentation_string").alias("doc"), F.trim("func_code_string").alias("code")).where(_given("doc", "code"))
    kept = running_sums(rows.withColumn("d", F.md5(F.concat_ws(":", F.lit(str(seed)), "config", "split", F.col("pos").cast("string")))), ["config", "split"], [F.col("d"), F.col("pos")], {})
    if train_rows is not None:
        kept = kept.where(~F.col("split").startswith("train") | (F.col("_n") <= train_rows))
    kept = kept.withColumn("row_no", F.concat_ws(":", "config", "split", F.col("pos").cast("string")))
    sizes = kept.groupBy("config", "split").agg(F.max("_n").alias("size"))
    asked = kept.join(sizes, ["config", "split"]).select("row_no", "config", "split", F.posexplode(_numbers(F.col("size"), F.lit(16), f"{seed}:code")).alias("turn", "n")).withColumn("at", F.struct("config", "split", "n"))
    met = lookup(asked, kept.select(F.struct("config", "split", F.col("_n").cast("bigint").alias("n")).alias("at"), F.col("code").alias("other")), "at", "row_no", how="inner").join(kept.select("row_no", "code"), "row_no").where("other <> code")
    three = met.groupBy("row_no").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", "other"))), 1, 3).alias("o")).where("size(o) = 3")  # 16 at most
    place = F.pmod(F.xxhash64(F.lit(seed), "row_no"), F.lit(4)).cast("int")
    texts = F.transform("o", lambda e: e["other"])
    options = F.concat(F.slice(texts, F.lit(1), F.col("place")), F.array("code"), F.slice(texts, F.col("place") + 1, F.lit(3)))
    made = kept.join(three, "row_no").withColumn("place", place).withColumn("texts", options)
    return made.select(*question(
        "choice", id=F.concat_ws("-", F.lit("codesearchnet"), "config", "split", F.format_string("%05d", "pos")), state=F.concat(F.lit("Docstring: "), "doc"), instructions=F.concat(F.lit("Which "), "config", F.lit(" code snippet correctly implements the described functionality?")),
        label=F.substring(F.lit("ABCD"), F.col("place") + 1, F.lit(1)), source=F.lit("codesearchnet"), split=F.expr(OUT), group=F.concat(F.lit("codesearchnet-"), "config"), options=F.expr(_letters("texts")),
    ))


def adapt_typed_decisions(df: DataFrame) -> DataFrame:
    """Rows of a state with several questions (JSON by id) and their answers (JSON by id): a row for each question with a type and an answer. Options and levels come from its criteria."""
    q = df.select("split", "pos", "workflow", "state", F.explode(F.from_json("questions", "map<string,string>")).alias("qid", "q"), F.from_json("gold", "map<string,string>").alias("gold"))
    told = q.select("*", F.get_json_object("q", "$.type").alias("type"), F.get_json_object("q", "$.instructions").alias("instructions"), F.get_json_object("q", "$.criteria").alias("criteria"), F.get_json_object(F.try_element_at("gold", F.col("qid")), "$.label").alias("label")).where("type IS NOT NULL AND label IS NOT NULL")
    keyed = F.transform(F.map_entries(F.from_json("criteria", "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text")))
    common = dict(id=F.concat_ws("-", F.lit("typed_decisions"), "split", F.format_string("%05d", "pos"), "qid"), state=F.col("state"), instructions=F.col("instructions"), source=F.lit("typed_decisions"), split=F.col("split"), group=F.coalesce("workflow", F.concat(F.lit("td-"), F.pmod("pos", F.lit(20)).cast("string"))))
    noul = told.where("type = 'noul'").select(*question("noul", label=F.lower("label").isin("true", "yes", "1"), **common))
    choice = told.where("type = 'choice'").select(*question("choice", label=F.col("label"), options=keyed, **common))
    score = told.where("type = 'score'").select(*question("score", label=F.expr("try_cast(label AS double)"), levels=F.from_json("criteria", "array<string>"), **common))
    return noul.unionByName(choice).unionByName(score)


def adapt_probes(df: DataFrame) -> DataFrame:
    """Held-out tasks as they are published: id, state, question struct (type, instructions, criteria as JSON), expected, group, family. yes is true; a score is a number. All are test rows."""
    kind = F.col("question.type")
    keyed = F.transform(F.map_entries(F.from_json("question.criteria", "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text")))
    common = dict(id=F.col("id"), state=F.col("state"), instructions=F.col("question.instructions"), source=F.lit("probes"), split=F.lit("test"), group=F.coalesce("group", "family"))
    noul = df.where(kind == "noul").select(*question("noul", label=F.col("expected") == "yes", **common))
    choice = df.where(kind == "choice").select(*question("choice", label=F.col("expected"), options=keyed, **common))
    score = df.where(kind == "score").select(*question("score", label=F.expr("try_cast(expected AS double)"), levels=F.from_json("question.criteria", "array<string>"), **common))
    return noul.unionByName(choice).unionByName(score)


def intent_items(df: DataFrame, names: list[str], count: int, seed: int = 42, classes: int = 150, outside: str = "oos") -> DataFrame:
    """Rows (pos, text, intent as an index of names) inside the classes, the first count in an order drawn by hash: id, state, options, label_key, place. Refuses another number of classes."""
    inside = [n for n in names if n != outside]
    if len(inside) != classes:
        raise ValueError(f"expected {classes} classes, got {len(inside)}")
    label = F.get(F.array(*map(F.lit, names)), F.col("intent"))
    kept = df.withColumn("label_key", label).where(F.col("label_key").isNotNull() & (F.col("label_key") != outside)).withColumn("d", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pos").cast("string"))))
    first = kept.orderBy("d", "pos").limit(count)
    options = F.array(*(F.struct(F.lit(n).alias("key"), F.lit(n.replace("_", " ")).alias("text")) for n in inside))
    return first.select(F.concat(F.lit("clinc150-test-"), F.format_string("%05d", "pos")).alias("id"), F.col("text").alias("state"), options.alias("options"), "label_key")


# ---- rows of long-context sources in one shape

_PARAGRAPHS = "filter(transform({0}, p -> named_struct('title', coalesce(cast(p.{1} AS string), ''), 'text', trim({2}))), p -> p.text <> '')"
#: Expressions of id, question, answer, paragraphs, supporting (titles), options (of a row that has its own), answer_index, aliases, group; and which rows are used.
EXAMPLES = {
    "hotpotqa": dict(
        id="concat('hotpotqa-long-', id)", paragraphs="transform(arrays_zip(context.title, context.sentences), p -> named_struct('title', p.title, 'text', array_join(p.sentences, ' ')))", supporting="array_distinct(supporting_facts.title)", group="coalesce(type, 'unknown')",
    ),
    "musique": dict(
        id="concat('musique-long-', id)", paragraphs=_PARAGRAPHS.format("paragraphs", "title", "coalesce(p.paragraph_text, '')"), supporting="array_distinct(transform(filter(paragraphs, p -> p.is_supporting AND trim(p.paragraph_text) <> ''), p -> p.title))",
        aliases="transform(coalesce(answer_aliases, array()), a -> trim(a))", group="concat(greatest(0, size(question_decomposition)), 'hop')", keep="coalesce(answerable, true)",
    ),
    "mmlu_pro": dict(id="concat('mmlu-pro-', question_id)", paragraphs="array(named_struct('title', '', 'text', trim(question)))", supporting="array('')", options="transform(options, o -> trim(o))", answer_index="answer_index", group="concat('short_reasoning:', coalesce(category, 'unknown'))"),
    "race": dict(
        id="concat('race-', example_id)", paragraphs="array(named_struct('title', '', 'text', trim(article)))", supporting="array('')", options="transform(options, o -> trim(o))", answer_index="locate(upper(trim(answer)), 'ABCD') - 1", group="'short_passage_rc'",
        keep="size(options) = 4 AND forall(options, o -> trim(o) <> '') AND upper(trim(answer)) IN ('A', 'B', 'C', 'D') AND trim(article) <> ''",
    ),
    "longbench": dict(
        id="concat('longbench-', subset, '-', _id)", question="trim(input)", answer="get(filter(transform(answers, a -> trim(a)), a -> a <> ''), 0)", aliases="slice(filter(transform(answers, a -> trim(a)), a -> a <> ''), 2, 1000)", paragraphs="array(named_struct('title', '', 'text', trim(context)))", supporting="array('')", group="subset", keep="trim(context) <> ''",
    ),
    "twowiki": dict(id="concat('2wiki-long-', _id)", paragraphs=_PARAGRAPHS.format("context", "title", "array_join(p.sentences, ' ')"), supporting="array_distinct(transform(supporting_facts, f -> f.title))", group="coalesce(type, 'unknown')"),
}


def example(df: DataFrame, name: str) -> DataFrame:
    """Rows of a long-context source in one shape: id, question, answer, paragraphs, supporting, options, answer_index, aliases, group, split. A row without a question, an answer or a paragraph is left out; one with options of its own has the one at answer_index as its answer."""
    e = EXAMPLES[name]
    index = e.get("answer_index", "cast(null AS int)")
    options = e.get("options", "cast(null AS array<string>)")
    answer = f"get({options}, {index})" if "options" in e else e.get("answer", "trim(answer)")
    made = df.where(e.get("keep", "true")).select(
        F.expr(e["id"]).alias("id"), F.expr(e.get("question", "trim(question)")).alias("question"), F.expr(answer).alias("answer"), F.expr(e["paragraphs"]).alias("paragraphs"), F.expr(e["supporting"]).alias("supporting"),
        F.expr(options).alias("options"), F.expr(index).cast("int").alias("answer_index"), F.expr(e.get("aliases", "cast(array() AS array<string>)")).alias("aliases"), F.expr(e["group"]).alias("group"), "split",
    )
    return made.where("question <> '' AND answer <> '' AND size(paragraphs) > 0")


def answer_pool(examples: DataFrame) -> DataFrame:
    """Answers, aliases and options of all examples, each once: text. It doesn't depend on how many of them are made into items."""
    every = F.concat(F.array("answer"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("options", F.array().cast("array<string>")))
    return examples.select(F.explode(every).alias("text")).where("trim(text) <> ''").distinct()
