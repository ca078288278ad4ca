"""Ordered rules that name a row: where its label comes from, what its question asks for, which licence it falls under. The first rule that holds decides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import questions as Q

TIERS = ("gold", "execution", "teacher")
# fixed values: reasons that mark an answer as withheld by construction
WITHHELD_REASONS = ("insufficient", "out_of_scope", "none_of_these", "no_applicable_tool")
# fixed values: sources whose labels are a published dataset's own
DATASET_SOURCES = (
    "2wiki_long_choice", "agnews", "anli", "arc", "banking77", "boolq", "codesearchnet", "commonsenseqa", "contractnli", "fever", "hellaswag", "hotpotqa_long_choice", "logiqa", "longbench_long_choice", "mednli", "mmlu",
    "mmlu_pro_short_reasoning_choice", "mnli", "multirc", "piqa", "race", "race_short_passage_choice", "sst2", "sst5", "stsb", "swag", "tabfact", "twowiki_long_choice", "winogrande", "yelp",
)


@dataclass(frozen=True)
class Origins:
    """What sources and corpora begin with, or are, by where labels come from."""

    trajectory: tuple[str, ...] = ("apigen",)
    constructed: tuple[str, ...] = ("abstention",)
    synthetic: tuple[str, ...] = ("synthetic",)
    authored: tuple[str, ...] = ("typed_decisions",)
    datasets: tuple[str, ...] = DATASET_SOURCES
    constructed_id: str = "-abstain-"


def first_rule(rules: list[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """The outcome of the first rule whose condition is true; a condition that is null isn't."""
    out = None
    for condition, outcome in rules:
        value = outcome if isinstance(outcome, Column) else F.lit(outcome)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    last = otherwise if isinstance(otherwise, Column) else F.lit(otherwise).cast("string")
    return last if out is None else out.otherwise(last)


def _begins(c: Column, prefixes: tuple[str, ...]) -> Column:
    """True or false, never null."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(c.startswith(p), F.lit(False))
    return out


def provenance(df: DataFrame, origins: Origins = Origins()) -> DataFrame:
    """df with tier and origin of each row's label: declared, trajectory, constructed, synthetic, authored, dataset; a null tier with origin unknown.

    Reads provenance, source, corpus, id, reason, answerable. A declared tier that isn't one is unknown. Names are compared as they are written.
    """
    corpus = F.regexp_replace(F.element_at(F.split(F.coalesce("corpus", F.lit("")), "/"), -1), r"\.jsonl$", "")
    source = F.coalesce(F.col("source"), F.lit(""))
    withheld = F.col("reason").isin(*WITHHELD_REASONS) & F.col("answerable").eqNullSafe(F.lit(False))
    constructed = F.coalesce(F.col("id").contains(origins.constructed_id), F.lit(False)) | _begins(corpus, origins.constructed) | F.coalesce(withheld, F.lit(False))
    origin = first_rule([
        (F.col("provenance").isin(*TIERS), "declared"), (F.col("provenance").isNotNull(), "unknown"), (_begins(source, origins.trajectory) | _begins(corpus, origins.trajectory), "trajectory"), (constructed, "constructed"),
        (_begins(source, origins.synthetic) | _begins(corpus, origins.synthetic), "synthetic"), (source.isin(*origins.authored), "authored"), (source.isin(*origins.datasets), "dataset"),
    ], "unknown")
    tier = first_rule([(F.col("origin") == "declared", F.col("provenance")), (F.col("origin").isin("trajectory", "constructed"), "execution"), (F.col("origin") != "unknown", "gold")])
    return df.withColumn("origin", origin).withColumn("tier", tier)


def eligible(df: DataFrame, origins: Origins = Origins()) -> DataFrame:
    """df with tier, origin and eligible: whether its label may be learned as it is. Fails closed: a withheld answer, a label from a teacher or of unknown origin, or one that isn't valid is not."""
    usable = Q.label_status().isin("boolean", "option", "level", "fractional")
    return provenance(df, origins).withColumn("eligible", ~F.col("answerable").eqNullSafe(F.lit(False)) & F.coalesce(F.col("tier").isin("gold", "execution"), F.lit(False)) & usable)


def label_coercion() -> Column:
    """Whether a label is usable only once its type is changed: noul_string, score_string, else null. A label kept as its own type needs none."""
    return first_rule([
        ((F.col("q_type") == "noul") & F.col("label_bool").isNull() & Q.noul_label().isNotNull(), "noul_string"),
        ((F.col("q_type") == "score") & F.col("label_level").isNull() & (Q.label_status().isin("level", "fractional")), "score_string"),
    ])


# fixed values: what a question asks for, by the words of its instruction, in this order; the first three are for questions from outside
EXTERNAL_PATTERNS = (
    ("external_extraction", r"\b(?:which (?:payment method|priority|shirt size|order id) does\b|which day does the (?:customer|user|person|applicant) propose\b|which .{0,40} does the (?:customer|user|ticket|person|applicant) (?:name|state|ask for|propose))\b", "Structured Data Extraction"),
    ("external_routing", r"\b(?:which single tool|specialist needed|primary handler|who must be paged|what should the agent do|what must the agent do|single action .{0,60} must take|how must .{0,60} handle|record action|review route)\b", "Routing"),
    ("external_verification", r"\b(?:does the response .{0,80}satisfy|does the trusted evidence establish|is the requested action permitted)\b", "Verification"),
)
PATTERNS = (
    ("structured_value", r"\b(?:what value|which value|extract the|what (?:is|was) the (?:value|amount|date|number|score) of)\b", "Structured Data Extraction"),
    ("routing", r"\b(?:what should .{0,60} do (?:next|now|upon|first)|which (?:action|tool|strategy|route|direction)|next action|disposition|triage level|moderation action|which .{0,30} should (?:be used|the agent|the assistant|you))\b", "Routing"),
    ("evidence_sufficiency", r"\b(?:(?:sufficient|insufficient|enough (?:information|detail))\b.{0,80}\b(?:determine|establish|conclude|answer|decide|confirm)|is there (?:evidence|enough detail))", "Verification"),
    ("verification", r"\b(?:does .{0,60}(?:support|entail|reconcile|comply|match|verify)|is (?:it|this) true|assess the claim|is this answer correct|supports? the claim|is entailed|correctly implements)\b", "Verification"),
    ("detection", r"\b(?:is .{0,40} present|malicious|violation|risk factor|(?:pose|poses|posing) .{0,30}threat|explicit threat|safety concern|bottleneck|information gap|suspicious)\b", "Detection"),
)
TYPE_ABILITY = {"noul": "Classification", "choice": "Classification", "score": "Scoring"}


@dataclass(frozen=True)
class AbilityTables:
    """Abilities by source, and by the exact instruction where a source has templates."""

    by_source: dict[str, str] = field(default_factory=dict)
    by_instruction: dict[str, str] = field(default_factory=dict)


def ability(df: DataFrame, tables: AbilityTables = AbilityTables(), external: bool = False) -> DataFrame:
    """df with ability, method (source_rule or heuristic) and rule. Reads q_type, source, instructions.

    Order: score questions; the source's ability; the instruction's; the patterns, with external those for outside questions first; the type's default.
    external: only the question is known, so source and type rules are left out.
    """
    text = F.trim(F.coalesce("instructions", F.lit("")))
    rules: list[tuple[Column, str, str, str]] = []
    if not external:
        rules.append((F.col("q_type") == "score", "Scoring", "source_rule", "question_type"))
        rules += [(F.col("source") == s, a, "source_rule", "source") for s, a in tables.by_source.items()]
        rules += [(text == t, a, "source_rule", "instruction") for t, a in tables.by_instruction.items()]
    rules += [(text.rlike(f"(?i){p}"), a, "heuristic", name) for name, p, a in (EXTERNAL_PATTERNS if external else ()) + PATTERNS]
    default = first_rule([(F.col("q_type") == t, a) for t, a in TYPE_ABILITY.items()], "Classification")
    return df.withColumns({
        "ability": first_rule([(c, a) for c, a, _, _ in rules], default), "method": first_rule([(c, m) for c, _, m, _ in rules], "heuristic"), "rule": first_rule([(c, r) for c, _, _, r in rules], "type_default"),
    })


def ability_coverage(df: DataFrame, single: float = 0.9, few: int = 2000) -> DataFrame:
    """Per ability: rows, by type, by method, withheld answers, its largest source with that one's share (ties to the lesser name), and flags. Reads what ability() adds, q_type, source, answerable, reason."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    by_source = df.groupBy("ability", F.coalesce("source", F.lit("missing")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"), *(count(F.col("q_type") == t).alias(t) for t in TYPE_ABILITY), count(F.col("method") == "source_rule").alias("by_rule"), count(F.col("answerable").eqNullSafe(F.lit(False)) | F.col("reason").isNotNull()).alias("withheld")
    )
    whole = by_source.groupBy("ability").agg(*(F.sum(c).alias(c) for c in ("n", *TYPE_ABILITY, "by_rule", "withheld")), F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("top_source"), F.max("n").alias("top"))
    share = F.col("top") / F.col("n")
    flags = F.concat_ws(",", F.when(F.col("n") < few, "few"), F.when(share >= single, "single_source"), F.when(F.col("by_rule") == 0, "no_rule"))
    return whole.select("ability", "n", *TYPE_ABILITY, "by_rule", "withheld", "top_source", F.round(share, 6).alias("top_share"), flags.alias("flags"))


def shares_compared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Shares of a key in two tables, side by side: key, left_n, right_n, left_share, right_share, difference. A key of one side only has 0 on the other; keys are few."""
    a, b = (df.groupBy(F.coalesce(key, F.lit("missing")).alias(key)).agg(F.count(F.lit(1)).alias(f"{x}_n")) for df, x in ((left, "left"), (right, "right")))
    both = a.join(b, key, "full").select(key, *(F.coalesce(f"{x}_n", F.lit(0)).alias(f"{x}_n") for x in ("left", "right")))
    totals = both.agg(F.sum("left_n").alias("l"), F.sum("right_n").alias("r"))
    share = lambda n, t: F.coalesce(F.col(n) / F.nullif(F.col(t), F.lit(0)), F.lit(0.0))
    with_share = both.crossJoin(totals).withColumns({"left_share": share("left_n", "l"), "right_share": share("right_n", "r")})  # one row
    return with_share.select(key, "left_n", "right_n", F.round("left_share", 9).alias("left_share"), F.round("right_share", 9).alias("right_share"), F.round(F.col("left_share") - F.col("right_share"), 9).alias("difference"))


def agreement_matrix(df: DataFrame, first: str, second: str, values: list[str]) -> DataFrame:
    """How often each value of first goes with each of the stated values of second (a column each), and the rows in which both agree."""
    return df.groupBy(F.coalesce(first, F.lit("missing")).alias(first)).agg(*(F.sum(F.coalesce(F.col(second) == v, F.lit(False)).cast("int")).alias(v) for v in values), F.sum(F.coalesce(F.col(first) == F.col(second), F.lit(False)).cast("int")).alias("agree"), F.count(F.lit(1)).alias("n"))


def licence_group(source: Column) -> Column:
    """The manifest's name of a source: trimmed, lower case, what parts its words one underscore."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-/\s]+", "_")


def licence_scenarios(df: DataFrame, manifest: DataFrame, scenarios: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per scenario and q_type: rows that its verdicts exclude and rows that remain. A source that the manifest lacks, or without a verdict, is unresolved. The manifest is small; its names must be unique."""
    terms = manifest.select(F.col("corpus").alias("group"), "verdict")
    named = df.select("q_type", licence_group(F.col("source")).alias("group")).groupBy("q_type", "group").agg(F.count(F.lit(1)).alias("n")).join(terms, "group", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unresolved")))
    out = [F.struct(F.lit(name).alias("scenario"), F.col("verdict").isin(*kinds).alias("out")) for name, kinds in scenarios.items()]
    each = named.select("q_type", "n", F.explode(F.array(*out)).alias("s")).select("q_type", "n", "s.*")
    return each.groupBy("scenario", "q_type").agg(F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)).alias("excluded"), F.sum(F.when(~F.col("out"), F.col("n")).otherwise(0)).alias("remaining"))


def evidence_problem(state: Column, evidence: str) -> Column:
    """Why a state doesn't carry the evidence named: empty_state, undeclared, missing, empty; null if it does. Evidence is the whole state ("state text"), a key of a JSON object, or a section that begins with the name and a colon and ends at an empty line."""
    text = F.trim(F.coalesce(state, F.lit("")))
    value = F.get_json_object(text, f"$['{evidence}']")
    at = F.locate(f"{evidence}:", text)
    section = F.element_at(F.split(F.substring(text, at + len(evidence) + 1, F.length(text)), "\n\n"), 1)
    return first_rule([
        (text == "", "empty_state"), (F.lit(not evidence.strip()), "undeclared"), (F.lit(evidence == "state text"), F.lit(None).cast("string")),
        (F.array_contains(F.json_object_keys(text), evidence), F.when(value.isNull() | value.isin("", "[]", "{}"), "empty")),
        (at == 0, "missing"), (~section.rlike(r"\S"), "empty"),
    ])


def template_of(df: DataFrame, templates: DataFrame, key: str, name: str = "template") -> DataFrame:
    """df with the template of its key, null if there is none. templates: key, template, one row a key; a small table, but joined as Spark sees fit."""
    return df.join(templates.select(key, F.col("template").alias(name)), key, "left")


def full_options(base: Column, extra: Column) -> Column:
    """Two maps in one; a key of both has the second's text."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra)
