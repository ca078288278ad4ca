"""Queries over rules that name rows: provenance, abilities, licences, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators import rules as R
from sievework.plans.questions import _STATUS

ORIGINS = R.Origins(
    trajectory=("apigen", "tool_trace", "tool-trace"), constructed=("abstention", "abstain"), synthetic=("synthetic",), authored=("typed_decisions",), datasets=("ledger_intents", "clause_check", "rubric_scores", "long_passage_choice", "short_passage_choice"), constructed_id="-abstain-"
)
ABILITIES = R.AbilityTables(
    by_source={"tool_trace_choice": "Routing", "tool_trace_argument": "Structured Data Extraction", "policy_compliance": "Verification", "clause_check": "Verification"}, by_instruction={}
)
SCENARIOS = {"without_denied": ("deny",), "allowed_only": ("deny", "research_only", "unresolved")}


def _q(spark: SparkSession, sf_dir: str, name: str = "typed_questions") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.provenance(_q(spark, sf_dir), ORIGINS).select("row_no", "tier", "origin")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each declared tier end up with which, and from where."""
    return R.provenance(_q(spark, sf_dir), ORIGINS).groupBy(F.col("provenance").alias("declared"), F.coalesce("provenance", "tier").alias("tier"), "origin").agg(F.count(F.lit(1)).alias("n"))


def hard_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.eligible(_q(spark, sf_dir), ORIGINS).select("row_no", "eligible", R.label_coercion().alias("coercion"))


def abilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ability(_q(spark, sf_dir), ABILITIES).select("row_no", "ability", "method", "rule")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ability_coverage(R.ability(_q(spark, sf_dir), ABILITIES))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abilities of the held-out items, by their questions alone, beside those of the corpus."""
    return R.shares_compared(R.ability(_q(spark, sf_dir), ABILITIES), R.ability(_q(spark, sf_dir, "eval_items"), external=True), "ability")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abilities by the rules beside those by the question alone."""
    both = R.ability(R.ability(_q(spark, sf_dir), external=True).withColumnRenamed("ability", "by_question"), ABILITIES)
    return R.agreement_matrix(both, "ability", "by_question", ["Classification", "Detection", "Routing", "Scoring", "Verification"])


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.licence_scenarios(_q(spark, sf_dir), _q(spark, sf_dir, "licence_manifest"), SCENARIOS)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _q(spark, sf_dir)
    return q.groupBy("source", F.coalesce(R.evidence_problem(F.col("state"), "Customer"), F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of the template of a question's type laid under its own, which win: row_no, how many there are, and their keys in order."""
    made = spark.createDataFrame([("noul", {"true": "The condition holds", "false": "The condition does not hold", "borderline": "It is close"}), ("choice", {"none": "None of these"})], "q_type string, template map<string,string>")
    own = F.map_from_entries(F.coalesce("augmented_options", F.array().cast("array<struct<key:string,text:string>>")))
    rows = R.template_of(_q(spark, sf_dir), made, "q_type").where("template IS NOT NULL")
    return rows.select("row_no", R.full_options(F.col("template"), own).alias("o")).select("row_no", F.size("o").alias("options"), F.array_join(F.array_sort(F.map_keys("o")), "|").alias("keys"))


QUERIES = {
    "provenance_tiers": tiers,
    "provenance_tagged": tagged,
    "hard_label_eligible": hard_label,
    "abilities": abilities,
    "ability_coverage": coverage,
    "ability_demand": demand,
    "ability_matrix": matrix,
    "licence_scenarios": scenarios,
    "evidence_problems": evidence,
    "option_templates": templates,
}


def _begins(c: str, prefixes: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"coalesce(starts_with({c}, '{p}'), false)" for p in prefixes) + ")"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_CORPUS = "regexp_replace(list_last(string_split(coalesce(corpus, ''), '/')), '\\.jsonl$', '')"
_ORIGIN = f"""CASE WHEN provenance IN {_in(R.TIERS)} THEN 'declared' WHEN provenance IS NOT NULL THEN 'unknown' WHEN {_begins("coalesce(source, '')", ORIGINS.trajectory)} OR {_begins(_CORPUS, ORIGINS.trajectory)} THEN 'trajectory'
    WHEN coalesce(contains(id, '-abstain-'), false) OR {_begins(_CORPUS, ORIGINS.constructed)} OR (reason IN {_in(R.WITHHELD_REASONS)} AND answerable IS NOT DISTINCT FROM false) THEN 'constructed' WHEN {_begins("coalesce(source, '')", ORIGINS.synthetic)} OR {_begins(_CORPUS, ORIGINS.synthetic)} THEN 'synthetic'
    WHEN source IN {_in(ORIGINS.authored)[:-1]}) THEN 'authored' WHEN source IN {_in(ORIGINS.datasets)} THEN 'dataset' ELSE 'unknown' END"""
_TIER = f"SELECT *, CASE WHEN origin = 'declared' THEN provenance WHEN origin IN ('trajectory', 'constructed') THEN 'execution' WHEN origin <> 'unknown' THEN 'gold' END AS tier FROM (SELECT *, {_ORIGIN} AS origin FROM typed_questions)"


def _ability(table: str, external: bool) -> str:
    text = "trim(coalesce(instructions, ''))"
    rules = [] if external else [("q_type = 'score'", "Scoring", "source_rule", "question_type"), *((f"source = '{s}'", a, "source_rule", "source") for s, a in ABILITIES.by_source.items())]
    rules += [(f"regexp_matches({text}, '{p}', 'i')", a, "heuristic", n) for n, p, a in (R.EXTERNAL_PATTERNS if external else ()) + R.PATTERNS]
    case = lambda i, last: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i]}'" for r in rules) + f" ELSE {last} END"
    return f"SELECT *, {case(1, "CASE q_type WHEN 'score' THEN 'Scoring' ELSE 'Classification' END")} AS ability, {case(2, "'heuristic'")} AS method, {case(3, "'type_default'")} AS rule FROM {table}"


_COUNT = "CAST(count(*) FILTER ({}) AS BIGINT)"

ORACLES = {
    "provenance_tiers": f"SELECT row_no, tier, origin FROM ({_TIER})",
    "provenance_tagged": f"SELECT provenance AS declared, coalesce(provenance, tier) AS tier, origin, count(*) AS n FROM ({_TIER}) GROUP BY ALL",
    "hard_label_eligible": f"""SELECT row_no, answerable IS DISTINCT FROM false AND coalesce(tier IN ('gold', 'execution'), false) AND s IN ('boolean', 'option', 'level', 'fractional') AS eligible,
        CASE WHEN q_type = 'noul' AND label_bool IS NULL AND s = 'boolean' THEN 'noul_string' WHEN q_type = 'score' AND label_level IS NULL AND s IN ('level', 'fractional') THEN 'score_string' END AS coercion FROM (SELECT *, {_STATUS} AS s FROM ({_TIER}))""",
    "abilities": f"SELECT row_no, ability, method, rule FROM ({_ability('typed_questions', False)})",
    "ability_coverage": f"""WITH a AS ({_ability('typed_questions', False)}), s AS (SELECT ability, coalesce(source, 'missing') AS source, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT ability, arg_min(source, (-n, source)) AS top_source, max(n) AS top FROM s GROUP BY 1),
        w AS (SELECT ability, count(*) AS n, {_COUNT.format("q_type = 'noul'")} AS noul, {_COUNT.format("q_type = 'choice'")} AS choice, {_COUNT.format("q_type = 'score'")} AS score, {_COUNT.format("method = 'source_rule'")} AS by_rule, {_COUNT.format("answerable IS NOT DISTINCT FROM false OR reason IS NOT NULL")} AS withheld FROM a GROUP BY 1)
        SELECT w.*, top_source, round(top / n::DOUBLE, 6) AS top_share, concat_ws(',', CASE WHEN n < 2000 THEN 'few' END, CASE WHEN top / n::DOUBLE >= 0.9::DOUBLE THEN 'single_source' END, CASE WHEN by_rule = 0 THEN 'no_rule' END) AS flags FROM w JOIN t USING (ability)""",
    "ability_demand": f"""WITH l AS (SELECT ability, count(*) AS n FROM ({_ability('typed_questions', False)}) GROUP BY 1), r AS (SELECT ability, count(*) AS n FROM ({_ability('eval_items', True)}) GROUP BY 1),
        b AS (SELECT coalesce(l.ability, r.ability) AS ability, coalesce(l.n, 0) AS left_n, coalesce(r.n, 0) AS right_n FROM l FULL JOIN r ON l.ability = r.ability), s AS (SELECT *, left_n / sum(left_n) OVER ()::DOUBLE AS ls, right_n / sum(right_n) OVER ()::DOUBLE AS rs FROM b)
        SELECT ability, left_n, right_n, round(ls, 9) AS left_share, round(rs, 9) AS right_share, round(ls - rs, 9) AS difference FROM s""",
    "ability_matrix": f"""WITH b AS (SELECT a.ability, e.ability AS e FROM ({_ability('typed_questions', False)}) a JOIN ({_ability('typed_questions', True)}) e USING (row_no))
        SELECT ability, {", ".join(f"{_COUNT.format(f"e = '{v}'")} AS {v}" for v in ["Classification", "Detection", "Routing", "Scoring", "Verification"])}, {_COUNT.format("e = ability")} AS agree, count(*) AS n FROM b GROUP BY 1""",
    "licence_scenarios": """WITH n AS (SELECT q_type, coalesce(m.verdict, 'unresolved') AS v FROM typed_questions q LEFT JOIN licence_manifest m ON m.corpus = regexp_replace(lower(trim(q.source)), '[-/\\s]+', '_', 'g')),
        s AS (SELECT 'without_denied' AS scenario, q_type, v = 'deny' AS o FROM n UNION ALL SELECT 'allowed_only', q_type, v IN ('deny', 'research_only', 'unresolved') FROM n)
        SELECT scenario, q_type, CAST(count(*) FILTER (o) AS BIGINT) AS excluded, CAST(count(*) FILTER (NOT o) AS BIGINT) AS remaining FROM s GROUP BY 1, 2""",
    "evidence_problems": """WITH t AS (SELECT source, trim(coalesce(state, '')) AS t FROM typed_questions), p AS (SELECT source, t, strpos(t, 'Customer:') AS pos FROM t)
        SELECT source, CASE WHEN t = '' THEN 'empty_state' WHEN json_valid(t) AND json_type(t) = 'OBJECT' AND list_contains(json_keys(t), 'Customer') THEN CASE WHEN coalesce(t ->> 'Customer', '') IN ('', '[]', '{}') THEN 'empty' ELSE 'none' END
            WHEN pos = 0 THEN 'missing' WHEN NOT regexp_matches(string_split(substr(t, pos + 9), chr(10) || chr(10))[1], '\\S') THEN 'empty' ELSE 'none' END AS problem, count(*) AS n FROM p GROUP BY 1, 2""",
    "option_templates": """WITH k AS (SELECT row_no, list_sort(list_distinct(list_concat(CASE q_type WHEN 'noul' THEN ['true', 'false', 'borderline'] ELSE ['none'] END, coalesce(list_transform(augmented_options, lambda o: o.key), [])))) AS k FROM typed_questions WHERE q_type IN ('noul', 'choice'))
        SELECT row_no, len(k) AS options, array_to_string(k, '|') AS keys FROM k""",
}
