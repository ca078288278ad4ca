"""Queries of what is in the tables, and of scalar functions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import values as V
from sievework.functions.forms import IDEOGRAPHS, token_count_column
from sievework.operators import clusters, metrics
from sievework.operators import inventory as I
from sievework.operators import questions as Q
from sievework.operators import reports as R
from sievework.operators.corpus import split_side
from sievework.plans import clusters as cluster_plans
from sievework.plans.corpus import _FIRST
from sievework.plans.predictions import _SCORED
from sievework.plans.questions import _LEVEL, _NOUL, _STATUS
from sievework.plans.selection import _OPTIONS

LENGTHS = ((0, 500, "short"), (500, 2000, "middle"), (2000, None, "long"))
SOURCES = {"ledger_intents": {"max_train": 50}, "clause_check": {"weight": 0}, "rubric_scores": {"max_eval": 5, "max_train": 20}}
TIERS = {"easy": 80, "hard": 80, "original": 80}


def _t(spark: SparkSession, sf_dir: str, name: str = "typed_questions") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(operator, *names: str, **options):  # noqa: ANN001, ANN003, ANN202
    return lambda spark, sf_dir: operator(*(_t(spark, sf_dir, n) for n in names), **options)


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return _t(spark, sf_dir).select("row_no", V.tier_of(i).alias("tier"), V.stage_of(i).alias("stage"), V.type_of(i).alias("kind"), V.type_within(i, ("choice", "argument", "pairs")).alias("inside"), V.polarity(F.coalesce(F.col("label_bool").cast("string"), "label_key")).alias("polarity"))


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of questions, with how many rows they have and the side that a hash puts them on."""
    keys = F.when(F.col("q_type") == "choice", Q.option_keys()).when(F.col("q_type") == "score", F.transform("levels", lambda x, i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    n = _t(spark, sf_dir).select(V.schema_key(F.col("instructions"), keys).alias("schema_key")).groupBy("schema_key").agg(F.count(F.lit(1)).alias("n"))
    return n.select("schema_key", "n", F.when(F.conv(F.substring(F.md5("schema_key"), 1, 8), 16, 10).cast("double") / 4294967295.0 < 0.2, "held_out").otherwise("seen").alias("side"))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice questions: options in order of their texts' digests, blocks of three, where the gold lies in its block, texts that repeat."""
    texts = F.transform("options", lambda o: F.coalesce(o["text"], F.lit("")))
    gold = F.array_position(Q.option_keys(), F.col("label_key")) - 1
    rows = _t(spark, sf_dir).where("q_type = 'choice' AND size(options) > 0").select("row_no", texts.alias("t"), gold.cast("int").alias("gold"))
    blocks = R.blocks_of(F.size("t"), 3)
    block = F.filter("b", lambda x: F.array_contains(x, F.col("gold")))
    made = rows.withColumn("b", blocks).withColumn("mine", F.try_element_at(block, F.lit(1)))
    place = R.position_bin((F.array_position("mine", F.col("gold")) - 1).cast("double"), F.size("mine").cast("double"))
    return made.select("row_no", F.array_join(F.transform(Q.digest_order(F.col("t")), lambda i: i.cast("string")), ",").alias("order"), F.size("b").alias("blocks"), F.when(F.col("mine").isNotNull(), place).alias("bin"), (F.size("t") - F.size(F.array_distinct("t"))).alias("repeats"))


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir).where("q_type = 'score' AND size(levels) > 0").select("row_no", F.size("levels").alias("k"), F.explode("teacher_probs").alias("teacher", "p"))
    return rows.select("row_no", "teacher", V.distribution_problem(F.col("p"), F.col("k")).alias("problem"), V.top_level(F.col("p")).alias("level"))


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir).where("teacher_probs IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(V.corrections(F.col("teacher_probs"))).alias("corrected"))


def readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions shown backwards and put back, their log probabilities combined with masses, sums over stretches, bounds of the ratio of the first two."""
    s = metrics.scored(_t(spark, sf_dir, "predictions")).where("k >= 2")
    order = F.reverse(F.sequence(F.lit(0), F.col("k") - 1))
    logs = F.transform("probs", lambda p: F.log(F.greatest(p, F.lit(1e-9))))
    spans = F.array(F.struct(F.lit(1).alias("low"), F.lit(2).alias("high")))
    mass = V.span_masses(F.col("probs"), spans)
    first, second = F.round(F.element_at("probs", 1), 2), F.round(F.element_at("probs", 2), 2)
    made = s.select("item_id", "run_name", "scored_at", V.in_place(F.reverse("probs"), order).alias("back"), V.combined(logs, F.reverse("probs"), 0.5, 1e-4).alias("both"), mass.alias("m"), V.log_ratio_interval(first, second).alias("r"), "pred")
    from sievework.functions import columns as C

    return made.groupBy("run_name").agg(
        F.sum((C.argmax(F.col("back")) == F.col("pred")).cast("int")).alias("same"), F.round(F.sum(F.array_max("both")), 6).alias("combined"), F.round(F.sum("m.span_sum"), 6).alias("span_sum"), F.round(F.sum("m.preamble"), 6).alias("preamble"), F.round(F.sum("m.residual"), 6).alias("residual"),
        F.round(F.sum("r.low"), 5).alias("low"), F.round(F.sum("r.high"), 5).alias("high"),
    )


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    at = {"p50": F.floor(n * 0.5), "p95": F.least(n - 1, F.floor(n * 0.95)), "nearest95": F.greatest(F.lit(0), F.bround(n * 0.95, 0) - 1), "p99": F.bround((n - 1) * 0.99, 0)}
    return I.lengths(_t(spark, sf_dir, "documents"), ["source"], F.length("text"), at)


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("lang", V.range_bucket(F.length("text"), LENGTHS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def state_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source and type: states, their median length, and the share at least as long as three quarters of the hard probes."""
    n = F.col("n")
    rows = _t(spark, sf_dir)
    hard = I.lengths(_t(spark, sf_dir, "eval_items").where("tier = 'hard'"), ["tier"], F.length("state"), {"limit": F.floor(n * 0.75)})
    mid = I.lengths(rows, ["source", "q_type"], F.length("state"), {"p50": F.floor(n * 0.5)})
    far = I.beyond(rows, ["source", "q_type"], F.length("state"), hard, "limit")
    return mid.alias("m").join(far.drop("n").alias("f"), [F.col("m.source").eqNullSafe(F.col("f.source")), F.col("m.q_type").eqNullSafe(F.col("f.q_type"))]).select("m.source", "m.q_type", "n", "p50", "share")


def due_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' dates seven business days on."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format(V.add_business_days(F.col("o_orderdate").cast("date"), F.lit(7)), "yyyy-MM-dd").alias("due"))


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced blocks of documents: how many, and how many hold JSON as a whole."""
    b = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(```[^`]*```)"), 1)).alias("block"))
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count(V.lenient_json(F.col("block"))).alias("json"))


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as messages, in one text again."""
    m = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("content")))
    return _t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(V.flattened(m)).alias("text"))


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic tokens of documents by language: all, and the most of one."""
    d = _t(spark, sf_dir, "documents").select("lang", token_count_column("text").alias("tokens"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a row's teacher name comes from: its own, its reason, or a default."""
    r = V.resolved(("own", F.col("teacher_name")), ("reason", F.col("reason")), ("default", F.lit("none")))
    return _t(spark, sf_dir).select(r.alias("r")).groupBy("r.source", "r.value").agg(F.count(F.lit(1)).alias("n"))


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir).where("id IS NOT NULL").select(F.col("id").alias("item_id")).distinct()
    return I.run_integrity(_t(spark, sf_dir, "predictions"), items)


def build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "corpus_records")
    b = I.canonical_build(rows, _t(spark, sf_dir, "licence_manifest"))
    return b.join(rows.select("row_no", "corpus"), "row_no").groupBy("corpus", "verdict").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("new_id").alias("ids"))


def held_out_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows before and after near duplicates are removed: rows and a checksum of their numbers, which must agree."""
    rows = _t(spark, sf_dir)
    before = I.checksum(rows.where(split_side() == "test"), "row_no").withColumn("stage", F.lit("before"))
    verdicts = clusters.without_held_out(rows, "row_no", cluster_plans._state(), split_side() == "test")
    return before.unionByName(I.checksum(verdicts.where("verdict = 'held'"), "id").withColumn("stage", F.lit("after")))


QUERIES = {
    "inventory_typed": _on(I.typed, "typed_questions"),
    "inventory_probs": _on(I.probs, "predictions"),
    "inventory_withheld": _on(I.withheld, "typed_questions"),
    "inventory_presence": _on(I.presence, "typed_questions", group="source", fields=["options", "levels", "augmented_options", "teacher_probs", "score_form", "reason"]),
    "inventory_widths": _on(I.width_card, "typed_questions"),
    "bad_labels": _on(I.bad_labels, "typed_questions"),
    "run_integrity": integrity,
    "tier_counts": _on(I.tier_counts, "eval_items", expected=TIERS),
    "source_items": _on(I.source_items, "typed_questions", config=SOURCES),
    "canonical_build": build_counts,
    "held_out_unchanged": held_out_unchanged,
    "scalar_ids": ids,
    "question_schemas": schemas,
    "scalar_layouts": layouts,
    "scalar_distributions": distributions,
    "teacher_corrected": corrected,
    "scalar_readouts": readouts,
    "length_percentiles": percentiles,
    "length_buckets": length_buckets,
    "token_lengths": token_lengths,
    "state_lengths": state_lengths,
    "scalar_due_dates": due_dates,
    "scalar_fenced_json": fenced,
    "scalar_flattened": flattened,
    "scalar_settings": settings,
}

_IDEOGRAPHS = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in IDEOGRAPHS)
_TOKEN = rf"(?:[^\P{{L}}{_IDEOGRAPHS}]|\p{{N}})+|[{_IDEOGRAPHS}]|[^\s\p{{L}}\p{{N}}\p{{Z}}\p{{Cc}}\p{{Cf}}]"
_COERCE = f"CASE WHEN q_type = 'noul' AND label_bool IS NULL AND {_NOUL} IS NOT NULL THEN 'noul_string' WHEN q_type = 'score' AND label_level IS NULL AND ({_STATUS}) IN ('level', 'fractional') THEN 'score_string' END"
_SP = "lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g'))"
_REST = "array_to_string(string_split(id, '-')[4:], '-')"
_N = "CAST(count(*) FILTER ({}) AS BIGINT)"
_PARTS = "(SELECT *, CASE q_type WHEN 'choice' THEN list_transform(options, lambda o: o.key) WHEN 'score' THEN list_transform(range(len(levels)), lambda i: CAST(i AS VARCHAR)) ELSE [] END AS keys FROM typed_questions)"
_SPACES = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

ORACLES = {
    "inventory_typed": f"""WITH e AS (SELECT unnest([('type', coalesce(nullif(q_type, ''), 'missing')), ('split', coalesce(nullif(split, ''), 'missing')), ('source', coalesce(nullif(source, ''), 'missing')), ('label', {_STATUS}), ('coercion', {_COERCE}), ('rows', 'all'), ('augmented', CASE WHEN len(augmented_options) > 0 THEN 'all' END), ('withheld', CASE WHEN answerable IS NOT DISTINCT FROM false THEN 'all' END)]) AS e FROM typed_questions),
        t AS (SELECT unnest(map_keys(teacher_probs)) AS v FROM typed_questions), u AS (SELECT e[1] AS metric, e[2] AS value FROM e WHERE e[2] IS NOT NULL UNION ALL SELECT 'teacher', v FROM t)
        SELECT metric, value, count(*) AS n FROM u GROUP BY 1, 2 UNION ALL SELECT 'ids', 'all', count(DISTINCT id) FROM typed_questions WHERE id <> '' UNION ALL SELECT 'repeated_ids', 'all', count(*) - count(DISTINCT id) FROM typed_questions WHERE id <> ''""",
    "inventory_probs": f"""SELECT run_name, count(*) AS rows, {_N.format('item_id IS NULL OR probs IS NULL OR option_keys IS NULL OR len(probs) <> len(option_keys)')} AS schema_errors, max(len(option_keys)) FILTER (item_id IS NOT NULL AND len(probs) = len(option_keys)) AS most_keys, count(DISTINCT item_id) AS ids, count(item_id) - count(DISTINCT item_id) AS repeated FROM predictions GROUP BY 1""",
    "inventory_withheld": f"""SELECT grouping(source, q_type, reason) AS level, source, q_type, reason, count(*) AS n, count(*) FILTER (s <> 'missing') AS with_label, count(*) FILTER (s IN ('option', 'level', 'fractional', 'boolean')) AS in_options, count(*) FILTER (cardinality(teacher_probs) > 0) AS taught
        FROM (SELECT *, {_STATUS} AS s FROM typed_questions WHERE answerable = false) GROUP BY GROUPING SETS ((), (source), (q_type), (reason), (source, reason))""",
    "inventory_presence": "SELECT source, count(*) AS n, count(options) AS options, count(levels) AS levels, count(augmented_options) AS augmented_options, count(teacher_probs) AS teacher_probs, count(score_form) AS score_form, count(reason) AS reason FROM typed_questions GROUP BY 1",
    "inventory_widths": f"SELECT q_type, k, n, round(n / (sum(n) OVER (PARTITION BY q_type))::DOUBLE, 9) AS share FROM (SELECT q_type, {_OPTIONS} AS k, count(*) AS n FROM typed_questions GROUP BY 1, 2)",
    "bad_labels": f"SELECT row_no, s AS status, CASE q_type WHEN 'choice' THEN array_to_string(list_transform(options, lambda o: o.key), '|') WHEN 'score' THEN '0..' || (len(levels) - 1) ELSE 'true|false' END AS allowed FROM (SELECT *, {_STATUS} AS s FROM typed_questions) WHERE s IN ('not_an_option', 'out_of_range', 'not_numeric', 'not_boolean')",
    "run_integrity": "SELECT run_name, count(*) AS rows, count(*) FILTER (item_id IS NULL OR item_id NOT IN (SELECT id FROM typed_questions WHERE id IS NOT NULL)) AS unknown, count(*) FILTER (tier IS NULL) AS without_tier, count(*) - count(DISTINCT coalesce(item_id, chr(0))) AS repeats FROM predictions GROUP BY 1",
    "tier_counts": "SELECT coalesce(e.tier, x.tier) AS tier, coalesce(n, 0) AS n, coalesce(x.expected, 0) AS expected, coalesce(n, 0) = coalesce(x.expected, 0) AS ok FROM (SELECT tier, count(*) AS n FROM eval_items GROUP BY 1) e FULL JOIN (VALUES ('easy', 80), ('hard', 80), ('original', 80)) x(tier, expected) ON e.tier = x.tier",
    "source_items": f"""WITH r AS (SELECT row_no, source, CASE WHEN {_SP} = 'test' THEN 'test' ELSE 'train' END AS side FROM typed_questions WHERE source IN ('ledger_intents', 'clause_check', 'rubric_scores') AND q_type IN ('noul', 'choice', 'score') AND {_SP} IN ('train', 'test') AND NOT (q_type = 'score' AND ({_STATUS}) IN ('out_of_range', 'not_numeric'))),
        n AS (SELECT *, row_number() OVER (PARTITION BY source, side ORDER BY md5('42:' || row_no), row_no) AS i FROM r WHERE NOT (source = 'clause_check' AND side = 'train')) SELECT row_no, source, side FROM n WHERE i <= CASE WHEN source = 'ledger_intents' AND side = 'train' THEN 50 WHEN source = 'rubric_scores' AND side = 'train' THEN 20 WHEN source = 'rubric_scores' THEN 5 ELSE 1000000000 END""",
    "canonical_build": _FIRST + """, s AS (SELECT row_no, corpus, id, count(*) OVER (PARTITION BY corpus, id) AS n, row_number() OVER (PARTITION BY corpus, id ORDER BY pos NULLS FIRST, row_no) - 1 AS i FROM corpus_records WHERE id IS NOT NULL), nid AS (SELECT row_no, CASE WHEN max(n) OVER (PARTITION BY corpus) > 1 THEN id || '-q' || i ELSE id END AS new_id FROM s),
        b AS (SELECT c.corpus, coalesce(n.new_id, c.id) AS new_id, CASE WHEN v.verdict <> 'kept' THEN v.verdict WHEN m.corpus IS NULL THEN 'licence' ELSE 'kept' END AS verdict FROM corpus_records c JOIN v USING (row_no) LEFT JOIN nid n USING (row_no) LEFT JOIN licence_manifest m ON m.corpus = c.corpus AND m.verdict = 'allow' AND list_contains(m.included_in, 'canonical'))
        SELECT corpus, verdict, count(*) AS n, count(DISTINCT new_id) AS ids FROM b GROUP BY 1, 2""",
    "held_out_unchanged": f"WITH h AS (SELECT count(*) AS n, CAST(sum(('0x' || substr(md5(CAST(row_no AS VARCHAR)), 1, 8))::BIGINT) AS BIGINT) AS sum FROM typed_questions WHERE {_SP} = 'test') SELECT n, sum, unnest(['before', 'after']) AS stage FROM h",
    "scalar_ids": f"""SELECT row_no, split_part(id, '-', 1) AS tier, CASE WHEN starts_with(r, 'cf-') THEN 'cf' WHEN starts_with(r, 'para-state-') THEN 'para-state' WHEN starts_with(r, 'para-q-') THEN 'para-q' WHEN starts_with(r, 'shuffle-') THEN 'shuffle' WHEN starts_with(r, 'neg-') THEN 'neg' WHEN id IS NOT NULL THEN 'base' END AS stage,
        CASE WHEN starts_with(q, 'noul') THEN 'noul' WHEN starts_with(q, 'choice') THEN 'choice' WHEN starts_with(q, 'score') THEN 'score' WHEN id IS NOT NULL THEN 'unknown' END AS kind, CASE WHEN contains(id, '-choice-') THEN 'choice' WHEN contains(id, '-argument-') THEN 'argument' WHEN contains(id, '-pairs-') THEN 'pairs' WHEN id IS NOT NULL THEN 'unknown' END AS inside,
        CASE WHEN lower(trim(l)) IN ('true', 'yes', '1', 'y') THEN true WHEN lower(trim(l)) IN ('false', 'no', '0', 'n') THEN false END AS polarity FROM (SELECT *, {_REST} AS r, regexp_replace({_REST}, '^(cf-|para-state-|para-q-|shuffle-|neg-)', '') AS q, coalesce(CAST(label_bool AS VARCHAR), label_key) AS l FROM typed_questions)""",
    "question_schemas": f"""WITH k AS (SELECT substr(sha256('[' || CAST(to_json(lower(trim(regexp_replace(coalesce(instructions, ''), '{_SPACES}', ' ', 'g')))) AS VARCHAR) || ', [' || array_to_string(list_transform(list_sort(keys), lambda k: CAST(to_json(k) AS VARCHAR)), ', ') || ']]'), 1, 16) AS schema_key FROM {_PARTS})
        SELECT schema_key, count(*) AS n, CASE WHEN ('0x' || substr(md5(schema_key), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.2::DOUBLE THEN 'held_out' ELSE 'seen' END AS side FROM k GROUP BY 1""",
    "scalar_layouts": """WITH t AS (SELECT row_no, list_transform(options, lambda o: coalesce(o.text, '')) AS t, list_position(list_transform(options, lambda o: o.key), label_key) - 1 AS gold FROM typed_questions WHERE q_type = 'choice' AND len(options) > 0), g AS (SELECT *, CASE WHEN gold >= 0 THEN gold // 3 END AS blk FROM t),
        w AS (SELECT *, least(3, len(t) - blk * 3) AS width, gold - blk * 3 AS local FROM g)
        SELECT row_no, array_to_string(list_transform(list_sort(list_transform(range(len(t)), lambda i: {'d': sha256(trim(t[i + 1])), 'i': i})), lambda e: e.i), ',') AS order, (len(t) + 2) // 3 AS blocks, CASE WHEN blk IS NULL THEN NULL WHEN local < 0.2 * width THEN 'first' WHEN local >= 0.8 * width THEN 'last' ELSE 'middle' END AS bin, len(t) - len(list_distinct(t)) AS repeats FROM w""".replace("AS order,", 'AS "order",'),
    "scalar_distributions": """WITH e AS (SELECT row_no, len(levels) AS k, unnest(map_entries(teacher_probs)) AS t FROM typed_questions WHERE q_type = 'score' AND len(levels) > 0), p AS (SELECT row_no, k, t.key AS teacher, t.value AS p, map_values(t.value) AS v, map_keys(t.value) AS ks FROM e)
        SELECT row_no, teacher, CASE WHEN len(ks) <> k OR len(list_filter(range(k), lambda i: NOT list_contains(ks, CAST(i AS VARCHAR)))) > 0 THEN 'keys' WHEN len(list_filter(v, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'nonnumeric' WHEN len(list_filter(v, lambda x: x < 0 OR x > 1)) > 0 THEN 'range' WHEN abs(list_sum(v) - 1) > 0.02 THEN 'sum'
            WHEN list_max(v) >= 0.99 OR len(list_filter(v, lambda x: x > 0.01)) < 2 THEN 'degenerate' END AS problem, try_cast(list_max(list_transform(list_filter(map_entries(p), lambda x: x.value = list_max(v)), lambda x: x.key)) AS DOUBLE) AS level FROM p""",
    "teacher_corrected": """WITH e AS (SELECT source, row_no, unnest(map_values(teacher_probs)) AS m FROM typed_questions), c AS (SELECT source, count(*) FILTER (abs(list_sum(map_values(m)) - 1) > 1e-6 AND list_sum(map_values(m)) > 0) AS c FROM e GROUP BY 1)
        SELECT t.source, count(*) AS n, coalesce(max(c), 0) AS corrected FROM typed_questions t LEFT JOIN c ON t.source IS NOT DISTINCT FROM c.source WHERE teacher_probs IS NOT NULL GROUP BY 1""",
    "scalar_readouts": _SCORED + """, l AS (SELECT run_name, k, probs, list_transform(probs, lambda p: ln(greatest(p, 1e-9))) AS z, list_reverse(probs) AS m, round(probs[1], 2) AS a, round(probs[2], 2) AS b FROM scored WHERE k >= 2),
        n AS (SELECT *, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) AS norm FROM l)
        SELECT run_name, count(*) AS same, round(sum(list_max(list_transform(range(k), lambda i: z[i + 1] - norm + 0.5 * ln(greatest(m[i + 1], 1e-4))))), 6) AS combined, round(sum(probs[2]), 6) AS span_sum, round(sum(probs[1]), 6) AS preamble, round(sum(list_sum(probs) - probs[2]), 6) AS residual,
            round(sum(ln(greatest(greatest(a - 0.005, 0), 1e-12) / greatest(least(b + 0.005, 1), 1e-12))), 5) AS low, round(sum(ln(greatest(least(a + 0.005, 1), 1e-12) / greatest(greatest(b - 0.005, 0), 1e-12))), 5) AS high FROM n GROUP BY 1""",
    "length_percentiles": """WITH r AS (SELECT source, length(text) AS v, row_number() OVER (PARTITION BY source ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE text IS NOT NULL)
        SELECT source, max(n) AS n, min(v) FILTER (i = floor(n * 0.5::DOUBLE)) AS p50, min(v) FILTER (i = least(n - 1, floor(n * 0.95::DOUBLE))) AS p95, min(v) FILTER (i = greatest(0, round_even(n * 0.95::DOUBLE, 0) - 1)) AS nearest95, min(v) FILTER (i = round_even((n - 1) * 0.99::DOUBLE, 0)) AS p99 FROM r GROUP BY 1""",
    "length_buckets": "SELECT lang, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 2000 THEN 'middle' ELSE 'long' END AS bucket, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2",
    "token_lengths": f"SELECT lang, count(*) AS n, CAST(sum(coalesce(len(regexp_extract_all(text, '{_TOKEN}')), 0)) AS BIGINT) AS tokens, max(coalesce(len(regexp_extract_all(text, '{_TOKEN}')), 0)) AS most FROM documents GROUP BY 1",
    "state_lengths": """WITH h AS (SELECT v FROM (SELECT length(state) AS v, row_number() OVER (ORDER BY length(state)) - 1 AS i, count(*) OVER () AS n FROM eval_items WHERE tier = 'hard') WHERE i = floor(n * 0.75::DOUBLE)), r AS (SELECT source, q_type, length(state) AS v, row_number() OVER (PARTITION BY source, q_type ORDER BY length(state)) - 1 AS i, count(*) OVER (PARTITION BY source, q_type) AS n FROM typed_questions WHERE state IS NOT NULL)
        SELECT source, q_type, max(n) AS n, min(v) FILTER (i = floor(n * 0.5::DOUBLE)) AS p50, round(avg(CAST(v >= (SELECT v FROM h) AS INT)), 9) AS share FROM r GROUP BY 1, 2""",
    "scalar_due_dates": "SELECT o_orderkey, strftime(list_filter(list_transform(range(1, 15), lambda i: CAST(o_orderdate AS DATE) + CAST(i AS INT)), lambda d: isodow(d) < 6)[7], '%Y-%m-%d') AS due FROM orders",
    "scalar_fenced_json": "WITH b AS (SELECT doc_id, unnest(regexp_extract_all(text, '(```[^`]*```)', 1)) AS b FROM documents) SELECT doc_id, count(*) AS blocks, count(*) FILTER (json_valid(trim(regexp_replace(regexp_replace(b, '^```[^\\n]*\\n', ''), '```$', '')))) AS json FROM b GROUP BY 1",
    "scalar_flattened": "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda s: s <> ''), chr(10))) AS text FROM documents WHERE text IS NOT NULL",
    "scalar_settings": "SELECT CASE WHEN teacher_name IS NOT NULL THEN 'own' WHEN reason IS NOT NULL THEN 'reason' ELSE 'default' END AS source, coalesce(teacher_name, reason, 'none') AS value, count(*) AS n FROM typed_questions GROUP BY 1, 2",
}
