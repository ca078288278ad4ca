"""Queries over samples and selections of typed questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators import metrics
from sievework.operators import questions as Q
from sievework.operators import sampler as M
from sievework.operators import selection as S
from sievework.operators.corpus import split_side

MIXED = M.SamplerConfig(source_caps={"ledger_intents": 100, "clause_check": 50}, temperature=2.0, synthetic_sources=("synthetic/transit", "synthetic/clinic", "synthetic/claims"), synthetic_ratio=0.25)
HARD = M.SamplerConfig(difficulty_weights={"noul": 0.5, "choice": 1.0, "score": 2.0}, source_weights={"rubric_scores": 3.0}, epoch_size=900)
SHARES = {"noul": 0.315, "choice": 0.6, "score": 0.085}
TARGETS = {"noul": 30, "choice": 60, "score": 20}


def _q(spark: SparkSession, sf_dir: str, name: str = "typed_questions") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(operator, *args):  # noqa: ANN001, ANN002, ANN202
    return lambda spark, sf_dir: operator(_q(spark, sf_dir), *args)


def sample_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = M.weights(M.pools(_q(spark, sf_dir), MIXED), MIXED)
    return w.select("kind", "source", "size", F.round("weight", 9).alias("weight"), F.round("share", 9).alias("share"))


def sample_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each type and source in an epoch that weighs types by difficulty, and how many of them are different."""
    return M.epoch(_q(spark, sf_dir), HARD, 1).groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_no").alias("rows"))


def allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that no prediction has, noul ones with augmented options left out, drawn to shares of 100."""
    free = _q(spark, sf_dir).join(_q(spark, sf_dir, "predictions").select(F.col("item_id").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti")
    rows = free.where(~((F.col("q_type") == "noul") & F.col("augmented_options").isNotNull()))
    return S.allocated(rows, "q_type", SHARES, 100, 42).select("row_no", "q_type", "rank")


def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q(spark, sf_dir).where("q_type = 'score' AND label_level IS NOT NULL").select("row_no", "source", "label_level")
    return S.running_cap(rows, ["source"], [F.col("row_no")], F.col("label_level") == 0, 0.25).select("row_no", "taken")


def templates_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q(spark, sf_dir).select("row_no", "q_type", F.when(F.col("source").startswith("synthetic"), F.concat_ws("/", "source", F.coalesce("group_key", F.lit("")))).alias("template"))
    return S.templates_capped(rows, F.col("template"), "q_type", "row_no", 3).select("row_no", "place")


def gold_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q(spark, sf_dir).where("q_type = 'choice'").withColumn("side", F.coalesce(split_side(), F.lit("none")))
    return S.gold_slots(rows, ["side"], Q.option_keys(), F.col("label_key"), 7).select("row_no", "slot", F.array_join("keys", "|").alias("keys"))


def held_out_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q(spark, sf_dir).select("source", F.coalesce("group_key", F.concat(F.lit("row "), F.col("row_no").cast("string"))).alias("group_key"), "q_type")
    return S.whole_clusters(rows, ["source", "group_key"], "q_type", TARGETS, 200).select("source", "group_key", "q_type", "n", "upto")


def dev_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As held_out_clusters, but a source gives no more than 7 rows of a type."""
    rows = _q(spark, sf_dir).select("source", F.coalesce("group_key", F.concat(F.lit("row "), F.col("row_no").cast("string"))).alias("group_key"), "q_type")
    return S.whole_clusters(rows, ["source", "group_key"], "q_type", TARGETS, 200, "source", 7).select("source", "group_key", "q_type", "n", "upto")


def abstention_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.base_split(_q(spark, sf_dir), F.col("answerable").eqNullSafe(F.lit(False)), 0.3, 11, F.col("reason") == "insufficient")


def abstention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.pairs_of_variants(_q(spark, sf_dir))
    held = _q(spark, sf_dir).where(split_side() == "test").select(F.col("row_no").alias("variant"))
    return S.in_digest_order(pairs, held, "variant").select("variant", "donor", "problem", "place")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of each type and source by how probable two runs find their gold: the band under the current run, and how many changed theirs since the base run."""
    s = metrics.one_per_item(metrics.scored(_q(spark, sf_dir, "predictions")))
    p = lambda run, name: s.where(F.col("run_name") == run).groupBy(F.col("item_id").alias("id")).agg(F.min_by(F.element_at("probs", F.col("gold") + 1), "item_id").alias(name))
    both = _q(spark, sf_dir).select("id", "q_type", "source").join(p("head-base", "base"), "id", "left").join(p("head-lora", "now"), "id", "left")
    now = F.coalesce(S.band(F.col("now"), 0.05, 0.8), F.lit("missing"))
    return both.groupBy("q_type", "source", now.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(S.band(F.col("base"), 0.05, 0.8) != S.band(F.col("now"), 0.05, 0.8), F.lit(False)).cast("int")).alias("changed"), F.round(F.min("now"), 9).alias("least"))


def strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strided(_q(spark, sf_dir).select("row_no"), [F.col("row_no")], 7)


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _q(spark, sf_dir).where("id IS NOT NULL").select("id").distinct()
    return S.halves(ids, [F.col("id")])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q(spark, sf_dir).select("row_no", F.coalesce("state", F.lit("")).alias("state"))
    return S.chunks(rows, "state", "row_no", 50).select("row_no", "chunk")


def shortlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.one_per_item(metrics.scored(_q(spark, sf_dir, "predictions")))
    return s.select("item_id", "run_name", F.array_join(F.transform(S.shortlist(F.col("probs"), 2, F.col("gold")), lambda i: i.cast("string")), ",").alias("short"))


def duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of a shortlist of three by their duels, a duel won by share of the two probabilities: best option of each prediction."""
    s = metrics.one_per_item(metrics.scored(_q(spark, sf_dir, "predictions"))).where("k >= 2")
    short = s.select(F.struct("item_id", "run_name").alias("item"), "probs", F.posexplode(S.shortlist(F.col("probs"), 3)).alias("a", "first")).select("item", "probs", "first")
    pairs = short.alias("x").join(short.alias("y"), "item").where("x.first < y.first")  # three of an item at most
    p = F.element_at("x.probs", F.col("x.first") + 1)
    q = F.element_at("x.probs", F.col("y.first") + 1)
    wins = pairs.where(p + q > 0).select("item", F.col("x.first").alias("first"), F.col("y.first").alias("second"), (p / (p + q)).alias("p"))
    return S.duel_scores(wins, "item").select("item.item_id", "item.run_name", "option", F.round("score", 7).alias("score"), "duels")


def new_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States without a score question, as candidates for one: their first row and the id of a question to be made."""
    rows = _q(spark, sf_dir)
    got = S.new_states(rows, C.collapsed_lower("state"), F.col("q_type") == "score", F.col("source").isNotNull())
    return got.join(rows.select("row_no", "source"), "row_no").select("row_no", F.concat_ws("-", F.lit("scoregen"), C.slug("source"), F.substring(F.sha1("state"), 1, 10)).alias("candidate_id"))


def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.set_changes(_q(spark, sf_dir, "predictions"), "run_name", "head-base", "item_id", ["source", "q_type"])


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: predictions whose item is there, and those that would be cleaned away."""
    known = _q(spark, sf_dir).where("id IS NOT NULL").select(F.col("id").alias("item_id")).distinct().withColumn("there", F.lit(1))
    return _q(spark, sf_dir, "predictions").join(known, "item_id", "left").groupBy("run_name").agg(F.count("there").alias("kept"), (F.count(F.lit(1)) - F.count("there")).alias("orphaned"))


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: questions without any teacher, and those that one teacher labelled and another didn't."""
    has = lambda t: F.coalesce(F.map_contains_key("teacher_probs", F.lit(t)), F.lit(False))
    return _q(spark, sf_dir).groupBy("source").agg(F.sum(F.coalesce(F.size("teacher_probs") <= 0, F.lit(True)).cast("int")).alias("unlabelled"), F.sum((has("teacher-a") & ~has("teacher-b")).cast("int")).alias("only_a"), F.sum((has("teacher-b") & ~has("teacher-a")).cast("int")).alias("only_b"))


def within_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type: questions with at most four options, and those above."""
    return _q(spark, sf_dir).groupBy("q_type").agg(F.sum((Q.option_count() <= 4).cast("int")).alias("kept"), F.sum((Q.option_count() > 4).cast("int")).alias("skipped"), F.max(Q.option_count()).alias("most"))


QUERIES = {
    "sample_epoch": _on(M.epoch, MIXED, 3),
    "sample_pools": sample_pools,
    "sample_difficulty": sample_difficulty,
    "sample_allocated": allocated,
    "sample_running_cap": running_cap,
    "sample_templates_capped": templates_capped,
    "sample_gold_slots": gold_slots,
    "sample_held_out_clusters": held_out_clusters,
    "sample_dev_clusters": dev_clusters,
    "abstention_split": abstention_split,
    "abstention_pairs": abstention_pairs,
    "sample_bands": bands,
    "sample_strided": strided,
    "split_halves": halves,
    "sample_chunks": chunks,
    "pred_shortlists": shortlists,
    "pred_duels": duels,
    "score_new_states": new_states,
    "pred_run_changes": run_changes,
    "pred_orphans": orphans,
    "teacher_unlabelled": unlabelled,
    "options_within_limit": within_limit,
    "options_variants": lambda spark, sf_dir: Q.variants(_q(spark, sf_dir), 5).select("row_no", "variant", "instructions", F.array_join("keys", "|").alias("keys"), "label"),
    "options_k_augmented": lambda spark, sf_dir: Q.k_augmented(_q(spark, sf_dir), 0.5, 4, 12, 3, 1).select("choice_items", "selected", "teachers_dropped", "encodes_before", "target_mean"),
}

_CAPS = "CASE source WHEN 'ledger_intents' THEN 100 WHEN 'clause_check' THEN 50 END"
_KIND = "coalesce(nullif(score_form.source_type, ''), q_type, 'noul')"
_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


def _epoch(pool: str, weight: str, total: str, ratios: dict[str, float], number: int, part: str, share: float) -> str:
    case = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in ratios.items()) + " ELSE 0 END"
    u = _HASH.format(f"'42:{number}:' || kind || ':' || i")
    return f"""WITH pool AS MATERIALIZED ({pool}), w AS (SELECT kind, source, count(*) AS size, {weight} AS weight FROM pool GROUP BY 1, 2),
    k AS (SELECT kind, {case} AS r, row_number() OVER (ORDER BY kind) AS j, count(*) OVER () AS kinds FROM (SELECT DISTINCT kind FROM w)), q0 AS (SELECT *, CAST(floor({total} * r / sum(r) OVER ()) AS BIGINT) AS part FROM k),
    q AS (SELECT kind, CASE WHEN j = kinds THEN {total} - coalesce(sum(part) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE part END AS quota FROM q0 WHERE r > 0),
    p0 AS (SELECT *, {part} AS part FROM w), two AS (SELECT kind, count(DISTINCT part) > 1 AS two FROM p0 GROUP BY 1), p AS (SELECT kind, source, size, weight, CASE WHEN two.two THEN part ELSE 'all' END AS part FROM p0 JOIN two USING (kind)),
    g AS (SELECT *, sum(weight) OVER (PARTITION BY kind, part ORDER BY source) / sum(weight) OVER (PARTITION BY kind, part) AS high, max(source) OVER (PARTITION BY kind, part) = source AS final FROM p), r AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY kind, part ORDER BY source), 0) AS low FROM g),
    s AS (SELECT kind, i, quota, CASE WHEN NOT two.two THEN 'all' WHEN i < floor(quota * {share}::DOUBLE) THEN 'synthetic' ELSE 'other' END AS part, {u} AS u FROM (SELECT kind, CAST(quota AS BIGINT) AS quota, unnest(range(CAST(quota AS BIGINT))) AS i FROM q) JOIN two USING (kind)),
    c AS (SELECT s.kind, i, quota, source, size FROM s JOIN r ON s.kind = r.kind AND s.part = r.part AND u >= low AND (u < high OR final)), d AS (SELECT *, row_number() OVER (PARTITION BY kind, source ORDER BY i) - 1 AS o FROM c),
    laps AS (SELECT kind, source, max(o // size) AS laps FROM d GROUP BY 1, 2), t AS (SELECT kind, source, row_no, unnest(range(laps + 1)) AS lap FROM pool JOIN laps USING (kind, source)),
    n AS (SELECT *, row_number() OVER (PARTITION BY kind, source, lap ORDER BY md5('42:{number}:' || lap || ':' || row_no), row_no) - 1 AS o FROM t),
    x AS (SELECT d.kind, d.source, n.row_no, i, row_number() OVER (ORDER BY (i + 0.5::DOUBLE) / quota, d.kind) - 1 AS pos FROM d JOIN n ON d.kind = n.kind AND d.source = n.source AND d.o // d.size = n.lap AND d.o % d.size = n.o),
    e AS (SELECT (pos // 8) * 8 + row_number() OVER (PARTITION BY pos // 8 ORDER BY md5('42:{number}:mix:' || kind || ':' || i)) AS place, kind, source, row_no FROM x)"""


_POOL = f"""SELECT row_no, kind, source FROM (SELECT *, row_number() OVER (PARTITION BY kind, source ORDER BY md5('42:' || row_no), row_no) AS rn FROM (SELECT row_no, {_KIND} AS kind, coalesce(source, '') AS source FROM typed_questions)) WHERE coalesce(rn <= {_CAPS}, true)"""
_EVEN = {"noul": 1.0, "choice": 1.0, "score": 1.0}
_KEYS = "list_transform(options, lambda o: o.key)"
_SIDE = "CASE WHEN sp IN ('val', 'dev', 'valid') THEN 'validation' WHEN sp <> '' THEN sp END"
_ROWS = "(SELECT *, lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) AS sp FROM typed_questions)"
_UNITS = """WITH u AS (SELECT coalesce(source, '') AS source, coalesce(group_key, 'row ' || row_no) AS group_key, min(q_type) AS q_type, max(q_type) AS other, count(*) AS n FROM typed_questions GROUP BY coalesce(source, ''), coalesce(group_key, 'row ' || row_no)),
    g AS (SELECT source, group_key, q_type, n, sha256(source || chr(0) || group_key) AS digest, CASE q_type WHEN 'noul' THEN 30 WHEN 'choice' THEN 60 WHEN 'score' THEN 20 END AS goal FROM u WHERE q_type = other AND n <= 200)"""
_TAUGHT = "coalesce(list_max(list_transform(map_values(teacher_probs), lambda m: cardinality(m))), 0)"
_OPTIONS = f"CASE q_type WHEN 'choice' THEN coalesce(len(options), 0) WHEN 'score' THEN coalesce(len(levels), 0) ELSE CASE WHEN {_TAUGHT} > 2 AND len(augmented_options) > 0 THEN len(augmented_options) ELSE 2 END END"

ORACLES = {
    "sample_epoch": _epoch(_POOL, "sqrt(count(*))", "(SELECT count(*) FROM pool)", _EVEN, 3, "CASE WHEN source IN ('synthetic/transit', 'synthetic/clinic', 'synthetic/claims') THEN 'synthetic' ELSE 'other' END", 0.25) + "SELECT place, kind, source, row_no FROM e",
    "sample_pools": f"SELECT kind, source, size, round(sqrt(size), 9) AS weight, round(sqrt(size) / sum(sqrt(size)) OVER (PARTITION BY kind), 9) AS share FROM (SELECT kind, source, count(*) AS size FROM ({_POOL}) GROUP BY 1, 2)",
    "sample_difficulty": _epoch(f"SELECT row_no, {_KIND} AS kind, coalesce(source, '') AS source FROM typed_questions", "CASE WHEN source = 'rubric_scores' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END", "900", {"noul": 0.5, "choice": 1.0, "score": 2.0}, 1, "'all'", 0)
    + "SELECT kind, source, count(*) AS n, count(DISTINCT row_no) AS rows FROM e GROUP BY 1, 2",
    "sample_allocated": """WITH f AS (SELECT row_no, q_type, row_number() OVER (PARTITION BY q_type ORDER BY md5('42:' || row_no), row_no) AS rank FROM typed_questions t WHERE q_type IN ('noul', 'choice', 'score') AND NOT EXISTS (SELECT 1 FROM predictions p WHERE p.item_id = t.id) AND NOT (q_type = 'noul' AND augmented_options IS NOT NULL)),
        a AS (SELECT q_type, max(rank) AS there, least(max(rank), CASE q_type WHEN 'noul' THEN 31 WHEN 'choice' THEN 60 ELSE 8 END) AS q, CASE q_type WHEN 'noul' THEN 1 WHEN 'score' THEN 2 ELSE 3 END AS o FROM f GROUP BY 1),
        s AS (SELECT q_type, 0 AS turn, o FROM a WHERE there > q UNION ALL SELECT q_type, unnest(range(1, there - q)), CASE q_type WHEN 'choice' THEN 1 WHEN 'noul' THEN 2 ELSE 3 END FROM a WHERE there > q),
        x AS (SELECT q_type, count(*) AS more FROM (SELECT q_type, row_number() OVER (ORDER BY turn, o) AS i FROM s) WHERE i <= (SELECT 100 - sum(q) FROM a) GROUP BY 1)
        SELECT row_no, q_type, rank FROM f JOIN a USING (q_type) LEFT JOIN x USING (q_type) WHERE rank <= q + coalesce(more, 0)""",
    "sample_running_cap": """WITH RECURSIVE f AS (SELECT row_no, source, label_level = 0 AS z, row_number() OVER (PARTITION BY source ORDER BY row_no) AS i FROM typed_questions WHERE q_type = 'score' AND label_level IS NOT NULL),
        r AS (SELECT source, 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS l, NULL::BIGINT AS row_no, true AS taken FROM (SELECT DISTINCT source FROM f) UNION ALL
            SELECT f.source, f.i, r.a + CASE WHEN NOT f.z OR r.l + 1 <= ceil(0.25::DOUBLE * (r.a + 1)) THEN 1 ELSE 0 END, r.l + CASE WHEN f.z AND r.l + 1 <= ceil(0.25::DOUBLE * (r.a + 1)) THEN 1 ELSE 0 END, f.row_no, NOT f.z OR r.l + 1 <= ceil(0.25::DOUBLE * (r.a + 1))
            FROM r JOIN f ON f.source IS NOT DISTINCT FROM r.source AND f.i = r.i + 1)
        SELECT row_no, taken FROM r WHERE row_no IS NOT NULL""",
    "sample_templates_capped": """WITH t AS (SELECT row_no, q_type, CASE WHEN starts_with(source, 'synthetic') THEN source || '/' || coalesce(group_key, '') END AS t FROM typed_questions), a AS (SELECT *, row_number() OVER (PARTITION BY t, q_type ORDER BY row_no) AS turn FROM t WHERE t IS NOT NULL),
        b AS (SELECT row_no, row_number() OVER (PARTITION BY t ORDER BY turn, q_type) AS place FROM a) SELECT row_no, place FROM b WHERE place <= 3 UNION ALL SELECT row_no, NULL FROM t WHERE t IS NULL""",
    "sample_gold_slots": f"""WITH g AS (SELECT row_no, label_key, {_KEYS} AS keys, coalesce({_SIDE}, 'none') AS side, md5('7:' || row_no) AS d FROM {_ROWS} WHERE q_type = 'choice' AND list_contains({_KEYS}, label_key)),
        s AS (SELECT *, CAST((row_number() OVER (PARTITION BY side, len(keys) ORDER BY d, row_no) - 1) % len(keys) AS INT) AS slot, list_transform(list_sort(list_transform(list_filter(keys, lambda k: k <> label_key), lambda k: {{'d': md5('7:' || row_no || ':' || k), 'k': k}})), lambda e: e.k) AS o FROM g)
        SELECT row_no, slot, array_to_string(list_concat(o[1:slot], [label_key], o[slot + 1:]), '|') AS keys FROM s""",
    "sample_held_out_clusters": _UNITS + ", r AS (SELECT *, sum(n) OVER (PARTITION BY q_type ORDER BY digest, source, group_key ROWS UNBOUNDED PRECEDING) AS upto FROM g) SELECT source, group_key, q_type, n, CAST(upto AS BIGINT) AS upto FROM r WHERE upto - n < goal",
    "sample_dev_clusters": _UNITS.replace("WITH u", "WITH RECURSIVE u") + """, o AS (SELECT *, row_number() OVER (PARTITION BY q_type, source ORDER BY digest) AS i FROM g),
        f AS (SELECT q_type, source, 0::BIGINT AS i, 0::BIGINT AS used, NULL::VARCHAR AS group_key, 0::BIGINT AS n, '' AS digest, 0 AS goal, false AS ok FROM (SELECT DISTINCT q_type, source FROM o) UNION ALL
            SELECT o.q_type, o.source, o.i, f.used + CASE WHEN f.used + o.n <= 7 THEN o.n ELSE 0 END, o.group_key, o.n, o.digest, o.goal, f.used + o.n <= 7 FROM f JOIN o ON o.q_type = f.q_type AND o.source = f.source AND o.i = f.i + 1),
        r AS (SELECT *, sum(n) OVER (PARTITION BY q_type ORDER BY digest, source, group_key ROWS UNBOUNDED PRECEDING) AS upto FROM f WHERE ok) SELECT source, group_key, q_type, n, CAST(upto AS BIGINT) AS upto FROM r WHERE upto - n < goal""",
    "abstention_split": """WITH t AS (SELECT *, regexp_replace(id, '-(abstain|unans)-.*$', '') AS base, answerable IS NOT DISTINCT FROM false AS c FROM typed_questions), b AS (SELECT base, max(CAST(coalesce(reason = 'insufficient', false) AS INT)) AS forced FROM t WHERE c AND base IS NOT NULL GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY forced DESC, md5('11:' || base), base) AS i FROM b), e AS (SELECT base FROM r WHERE i <= (SELECT greatest(1, round_even(count(*) * 0.3::DOUBLE, 0), sum(forced)) FROM b))
        SELECT row_no, CASE WHEN base IN (SELECT base FROM e) THEN 'eval_negative' ELSE 'train' END AS part FROM t WHERE c UNION ALL SELECT min(row_no), 'eval_positive' FROM t WHERE NOT c AND id IN (SELECT base FROM e) GROUP BY id""",
    "abstention_pairs": f"""WITH t AS (SELECT *, regexp_replace(id, '-(abstain|unans)-.*$', '') AS base, answerable IS NOT DISTINCT FROM false OR reason IS NOT NULL AS w, {_SIDE} AS side FROM {_ROWS}), d AS (SELECT id, min(row_no) AS donor FROM t WHERE NOT w GROUP BY 1),
        p AS (SELECT v.row_no AS variant, d.donor, v.source, v.group_key, v.side, CASE WHEN d.donor IS NULL THEN 'donor is missing' WHEN v.source IS DISTINCT FROM o.source THEN 'donor and variant differ in source' WHEN v.group_key IS DISTINCT FROM o.group_key THEN 'donor and variant differ in group'
            WHEN v.q_type IS DISTINCT FROM o.q_type THEN 'donor and variant differ in question type' END AS problem FROM t v LEFT JOIN d ON v.base = d.id LEFT JOIN t o ON o.row_no = d.donor WHERE v.w)
        SELECT variant, donor, problem, row_number() OVER (ORDER BY sha256(coalesce(source, '') || chr(0) || coalesce(group_key, '')), variant) AS place FROM p WHERE side IS DISTINCT FROM 'test'""",
    "sample_strided": """WITH n AS (SELECT row_no, row_number() OVER (ORDER BY row_no) - 1 AS i, count(*) OVER () AS total FROM typed_questions)
        SELECT row_no, CAST(i % 7 AS INT) AS rank, i // 7 AS step FROM n UNION ALL SELECT row_no, CAST(i AS INT), CAST(ceil(total / 7.0) - 1 AS BIGINT) FROM n WHERE i < 7 AND total % 7 <> 0 AND i >= total % 7""",
    "split_halves": "WITH n AS (SELECT id, row_number() OVER (ORDER BY id) AS i, count(*) OVER () AS total FROM (SELECT DISTINCT id FROM typed_questions WHERE id IS NOT NULL)) SELECT id, CASE WHEN i % 2 = 1 THEN 'even' ELSE 'odd' END AS parity, CASE WHEN i <= total // 2 THEN 'first' ELSE 'second' END AS half FROM n",
    "sample_chunks": "WITH u AS (SELECT coalesce(state, '') AS s, min(row_no) AS f, count(*) AS n FROM typed_questions GROUP BY 1), c AS (SELECT s, CAST(sum(n) OVER (ORDER BY f ROWS UNBOUNDED PRECEDING) - n AS BIGINT) // 50 AS chunk FROM u) SELECT row_no, chunk FROM typed_questions t JOIN c ON coalesce(t.state, '') = c.s",
    "score_new_states": """WITH t AS (SELECT row_no, source, q_type, lower(trim(regexp_replace(state, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))) AS s FROM typed_questions),
        f AS (SELECT s, min(row_no) FILTER (source IS NOT NULL) AS row_no FROM t WHERE s <> '' GROUP BY 1 HAVING NOT bool_or(q_type = 'score') AND min(row_no) FILTER (source IS NOT NULL) IS NOT NULL)
        SELECT row_no, 'scoregen-' || regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(sha1(f.s), 1, 10) AS candidate_id FROM f JOIN t USING (row_no)""",
    "pred_run_changes": """WITH o AS (SELECT run_name, item_id, min((source, q_type)) AS f FROM predictions WHERE item_id IS NOT NULL GROUP BY 1, 2), b AS (SELECT * FROM o WHERE run_name = 'head-base'), n AS (SELECT DISTINCT run_name FROM predictions WHERE run_name <> 'head-base'),
        c AS (SELECT o.run_name, 'added' AS change, o.f FROM o WHERE run_name <> 'head-base' AND item_id NOT IN (SELECT item_id FROM b) UNION ALL SELECT n.run_name, 'dropped', b.f FROM b, n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.run_name = n.run_name AND o.item_id = b.item_id))
        SELECT run_name, change, f[1] AS source, f[2] AS q_type, count(*) AS n FROM c GROUP BY ALL""",
    "pred_orphans": "SELECT run_name, count(*) FILTER (item_id IN (SELECT id FROM typed_questions WHERE id IS NOT NULL)) AS kept, count(*) - count(*) FILTER (item_id IN (SELECT id FROM typed_questions WHERE id IS NOT NULL)) AS orphaned FROM predictions GROUP BY 1",
    "teacher_unlabelled": """SELECT source, count(*) FILTER (coalesce(cardinality(teacher_probs), 0) = 0) AS unlabelled, count(*) FILTER (coalesce(map_contains(teacher_probs, 'teacher-a'), false) AND NOT coalesce(map_contains(teacher_probs, 'teacher-b'), false)) AS only_a,
        count(*) FILTER (coalesce(map_contains(teacher_probs, 'teacher-b'), false) AND NOT coalesce(map_contains(teacher_probs, 'teacher-a'), false)) AS only_b FROM typed_questions GROUP BY 1""",
    "options_within_limit": f"SELECT q_type, count(*) FILTER (k <= 4) AS kept, count(*) FILTER (k > 4) AS skipped, max(k) AS most FROM (SELECT q_type, {_OPTIONS} AS k FROM typed_questions) GROUP BY 1",
    "options_variants": f"""WITH b AS (SELECT row_no, q_type, instructions, CASE q_type WHEN 'choice' THEN {_KEYS} WHEN 'score' THEN levels END AS keys, CASE q_type WHEN 'choice' THEN label_key ELSE CAST(coalesce(label_level, try_cast(trim(label_key) AS DOUBLE)) AS VARCHAR) END AS label FROM typed_questions),
        v AS (SELECT *, len(keys) AS n, unnest(['neutral', 'nonsense', 'reversed', 'shuffled']) AS variant FROM b WHERE len(keys) > 0 AND label IS NOT NULL),
        o AS (SELECT *, CASE variant WHEN 'reversed' THEN list_reverse(range(n)) WHEN 'shuffled' THEN list_transform(list_sort(list_transform(range(n), lambda i: {{'d': md5('5:' || row_no || ':' || i), 'i': i}})), lambda e: e.i) ELSE range(n) END AS ord, try_cast(label AS DOUBLE) AS l FROM v),
        m AS (SELECT *, list_position(ord, CAST(floor(l) AS BIGINT)) - 1 AS a, list_position(ord, least(CAST(floor(l) AS BIGINT) + 1, n - 1)) - 1 AS z FROM o)
        SELECT row_no, variant, CASE variant WHEN 'neutral' THEN 'Choose the best answer.' WHEN 'nonsense' THEN 'Blue seven quietly under the.' ELSE instructions END AS instructions, array_to_string(list_transform(ord, lambda i: keys[i + 1]), '|') AS keys,
        CASE WHEN q_type = 'choice' THEN label ELSE CAST(CAST(a + (l - floor(l)) * (z - a) AS DOUBLE) AS VARCHAR) END AS label FROM m WHERE q_type = 'choice' OR l BETWEEN 0 AND n - 1""",
    "options_k_augmented": f"""WITH c AS (SELECT row_no, len(options) AS n, teacher_probs IS NOT NULL AS taught, {_HASH.format("'3:1:coin:' || row_no")} < 0.5::DOUBLE AS d, least(12, greatest(4, CAST(round_even(exp(ln(4.0::DOUBLE) + {_HASH.format("'3:k:' || row_no")} * (ln(12.0::DOUBLE) - ln(4.0::DOUBLE))), 0) AS INT))) AS k FROM typed_questions WHERE q_type = 'choice' AND options IS NOT NULL)
        SELECT count(*) AS choice_items, count(*) FILTER (d) AS selected, count(*) FILTER (d AND taught) AS teachers_dropped, CAST(sum(n) AS BIGINT) AS encodes_before, round(coalesce(avg(k) FILTER (d AND k > n), 0), 9) AS target_mean FROM c""",
}


def _with_predictions() -> None:
    from sievework.plans.predictions import _ONE, _SCORED

    one = _SCORED + _ONE
    short = "list_transform(list_sort(list_transform(range(k), lambda i: {'v': -probs[i + 1], 'i': i})), lambda e: e.i)"
    ORACLES["pred_shortlists"] = one + f", s AS (SELECT item_id, run_name, gold, {short}[1:2] AS b FROM one) SELECT item_id, run_name, array_to_string(list_sort(CASE WHEN list_contains(b, gold) THEN b ELSE list_concat(b[1:1], [gold]) END), ',') AS short FROM s"
    ORACLES["pred_duels"] = one + f""", s AS (SELECT item_id, run_name, probs, unnest({short}[1:3]) AS o FROM one WHERE k >= 2), d AS (SELECT a.item_id, a.run_name, a.o AS x, b.o AS y, a.probs[a.o + 1] / (a.probs[a.o + 1] + a.probs[b.o + 1]) AS p FROM s a JOIN s b ON a.item_id IS NOT DISTINCT FROM b.item_id AND a.run_name IS NOT DISTINCT FROM b.run_name AND a.o < b.o WHERE a.probs[a.o + 1] + a.probs[b.o + 1] > 0),
        c AS (SELECT *, least(1 - 1e-6, greatest(1e-6, p)) AS q FROM d), w AS (SELECT item_id, run_name, x AS o, ln(q) AS w FROM c UNION ALL SELECT item_id, run_name, y, ln(1 - q) FROM c) SELECT item_id, run_name, CAST(o AS INT) AS option, round(avg(w), 7) AS score, count(*) AS duels FROM w GROUP BY ALL"""
    ORACLES["sample_bands"] = one + """, p AS (SELECT item_id, run_name, min(probs[gold + 1]) AS p FROM one GROUP BY 1, 2), j AS (SELECT q.q_type, q.source, b.p AS base, n.p AS now FROM typed_questions q LEFT JOIN p b ON b.run_name = 'head-base' AND b.item_id = q.id LEFT JOIN p n ON n.run_name = 'head-lora' AND n.item_id = q.id),
        k AS (SELECT *, CASE WHEN now > 0.8 THEN 'easy' WHEN now <= 0.05 THEN 'never' WHEN now IS NOT NULL THEN 'band' END AS nb, CASE WHEN base > 0.8 THEN 'easy' WHEN base <= 0.05 THEN 'never' WHEN base IS NOT NULL THEN 'band' END AS bb FROM j)
        SELECT q_type, source, coalesce(nb, 'missing') AS band, count(*) AS n, CAST(sum(CAST(coalesce(bb <> nb, false) AS INT)) AS BIGINT) AS changed, round(min(now), 9) AS least FROM k GROUP BY 1, 2, 3"""


_with_predictions()
