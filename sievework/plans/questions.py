"""Queries over typed questions: validation, transforms, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import questions as Q
from sievework.operators import sampling as S


def _q(spark: SparkSession, sf_dir: str, name: str = "typed_questions") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(operator, *args):  # noqa: ANN001, ANN002, ANN202
    return lambda spark, sf_dir: operator(_q(spark, sf_dir), *args)


def _joined(column: str):  # noqa: ANN202
    return F.array_join(column, "|").alias(column)


def score_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.to_score(_q(spark, sf_dir)).select("row_no", "source_type", _joined("levels"), "level")


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice to candidates and back: rows, and how many come back to their label."""
    back = Q.from_candidates(Q.to_candidates(_q(spark, sf_dir)), "level").join(_q(spark, sf_dir).select("row_no", "source", "label_key"), "row_no")
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("chosen") == F.col("label_key")).cast("int")).alias("same"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("group_key", F.lit("")))
    return S.hash_split(_q(spark, sf_dir), key, 0.1).select("row_no", "side")


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q(spark, sf_dir).withColumn("d", S.draw(5, "row_no"))
    return S.cap(rows, ["source"], 20, [F.col("d"), F.col("row_no")]).select("row_no", "source", "rank")


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q(spark, sf_dir).select("row_no", "q_type", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("group_key", F.col("row_no").cast("string"))).alias("g"))
    return S.group_split(rows, "g", "q_type", 0.1, 3).select("row_no", "side")


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified(_q(spark, sf_dir), "source", "row_no", 1000, 5, 350, 9).select("row_no", "source", "rank")


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.round_robin(_q(spark, sf_dir).where("source IS NOT NULL"), "source", [F.col("row_no")]).select("row_no", "source", "place")


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What padding to eight options added to each question: texts, how many of them its source has, and how many are the question's own or come twice (none may)."""
    rows = _q(spark, sf_dir)
    added = Q.pad(rows, 8, 2).select("row_no", F.explode("added").alias("text")).withColumn("norm", F.lower(F.trim("text")))
    own = Q.distractor_pool(rows).select("source", "norm", F.lit(1).alias("own"))
    have = rows.select("row_no", "source", F.transform("options", lambda o: F.lower(F.trim(o["text"]))).alias("have"))
    marked = added.join(have, "row_no").join(own, ["source", "norm"], "left")
    return marked.groupBy("row_no").agg(F.count(F.lit(1)).alias("added"), F.count("own").alias("of_source"), (F.sum(F.array_contains("have", F.col("norm")).cast("int")) + F.count(F.lit(1)) - F.countDistinct("norm")).alias("clashes"))


QUERIES = {
    "question_profile": _on(Q.profile),
    "question_status": lambda spark, sf_dir: _q(spark, sf_dir).select("row_no", Q.label_status().alias("status"), Q.well_formed().alias("formed")),
    "teacher_sums": _on(Q.teacher_sums),
    "teacher_rows": lambda spark, sf_dir: Q.teacher_rows(_q(spark, sf_dir)).select("row_no", "teacher", "key", F.round("p", 9).alias("p")),
    "teacher_agreement": _on(Q.teacher_agreement),
    "teacher_mixed": _on(Q.mixed_gold, 0.3),
    "score_form": score_form,
    "score_candidates": _on(Q.to_candidates),
    "score_round_trip": round_trip,
    "score_reversed": lambda spark, sf_dir: Q.reversed_score(_q(spark, sf_dir)).select("row_no", _joined("levels"), "level"),
    "options_shuffled": lambda spark, sf_dir: Q.shuffled_options(_q(spark, sf_dir), 4).select("row_no", _joined("keys"), "gold"),
    "options_without_gold": lambda spark, sf_dir: Q.without_gold(_q(spark, sf_dir)).select("row_no", _joined("keys")),
    "options_shrunk": lambda spark, sf_dir: Q.shrink(_q(spark, sf_dir), 3, 6).select("row_no", _joined("keys")),
    "options_nested": lambda spark, sf_dir: Q.nested_options(_q(spark, sf_dir), (2, 3, 4), 8).select("row_no", "size", _joined("keys")),
    "options_pool": _on(Q.distractor_pool),
    "options_padded": padded,
    "state_first_sentences": _on(Q.first_sentences, 0.5),
    "split_hash": hash_split,
    "split_groups": group_split,
    "sample_capped": capped,
    "sample_quotas": _on(S.quotas, "source", 1000, 5, 350),
    "sample_stratified": stratified,
    "sample_round_robin": round_robin,
    "sample_temperature": _on(S.temperature_weights, ["q_type"], "source", 2.0),
    "sample_resampling": _on(S.resampling, "q_type", 1000),
    "sample_shards": lambda spark, sf_dir: S.shards(_q(spark, sf_dir), "id", 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n")),
}

_NOUL = "coalesce(label_bool, CASE WHEN lower(trim(label_key)) IN ('true', 'yes', '1') THEN true WHEN lower(trim(label_key)) IN ('false', 'no', '0') THEN false END)"
_LEVEL = "coalesce(label_level, try_cast(trim(label_key) AS DOUBLE))"
_KEYS = "list_transform(options, lambda o: o.key)"
_STATUS = f"""CASE q_type
    WHEN 'choice' THEN CASE WHEN list_contains({_KEYS}, label_key) THEN 'option' WHEN answerable IS NOT DISTINCT FROM false THEN 'withheld_gold' WHEN label_key IS NULL THEN 'missing' ELSE 'not_an_option' END
    WHEN 'score' THEN CASE WHEN {_LEVEL} IS NULL THEN CASE WHEN label_key IS NULL THEN 'missing' ELSE 'not_numeric' END WHEN {_LEVEL} < 0 OR {_LEVEL} > len(levels) - 1 OR levels IS NULL THEN 'out_of_range'
        WHEN abs({_LEVEL} - round_even({_LEVEL}, 0)) < 1e-9 THEN 'level' ELSE 'fractional' END
    WHEN 'noul' THEN CASE WHEN {_NOUL} IS NOT NULL THEN 'boolean' WHEN label_key IS NULL THEN 'missing' ELSE 'not_boolean' END ELSE 'unknown_type' END"""
_TEXTS = "CASE q_type WHEN 'choice' THEN list_transform(options, lambda o: o.text) WHEN 'score' THEN levels END"
_FORMED = f"(q_type IS NOT DISTINCT FROM 'noul' OR coalesce(len({_TEXTS}) >= 2 AND len(list_filter({_TEXTS}, lambda x: coalesce(trim(x) <> '', false))) = len({_TEXTS}), false))"
_TEACH = """WITH e AS (SELECT row_no, q_type, label_key, unnest(map_entries(teacher_probs)) AS t FROM typed_questions), d AS (SELECT row_no, q_type, label_key, t.key AS teacher, t.value AS probs, list_sum(map_values(t.value)) AS total FROM e),
    k AS (SELECT row_no, q_type, label_key, teacher, total, unnest(map_entries(probs)) AS x FROM d), r AS (SELECT row_no, q_type, label_key, teacher, x.key AS key, CASE WHEN abs(total - 1) > 1e-6 AND total > 0 THEN x.value / total ELSE x.value END AS p FROM k)"""
_JOIN = "array_to_string({}, '|')"
_OPT = f"SELECT * FROM typed_questions WHERE q_type = 'choice' AND list_contains({_KEYS}, label_key)"
_QUOTA = """WITH p AS (SELECT source, count(*) AS pool FROM typed_questions WHERE source IS NOT NULL GROUP BY 1), s AS (SELECT source, pool, unnest(range(least(pool, 350))) AS seat FROM p),
    r AS (SELECT source, row_number() OVER (ORDER BY CAST(seat < 5 AS INT) DESC, CASE WHEN seat < 5 THEN seat END NULLS FIRST, pool / (seat + 1)::DOUBLE DESC, source DESC) AS rank FROM s),
    q AS (SELECT p.source, p.pool, count(r.source) AS quota FROM p LEFT JOIN r ON p.source = r.source AND rank <= 1000 GROUP BY 1, 2)"""
_POOL = """WITH o AS (SELECT source, row_no, generate_subscripts(options, 1) AS place, unnest(options) AS o FROM typed_questions WHERE q_type = 'choice'),
    pool AS (SELECT source, lower(trim(o.text)) AS norm, arg_min(o.text, (row_no, place)) AS text, count(*) AS uses FROM o WHERE lower(trim(o.text)) <> '' GROUP BY 1, 2)"""

ORACLES = {
    "question_profile": f"""SELECT q_type, {_STATUS} AS status, count(*) AS n, count(DISTINCT id) AS ids, CAST(sum(CAST(coalesce(cardinality(teacher_probs), 0) > 0 AS INT)) AS BIGINT) AS taught,
        CAST(sum(CAST(answerable IS NOT DISTINCT FROM false AS INT)) AS BIGINT) AS withheld, CAST(sum(CAST(NOT {_FORMED} AS INT)) AS BIGINT) AS malformed FROM typed_questions GROUP BY 1, 2""",
    "question_status": f"SELECT row_no, {_STATUS} AS status, {_FORMED} AS formed FROM typed_questions",
    "teacher_sums": _TEACH + "SELECT teacher, count(*) AS n, CAST(sum(CAST(abs(total - 1) > 1e-6 AS INT)) AS BIGINT) AS off, round(min(total), 9) AS least, round(max(total), 9) AS most FROM d GROUP BY 1",
    "teacher_rows": _TEACH + "SELECT row_no, teacher, key, round(p, 9) AS p FROM r",
    "teacher_agreement": _TEACH + """, t AS (SELECT row_no, teacher, label_key, key, row_number() OVER (PARTITION BY row_no, teacher ORDER BY p DESC, key) AS i FROM r WHERE q_type = 'choice' AND label_key IS NOT NULL)
        SELECT teacher, count(*) AS n, CAST(sum(CAST(key = label_key AS INT)) AS BIGINT) AS agree FROM t WHERE i = 1 GROUP BY 1""",
    "teacher_mixed": _TEACH + "SELECT row_no, teacher, key, round(p * (1 - 0.3::DOUBLE) + CASE WHEN key = label_key THEN 0.3::DOUBLE ELSE 0 END, 9) AS p FROM r WHERE q_type = 'choice' AND label_key IS NOT NULL",
    "score_form": f"""WITH s AS (SELECT row_no, q_type AS source_type, CASE q_type WHEN 'noul' THEN ['no', 'yes'] WHEN 'choice' THEN list_transform(options, lambda o: o.text) ELSE levels END AS levels,
        CASE q_type WHEN 'noul' THEN CAST({_NOUL} AS DOUBLE) WHEN 'choice' THEN nullif(coalesce(list_position({_KEYS}, label_key), 0), 0) - 1 ELSE {_LEVEL} END AS level FROM typed_questions)
        SELECT row_no, source_type, {_JOIN.format('levels')} AS levels, CAST(level AS DOUBLE) AS level FROM s WHERE level BETWEEN 0 AND len(levels) - 1""",
    "score_candidates": """WITH o AS (SELECT row_no, label_key, generate_subscripts(options, 1) - 1 AS place, unnest(options) AS o FROM typed_questions WHERE q_type = 'choice')
        SELECT row_no, place, o.key AS candidate, CASE WHEN o.key = label_key THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS level FROM o WHERE o.key IS NOT NULL""",
    "score_round_trip": f"""SELECT source, count(*) AS n, CAST(sum(CAST(CASE WHEN list_contains({_KEYS}, label_key) THEN label_key ELSE options[1].key END = label_key AS INT)) AS BIGINT) AS same FROM typed_questions WHERE q_type = 'choice' AND len(options) > 0 GROUP BY 1""",
    "score_reversed": f"SELECT row_no, {_JOIN.format('list_reverse(levels)')} AS levels, len(levels) - 1 - label_level AS level FROM typed_questions WHERE q_type = 'score' AND label_level BETWEEN 0 AND len(levels) - 1",
    "options_shuffled": """WITH o AS (SELECT row_no, label_key, unnest(options).key AS key FROM typed_questions WHERE q_type = 'choice'), l AS (SELECT row_no, label_key, list(key ORDER BY md5('4:' || row_no || ':' || key), key) AS keys FROM o GROUP BY 1, 2)
        SELECT row_no, array_to_string(keys, '|') AS keys, coalesce(list_position(keys, label_key), 0) - 1 AS gold FROM l""",
    "options_without_gold": f"SELECT row_no, {_JOIN.format(f'list_filter({_KEYS}, lambda k: k <> label_key)')} AS keys FROM ({_OPT}) WHERE len(options) >= 3",
    "options_shrunk": f"""WITH o AS (SELECT row_no, label_key, generate_subscripts(options, 1) AS place, unnest(options).key AS key FROM ({_OPT}) WHERE len(options) > 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY CASE WHEN key = label_key THEN '' ELSE md5('6:' || row_no || ':' || key) END, place) AS i FROM o)
        SELECT row_no, string_agg(key, '|' ORDER BY place) AS keys FROM r WHERE i <= 3 GROUP BY 1""",
    "options_nested": f"""WITH o AS (SELECT row_no, len(options) AS k, label_key, unnest(options).key AS key FROM ({_OPT})), r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY CASE WHEN key = label_key THEN '' ELSE md5('8:' || row_no || ':' || key) END, key) AS i FROM o)
        SELECT row_no, size, string_agg(key, '|' ORDER BY i) AS keys FROM r, (SELECT unnest([2, 3, 4]) AS size) WHERE i <= size AND k > size GROUP BY 1, 2""",
    "options_pool": _POOL + "SELECT * FROM pool",
    "options_padded": _POOL + f""", q AS (SELECT row_no, source, list_transform(options, lambda o: coalesce(lower(trim(o.text)), '')) AS have FROM typed_questions WHERE q_type = 'choice' AND len(options) < 8 AND list_contains({_KEYS}, label_key)),
        c AS (SELECT row_no, any_value(have) AS have, count(*) FILTER (p.source = q.source AND NOT list_contains(have, p.norm)) AS own, count(DISTINCT p.norm) FILTER (NOT list_contains(have, p.norm)) AS free FROM q, pool p GROUP BY row_no)
        SELECT row_no, least(8 - len(have), free) AS added, least(8 - len(have), own) AS of_source, 0 AS clashes FROM c WHERE least(8 - len(have), free) > 0""",
    "state_first_sentences": "WITH a AS (SELECT row_no, string_split(regexp_replace(state, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM typed_questions WHERE state IS NOT NULL) SELECT row_no, len(a) AS sentences, array_to_string(a[1:greatest(1, CAST(floor(len(a) * 0.5::DOUBLE) AS INT))], ' ') AS state FROM a WHERE len(a) >= 2",
    "split_hash": "SELECT row_no, CASE WHEN ('0x' || substr(md5(coalesce(source, '') || '/' || coalesce(group_key, '')), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.1::DOUBLE THEN 'test' ELSE 'train' END AS side FROM typed_questions",
    "split_groups": """WITH r AS (SELECT row_no, q_type, coalesce(source, '') || '/' || coalesce(group_key, CAST(row_no AS VARCHAR)) AS g FROM typed_questions), g AS (SELECT g, min(q_type) AS s, count(*) AS n FROM r GROUP BY 1),
        o AS (SELECT g, s, sum(n) OVER (PARTITION BY s ORDER BY md5('3:' || g), g ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY s) AS total FROM g)
        SELECT row_no, CASE WHEN before < CASE WHEN total <= 1 THEN 0 ELSE least(total, greatest(1, round_even(total * 0.1::DOUBLE, 0))) END THEN 'val' ELSE 'train' END AS side FROM r JOIN o USING (g)""",
    "sample_capped": "SELECT row_no, source, rank FROM (SELECT row_no, source, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || row_no), row_no) AS rank FROM typed_questions) WHERE rank <= 20",
    "sample_quotas": _QUOTA + "SELECT * FROM q",
    "sample_stratified": _QUOTA + """, t AS (SELECT row_no, source, row_number() OVER (PARTITION BY source ORDER BY md5('9:' || source || ':' || row_no), row_no) AS rank FROM typed_questions WHERE source IS NOT NULL)
        SELECT row_no, t.source, t.rank FROM t JOIN q ON t.source = q.source AND t.rank <= q.quota""",
    "sample_round_robin": "SELECT row_no, source, row_number() OVER (ORDER BY turn, source) AS place FROM (SELECT row_no, source, row_number() OVER (PARTITION BY source ORDER BY row_no) AS turn FROM typed_questions WHERE source IS NOT NULL)",
    "sample_temperature": "SELECT q_type, source, n, round(sqrt(n) / sum(sqrt(n)) OVER (PARTITION BY q_type), 9) AS share FROM (SELECT q_type, source, count(*) AS n FROM typed_questions GROUP BY 1, 2)",
    "sample_resampling": """WITH n AS (SELECT q_type AS kind, count(*) AS pool FROM typed_questions WHERE q_type IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY kind) AS i, count(*) OVER () AS k FROM n),
        s AS (SELECT kind, pool, CAST(CASE WHEN i = k THEN 1000 - floor(1000 / k::DOUBLE) * (k - 1) ELSE floor(1000 / k::DOUBLE) END AS BIGINT) AS slots FROM r) SELECT kind, pool, slots, round(slots / pool::DOUBLE, 9) AS factor FROM s""",
    "sample_shards": "SELECT CAST(('0x' || substr(md5(coalesce(id, '')), 1, 8))::BIGINT % 7 AS INT) AS shard, count(*) AS n FROM typed_questions GROUP BY 1",
}
