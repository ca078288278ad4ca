"""Queries over documents, corpus records and typed questions: dedup, contamination, leakage, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.forms import folded_column
from sievework.operators import corpus


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(operator, *names: str, **options):  # noqa: ANN001, ANN003, ANN202
    return lambda spark, sf_dir: operator(*(_t(spark, sf_dir, n) for n in names), **options)


def first_wins_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_wins(_t(spark, sf_dir, "corpus_records")).groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("n"))


def documents_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least doc_id of each normalised text."""
    return _t(spark, sf_dir, "documents").select("doc_id", folded_column("text").alias("norm")).where("norm <> ''").groupBy("norm").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


def cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.cross_source(_t(spark, sf_dir, "corpus_records"), folded_column("state"))


def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that corpora share, two by two."""
    return corpus.cross_source(_t(spark, sf_dir, "corpus_records").drop("source").withColumnRenamed("corpus", "source"), F.col("id"))


def contamination_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = corpus.contamination_pairs(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_items"))
    return pairs.join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").join(_t(spark, sf_dir, "eval_items").select(F.col("id").alias("item_id"), "tier"), "item_id").groupBy("source", "tier", "reason").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("doc_id").alias("documents"))


QUERIES = {
    "contamination_pairs": _on(corpus.contamination_pairs, "documents", "eval_items"),
    "contamination_summary": contamination_summary,
    "contamination_pooled": _on(corpus.contamination_pooled, "documents", "eval_items"),
    "containment_by_probe": _on(corpus.containment, "documents", "eval_items"),
    "first_wins": _on(corpus.first_wins, "corpus_records"),
    "first_wins_counts": first_wins_counts,
    "first_wins_strict": _on(corpus.first_wins, "corpus_records", keep_reuse=False),
    "documents_first": documents_first,
    "duplicate_metrics": _on(corpus.duplicate_metrics, "corpus_records"),
    "cross_source_states": cross_source,
    "corpus_overlap_matrix": overlap_matrix,
    "id_suffixes": _on(corpus.id_suffixes, "corpus_records"),
    "exact_leaks": _on(corpus.exact_leaks, "typed_questions"),
    "coverage_gaps": _on(corpus.coverage_gaps, "typed_questions", "predictions"),
    "licence_counts": _on(corpus.licence_counts, "corpus_records", "licence_manifest"),
    "length_profile": _on(corpus.length_profile, "documents"),
    "json_profile_events": _on(corpus.json_profile, "events", column="props", group="event_type"),
    "json_profile_questions": _on(corpus.json_profile, "corpus_records", column="question", group="corpus"),
}

# full case folding, of the characters that occur in the tables beyond what lower() does
_NORM = "trim(regexp_replace(replace(replace(replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _norm(column: str) -> str:
    return _NORM.format(column)


def _shingles(text: str) -> str:
    return f"unnest(list_distinct(list_transform(range(1, len({text}) - 6), lambda i: array_to_string({text}[i:i + 7], ' '))))"


_PAIRS = f"""
    WITH d AS MATERIALIZED (SELECT *, string_split(norm, ' ') AS w FROM (SELECT doc_id, {_norm('text')} AS norm FROM documents)),
    p AS MATERIALIZED (SELECT *, string_split(norm, ' ') AS w FROM (SELECT id AS item_id, {_norm('state')} AS norm FROM eval_items)),
    exact AS (SELECT DISTINCT doc_id, item_id FROM d JOIN p USING (norm) WHERE norm <> ''),
    ps AS (SELECT DISTINCT item_id, {_shingles('w')} AS shingle FROM p), ds AS (SELECT doc_id, {_shingles('w')} AS shingle FROM d),
    shared AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN ps USING (shingle) GROUP BY 1, 2 HAVING count(*) >= 3),
    pairs AS (SELECT doc_id, item_id, 'state' AS reason, CAST(0 AS BIGINT) AS shared FROM exact UNION ALL SELECT doc_id, item_id, 'shingle', shared FROM shared WHERE doc_id NOT IN (SELECT doc_id FROM exact))
"""
# one text for each JSON value: its leaves and containers by path, so an object's order doesn't matter
_TREE = """qj AS (SELECT row_no, coalesce(string_agg(t.fullkey || '=' || t.type || ':' || coalesce(CAST(t.atom AS VARCHAR), ''), chr(30) ORDER BY t.fullkey), '!' || any_value(question)) AS q FROM corpus_records c LEFT JOIN LATERAL (SELECT * FROM json_tree(CASE WHEN json_valid(c.question) THEN c.question END)) t ON true GROUP BY row_no),
    lj AS (SELECT row_no, CASE WHEN label IS NULL THEN NULL WHEN json_valid(label) THEN CAST(json(label) AS VARCHAR) ELSE CAST(to_json(label) AS VARCHAR) END AS l FROM corpus_records)"""
_DIGEST = "md5(concat_ws(chr(31), {}))".format(", ".join("CASE WHEN {0} IS NULL THEN '0' ELSE '1' || {0} END".replace("{0}", c) for c in ("id", "s", "q", "l")))
_COLLAPSED = "lower(trim(regexp_replace({}, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')))"
_FIRST = f"""
    WITH {_TREE}, r AS (SELECT row_no, source, id, priority, corpus, pos, {_DIGEST} AS digest FROM (SELECT *, {_norm('state')} AS s FROM corpus_records) JOIN qj USING (row_no) JOIN lj USING (row_no)),
    a AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY priority NULLS FIRST, corpus NULLS FIRST, pos NULLS FIRST, row_no) > 1 AS repeat FROM r),
    o AS (SELECT id, arg_min(source, rn) AS owner FROM (SELECT id, coalesce(source, chr(0)) AS source, row_number() OVER (PARTITION BY id ORDER BY priority NULLS FIRST, corpus NULLS FIRST, pos NULLS FIRST, row_no) AS rn FROM a WHERE NOT repeat AND id IS NOT NULL) GROUP BY 1),
    v AS (SELECT row_no, source, CASE WHEN repeat THEN 'record' WHEN a.id IS NOT NULL AND owner IS DISTINCT FROM coalesce(source, chr(0)) THEN 'id' ELSE 'kept' END AS verdict FROM a LEFT JOIN o ON a.id = o.id)
"""
_JSON = """SELECT {g}, count(*) AS n, CAST(sum(CAST({c} IS NULL AS INT)) AS BIGINT) AS nulls, CAST(sum(CAST({c} IS NOT NULL AND NOT json_valid({c}) AS INT)) AS BIGINT) AS unparsed,
    CAST(sum(CASE WHEN json_valid({c}) AND json_type({c}) = 'OBJECT' THEN len(json_keys({c})) ELSE 0 END) AS BIGINT) AS keys FROM {t} GROUP BY 1"""

ORACLES = {
    "contamination_pairs": _PAIRS + "SELECT * FROM pairs",
    "contamination_summary": _PAIRS + "SELECT source, tier, reason, count(*) AS pairs, count(DISTINCT doc_id) AS documents FROM pairs JOIN documents USING (doc_id) JOIN eval_items ON id = item_id GROUP BY 1, 2, 3",
    "contamination_pooled": _PAIRS + "SELECT doc_id, count(*) AS shared FROM ds WHERE shingle IN (SELECT shingle FROM ps) GROUP BY 1 HAVING count(*) >= 3",
    "containment_by_probe": f"""
        WITH d AS MATERIALIZED (SELECT *, string_split(n, ' ') AS w FROM (SELECT {_COLLAPSED.format('text')} AS n FROM documents)),
        p AS MATERIALIZED (SELECT *, string_split(n, ' ') AS w FROM (SELECT id AS item_id, {_COLLAPSED.format('state')} AS n FROM eval_items)),
        ds AS (SELECT DISTINCT s FROM (SELECT {_shingles('w')} AS s FROM d WHERE len(w) >= 8 UNION ALL SELECT n FROM d WHERE n <> '' AND len(w) < 8)),
        ps AS (SELECT item_id, {_shingles('w')} AS s FROM p WHERE len(w) >= 8 UNION ALL SELECT item_id, n FROM p WHERE n <> '' AND len(w) < 8)
        SELECT item_id, count(*) AS shingles, count(ds.s) AS found, round(count(ds.s) / count(*)::DOUBLE, 9) AS share, count(ds.s) / count(*)::DOUBLE >= 0.5::DOUBLE AS flagged FROM ps LEFT JOIN ds ON ps.s = ds.s GROUP BY 1""",
    "first_wins": _FIRST + "SELECT * FROM v",
    "first_wins_strict": _FIRST.replace("ELSE 'kept' END AS verdict", "WHEN a.id IS NOT NULL AND a.rn > o.first THEN 'reuse' ELSE 'kept' END AS verdict").replace("SELECT id, arg_min(source, rn) AS owner", "SELECT id, arg_min(source, rn) AS owner, min(rn) AS first").replace("FROM a LEFT JOIN o ON a.id = o.id", "FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(repeat AS INT), priority NULLS FIRST, corpus NULLS FIRST, pos NULLS FIRST, row_no) AS rn FROM a) a LEFT JOIN o ON a.id = o.id") + "SELECT * FROM v",
    "first_wins_counts": _FIRST + "SELECT source, verdict, count(*) AS n FROM v GROUP BY 1, 2",
    "documents_first": f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {_norm('text')} AS norm FROM documents) WHERE norm <> '' GROUP BY norm",
    "duplicate_metrics": f"""
        WITH {_TREE}, r AS (SELECT source, s, id, q, {_DIGEST} AS d FROM (SELECT row_no, source, coalesce(id, '') AS id, {_norm("coalesce(state, '')")} AS s FROM corpus_records) JOIN qj USING (row_no) JOIN lj USING (row_no)),
        st AS (SELECT source, count(*) AS states, max(n) AS m, CAST(count(*) FILTER (k > 1) AS BIGINT) AS k FROM (SELECT source, s, count(*) AS n, count(DISTINCT coalesce(q, '')) AS k FROM r GROUP BY 1, 2) GROUP BY 1),
        i AS (SELECT source, count(*) AS ids, max(n) AS m, CAST(count(*) FILTER (k > 1) AS BIGINT) AS k FROM (SELECT source, id, count(*) AS n, count(DISTINCT coalesce(q, '')) AS k FROM r GROUP BY 1, 2) GROUP BY 1),
        a AS (SELECT source, count(*) AS n, count(DISTINCT d) AS records FROM r GROUP BY 1)
        SELECT a.source, n, ids, states, records, n - records AS repeated_records, n - ids AS rows_sharing_id, n - states AS rows_sharing_state, i.k AS ids_of_several_questions, st.k AS states_of_several_questions, i.m AS most_rows_of_id, st.m AS most_rows_of_state
        FROM a JOIN st ON a.source IS NOT DISTINCT FROM st.source JOIN i ON a.source IS NOT DISTINCT FROM i.source""",
    "cross_source_states": f"""WITH k AS (SELECT DISTINCT {_norm('state')} AS key, source FROM corpus_records WHERE source IS NOT NULL)
        SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.source < b.source AND a.key <> '' GROUP BY 1, 2""",
    "corpus_overlap_matrix": """WITH k AS (SELECT DISTINCT id AS key, corpus AS source FROM corpus_records WHERE corpus IS NOT NULL AND id <> '')
        SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM k a JOIN k b ON a.key = b.key AND a.source < b.source GROUP BY 1, 2""",
    "id_suffixes": """WITH r AS (SELECT row_no, corpus, id, count(*) OVER (PARTITION BY corpus, id) AS n, row_number() OVER (PARTITION BY corpus, id ORDER BY pos NULLS FIRST, row_no) - 1 AS i FROM corpus_records WHERE id IS NOT NULL)
        SELECT row_no, CASE WHEN max(n) OVER (PARTITION BY corpus) > 1 THEN id || '-q' || i ELSE id END AS new_id FROM r""",
    "exact_leaks": f"""
        WITH r AS (SELECT row_no, CASE WHEN sp IN ('val', 'dev', 'valid') THEN 'validation' WHEN sp <> '' THEN sp END AS side, {_COLLAPSED.format('state')} AS s,
            concat_ws(chr(30), q_type, {_COLLAPSED.format('instructions')}, array_to_string(list_sort(coalesce(list_transform(options, lambda o: o.key), levels, []::VARCHAR[])), chr(31))) AS q,
            coalesce(CAST(label_bool AS VARCHAR), label_key, CAST(label_level AS VARCHAR)) AS label FROM (SELECT *, lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) AS sp FROM typed_questions)),
        f AS (SELECT * FROM r WHERE s <> ''), t AS (SELECT s, q, arg_min(label, row_no) AS train_label FROM f WHERE side = 'train' GROUP BY 1, 2), st AS (SELECT DISTINCT s FROM f WHERE side = 'train')
        SELECT side, count(*) AS n, count(st.s) AS state_repeats, count(t.q) AS identical, CAST(coalesce(sum(CAST(label <> train_label AS INT)), 0) AS BIGINT) AS label_conflicts
        FROM f LEFT JOIN st ON f.s = st.s LEFT JOIN t ON f.s = t.s AND f.q = t.q WHERE side IN ('validation', 'test') GROUP BY 1""",
    "coverage_gaps": """
        WITH k AS (SELECT DISTINCT id FROM typed_questions WHERE id IS NOT NULL), h AS (SELECT DISTINCT run_name, item_id FROM predictions WHERE item_id IS NOT NULL)
        SELECT r.run_name, count(k.id) AS covered, (SELECT count(*) FROM k) - count(k.id) AS missing, count(h.item_id) - count(k.id) AS unknown
        FROM (SELECT DISTINCT run_name FROM predictions) r LEFT JOIN h ON r.run_name = h.run_name LEFT JOIN k ON k.id = h.item_id GROUP BY 1""",
    "licence_counts": """SELECT c.corpus, coalesce(verdict, CASE WHEN m.corpus IS NOT NULL THEN 'unknown' ELSE 'unlisted' END) AS verdict, count(*) AS n,
        CAST(sum(CAST(coalesce(list_contains(included_in, 'canonical'), false) AND coalesce(verdict = 'allow', false) AS INT)) AS BIGINT) AS included FROM corpus_records c LEFT JOIN licence_manifest m ON c.corpus = m.corpus GROUP BY 1, 2""",
    "length_profile": """
        WITH l AS (SELECT lang, length(text) AS len, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS total FROM documents WHERE text IS NOT NULL)
        SELECT lang, count(*) AS n, max(CASE WHEN i = round_even(0.5 * (total - 1), 0) THEN len END) AS p50, max(CASE WHEN i = round_even(0.9 * (total - 1), 0) THEN len END) AS p90, max(CASE WHEN i = round_even(0.99 * (total - 1), 0) THEN len END) AS p99,
        """ + ", ".join(f"round(avg(CAST(len > {b} AS INT)), 9) AS over_{b}" for b in (128, 512, 1024, 2048, 4096, 8192)) + " FROM l GROUP BY 1",
    "json_profile_events": _JSON.format(g="event_type", c="props", t="events"),
    "json_profile_questions": _JSON.format(g="corpus", c="question", t="corpus_records"),
}
