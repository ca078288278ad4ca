"""The pN_ queries: each problem's operator over whole tables, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import crosssplit, cutting, formatdup, groupsplit, leakage, mixing, neardup, packing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _limit(spark: SparkSession, sf_dir: str, task: str) -> tuple[int, int]:
    row = _table(spark, sf_dir, "size_limits").where(F.col("task") == task).first()
    return row["max_tokens"], row["overlap_tokens"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.verbatim(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), 10)


def p1_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.paraphrases(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdup.copies_found(formatdup.records(_table(spark, sf_dir, "corpus_records")))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdup.collapsed(formatdup.records(_table(spark, sf_dir, "corpus_records")))


def _near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [(_table(spark, sf_dir, name), "row_no", "state") for name in ("typed_questions", "corpus_records")]
    return neardup.near_groups(neardup.representatives(*tables), 0.7)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_found(_near_groups(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_groups(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.overlaps_found(crosssplit.overlaps(_table(spark, sf_dir, "typed_questions"), 0.7))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosssplit.counts(_table(spark, sf_dir, "typed_questions"), 0.7)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupsplit.torn(groupsplit.sets(_table(spark, sf_dir, "typed_questions")))


def p5_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupsplit.assign(groupsplit.sets(_table(spark, sf_dir, "typed_questions")), _table(spark, sf_dir, "split_targets"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _limit(spark, sf_dir, "pack")
    return packing.pack(_table(spark, sf_dir, "documents"), capacity)


def p6_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _limit(spark, sf_dir, "pack")
    return packing.fills(packing.pack(_table(spark, sf_dir, "documents"), capacity), capacity)


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_table(spark, sf_dir, "documents"), _limit(spark, sf_dir, "pack")[0])


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, _ = _limit(spark, sf_dir, "pack")
    return packing.totals(packing.pack(_table(spark, sf_dir, "documents"), capacity), capacity)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return mixing.mix(documents, mixing.plan_mix(documents, _table(spark, sf_dir, "mix_targets")))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return mixing.shares(documents, mixing.plan_mix(documents, _table(spark, sf_dir, "mix_targets")))


def p7_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mix in which every source with tokens gives its whole share."""
    documents = _table(spark, sf_dir, "documents")
    plans = mixing.plan_mix(documents, _table(spark, sf_dir, "mix_targets"))
    return mixing.shares(documents, mixing.plan_mix(documents, _table(spark, sf_dir, "mix_targets"), mixing.largest_exact(plans)))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a mix, by source: tokens there are, whether no text is used more often than allowed, and whether the tokens used are within a hundredth of those meant."""
    s = p7_shares(spark, sf_dir)
    return s.select("source", "source_tokens", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("used_tokens") - F.col("goal_tokens")) <= F.greatest(0.01 * F.col("goal_tokens"), F.lit(20_000.0))).alias("as_meant"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of cut texts: texts, tokens of the pieces less what they share, pieces above the limit."""
    limit, overlap = _limit(spark, sf_dir, "cut")
    return p8_pieces(spark, sf_dir).agg(F.countDistinct("doc_id").alias("texts"), F.sum(F.col("tokens") - F.when(F.col("piece_no") > 0, overlap).otherwise(0)).alias("tokens"), F.sum((F.col("tokens") > limit).cast("int")).alias("above"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.cut_texts(_table(spark, sf_dir, "documents"), *_limit(spark, sf_dir, "cut"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.oversized(p8_pieces(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_paraphrases": p1_paraphrases,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_assignment": p5_assignment,
    "p6_containers": p6_containers,
    "p6_fills": p6_fills,
    "p6_fill_report": p6_fill_report,
    "p6_totals": p6_totals,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_exact_shares": p7_exact_shares,
    "p7_totals": p7_totals,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
    "p8_totals": p8_totals,
}

_IDEOGRAPHS = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2F800}-\x{2FA1F}"
_TOKEN = rf"(?:[^\P{{L}}{_IDEOGRAPHS}]|\p{{N}})+|[{_IDEOGRAPHS}]|[^\s\p{{L}}\p{{N}}\p{{Z}}\p{{Cc}}\p{{Cf}}]"

_COUNTS = f"SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_TOKEN}')), 0) AS n FROM documents"

_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_PLAIN = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _form(column: str) -> str:
    """The form of a text, for the characters that occur in the tables: of compatibility characters wide ones and two ligatures, of folding beyond lower() three letters."""
    told = f"lower(nfc_normalize(translate(regexp_replace(coalesce({column}, ''), '\\p{{Cf}}', '', 'g'), '{_WIDE}', '{_PLAIN}')))"
    return f"trim(regexp_replace(replace(replace(replace(replace({told}, 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_SPLIT = "lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g'))"
_NAMED = f"CASE WHEN {_SPLIT} IN ('val', 'dev', 'valid') THEN 'validation' WHEN {_SPLIT} <> '' THEN {_SPLIT} END"
_CHAINS = "cc(id, c) USING KEY (id) AS (SELECT id, id FROM d UNION (SELECT e.b, min(cc.c) FROM cc JOIN e ON cc.id = e.a JOIN recurring.cc AS r ON r.id = e.b WHERE cc.c < r.c GROUP BY e.b))"
# all pairs of forms by the substrings they share
_NEAR = """d AS MATERIALIZED (SELECT s, min(row_no) AS id FROM t WHERE s <> '' GROUP BY s), g AS MATERIALIZED (SELECT id, count(*) OVER (PARTITION BY id) AS n, g FROM (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(length(s) - 3, 2)), lambda i: substr(s, i, 5))) AS g FROM d)),
    p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.g = b.g AND a.id < b.id AND a.n BETWEEN b.n * 0.7 AND b.n / 0.7 GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9), e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)"""
_WINDOWS = "unnest(list_distinct(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))))"
_RECORDS = f"""WITH q AS (SELECT row_no, string_agg({_form("t.fullkey")} || '=' || CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'DECIMAL') THEN 'n' ELSE t.type END || ':' || CASE WHEN t.type = 'VARCHAR' THEN {_form("t.atom ->> '$'")} WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'DECIMAL') THEN CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) ELSE coalesce(CAST(t.atom AS VARCHAR), '') END, chr(30)
        ORDER BY {_form("t.fullkey")}, t.fullkey) AS q FROM corpus_records c, LATERAL (SELECT * FROM json_tree(CASE WHEN json_valid(c.question) THEN c.question END)) t GROUP BY row_no),
    r AS (SELECT row_no, {_form('state')} AS s, q FROM corpus_records LEFT JOIN q USING (row_no)), f AS (SELECT row_no, s <> '' AND q IS NOT NULL AS ok, CASE WHEN s <> '' AND q IS NOT NULL THEN min(row_no) OVER (PARTITION BY s, q) ELSE row_no END AS first_row FROM r)"""
_BOTH = f"WITH RECURSIVE t AS MATERIALIZED (SELECT row_no, {_form('state')} AS s FROM typed_questions UNION ALL SELECT row_no, {_form('state')} FROM corpus_records), {_NEAR}"
_CROSS = f"""WITH t AS MATERIALIZED (SELECT row_no, {_form('state')} AS s, {_NAMED} AS sp, {_form('source')} AS source FROM typed_questions), {_NEAR}, r AS MATERIALIZED (SELECT t.row_no, t.sp, t.source, d.id FROM t JOIN d USING (s)),
    x AS (SELECT a.row_no AS train, b.row_no AS held, b.sp AS split, b.source, a.id = b.id AS equal FROM r a JOIN (SELECT id AS a, id AS b FROM d UNION ALL SELECT a, b FROM e) k ON a.id = k.a JOIN r b ON b.id = k.b WHERE a.sp = 'train' AND b.sp IN ('validation', 'test'))"""

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH d AS MATERIALIZED (SELECT doc_id, string_split({_form('text')}, ' ') AS w FROM documents), i AS MATERIALIZED (SELECT id AS item_id, string_split({_form('state')}, ' ') AS w FROM eval_items), k AS (SELECT DISTINCT item_id, {_WINDOWS} AS k FROM i)
        SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {_WINDOWS} AS k FROM d) JOIN k USING (k)""",
    "p2_found": _RECORDS + "SELECT first_row, row_no FROM f WHERE first_row <> row_no",
    "p2_records": _RECORDS + "SELECT first_row, count(*) AS copies, bool_and(ok) AS comparable FROM f GROUP BY 1",
    "p3_found": _BOTH + f", {_CHAINS} SELECT c AS first_row, id AS row_no FROM cc WHERE c <> id",
    "p3_groups": _BOTH + f", {_CHAINS}, n AS (SELECT a, count(*) AS n FROM e GROUP BY 1) SELECT id AS row_no, c AS first_row, coalesce(n, 0) AS links FROM cc LEFT JOIN n ON n.a = cc.id",
    "p4_found": _CROSS + "SELECT least(train, held) AS row_a, greatest(train, held) AS row_b FROM x",
    "p4_counts": _CROSS + "SELECT split, source, count(*) AS pairs, count(*) FILTER (equal) AS equal_pairs, count(DISTINCT held) AS held_rows, count(DISTINCT train) AS train_rows FROM x GROUP BY 1, 2",
    "p5_found": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_no AS id, {_form('state')} AS s, {_form('source')} AS source, {_form('group_key')} AS g, {_NAMED} AS sp FROM typed_questions),
        k AS (SELECT id, min(id) OVER (PARTITION BY s) AS f FROM d WHERE s <> '' UNION ALL SELECT id, min(id) OVER (PARTITION BY source, g) FROM d WHERE g <> ''), e AS MATERIALIZED (SELECT id AS a, f AS b FROM k WHERE id <> f UNION ALL SELECT f, id FROM k WHERE id <> f),
        {_CHAINS}, b AS (SELECT c FROM cc JOIN d USING (id) GROUP BY 1 HAVING count(DISTINCT sp) > 1) SELECT c AS first_row, id AS row_no FROM cc JOIN b USING (c) WHERE c <> id""",
    "p6_totals": f"SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n > (SELECT max_tokens FROM size_limits WHERE task = 'pack')) AS split, 0 AS torn, 0 AS crowded FROM ({_COUNTS})",
    "p7_totals": f"""WITH f AS (SELECT trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS s, n FROM ({_COUNTS})), t AS (SELECT trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS source, sum(target_share) AS share FROM mix_targets WHERE target_share > 0 GROUP BY 1)
        SELECT source, CAST(coalesce(sum(n), 0) AS BIGINT) AS source_tokens, true AS within_cap, true AS as_meant FROM t LEFT JOIN f ON f.s = t.source GROUP BY 1""",
    "p8_totals": f"SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens, 0 AS above FROM ({_COUNTS}) WHERE n > (SELECT max_tokens FROM size_limits WHERE task = 'cut')",
    "p8_found": f"SELECT doc_id FROM ({_COUNTS}) WHERE n > (SELECT max_tokens FROM size_limits WHERE task = 'cut') GROUP BY 1",
}
