"""Queries over near-duplicate clusters: reports, splits, removal of what is near held-out rows, groups of tied rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.functions.forms import folded_column
from sievework.operators import clusters, minhash
from sievework.operators.corpus import split_side
from sievework.plans.corpus import _norm


def _t(spark: SparkSession, sf_dir: str, name: str = "typed_questions") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _state():  # noqa: ANN202
    return folded_column(F.coalesce("state", F.lit("")))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "row_no")


def near_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(minhash.clusters(_t(spark, sf_dir), "row_no", _state()))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(_t(spark, sf_dir), "row_no", _state())[0]


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(_t(spark, sf_dir), "row_no", _state())[1]


def cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(clusters.cluster_split(_t(spark, sf_dir), "row_no", _state(), "source")).select("row_no", "cluster", "side", "alone")


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.split_leakage(clusters.cluster_split(_t(spark, sf_dir), "row_no", _state(), "source"))


def without_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(clusters.without_held_out(_t(spark, sf_dir), "row_no", _state(), split_side() == "test"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows tied by normalised state, or by group inside a source."""
    rows = _t(spark, sf_dir)
    group = F.when(F.col("group_key") != "", F.concat_ws("\x1f", F.coalesce("source", F.lit("")), "group_key"))
    return _named(clusters.linked(rows, "row_no", {"state": C.normal_words("state"), "group": group}))


QUERIES = {
    "near_clusters": near_clusters,
    "near_report": report,
    "near_shared_sources": shared,
    "near_greedy": lambda spark, sf_dir: _named(minhash.greedy_kept(_t(spark, sf_dir), "row_no", _state())),
    "near_documents": lambda spark, sf_dir: minhash.clusters(_t(spark, sf_dir, "documents"), "doc_id", folded_column(F.coalesce("text", F.lit("")))).withColumnRenamed("id", "doc_id"),
    "cluster_split": cluster_split,
    "cluster_leakage": leakage,
    "corpus_without_held_out": without_held_out,
    "linked_groups": linked,
}

# all pairs of texts by the substrings they share, then the least id along chains
_NEAR = f"""
    WITH RECURSIVE t AS MATERIALIZED (SELECT row_no, coalesce(source, '') AS source, trim(lower(split)) AS sp, {_norm("coalesce(state, '')")} AS s FROM typed_questions), d AS MATERIALIZED (SELECT s, min(row_no) AS id FROM t WHERE s <> '' GROUP BY s),
    g AS MATERIALIZED (SELECT id, count(*) OVER (PARTITION BY id) AS n, g FROM (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(length(s) - 3, 2)), lambda i: substr(s, i, 5))) AS g FROM d)),
    p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.g = b.g AND a.id < b.id AND a.n BETWEEN b.n * 0.7 AND b.n / 0.7 GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9),
    e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    cc(id, c) USING KEY (id) AS (SELECT id, id FROM d UNION (SELECT e.b, min(cc.c) FROM cc JOIN e ON cc.id = e.a JOIN recurring.cc AS r ON r.id = e.b WHERE cc.c < r.c GROUP BY e.b)),
    m AS MATERIALIZED (SELECT t.row_no, t.source, t.s, cc.c AS cluster FROM t JOIN d USING (s) JOIN cc USING (id))"""
_INSIDE = _NEAR + """, k AS (SELECT cluster FROM m GROUP BY 1 HAVING count(DISTINCT s) > 1), i AS (SELECT cluster, source, count(*) AS rows FROM m JOIN k USING (cluster) GROUP BY 1, 2)"""
_SIDE = "CASE WHEN ('0x' || substr(md5(source || '-' || {}), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.1::DOUBLE THEN 'test' ELSE 'train' END"
_SPLIT = _NEAR + f""", f AS (SELECT *, min(row_no) OVER (PARTITION BY source, cluster) AS first FROM m), x AS (SELECT row_no, source, cluster, {_SIDE.format('first')} AS side, {_SIDE.format('row_no')} AS alone FROM f)"""

ORACLES = {
    "near_clusters": _NEAR + "SELECT row_no, cluster FROM m",
    "near_report": _INSIDE + """, s AS (SELECT cluster, count(*) > 1 AS shared FROM i GROUP BY 1)
        SELECT source, CAST(sum(rows) AS BIGINT) AS rows_in_clusters, count(*) AS clusters, CAST(sum(CAST(shared AS INT)) AS BIGINT) AS shared_clusters FROM i JOIN s USING (cluster) GROUP BY 1""",
    "near_shared_sources": _INSIDE + "SELECT a.source AS source_a, b.source AS source_b, count(*) AS clusters FROM i a JOIN i b ON a.cluster = b.cluster AND a.source < b.source GROUP BY 1, 2",
    "cluster_split": _SPLIT + "SELECT row_no, cluster, side, alone FROM x",
    "cluster_leakage": _SPLIT + """, u AS (SELECT source, cluster, count(*) AS n, sum(CAST(side <> alone AS INT)) AS moved, min(alone) <> max(alone) AS ta, min(side) <> max(side) AS t FROM x GROUP BY 1, 2)
        SELECT source AS domain, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, CAST(sum(moved) AS BIGINT) AS moved, CAST(sum(CAST(ta AS INT)) AS BIGINT) AS torn_alone, CAST(sum(CAST(t AS INT)) AS BIGINT) AS torn FROM u GROUP BY 1""",
    "corpus_without_held_out": _NEAR + """, h AS (SELECT DISTINCT s FROM t WHERE regexp_replace(sp, '^\\s+|\\s+$', '', 'g') = 'test' AND s <> ''), hi AS (SELECT id FROM d JOIN h USING (s)), w AS (SELECT DISTINCT e.b AS id FROM e JOIN hi ON hi.id = e.a)
        SELECT row_no, CASE WHEN regexp_replace(sp, '^\\s+|\\s+$', '', 'g') = 'test' THEN 'held' WHEN t.s IN (SELECT s FROM h) THEN 'equal' WHEN d.id IN (SELECT id FROM w) THEN 'near' ELSE 'kept' END AS verdict FROM t LEFT JOIN d ON t.s = d.s""",
    "linked_groups": """
        WITH RECURSIVE t AS MATERIALIZED (SELECT row_no AS id, trim(regexp_replace(replace(lower(state), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS s, CASE WHEN group_key <> '' THEN coalesce(source, '') || chr(31) || group_key END AS g FROM typed_questions),
        k AS (SELECT id, min(id) OVER (PARTITION BY s) AS f FROM t WHERE s <> '' UNION ALL SELECT id, min(id) OVER (PARTITION BY g) FROM t WHERE g IS NOT NULL), e AS MATERIALIZED (SELECT id AS a, f AS b FROM k WHERE id <> f UNION ALL SELECT f, id FROM k WHERE id <> f),
        cc(id, c) USING KEY (id) AS (SELECT id, id FROM t UNION (SELECT e.b, min(cc.c) FROM cc JOIN e ON cc.id = e.a JOIN recurring.cc AS r ON r.id = e.b WHERE cc.c < r.c GROUP BY e.b))
        SELECT id AS row_no, c AS linked FROM cc""",
}
