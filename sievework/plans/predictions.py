"""Queries over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import calibration, metrics

TEMPERATURES = metrics.log_spaced(0.25, 8.0, 40)
THRESHOLDS = [0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
WEIGHTS = [0.0, 0.5, 1.0, 2.0]
TIES = ["item_id", "scored_at", "source", "schema_key"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scored(spark.read.parquet(f"{sf_dir}/predictions.parquet"))


def _over(operator, *args):  # noqa: ANN001, ANN002, ANN202
    return lambda spark, sf_dir: operator(_scored(spark, sf_dir), *args)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_scored(spark, sf_dir), ["q_type", "run_name", "tier"])


def best_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_temperature(metrics.temperature_curve(_scored(spark, sf_dir), ["run_name"], TEMPERATURES), ["run_name"])


def cascade_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(metrics.cascade_sweep(_scored(spark, sf_dir), ["run_name"], THRESHOLDS), ["run_name"])


def unmatched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of items that no question has, by run."""
    predictions, questions = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("predictions", "typed_questions"))
    return predictions.join(questions.select(F.col("id").alias("item_id")), "item_id", "left_anti").groupBy("run_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"))


def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.ece_table(_scored(spark, sf_dir), ["run_name"])
    return t.select("run_name", "bin", "n", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("accuracy", 9).alias("accuracy"))


QUERIES = {
    "pred_accuracy_by_type": _over(metrics.accuracy_by_type),
    "pred_summary": summary,
    "pred_ece_bins": ece_bins,
    "pred_ece": _over(metrics.ece, ["run_name", "q_type"]),
    "pred_brier_skill": _over(metrics.brier_skill, ["run_name"]),
    "pred_qwk": _over(metrics.quadratic_kappa, ["run_name"]),
    "pred_chance_corrected": _over(metrics.chance_corrected, ["run_name"]),
    "pred_wilson_breakdown": _over(metrics.wilson_breakdown),
    "pred_risk_coverage": _over(metrics.risk_coverage, ["run_name"], TIES),
    "pred_aurc": _over(metrics.aurc, ["run_name"], TIES),
    "pred_auroc": _over(metrics.auroc, ["run_name"]),
    "pred_topm_recall": _over(metrics.topm_recall, ["run_name"]),
    "pred_temperature_curve": _over(metrics.temperature_curve, ["run_name"], TEMPERATURES),
    "pred_best_temperature": best_temperature,
    "pred_cascade_sweep": _over(metrics.cascade_sweep, ["run_name"], THRESHOLDS),
    "pred_cascade_best": cascade_best,
    "pred_discordance": _over(metrics.discordance),
    "pred_run_distance": _over(metrics.run_distance),
    "pred_position_diagnostics": _over(metrics.position_diagnostics, ["run_name"]),
    "pred_floors": _over(metrics.floors, ["run_name"]),
    "pred_tie_report": _over(metrics.tie_report, ["run_name"]),
    "pred_confidence_relation": _over(metrics.confidence_relation, ["run_name"]),
    "pred_bucket_metrics": _over(metrics.bucket_metrics, ["run_name"]),
    "pred_unmatched_items": unmatched_items,
    "pred_focal_loss": _over(metrics.focal_loss, ["run_name"]),
    "pred_blend_sweep": _over(metrics.blend_sweep, "head-base", "head-lora", WEIGHTS),
    "pred_mixture": _over(metrics.mixture, ["head-base", "head-lora", "head-wide"]),
    "pred_confidence_map": _over(calibration.confidence_map, ["run_name"]),
    "pred_calibrated": _over(calibration.calibrated_report, ["run_name"]),
}

_SCORED = """
    WITH first AS (
        SELECT *, CASE q_type
            WHEN 'noul' THEN CAST(coalesce(label_bool, CASE WHEN lower(trim(label_key)) IN ('true', 'yes', '1') THEN true WHEN lower(trim(label_key)) IN ('false', 'no', '0') THEN false END) AS INT)
            WHEN 'choice' THEN nullif(coalesce(list_position(option_keys, label_key), 0), 0) - 1
            WHEN 'score' THEN nullif(coalesce(list_position(option_keys, CAST(CAST(round_even(label_level, 0) AS BIGINT) AS VARCHAR)), 0), 0) - 1 END AS gold
        FROM predictions),
    scored AS (
        SELECT *, len(probs) AS k, list_position(probs, list_max(probs)) - 1 AS pred, list_max(probs) AS confidence,
            CAST(list_position(probs, list_max(probs)) - 1 = gold AS INT) AS correct,
            CASE WHEN q_type = 'noul' THEN (probs[2] - gold) ** 2
                ELSE list_sum(list_transform(range(len(probs)), lambda i: (probs[i + 1] - CASE WHEN i = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ** 2)) END AS brier,
            list_sum(list_transform(range(len(probs)), lambda i: probs[i + 1] * i)) AS expected
        FROM first WHERE gold IS NOT NULL AND probs IS NOT NULL AND len(probs) = len(option_keys) AND gold < len(probs) AND len(list_filter(probs, lambda p: p IS NULL)) = 0)
"""
_BINS = """, bins AS (SELECT run_name, q_type, least(CAST(floor(confidence * 10) AS INT), 9) AS bin, confidence, correct FROM scored)"""
_RANKED = """, ranked AS (SELECT run_name, correct, row_number() OVER w AS rn, sum(correct) OVER w AS hits, count(*) OVER (PARTITION BY run_name) AS total
    FROM scored WINDOW w AS (PARTITION BY run_name ORDER BY confidence DESC, item_id NULLS FIRST, scored_at NULLS FIRST, source NULLS FIRST, schema_key NULLS FIRST ROWS UNBOUNDED PRECEDING))"""
_SWEEP = f""", m AS (SELECT run_name, correct, CASE WHEN len(probs) > 1 THEN list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] ELSE probs[1] END AS margin FROM scored),
    sweep AS (SELECT run_name, threshold, count(*) AS n, sum(CAST(margin < threshold AS INT)) AS sent, round(avg(CASE WHEN NOT margin < threshold THEN correct END), 9) AS kept_accuracy
        FROM m, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold) GROUP BY ALL)"""
_CURVE = f""", t AS (SELECT run_name, gold, correct, temperature, list_transform(probs, lambda p: ln(greatest(p, 1e-12)) / temperature) AS s FROM scored, (SELECT unnest({TEMPERATURES}::DOUBLE[]) AS temperature)),
    n AS (SELECT *, list_max(s) AS top, ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s))))) + list_max(s) AS norm FROM t),
    b AS (SELECT run_name, temperature, count(*) AS m, abs(sum(correct) - sum(exp(top - norm))) AS gap, sum(norm - s[gold + 1]) AS nll, sum(exp(top - norm)) AS conf FROM n GROUP BY run_name, temperature, least(floor(exp(top - norm) * 10), 9)),
    curve AS (SELECT run_name, temperature, round(sum(nll) / sum(m), 9) AS nll, round(sum(conf) / sum(m), 9) AS confidence, round(sum(gap) / sum(m), 9) AS ece FROM b GROUP BY 1, 2)"""
_WILSON = """round(greatest((hits / n::DOUBLE + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(hits / n::DOUBLE * (1 - hits / n::DOUBLE) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n), 0), 9) AS low,
    round(least((hits / n::DOUBLE + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(hits / n::DOUBLE * (1 - hits / n::DOUBLE) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n), 1), 9) AS high"""
_ONE = """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, run_name ORDER BY scored_at NULLS FIRST, probs) AS rn FROM scored) WHERE rn = 1)"""

ORACLES = {
    "pred_accuracy_by_type": _SCORED + """SELECT q_type, count(*) AS n, round(avg(CASE q_type WHEN 'noul' THEN CAST(CAST(probs[2] > 0.5 AS INT) = gold AS DOUBLE) WHEN 'choice' THEN correct ELSE abs(expected - label_level) END), 9) AS value FROM scored GROUP BY 1""",
    "pred_summary": _SCORED + """, r AS (SELECT *, CASE WHEN q_type = 'score' THEN CASE WHEN k > 1 THEN list_sum(list_transform(range(1, k), lambda i: (list_sum(probs[1:i]) - CASE WHEN i > gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ** 2)) / (k - 1) ELSE 0 END END AS rps,
            CASE WHEN q_type = 'score' THEN abs(expected - label_level) END AS mae FROM scored),
        u AS (SELECT 'all' AS level, NULL AS value, * FROM r UNION ALL SELECT 'q_type', q_type, * FROM r UNION ALL SELECT 'run_name', run_name, * FROM r UNION ALL SELECT 'tier', tier, * FROM r)
        SELECT level, value, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(brier), 9) AS brier, round(avg(confidence), 9) AS mean_confidence, round(avg(rps), 9) AS rps, round(avg(mae), 9) AS mae FROM u GROUP BY 1, 2""",
    "pred_ece_bins": _SCORED + _BINS + "SELECT run_name, bin, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, round(avg(correct), 9) AS accuracy FROM bins GROUP BY 1, 2",
    "pred_ece": _SCORED + _BINS + """SELECT run_name, q_type, CAST(sum(n) AS BIGINT) AS n, round(sum(abs(a - c) * n) / sum(n), 9) AS ece
        FROM (SELECT run_name, q_type, bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM bins GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "pred_brier_skill": _SCORED + """, s AS (SELECT *, row_number() OVER () AS row FROM scored),
        marginal AS (SELECT run_name, q_type, CASE WHEN q_type = 'choice' THEN option_keys[gold + 1] ELSE CAST(gold AS VARCHAR) END AS mark, count(*) AS n FROM s GROUP BY ALL),
        o AS (SELECT row, run_name, q_type, gold, i, CASE WHEN q_type = 'choice' THEN option_keys[i + 1] ELSE CAST(i AS VARCHAR) END AS mark FROM (SELECT *, unnest(range(k)) AS i FROM s)),
        w AS (SELECT o.*, coalesce(n, 0) AS w FROM o LEFT JOIN marginal USING (run_name, q_type, mark)),
        p AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY row) > 0 THEN w / (sum(w) OVER (PARTITION BY row))::DOUBLE ELSE 1.0 / count(*) OVER (PARTITION BY row) END AS p FROM w),
        ref AS (SELECT row, run_name, sum(CASE WHEN q_type = 'noul' AND i = 0 THEN 0 ELSE (p - CASE WHEN i = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ** 2 END) AS reference FROM p GROUP BY 1, 2),
        r AS (SELECT run_name, avg(reference) AS reference FROM ref GROUP BY 1), b AS (SELECT run_name, avg(brier) AS brier FROM s GROUP BY 1)
        SELECT run_name, round(brier, 9) AS brier, round(reference, 9) AS reference, round(CASE WHEN reference > 0 THEN 1 - brier / reference END, 9) AS skill FROM b JOIN r USING (run_name)""",
    "pred_qwk": _SCORED + """, s AS (SELECT run_name, gold, pred FROM scored WHERE q_type = 'score'), n AS (SELECT run_name, count(*) AS n, sum((gold - pred) ** 2) AS seen FROM s GROUP BY 1),
        c AS (SELECT a.run_name, sum((a.gold - b.pred) ** 2) AS chance FROM s a JOIN s b USING (run_name) GROUP BY 1)
        SELECT run_name, n, round(CASE WHEN chance > 0 THEN 1 - seen * n / chance END, 9) AS qwk FROM n JOIN c USING (run_name)""",
    "pred_chance_corrected": _SCORED + """SELECT run_name, k, count(*) AS n, CAST(sum(correct) AS BIGINT) AS hits, round(1.0::DOUBLE / k, 9) AS chance, round((avg(correct) - 1.0::DOUBLE / k) / (1 - 1.0::DOUBLE / k), 9) AS corrected FROM scored WHERE k >= 2 GROUP BY 1, 2""",
    "pred_wilson_breakdown": _SCORED + f""", g AS (SELECT grouping(source, q_type) AS level, source, q_type, count(*) AS n, CAST(sum(correct) AS BIGINT) AS hits FROM scored GROUP BY GROUPING SETS ((), (source), (q_type), (source, q_type)))
        SELECT level, source, q_type, n, hits, {_WILSON} FROM g""",
    "pred_risk_coverage": _SCORED + _RANKED + f""", c AS (SELECT unnest({list(metrics.COVERAGES)}::DOUBLE[]) AS coverage)
        SELECT run_name, coverage, rn AS n, round(1 - hits / rn::DOUBLE, 9) AS risk FROM ranked, c WHERE rn = greatest(1, CAST(ceil(coverage * total) AS BIGINT))""",
    "pred_aurc": _SCORED + _RANKED + "SELECT run_name, round(avg(1 - hits / rn::DOUBLE), 9) AS aurc FROM ranked GROUP BY 1",
    "pred_auroc": _SCORED + """SELECT a.run_name, round(avg(CASE WHEN a.confidence > b.confidence THEN 1.0::DOUBLE WHEN a.confidence = b.confidence THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 9) AS auroc
        FROM scored a JOIN scored b ON a.run_name = b.run_name AND a.correct = 1 AND b.correct = 0 GROUP BY 1""",
    "pred_topm_recall": _SCORED + """, r AS (SELECT run_name, k, len(list_filter(probs, lambda p: p >= probs[gold + 1])) AS rank, unnest(range(1, 6)) AS m FROM scored),
        a AS (SELECT run_name, m, count(*) AS n, avg(CAST(rank <= m AS DOUBLE)) AS share, sum(CAST(k > m AS INT)) AS informative FROM r GROUP BY 1, 2)
        SELECT run_name, m, n, round(share, 9) AS recall, round(sqrt(share * (1 - share) / n), 9) AS error, CAST(informative AS BIGINT) AS informative FROM a""",
    "pred_temperature_curve": _SCORED + _CURVE + "SELECT * FROM curve",
    "pred_best_temperature": _SCORED + _CURVE + "SELECT run_name, arg_min(temperature, (nll, temperature)) AS temperature, min(nll) AS nll, arg_min(temperature, (ece, temperature)) AS ece_temperature, min(ece) AS ece FROM curve GROUP BY 1",
    "pred_cascade_sweep": _SCORED + _SWEEP + "SELECT run_name, threshold, n, CAST(sent AS BIGINT) AS sent, kept_accuracy FROM sweep",
    "pred_cascade_best": _SCORED + _SWEEP + "SELECT run_name, threshold, kept_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY kept_accuracy DESC, threshold DESC) AS rn FROM sweep WHERE kept_accuracy IS NOT NULL) WHERE rn = 1",
    "pred_discordance": _SCORED + _ONE + """SELECT a.run_name AS run_a, b.run_name AS run_b, count(*) AS items, CAST(sum(CAST(a.correct > b.correct AS INT)) AS BIGINT) AS a_only, CAST(sum(CAST(a.correct < b.correct AS INT)) AS BIGINT) AS b_only,
        round(avg(a.correct - b.correct), 9) AS difference, round(stddev_samp(a.correct - b.correct) / sqrt(count(*)), 9) AS error FROM one a JOIN one b ON a.item_id = b.item_id AND a.run_name < b.run_name GROUP BY 1, 2""",
    "pred_run_distance": _SCORED + _ONE + """, u AS (SELECT item_id, run_name, option_keys, probs, option_keys[pred + 1] AS answer FROM one WHERE len(list_distinct(option_keys)) = len(option_keys)),
        j AS (SELECT a.run_name AS run_a, b.run_name AS run_b, a.answer <> b.answer AS changed,
            (list_sum(list_transform(range(len(a.probs)), lambda i: abs(a.probs[i + 1] - coalesce(b.probs[list_position(b.option_keys, a.option_keys[i + 1])], 0))))
             + coalesce(list_sum(list_transform(list_filter(range(len(b.probs)), lambda i: NOT list_contains(a.option_keys, b.option_keys[i + 1])), lambda i: b.probs[i + 1])), 0)) / 2 AS tv
            FROM u a JOIN u b ON a.item_id = b.item_id AND a.run_name < b.run_name)
        SELECT run_a, run_b, count(*) AS items, round(avg(CAST(changed AS DOUBLE)), 9) AS changed, round(avg(tv), 9) AS mean_tv, round(max(tv), 9) AS max_tv FROM j GROUP BY 1, 2""",
    "pred_position_diagnostics": _SCORED + """, b AS (SELECT run_name, correct, least(4, CAST(floor(gold * 5 / k::DOUBLE) AS INT)) AS g, least(4, CAST(floor(pred * 5 / k::DOUBLE) AS INT)) AS p FROM scored),
        x AS (SELECT run_name, g AS part, count(*) AS gold, round(avg(correct), 9) AS accuracy FROM b GROUP BY 1, 2), y AS (SELECT run_name, p AS part, count(*) AS answers FROM b GROUP BY 1, 2)
        SELECT coalesce(x.run_name, y.run_name) AS run_name, coalesce(x.part, y.part) AS part, coalesce(gold, 0) AS gold, coalesce(answers, 0) AS answers, accuracy FROM x FULL JOIN y ON x.run_name = y.run_name AND x.part = y.part""",
    "pred_floors": _SCORED + """, c AS (SELECT run_name, q_type, option_keys[gold + 1] AS g, count(*) AS n, sum(1.0::DOUBLE / k) AS chance FROM scored GROUP BY ALL)
        SELECT run_name, q_type, CAST(sum(n) AS BIGINT) AS n, round(sum(chance) / sum(n), 9) AS chance, round(max(n) / sum(n)::DOUBLE, 9) AS majority FROM c GROUP BY 1, 2""",
    "pred_tie_report": _SCORED + """SELECT run_name, count(*) AS n, CAST(sum(CAST(t > 1 AS INT)) AS BIGINT) AS tied, max(t) AS most_tied FROM (SELECT run_name, len(list_filter(probs, lambda p: p = list_max(probs))) AS t FROM scored) GROUP BY 1""",
    "pred_confidence_relation": _SCORED + """SELECT run_name, round(corr(confidence, correct), 6) AS r, round(regr_slope(correct, confidence), 6) AS slope, round(regr_intercept(correct, confidence), 6) AS intercept, round(regr_r2(correct, confidence), 6) AS r2 FROM scored GROUP BY 1""",
    "pred_bucket_metrics": _SCORED + """SELECT run_name, CASE WHEN k <= 2 THEN '2' WHEN k <= 5 THEN '3-5' WHEN k <= 20 THEN '6-20' WHEN k <= 80 THEN '21-80' WHEN k <= 256 THEN '81-256' ELSE '>256' END AS bucket, count(*) AS n,
        round(avg(correct), 9) AS accuracy, round(avg(brier), 9) AS brier, round(avg(CASE WHEN k > 1 THEN greatest((confidence - 1.0::DOUBLE / k) / (1 - 1.0::DOUBLE / k), 0) ELSE 1 END), 9) AS corrected_confidence FROM scored GROUP BY 1, 2""",
    "pred_focal_loss": _SCORED + """, p AS (SELECT run_name, greatest(probs[gold + 1], 1e-12) AS p FROM scored) SELECT run_name, count(*) AS n, round(avg((1 - p) ** 2 * -ln(p)), 9) AS focal, round(avg(-ln(p)), 9) AS nll FROM p GROUP BY 1""",
    "pred_blend_sweep": _SCORED + _ONE + f""", j AS (SELECT a.k, a.gold, weight, list_transform(range(a.k), lambda i: a.probs[i + 1] + weight * b.probs[i + 1]) AS p FROM one a JOIN one b ON a.item_id = b.item_id AND a.run_name = 'head-base' AND b.run_name = 'head-lora'
            AND a.option_keys = b.option_keys AND a.gold = b.gold, (SELECT unnest({WEIGHTS}::DOUBLE[]) AS weight))
        SELECT CASE WHEN k <= 5 THEN '<=5' WHEN k <= 19 THEN '6-19' ELSE '>=20' END AS bucket, weight, count(*) AS n, round(avg(CAST(list_position(p, list_max(p)) - 1 = gold AS DOUBLE)), 9) AS accuracy FROM j GROUP BY 1, 2""",
    "pred_mixture": _SCORED + _ONE + """, o AS (SELECT item_id, option_keys, gold, generate_subscripts(probs, 1) - 1 AS i, unnest(probs) AS p FROM one), m AS (SELECT item_id, option_keys, gold, i, sum(p) AS p FROM o GROUP BY 1, 2, 3, 4 HAVING count(*) = 3),
        t AS (SELECT *, row_number() OVER (PARTITION BY item_id, option_keys, gold ORDER BY round(p, 12) DESC, i) AS r FROM m) SELECT item_id, option_keys[i + 1] AS answer, CAST(i = gold AS INT) AS correct FROM t WHERE r = 1""",
    "pred_unmatched_items": "SELECT run_name, count(*) AS n, count(DISTINCT item_id) AS items FROM predictions WHERE item_id IS NULL OR item_id NOT IN (SELECT id FROM typed_questions WHERE id IS NOT NULL) GROUP BY 1",
}
