"""Queries of reports over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators import calibration, metrics
from sievework.operators import reports as R
from sievework.plans.predictions import _ONE, _SCORED, _WILSON, ORACLES as P, TIES, WEIGHTS

RUNS = ("head-base", "head-lora", "head-wide")
ANSWER_AT = [0.3, 0.5, 0.7, 0.9]


def _t(spark: SparkSession, sf_dir: str, name: str = "predictions") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scored(_t(spark, sf_dir))


def _over(operator, *args):  # noqa: ANN001, ANN002, ANN202
    return lambda spark, sf_dir: operator(_scored(spark, sf_dir), *args)


def _items(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:  # noqa: ANN002
    """A question of each id, the first."""
    q = _t(spark, sf_dir, "typed_questions").where("id IS NOT NULL")
    return q.groupBy(F.col("id").alias("item_id")).agg(F.min_by(F.struct(*columns), "row_no").alias("q")).select("item_id", "q.*")


def schema_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas below 100 are seen or held out by hash, others aren't assigned."""
    s = _scored(spark, sf_dir)
    mapping = s.where("schema_key < 'schema-100'").select("schema_key").distinct().withColumn("side", F.when(C.hash_fraction(F.col("schema_key")) < 0.8, "seen").otherwise("held_out"))
    return R.by_map(s, mapping, "schema_key", "side")


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the options' keys beside confidence."""
    return R.related(_scored(spark, sf_dir), ["run_name"], F.length(F.array_join("option_keys", "")), F.col("confidence"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.threshold_grid(_scored(spark, sf_dir), ["run_name"]).groupBy("run_name").agg(F.count(F.lit(1)).alias("thresholds"), F.round(F.min("threshold"), 9).alias("least"), F.round(F.sum("threshold"), 6).alias("sum"))


def length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lambda f: F.transform("options", lambda o: o[f])
    return R.length_guard(_scored(spark, sf_dir), _items(spark, sf_dir, o("key").alias("keys"), o("text").alias("texts")))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as seconds."""
    return R.latency(_t(spark, sf_dir, "events").withColumn("s", F.round("value", 3)), ["event_type"], "s")


def recall_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recall_by_reason(_scored(spark, sf_dir), _items(spark, sf_dir, "reason"), 0.8, [*TIES, "run_name"])


def abstention_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of answerable items and of withheld ones, by the items' source."""
    j = _scored(spark, sf_dir).join(_items(spark, sf_dir, "answerable"), "item_id")
    return j.groupBy("source", (~F.col("answerable").eqNullSafe(F.lit(False))).alias("answerable")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 9).alias("accuracy"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _scored(spark, sf_dir).groupBy("run_name", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg("brier").alias("brier"))
    return R.merged(parts, ["run_name"], ["accuracy", "brier"])


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = calibration.screens(_scored(spark, sf_dir))
    return s.select("run_a", "run_b", "n", *(F.round(c, 6).alias(c) for c in ("delta_pp", "low_pp", "high_pp", "p", "discordance")), "wins", "losses", "screen", "improvement", calibration.reading(F.col("delta_pp"), F.col("p"), F.col("low_pp")).alias("reading"))


def detectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.screens(_scored(spark, sf_dir)).select("run_a", "run_b", "n", "detectable_pp", "detectable_cc_pp")


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.mcnemar(_scored(spark, sf_dir)).withColumn("p", F.round("p", 9))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of runs, and whether they lie in their intervals, which are no wider than four standard errors and no narrower than three where there are 30 items."""
    b = calibration.bootstrap(_scored(spark, sf_dir))
    d = metrics.discordance(_scored(spark, sf_dir)).select("run_a", "run_b", "error")
    width = (F.col("high") - F.col("low")) / F.nullif(F.col("error"), F.lit(0.0))
    return b.join(d, ["run_a", "run_b"]).select("run_a", "run_b", "items", F.round("difference", 9).alias("difference"), F.col("difference").between(F.col("low"), F.col("high")).alias("inside"), (F.coalesce(width.between(3.0, 4.8), F.lit(True)) | (F.col("items") < 30)).alias("fitting"))


def fitted_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = calibration.fit_temperature(_scored(spark, sf_dir), ["run_name"])
    return t.select("run_name", F.round("temperature", 5).alias("temperature"), F.round("nll_before", 7).alias("nll_before"), F.round("nll_after", 7).alias("nll_after"), "n")


def temperature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A temperature fitted on half of the items, by hash, and the calibration error and likelihood of the other half before and after."""
    s = _scored(spark, sf_dir)
    half = F.substring(F.md5(F.coalesce("item_id", F.lit(""))), 1, 1) < "8"
    fit = calibration.fit_temperature(s.where(half), ["run_name"]).select("run_name", "temperature")
    held = s.where(~half).join(fit, "run_name")
    logs = F.transform("probs", lambda p: F.ln(F.greatest(p, F.lit(1e-12))))
    after = held.withColumn("probs", F.transform(C.softmax(F.transform(logs, lambda x: x / F.col("temperature"))), lambda x: x)).withColumn("confidence", F.array_max("probs"))
    both = metrics.ece(held, ["run_name"]).select("run_name", "n", F.col("ece").alias("before")).join(metrics.ece(after, ["run_name"]).select("run_name", F.col("ece").alias("after")), "run_name")
    return both.join(fit, "run_name").select("run_name", "n", F.round("before", 7).alias("before"), F.round("after", 7).alias("after"), F.round("temperature", 5).alias("temperature"))


def biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A temperature and a bias for each of eight places, fitted on rows of at most eight options."""
    f = calibration.fit_temperature_bias(_scored(spark, sf_dir).where("k <= 8"), 8)
    return spark.createDataFrame([(f["n"], f["temperature"], f["nll_before"], f["nll_after"], f["bias"])], "n bigint, temperature double, nll_before double, nll_after double, bias array<double>")


def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monotone map without joining small blocks: each drawn towards the base rate by 20 rows."""
    m = calibration.confidence_map(_scored(spark, sf_dir), ["run_name"], 20.0, 1)
    return m.select("run_name", F.round("upto", 7).alias("upto"), F.round("rate", 7).alias("rate"), "n")


def kernel_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.kernel_error(_scored(spark, sf_dir), ["run_name"]).withColumn("error", F.round("error", 8))


def quadratic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of a line as a quadratic of its quantity."""
    x = F.col("l_quantity")
    f = calibration.least_squares(_t(spark, sf_dir, "lineitem"), [x, x * x], F.col("l_extendedprice"))
    rows = [(f["n"], *(round(w, 4) for w in f["weights"]))] if f else []
    return spark.createDataFrame(rows, "n bigint, linear double, quadratic double, fixed double")


def fold_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of orders by key: root mean square of what is left on a fold by the line fitted on the others."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("fold"), F.dayofyear("o_orderdate").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    out = spark.createDataFrame([], "fold bigint, n bigint, rms double")
    for fold in range(5):
        f = calibration.least_squares(o.where(F.col("fold") != fold), [F.col("x")], F.col("y"))
        if f is None:
            continue
        rest = o.where(F.col("fold") == fold).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("y") - calibration.fitted(f, [F.col("x")]), F.lit(2.0)))), 3).alias("rms"))
        out = out.unionByName(rest)
    return out


def surface_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the surface of a state tells withheld answers from others: a ridge fit on eight features, its area under the curve, beside that under labels dealt anew 20 times."""
    q = _t(spark, sf_dir, "typed_questions").withColumn("s", F.coalesce("state", F.lit("")))
    n, tokens = F.greatest(F.length("s"), F.lit(1)), F.filter(F.split("s", r"\s+"), lambda t: t != "")
    share = lambda pattern: F.length(F.regexp_replace("s", pattern, "")) / n
    features = [
        F.log1p(F.length("s")), F.log1p(F.greatest(F.size(tokens), F.lit(1))), F.log1p(F.size(F.split("s", r"[.!?]+\s+"))), F.length(F.regexp_replace("s", r"\s+", "")) / F.greatest(F.size(tokens), F.lit(1)),
        1 - share(r"\p{Nd}"), 1 - share(r"\p{Lu}"), 1 - share(r"[^\p{L}\p{N}\s]"), F.greatest(F.size(F.coalesce("options", F.array().cast("array<struct<key:string,text:string>>"))), F.lit(0)),
    ]
    rows = q.select("row_no", F.col("answerable").eqNullSafe(F.lit(False)).cast("int").alias("withheld"), *(f.cast("double").alias(f"x{i}") for i, f in enumerate(features)))
    xs = [F.col(f"x{i}") for i in range(8)]
    fit = calibration.least_squares(rows, xs, F.col("withheld"), 1.0, True)
    if fit is None:
        return spark.createDataFrame([], "auc double, null_p05 double, null_p50 double, null_p95 double, null_sd double")
    return calibration.null_band(rows.withColumn("score", calibration.fitted(fit, xs)), "score", "withheld", 20, 5, "row_no")


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sorted_board(R.filtered_board(R.board(_scored(spark, sf_dir)), "HEAD", RUNS, True), "accuracy")


def board_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board as it is shown, sorted by name."""
    b = R.sorted_board(R.board(_scored(spark, sf_dir)), "run_name", False)
    return b.select("place", "run_name", R.rendered(F.col("accuracy"), True).alias("accuracy"), R.rendered(F.col("score"), False).alias("score"), R.rendered(F.lit(None).cast("double"), True).alias("latency"))


def teacher_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By teacher and type: rows, how often the most probable key (ties to the least) is the label, and of score labels how often it is within one level."""
    from sievework.operators import questions as Q

    rows = Q.teacher_rows(_t(spark, sf_dir, "typed_questions").withColumn("label_key", F.when(F.col("q_type") == "score", F.bround(Q.level_label(), 0).cast("bigint").cast("string")).when(F.col("q_type") == "noul", F.lower(Q.noul_label().cast("string"))).otherwise(F.col("label_key"))))
    top = rows.where("label_key IS NOT NULL").groupBy("row_no", "q_type", "teacher", "label_key").agg(F.min_by("key", F.struct(-F.col("p"), F.col("key"))).alias("top"))
    near = F.abs(F.expr("try_cast(top AS int)") - F.expr("try_cast(label_key AS int)")) <= 1
    return top.groupBy("teacher", "q_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("top") == F.col("label_key")).cast("int")).alias("agree"), F.sum(((F.col("q_type") == "score") & F.coalesce(near, F.lit(False))).cast("int")).alias("within_one"))


QUERIES = {
    "pred_full_summary": _over(R.full_summary, ["run_name"]),
    "pred_tier_cube": _over(R.tier_cube),
    "pred_rows": _over(R.rows),
    "pred_chance_mean": _over(R.chance_mean, ["run_name"]),
    "pred_schema_split": schema_split,
    "pred_order_positions": _over(R.order_positions, ["run_name"]),
    "pred_order_flips": _over(R.order_flips),
    "pred_surface_relation": surface,
    "pred_threshold_grid": grid,
    "pred_tier_discordance": _over(R.tier_discordance),
    "pred_block_decompose": _over(R.block_decompose, ["run_name"], 3),
    "pred_order_effect": _over(R.order_effect, "head-base", "head-lora"),
    "pred_tie_places": _over(R.tie_places, ["run_name"]),
    "pred_length_guard": length_guard,
    "latency_summary": latency,
    "pred_spread": lambda spark, sf_dir: R.spread(_scored(spark, sf_dir)).withColumn("scale", F.round("scale", 9)),
    "pred_scaled_blend": _over(R.scaled_blend, "head-base", "head-lora", WEIGHTS),
    "pred_type_metrics": _over(R.type_metrics, ["run_name"]),
    "pred_score_metrics": _over(R.score_metrics, ["run_name"]),
    "pred_nested_accuracy": _over(R.nested_accuracy, (2, 3, 4), 8),
    "pred_answered": _over(R.answered, ANSWER_AT),
    "pred_recall_by_reason": recall_by_reason,
    "pred_abstention_groups": abstention_groups,
    "pred_fixes": _over(R.fixes, "head-base"),
    "pred_merged": merged,
    "pred_flagged": _over(R.flagged_breakdown),
    "pred_screens": screens,
    "pred_detectable": detectable,
    "pred_mcnemar": mcnemar,
    "pred_bootstrap": bootstrap,
    "pred_fitted_temperature": fitted_temperature,
    "pred_temperature_report": temperature_report,
    "pred_temperature_bias": biased,
    "pred_isotonic": isotonic,
    "pred_kernel_error": kernel_error,
    "fit_quadratic": quadratic_fit,
    "fit_folds": fold_fit,
    "surface_baseline": surface_baseline,
    "board_runs": boards,
    "board_text": board_text,
    "board_best": _over(R.best_by_source, "head-base"),
    "board_delta": lambda spark, sf_dir: R.delta_at_last_shared(_scored(spark, sf_dir), "head-base", F.date_format("scored_at", "yyyy-MM")),
    "board_votes": _over(R.voted),
    "teacher_detail": teacher_detail,
}

_N = "CAST(count(*) FILTER ({}) AS BIGINT)"
_RPS = "CASE WHEN q_type = 'score' THEN CASE WHEN k > 1 THEN list_sum(list_transform(range(1, k), lambda i: (list_sum(probs[1:i]) - CASE WHEN i > gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ** 2)) / (k - 1) ELSE 0.0::DOUBLE END END"
_ITEMS = ", items AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no) AS rn FROM typed_questions WHERE id IS NOT NULL) WHERE rn = 1)"
_STABLE = "list_position(option_keys, list_min(list_transform(list_filter(range(k), lambda i: probs[i + 1] = list_max(probs)), lambda i: option_keys[i + 1]))) - 1"
_TIED = "len(list_filter(probs, lambda p: p = list_max(probs))) > 1"
_PAIRS = ", pair AS (SELECT a.run_name AS run_a, b.run_name AS run_b, a.correct AS a, b.correct AS b, a.k FROM one a JOIN one b ON a.item_id = b.item_id AND a.k = b.k AND a.run_name < b.run_name AND a.k >= 2)"
_EXACT = "least(1.0::DOUBLE, CASE WHEN {w} + {l} = 0 THEN 1.0::DOUBLE ELSE 2 * list_sum(list_transform(range(least({w}, {l}) + 1), lambda i: exp(lgamma({w} + {l} + 1) - lgamma(i + 1) - lgamma({w} + {l} - i + 1) - ({w} + {l}) * ln(2.0::DOUBLE)))) END)"
_BOARD = """, runs AS (SELECT run_name, count(DISTINCT source) AS sources, avg(correct) FILTER (tier = 'easy') AS easy, avg(correct) FILTER (tier = 'hard') AS hard, avg(correct) FILTER (tier = 'original') AS original, avg(correct) FILTER (q_type = 'noul') AS noul, avg(correct) FILTER (q_type = 'choice') AS choice, avg(correct) FILTER (q_type = 'score') AS score FROM scored GROUP BY 1),
    bys AS (SELECT run_name, source, avg(correct) AS a FROM scored GROUP BY 1, 2), ag AS (SELECT *, (sum(a) OVER (PARTITION BY source) - a) / (count(*) OVER (PARTITION BY source) - 1) AS o FROM bys QUALIFY count(*) OVER (PARTITION BY source) > 1),
    wl AS (SELECT run_name, count(*) FILTER (a > o + 1e-12) AS wins, count(*) FILTER (a < o - 1e-12) AS losses FROM ag GROUP BY 1),
    board AS (SELECT run_name, round(list_avg(list_filter([round(noul, 9), round(choice, 9)], lambda x: x IS NOT NULL)), 9) AS accuracy, sources, round(easy, 9) AS easy, round(hard, 9) AS hard, round(original, 9) AS original, round(noul, 9) AS noul, round(choice, 9) AS choice, round(score, 9) AS score, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses FROM runs LEFT JOIN wl USING (run_name))"""


def _grid(where: str) -> str:
    """The temperature found by trying all of both grids."""
    nll = "avg((SELECT ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[gold + 1] FROM (SELECT list_transform(probs, lambda p: ln(greatest(p, 1e-12)) / t) AS z)))"
    return f""", h AS MATERIALIZED (SELECT run_name, gold, probs FROM scored WHERE {where}), c AS (SELECT run_name, i, t, {nll} AS v FROM h, (SELECT i, 0.05::DOUBLE * pow(400.0::DOUBLE, i / 399.0::DOUBLE) AS t FROM (SELECT unnest(range(400)) AS i)) GROUP BY ALL),
    b AS (SELECT run_name, arg_min(t, (v, i)) AS t FROM c GROUP BY 1), s AS (SELECT run_name, i, lo * pow(hi / lo, i / 39.0::DOUBLE) AS t FROM (SELECT run_name, greatest(0.05::DOUBLE, 1 / pow(400.0::DOUBLE, 1 / 399.0::DOUBLE)) AS lo, least(t * t * pow(400.0::DOUBLE, 1 / 399.0::DOUBLE), 20.0::DOUBLE) AS hi, unnest(range(40)) AS i FROM b)),
    f AS (SELECT h.run_name, i, t, {nll} AS v FROM h JOIN s USING (run_name) GROUP BY ALL), best AS (SELECT run_name, arg_min(t, (v, i)) AS t, min(v) AS v FROM f GROUP BY 1)"""


_ISO = """, pts AS (SELECT run_name, confidence AS x, sum(correct) AS h, count(*) AS n FROM scored GROUP BY 1, 2), p AS (SELECT *, row_number() OVER w AS i, sum(h) OVER w AS ch, sum(n) OVER w AS cn, sum(x * n) OVER w AS cx FROM pts WINDOW w AS (PARTITION BY run_name ORDER BY x)),
    z AS (SELECT run_name, i, ch, cn, cx, ch - h AS bh, cn - n AS bn FROM p), m AS (SELECT a.run_name, a.i AS a, b.i AS b, (b.ch - a.bh) / (b.cn - a.bn)::DOUBLE AS r FROM z a JOIN z b ON a.run_name = b.run_name AND a.i <= b.i),
    lo AS (SELECT run_name, a, b, min(r) OVER (PARTITION BY run_name, a ORDER BY b DESC) AS r FROM m), iso AS (SELECT run_name, b AS i, max(r) AS r FROM lo GROUP BY 1, 2),
    k1 AS (SELECT p.run_name, round(r, 12) AS r, sum(x * n) AS x, sum(h) AS h, sum(n) AS n FROM p JOIN iso USING (run_name, i) GROUP BY 1, 2), base AS (SELECT run_name, sum(h) / sum(n)::DOUBLE AS base FROM pts GROUP BY 1),
    k2 AS (SELECT k1.run_name, row_number() OVER (PARTITION BY k1.run_name ORDER BY r) AS i, x, n, (h + 20 * base) / (n + 20) * n AS h FROM k1 JOIN base USING (run_name)), c2 AS (SELECT *, sum(h) OVER w AS ch, sum(n) OVER w AS cn FROM k2 WINDOW w AS (PARTITION BY run_name ORDER BY i)),
    m2 AS (SELECT a.run_name, a.i AS a, b.i AS b, (b.ch - a.ch + a.h) / (b.cn - a.cn + a.n) AS r FROM c2 a JOIN c2 b ON a.run_name = b.run_name AND a.i <= b.i), lo2 AS (SELECT run_name, a, b, min(r) OVER (PARTITION BY run_name, a ORDER BY b DESC) AS r FROM m2), iso2 AS (SELECT run_name, b AS i, max(r) AS r FROM lo2 GROUP BY 1, 2)
    SELECT run_name, round(sum(x) / sum(n), 7) AS upto, round(sum(h) / sum(n), 7) AS rate, CAST(sum(n) AS BIGINT) AS n FROM k2 JOIN iso2 USING (run_name, i) GROUP BY run_name, round(r, 12)"""

ORACLES = {
    "pred_full_summary": f"""SELECT b.*, e.ece, s.brier, s.skill, q.qwk FROM ({_SCORED} SELECT run_name, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(confidence), 9) AS mean_confidence, round(avg({_RPS}), 9) AS rps, round(avg(CASE WHEN q_type = 'score' THEN abs(expected - label_level) END), 9) AS mae FROM scored GROUP BY 1) b
        JOIN ({_SCORED} SELECT run_name, round(sum(g) / sum(n), 9) AS ece FROM (SELECT run_name, count(*) AS n, abs(sum(correct) - sum(confidence)) AS g FROM scored GROUP BY run_name, least(floor(confidence * 10), 9)) GROUP BY 1) e USING (run_name) JOIN ({P['pred_brier_skill']}) s USING (run_name) LEFT JOIN ({P['pred_qwk']}) q USING (run_name)""",
    "pred_tier_cube": _SCORED + "SELECT grouping(tier, q_type) AS level, tier, q_type, CAST(sum(correct) AS BIGINT) AS correct, count(*) AS total, round(avg(correct), 9) AS accuracy FROM scored GROUP BY CUBE (tier, q_type)",
    "pred_rows": _SCORED + f"SELECT item_id, run_name, q_type, k AS n_options, option_keys[gold + 1] AS gold, option_keys[p + 1] AS predicted, p = gold AS right FROM (SELECT *, {_STABLE} AS p FROM scored)",
    "pred_chance_mean": _SCORED + "SELECT run_name, count(*) AS n, round(avg((correct - 1.0::DOUBLE / k) / (1 - 1.0::DOUBLE / k)), 9) AS corrected, round(avg((correct - 1.0::DOUBLE / k) / (1 - 1.0::DOUBLE / k)), 9) AS from_counts FROM scored WHERE k >= 2 GROUP BY 1",
    "pred_schema_split": _SCORED + "SELECT CASE WHEN schema_key < 'schema-100' THEN CASE WHEN ('0x' || substr(md5(schema_key), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.8::DOUBLE THEN 'seen' ELSE 'held_out' END ELSE 'unassigned' END AS side, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(brier), 9) AS brier FROM scored GROUP BY 1",
    "pred_order_positions": _SCORED + ", p AS (SELECT run_name, max(k) OVER (PARTITION BY run_name) AS most, generate_subscripts(probs, 1) - 1 AS place, unnest(probs) AS p FROM scored) SELECT run_name, CAST(place AS INT) AS place, count(*) AS n, round(avg(p), 9) AS mean, round(avg(p) - 1.0::DOUBLE / any_value(most), 9) AS delta FROM p GROUP BY 1, 2",
    "pred_order_flips": _SCORED + _ONE + """, u AS (SELECT item_id, q_type, run_name, option_keys[pred + 1] AS answer, unnest(option_keys) AS key, unnest(probs) AS p FROM one), o AS (SELECT item_id, q_type, key, max(p) - min(p) AS swing, count(DISTINCT run_name) AS runs, min(answer) AS a, max(answer) AS b FROM u GROUP BY 1, 2, 3),
        i AS (SELECT item_id, q_type, max(swing) AS swing, min(a) <> max(b) AS flip FROM o GROUP BY 1, 2 HAVING max(runs) > 1) SELECT q_type, count(*) AS items, count(*) FILTER (flip) AS flipped, round(avg(swing), 9) AS swing FROM i GROUP BY 1""",
    "pred_surface_relation": _SCORED + "SELECT run_name, count(*) AS n, round(corr(length(array_to_string(option_keys, '')), confidence), 6) AS r, round(corr(length(array_to_string(option_keys, '')), confidence) ** 2, 6) AS r2 FROM scored GROUP BY 1",
    "pred_threshold_grid": _SCORED + ", m AS (SELECT run_name, CASE WHEN k > 1 THEN list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] ELSE probs[1] END AS t FROM scored UNION SELECT run_name, 0 FROM scored UNION SELECT run_name, 1 FROM scored) SELECT run_name, count(*) AS thresholds, round(min(t), 9) AS least, round(sum(t), 6) AS sum FROM m GROUP BY 1",
    "pred_tier_discordance": _SCORED + _ONE + ", i AS (SELECT item_id, min(tier) AS tier, count(DISTINCT run_name) AS runs, min(correct) <> max(correct) AS apart FROM one GROUP BY 1) SELECT tier, count(*) AS items, count(*) FILTER (apart) AS discordant, round(avg(CAST(apart AS DOUBLE)), 9) AS rate FROM i WHERE runs = (SELECT count(DISTINCT run_name) FROM one) GROUP BY 1",
    "pred_block_decompose": _SCORED + f""", b AS (SELECT *, gold // 3 * 3 AS st, probs[gold // 3 * 3 + 1:gold // 3 * 3 + 3] AS bl FROM scored), w AS (SELECT run_name, correct, list_position(bl, list_max(bl)) - 1 + st = gold AS won, gold - st < 0.2 * len(bl) AS f, gold - st >= 0.8 * len(bl) AS l FROM b)
        SELECT run_name, count(*) AS items, {_N.format('won')} AS won, {_N.format('f')} AS gold_first, {_N.format('l AND NOT f')} AS gold_last, round(avg(CAST(won AS INT)), 9) AS won_rate, round(CASE WHEN count(*) FILTER (won) > 0 THEN count(*) FILTER (won AND correct = 1) / (count(*) FILTER (won))::DOUBLE ELSE 0 END, 9) AS right_given_won, round(avg(CAST(won AND correct = 1 AS INT)), 9) AS product FROM w GROUP BY 1""",
    "pred_order_effect": _SCORED + _ONE + f""", j AS (SELECT a.q_type, a.k, a.correct AS ca, b.correct AS cb, a.option_keys[a.pred + 1] <> b.option_keys[b.pred + 1] AS ch, len(list_filter(a.probs, lambda p: p = list_max(a.probs))) > 1 OR len(list_filter(b.probs, lambda p: p = list_max(b.probs))) > 1 AS tie FROM one a JOIN one b ON a.item_id = b.item_id AND a.run_name = 'head-base' AND b.run_name = 'head-lora')
        SELECT q_type, count(*) AS items, round(avg(CAST(ch AS INT)), 9) AS changed, round(avg(ca), 9) AS accuracy_a, round(avg(cb), 9) AS accuracy_b, round(avg(1.0::DOUBLE / k), 9) AS chance, {_N.format('ch AND NOT tie')} AS changed_without_ties FROM j GROUP BY 1""",
    "pred_tie_places": _SCORED + f", t AS (SELECT run_name, list_max(probs) AS top, generate_subscripts(probs, 1) - 1 AS place, unnest(probs) AS p FROM scored WHERE {_TIED}) SELECT run_name, CAST(place AS INT) AS place, count(*) AS ties FROM t WHERE p = top GROUP BY 1, 2",
    "pred_length_guard": _SCORED + _ITEMS + """, j AS (SELECT s.*, list_transform(i.options, lambda o: length(o.text)) AS l FROM scored s JOIN items i ON s.item_id = i.id WHERE s.q_type = 'choice' AND list_transform(i.options, lambda o: o.key) = s.option_keys AND len(list_filter(i.options, lambda o: o.text IS NULL)) = 0)
        SELECT run_name, count(*) AS items, round(avg(CAST(list_position(l, list_max(l)) - 1 = gold AS INT)), 9) AS longest_accuracy, round(avg(correct), 9) AS accuracy, round(avg(CAST(list_position(l, list_max(l)) - 1 = pred AS INT)), 9) AS agreement FROM j GROUP BY 1""",
    "latency_summary": """WITH r AS (SELECT event_type, round(value, 3) AS v, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 3)) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, max(n) AS n, round(500 * (min(v) FILTER (i = floor((n + 1) / 2.0)) + min(v) FILTER (i = ceil((n + 1) / 2.0))), 6) AS median_ms, round(1000 * min(v) FILTER (i = greatest(1, round_even(0.95::DOUBLE * n, 0))), 6) AS p95_ms, round(1000 * avg(v), 6) AS mean_ms, round(1 / avg(v), 6) AS items_per_s FROM r GROUP BY 1""",
    "pred_spread": _SCORED + ", m AS (SELECT run_name, CASE WHEN k > 1 THEN list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] ELSE probs[1] END AS t FROM scored) SELECT run_name, round(coalesce(median(t) FILTER (t > 0), 1), 9) AS scale FROM m GROUP BY 1",
    "pred_scaled_blend": _SCORED + _ONE + f""", m AS (SELECT run_name, coalesce(median(t) FILTER (t > 0), 1) AS scale FROM (SELECT run_name, CASE WHEN k > 1 THEN list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] ELSE probs[1] END AS t FROM scored) GROUP BY 1),
        j AS (SELECT a.k, a.gold, weight, list_transform(range(a.k), lambda i: a.probs[i + 1] / x.scale + weight * b.probs[i + 1] / y.scale) AS p, list_transform(range(a.k), lambda i: a.probs[i + 1] / x.scale + CASE WHEN a.k >= 5 THEN weight ELSE 0 END * b.probs[i + 1] / y.scale) AS l
            FROM one a JOIN one b ON a.item_id = b.item_id AND a.run_name = 'head-base' AND b.run_name = 'head-lora' AND a.option_keys = b.option_keys AND a.gold = b.gold JOIN m x ON x.run_name = 'head-base' JOIN m y ON y.run_name = 'head-lora', (SELECT unnest({WEIGHTS}::DOUBLE[]) AS weight))
        SELECT weight, count(*) AS n, round(avg(CAST(list_position(p, list_max(p)) - 1 = gold AS INT)), 9) AS accuracy, round(avg(CAST(list_position(l, list_max(l)) - 1 = gold AS INT)), 9) AS long_only, round(avg(1.0::DOUBLE / k), 9) AS chance FROM j GROUP BY 1""",
    "pred_type_metrics": _SCORED + f""", e AS (SELECT run_name, q_type, round(sum(g) / sum(n), 9) AS ece FROM (SELECT run_name, q_type, count(*) AS n, abs(sum(correct) - sum(confidence)) AS g FROM scored GROUP BY run_name, q_type, least(floor(confidence * 10), 9)) GROUP BY 1, 2),
        b AS (SELECT run_name, q_type, count(*) AS n, round(avg(CAST({_STABLE} = gold AS INT)), 9) AS accuracy, round(avg(brier), 9) AS brier, {_N.format(_TIED)} AS tied, {_N.format('len(list_distinct(option_keys)) < len(option_keys)')} AS repeated FROM scored GROUP BY 1, 2) SELECT * FROM b JOIN e USING (run_name, q_type)""",
    "pred_score_metrics": _SCORED + """, r AS (SELECT run_name, k, gold, pred, probs, expected, label_level, list_transform(range(k), lambda i: greatest(0.0::DOUBLE, 1 - abs(least(k - 1, greatest(0.0::DOUBLE, label_level)) - i))) AS t FROM scored WHERE q_type = 'score' AND label_level IS NOT NULL),
        b AS (SELECT run_name, count(*) AS n, round(avg(abs(expected - label_level)), 9) AS mae, round(avg(CASE WHEN k > 1 THEN list_sum(list_transform(range(1, k), lambda i: (list_sum(probs[1:i]) - list_sum(t[1:i])) ** 2)) / (k - 1) ELSE 0 END), 9) AS rps FROM r GROUP BY 1),
        o AS (SELECT run_name, k, count(*) AS n, sum((gold - pred) ** 2) AS seen FROM r GROUP BY 1, 2), c AS (SELECT a.run_name, a.k, sum((a.gold - b.pred) ** 2) AS chance FROM r a JOIN r b USING (run_name, k) GROUP BY 1, 2),
        q AS (SELECT run_name, n, round(CASE WHEN chance > 0 THEN 1 - seen * n / chance ELSE 0 END, 9) AS qwk FROM o JOIN c USING (run_name, k)), m AS (SELECT run_name, round(coalesce(sum(qwk * n) FILTER (n >= 30) / sum(n) FILTER (n >= 30), 0), 6) AS qwk, count(*) FILTER (n < 30) AS scales_left_out FROM q GROUP BY 1)
        SELECT * FROM b JOIN m USING (run_name)""",
    "pred_nested_accuracy": _SCORED + """, o AS (SELECT run_name, k, probs[gold + 1] AS mine, list_transform(list_sort(list_transform(list_filter(range(k), lambda i: i <> gold), lambda i: {'d': md5(concat_ws(':', '8', item_id, option_keys[i + 1])), 'p': probs[i + 1]})), lambda e: e.p) AS o, unnest([2, 3, 4]) AS size FROM scored WHERE q_type = 'choice')
        SELECT run_name, size, count(*) AS n, round(avg(CAST(mine > list_max(o[1:size - 1]) AS INT)), 9) AS accuracy FROM o WHERE k > size GROUP BY 1, 2""",
    "pred_answered": _SCORED + f"SELECT run_name, threshold, {_N.format('confidence >= threshold')} AS answered, round(avg(CAST(confidence >= threshold AS INT)), 9) AS rate, round(avg(correct) FILTER (confidence >= threshold), 9) AS accuracy FROM scored, (SELECT unnest({ANSWER_AT}::DOUBLE[]) AS threshold) GROUP BY 1, 2",
    "pred_recall_by_reason": _SCORED + _ITEMS + """, r AS (SELECT coalesce(i.reason, 'none') AS reason, row_number() OVER (ORDER BY confidence DESC, item_id NULLS FIRST, scored_at NULLS FIRST, s.source NULLS FIRST, schema_key NULLS FIRST, run_name NULLS FIRST) AS rn, count(*) OVER () AS n FROM scored s LEFT JOIN items i ON s.item_id = i.id)
        SELECT reason, count(*) AS n, count(*) FILTER (rn > ceil(n * 0.8::DOUBLE)) AS below, round(avg(CAST(rn > ceil(n * 0.8::DOUBLE) AS INT)), 9) AS recall FROM r GROUP BY 1""",
    "pred_abstention_groups": _SCORED + _ITEMS + "SELECT s.source, i.answerable IS DISTINCT FROM false AS answerable, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(confidence), 9) AS mean_confidence FROM scored s JOIN items i ON s.item_id = i.id GROUP BY 1, 2",
    "pred_fixes": _SCORED + _ONE + "SELECT n.run_name, n.q_type, count(*) AS items, count(*) FILTER (o.correct = 0 AND n.correct = 1) AS fixed, count(*) FILTER (o.correct = 1 AND n.correct = 0) AS broken FROM one n JOIN one o ON n.item_id = o.item_id AND o.run_name = 'head-base' AND n.run_name <> 'head-base' GROUP BY 1, 2",
    "pred_merged": _SCORED + "SELECT run_name, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(brier), 9) AS brier FROM scored GROUP BY 1",
    "pred_flagged": _SCORED + f""", g AS (SELECT source, q_type, count(*) AS n, CAST(sum(correct) AS BIGINT) AS hits FROM scored GROUP BY 1, 2), w AS (SELECT *, {_WILSON}, sum(hits) OVER () / sum(n) OVER ()::DOUBLE AS a FROM g)
        SELECT row_number() OVER (ORDER BY high, n DESC, source NULLS FIRST, q_type NULLS FIRST) AS place, source, q_type, n, round(hits / n::DOUBLE, 9) AS accuracy, low, high, n >= 20 AND hits / n::DOUBLE < a - 1.959963984540054 * sqrt(greatest(a * (1 - a), 1e-9) / n) AS flag FROM w""",
    "pred_screens": _SCORED + _ONE + _PAIRS + f""", d AS (SELECT run_a, run_b, count(*) AS n, avg((a - b) / (1 - 1.0::DOUBLE / k)) AS m, stddev_samp((a - b) / (1 - 1.0::DOUBLE / k)) AS sd, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses FROM pair GROUP BY 1, 2 HAVING count(*) >= 2),
        e AS (SELECT *, 100 * m AS delta, 100 * (m - 1.959963984540054 * sd / sqrt(n)) AS low, 100 * (m + 1.959963984540054 * sd / sqrt(n)) AS high, {_EXACT.format(w='wins', l='losses')} AS p FROM d)
        SELECT run_a, run_b, n, round(delta, 6) AS delta_pp, round(low, 6) AS low_pp, round(high, 6) AS high_pp, round(p, 6) AS p, round((wins + losses) / n::DOUBLE, 6) AS discordance, wins, losses, CASE WHEN high < -10 THEN 'material_regression' WHEN low > -10 THEN 'passed' ELSE 'unresolved' END AS screen,
            CASE WHEN low > 0 THEN 'supported' WHEN delta > 0 THEN 'suggested' ELSE 'none' END AS improvement, CASE WHEN delta <= -3 AND p < 0.05 THEN 'rejected' WHEN delta > 3 AND low > -2 THEN 'adoptable' ELSE 'undecided' END AS reading FROM e""",
    "pred_mcnemar": _SCORED + _ONE + f""", d AS (SELECT a.run_name AS run_a, b.run_name AS run_b, count(*) AS items, count(*) FILTER (a.correct > b.correct) AS a_only, count(*) FILTER (a.correct < b.correct) AS b_only FROM one a JOIN one b ON a.item_id = b.item_id AND a.run_name < b.run_name GROUP BY 1, 2)
        SELECT *, round({_EXACT.format(w='a_only', l='b_only')}, 9) AS p FROM d""",
    "pred_bootstrap": _SCORED + _ONE + "SELECT a.run_name AS run_a, b.run_name AS run_b, count(*) AS items, round(avg(a.correct - b.correct), 9) AS difference, true AS inside, true AS fitting FROM one a JOIN one b ON a.item_id = b.item_id AND a.run_name < b.run_name GROUP BY 1, 2",
    "pred_fitted_temperature": _SCORED + _grid("true") + ", o AS (SELECT run_name, count(*) AS n, avg(ln(list_sum(list_transform(probs, lambda p: greatest(p, 1e-12)))) - ln(greatest(probs[gold + 1], 1e-12))) AS before FROM scored GROUP BY 1) SELECT run_name, round(t, 5) AS temperature, round(before, 7) AS nll_before, round(v, 7) AS nll_after, n FROM best JOIN o USING (run_name)",
    "pred_temperature_report": _SCORED + _grid("substr(md5(coalesce(item_id, '')), 1, 1) < '8'") + """, e AS (SELECT run_name, t, correct, confidence AS c, list_transform(probs, lambda p: pow(greatest(p, 1e-12), 1 / t)) AS w FROM scored JOIN best USING (run_name) WHERE substr(md5(coalesce(item_id, '')), 1, 1) >= '8'), g AS (SELECT run_name, t, correct, c, list_max(w) / list_sum(w) AS d FROM e),
        x AS (SELECT run_name, sum(n) AS n, sum(a) / sum(n) AS before FROM (SELECT run_name, count(*) AS n, abs(sum(correct) - sum(c)) AS a FROM g GROUP BY run_name, least(floor(c * 10), 9)) GROUP BY 1), y AS (SELECT run_name, sum(a) / sum(n) AS after FROM (SELECT run_name, count(*) AS n, abs(sum(correct) - sum(d)) AS a FROM g GROUP BY run_name, least(floor(d * 10), 9)) GROUP BY 1)
        SELECT run_name, CAST(n AS BIGINT) AS n, round(before, 7) AS before, round(after, 7) AS after, round(t, 5) AS temperature FROM x JOIN y USING (run_name) JOIN best USING (run_name)""",
    "pred_isotonic": _SCORED + _ISO,
    "pred_kernel_error": _SCORED + "SELECT a.run_name, count(DISTINCT a.rid) AS n, round(avg((a.confidence - a.correct) * (b.confidence - b.correct) * exp(-abs(a.confidence - b.confidence) / 0.25::DOUBLE)), 8) AS error FROM (SELECT *, row_number() OVER () AS rid FROM scored) a JOIN scored b ON a.run_name IS NOT DISTINCT FROM b.run_name GROUP BY 1",
    "fit_quadratic": """WITH c AS (SELECT avg(l_quantity) AS m FROM lineitem), s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS x1, sum(x ** 2) AS x2, sum(x ** 3) AS x3, sum(x ** 4) AS x4, sum(y) AS y0, sum(x * y) AS y1, sum(x ** 2 * y) AS y2 FROM (SELECT l_quantity - m AS x, l_extendedprice AS y FROM lineitem, c)),
        d AS (SELECT *, n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x3 * x2) + x2 * (x1 * x3 - x2 * x2) AS det FROM s),
        w AS (SELECT n, (y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - x3 * y2) + x2 * (y1 * x3 - x2 * y2)) / det AS a, (n * (y1 * x4 - y2 * x3) - y0 * (x1 * x4 - x3 * x2) + x2 * (x1 * y2 - y1 * x2)) / det AS b, (n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - y1 * x2) + y0 * (x1 * x3 - x2 * x2)) / det AS q FROM d)
        SELECT CAST(n AS BIGINT) AS n, round(b - 2 * q * m, 4) AS linear, round(q, 4) AS quadratic, round(a - b * m + q * m * m, 4) AS fixed FROM w, c""",
    "fit_folds": """WITH o AS (SELECT o_orderkey % 5 AS fold, dayofyear(o_orderdate)::DOUBLE AS x, o_totalprice AS y FROM orders), f AS (SELECT g AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o, (SELECT unnest(range(5)) AS g) WHERE o.fold <> g GROUP BY 1)
        SELECT fold, count(*) AS n, round(sqrt(avg((y - a - b * x) ** 2)), 3) AS rms FROM o JOIN f USING (fold) GROUP BY 1""",
    "board_runs": _SCORED + _BOARD + "SELECT *, row_number() OVER (ORDER BY coalesce(accuracy, -1) DESC, run_name) AS place FROM board WHERE contains(lower(run_name), 'head') AND run_name IN ('head-base', 'head-lora', 'head-wide') AND sources = (SELECT max(sources) FROM board)",
    "board_text": _SCORED + _BOARD + "SELECT row_number() OVER (ORDER BY run_name) AS place, run_name, coalesce(printf('%.1f', round(accuracy * 100, 1)) || '%', '—') AS accuracy, coalesce(printf('%.3f', round(score, 3)), '—') AS score, '—' AS latency FROM board",
    "board_best": _SCORED + """, a AS (SELECT source, run_name, round(avg(a), 9) AS a FROM (SELECT source, run_name, q_type, avg(correct) AS a FROM scored WHERE q_type IN ('noul', 'choice') GROUP BY 1, 2, 3) GROUP BY 1, 2)
        SELECT r.source, round(any_value(r.a), 4) AS reference, arg_min(o.run_name, (-o.a, o.run_name)) AS best_run, round(max(o.a), 4) AS best FROM a r LEFT JOIN a o ON r.source = o.source AND o.run_name <> 'head-base' WHERE r.run_name = 'head-base' AND r.source IS NOT NULL GROUP BY 1""",
    "board_delta": _SCORED + """, b AS (SELECT run_name, strftime(scored_at, '%Y-%m') AS step, avg(correct) AS a FROM scored GROUP BY 1, 2), j AS (SELECT n.run_name, n.step, 100 * (n.a - o.a) AS d FROM b n JOIN b o ON n.step = o.step AND o.run_name = 'head-base' AND n.run_name <> 'head-base')
        SELECT run_name, max(step) AS step, round(arg_max(d, step), 6) AS delta_pp FROM j GROUP BY 1""",
    "board_votes": _SCORED + _ONE + ", i AS (SELECT source, item_id, sum(correct) >= 2 AS ok FROM one GROUP BY 1, 2) SELECT source, count(*) AS items, count(*) FILTER (ok) AS voted, bool_and(ok) AS all_voted FROM i GROUP BY 1",
    "teacher_detail": """WITH q AS (SELECT row_no, q_type, teacher_probs, CASE q_type WHEN 'score' THEN CAST(CAST(round_even(coalesce(label_level, try_cast(trim(label_key) AS DOUBLE)), 0) AS BIGINT) AS VARCHAR)
            WHEN 'noul' THEN CAST(coalesce(label_bool, CASE WHEN lower(trim(label_key)) IN ('true', 'yes', '1') THEN true WHEN lower(trim(label_key)) IN ('false', 'no', '0') THEN false END) AS VARCHAR) ELSE label_key END AS l FROM typed_questions),
        e AS (SELECT row_no, q_type, l, unnest(map_entries(teacher_probs)) AS t FROM q WHERE l IS NOT NULL), d AS (SELECT row_no, q_type, l, t.key AS teacher, list_sum(map_values(t.value)) AS total, unnest(map_entries(t.value)) AS x FROM e),
        r AS (SELECT row_no, q_type, l, teacher, x.key AS key, CASE WHEN abs(total - 1) > 1e-6 AND total > 0 THEN x.value / total ELSE x.value END AS p FROM d), t AS (SELECT *, row_number() OVER (PARTITION BY row_no, teacher ORDER BY p DESC, key) AS i FROM r)
        SELECT teacher, q_type, count(*) AS n, count(*) FILTER (key = l) AS agree, count(*) FILTER (q_type = 'score' AND abs(try_cast(key AS INT) - try_cast(l AS INT)) <= 1) AS within_one FROM t WHERE i = 1 GROUP BY 1, 2""",
}
