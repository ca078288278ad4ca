"""Metrics of calibrated predictions.

A prediction has q_type, label_bool / label_key / label_level, probs, option_keys and what it is grouped by. scored() adds what all
metrics read; a row without usable probabilities or without a gold option among its keys is left out of them, as unusable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators.running import running_sums


def gold_index() -> Column:
    """Index from 0 of the gold option; null if there is none. Fractional levels round half to even."""
    noul = F.coalesce(F.col("label_bool"), F.when(F.lower(F.trim("label_key")).isin("true", "yes", "1"), True).when(F.lower(F.trim("label_key")).isin("false", "no", "0"), False))
    key = F.when(F.col("q_type") == "choice", F.col("label_key")).when(F.col("q_type") == "score", F.bround(F.col("label_level"), 0).cast("bigint").cast("string"))
    return F.when(F.col("q_type") == "noul", noul.cast("int")).otherwise(F.nullif(F.array_position("option_keys", key), F.lit(0)) - 1).cast("int")


def scored(df: DataFrame) -> DataFrame:
    """Usable predictions with k (options), gold, pred, confidence, correct and brier (binary for noul, else of the whole vector)."""
    usable = df.withColumn("gold", gold_index()).where("gold IS NOT NULL AND probs IS NOT NULL AND size(probs) = size(option_keys) AND gold < size(probs) AND NOT exists(probs, p -> p IS NULL)")
    probs = F.col("probs")
    return usable.withColumns({
        "k": F.size(probs),
        "pred": C.argmax(probs),
        "confidence": F.array_max(probs),
        "brier": F.when(F.col("q_type") == "noul", F.pow(F.element_at(probs, 2) - F.col("gold"), F.lit(2.0))).otherwise(C.multiclass_brier(probs, F.col("gold"))),
    }).withColumn("correct", (F.col("pred") == F.col("gold")).cast("int"))


def accuracy_by_type(s: DataFrame) -> DataFrame:
    """Accuracy of noul (strictly above one half) and choice, mean absolute error of the expected level of score."""
    value = (
        F.when(F.col("q_type") == "noul", ((F.element_at("probs", 2) > 0.5).cast("int") == F.col("gold")).cast("double"))
        .when(F.col("q_type") == "choice", F.col("correct").cast("double"))
        .otherwise(F.abs(C.expected_level(F.col("probs")) - F.col("label_level")))
    )
    return s.groupBy("q_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 9).alias("value"))


def ece_table(s: DataFrame, group: list[str], bins: int = 10) -> DataFrame:
    """Non-empty bins of confidence, equal width, the last closed: rows, mean confidence, accuracy."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return s.groupBy(*group, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("correct").alias("accuracy"))


def ece(s: DataFrame, group: list[str], bins: int = 10) -> DataFrame:
    gap = F.sum(F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")) / F.sum("n")
    return ece_table(s, group, bins).groupBy(*group).agg(F.sum("n").alias("n"), F.round(gap, 9).alias("ece"))


def summary(s: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, accuracy, Brier and mean confidence overall and by each key alone (grouping sets), ordinal metrics over score rows."""
    score = F.col("q_type") == "score"
    sets = ", ".join(["()", *(f"({k})" for k in keys)])
    view = s.select(
        *keys, "correct", "brier", "confidence",
        F.when(score, C.rps(F.col("probs"), F.col("gold"))).alias("rps"),
        F.when(score, F.abs(C.expected_level(F.col("probs")) - F.col("label_level"))).alias("mae"),
    )
    names = ", ".join(f"'{k}'" for k in keys)
    return view.sparkSession.sql(
        f"""SELECT element_at(array('all', {names}), cast(1 + {" + ".join(f"(1 - grouping({k})) * {i + 1}" for i, k in enumerate(keys))} AS int)) AS level,
            coalesce({", ".join(f"cast({k} AS string)" for k in keys)}) AS value, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(brier), 9) AS brier,
            round(avg(confidence), 9) AS mean_confidence, round(avg(rps), 9) AS rps, round(avg(mae), 9) AS mae
            FROM {{view}} GROUP BY GROUPING SETS ({sets})""",
        view=view,
    )


def brier_skill(s: DataFrame, group: list[str]) -> DataFrame:
    """Skill against the marginal of labels inside each group: of noul, of score levels and of choice keys, restricted to a row's options."""
    gold_key = F.element_at("option_keys", F.col("gold") + 1)
    mark = F.when(F.col("q_type") == "choice", gold_key).otherwise(F.col("gold").cast("string"))
    marginal = s.groupBy(*group, "q_type", mark.alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    rows = s.withColumn("_row", F.monotonically_increasing_id())
    options = rows.select(*group, "q_type", "_row", "gold", F.posexplode("option_keys").alias("i", "key")).withColumn("mark", F.when(F.col("q_type") == "choice", F.col("key")).otherwise(F.col("i").cast("string")))
    weighed = options.join(marginal, [*group, "q_type", "mark"], "left").select("_row", *group, "q_type", "gold", "i", F.coalesce("n", F.lit(0)).alias("w"))
    per_row = weighed.groupBy("_row", *group, "q_type").agg(
        F.sum("w").alias("all"), F.count(F.lit(1)).alias("k"), F.sum(F.col("w") * F.col("w")).alias("squares"), F.max(F.when(F.col("i") == F.col("gold"), F.col("w"))).alias("gold_w")
    )
    # sum over options of (w/all - [gold])^2, for noul the second option's term only, which is half of it
    full = F.when(F.col("all") > 0, F.col("squares") / F.col("all") / F.col("all") - 2 * F.col("gold_w") / F.col("all") + 1).otherwise(1 - 1 / F.col("k"))
    reference = per_row.select(*group, F.when(F.col("q_type") == "noul", full / 2).otherwise(full).alias("reference"))
    ref = reference.groupBy(*group).agg(F.avg("reference").alias("reference"))
    return s.groupBy(*group).agg(F.avg("brier").alias("brier")).join(ref, group).select(*group, F.round("brier", 9).alias("brier"), F.round("reference", 9).alias("reference"), F.round(C.skill(F.col("brier"), F.col("reference")), 9).alias("skill"))


def quadratic_kappa(s: DataFrame, group: list[str], none: float | None = None) -> DataFrame:
    """Quadratic weighted kappa of score rows; none (null by default, 0 if so wanted) where the expected disagreement is 0."""
    pairs = s.where("q_type = 'score'").groupBy(*group, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    gold = pairs.groupBy(*group, F.col("gold").alias("g")).agg(F.sum("n").alias("ng"))
    pred = pairs.groupBy(*group, F.col("pred").alias("p")).agg(F.sum("n").alias("np"))
    n = pairs.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("gold") - F.col("pred"), F.lit(2.0))).alias("seen"))
    chance = gold.join(pred, group).groupBy(*group).agg(F.sum(F.col("ng") * F.col("np") * F.pow(F.col("g") - F.col("p"), F.lit(2.0))).alias("chance"))  # levels by levels
    return n.join(chance, group).select(*group, "n", F.round(F.when(F.col("chance") > 0, 1 - F.col("seen") * F.col("n") / F.col("chance")).otherwise(none), 9).alias("qwk"))


def chance_corrected(s: DataFrame, group: list[str]) -> DataFrame:
    """By number of options, two or more: rows, correct, chance, and accuracy with chance taken off."""
    by = s.where("k >= 2").groupBy(*group, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("hits"))
    chance = 1 / F.col("k")
    return by.select(*group, "k", "n", "hits", F.round(chance, 9).alias("chance"), F.round((F.col("hits") / F.col("n") - chance) / (1 - chance), 9).alias("corrected"))


def wilson_breakdown(s: DataFrame) -> DataFrame:
    """Accuracy with Wilson bounds overall, by type, by source and by both."""
    by = s.rollup("source", "q_type").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("hits"), F.grouping_id().alias("level"))
    types = s.groupBy("q_type").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("hits")).select(F.lit(None).cast("string").alias("source"), "q_type", "n", "hits", F.lit(2).cast("bigint").alias("level"))
    every = by.select("source", "q_type", "n", "hits", "level").unionByName(types)
    bounds = C.wilson(F.col("hits"), F.col("n"))
    return every.select("level", "source", "q_type", "n", "hits", F.round(bounds["low"], 9).alias("low"), F.round(bounds["high"], 9).alias("high"))


COVERAGES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def risk_coverage(s: DataFrame, group: list[str], ties: list[str]) -> DataFrame:
    """Risk among the most confident ceil(coverage * n) rows of each group. ties: columns that decide equal confidence."""
    ordered = running_sums(s.select(*group, *ties, "confidence", "correct"), group, [F.desc("confidence"), *ties], {"hits": "correct"})
    n = s.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    points = n.select(*group, "total", F.explode(F.array(*map(F.lit, COVERAGES))).alias("coverage")).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("coverage") * F.col("total"))))
    return ordered.join(points, [*group, "_n"]).select(*group, "coverage", F.col("_n").alias("n"), F.round(1 - F.col("hits") / F.col("_n"), 9).alias("risk"))


def aurc(s: DataFrame, group: list[str], ties: list[str]) -> DataFrame:
    """Mean of the running risk in order of confidence."""
    ordered = running_sums(s.select(*group, *ties, "confidence", "correct"), group, [F.desc("confidence"), *ties], {"hits": "correct"})
    return ordered.groupBy(*group).agg(F.round(F.avg(1 - F.col("hits") / F.col("_n")), 9).alias("aurc"))


def auroc(s: DataFrame, group: list[str]) -> DataFrame:
    """Chance that a correct row is more confident than a wrong one, ties counting half; null without both kinds.

    Rows are reduced to distinct confidences first; those are summed up in range partitions.
    """
    by = s.groupBy(*group, "confidence").agg(F.sum("correct").alias("pos"), F.sum(1 - F.col("correct")).alias("neg"))
    ordered = running_sums(by, group, [F.col("confidence")], {"neg_to": "neg"})
    wins = F.sum(F.col("pos") * (F.col("neg_to") - F.col("neg") + 0.5 * F.col("neg")))
    pairs = F.sum("pos") * F.sum("neg")
    return ordered.groupBy(*group).agg(F.round(F.when(pairs > 0, wins / pairs), 9).alias("auroc"))


def topm_recall(s: DataFrame, group: list[str], most: int = 5) -> DataFrame:
    """Share of rows whose gold is among the m most probable, ties counting against it, with its standard error and how many rows have more than m options."""
    ranked = s.withColumn("rank", C.gold_rank(F.col("probs"), F.col("gold"))).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(most))))
    share = F.avg((F.col("rank") <= F.col("m")).cast("double"))
    return ranked.groupBy(*group, "m").agg(
        F.count(F.lit(1)).alias("n"), F.round(share, 9).alias("recall"), F.round(F.sqrt(share * (1 - share) / F.count(F.lit(1))), 9).alias("error"), F.sum((F.col("k") > F.col("m")).cast("int")).alias("informative")
    )


def log_spaced(low: float, high: float, steps: int) -> list[float]:
    """Numbers evenly spaced in logarithm, and 1."""
    return sorted({*(low * (high / low) ** (i / (steps - 1)) for i in range(steps)), 1.0})


def temperature_curve(s: DataFrame, group: list[str], temperatures: list[float], bins: int = 10) -> DataFrame:
    """Mean negative log likelihood, mean confidence and calibration error when log probabilities are divided by each temperature. The answers don't change, so neither does what is correct."""
    grid = s.select(*group, "gold", "correct", "probs", F.explode(F.array(*map(F.lit, temperatures))).alias("temperature"))
    scaled = F.transform("probs", lambda p: F.ln(F.greatest(p, F.lit(1e-12))) / F.col("temperature"))
    top = F.array_max("scaled")
    norm = F.ln(C.total(F.transform("scaled", lambda x: F.exp(x - top)))) + top
    rows = grid.withColumn("scaled", scaled).withColumns({"nll": norm - F.element_at("scaled", F.col("gold") + 1), "conf": F.exp(top - norm)})
    by_bin = rows.groupBy(*group, "temperature", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("nll", "conf", "correct")))
    gap = F.sum(F.abs(F.col("correct") - F.col("conf"))) / F.sum("n")
    return by_bin.groupBy(*group, "temperature").agg(F.round(F.sum("nll") / F.sum("n"), 9).alias("nll"), F.round(F.sum("conf") / F.sum("n"), 9).alias("confidence"), F.round(gap, 9).alias("ece"))


def best_temperature(curve: DataFrame, group: list[str]) -> DataFrame:
    """The temperature with the least likelihood loss, and the one with the least calibration error; ties to the lower."""
    return curve.groupBy(*group).agg(F.min_by("temperature", F.struct("nll", "temperature")).alias("temperature"), F.min("nll").alias("nll"), F.min_by("temperature", F.struct("ece", "temperature")).alias("ece_temperature"), F.min("ece").alias("ece"))


def cascade_sweep(s: DataFrame, group: list[str], thresholds: list[float]) -> DataFrame:
    """At each threshold of the margin between the top two: share sent on, and accuracy of those kept."""
    rows = s.withColumn("margin", C.margin(F.col("probs"))).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    sent = F.col("margin") < F.col("threshold")
    return rows.groupBy(*group, "threshold").agg(F.count(F.lit(1)).alias("n"), F.sum(sent.cast("int")).alias("sent"), F.round(F.avg(F.when(~sent, F.col("correct"))), 9).alias("kept_accuracy"))


def best_threshold(sweep: DataFrame, group: list[str]) -> DataFrame:
    """The threshold with the best accuracy of what is kept; ties to the largest."""
    return sweep.where("kept_accuracy IS NOT NULL").groupBy(*group).agg(F.max_by("threshold", F.struct("kept_accuracy", "threshold")).alias("threshold"), F.max("kept_accuracy").alias("kept_accuracy"))


def one_per_item(s: DataFrame) -> DataFrame:
    """Of several predictions of an item by one run, the earliest; of those the least probabilities."""
    w = Window.partitionBy("item_id", "run_name").orderBy("scored_at", "probs")
    return s.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def discordance(s: DataFrame) -> DataFrame:
    """Runs two by two over the items that both have: items, wins of either, difference and its standard error."""
    one = one_per_item(s).select("item_id", "run_name", "correct")
    a, b = (one.select("item_id", F.col("run_name").alias(f"run_{x}"), F.col("correct").alias(f"correct_{x}")) for x in "ab")
    d = F.col("correct_a") - F.col("correct_b")
    return (
        a.join(b, "item_id").where("run_a < run_b").groupBy("run_a", "run_b")
        .agg(F.count(F.lit(1)).alias("items"), F.sum((d > 0).cast("int")).alias("a_only"), F.sum((d < 0).cast("int")).alias("b_only"), F.round(F.avg(d), 9).alias("difference"), F.round(F.stddev_samp(d) / F.sqrt(F.count(F.lit(1))), 9).alias("error"))
    )


def run_distance(s: DataFrame) -> DataFrame:
    """Runs two by two: share of items whose answer changes, mean and greatest total variation of their distributions by key."""
    one = one_per_item(s).select("item_id", "run_name", "probs", "option_keys", F.element_at("option_keys", F.col("pred") + 1).alias("answer"))
    one = one.where(F.size(F.array_distinct("option_keys")) == F.size("option_keys")).withColumn("dist", F.map_from_arrays("option_keys", "probs")).drop("probs", "option_keys")
    a, b = (one.select("item_id", *(F.col(c).alias(f"{c}_{x}") for c in ("run_name", "answer", "dist"))) for x in "ab")
    tv = C.total_variation(F.col("dist_a"), F.col("dist_b"))
    return (
        a.join(b, "item_id").where("run_name_a < run_name_b").groupBy(F.col("run_name_a").alias("run_a"), F.col("run_name_b").alias("run_b"))
        .agg(F.count(F.lit(1)).alias("items"), F.round(F.avg((F.col("answer_a") != F.col("answer_b")).cast("double")), 9).alias("changed"), F.round(F.avg(tv), 9).alias("mean_tv"), F.round(F.max(tv), 9).alias("max_tv"))
    )


def position_diagnostics(s: DataFrame, group: list[str]) -> DataFrame:
    """By fifth of the option list: how often gold lies there, how often the answer does, and accuracy of gold that lies there."""
    both = s.withColumns({"gold_part": C.position_bucket(F.col("gold"), F.col("k")), "pred_part": C.position_bucket(F.col("pred"), F.col("k"))})
    gold = both.groupBy(*group, F.col("gold_part").alias("part")).agg(F.count(F.lit(1)).alias("gold"), F.round(F.avg("correct"), 9).alias("accuracy"))
    pred = both.groupBy(*group, F.col("pred_part").alias("part")).agg(F.count(F.lit(1)).alias("answers"))
    return gold.join(pred, [*group, "part"], "full").select(*group, "part", F.coalesce("gold", F.lit(0)).alias("gold"), F.coalesce("answers", F.lit(0)).alias("answers"), "accuracy")


def floors(s: DataFrame, group: list[str]) -> DataFrame:
    """What needs no model: mean chance, and the share of the commonest gold option."""
    counts = s.groupBy(*group, "q_type", F.element_at("option_keys", F.col("gold") + 1).alias("gold_key")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("k")).alias("chance"))
    return counts.groupBy(*group, "q_type").agg(F.sum("n").alias("n"), F.round(F.sum("chance") / F.sum("n"), 9).alias("chance"), F.round(F.max("n") / F.sum("n"), 9).alias("majority"))


def tie_report(s: DataFrame, group: list[str]) -> DataFrame:
    return s.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(C.has_tie(F.col("probs")).cast("int")).alias("tied"), F.max(C.tie_count(F.col("probs"))).alias("most_tied"))


def confidence_relation(s: DataFrame, group: list[str]) -> DataFrame:
    """Pearson correlation of confidence and correctness, and the line fitted to it."""
    return s.groupBy(*group).agg(
        F.round(F.corr("confidence", "correct"), 6).alias("r"), F.round(F.regr_slope("correct", "confidence"), 6).alias("slope"),
        F.round(F.regr_intercept("correct", "confidence"), 6).alias("intercept"), F.round(F.regr_r2("correct", "confidence"), 6).alias("r2"),
    )


def bucket_metrics(s: DataFrame, group: list[str]) -> DataFrame:
    return s.groupBy(*group, C.k_bucket(F.col("k")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 9).alias("accuracy"), F.round(F.avg("brier"), 9).alias("brier"), F.round(F.avg(C.corrected_confidence(F.col("probs"))), 9).alias("corrected_confidence")
    )


def focal_loss(s: DataFrame, group: list[str], gamma: float = 2.0) -> DataFrame:
    """Mean focal loss and mean negative log likelihood of the gold option."""
    p = F.greatest(F.element_at("probs", F.col("gold") + 1), F.lit(1e-12))
    return s.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(1 - p, F.lit(gamma)) * -F.ln(p)), 9).alias("focal"), F.round(F.avg(-F.ln(p)), 9).alias("nll"))


def _two_runs(s: DataFrame, first: str, second: str) -> DataFrame:
    """Items that both runs answered with the same options in the same order."""
    one = one_per_item(s).select("item_id", "run_name", "gold", "k", "probs", "option_keys")
    a, b = (one.where(F.col("run_name") == run).select("item_id", F.col("gold").alias(f"gold_{x}"), "k", F.col("probs").alias(x), F.col("option_keys").alias(f"keys_{x}")) for run, x in ((first, "a"), (second, "b")))
    return a.join(b.drop("k"), "item_id").where("keys_a = keys_b AND gold_a = gold_b").withColumnRenamed("gold_a", "gold")


def blend_sweep(s: DataFrame, first: str, second: str, weights: list[float]) -> DataFrame:
    """Accuracy of first + weight * second by option bucket and weight, over items that both have."""
    rows = _two_runs(s, first, second).withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    blended = F.zip_with("a", "b", lambda x, y: x + F.col("weight") * y)
    return rows.groupBy(C.blend_bucket(F.col("k")).alias("bucket"), "weight").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((C.argmax(blended) == F.col("gold")).cast("double")), 9).alias("accuracy"))


def mixture(s: DataFrame, runs: list[str]) -> DataFrame:
    """Answers of the mean distribution of runs, per item that all of them have with the same options: item_id, answer, correct."""
    rows = one_per_item(s).where(F.col("run_name").isin(runs)).select("item_id", "run_name", "gold", "option_keys", F.posexplode("probs").alias("i", "p"))
    mean = rows.groupBy("item_id", "option_keys", "gold", "i").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("runs")).where(F.col("runs") == len(runs))
    top = mean.groupBy("item_id", "option_keys", "gold").agg(F.min_by("i", F.struct(-F.round("p", 12), F.col("i"))).alias("top"))
    return top.select("item_id", F.element_at("option_keys", F.col("top") + 1).alias("answer"), (F.col("top") == F.col("gold")).cast("int").alias("correct"))
