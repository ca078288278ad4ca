"""Reports over scored predictions: whole summaries, tables by tier, order and length effects, boards of runs, merged parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators import metrics as M
from sievework.operators.running import running_sums

_mean = lambda c: F.round(F.avg(c), 9)
_count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))


def full_summary(s: DataFrame, group: list[str]) -> DataFrame:
    """Rows, accuracy, calibration error, Brier score with its skill, mean confidence; over score rows kappa, ranked probability score and mean absolute error. Each is made by its own operator and joined by group."""
    score = F.col("q_type") == "score"
    base = s.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), _mean("correct").alias("accuracy"), _mean("confidence").alias("mean_confidence"), F.round(F.avg(F.when(score, C.rps(F.col("probs"), F.col("gold")))), 9).alias("rps"), F.round(F.avg(F.when(score, F.abs(C.expected_level(F.col("probs")) - F.col("label_level")))), 9).alias("mae")
    )
    return base.join(M.ece(s, group).select(*group, "ece"), group).join(M.brier_skill(s, group).select(*group, "brier", "skill"), group).join(M.quadratic_kappa(s, group).select(*group, "qwk"), group, "left")


def tier_cube(s: DataFrame, tier: str = "tier", kind: str = "q_type") -> DataFrame:
    """Correct rows, rows and accuracy over all, by tier, by type and by both: level (0 both, 1 tier, 2 type, 3 all), tier, q_type, correct, total, accuracy."""
    return s.cube(tier, kind).agg(F.grouping_id().alias("level"), F.sum("correct").alias("right"), F.count(F.lit(1)).alias("total")).select("level", tier, kind, F.col("right").alias("correct"), "total", F.round(F.col("right") / F.col("total"), 9).alias("accuracy"))


def rows(s: DataFrame) -> DataFrame:
    """One row a prediction: what was right, what was answered (ties to the least key), options, whether it is correct."""
    answer = C.argmax_by_key(F.col("probs"), F.col("option_keys"))
    return s.select("item_id", "run_name", "q_type", F.col("k").alias("n_options"), F.element_at("option_keys", F.col("gold") + 1).alias("gold"), F.element_at("option_keys", answer + 1).alias("predicted"), (answer == F.col("gold")).alias("right"))


def chance_mean(s: DataFrame, group: list[str]) -> DataFrame:
    """Mean over items of two options and more of (correct - 1/k) / (1 - 1/k), row by row and again from counts by k: both are equal."""
    one = (F.col("correct") - 1 / F.col("k")) / (1 - 1 / F.col("k"))
    parts = s.where("k >= 2").groupBy(*group, "k").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("hits"), F.sum(one).alias("sum"))
    again = F.sum((F.col("hits") - F.col("n") / F.col("k")) / (1 - 1 / F.col("k"))) / F.sum("n")
    return parts.groupBy(*group).agg(F.sum("n").alias("n"), F.round(F.sum("sum") / F.sum("n"), 9).alias("corrected"), F.round(again, 9).alias("from_counts"))


def by_map(s: DataFrame, mapping: DataFrame, key: str, name: str) -> DataFrame:
    """Rows, accuracy and Brier score by what a table (key, name) says of the key, "unassigned" where it says nothing. The table has a row a key."""
    return s.join(mapping.select(key, name), key, "left").groupBy(F.coalesce(name, F.lit("unassigned")).alias(name)).agg(F.count(F.lit(1)).alias("n"), _mean("correct").alias("accuracy"), _mean("brier").alias("brier"))


def order_positions(s: DataFrame, group: list[str]) -> DataFrame:
    """Mean probability at each place of the option list, and its distance from what the widest list would give by chance."""
    wide = s.groupBy(*group).agg(F.max("k").alias("most"))
    at = s.select(*group, F.posexplode("probs").alias("place", "p")).groupBy(*group, "place").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"))
    return at.join(wide, group).select(*group, "place", "n", F.round("mean", 9).alias("mean"), F.round(F.col("mean") - 1 / F.col("most"), 9).alias("delta"))


def order_flips(s: DataFrame) -> DataFrame:
    """By type, over items that several runs answered: items, those whose answer changes, and the mean over items of the most that an option's probability swings."""
    keyed = M.one_per_item(s).select("item_id", "q_type", "run_name", F.element_at("option_keys", F.col("pred") + 1).alias("answer"), F.posexplode("probs").alias("i", "p"), "option_keys")
    option = keyed.groupBy("item_id", "q_type", F.element_at("option_keys", F.col("i") + 1).alias("key")).agg((F.max("p") - F.min("p")).alias("swing"), F.count_distinct("run_name").alias("runs"), F.min("answer").alias("a"), F.max("answer").alias("b"))
    item = option.groupBy("item_id", "q_type").agg(F.max("swing").alias("swing"), F.max("runs").alias("runs"), (F.min("a") != F.max("b")).alias("flip")).where("runs > 1")
    return item.groupBy("q_type").agg(F.count(F.lit(1)).alias("items"), _count(F.col("flip")).alias("flipped"), _mean("swing").alias("swing"))


def related(df: DataFrame, group: list[str], x: Column, y: Column) -> DataFrame:
    """Pearson correlation of two numbers and its square, by group."""
    pairs = df.select(*group, x.cast("double").alias("x"), y.cast("double").alias("y"))
    return pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"), F.round(F.pow(F.corr("x", "y"), F.lit(2.0)), 6).alias("r2"))


def threshold_grid(s: DataFrame, group: list[str]) -> DataFrame:
    """Thresholds worth trying: the different margins, 0 and 1."""
    ends = s.select(*group).distinct().withColumn("threshold", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    return s.select(*group, C.margin(F.col("probs")).alias("threshold")).unionByName(ends).distinct()


def tier_discordance(s: DataFrame, tier: str = "tier") -> DataFrame:
    """By tier: items that every run has, those that some get right and others wrong, and their share."""
    one = M.one_per_item(s)
    runs = one.agg(F.count_distinct("run_name").alias("all_runs"))
    item = one.groupBy("item_id").agg(F.min(tier).alias(tier), F.count_distinct("run_name").alias("runs"), (F.min("correct") != F.max("correct")).alias("apart"))
    return item.crossJoin(runs).where("runs = all_runs").groupBy(tier).agg(F.count(F.lit(1)).alias("items"), _count(F.col("apart")).alias("discordant"), _mean(F.col("apart").cast("double")).alias("rate"))  # one row


def blocks_of(k: Column, size: int) -> Column:
    """Indexes 0 to k - 1 in consecutive blocks; the last may be short."""
    return F.transform(F.sequence(F.lit(0), F.floor((k - 1) / size).cast("int")), lambda b: F.sequence(b * size, F.least(b * size + size, k) - 1))


def position_bin(local: Column, width: Column) -> Column:
    """first or last fifth of a block, else middle."""
    return F.when(local < 0.2 * width, "first").when(local >= 0.8 * width, "last").otherwise("middle")


def block_decompose(s: DataFrame, group: list[str], size: int) -> DataFrame:
    """If options were asked in blocks: how often the gold wins its block, how often it is then right, and the product. Ties go to the earlier option."""
    start = (F.floor(F.col("gold") / size) * size).cast("int")
    block = F.slice("probs", start + 1, F.lit(size))
    won = (C.argmax(block) + start) == F.col("gold")
    out = s.select(*group, won.alias("won"), (won & (F.col("correct") == 1)).alias("both"), position_bin(F.col("gold") - start, F.size(block)).alias("bin"))
    n = out.groupBy(*group).agg(F.count(F.lit(1)).alias("items"), _count(F.col("won")).alias("won"), _count(F.col("both")).alias("both"), _count(F.col("bin") == "first").alias("gold_first"), _count(F.col("bin") == "last").alias("gold_last"))
    return n.select(*group, "items", "won", "gold_first", "gold_last", F.round(F.col("won") / F.col("items"), 9).alias("won_rate"), F.round(F.when(F.col("won") > 0, F.col("both") / F.col("won")).otherwise(0.0), 9).alias("right_given_won"), F.round(F.col("both") / F.col("items"), 9).alias("product"))


def order_effect(s: DataFrame, first: str, second: str) -> DataFrame:
    """Two presentations of the same items, by type: items, answers that change, accuracy of each, mean chance, and changes where neither has a tie."""
    one = M.one_per_item(s).select("item_id", "q_type", "run_name", "correct", "k", F.element_at("option_keys", F.col("pred") + 1).alias("answer"), C.has_tie(F.col("probs")).alias("tied"))
    a, b = (one.where(F.col("run_name") == r).select("item_id", *(["q_type", "k"] if x == "a" else []), *(F.col(c).alias(f"{c}_{x}") for c in ("correct", "answer", "tied"))) for r, x in ((first, "a"), (second, "b")))
    both = a.join(b, "item_id").withColumn("changed", F.col("answer_a") != F.col("answer_b"))
    return both.groupBy("q_type").agg(
        F.count(F.lit(1)).alias("items"), _mean(F.col("changed").cast("double")).alias("changed"), _mean("correct_a").alias("accuracy_a"), _mean("correct_b").alias("accuracy_b"), _mean(1 / F.col("k")).alias("chance"), _count(F.col("changed") & ~F.col("tied_a") & ~F.col("tied_b")).alias("changed_without_ties")
    )


def tie_places(s: DataFrame, group: list[str]) -> DataFrame:
    """By place of the option list: rows in which it shares the greatest probability with another."""
    tied = s.where(C.has_tie(F.col("probs"))).select(*group, F.array_max("probs").alias("top"), F.posexplode("probs").alias("place", "p"))
    return tied.where("p = top").groupBy(*group, "place").agg(F.count(F.lit(1)).alias("ties"))


def length_guard(s: DataFrame, questions: DataFrame) -> DataFrame:
    """Whether a run just picks the longest option, over choice rows whose options the question has: by run: items, accuracy of picking the longest (ties to the earlier), of the run, and how often both pick the same. questions: item_id, keys, texts, a row an item."""
    joined = s.where("q_type = 'choice'").join(questions, "item_id").where("keys = option_keys AND NOT exists(texts, t -> t IS NULL)")
    longest = C.argmax(F.transform("texts", lambda t: F.length(t).cast("double")))
    return joined.withColumn("longest", longest).groupBy("run_name").agg(F.count(F.lit(1)).alias("items"), _mean((F.col("longest") == F.col("gold")).cast("double")).alias("longest_accuracy"), _mean("correct").alias("accuracy"), _mean((F.col("longest") == F.col("pred")).cast("double")).alias("agreement"))


def latency(df: DataFrame, group: list[str], seconds: str) -> DataFrame:
    """Median, 95th percentile (the value at rank round(0.95 n)) and mean in milliseconds, and items a second. Order statistics come from counts of values, ranked over range partitions."""
    hist = df.where(F.col(seconds).isNotNull()).groupBy(*group, F.col(seconds).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(hist, group, [F.col("v")], {"upto": "n"}).drop("_n")
    total = hist.groupBy(*group).agg(F.sum("n").alias("total"), F.sum(F.col("v") * F.col("n")).alias("sum"))
    joined = ranked.join(total, group)
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)
    mean = 1000 * F.first("sum") / F.first("total")
    return joined.groupBy(*group).agg(
        F.first("total").alias("n"), F.round(500 * (at(low) + at(high)), 6).alias("median_ms"), F.round(1000 * at(F.greatest(F.lit(1), F.bround(0.95 * F.col("total"), 0))), 6).alias("p95_ms"), F.round(mean, 6).alias("mean_ms"), F.round(F.when(mean > 0, 1000 / mean), 6).alias("items_per_s")
    )


def spread(s: DataFrame) -> DataFrame:
    """One scale for each run: the median of its positive margins, 1 if there are none."""
    m = s.withColumn("m", C.margin(F.col("probs")))
    return m.groupBy("run_name").agg(F.coalesce(F.median(F.when(F.col("m") > 0, F.col("m"))), F.lit(1.0)).alias("scale"))


def scaled_blend(s: DataFrame, first: str, second: str, weights: list[float], long: int = 5) -> DataFrame:
    """Accuracy of first / its scale + weight * second / its scale over items that both have, and the same where only lists of `long` options and more are blended; beside mean chance."""
    scales = {r.run_name: r.scale for r in spread(s.where(F.col("run_name").isin(first, second))).toLocalIterator()}
    pairs = M._two_runs(s, first, second).withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    blended = lambda w: F.zip_with("a", "b", lambda x, y: x / scales.get(first, 1.0) + w * y / scales.get(second, 1.0))
    right = lambda w: _mean((C.argmax(blended(w)) == F.col("gold")).cast("double"))
    return pairs.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), right(F.col("weight")).alias("accuracy"), right(F.when(F.col("k") >= long, F.col("weight")).otherwise(0.0)).alias("long_only"), _mean(1 / F.col("k")).alias("chance"))


def type_metrics(s: DataFrame, group: list[str]) -> DataFrame:
    """By group and type: rows, accuracy with ties to the least key, calibration error, Brier score, ties, rows whose keys repeat."""
    by = [*group, "q_type"]
    stable = C.argmax_by_key(F.col("probs"), F.col("option_keys"))
    base = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _mean((stable == F.col("gold")).cast("double")).alias("accuracy"), _mean("brier").alias("brier"), _count(C.has_tie(F.col("probs"))).alias("tied"), _count(F.size(F.array_distinct("option_keys")) < F.size("option_keys")).alias("repeated"))
    return base.join(M.ece(s, by).select(*by, "ece"), by)


def score_target(label: Column, n: Column) -> Column:
    """What a level says about n levels: all on it, or shared by the two it lies between."""
    held = F.least((n - 1).cast("double"), F.greatest(F.lit(0.0), label))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(0.0), 1 - F.abs(held - i)))


def score_metrics(s: DataFrame, group: list[str], least: int = 30) -> DataFrame:
    """Over score rows: mean absolute error, ranked probability score against targets shared between levels, and kappa averaged over scales (numbers of levels) of at least so many rows, 0 without one; scales left out."""
    rows_ = s.where("q_type = 'score' AND label_level IS NOT NULL").withColumn("target", score_target(F.col("label_level"), F.col("k")))
    gaps = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.pow(C.total(F.slice("probs", F.lit(1), i)) - C.total(F.slice("target", F.lit(1), i)), F.lit(2.0)))
    rps = F.when(F.col("k") > 1, C.total(gaps) / (F.col("k") - 1)).otherwise(0.0)
    base = rows_.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), _mean(F.abs(C.expected_level(F.col("probs")) - F.col("label_level"))).alias("mae"), _mean(rps).alias("rps"))
    scales = M.quadratic_kappa(rows_, [*group, "k"], 0.0).withColumn("enough", F.col("n") >= least)
    mixed = scales.groupBy(*group).agg(F.round(F.coalesce(F.sum(F.when(F.col("enough"), F.col("qwk") * F.col("n"))) / F.sum(F.when(F.col("enough"), F.col("n"))), F.lit(0.0)), 6).alias("qwk"), _count(~F.col("enough")).alias("scales_left_out"))
    return base.join(mixed, group)


def nested_accuracy(s: DataFrame, sizes: tuple[int, ...], seed: int) -> DataFrame:
    """Accuracy if only the gold and the first others in an order drawn by hash had been options, by size, over rows with more options: run_name, size, n, accuracy. A tie counts as wrong."""
    others = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda i: i != F.col("gold")), lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), "item_id", F.element_at("option_keys", i + 1))).alias("d"), F.element_at("probs", i + 1).alias("p"))))
    each = s.where("q_type = 'choice'").select("run_name", "k", F.element_at("probs", F.col("gold") + 1).alias("mine"), others.alias("others")).select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where("k > size")
    best = F.array_max(F.transform(F.slice("others", F.lit(1), F.col("size") - 1), lambda e: e["p"]))
    return each.groupBy("run_name", "size").agg(F.count(F.lit(1)).alias("n"), _mean((F.col("mine") > best).cast("double")).alias("accuracy"))


def answered(s: DataFrame, thresholds: list[float]) -> DataFrame:
    """At each threshold of confidence, by run: rows answered, their share, and their accuracy (null for none)."""
    each = s.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    yes = F.col("confidence") >= F.col("threshold")
    return each.groupBy("run_name", "threshold").agg(_count(yes).alias("answered"), _mean(yes.cast("double")).alias("rate"), F.round(F.avg(F.when(yes, F.col("correct"))), 9).alias("accuracy"))


def recall_by_reason(s: DataFrame, reasons: DataFrame, coverage: float, ties: list[str]) -> DataFrame:
    """Of each reason for withholding an answer, how many rows fall below the confidence that keeps the given share of all rows: reason, n, below, recall. reasons: item_id, reason, a row an item; rows without one have the reason none."""
    rows_ = s.join(reasons, "item_id", "left").withColumn("reason", F.coalesce("reason", F.lit("none"))).select("reason", "confidence", *ties)
    n = rows_.agg(F.ceil(F.count(F.lit(1)) * coverage).alias("kept"))
    ranked = running_sums(rows_, [], [F.desc("confidence"), *ties], {}).crossJoin(n)  # one row
    return ranked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), _count(F.col("_n") > F.col("kept")).alias("below"), _mean((F.col("_n") > F.col("kept")).cast("double")).alias("recall"))


def fixes(s: DataFrame, base: str) -> DataFrame:
    """Against a base run, by run and type: items that both have, those that the run puts right, and those that it breaks."""
    one = M.one_per_item(s).select("item_id", "run_name", "q_type", "correct")
    old = one.where(F.col("run_name") == base).select("item_id", F.col("correct").alias("before"))
    return one.where(F.col("run_name") != base).join(old, "item_id").groupBy("run_name", "q_type").agg(F.count(F.lit(1)).alias("items"), _count((F.col("before") == 0) & (F.col("correct") == 1)).alias("fixed"), _count((F.col("before") == 1) & (F.col("correct") == 0)).alias("broken"))


def merged(parts: DataFrame, keys: list[str], means: list[str], n: str = "n") -> DataFrame:
    """Partial means merged by their rows: keys, n, the means."""
    return parts.groupBy(*keys).agg(F.sum(n).alias(n), *(F.round(F.sum(F.col(m) * F.col(n)) / F.sum(n), 9).alias(m) for m in means))


def flagged_breakdown(s: DataFrame, z: float = 1.959963984540054, least: int = 20) -> DataFrame:
    """By source and type, the lowest upper Wilson bound first: place, source, q_type, n, accuracy, low, high, flag (at least so many rows, and an accuracy more than z standard errors below that of all rows)."""
    cells = s.groupBy("source", "q_type").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("hits"))
    whole = cells.agg((F.sum("hits") / F.sum("n")).alias("all"))
    bounds = C.wilson(F.col("hits"), F.col("n"), z)
    made = cells.crossJoin(whole).withColumns({"accuracy": F.col("hits") / F.col("n"), "low": F.round(bounds["low"], 9), "high": F.round(bounds["high"], 9)})  # one row
    flag = (F.col("n") >= least) & (F.col("accuracy") < F.col("all") - z * F.sqrt(F.greatest(F.col("all") * (1 - F.col("all")), F.lit(1e-9)) / F.col("n")))
    w = Window.orderBy("high", F.desc("n"), "source", "q_type")  # sources by types
    return made.select(F.row_number().over(w).alias("place"), "source", "q_type", "n", F.round("accuracy", 9).alias("accuracy"), "low", "high", flag.alias("flag"))


def board(s: DataFrame) -> DataFrame:
    """A row a run: accuracy over noul and choice rows (mean of the two), by tier and by type, how many sources it has, how often it beats and loses to the mean of the other runs on a source.

    Runs, tiers and sources are few.
    """
    runs = s.groupBy("run_name").agg(
        F.count_distinct("source").alias("sources"), *(F.round(F.avg(F.when(F.col("tier") == t, F.col("correct"))), 9).alias(t) for t in ("easy", "hard", "original")), *(F.round(F.avg(F.when(F.col("q_type") == t, F.col("correct"))), 9).alias(t) for t in ("noul", "choice", "score"))
    )
    by = s.groupBy("run_name", "source").agg(F.avg("correct").alias("a"))
    w = Window.partitionBy("source")
    against = by.withColumns({"all": F.sum("a").over(w), "m": F.count(F.lit(1)).over(w)}).where("m > 1").withColumn("other", (F.col("all") - F.col("a")) / (F.col("m") - 1))
    wins = against.groupBy("run_name").agg(_count(F.col("a") > F.col("other") + 1e-12).alias("wins"), _count(F.col("a") < F.col("other") - 1e-12).alias("losses"))
    both = F.array_compact(F.array("noul", "choice"))
    mean = F.when(F.size(both) > 0, C.total(both) / F.size(both))
    return runs.join(wins, "run_name", "left").select("run_name", F.round(mean, 9).alias("accuracy"), "sources", "easy", "hard", "original", "noul", "choice", "score", F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("losses", F.lit(0)).alias("losses"))


def filtered_board(board_: DataFrame, words: str = "", runs: tuple[str, ...] = (), full_only: bool = False) -> DataFrame:
    """Rows of a board whose run is one of runs (any, if none are named) and has the words in its name, whatever their case; with full_only those with as many sources as any."""
    out = board_.where(F.contains(F.lower("run_name"), F.lit(words.lower())))
    if runs:
        out = out.where(F.col("run_name").isin(*runs))
    if full_only:
        out = out.crossJoin(board_.agg(F.max("sources").alias("_most"))).where("sources = _most").drop("_most")  # one row
    return out


def sorted_board(board_: DataFrame, key: str, descending: bool = True, missing: float = -1.0) -> DataFrame:
    """A board with place: by a column, a missing number as `missing`, ties by name. A board has a row a run."""
    value = F.col(key) if board_.schema[key].dataType.simpleString() == "string" else F.coalesce(F.col(key).cast("double"), F.lit(missing))
    return board_.withColumn("place", F.row_number().over(Window.orderBy(value.desc() if descending else value.asc(), "run_name")))


def best_by_source(s: DataFrame, reference: str) -> DataFrame:
    """By source that the reference run has: its accuracy over noul and choice rows, and the best of the other runs with its name (ties to the lesser name)."""
    acc = s.where("q_type IN ('noul', 'choice')").groupBy("source", "run_name", "q_type").agg(F.avg("correct").alias("a")).groupBy("source", "run_name").agg(F.round(F.avg("a"), 9).alias("a"))
    ref = acc.where(F.col("run_name") == reference).select("source", F.col("a").alias("reference"))
    best = acc.where(F.col("run_name") != reference).groupBy("source").agg(F.min_by("run_name", F.struct(-F.col("a"), F.col("run_name"))).alias("best_run"), F.max("a").alias("best"))
    return ref.join(best, "source", "left").select("source", F.round("reference", 4).alias("reference"), "best_run", F.round("best", 4).alias("best"))


def delta_at_last_shared(s: DataFrame, base: str, step: Column) -> DataFrame:
    """Accuracy of each run less the base's, in points, at the last step at which both have rows: run_name, step, delta_pp."""
    by = s.groupBy("run_name", step.alias("step")).agg(F.avg("correct").alias("a"))
    b = by.where(F.col("run_name") == base).select("step", F.col("a").alias("base"))
    return by.where(F.col("run_name") != base).join(b, "step").groupBy("run_name").agg(F.max("step").alias("step"), F.round(F.max_by(100 * (F.col("a") - F.col("base")), "step"), 6).alias("delta_pp"))


def voted(s: DataFrame, least: int = 2) -> DataFrame:
    """Items that at least so many runs get right: by source: items, those so voted, and whether all are."""
    item = M.one_per_item(s).groupBy("source", "item_id").agg((F.sum("correct") >= least).alias("ok"))
    return item.groupBy("source").agg(F.count(F.lit(1)).alias("items"), _count(F.col("ok")).alias("voted"), F.bool_and("ok").alias("all_voted"))


def rendered(c: Column, percent: bool) -> Column:
    """A number as text: a percentage with one decimal or three decimals; a dash for null."""
    text = F.concat(F.format_string("%.1f", F.round(c * 100, 1)), F.lit("%")) if percent else F.format_string("%.3f", F.round(c, 3))
    return F.when(c.isNull(), "—").otherwise(text)
