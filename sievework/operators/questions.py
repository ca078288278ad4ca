"""Validation, label semantics and row transforms of typed questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.operators.running import running_sums
from sievework.operators.skew import lookup
from sievework.session import cut

TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")


def noul_label() -> Column:
    text = F.lower(F.trim("label_key"))
    return F.coalesce(F.col("label_bool"), F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False))


def level_label() -> Column:
    return F.coalesce(F.col("label_level"), F.expr("try_cast(trim(label_key) AS double)"))


def option_keys() -> Column:
    return F.transform("options", lambda o: o["key"])


def label_status() -> Column:
    """What a label is, by type: option, withheld_gold, level, fractional, boolean; else what is wrong: missing, not_an_option, not_numeric, out_of_range, unknown_type."""
    choice = F.when(F.array_contains(option_keys(), F.col("label_key")), "option").when(F.col("answerable").eqNullSafe(F.lit(False)), "withheld_gold").when(F.col("label_key").isNull(), "missing").otherwise("not_an_option")
    level, top = level_label(), F.size("levels") - 1
    score = (
        F.when(level.isNull(), F.when(F.col("label_key").isNull(), "missing").otherwise("not_numeric"))
        .when((level < 0) | (level > top) | F.col("levels").isNull(), "out_of_range").when(F.abs(level - F.bround(level)) < 1e-9, "level").otherwise("fractional")
    )
    noul = F.when(noul_label().isNotNull(), "boolean").when(F.col("label_key").isNull(), "missing").otherwise("not_boolean")
    return F.when(F.col("q_type") == "choice", choice).when(F.col("q_type") == "score", score).when(F.col("q_type") == "noul", noul).otherwise("unknown_type")


def well_formed() -> Column:
    """At least two options or levels, none blank."""
    texts = F.coalesce(F.when(F.col("q_type") == "choice", F.transform("options", lambda o: o["text"])), F.when(F.col("q_type") == "score", F.col("levels")))
    return (F.col("q_type") == "noul") | F.coalesce((F.size(texts) >= 2) & F.forall(texts, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.lit(False))


def profile(df: DataFrame) -> DataFrame:
    """By type and label status: rows, distinct ids, ids that repeat, rows with teacher probabilities, unanswerable rows, badly formed ones."""
    rows = df.select("q_type", "id", label_status().alias("status"), (F.size(F.coalesce("teacher_probs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<map<string,double>>")))) > 0).alias("taught"), F.col("answerable").eqNullSafe(F.lit(False)).alias("withheld"), well_formed().alias("formed"))
    return rows.groupBy("q_type", "status").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.col("taught").cast("int")).alias("taught"), F.sum(F.col("withheld").cast("int")).alias("withheld"), F.sum((~F.col("formed")).cast("int")).alias("malformed")
    )


def teacher_rows(df: DataFrame) -> DataFrame:
    """One row per question, teacher and key; p divided by the teacher's sum where that is positive and off 1."""
    by = df.select("row_no", "q_type", "label_key", F.explode("teacher_probs").alias("teacher", "probs")).withColumn("total", C.total(F.map_values("probs")))
    return by.withColumn("probs", C.normalised_map(F.col("probs"))).select("row_no", "q_type", "label_key", "teacher", "total", F.explode("probs").alias("key", "p"))


def teacher_sums(df: DataFrame) -> DataFrame:
    """By teacher: rows, distributions that don't sum to 1, least and greatest sum."""
    by = df.select(F.explode("teacher_probs").alias("teacher", "probs")).withColumn("total", C.total(F.map_values("probs")))
    return by.groupBy("teacher").agg(F.count(F.lit(1)).alias("n"), F.sum((F.abs(F.col("total") - 1) > 1e-6).cast("int")).alias("off"), F.round(F.min("total"), 9).alias("least"), F.round(F.max("total"), 9).alias("most"))


def teacher_agreement(df: DataFrame) -> DataFrame:
    """Choice questions by teacher: rows, and how often the most probable key (ties to the least) is the label."""
    top = teacher_rows(df.where("q_type = 'choice' AND label_key IS NOT NULL")).groupBy("row_no", "teacher", "label_key").agg(F.min_by("key", F.struct(-F.col("p"), F.col("key"))).alias("top"))
    return top.groupBy("teacher").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("top") == F.col("label_key")).cast("int")).alias("agree"))


def mixed_gold(df: DataFrame, weight: float) -> DataFrame:
    """Teacher distributions of choice questions with the gold option mixed in."""
    rows = teacher_rows(df.where("q_type = 'choice' AND label_key IS NOT NULL"))
    return rows.select("row_no", "teacher", "key", F.round(F.col("p") * (1 - weight) + F.when(F.col("key") == F.col("label_key"), weight).otherwise(0.0), 9).alias("p"))


def to_score(df: DataFrame) -> DataFrame:
    """Every question as one score question: noul has levels no and yes, choice its option texts in order; label is the level. Rows without a usable label are left out."""
    levels = F.when(F.col("q_type") == "noul", F.array(F.lit("no"), F.lit("yes"))).when(F.col("q_type") == "choice", F.transform("options", lambda o: o["text"])).otherwise(F.col("levels"))
    label = (
        F.when(F.col("q_type") == "noul", noul_label().cast("double"))
        .when(F.col("q_type") == "choice", (F.nullif(F.array_position(option_keys(), F.col("label_key")), F.lit(0)) - 1).cast("double"))
        .otherwise(level_label())
    )
    return df.select("row_no", F.col("q_type").alias("source_type"), levels.alias("levels"), label.alias("level")).where("level IS NOT NULL AND levels IS NOT NULL AND level BETWEEN 0 AND size(levels) - 1")


def to_candidates(df: DataFrame) -> DataFrame:
    """Choice questions as one five-level row per option: 4 for the gold, else 0."""
    rows = df.where(F.col("q_type") == "choice").select("row_no", "label_key", F.posexplode("options").alias("place", "o"))
    return rows.select("row_no", "place", F.col("o.key").alias("candidate"), F.when(F.col("o.key") == F.col("label_key"), 4.0).otherwise(0.0).alias("level")).where("candidate IS NOT NULL")


def from_candidates(rows: DataFrame, score: str) -> DataFrame:
    """Back to a choice: the candidate with the greatest score, ties to the earlier one, and its share under softmax."""
    w = rows.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "place", "candidate"))).alias("c"))  # options of one question
    share = 1 / C.total(F.transform("c", lambda e: F.exp(F.element_at("c", 1)["s"] - e["s"])))
    return w.select("row_no", F.element_at("c", 1)["candidate"].alias("chosen"), F.round(share, 9).alias("share"))


def reversed_score(df: DataFrame) -> DataFrame:
    return df.where("q_type = 'score' AND label_level BETWEEN 0 AND size(levels) - 1").select("row_no", F.reverse("levels").alias("levels"), (F.size("levels") - 1 - F.col("label_level")).alias("level"))


def shuffled_options(df: DataFrame, seed: int) -> DataFrame:
    """Choice options in an order drawn by hash of seed, row and key, with the gold's new place, -1 if it has none."""
    rows = df.where("q_type = 'choice' AND options IS NOT NULL")
    drawn = F.array_sort(F.transform("options", lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_no").cast("string"), o["key"])).alias("draw"), o["key"].alias("key"))))
    keys = F.transform(drawn, lambda o: o["key"])
    return rows.select("row_no", keys.alias("keys"), (F.coalesce(F.array_position(keys, F.col("label_key")), F.lit(0)) - 1).cast("int").alias("gold"))


def without_gold(df: DataFrame) -> DataFrame:
    """Choice questions of three options and more, their gold taken out: nothing is right any more."""
    left = F.filter("options", lambda o: o["key"] != F.col("label_key"))
    return df.where("q_type = 'choice' AND size(options) >= 3").where(F.array_contains(option_keys(), F.col("label_key"))).select("row_no", F.transform(left, lambda o: o["key"]).alias("keys"))


def first_sentences(df: DataFrame, share: float) -> DataFrame:
    """The first share of each state's sentences, one at least; states of two sentences and more."""
    sentences = F.split("state", r"(?<=[.!?])\s+")
    n = F.greatest(F.lit(1), F.floor(F.size(sentences) * share).cast("int"))
    return df.where("state IS NOT NULL").where(F.size(sentences) >= 2).select("row_no", F.size(sentences).alias("sentences"), F.array_join(F.slice(sentences, F.lit(1), n), " ").alias("state"))


def shrink(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Choice questions with more than k options: the gold and k - 1 others drawn by hash, in their old order."""
    rows = df.where("q_type = 'choice'").where(F.size("options") > k).where(F.array_contains(option_keys(), F.col("label_key")))
    o = rows.select("row_no", "label_key", F.posexplode("options").alias("place", "o")).select("row_no", "place", F.col("o.key").alias("key"), F.when(F.col("o.key") == F.col("label_key"), "").otherwise(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_no").cast("string"), F.col("o.key")))).alias("draw"))
    kept = o.groupBy("row_no").agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "place", "key"))), 1, k).alias("kept"))  # options of one question
    return kept.select("row_no", F.transform(F.array_sort(F.transform("kept", lambda e: F.struct(e["place"], e["key"]))), lambda e: e["key"]).alias("keys"))


def distractor_pool(df: DataFrame) -> DataFrame:
    """Distinct option texts of each source, by trimmed lower case, the first in row order kept."""
    o = df.where("q_type = 'choice'").select("source", "row_no", F.posexplode("options").alias("place", "o")).withColumn("norm", F.lower(F.trim("o.text"))).where("norm <> ''")
    return o.groupBy("source", "norm").agg(F.min_by("o.text", F.struct("row_no", "place")).alias("text"), F.count(F.lit(1)).alias("uses"))


def _numbers(most: Column, k: Column, seed: str) -> Column:
    """k different numbers from 1 to most, all of them if there are fewer: every set of k is as likely (Floyd's draw), by hash of seed and row_no."""
    n = F.least(most.cast("bigint"), k.cast("bigint"))

    def drawn(have: Column, i: Column) -> Column:
        top = most - n + i
        t = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("row_no").cast("string"), i.cast("string"))), 1, 15), 16, 10).cast("bigint"), top) + 1
        return F.array_append(have, F.when(F.array_contains(have, t), top).otherwise(t))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), n), F.array().cast("array<bigint>"), drawn)).otherwise(F.array().cast("array<bigint>"))


def _drawn_texts(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """rows (row_no, numbers, source) with found: the pool's (norm, text) at those numbers, in an order drawn by hash. pool: source, _n, norm, text."""
    asked = rows.select("row_no", F.explode(F.transform("numbers", lambda i: F.struct(F.col("source").alias("source"), i.alias("n")))).alias("at"))
    texts = lookup(asked, pool.select(F.struct("source", F.col("_n").cast("bigint").alias("n")).alias("at"), "norm", "text"), "at", "row_no", how="inner")
    d = F.md5(F.concat_ws(":", F.col("row_no").cast("string"), "norm"))
    found = texts.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct(d.alias("d"), "norm", "text"))).alias("found"))  # k at most
    return rows.join(found, "row_no", "left")


def pad(df: DataFrame, k: int | Column, seed: int) -> DataFrame:
    """Choice questions with fewer than k options: texts that they don't have, drawn by hash from all texts of their source, and if those are too few from those of all sources, up to k. Columns: row_no (must be unique), k, added (texts).

    A question whose label isn't one of its options is left out. Texts are numbered, and a question looks up k numbers drawn by hash. A pool has each text
    once, so those that a question must not take and those that it wants are k together: k numbers always do.
    """
    pool = running_sums(distractor_pool(df).select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("unnamed"), "norm", "text"), ["source", "unnamed"], [F.col("norm")], {})
    own = pool.where("NOT unnamed").select("source", "_n", "norm", "text")
    asked = k if isinstance(k, Column) else F.lit(k)
    rows = df.where("q_type = 'choice'").where(F.array_contains(option_keys(), F.col("label_key"))).select("row_no", "source", asked.alias("k"), F.transform("options", lambda o: F.coalesce(F.lower(F.trim(o["text"])), F.lit(""))).alias("have")).where("size(have) < k")
    sizes = own.groupBy("source").agg(F.max("_n").alias("most"))
    asking = rows.join(sizes, "source", "left").withColumn("numbers", _numbers(F.coalesce("most", F.lit(0)), F.col("k"), f"{seed}:own"))

    def taken(e: Column) -> Column:
        return F.filter(F.coalesce("found", F.array().cast("array<struct<d:string,norm:string,text:string>>")), lambda x: ~F.array_contains(e, x["norm"]))

    wanted = F.col("k") - F.size("have")
    first = cut(_drawn_texts(asking, own).select("row_no", "k", "have", F.slice(taken(F.col("have")), F.lit(1), wanted).alias("mine")))
    flat = running_sums(pool.groupBy("norm").agg(F.min_by("text", F.struct("unnamed", "source")).alias("text")), [], [F.col("norm")], {}).withColumn("source", F.lit(""))
    lacking = first.where(F.size("mine") < wanted).crossJoin(flat.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("most")))  # one row
    second = _drawn_texts(lacking.select("row_no", "k", "have", "mine", F.lit("").alias("source"), _numbers(F.col("most"), F.col("k"), f"{seed}:all").alias("numbers")), flat)
    more = F.slice(taken(F.concat("have", F.transform("mine", lambda e: e["norm"]))), F.lit(1), wanted - F.size("mine"))
    both = first.where(F.size("mine") >= wanted).select("row_no", "k", "mine").unionByName(second.select("row_no", "k", F.concat("mine", more).alias("mine")))
    return both.select("row_no", "k", F.transform("mine", lambda e: e["text"]).alias("added")).where("size(added) > 0")


def target_k(low: int, high: int, seed: int) -> Column:
    """A whole number from low to high, its logarithm drawn evenly by hash of seed and row_no."""
    u = C.hash_fraction(F.concat_ws(":", F.lit(f"{seed}:k"), F.col("row_no").cast("string")))
    return F.least(F.lit(high), F.greatest(F.lit(low), F.bround(F.exp(F.log(F.lit(float(low))) + u * (F.log(F.lit(float(high))) - F.log(F.lit(float(low))))), 0).cast("int")))


def k_augmented(df: DataFrame, share: float, low: int, high: int, seed: int, epoch: int = 0) -> DataFrame:
    """What padding a share of the choice questions, drawn by hash of seed, epoch and row_no, to widths of target_k() comes to, in one row: choice_items, selected, padded,
    under_filled, teachers_dropped (a selected question keeps no teacher), encodes_before, encodes_after, target_mean, realised_mean, realised_max."""
    coin = C.hash_fraction(F.concat_ws(":", F.lit(f"{seed}:{epoch}:coin"), F.col("row_no").cast("string"))) < share
    choice = df.where("q_type = 'choice' AND options IS NOT NULL")
    rows = choice.select("row_no", F.size("options").alias("natural"), coin.alias("drawn"), F.col("teacher_probs").isNotNull().alias("taught"), target_k(low, high, seed).alias("k"))
    done = pad(df, F.when(coin, target_k(low, high, seed)), seed).select("row_no", F.size("added").alias("added"))
    all_ = rows.join(done, "row_no", "left").withColumns({"wide": F.col("natural") + F.coalesce("added", F.lit(0)), "aimed": F.col("drawn") & (F.col("k") > F.col("natural"))})
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return all_.agg(
        F.count(F.lit(1)).alias("choice_items"), count(F.col("drawn")).alias("selected"), count(F.coalesce("added", F.lit(0)) > 0).alias("padded"), count(F.col("aimed") & (F.col("wide") < F.col("k"))).alias("under_filled"), count(F.col("drawn") & F.col("taught")).alias("teachers_dropped"),
        F.coalesce(F.sum("natural"), F.lit(0)).alias("encodes_before"), F.coalesce(F.sum("wide"), F.lit(0)).alias("encodes_after"), F.round(F.coalesce(F.avg(F.when(F.col("aimed"), F.col("k"))), F.lit(0.0)), 9).alias("target_mean"),
        F.round(F.coalesce(F.avg(F.when(F.col("aimed"), F.col("wide"))), F.lit(0.0)), 9).alias("realised_mean"), F.coalesce(F.max(F.when(F.col("aimed"), F.col("wide"))), F.lit(0)).alias("realised_max"),
    )


def option_count() -> Column:
    """Options that a question is scored over: of noul the augmented ones if it has more than two teacher probabilities, else two."""
    taught = F.coalesce(F.array_max(F.transform(F.map_values("teacher_probs"), lambda m: F.size(m))), F.lit(0))
    return F.when(F.col("q_type") == "choice", F.coalesce(F.size("options"), F.lit(0))).when(F.col("q_type") == "score", F.coalesce(F.size("levels"), F.lit(0))).when((taught > 2) & (F.size("augmented_options") > 0), F.size("augmented_options")).otherwise(2)


def digest_order(texts: Column) -> Column:
    """Indexes from 0 in order of the digests of the trimmed texts; equal texts in their own order."""
    return F.transform(F.array_sort(F.transform(texts, lambda t, i: F.struct(F.sha2(F.trim(t), 256).alias("d"), i.alias("i")))), lambda e: e["i"])


def variants(df: DataFrame, seed: int) -> DataFrame:
    """Every question in four forms: row_no, variant (neutral, nonsense, reversed, shuffled), instructions, keys (of options or levels, in their new order), label.

    Neutral and nonsense change the instruction only. A score label moves with its level; one between two levels lies as far between their new places. Rows of other types or without options or levels are left out.
    """
    items = F.when(F.col("q_type") == "choice", option_keys()).when(F.col("q_type") == "score", F.col("levels"))
    base = df.select("row_no", "q_type", "instructions", items.alias("keys"), F.when(F.col("q_type") == "choice", F.col("label_key")).otherwise(level_label().cast("string")).alias("label")).where("size(keys) > 0 AND label IS NOT NULL")
    n = F.size("keys")
    drawn = F.transform(F.array_sort(F.transform("keys", lambda k, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_no").cast("string"), i.cast("string"))).alias("d"), i.alias("i")))), lambda e: e["i"])
    made = base.select("*", F.explode(F.array(*map(F.lit, ("neutral", "nonsense", "reversed", "shuffled")))).alias("variant"))
    order = F.when(F.col("variant") == "reversed", F.reverse(F.sequence(F.lit(0), n - 1))).when(F.col("variant") == "shuffled", drawn).otherwise(F.sequence(F.lit(0), n - 1))
    placed = made.withColumn("order", order)
    level = F.expr("try_cast(label AS double)")
    low = F.floor(level).cast("int")
    at = lambda i: (F.array_position("order", i) - 1).cast("double")
    moved = at(low) + (level - low) * (at(F.least(low + 1, n - 1)) - at(low))
    inside = (level >= 0) & (level <= n - 1)
    label = F.when(F.col("q_type") == "choice", F.col("label")).when(inside, moved.cast("string"))
    told = F.when(F.col("variant") == "neutral", "Choose the best answer.").when(F.col("variant") == "nonsense", "Blue seven quietly under the.").otherwise(F.col("instructions"))
    return placed.select("row_no", "variant", told.alias("instructions"), F.transform("order", lambda i: F.element_at("keys", i + 1)).alias("keys"), label.alias("label")).where("label IS NOT NULL")


def nested_options(df: DataFrame, sizes: tuple[int, ...], seed: int) -> DataFrame:
    """For each size below a choice question's own: the gold and the first others in an order drawn by hash, so smaller sets lie in larger ones. row_no, size, keys (in that order)."""
    rows = df.where("q_type = 'choice'").where(F.array_contains(option_keys(), F.col("label_key")))
    others = F.array_sort(F.transform(F.filter("options", lambda o: o["key"] != F.col("label_key")), lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_no").cast("string"), o["key"])).alias("d"), o["key"].alias("key"))))
    drawn = rows.select("row_no", F.concat(F.array("label_key"), F.transform(others, lambda e: e["key"])).alias("keys"), F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    return drawn.where(F.size("keys") > F.col("size")).select("row_no", "size", F.slice("keys", F.lit(1), F.col("size")).alias("keys"))
