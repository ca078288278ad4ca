"""What is in a corpus: counts of types, labels, teachers and splits, profiles of lengths, integrity of runs, builds and what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators import questions as Q
from sievework.operators import rules as R
from sievework.operators.corpus import first_wins, id_suffixes
from sievework.operators.running import running_sums
from sievework.operators.sampling import draw

_count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))


def typed(df: DataFrame) -> DataFrame:
    """Counts of typed questions in one long table: metric, value, n. Metrics: type, split, source, teacher, label (status), coercion, and rows, ids, repeated_ids, augmented, withheld under the value all.

    A row counts once in each metric (in teacher once for each of its teachers); all are taken in one pass over (metric, value).
    """
    pair = lambda m, v: F.struct(F.lit(m).alias("metric"), v.alias("value"))
    told = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("missing"))
    one = lambda m, c: F.when(F.coalesce(c, F.lit(False)), pair(m, F.lit("all")))
    each = F.array_compact(F.array(
        pair("type", told("q_type")), pair("split", told("split")), pair("source", told("source")), pair("label", Q.label_status()), F.when(R.label_coercion().isNotNull(), pair("coercion", R.label_coercion())), one("rows", F.lit(True)),
        one("augmented", F.size("augmented_options") > 0), one("withheld", F.col("answerable").eqNullSafe(F.lit(False))),
    ))
    teachers = F.transform(F.coalesce(F.map_keys("teacher_probs"), F.array().cast("array<string>")), lambda t: pair("teacher", t))
    counts = df.select(F.explode(F.concat(each, teachers)).alias("e")).groupBy("e.metric", "e.value").agg(F.count(F.lit(1)).alias("n"))
    ids = df.where("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_ids"))
    return counts.unionByName(ids.select(F.explode(F.array(F.struct(F.lit("ids").alias("metric"), F.lit("all").alias("value"), F.col("ids").alias("n")), F.struct(F.lit("repeated_ids").alias("metric"), F.lit("all").alias("value"), F.col("repeated_ids").alias("n")))).alias("e")).select("e.*"))


def probs(df: DataFrame) -> DataFrame:
    """Per run: rows, rows whose keys and probabilities don't match, distinct and repeated ids, and the most keys."""
    bad = F.col("item_id").isNull() | F.col("probs").isNull() | F.col("option_keys").isNull() | (F.size("probs") != F.size("option_keys"))
    rows = df.groupBy("run_name").agg(F.count(F.lit(1)).alias("rows"), _count(bad).alias("schema_errors"), F.max(F.when(~bad, F.size("option_keys"))).alias("most_keys"))
    ids = df.where("item_id IS NOT NULL").groupBy("run_name", "item_id").agg(F.count(F.lit(1)).alias("n")).groupBy("run_name").agg(F.count(F.lit(1)).alias("ids"), F.sum(F.col("n") - 1).alias("repeated"))
    return rows.join(ids, "run_name", "left")


def withheld(df: DataFrame) -> DataFrame:
    """Rows with a withheld answer overall, by source, by type, by reason, and by source and reason: level, source, q_type, reason, n, with_label, in_options, taught."""
    rows = df.where("answerable = false").select("source", "q_type", "reason", (Q.label_status() != "missing").alias("l"), Q.label_status().isin("option", "level", "fractional", "boolean").alias("o"), (F.size("teacher_probs") > 0).alias("t"))
    return rows.sparkSession.sql(
        """SELECT grouping_id(source, q_type, reason) AS level, source, q_type, reason, count(*) AS n, count_if(l) AS with_label, count_if(o) AS in_options, count_if(t) AS taught
        FROM {rows} GROUP BY GROUPING SETS ((), (source), (q_type), (reason), (source, reason))""",
        rows=rows,
    )


def bad_labels(df: DataFrame) -> DataFrame:
    """Rows whose label can't be right: row_no, status, what the label should have been one of."""
    allowed = F.when(F.col("q_type") == "choice", F.array_join(Q.option_keys(), "|")).when(F.col("q_type") == "score", F.concat(F.lit("0.."), (F.size("levels") - 1).cast("string"))).otherwise("true|false")
    return df.select("row_no", Q.label_status().alias("status"), allowed.alias("allowed")).where("status IN ('not_an_option', 'out_of_range', 'not_numeric', 'not_boolean')")


def run_integrity(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Per run: rows, rows of items that aren't there, rows that repeat an item, rows without a tier. items: item_id, a row an item."""
    met = runs.join(items.select("item_id", F.lit(1).alias("there")), "item_id", "left")
    base = met.groupBy("run_name").agg(F.count(F.lit(1)).alias("rows"), _count(F.col("there").isNull()).alias("unknown"), _count(F.col("tier").isNull()).alias("without_tier"))
    twice = runs.groupBy("run_name", "item_id").agg(F.count(F.lit(1)).alias("n")).groupBy("run_name").agg(F.sum(F.col("n") - 1).alias("repeats"))
    return base.join(twice, "run_name")


def presence(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """By group: rows, and how many have each field."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.count(f).alias(f) for f in fields))


def width_card(df: DataFrame) -> DataFrame:
    """By type and number of options: rows and their share of the type."""
    n = df.groupBy("q_type", Q.option_count().alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("q_type", "k", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("q_type")), 9).alias("share"))  # widths of a type


def lengths(df: DataFrame, group: list[str], value: Column, at: dict[str, Column]) -> DataFrame:
    """Order statistics of a whole number by group: n, and for each name of `at` the value at that index from 0, an expression of n. Exact, from counts of values ranked over range partitions."""
    hist = df.select(*group, value.alias("v")).where("v IS NOT NULL").groupBy(*group, "v").agg(F.count(F.lit(1)).alias("m"))
    ranked = running_sums(hist, group, [F.col("v")], {"upto": "m"}).drop("_n")
    total = hist.groupBy(*group).agg(F.sum("m").alias("n"))
    met = ranked.alias("r").join(total.alias("t"), [F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}")) for g in group]).select(*(F.col(f"r.{g}") for g in group), "v", "m", "upto", "n")
    return met.groupBy(*group).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > index, F.col("v"))).alias(name) for name, index in at.items()))


def beyond(df: DataFrame, group: list[str], value: Column, limit: DataFrame, name: str) -> DataFrame:
    """By group: rows, and the share whose value is at least the one number of limit (its column of that name)."""
    return df.select(*group, value.alias("v")).where("v IS NOT NULL").crossJoin(limit.select(name)).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(name).alias(name), F.round(F.avg((F.col("v") >= F.col(name)).cast("double")), 9).alias("share"))  # one row


def canonical_build(df: DataFrame, manifest: DataFrame, build: str = "canonical") -> DataFrame:
    """What a build keeps: row_no, new_id (made unique where a corpus uses ids again), verdict (record, id, licence or kept). Dedup comes first; then a corpus that the manifest doesn't allow and name for the build is left out."""
    allowed = manifest.where(F.col("verdict") == "allow").where(F.array_contains("included_in", build)).select("corpus", F.lit(True).alias("allowed"))
    named = df.select("row_no", "corpus", "id").join(first_wins(df).select("row_no", F.col("verdict").alias("dedup")), "row_no").join(id_suffixes(df), "row_no", "left").join(allowed, "corpus", "left")
    verdict = F.when(F.col("dedup") != "kept", F.col("dedup")).when(F.col("allowed").isNull(), "licence").otherwise("kept")
    return named.select("row_no", F.coalesce("new_id", "id").alias("new_id"), verdict.alias("verdict"))


def checksum(df: DataFrame, key: str) -> DataFrame:
    """Rows and a sum of hashes of a key, which are equal for equal multisets in any order."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("sum"))


def tier_counts(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Rows of each tier beside what is expected: tier, n, expected, ok. A tier on one side only isn't ok."""
    want = df.sparkSession.createDataFrame(list(expected.items()), "tier string, expected bigint")
    n = df.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return n.join(want, "tier", "full").select("tier", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected")).withColumn("ok", F.col("n") == F.col("expected"))


def source_items(df: DataFrame, config: dict[str, dict], seed: int = 42) -> DataFrame:
    """Training and test rows of configured sources: row_no, source, side (train, test). config: weight (0: test rows only), max_train, max_eval. Rows of other types, with a label that can't be right or of other splits are left out; a cap keeps rows drawn by hash."""
    from sievework.operators.corpus import split_side

    rows = df.where(F.col("source").isin(*config) & F.col("q_type").isin("noul", "choice", "score")).withColumn("side", split_side()).where("side IN ('train', 'test')")
    rows = rows.where(~((F.col("q_type") == "score") & Q.label_status().isin("out_of_range", "not_numeric")))
    cap, weight = F.lit(None).cast("bigint"), F.lit(1.0)
    for name, c in config.items():
        mine = F.col("source") == name
        cap = F.when(mine & (F.col("side") == "train"), F.lit(c.get("max_train")).cast("bigint")).when(mine & (F.col("side") == "test"), F.lit(c.get("max_eval")).cast("bigint")).otherwise(cap)
        weight = F.when(mine, F.lit(float(c.get("weight", 1.0)))).otherwise(weight)
    kept = rows.where(~((weight == 0) & (F.col("side") == "train"))).withColumns({"_cap": cap, "_d": draw(seed, "row_no")})
    ranked = running_sums(kept.where("_cap IS NOT NULL").select("row_no", "source", "side", "_cap", "_d"), ["source", "side"], [F.col("_d"), F.col("row_no")], {}).where("_n <= _cap")
    return kept.where("_cap IS NULL").select("row_no", "source", "side").unionByName(ranked.select("row_no", "source", "side"))
