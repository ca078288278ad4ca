"""Dedup, contamination, leakage, overlap and coverage over corpus tables.

Order comes from explicit columns (priority, pos, row_no), never from how rows happen to lie in files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import columns as C
from sievework.functions.forms import folded_column, folded_words, key_hashes
from sievework.operators.running import running_sums
from sievework.operators.skew import lookup
from sievework.session import cut

ORDER = ("priority", "corpus", "pos", "row_no")
SHINGLE_WORDS, SHARED_SHINGLES = 8, 3


def record_digest(id_: Column, state: Column, question: str, label: str) -> Column:
    """Digest of what makes a record: questions and labels as JSON, whatever order and spacing they are written in; nulls differ from empty strings."""
    part = lambda c: F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c))
    return F.unhex(F.md5(F.concat_ws("\x1f", part(id_), part(state), part(C.canonical_json(question)), part(C.canonical_value(label)))))


def first_wins(df: DataFrame, source: str = "source", keep_reuse: bool = True) -> DataFrame:
    """Rows kept by first-wins dedup, with the reason that drops the others.

    Columns: row_no, source, verdict. In order of priority, corpus, pos: an equal record (id, normalised state, question, label) seen before
    drops a row as "record"; an id that came first from another source group as "id"; an id reused inside its group is kept, or with keep_reuse off dropped as "reuse".
    Firsts are minima taken on the map side, looked up by salted joins: no window sorts a hot key.
    """
    rank = F.struct(*(F.col(c) for c in ORDER))
    rows = cut(df.select("row_no", source, "id", rank.alias("rank"), record_digest(F.col("id"), folded_column("state"), "question", "label").alias("digest")))
    by_record = rows.groupBy("digest").agg(F.min("rank").alias("first_rank"))
    marked = lookup(rows, by_record, "digest", "row_no").withColumn("repeat", F.col("rank") != F.col("first_rank"))
    by_id = marked.where("NOT repeat AND id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct(F.col(source).alias("source"), F.col("rank")), "rank").alias("owner"))
    owned = lookup(marked, by_id, "id", "row_no")
    verdict = F.when(F.col("repeat"), "record").when(~F.col("owner.source").eqNullSafe(F.col(source)) & F.col("id").isNotNull(), "id")
    if not keep_reuse:
        verdict = verdict.when(F.col("owner.rank") != F.col("rank"), "reuse")
    return owned.select("row_no", source, verdict.otherwise("kept").alias("verdict"))


def duplicate_metrics(df: DataFrame) -> DataFrame:
    """Per source: rows; distinct ids, states and records, and the rows beyond each; ids and states under several questions; most rows of an id and of a state.

    A null id or state counts as the empty one, a null question as a question of its own.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = cut(
        df.select("source", F.unhex(F.md5(folded_column(filled("state")))).alias("s"), filled("id").alias("i"), F.coalesce(C.canonical_json("question"), F.lit("")).alias("text"), record_digest(filled("id"), folded_column(filled("state")), "question", "label").alias("d"))
        .withColumn("q", F.unhex(F.md5("text"))).drop("text")
    )

    def per(key: str, name: str) -> DataFrame:
        """Keys are reduced to (key, question) first, so a hot one is a row per question."""
        by = rows.groupBy("source", key, "q").agg(F.count(F.lit(1)).alias("n")).groupBy("source", key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("q"))
        return by.groupBy(F.col("source").alias(f"source_{name}")).agg(F.sum("n").alias(f"n_{name}"), F.count(F.lit(1)).alias(f"{name}s"), F.sum((F.col("q") > 1).cast("int")).alias(f"{name}s_of_several_questions"), F.max("n").alias(f"most_rows_of_{name}"))

    records = rows.select("source", "d").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("records"))
    same = lambda name: F.col(f"source_{name}").eqNullSafe(F.col("source"))
    return records.join(per("s", "state"), same("state")).join(per("i", "id"), same("id")).select(
        "source", F.col("n_id").alias("n"), "ids", "states", "records", (F.col("n_id") - F.col("records")).alias("repeated_records"), (F.col("n_id") - F.col("ids")).alias("rows_sharing_id"), (F.col("n_id") - F.col("states")).alias("rows_sharing_state"),
        "ids_of_several_questions", "states_of_several_questions", "most_rows_of_id", "most_rows_of_state",
    )


def cross_source(df: DataFrame, key: Column) -> DataFrame:
    """Pairs of sources with how many keys both have. Keys are reduced to (key, source) first; sources are few."""
    pairs = df.select(key.alias("key"), "source").where("key IS NOT NULL AND key <> '' AND source IS NOT NULL").distinct()
    a, b = pairs.withColumnRenamed("source", "source_a"), pairs.withColumnRenamed("source", "source_b")
    return a.join(b, "key").where("source_a < source_b").groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("shared"))


def id_suffixes(df: DataFrame) -> DataFrame:
    """Ids made unique per corpus: where any id of a corpus repeats, ids of that corpus get -qN, N counting from 0 in order."""
    rows = running_sums(df.where("id IS NOT NULL").select("row_no", "corpus", "id", "pos"), ["corpus", "id"], [F.col("pos"), F.col("row_no")], {})
    flags = rows.groupBy("corpus").agg((F.max("_n") > 1).alias("reused"))
    flagged = rows.alias("r").join(flags.alias("f"), F.col("r.corpus").eqNullSafe(F.col("f.corpus")))
    return flagged.select("row_no", F.when(F.col("reused"), F.concat("id", F.lit("-q"), (F.col("_n") - 1).cast("string"))).otherwise(F.col("id")).alias("new_id"))


#: Keys of probes up to this number are sent to the tasks that read documents, which then give only what matches; more are joined by a shuffle.
SENT_KEYS = 4_000_000
_STATE, _SHINGLE = 0, 1


def _folded(text: str) -> list[str]:
    return folded_words(text).split(" ") if text else []


def _collapsed(text: str) -> list[str]:
    return text.lower().split()


def _keys(df: DataFrame, id_col: str, text: str, name: str, words_of: Callable[[str], list[str]], short: bool, wanted: Broadcast | None = None) -> DataFrame:
    """name, kind (of the whole text or of a shingle), high, low: the distinct keys of each text, those only that are wanted. A text without words has none."""
    kind = df.schema[id_col].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [words_of(t or "") for t in batch.column(1).to_pylist()]
            whole = [(i, hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest()) for i, w in enumerate(lists) if w]
            states = np.frombuffer(b"".join(d for _, d in whole), np.int64).reshape(-1, 2)
            shingles, owner = key_hashes(lists, SHINGLE_WORDS, short)
            high = np.concatenate([states[:, 0], shingles.view(np.int64)])
            low = np.concatenate([states[:, 1], np.zeros(len(shingles), np.int64)])
            row = np.concatenate([np.array([i for i, _ in whole], np.int64), owner])
            which = np.concatenate([np.full(len(states), _STATE, np.int8), np.full(len(shingles), _SHINGLE, np.int8)])
            if wanted is not None:
                at = np.searchsorted(wanted.value, high)
                at[at == len(wanted.value)] = 0
                hit = wanted.value[at] == high if len(wanted.value) else np.zeros(len(high), bool)
                high, low, row, which = high[hit], low[hit], row[hit], which[hit]
            order = np.lexsort((high, which, row))
            high, low, row, which = high[order], low[order], row[order], which[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (which[1:] != which[:-1]) | (high[1:] != high[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(which[new]), pa.array(high[new]), pa.array(low[new])], names=[name, "kind", "high", "low"])

    return df.select(id_col, text).mapInArrow(made, f"{name} {kind}, kind tinyint, high bigint, low bigint")


def _met(documents: DataFrame, probes: DataFrame, probe_text: str, words_of: Callable[[str], list[str]], short: bool) -> tuple[DataFrame, DataFrame]:
    """The probes' keys (item_id, kind, high, low), and the documents' keys that can match them (doc_id, ...).

    Every document is read once and whole. What leaves its tasks is what matches, if the probes have at most SENT_KEYS keys; else all keys are shuffled to them.
    """
    mine = cut(_keys(probes, "id", probe_text, "item_id", words_of, short))
    distinct = mine.select("high").distinct()
    sent = None
    if distinct.count() <= SENT_KEYS:
        sent = documents.sparkSession.sparkContext.broadcast(np.sort(distinct.toArrow()["high"].to_numpy()))
    return mine, _keys(documents, "doc_id", "text", "doc_id", words_of, short, sent)


def contamination_pairs(documents: DataFrame, probes: DataFrame, probe_text: str = "state", least: int = SHARED_SHINGLES) -> DataFrame:
    """Documents that give away a probe: the same normalised text ("state"), or at least `least` distinct shared shingles ("shingle").

    An exact hit hides the shingle hits of its document. Texts are compared by hashes: of the whole by 128 bits, of eight words by 64.
    """
    mine, there = _met(documents, probes, probe_text, _folded, False)
    same = ["kind", "high", "low"]
    hits = there.join(mine.distinct(), same).groupBy("doc_id", "item_id").agg(F.max((F.col("kind") == _STATE).cast("int")).alias("exact"), F.count(F.lit(1)).alias("shared"))
    marked = hits.where((F.col("exact") == 1) | (F.col("shared") >= least)).withColumn("hidden", F.max("exact").over(Window.partitionBy("doc_id")))  # the probes of one document
    return marked.where("exact = hidden").select("doc_id", "item_id", F.when(F.col("exact") == 1, "state").otherwise("shingle").alias("reason"), F.when(F.col("exact") == 1, 0).otherwise(F.col("shared")).cast("bigint").alias("shared"))


def contamination_pooled(documents: DataFrame, probes: DataFrame, probe_text: str = "state", least: int = SHARED_SHINGLES) -> DataFrame:
    """Documents with at least `least` shingles of any probes."""
    mine, there = _met(documents, probes, probe_text, _folded, False)
    pool = mine.where(F.col("kind") == _SHINGLE).select("high").distinct()
    return there.where(F.col("kind") == _SHINGLE).join(pool, "high", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def containment(documents: DataFrame, probes: DataFrame, probe_text: str = "state", flag: float = 0.5) -> DataFrame:
    """Of each probe: its shingles, those that stand in any document, their share, whether it reaches the flag. A probe shorter than a shingle is one shingle. Words are lower case, parted by white space only."""
    mine, there = _met(documents, probes, probe_text, _collapsed, True)
    shingles = mine.where(F.col("kind") == _SHINGLE).select("item_id", "high").distinct()
    found = there.where(F.col("kind") == _SHINGLE).join(shingles.select("high").distinct(), "high", "left_semi").select("high").distinct()
    both = shingles.join(found.withColumn("hit", F.lit(1)), "high", "left")
    return both.groupBy("item_id").agg(F.count(F.lit(1)).alias("shingles"), F.count("hit").alias("found")).select(
        "item_id", "shingles", "found", F.round(F.col("found") / F.col("shingles"), 9).alias("share"), (F.col("found") / F.col("shingles") >= flag).alias("flagged")
    )


def split_side(column: str = "split") -> Column:
    name = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return F.when(name.isin("val", "dev", "valid"), "validation").when(name != "", name)


def exact_leaks(df: DataFrame) -> DataFrame:
    """Per held-out split: rows, rows whose state is in train, whose state and question are, and of those with another first label."""
    label = F.coalesce(F.col("label_bool").cast("string"), F.col("label_key"), F.col("label_level").cast("string"))
    criteria = F.array_join(F.array_sort(F.coalesce(F.transform("options", lambda o: o["key"]), F.col("levels"), F.array().cast("array<string>"))), "\x1f")
    rows = df.select("row_no", split_side().alias("side"), C.collapsed_lower("state").alias("s"), F.concat_ws("\x1e", "q_type", C.collapsed_lower("instructions"), criteria).alias("q"), label.alias("label")).where("s <> ''")
    train = rows.where("side = 'train'")
    states = train.select("s").distinct().withColumn("state_there", F.lit(True))
    asked = train.groupBy("s", "q").agg(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("row_no"))).alias("train_label"), F.lit(True).alias("question_there"))
    held = rows.where("side IN ('validation', 'test')").join(states, "s", "left").join(asked, ["s", "q"], "left")
    return held.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.count("state_there").alias("state_repeats"), F.count("question_there").alias("identical"),
        F.sum((F.col("label") != F.col("train_label")).cast("int")).alias("label_conflicts"),
    ).withColumn("label_conflicts", F.coalesce("label_conflicts", F.lit(0)))


def coverage_gaps(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per run: items with a prediction, items without (left anti), predictions of unknown items."""
    known = items.where("id IS NOT NULL").select(F.col("id").alias("item_id")).distinct()
    runs = predictions.select("run_name").distinct()
    have = predictions.where("item_id IS NOT NULL").select("run_name", "item_id").distinct()
    hit = have.join(known, "item_id", "left_semi").groupBy("run_name").agg(F.count(F.lit(1)).alias("covered"))
    lost = have.join(known, "item_id", "left_anti").groupBy("run_name").agg(F.count(F.lit(1)).alias("unknown"))
    return runs.join(hit, "run_name", "left").join(lost, "run_name", "left").crossJoin(known.agg(F.count(F.lit(1)).alias("items"))).select(  # one row
        "run_name", F.coalesce("covered", F.lit(0)).alias("covered"), (F.col("items") - F.coalesce("covered", F.lit(0))).alias("missing"), F.coalesce("unknown", F.lit(0)).alias("unknown")
    )


def licence_counts(df: DataFrame, manifest: DataFrame, build: str = "canonical") -> DataFrame:
    """Rows by corpus and verdict; fail closed: only a corpus that the manifest allows and names for the build is included."""
    terms = manifest.select("corpus", "verdict", F.coalesce(F.array_contains("included_in", build), F.lit(False)).alias("named"), F.lit(True).alias("listed"))
    return df.join(terms, "corpus", "left").groupBy("corpus", F.coalesce("verdict", F.when(F.col("listed"), "unknown").otherwise("unlisted")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.coalesce("named", F.lit(False)) & F.coalesce(F.col("verdict") == "allow", F.lit(False))).cast("int")).alias("included")
    )


def length_profile(df: DataFrame, bounds: tuple[int, ...] = (128, 512, 1024, 2048, 4096, 8192)) -> DataFrame:
    """Per language: texts, and by half-even index rule the 50th, 90th and 99th percentile of length, and the share beyond each bound."""
    lengths = df.where("text IS NOT NULL").select("lang", F.length("text").alias("len"))
    # exact order statistics from a histogram by length, summed up; lengths are far fewer than texts
    hist = lengths.groupBy("lang", "len").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy("len")
    ranked = hist.select("lang", "len", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("total"))
    at = lambda f: F.min(F.when(F.col("upto") > F.bround(F.lit(f) * (F.col("total") - 1)), F.col("len"))).alias(f"p{round(f * 100)}")
    beyond = [F.round(F.sum(F.when(F.col("len") > b, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias(f"over_{b}") for b in bounds]
    return ranked.groupBy("lang").agg(F.sum("n").alias("n"), at(0.5), at(0.9), at(0.99), *beyond)


def json_profile(df: DataFrame, column: str, group: str) -> DataFrame:
    """Per group: rows, nulls, texts that don't parse as JSON, objects, keys a row."""
    parsed = F.try_parse_json(column)
    keys = F.json_object_keys(column)
    return df.select(group, F.col(column).isNull().alias("null"), (F.col(column).isNotNull() & parsed.isNull()).alias("bad"), F.size(keys).alias("keys")).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("null").cast("int")).alias("nulls"), F.sum(F.col("bad").cast("int")).alias("unparsed"), F.sum(F.when(F.col("keys") >= 0, F.col("keys")).otherwise(0)).alias("keys")
    )
