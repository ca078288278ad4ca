"""Row transforms of texts: sentences, paragraphs, tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.skew import shuffled

_TOKENS = r"[a-z0-9]+"


def ascii_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({_TOKENS})"), 1))


def sentence_table(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, place (from 0), sentence."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, r"(?<=[.!?])\s+")).alias("place", "sentence")).where("trim(sentence) <> ''")


def support_sentences(df: DataFrame, id_col: str, text: str, question: str) -> DataFrame:
    """Of each row the sentence that shares most with the question: sum of idf of common tokens over the root of the sentence's tokens. id, place, score.

    idf is ln((N + 1) / (df + 1)) + 1 over all sentences; ties go to the earlier sentence, rows without a common token give none.
    """
    tokens = sentence_table(df, id_col, text).select("id", "place", ascii_tokens(F.col("sentence")).alias("tokens")).where("size(tokens) > 0")
    flat = tokens.select("id", "place", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    idf = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(tokens.agg(F.count(F.lit(1)).alias("total"))).select("token", (F.ln((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row
    asked = df.select(F.col(id_col).alias("id"), F.explode(ascii_tokens(F.col(question))).alias("token"))
    scores = flat.join(shuffled(asked), ["id", "token"]).join(shuffled(idf), "token").groupBy("id", "place").agg((F.sum("idf") / F.sqrt(F.first("n"))).alias("score"))
    return scores.groupBy("id").agg(F.min_by("place", F.struct(-F.round("score", 9), F.col("place"))).alias("place"), F.round(F.max("score"), 9).alias("score"))


def filled_paragraphs(df: DataFrame, id_col: str, text: str, target: int, most: int) -> DataFrame:
    """Paragraphs of each text in order until target characters (with two for each break) are there, stopping before most: id, paragraphs, chars."""
    blocks = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, r"\n\s*\n")).alias("place", "block")).select("id", "place", F.length(F.trim("block")).alias("len")).where("len > 0")
    w = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # the paragraphs of one text
    total = blocks.withColumns({"upto": F.sum(F.col("len") + 2).over(w), "i": F.row_number().over(w)})
    kept = total.where(((F.col("upto") - F.col("len") - 2) < target) & ((F.col("i") == 1) | (F.col("upto") <= most)))
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.col("len") + 2).alias("chars"))


def tool_calls(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """JSON objects with a tool on lines of their own: id, place (from 0), tool, arg, n."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text, F.lit(r'(\{"tool": [^\n\r]*\})'), 1)).alias("place", "call"))
    return lines.select("id", "place", F.get_json_object("call", "$.tool").alias("tool"), F.get_json_object("call", "$.arg").alias("arg"), F.expr("try_cast(get_json_object(call, '$.n') AS bigint)").alias("n")).where("tool IS NOT NULL")


def argument_pool(calls: DataFrame, k: int) -> DataFrame:
    """The k commonest arguments of each tool, ties by value: tool, arg, uses, rank."""
    n = calls.where("arg IS NOT NULL").groupBy("tool", "arg").agg(F.count(F.lit(1)).alias("uses"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("uses"), "arg"))).where(F.col("rank") <= k)


def turns(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Log lines "hh:mm:ss XX-0000 ..." of a text as turns: id, place, at, code, gap (seconds since the turn before)."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text, F.lit(r"([0-9]{2}:[0-9]{2}:[0-9]{2} [A-Z]{2}-[0-9]{4})"), 1)).alias("place", "line"))
    seconds = F.substring("line", 1, 2).cast("int") * 3600 + F.substring("line", 4, 2).cast("int") * 60 + F.substring("line", 7, 2).cast("int")
    t = lines.select("id", "place", F.substring("line", 1, 8).alias("at"), F.substring("line", 10, 7).alias("code"), seconds.alias("s"))
    return t.select("id", "place", "at", "code", (F.col("s") - F.lag("s").over(Window.partitionBy("id").orderBy("place"))).alias("gap"))
