"""Mixing sources to target weights (problem 7).

Method: Poisson replication. Each text has a hash-seeded uniform number u; its repeats are the inverse of a Poisson
distribution function at u, capped. The mean of each source is found so that the tokens that the seeds really give,
not only those expected, come to the source's share. The chosen texts are exploded by their repeats and shuffled globally.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.forms import form, form_column, token_count_column
from sievework.session import cut

#: Bins of u. A source's tokens are known by bin, so its total for any mean is exact when thresholds lie on bin edges.
BINS = 1 << 14


@dataclass(frozen=True)
class Plan:
    """For a source: the target share, tokens there are, tokens meant, the Poisson mean, and the ascending thresholds of u: a text is used once for each that lies below its u."""

    source: str
    share: float
    max_repeats: int
    tokens: int
    goal: float
    mean: float
    thresholds: tuple[float, ...]


def poisson_thresholds(mean: float, most: int) -> list[float]:
    """F(0)..F(most-1) of the Poisson distribution, on bin edges. Inverting it at u gives as many repeats as thresholds lie at or below u, at most most."""
    if mean == math.inf:
        return [0.0] * most
    out, term, total = [], math.exp(-mean), 0.0
    for k in range(most):
        total += term
        out.append(min(BINS, round(total * BINS)) / BINS)
        term *= mean / (k + 1)
    return out


def realised(by_bin: np.ndarray, thresholds: list[float]) -> float:
    """Tokens that a source gives; by_bin: its tokens by bin of u."""
    tail = np.concatenate([np.cumsum(by_bin[::-1])[::-1], [0]])
    return float(sum(tail[round(t * BINS)] for t in thresholds))


def calibrate(by_bin: np.ndarray, goal: float, most: int) -> tuple[float, list[float]]:
    """The mean at which a source's repeats come closest to goal tokens."""
    if goal <= 0 or not by_bin.sum() or most < 1:
        return 0.0, [1.0] * max(0, most)
    if goal >= most * by_bin.sum():
        return math.inf, [0.0] * most
    low, high = 0.0, 1.0
    while realised(by_bin, poisson_thresholds(high, most)) < goal and high < 700:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if realised(by_bin, poisson_thresholds(mid, most)) < goal else (low, mid)
    mean = min((low, high), key=lambda m: abs(realised(by_bin, poisson_thresholds(m, most)) - goal))
    return mean, poisson_thresholds(mean, most)


def _seed(id_col: str, text_col: str, seed: int) -> Column:
    """A text's uniform number as a bin. Copies of a text under one id share it."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)), F.lit(BINS))


def fill_shares(shares: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """Tokens for each source: in proportion to the shares, none above its most, with the sum total if the mosts allow it."""
    goals, open_ = dict.fromkeys(shares, 0.0), {name for name in shares if most[name] > 0}
    while open_:
        left = total - sum(goals[name] for name in shares if name not in open_)
        whole = sum(shares[name] for name in open_)
        full = {name for name in open_ if left * shares[name] / whole >= most[name]}
        for name in full or open_:
            goals[name] = min(most[name], left * shares[name] / whole)
        if not full:
            break
        open_ -= full
    return goals


def largest_exact(plans: list[Plan]) -> float:
    """The largest total at which every source that has tokens gives its whole share."""
    live = [p for p in plans if p.tokens and p.max_repeats > 0]
    return min((p.max_repeats * p.tokens * sum(q.share for q in live) / p.share for p in live), default=0.0)


def plan_mix(df: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Plan]:
    """The Poisson means of the target sources, which are few; targets: source, target_share, max_repeats.

    total_tokens: size of the mix; by default the tokens that the target sources have. A source whose share is more than max_repeats
    times its tokens gives those, one without tokens nothing; what they lack is shared out to the others by their shares, so the mix
    keeps its size while any source has room. shares() reports what came of it. largest_exact() is the size up to which nothing lacks.
    Sources are compared by form.
    Targets of one form are added up, with the smaller cap.
    """
    wanted: dict[str, tuple[float, int]] = {}
    for row in targets.select("source", "target_share", "max_repeats").toLocalIterator():
        name, share, most = form(row[0]), row[1] or 0.0, row[2] or 0
        if name and share > 0:
            old = wanted.get(name)
            wanted[name] = (share + (old[0] if old else 0), min(most, old[1]) if old else most)
    seeded = df.select(form_column(source_col).alias("source"), _seed(id_col, text_col, seed).alias("bin"), token_count_column(text_col).alias("tokens"))
    # keyed by source and bin: at most the targets times BINS rows come back
    sums = seeded.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)).groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"))
    by_bin = {name: np.zeros(BINS) for name in wanted}
    for name, at, tokens in sums.toLocalIterator():
        by_bin[name][at] = tokens
    there = {name: float(tokens.sum()) for name, tokens in by_bin.items()}
    if total_tokens is None:
        total_tokens = sum(there.values())
    goals = fill_shares({name: share for name, (share, _) in wanted.items()}, {name: there[name] * max(0, most) for name, (_, most) in wanted.items()}, total_tokens)
    plans = []
    for name, (share, most) in sorted(wanted.items()):
        mean, thresholds = calibrate(by_bin[name], goals[name], most)
        plans.append(Plan(name, share, most, int(there[name]), goals[name], mean, tuple(thresholds)))
    return plans


def mix(df: DataFrame, plans: list[Plan], seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The chosen texts, a row for each use, in global random order.

    Columns: position_key (order by it), doc_id, source (its form), copy (from 0), repeats, tokens, text.
    A text without tokens, without a source or with a source that isn't a target is not chosen. Rows with equal ids are texts of their own.
    position_key is a hash of id, copy and seed, even over its range: partitions are equal stretches of it, each sorted. Nothing is sampled to find them,
    and no partition depends on a source's size.
    """
    used = [p for p in plans if p.thresholds and p.goal > 0]
    repeats = F.lit(0)
    for p in used:
        repeats = F.when(F.col("source") == p.source, sum((F.col("bin") >= round(t * BINS)).cast("int") for t in p.thresholds)).otherwise(repeats)
    chosen = (
        df.select(F.col(id_col).alias("doc_id"), form_column(source_col).alias("source"), F.col(text_col).alias("text"), _seed(id_col, text_col, seed).alias("bin"))
        .where(F.col("source").isin([p.source for p in used]) if used else F.lit(False))
        .withColumn("repeats", repeats)
        .where("repeats > 0")
        .withColumn("tokens", token_count_column("text"))
        .where("tokens > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
        .withColumn("position_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy", F.length("text")))
    )
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.least(F.floor((F.col("position_key") / 2.0**64 + 0.5) * partitions), F.lit(partitions - 1)).cast("int")
    return chosen.select("position_key", "doc_id", "source", "copy", "repeats", "tokens", "text").repartitionById(partitions, stretch).sortWithinPartitions("position_key", "doc_id", "copy")


def shares(df: DataFrame, plans: list[Plan], seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per target: source, target_share, max_repeats, tokens there are, Poisson mean, tokens used, texts, most repeats, actual share."""
    spark = df.sparkSession
    mixed = mix(df, plans, seed, id_col, text_col, source_col)
    used = cut(mixed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.sum((F.col("copy") == 0).cast("int")).alias("texts"), F.max("repeats").alias("most_repeats")))
    rows = [(p.source, p.share, p.max_repeats, p.tokens, p.goal, p.mean) for p in plans]
    target = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, source_tokens bigint, goal_tokens double, mean_repeats double")
    total = used.agg(F.sum("used_tokens").alias("total"))
    return (
        target.join(used, "source", "left")
        .crossJoin(total)  # one row
        .select("source", "target_share", "max_repeats", "source_tokens", "goal_tokens", "mean_repeats", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (F.coalesce("used_tokens", F.lit(0)) / F.col("total")).alias("actual_share"))
    )
