"""Epochs of a mixed corpus: pools by type and source, weights, quotas by type, draws without repeats until a pool is used up, types interleaved."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import hash_fraction
from sievework.operators.running import running_sums
from sievework.operators.sampling import draw
from sievework.session import cut


@dataclass(frozen=True)
class SamplerConfig:
    """type_ratios: how types share an epoch; difficulty_weights take their place if given. source_weights: 1 for those not named; with a temperature, a source of n rows weighs
    n ** (1 / temperature) instead. source_caps: rows of a source that are used at most. epoch_size: by default all rows after caps. window: rows in which types are mixed.
    synthetic_ratio: share of a type's rows that comes from synthetic_sources, where it has both kinds."""

    type_ratios: dict[str, float] = field(default_factory=lambda: {"noul": 1.0, "choice": 1.0, "score": 1.0})
    difficulty_weights: dict[str, float] | None = None
    source_weights: dict[str, float] = field(default_factory=dict)
    source_caps: dict[str, int] = field(default_factory=dict)
    epoch_size: int | None = None
    window: int = 8
    temperature: float | None = None
    synthetic_sources: tuple[str, ...] = ()
    synthetic_ratio: float | None = None

    def __post_init__(self) -> None:
        if self.temperature is not None and self.temperature <= 0:
            raise ValueError("the temperature must be above 0: a source of n rows weighs n ** (1 / temperature)")

    @property
    def ratios(self) -> dict[str, float]:
        return self.difficulty_weights or self.type_ratios


def sampling_type() -> Column:
    """The type that a row is pooled by: the one it had before it was put into score form."""
    return F.coalesce(F.nullif(F.col("score_form.source_type"), F.lit("")), F.col("q_type"), F.lit("noul"))


def pools(df: DataFrame, config: SamplerConfig, seed: int = 42) -> DataFrame:
    """Rows that may be drawn: row_no, kind, source. A source with a cap keeps so many of each type, drawn by hash. A null source is the empty one."""
    rows = df.select("row_no", sampling_type().alias("kind"), F.coalesce("source", F.lit("")).alias("source"))
    if not config.source_caps:
        return rows
    capped = rows.where(F.col("source").isin(*config.source_caps)).withColumn("d", draw(seed, "row_no"))
    cap = F.lit(None)
    for name, n in config.source_caps.items():
        cap = F.when(F.col("source") == name, n).otherwise(cap)
    ranked = running_sums(capped, ["kind", "source"], [F.col("d"), F.col("row_no")], {}).where(F.col("_n") <= cap)
    return rows.where(~F.col("source").isin(*config.source_caps)).unionByName(ranked.select("row_no", "kind", "source"))


def weights(pooled: DataFrame, config: SamplerConfig) -> DataFrame:
    """Per type and source: size, weight, share of the type's draws. Sources are few; a type's are in one window."""
    n = pooled.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("size"))
    if config.temperature is not None:
        w = F.pow("size", F.lit(1 / config.temperature))
    else:
        w = F.lit(1.0)
        for name, x in config.source_weights.items():
            w = F.when(F.col("source") == name, float(x)).otherwise(w)
    return n.withColumn("weight", w).withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("kind")))


def type_quotas(kinds: list[str], config: SamplerConfig, total: int) -> dict[str, int]:
    """Rows of an epoch for each type, in order of name: its share rounded down, the last type takes what is left; none without a ratio."""
    whole, left, out = sum(config.ratios.get(k, 0.0) for k in kinds), total, {}
    for i, kind in enumerate(sorted(kinds)):
        ratio = config.ratios.get(kind, 0.0)
        if ratio > 0 and whole > 0:
            out[kind] = left if i == len(kinds) - 1 else int(total * ratio / whole)
            left -= out[kind]
    return out


def epoch(df: DataFrame, config: SamplerConfig, number: int = 0, seed: int = 42) -> DataFrame:
    """The rows of an epoch in order: place (from 1), kind, source, row_no.

    Each of a type's slots draws a source by its weight, by hash. The slots of a source take its rows in an order drawn by hash, a new one each time the
    pool is used up, so rows repeat only as often as they must. Types are spread evenly, then mixed inside windows. Slots and rows meet by rank:
    ranks are running sums over range partitions, so a pool of any size is spread out. The driver holds the types' names.
    """
    pooled = cut(pools(df, config, seed))
    by_source = cut(weights(pooled, config))
    total = config.epoch_size if config.epoch_size is not None else pooled.count()
    quotas = type_quotas([r[0] for r in by_source.select("kind").distinct().toLocalIterator()], config, total)
    spark = df.sparkSession
    slots = spark.createDataFrame([], "kind string, i bigint, quota bigint")
    for kind, n in quotas.items():
        slots = slots.unionByName(spark.range(n).select(F.lit(kind).alias("kind"), F.col("id").alias("i"), F.lit(n).cast("bigint").alias("quota")))
    part = F.when(F.col("source").isin(*config.synthetic_sources), "synthetic").otherwise("other") if config.synthetic_ratio is not None and config.synthetic_sources else F.lit("all")
    parted = by_source.withColumn("part", part)
    both = parted.groupBy("kind").agg((F.count_distinct("part") > 1).alias("both"))
    parted = parted.join(both, "kind").withColumn("part", F.when(F.col("both"), F.col("part")).otherwise("all"))
    w = Window.partitionBy("kind", "part").orderBy("source")
    upto = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(Window.partitionBy("kind", "part"))
    ranges = parted.withColumns({"high": upto, "last": F.max("source").over(Window.partitionBy("kind", "part")) == F.col("source")}).withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0.0)))
    mine = F.when(~F.col("both"), "all").when(F.col("i") < F.floor(F.col("quota") * F.lit(config.synthetic_ratio or 0.0)), "synthetic").otherwise("other")
    u = hash_fraction(F.concat_ws(":", F.lit(f"{seed}:{number}"), "kind", F.col("i").cast("string")))
    asked = slots.join(both, "kind").select("kind", "i", "quota", mine.alias("part"), u.alias("u"))
    chosen = asked.join(ranges.select("kind", "part", "source", "size", "low", "high", "last"), ["kind", "part"]).where((F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | F.col("last")))
    drawn = cut(running_sums(chosen.select("kind", "i", "quota", "source", "size"), ["kind", "source"], [F.col("i")], {}).withColumns({"lap": F.floor((F.col("_n") - 1) / F.col("size")), "r": F.pmod(F.col("_n") - 1, F.col("size")) + 1}))
    laps = drawn.groupBy("kind", "source").agg(F.max("lap").alias("laps"))
    dealt = pooled.join(laps, ["kind", "source"]).select("kind", "source", "row_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("laps"))).alias("lap"))
    shuffled = dealt.withColumn("d", F.md5(F.concat_ws(":", F.lit(f"{seed}:{number}"), F.col("lap").cast("string"), F.col("row_no").cast("string"))))
    ranked = running_sums(shuffled, ["kind", "source", "lap"], [F.col("d"), F.col("row_no")], {}).select("kind", "source", "lap", F.col("_n").alias("r"), "row_no")
    rows = drawn.select("kind", "source", "lap", "r", "i", "quota").join(ranked, ["kind", "source", "lap", "r"])
    spread = running_sums(rows.select("kind", "source", "row_no", "i", ((F.col("i") + 0.5) / F.col("quota")).alias("t")), [], [F.col("t"), F.col("kind")], {}).withColumn("window", F.floor((F.col("_n") - 1) / config.window))
    inside = Window.partitionBy("window").orderBy(F.md5(F.concat_ws(":", F.lit(f"{seed}:{number}:mix"), "kind", F.col("i").cast("string"))))  # the rows of one window
    return spread.select((F.col("window") * config.window + F.row_number().over(inside)).alias("place"), "kind", "source", "row_no")
