"""What is done with near-duplicate clusters and other ties of rows: reports, splits that keep them whole, removal of what is near held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.columns import hash_fraction
from sievework.operators import minhash
from sievework.operators.components import connected_components
from sievework.operators.skew import first_per_key, lookup, shuffled
from sievework.session import cut


def report(df: DataFrame, id_col: str, text: Column, source: str = "source", threshold: float = minhash.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Per source: rows and clusters of two and more texts that it has part in, and of these the ones shared with another source; and, two by two, how many clusters sources share.

    Clusters are counted by texts, so copies of one text are no cluster. A source's clusters are reduced to (cluster, source) first.
    """
    rows = cut(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.unhex(F.md5(text)).alias("key")).join(shuffled(minhash.clusters(df, id_col, text, threshold)), "id"))
    several = rows.select("cluster", "key").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    inside = cut(lookup(rows, several, "cluster", "id", how="inner").groupBy("cluster", "source").agg(F.count(F.lit(1)).alias("rows")))
    shared = inside.groupBy("cluster").agg((F.count(F.lit(1)) > 1).alias("shared"))
    by_source = inside.join(shuffled(shared), "cluster").groupBy("source").agg(F.sum("rows").alias("rows_in_clusters"), F.count(F.lit(1)).alias("clusters"), F.sum(F.col("shared").cast("int")).alias("shared_clusters"))
    a, b = (inside.select("cluster", F.col("source").alias(f"source_{x}")) for x in "ab")
    return by_source, a.join(shuffled(b), "cluster").where("source_a < source_b").groupBy("source_a", "source_b").agg(F.count(F.lit(1)).alias("clusters"))  # sources of one cluster


def cluster_split(df: DataFrame, id_col: str, text: Column, domain: str, share: float = 0.1) -> DataFrame:
    """One split per cluster of a domain: id, cluster, side, alone (the side the row would have by itself). Clusters are those of the whole table, the least id of the
    domain's rows in a cluster being its key, so a row without near duplicates keeps the side of its own key. Rows without a text are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(domain), F.lit("")).alias("domain")).join(shuffled(minhash.clusters(df, id_col, text)), "id")
    rows = cut(rows.withColumn("unit", F.struct("domain", "cluster")))
    keys = first_per_key(rows, "unit", "id", "first")
    side = lambda key: F.when(hash_fraction(F.concat_ws("-", "domain", F.col(key).cast("string"))) < share, "test").otherwise("train")
    return lookup(rows, keys, "unit", "id").select("id", "domain", "cluster", side("first").alias("side"), side("id").alias("alone"))


def split_leakage(split: DataFrame) -> DataFrame:
    """Per domain: rows, clusters, rows that the cluster split moved, and clusters torn by the split of single rows and by the split given."""
    units = split.groupBy("domain", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("side") != F.col("alone")).cast("int")).alias("moved"), (F.min("alone") != F.max("alone")).alias("torn_alone"), (F.min("side") != F.max("side")).alias("torn"))
    return units.groupBy("domain").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum("moved").alias("moved"), F.sum(F.col("torn_alone").cast("int")).alias("torn_alone"), F.sum(F.col("torn").cast("int")).alias("torn"))


def without_held_out(df: DataFrame, id_col: str, text: Column, held: Column, threshold: float = minhash.THRESHOLD) -> DataFrame:
    """The verdict on every row: id, verdict: held (never removed), equal or near (its text equals or is near that of a held row, so it goes), else kept."""
    hits = minhash.near_any(df, id_col, held, text, threshold).select("id", "equal")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(held, F.lit(False)).alias("held")).join(hits, "id", "left")
    return rows.select("id", F.when(F.col("held"), "held").when(F.col("equal"), "equal").when(~F.col("equal"), "near").otherwise("kept").alias("verdict"))


def linked(df: DataFrame, id_col: str, relations: dict[str, Column]) -> DataFrame:
    """Groups of rows that share a key of any relation, and so on along chains: id, linked (the least id). A null or empty key joins nothing; id must be unique.

    A key's rows are tied to the first of them, so a key of many rows makes as many edges. Namespaces are the caller's: put them into the key.
    """
    edges = None
    for key in relations.values():
        keyed = cut(df.select(F.col(id_col).cast("bigint").alias("src"), key.cast("string").alias("key")).where("key <> ''").withColumn("key", F.unhex(F.md5("key"))))
        tied = lookup(keyed, first_per_key(keyed, "key", "src", "dst"), "key", "src", how="inner").select("src", "dst")
        edges = tied if edges is None else edges.unionByName(tied)
    found = connected_components(edges.where("src <> dst"))
    return df.select(F.col(id_col).cast("bigint").alias("node")).join(found, "node", "left").select(F.col("node").alias("id"), F.coalesce("component", "node").alias("linked"))
