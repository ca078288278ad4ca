"""Streams of events. The same functions take batch frames, so a stream's result can be held against a batch's."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievework.operators.running import running_sums
from sievework.session import new_folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a parquet file, or a folder of them, with the files' own schema; event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        folder, name = os.path.split(path)
        df = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        df = reader.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by window and type; what is later than the watermark is left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First event of each key; keys are forgotten when the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def error_streaks(events: DataFrame, least: int = 3) -> DataFrame:
    """A row when a user's run of errors ends that was at least so long, in order of ts and event_id.

    A batch frame is ordered whole, spread over range partitions. Of a stream, a user's state is one number, kept for good: a user's events of one
    micro-batch are put in order together, but those of a later micro-batch count as later, so a source out of order must be drained first.
    """
    if not events.isStreaming:
        return _bounded_streaks(events, least)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        out = []
        frames = [b[["ts", "event_id"]].assign(error=b.event_type == "error") for b in batches]  # one user comes in several frames
        for error in pd.concat(frames).sort_values(["ts", "event_id"]).error if frames else ():
            if error:
                run += 1
            else:
                if run >= least:
                    out.append(run)
                run = 0
        state.update((run,))
        if out:
            yield pd.DataFrame({"user_id": [key[0]] * len(out), "streak": out})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, streak bigint", "run bigint", "append", GroupStateTimeout.NoTimeout)


def _bounded_streaks(events: DataFrame, least: int) -> DataFrame:
    """Errors share a number with the run's other errors, the count of other events before them; the event that ends the run has the next."""
    error = F.coalesce(F.col("event_type") == "error", F.lit(False)).cast("int")
    rows = running_sums(events.select("user_id", "ts", "event_id", error.alias("error"), (1 - error).alias("other")), ["user_id"], [F.col("ts"), F.col("event_id")], {"others": "other"})
    runs = rows.groupBy("user_id", (F.col("others") - F.col("other")).alias("run")).agg(F.sum("error").alias("streak"), F.max("other").alias("ended"))
    return runs.where((F.col("streak") >= least) & (F.col("ended") == 1)).select("user_id", "streak")


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream until its source is used up, and read what it wrote. Each batch is written to a folder of its own, so a batch that is repeated after a failure replaces itself.

    In complete mode the last batch is the result.
    """
    spark = df.sparkSession
    base = new_folder(spark, "stream")
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        batches.append(number)

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], df.schema)
    whole = spark.read.schema(df.schema)
    return whole.parquet(f"{base}/out/batch={max(batches)}") if mode == "complete" else whole.parquet(*(f"{base}/out/batch={b}" for b in sorted(set(batches))))
