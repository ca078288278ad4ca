"""Sessions and the shared folder for checkpoints."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sievework")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and all runs in one process, as in tests, a folder of this machine.

    Also makes it the context's checkpoint folder, once.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), f"sievework-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder: what follows neither repeats df's work nor needs its executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses; tidy() removes it."""
    path = os.path.join(shared_folder(spark), f"{kind}-{uuid.uuid4().hex}")
    _written.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table: for wide rows, which take less disk so. tidy() removes it."""
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver collect what nothing refers to any more. Spark then removes the shuffle files behind it, which else stay on disk until the driver happens to be short of memory."""
    gc.collect()
    spark._jvm.System.gc()


def qualified(spark: SparkSession, path: str) -> str:
    """A path of the shared folder as a URI that pyarrow reads on any machine."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("s3a://", "s3://", 1)


def tidy(spark: SparkSession) -> None:
    """Remove what operators wrote to the shared folder, once the results made of it have been read. Checkpoints are Spark's own to clean."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once; they need it whatever their working folder is."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sievework-")) / "sievework_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(package.rglob("*.py")):
            packed.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
