"""Schemas, and readers and writers of JSON lines, archives, logs and pinned files."""

from __future__ import annotations

import fnmatch
import io
import json
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPTION = "struct<key:string,text:string>"
#: A typed question as it lies in JSON lines.
QUESTION_DDL = (
    f"id string, state string, q_type string, instructions string, options array<{_OPTION}>, levels array<string>, augmented_options array<{_OPTION}>, "
    "label_bool boolean, label_key string, label_level double, source string, split string, group_key string, "
    "teacher_probs map<string,map<string,double>>, teacher_name string, answerable boolean, reason string, provenance string, label_kind string, "
    "score_form struct<source_type:string,encoding:string,parent_id:string,candidate:string,option_keys:array<string>>, corpus string, priority int, pos bigint"
)
PREDICTION_DDL = "item_id string, run_name string, q_type string, label_bool boolean, label_key string, label_level double, probs array<double>, option_keys array<string>, source string, schema_key string, tier string"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def read_questions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines, strictly: a line that doesn't parse fails the job."""
    return spark.read.schema(schema(QUESTION_DDL)).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files as they are: file, line_no (from 1), line. Files are read whole, a file by one task, as line numbers need."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _numbered(where, "", 1, [x.decode("utf-8", "replace") for x in content.splitlines()], ["file", "member", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "file string, member string, line_no bigint, line string").drop("member")


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Where JSON lines don't parse: file, line_no, line. Blank lines are no error."""
    return numbered_lines(spark, path).where((F.trim("line") != "") & F.try_parse_json("line").isNull())


def sharded(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All shards of a table in a folder, columns by name, a column that some shards lack null there; file is where a row came from."""
    return spark.read.option("mergeSchema", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder).withColumn("file", F.col("_metadata.file_name"))


def load_all(loaders: dict[str, DataFrame], wanted: list[str] | None = None) -> DataFrame:
    """The wanted corpora in the order asked for (all, if none are named). A name that isn't known is an error that says which are."""
    names = list(loaders) if wanted is None else wanted
    unknown = [n for n in names if n not in loaders]
    if unknown:
        raise ValueError(f"unknown sources {unknown}; there are {sorted(loaders)}")
    return ordered_union(*((n, loaders[n]) for n in names))


def coverage(df: DataFrame, expected: list[str]) -> DataFrame:
    """Each expected corpus with its rows, 0 for those that are missing: corpus, n, missing."""
    there = df.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    named = df.sparkSession.createDataFrame([(e,) for e in expected], "corpus string")
    return named.join(there, "corpus", "left").select("corpus", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def file_kind(name: Column | str) -> Column:
    """What a corpus file holds, by its name: probs, families, variants, confounders, labels, else typed."""
    c = F.element_at(F.split(F.col(name) if isinstance(name, str) else name, "/"), -1)
    out = F.when(c.startswith("base_probs"), "probs")
    for ending, kind in (("_families", "families"), ("_variants", "variants"), ("_llm_confounders", "confounders"), ("_labels", "labels")):
        out = out.when(c.endswith(f"{ending}.jsonl"), kind)
    return out.otherwise("typed")


def check_lock(lock: dict) -> dict[str, dict]:
    """The files of a lock: repository, revision and for each file its sha256 and bytes, or an error that names what is wrong."""
    for key in ("repo", "revision", "files"):
        if not lock.get(key):
            raise ValueError(f"the lock has no {key}")
    if not re.fullmatch(r"[0-9a-f]{40}", str(lock["revision"])):
        raise ValueError("the revision isn't a full commit")
    for name, entry in lock["files"].items():
        if not re.fullmatch(r"[0-9a-f]{64}", str(entry.get("sha256", ""))) or not isinstance(entry.get("bytes"), int) or entry["bytes"] < 0:
            raise ValueError(f"{name}: needs a sha256 and a number of bytes")
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name}: leaves the folder")
    return lock["files"]


def select_files(files: dict[str, dict], patterns: list[str] | None) -> dict[str, dict]:
    """Files whose name fits a pattern, all without patterns. A pattern that fits none is an error."""
    if not patterns:
        return dict(files)
    for p in patterns:
        if not any(fnmatch.fnmatchcase(n, p) for n in files):
            raise ValueError(f"nothing fits {p!r}")
    return {n: e for n, e in files.items() if any(fnmatch.fnmatchcase(n, p) for p in patterns)}


def merged_shards(parts: list[DataFrame], key: str) -> DataFrame:
    """Parts of a sharded run in one, with part; an error if a key lies in two of them or twice in one."""
    whole = reduce(lambda a, b: a.unionByName(b), (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))
    twice = whole.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys in several parts: {[r[0] for r in twice]}")
    return whole


def profile_questions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per file: lines, lines that don't parse, blank lines, distinct ids. Nothing fails."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    parsed = lines.withColumn("ok", F.try_parse_json("line").isNotNull()).withColumn("id", F.get_json_object("line", "$.id"))
    blank = F.trim("line") == ""
    return parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.sum((~F.col("ok") & ~blank).cast("int")).alias("bad"), F.sum(blank.cast("int")).alias("blank"), F.countDistinct(F.when(F.col("ok"), F.col("id"))).alias("ids")
    )


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines without null fields. A row of nulls is an empty object."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def ordered_union(*corpora: tuple[str, DataFrame]) -> DataFrame:
    """All corpora, with corpus, priority (from 1, in the order given) and what place a row had as pos, if it has none."""
    parts = []
    for i, (name, df) in enumerate(corpora, 1):
        df = df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())
        parts.append(df.withColumn("corpus", F.lit(name)).withColumn("priority", F.lit(i)))
    if not parts:
        raise ValueError("no corpus was given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_sources(configured: DataFrame, df: DataFrame) -> DataFrame:
    """Configured sources (source, allow_missing) without a row, unless they may be missing."""
    return configured.where(~F.coalesce("allow_missing", F.lit(False))).join(df.select("source").distinct(), "source", "left_anti").select("source")


def read_zipped_lines(spark: SparkSession, path: str, pattern: str = ".jsonl") -> DataFrame:
    """Lines of the members of zip archives: archive, member, line_no, line. An archive is read by one task, member by member, line by line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "member", "line_no", "line"]
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if not member.endswith(pattern):
                            continue
                        held: list[str] = []
                        first = 1
                        with archive.open(member) as f:
                            for raw in f:
                                held.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                                if len(held) == 10_000:
                                    yield _numbered(where, member, first, held, names)
                                    first, held = first + len(held), []
                        if held:
                            yield _numbered(where, member, first, held, names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "archive string, member string, line_no bigint, line string")


def _numbered(where: str, member: str, first: int, held: list[str], names: list[str]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([where] * n), pa.array([member] * n), pa.array(range(first, first + n), pa.int64()), pa.array(held)], names=names)


def verify_files(spark: SparkSession, path: str, lock: DataFrame) -> DataFrame:
    """Files against a lock (name, bytes, sha256): name and verdict: ok, size, digest, missing or unlisted."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("real_bytes"), F.sha2("content", 256).alias("real_sha256"))
    both = lock.join(there, "name", "full")
    verdict = F.when(F.col("sha256").isNull(), "unlisted").when(F.col("real_sha256").isNull(), "missing").when(F.col("bytes") != F.col("real_bytes"), "size").when(F.col("sha256") != F.col("real_sha256"), "digest").otherwise("ok")
    return both.select("name", verdict.alias("verdict"))


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines "epoch N ... name=value ..." of run logs as rows: file, epoch, name, value."""
    text = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    found = text.select("file", F.regexp_extract("value", r"epoch\s+(\d+)", 1).alias("epoch"), F.expr(r"regexp_extract_all(value, '(\\w+)=([-+.\\deE]+)', 0)").alias("pairs")).where("epoch <> ''")
    return found.select("file", F.col("epoch").cast("int").alias("epoch"), F.explode("pairs").alias("pair")).select("file", "epoch", F.split("pair", "=")[0].alias("name"), F.expr("try_cast(split(pair, '=')[1] AS double)").alias("value"))


def rendered_state(column: Column | str) -> Column:
    """A state as text: a JSON object or array indented by two, anything else as it is. Null stays null."""

    @F.arrow_udf("string")
    def render(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            if v is not None and v.lstrip()[:1] in ("{", "["):
                try:
                    v = json.dumps(json.loads(v), indent=2, ensure_ascii=False)
                except ValueError:
                    pass
            out.append(v)
        return pa.array(out, pa.string())

    return render(F.col(column) if isinstance(column, str) else column)
