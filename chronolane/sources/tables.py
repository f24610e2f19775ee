"""Readers and writers of tables: tracking files, lookups, session documents, manifests."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.schema import TRACKING, nan_to_null, with_optional


def read_tracking(spark: SparkSession, path: str, schema: T.StructType = TRACKING, recursive: bool = False, glob: str = "*_tracking*.csv") -> DataFrame:
    """Tracking files with a fixed schema; missing columns are typed NULLs, NaN is NULL; ``source_file`` says where a row is from."""
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("enforceSchema", False).option("pathGlobFilter", glob)
    rows = reader.option("recursiveFileLookup", recursive).csv(path)
    typed = rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema if f.name in rows.columns], F.col("_metadata.file_name").alias("source_file"))
    return nan_to_null(with_optional(typed, schema))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A lookup of strings: a byte order mark and blanks around names and values go, empty values are NULL."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    clean = [(c, c.replace("﻿", "").strip()) for c in raw.columns]
    return raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in clean])


def read_sessions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A document of sessions as rows: session and a struct of ``kind``; keys that begin with "_" are comments; a bare NaN is NaN."""
    doc = spark.read.text(path, wholetext=True)
    opened = doc.select(F.explode(F.from_json("value", f"map<string,{kind}>", {"allowNonNumericNumbers": "true"})).alias("session", "config"))
    return opened.filter(~F.col("session").startswith("_"))


def write_csv(df: DataFrame, path: str, decimals: int | None = None, overwrite: bool = False) -> None:
    """CSV with a header, doubles to a fixed number of decimals if asked; refuses to replace unless told to."""
    if decimals is not None:
        df = df.select(*[F.format_string(f"%.{decimals}f", c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


#: Types that Arrow and Spark write to Parquet alike.
PLAIN = re.compile(r"(tinyint|smallint|int|bigint|float|double|boolean|string|date|timestamp|timestamp_ntz|decimal\(\d+,\d+\))")


def write_by(df: DataFrame, path: str, keys: list[str], overwrite: bool = False) -> None:
    """Parquet, one directory per combination of keys; rows are dealt by them first, so files don't multiply.

    A new folder of a local file system is written by Arrow within the tasks, as Hadoop starts three processes
    a directory there to set permissions; all else (other file systems, nested or binary columns, a folder that exists) by Spark's writer.
    """
    where = _local(df.sparkSession, path)
    rest = [c for c in df.columns if c not in keys]
    plain = len({"_at"} | {c.lower() for c in df.columns}) == 1 + len(rest) + len(keys) == 1 + len(df.columns) and all(PLAIN.fullmatch(k) for _, k in df.dtypes)
    if where and rest and plain and not os.path.lexists(where):
        _write_new(df, where, keys, rest)
    else:
        df.repartition(*keys).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*keys).parquet(path)


def read_by(spark: SparkSession, path: str, schema: str, keys: dict[str, str]) -> DataFrame:
    """Directories of keys (name: type, outermost first) as a table of ``schema`` and the keys.

    The keys are taken from the paths of the files, as Spark's own search for partitions takes time quadratic in
    directories.  These are listed by a few tasks a core, not by a task each.
    """
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    finally:
        spark.conf.set(setting, before)
    plain = lambda text: F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    folders = "/[^/=]*=([^/]*)" * len(keys) + "/[^/]*$"
    text = {k: F.regexp_extract(plain(F.col("_metadata.file_path")), folders, n) for n, k in enumerate(keys, 1)}
    return rows.select("*", *[plain(F.nullif(text[k], F.lit("__HIVE_DEFAULT_PARTITION__"))).cast(kind).alias(k) for k, kind in keys.items()])


def _local(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder of the local file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(at).toUri().getPath() if system.getScheme() == "file" else None


def _write_new(df: DataFrame, path: str, keys: list[str], rest: list[str]) -> None:
    """Each attempt of a task writes into a folder of its own beside ``path``; those of the attempts that count become ``path`` by one rename."""
    staged = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = uuid.uuid4().hex
        last = out = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).drop_columns("_at")
            runs, begin = pc.run_end_encode(batch["_at"], run_end_type=pa.int64()), 0
            for at, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if at != last:
                    if out:
                        out.close()
                    folder = f"{staged}/{own}/{directory(keys, json.loads(at))}"
                    os.makedirs(folder)
                    last, out = at, pq.ParquetWriter(f"{folder}/part-{own}.snappy.parquet", rows.schema, store_schema=False, write_page_checksum=True)
                out.write_table(rows.slice(begin, end - begin))
                begin = end
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"attempt": [own]})

    # dealt by the text of the keys, as it makes the directory: each is written by one task
    at = F.to_json(F.array(*[F.nullif(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys]))
    sorted_rows = df.select(*[F.col(f"`{c}`") for c in rest], at.alias("_at")).repartition("_at").sortWithinPartitions("_at")
    try:
        os.makedirs(f"{staged}/whole")
        for attempt in sorted_rows.mapInArrow(write, "attempt string").collect():
            _merge(f"{staged}/{attempt.attempt}", f"{staged}/whole")
        open(f"{staged}/whole/_SUCCESS", "x").close()
        os.rename(f"{staged}/whole", path)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def directory(keys: list[str], values: list[str | None]) -> str:
    """The folder of a combination of keys as Spark names it."""
    escaped = [[re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{[\]^]""", lambda m: f"%{ord(m[0]):02X}", text or "") for text in pair] for pair in zip(keys, values, strict=True)]
    return "/".join(f"{k}={v or '__HIVE_DEFAULT_PARTITION__'}" for k, v in escaped)


def _merge(folder: str, into: str) -> None:
    """The entries of one folder moved into another; the folders of some keys may be in both."""
    for entry in os.scandir(folder):
        if os.path.isdir(to := f"{into}/{entry.name}"):
            _merge(entry.path, to)
        else:
            os.rename(entry.path, to)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed(now: DataFrame, then: DataFrame) -> DataFrame:
    """Files that were added, removed or changed between two manifests."""
    both = now.select("path", F.col("sha256").alias("now")).join(then.select("path", F.col("sha256").alias("then")), "path", "full")
    return both.filter(~F.col("now").eqNullSafe(F.col("then"))).withColumn("change", F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed"))


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of a report folder: the sessions that are finished, and the run that wrote each."""
    ledger = f"{path}/finished"
    return spark.read.schema("session string, run string").parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], "session string, run string")


def write_reports(docs: DataFrame, path: str, again: str = "skip") -> DataFrame:
    """One JSON document per session (column ``session``, the other columns nested in it) under ``path``; returns the sessions written.

    A run writes its documents into a folder of its own and then, as the last step, its sessions into the
    ledger: only what the ledger names counts, so a run that fails anywhere leaves nothing.  Sessions in the ledger are
    skipped; ``again="refuse"`` raises FileExistsError if there is one, ``again="replace"`` writes it anew,
    and the ledger's newest run holds.  A session that occurs twice in ``docs``, or has no name, is an error.
    """
    spark, run = docs.sparkSession, f"{uuid.uuid1().time:020d}"
    done = finished(spark, path)
    if again == "refuse" and (met := docs.join(done.select("session").distinct(), "session", "left_semi").select("session").head()):
        raise FileExistsError(f"session {met.session} is finished")
    todo = docs if again == "replace" else pending(docs, done, ["session"])
    wrong = F.col("session").isNull() | (F.col("_n") > 1)
    counted = todo.groupBy("session").agg(F.count("*").alias("_n"))
    if bad := counted.filter(wrong).head():
        raise ValueError(f"session {bad.session} occurs {bad._n} times")
    folder = f"{path}/run={run}"
    body = F.to_json(F.struct(*[c for c in todo.columns if c != "session"]), {"ignoreNullFields": "false"})
    todo.select("session", body.alias("value")).repartition("session").write.mode("errorifexists").partitionBy("session").text(folder)
    if not exists(spark, f"{folder}/_SUCCESS"):
        raise OSError(f"{folder} is not complete")
    mine = counted.select("session", F.lit(run).alias("run"))
    mine.write.mode("append").parquet(f"{path}/finished")
    return finished(spark, path).filter(F.col("run") == run)


def read_reports(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The finished documents: session and a struct of ``kind``, of each session the newest."""
    newest = finished(spark, path).groupBy("session").agg(F.max("run").alias("run"))
    if not exists(spark, f"{path}/finished"):
        return newest.select("session", F.from_json(F.lit(None).cast("string"), kind).alias("report"))
    raw = spark.read.option("basePath", path).option("wholetext", True).schema("value string, run string, session string").text(f"{path}/run=*")
    return raw.join(newest, ["session", "run"]).select("session", F.from_json("value", kind).alias("report"))
