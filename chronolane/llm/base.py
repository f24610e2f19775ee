"""Shared plumbing: the session's shared folder, tables written to cut lineage, table loading."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``; where it is unset, in local mode only, a new one is set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, written as Parquet under the shared folder.

    A table that was written is read back from the shared folder, so a lost executor costs no
    recomputation of what came before it and plans stay short in loops.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near ``names`` that ``df`` doesn't have (any case), so inputs may carry any extra columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` whose columns of these names (any case) are renamed, and the new name of each; back() undoes it."""
    clash = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    new = {}
    for c in clash:
        name = f"_{c}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        new[c] = name
    return df.withColumnsRenamed(new), new


def back(df: DataFrame, columns: list[str], renamed: dict[str, str]) -> DataFrame:
    """The columns that a table had before aside(), in its order."""
    return df.select(*[F.col(renamed.get(c, c)).alias(c) for c in columns])


def packed(table: pa.Table) -> bytes:
    """A table as one compressed value; unpacked() reads it."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> pa.Table:
    with pa.ipc.open_stream(raw) as f:
        return f.read_all().combine_chunks()
