"""Corpus preparation in stages over ``documents``; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.llm.base import Workspace, aside, back, load
from chronolane.llm.decontaminate import decontaminate
from chronolane.llm.line_dedup import line_dedup
from chronolane.llm.mixing import mixed_shards
from chronolane.llm.near_dedup import near_dedup
from chronolane.llm.queries import TOXIC, toxicity_model
from chronolane.llm.toxicity import toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go; null and empty texts, which say nothing, have the score of a sentence without toxic words."""
    rows, renamed = aside(docs, "score")
    model = toxicity_model(rows, load(spark, sf_dir, "labels"))
    return back(toxicity(rows, model, with_text=True).filter(F.col("score") < TOXIC), docs.columns, renamed)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; every document stays, with what is left of its text (nothing of a null one)."""
    rows, renamed = aside(docs, "n_lines", "n_removed")
    return back(line_dedup(rows).withColumn("n_chars", F.length("text").cast("long")), docs.columns, renamed)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; texts without words are like nothing and stay, rows of one id go together."""
    return near_dedup(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark passages go."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by output shard, in random order, in the proportions of the source targets; see mixed_shards()."""
    return mixed_shards(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the result of mixed_shards(), a row per piece.

    Each stage keeps every column of its input with its values, whatever the names (n_chars follows the
    text), so extra columns reach the end; a result column of the last stage whose name is taken gets an
    underscore in front.  Null, empty and blank texts pass the first four stages and give no piece.  Repeated rows
    are documents each.  Texts may be as long as a row can be.  Without documents the result is empty,
    without labels nothing is toxic, without a benchmark nothing is contaminated.
    """
    ws, docs = Workspace(spark, "pipeline"), load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs


#: No SQL: the classifier and near-duplicate stages have none; the tests hold run() against a brute-force version.
ORACLE_SQL = None
