"""Connected components of links between long ids, in DataFrame functions, cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.base import Workspace


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, comp) for every end of ``links(a, b)``; comp is the smallest node reachable.

    First every node's smaller neighbours are hung on the smallest of them (links that many nodes repeat
    become one).  Each round then gives a node the smallest label among its neighbours and then follows that label one
    step (pointer jumping), so a chain shortens by half and a star is done at once.  A node with very
    many links is one key of a join that adaptive execution can split, and of a minimum that is
    partially aggregated.  Labels go to the shared folder each round; nothing reaches the driver but a
    flag that says whether labels still change.
    """
    ordered = ws.table(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}_links")
    hung = ordered.join(ordered.groupBy("b").agg(F.min("a").alias("hub")), "b").select("hub", F.explode(F.array("a", "b")).alias("end")).filter("hub <> end").distinct()
    both = ws.table(hung.select(F.explode(F.array(F.struct(F.col("hub").alias("a"), F.col("end").alias("b")), F.struct(F.col("end").alias("a"), F.col("hub").alias("b")))).alias("e")).select("e.*"), f"{name}_edges")
    ws.drop(f"{name}_links")
    labels = ws.table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), f"{name}_0")
    k = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        new = step.join(jump, "via", "left").select("node", F.least("via", F.coalesce("far", "via")).alias("comp"), F.col("comp").alias("old"))
        k += 1
        written = ws.table(new, f"{name}_{k}")
        changed = not written.filter("comp <> old").isEmpty()
        ws.drop(f"{name}_{k - 1}")
        labels = written.drop("old")
        if not changed:
            ws.drop(f"{name}_edges")
            return labels
