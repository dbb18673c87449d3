"""Connected components of an edge table, by smallest labels that jump along themselves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.session import stage


def _united(batches):
    """The smallest node that each node's edges lead to."""
    above: dict[int, int] = {}

    def top(node: int) -> int:
        while above[node] != node:
            above[node] = node = above[above[node]]
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for node in (a, b):
                above.setdefault(node, node)
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], ["node", "label"]
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the staged ``edges`` (``a, b``); the label is the component's smallest node.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so a chain
    shortens by half at least. Every round is written to the shared folder; the driver sees one count. Edges that could
    as well be broadcast are united by one task.
    """
    if C.fits(edges):
        return stage(edges.select("a", "b").coalesce(1).mapInArrow(_united, "node long, label long"), "labels")
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        new = stage(
            step.join(jump, "next").select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")),
            "labels",
        )
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels
