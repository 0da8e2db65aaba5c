"""Connected components of a table of links, as joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import saved
from episcope.session import ship_package


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a batch as a forest with the same components: a node and the smallest of its tree."""
    for batch in batches:
        parent: dict = {}

        def root(x, parent=parent):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in parent]
        left = [x for x, r in found if x != r]
        right = [r for x, r in found if x != r]
        kind = batch.schema[0].type
        yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], names=["x", "y"])


def components(links: DataFrame, a: str = "a", b: str = "b", native: bool = False) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``links``.

    Each round takes the smallest label among a node's neighbours, then follows labels twice, so long
    chains shorten by a factor each round. Rounds are written to the shared folder. ``native`` leaves out
    the step in Python that thins the links.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    if not native:
        ship_package(links.sparkSession)
        both = both.mapInArrow(_forest, both.schema)  # fewer links than nodes, per batch
    both = saved(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("label"))
    labels = saved(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node"))
        new = near.agg(F.min("label").alias("near")).join(labels.withColumnRenamed("label", "old"), "node")
        new = new.select("node", "old", F.least("old", "near").alias("label"))
        for _ in range(2):
            over = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            new = new.join(over, "label").select("node", "old", F.least("label", "next").alias("label"))
        new = saved(new, "labels")
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels
