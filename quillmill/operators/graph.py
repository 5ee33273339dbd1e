"""Connected components over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.runtime import cut_lineage


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id), edges(a, b) -> (id, root): the smallest id that each node reaches.

    Labels spread to neighbours and jump to the label of their label, so rounds usually grow with the logarithm of the
    diameter; each round is written to the checkpoint folder. Labels only fall, so rounds go on until none does, however
    long the chains are. Edges to nodes that are not given are kept.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("root").alias("near"))
        far = labels.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = cut_lineage(
            labels.join(near, labels.id == near.a, "left").join(far, "root", "left")
            .select("id", F.col("root").alias("old"), F.least("root", "near", "far").alias("root"))
        )
        labels = step.select("id", "root")
        if not step.where("old <> root").limit(1).count():
            return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
