"""Connected components of a table of links, by least labels and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import drop, shuffled, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node and label, the least node reachable, for every node that has a link.

    Each round takes the least label of a node's neighbours and then the label of that label, so a chain of n links needs
    about log n rounds; each round is written to the shared folder."""
    edges = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    edges = written(edges, "edges")
    table = labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(shuffled(labels), edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(shuffled(near), labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid"))
        above = labels.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        moved = written(stepped.join(shuffled(above), "mid", "left").select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("label")), "labels")
        changed = moved.where("old != label").limit(1).count()
        drop(table)
        table, labels = moved, moved.select("node", "label")
        if not changed:
            return labels
