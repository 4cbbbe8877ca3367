"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrow.llm.common import cut, fewer, join_hot


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); the root is the least node of its component.

    Each round takes the least label among a node and its neighbours, then the label of that label,
    until none changes; each round's table is cut in the shared folder. No edges give no rows.
    ``edges`` are read three times and best a computed table.
    """
    rows = 2 * edges.count()
    both = cut(fewer(fewer(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b"), rows).distinct(), rows))
    labels = cut(fewer(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), rows))
    while True:
        near = fewer(join_hot(both, labels.withColumnRenamed("node", "b"), "b"), rows).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = cut(fewer(labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")), rows))
        over = lower.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = cut(fewer(join_hot(lower, over, "root", "left").select("node", F.coalesce("above", "root").alias("root"), "was"), rows))
        changed = jumped.filter("root <> was").limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels
