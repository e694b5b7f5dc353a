"""Connected components by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.llm.text import written


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges`` (columns ``a, b``): comp is the smallest node reachable.

    Each round takes the least label among neighbours and then the label's own label,
    so chains halve; labels and edges stay distributed, lineage is cut every round.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
        moved = written(least.join(up, "mid").select("node", "old", F.least("mid", "top").alias("comp")))
        labels = moved.select("node", "comp")
        if moved.filter(F.col("old") != F.col("comp")).limit(1).count() == 0:
            return labels
