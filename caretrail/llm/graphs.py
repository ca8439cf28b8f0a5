"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches) of every node of the links (a, b).

    Smallest labels pass along the links and then along labels (pointer jumping), until nothing changes.
    """
    both = checkpointed(links.select(F.explode(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    while True:
        labels = checkpointed(labels)
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower"))
        ahead = labels.select(F.col("node").alias("lower"), F.col("label").alias("lowest"))
        moved = checkpointed(step.join(ahead, "lower").select("node", "label", F.least("lower", "lowest").alias("new")))
        if moved.where("label <> new").isEmpty():
            return labels
        labels = moved.select("node", F.col("new").alias("label"))
