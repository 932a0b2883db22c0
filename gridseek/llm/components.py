"""Connected components of links, in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.llm.common import durable

#: Links up to which a round is one task, which needs no shuffle; beyond it is dealt out. Rows of a file.
ONE_TASK = ROWS = 200_000


def components(links: DataFrame) -> DataFrame:
    """id and component (its least id) of each end of the links (a, b), both long.

    Each round takes the least label among the neighbours and then the label of that label, so that
    the number of rounds grows with the logarithm of the longest path. Labels and links stay tables.
    """
    both = durable(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), ROWS)
    together = (lambda t: t.coalesce(1)) if both.count() <= ONE_TASK else (lambda t: t)
    both = together(both)
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), "component")
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = together(durable(step.join(jump, "next", "left").select("id", F.coalesce(F.least("far", "next"), "next").alias("next"), "component")))
        labels = moved.select("id", F.col("next").alias("component"))
        if moved.where("next != component").isEmpty():
            return labels
