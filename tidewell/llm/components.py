"""Connected components of a graph of long ids, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest node it is joined to.

    In each round every node takes the least label among its own and its
    neighbours', then the label of its label.  Minima are combined before each
    shuffle, so nodes of any degree cost one row per task; rounds grow with the
    logarithm of a component's diameter, as labels jump.  Each round's labels
    are written to the shared folder.  Self edges are allowed and give
    components of one.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), purpose)
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("node"), "l"), purpose)
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("h")).withColumnRenamed("a", "node")
        least = labels.join(heard, "node").select("node", F.least("l", "h").alias("n"), F.col("l").alias("old"))
        jump = labels.select(F.col("node").alias("n"), F.col("l").alias("up"))
        after = written(least.join(jump, "n").select("node", F.least("n", "up").alias("l"), (F.least("n", "up") != F.col("old")).alias("moved")), purpose)
        labels = after.select("node", "l")
        if after.where("moved").limit(1).count() == 0:
            return labels.withColumnRenamed("l", "component")
