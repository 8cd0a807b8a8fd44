"""Connected components of a table of links, by lowest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(v, c) for every vertex of the links (a, b): c is the smallest vertex that v reaches.

    Every round a vertex takes the lowest label among its neighbours, and then its label's label, so the rounds grow
    with the logarithm of the longest path. Labels stay in tables; the driver sees one count a round.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("c")))
    while True:
        seen = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("m"))
        lower = labels.join(seen, labels["v"] == seen["a"]).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        far = labels.select(F.col("v").alias("w"), F.col("c").alias("d"))
        jumped = cut(lower.join(far, F.col("c") == F.col("w")).select("v", "old", F.least("c", "d").alias("c")))
        labels = jumped.select("v", "c")
        if jumped.where("c != old").isEmpty():
            return labels
