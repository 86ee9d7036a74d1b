"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(v, comp)`` for every vertex of ``links``: comp is the smallest vertex that
    can be reached.  Each round takes the least label among the neighbours and then
    the label of one's label (so chains shrink by half); it ends when nothing changes.
    Every round is written to the shared folder.  A vertex with very many
    neighbours is a hot join key: both sides of the joins come from files, so
    adaptive execution splits them."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("w")).where("u <> w")
    edges = cut(both.unionByName(both.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("u").alias("v")).agg(F.least(F.col("u"), F.min("w")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("v", "w"), "w").groupBy(F.col("u").alias("v")).agg(F.min("comp").alias("m"))
        low = cut(labels.join(near, "v").select("v", "comp", F.least("comp", "m").alias("c")), "low")
        to = low.select(F.col("v").alias("c"), F.col("c").alias("jump"))
        new = cut(low.join(to, "c", "left").select("v", "comp", F.least(F.col("c"), F.col("jump")).alias("c")), "labels")
        done = new.where("comp <> c").isEmpty()
        labels = new.select("v", F.col("c").alias("comp"))
        if done:
            return labels
