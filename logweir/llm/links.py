"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.store import written


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``id, root`` of every linked node; the root is the smallest id that is reachable.

    Each round takes the smallest root among neighbours and then the root of that root, so
    the rounds grow with the logarithm of the longest chain. Neighbours are reduced to
    one row per node and task before the shuffle; a root with many nodes is a skewed
    join, which AQE splits. Null ends are no links. Only a count leaves the cluster.
    """
    ends = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    both = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
    roots = written(roots, "roots")
    while True:
        near = both.join(roots.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        closer = roots.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("via"))
        beyond = roots.select(F.col("id").alias("via"), F.col("root").alias("far"))
        after = written(closer.join(beyond, "via").select("id", "old", F.least("via", "far").alias("root")), "roots")
        roots = after.select("id", "root")
        if not after.where("root <> old").take(1):
            return roots
