"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.storage import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node id of each component, for every node that has an edge (a, b).

    Every round hooks each tree to the smallest label among its neighbours and then halves the paths, so the number of rounds grows with the
    logarithm of the longest chain. All rounds are joins and aggregates; one count reaches the driver. A self loop only names
    its node. NULL ids have no edges.
    """
    e = kept(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    loops = e.where("a = b")
    state = None
    while True:
        proper = e.where("a <> b")
        both = proper.union(proper.select("b", "a")).toDF("node", "other")
        # large star: neighbours above a node hang on its smallest neighbour or itself
        low = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = kept(both.join(low, "node").where("other > node").select(F.col("m").alias("a"), F.col("other").alias("b")).where("a <> b").distinct(), "large-star")
        # small star: a node and its neighbours below hang on the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = kept(joined.select(F.col("m").alias("a"), "b").union(joined.select("m", "a")).where("a <> b").distinct(), "small-star")
        mark = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        e = small
        if (mark.n, mark.h) == state:
            break
        state = (mark.n, mark.h)
    e = e.union(loops)
    stars = e.groupBy("b").agg(F.min("a").alias("label")).withColumnRenamed("b", "node")
    roots = e.select(F.col("a").alias("node")).distinct().join(stars.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    return stars.union(roots)
