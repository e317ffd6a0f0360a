"""Rows at given ranks of huge groups by distributed radix selection: nothing is sorted but the rows that share the leading bits of a wanted one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyfield.functions.durable import stored

LEVELS = (8, 16)  # leading bits of the draw that each histogram resolves: a coarse one over all rows, a fine one inside the prefixes it leaves


def rows_at_ranks(df: DataFrame, groups: Sequence[str], draw: str, bits: int, order_by: Sequence[str], wanted: DataFrame, rank: str = "rank") -> DataFrame:
    """The rows of ``df`` at the 1-based ranks of ``wanted`` (groups, rank) in the order (draw, order_by, all other columns) of their group.

    draw: a uniform integer of ``bits`` bits. Each level is one aggregation that counts rows by (group, next bits) inside the prefixes that
    hold a wanted rank, so the lines themselves are never shuffled. Equal rows are counted, not listed, so a hot row stays one row.
    Ranks beyond a group's size give nothing.
    """
    groups = list(groups)
    spread = [*groups, "__prefix"]
    place = stored(wanted.select(*groups, F.col(rank).alias("__rank"), F.lit(0).cast("bigint").alias("__prefix"), (F.col(rank) - 1).cast("bigint").alias("__at")), "ranks")

    def inside(used: int) -> DataFrame:
        """Rows whose leading bits are those of a wanted rank: at most one prefix for each rank, so the lookup is as small as ``wanted``."""
        some = stored(place.select(*spread).distinct(), "prefixes")
        return df.withColumn("__prefix", F.shiftright(F.col(draw), bits - used)).join(some, spread, "left_semi")
    used = 0
    for level in LEVELS:
        step = min(level, bits - used)
        if step <= 0:
            break
        next_bits = F.shiftright(F.col(draw), bits - used - step).alias("__next")
        counts = inside(used).groupBy(*spread, next_bits).agg(F.count(F.lit(1)).alias("__c"))
        by = Window.partitionBy(*spread)  # at most 2^16 counts, and the ranks wanted there
        starts = counts.select(*spread, (F.sum("__c").over(by.orderBy("__next")) - F.col("__c")).alias("__pos"), F.lit(0).alias("__kind"), "__next",
                               F.lit(None).cast("bigint").alias("__rank"))
        seen = starts.unionByName(place.select(*spread, F.col("__at").alias("__pos"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__next"),
                                               F.col("__rank").cast("bigint").alias("__rank")))
        before = by.orderBy("__pos", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        located = seen.select(*groups, "__kind", "__rank", F.last("__next", True).over(before).alias("__prefix"),
                              (F.col("__pos") - F.last(F.when(F.col("__kind") == 0, F.col("__pos")), True).over(before)).alias("__at"))
        place = stored(located.where((F.col("__kind") == 1) & F.col("__prefix").isNotNull()).drop("__kind"), "ranks")
        used += step
    names = [f"`{c}`" for c in df.columns]
    counted = inside(used).groupBy(*names, "__prefix").agg(F.count(F.lit(1)).alias("__copies"))
    order = Window.partitionBy(*spread).orderBy(draw, *order_by, *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counted.withColumn("__end", F.sum("__copies").over(order))
    asked = place.select(*[F.col(c).alias(f"__of_{i}") for i, c in enumerate(spread)], "__rank", "__at")
    same = [F.col(f"`{c}`") == F.col(f"__of_{i}") for i, c in enumerate(spread)]
    here = (F.col("__at") < F.col("__end")) & (F.col("__at") >= F.col("__end") - F.col("__copies"))
    found = ends.join(asked, [*same, here])
    return found.select(*names, F.col("__rank").alias(rank))
