"""Total orders over large tables without a single-task window.

``Window.orderBy`` without ``partitionBy`` moves the whole table into one task, and a window
partitioned by a handful of groups is not much better. Here rows are range-partitioned and
sorted by Spark, the layout is checkpointed once (a second run of the range sampler may cut
elsewhere), and only one total per partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyfield.functions.durable import slices, stored

_PART, _AT = "__ordering_part", "__ordering_at"  # names that no caller uses
_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row index in the low 33 bits
_SLICE_BIT = 32  # a stored partition number: the slice above this bit, Spark's number in the slice below
_SLICE = 1 << _SLICE_BIT


def _partition_start(rows) -> Column:
    """Rows (or their weight) in all partitions before a row's own, those of earlier slices included."""
    totals = {divmod(r[_PART], _SLICE): r["__total"] or 0 for r in rows}
    last, parts = max((s for s, _ in totals), default=0), max((p for _, p in totals), default=0) + 1
    starts = [0, *accumulate(totals.get((s, p), 0) for s in range(last + 1) for p in range(parts))][:-1]
    # one string literal, folded to an array once: cheap to ship even for thousands of partitions
    table = F.split(F.lit(",".join(str(int(s)) for s in starts)), ",").cast("array<bigint>")
    at = F.shiftright(_PART, _SLICE_BIT) * F.lit(parts) + F.col(_PART).bitwiseAND(F.lit(_SLICE - 1))
    return F.get(table, at.cast("int"))


def _running(weight: str):
    """Adds the exclusive running total of ``weight`` within a partition."""
    def run(batches):
        before = 0
        for batch in batches:
            sums = before + np.cumsum(batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64))
            yield batch.append_column(_AT, pa.array(np.r_[before, sums[:-1]] if sums.size else sums, pa.int64()))
            before = int(sums[-1]) if sums.size else before
    return run


SORTED_ROWS = 500_000  # rows that one task sorts, where their number is known


def _sliced(df: DataFrame, first: str, rows: int) -> list[tuple[DataFrame, int]]:
    """The rows in slices of the leading column, in its order (NULL first), with the number of rows in each.

    Equal values stay in one slice, so one that most rows share makes a larger slice.
    """
    n = slices(rows)
    if n == 1:
        return [(df, rows)]
    c, kind = F.col(first), df.schema[first].dataType
    cuts = df.agg(F.percentile_approx(c, [i / n for i in range(1, n)]).cast("array<string>")).first()[0] or []
    edges = [F.lit(v).cast(kind) for v in dict.fromkeys(cuts)]
    at = sum((F.coalesce(c > e, F.lit(False)).cast("int") for e in edges), F.lit(0))
    sizes = dict(df.select(at.alias("s")).groupBy("s").agg(F.count(F.lit(1))).collect())
    return [(df.where(at == F.lit(s)), sizes[s]) for s in sorted(sizes)]


def _laid_out(df: DataFrame, order_by: Sequence[str], weight: str | None = None, rows: int | None = None) -> tuple[DataFrame, Column]:
    """The rows with their partition and position (or running total) in it, stored, and the start of each row's partition."""
    sorted_slices = []
    for i, (part, size) in enumerate([(df, None)] if rows is None else _sliced(df, order_by[0], rows)):
        ranges = []
        if size is not None:  # as many ranges as the rows need, so that a task sorts in memory whatever the table's size
            ranges = [max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SORTED_ROWS))]
        cut = part.repartitionByRange(*ranges, *order_by).sortWithinPartitions(*order_by)
        if weight is None:
            cut = cut.withColumn(_AT, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
        else:
            cut = cut.mapInArrow(_running(weight), T.StructType([*cut.schema.fields, T.StructField(_AT, T.LongType())]))
        sorted_slices.append(cut.withColumn(_PART, F.spark_partition_id() + F.lit(i * _SLICE).cast("bigint")))
    kept = stored(sorted_slices[0], "ordered", *sorted_slices[1:])
    size = F.lit(1) if weight is None else F.col(weight)
    totals = kept.groupBy(_PART).agg(F.max(F.col(_AT) + size).alias("__total")).collect()
    return kept, _partition_start(totals)


def with_row_number(df: DataFrame, order_by: Sequence[str], out: str = "row_number", rows: int | None = None) -> DataFrame:
    """1-based position in the total order of ``order_by`` (which must identify rows), read from a stored table.

    One range shuffle; hot leading values are split because the whole key takes part in the cut. ``rows``: their number, where it is cheap to
    know; wide rows are then cut into ranges that fit a task's memory, and moved in slices of the first column (a number, date or time), one
    after the other, so that the disk never holds a shuffle of the whole table.
    """
    kept, start = _laid_out(df, order_by, rows=rows)
    return kept.withColumn(out, start + F.col(_AT) + F.lit(1)).drop(_PART, _AT)


def with_prefix_sum(df: DataFrame, order_by: Sequence[str], weight: str, out: str = "below") -> DataFrame:
    """Exclusive running total of a positive integer ``weight`` in the total order of ``order_by``. One range shuffle."""
    kept, start = _laid_out(df, order_by, weight)
    return kept.withColumn(out, start + F.col(_AT)).drop(_PART, _AT)


def group_row_number(df: DataFrame, groups: Sequence[str], order_by: Sequence[str],
                     out: str = "row_number", size_out: str | None = None) -> DataFrame:
    """``row_number() over (partition by groups order by order_by)`` for few, huge groups.

    Positions come from one total order; each group's start is subtracted afterwards.
    """
    ranked = with_row_number(df, [*groups, *order_by], out="__pos")
    # one row for each group, written out so that its size is known: few groups are then broadcast and a hot one is not gathered
    bounds = stored(ranked.groupBy(*groups).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__size")), "group-bounds")
    joined = (ranked.join(bounds, list(groups), "inner")
              .withColumn(out, F.col("__pos") - F.col("__first") + F.lit(1)).drop("__pos", "__first"))
    return joined.withColumnRenamed("__size", size_out) if size_out else joined.drop("__size")


def value_ranks(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct value): ``cnt``, ``below`` (rows with a smaller value), ``n`` (group size).

    Equal values collapse map-side before the sort, so a value held by a third of all rows is one row here.
    Average-tie rank is ``below + (cnt + 1) / 2``.
    """
    groups = list(groups)
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*groups, value).agg(F.count(F.lit(1)).alias("cnt")))
    ranked = with_prefix_sum(counted, [*groups, value], "cnt", out="__below")
    if not groups:
        total = ranked.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"))
        return ranked.withColumn("n", total.scalar()).withColumnRenamed("__below", "below")
    bounds = stored(ranked.groupBy(*groups).agg(F.min("__below").alias("__first"), F.sum("cnt").alias("n")), "group-bounds")
    return (ranked.join(bounds, groups, "inner")
            .withColumn("below", F.col("__below") - F.col("__first"))
            .drop("__below", "__first"))


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation percentiles, one output column per entry of ``probs``.

    The built-in ``percentile`` keeps every distinct value of a group in one buffer; this keeps none.
    """
    ranked = value_ranks(df, value, groups)
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - F.lit(1))
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("below") <= k) & (k < F.col("below") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{name}_{side}"))
    picked = ranked.groupBy(*groups).agg(F.max("n").alias("__n"), *aggs)
    cols = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("__n") - F.lit(1))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*groups, *cols)


def group_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str) -> DataFrame:
    """Exact percentile per key, for many small keys and hot ones alike: ranks in one total order with the key leading."""
    return exact_percentiles(df, value, {out: p}, list(keys))
