"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that may not be split. Groups are packed in two steps, so that no task and no driver sees them all:

1. Groups are spread by hash over a fixed number of packers. Each takes its groups from large to small and puts each into the open bin with the least
   remaining capacity that still holds it, found in a balanced tree of remaining capacities. A small bin holds 1 / (shards * per_shard) of all
   bytes; a larger group is a bin of its own.
2. The bins (a number bounded by the parameters, not by the input) are packed into the shards the same way. The capacity of a shard
   is the smallest, found by bisection, at which best-fit-decreasing needs no more than the wanted number of shards.

Shard sizes then differ by about one small bin, unless one group is larger than a fair share: it stays whole and has a shard nearly to itself.
Slots count the rows of a shard without gaps.

Defined results: a NULL text has no bytes and groups with the empty text, size 1 and CRC 0; NULL ids sort first; repeated
rows are rows of the same group with slots of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.functions.ordering import with_row_number
from tallyfield.llm.storage import kept


class Capacities:
    """Remaining capacities of open bins in order: a tree of height two whose leaves are split when they grow."""

    WIDE = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []  # the largest entry of each leaf

    def add(self, room: int, bin_no: int) -> None:
        entry = (room, bin_no)
        if not self.leaves:
            self.leaves, self.tops = [[entry]], [entry]
            return
        at = min(bisect_left(self.tops, entry), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        self.tops[at] = leaf[-1]
        if len(leaf) > self.WIDE:
            self.leaves[at:at + 1] = [leaf[:len(leaf) // 2], leaf[len(leaf) // 2:]]
            self.tops[at:at + 1] = [leaf[len(leaf) // 2 - 1], leaf[-1]]

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the entry with the least room of at least ``size``."""
        at = bisect_left(self.tops, (size, -1))
        if at == len(self.leaves):
            return None
        leaf = self.leaves[at]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[at] = leaf[-1]
        else:
            del self.leaves[at], self.tops[at]
        return entry


class Packer:
    """Best fit for sizes that arrive in decreasing order."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.count = capacity, Capacities(), 0

    def place(self, size: int) -> int:
        found = self.rooms.tightest(size)
        room, bin_no = found if found else (max(self.capacity, size), self.count)
        self.count += not found
        if room > size:
            self.rooms.add(room - size, bin_no)
        return bin_no


def pack(sizes: list[int], shards: int) -> tuple[list[int], int]:
    """Shard of each size (given in decreasing order) and the smallest capacity for which best fit needs no more than ``shards``."""
    def attempt(capacity: int) -> list[int] | None:
        packer = Packer(capacity)
        placed = [packer.place(s) for s in sizes]
        return placed if packer.count <= shards else None

    low = max([1, *sizes[:1], -(-sum(sizes) // shards)])
    high = max(low, 2 * low)
    while (best := attempt(high)) is None:
        high *= 2
    while low < high:
        middle = (low + high) // 2
        placed = attempt(middle)
        if placed is None:
            low = middle + 1
        else:
            high, best = middle, placed
    return best, high


def _pack_groups(capacity: int):
    """Groups sorted by packer and falling weight -> the bin of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packer = None, Packer(capacity)
        for batch in batches:
            bins = np.empty(batch.num_rows, dtype=np.int64)
            packers, weights = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, (name, weight) in enumerate(zip(packers, weights)):
                if name != current:
                    current, packer = name, Packer(capacity)
                bins[i] = (name << 40) | packer.place(weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins), batch.column(2)], names=["group", "bin", "weight"])
    return run


def shard_documents(docs: DataFrame, shards: int = 8, per_shard: int = 256, packers: int = 512) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text). Sizes are UTF-8 bytes plus 1."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = kept(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                            F.unhex(F.md5(text.cast("binary"))).alias("group")), "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("weight"))
    groups = kept(groups, "shard-groups")
    total = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("t")).first().t
    capacity = max(1, total // (shards * per_shard))
    spread = groups.select("group", F.pmod(F.xxhash64("group"), F.lit(packers)).cast("long").alias("packer"), "weight")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = spread.repartition(width, "packer").sortWithinPartitions("packer", F.desc("weight"), "group")
    binned = kept(ordered.mapInArrow(_pack_groups(capacity), "group binary, bin long, weight long"), "shard-bins")
    # at most packers + 2 * shards * per_shard bins, whatever the input
    bins = sorted(((r.w, r.bin) for r in binned.groupBy("bin").agg(F.sum("weight").alias("w")).collect()), key=lambda x: (-x[0], x[1]))
    placed, _ = pack([w for w, _ in bins], shards)
    of_bin = docs.sparkSession.createDataFrame([(b, int(s)) for (_, b), s in zip(bins, placed)], "bin long, shard int")
    assigned = rows.join(binned.join(F.broadcast(of_bin), "bin").select("group", "shard"), "group").drop("group")
    numbered = with_row_number(assigned, ["shard", "doc_id", "size", "text_crc32"], out="__at")
    counts = {r.shard: r.n for r in numbered.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [sum(counts.get(s, 0) for s in range(k)) for k in range(shards)]
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard") + 1)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__at") - 1 - first).alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
