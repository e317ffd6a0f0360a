"""MinHash near-duplicate removal.

Word-shingle sets of whole texts; two documents link when their Jaccard similarity reaches the threshold.

1. One pass over the texts: set size, digest of the set and a signature, the minima of 128 universal hash functions (multiply and add modulo 2^64, the
   upper half kept) over the set. Documents with the same set are one class from here on, however many copies there are.
2. Banding: 32 bands of 4 minima. A pair at the threshold of 0.85 misses all bands with a probability of 6e-11. Classes with the same band are a bucket.
3. Stars: each member of a bucket is a candidate partner of its least member (the groups: one row for each such pair, however many bands it has). Candidates whose signatures agree too little are dropped (a pair at
   the threshold is lost with a probability below 1e-8), the others are compared exactly on their full sets.
4. Components of the links by alternating large star and small star.
5. Rest: every pair with a common band lies in the group of that bucket's least member. Groups whose members are not one component yet are compared
   completely inside tasks: all intersections of a block of full sets come from one matrix product, and only what connects different
   components leaves the task. In groups of more members than a block the largest component lies once in blocks of its own and only
   the others are copied to each block, so pairs inside a component are never formed.

Defined results: NULL, empty and blank texts have no shingles and stand alone; fewer words than the shingle length count as one shingle;
repeated rows (same id) each come back; rows with a NULL id take part and name a component only when nothing else can (then NULL, and they are
kept); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyfield.llm.graph import components
from tallyfield.llm.storage import kept
from tallyfield.llm.text import chunks, mix, shingle_sets

BANDS, ROWS = 32, 4
BLOCK, BLOCK_TOKENS = 1024, 1 << 20  # members, and tokens of their sets, that are compared in one step
FEW = 8       # sets that share a token are counted pair by pair up to this number
SIGMAS = 6.0  # slack of the signature comparison, in standard deviations at the threshold


def hash_functions(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of the universal hash functions."""
    with np.errstate(over="ignore"):
        drawn = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return drawn[:count] | np.uint64(1), drawn[count:]


def least_agreement(count: int, num: int, den: int) -> int:
    """Equal minima that a pair at the threshold has, but for a negligible share of pairs."""
    p = num / den
    return max(1, math.ceil(count * p - SIGMAS * math.sqrt(count * p * (1 - p))))


def _digest(tokens: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([np.sum(mix(tokens ^ np.uint64(0x6C62272E07BB0142)), dtype=np.uint64), np.sum(mix(tokens + np.uint64(0x62B821756295C58D)), dtype=np.uint64)]).tobytes()


def _profile(k: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_functions(count)
        for batch in batches:
            ids = batch.column(0)
            for row, buf, offsets in chunks(batch.column(1)):
                sets = list(shingle_sets(buf, offsets, k))
                n = np.array([s.size for s in sets], dtype=np.int64)
                tokens, filled = np.concatenate(sets), np.flatnonzero(n)
                digest: list = [None] * len(sets)
                signature: list = [None] * len(sets)
                if filled.size:
                    at = np.r_[0, np.cumsum(n[filled])[:-1]]
                    minima = np.empty((filled.size, count), dtype=np.uint32)
                    with np.errstate(over="ignore"):
                        for j in range(count):
                            minima[:, j] = np.minimum.reduceat(tokens * a[j] + b[j], at) >> np.uint64(32)
                    for i, r in enumerate(filled.tolist()):
                        digest[r] = _digest(sets[r])
                        signature[r] = minima[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(sets)), pa.array(n), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], names=["doc_id", "n", "digest", "signature"])
    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Signatures of equal length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].view(np.uint32).reshape(-1, width)


def _alike(count: int, least: int):
    """(a, b, signature of a, signature of b) -> the pairs with enough equal minima."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(2), count) == _matrix(batch.column(3), count)).sum(axis=1)
                yield batch.select([0, 1]).filter(pa.array(same >= least))
    return run


def _sets(k: int):
    """Texts -> (digest, sorted set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offsets in chunks(batch.column(0)):
                sets = [s for s in shingle_sets(buf, offsets, k) if s.size]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "tokens"])
    return run


def _confirm(num: int, den: int):
    """(a, b, set of a, set of b) -> (a, b, ok)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                both = np.intersect1d(x, y, assume_unique=True).size
                ok.append(den * both >= num * (x.size + y.size - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])
    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Tokens in few sets are counted pair by pair, the others by one matrix product."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [s.size for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, rows = tokens[order], rows[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]), tokens.size]
    first, size = cuts[:-1], np.diff(cuts)
    common = np.zeros(m * m, dtype=np.int64)
    for c in range(2, FEW + 1):
        at = first[size == c]
        for i in range(c if at.size else 0):
            for j in range(i):
                common += np.bincount(rows[at + j] * m + rows[at + i], minlength=m * m)  # rows ascend within a token
    common = common.reshape(m, m)
    common += common.T
    wide = np.flatnonzero(size > FEW)
    for lo in range(0, wide.size, 4096):
        part = wide[lo:lo + 4096]
        held = np.zeros((m, part.size), dtype=np.float32)
        for column, t in enumerate(part.tolist()):
            held[rows[first[t]:first[t] + size[t]], column] = 1
        common += (held @ held.T).astype(np.int64)
    return common


def _joined(sets: list[np.ndarray], labels: np.ndarray, movers: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows that connect all labels which true links of these sets connect (a star for each component)."""
    n = np.array([s.size for s in sets])
    both = common_counts(sets)
    linked = den * both >= num * (n[:, None] + n[None, :] - both)
    linked &= movers[:, None] | movers[None, :]
    kinds, at = np.unique(labels, return_inverse=True)
    near = np.zeros((kinds.size, kinds.size), dtype=bool)
    near[at[np.nonzero(linked)[0]], at[np.nonzero(linked)[1]]] = True
    one = np.unique(at, return_index=True)[1]
    free = np.ones(kinds.size, dtype=bool)
    for seed in range(kinds.size):
        if free[seed]:
            free[seed] = False
            new = np.array([seed])
            while new.size:
                new = np.flatnonzero(near[new].any(axis=0) & free)
                free[new] = False
                for x in new.tolist():
                    yield int(one[seed]), int(one[x])


def _rest_links(num: int, den: int):
    """Members (bucket, node, label, mover, tokens), sorted by bucket -> (a, b) that connect different labels. A bucket is bounded by _spread."""
    def solve(held: list) -> pa.RecordBatch:
        node, label, mover, tokens = zip(*held)
        pairs = list(_joined([np.frombuffer(t, dtype=np.uint64) for t in tokens], np.array(label), np.array(mover), num, den))
        return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in pairs], pa.int64()), pa.array([node[j] for _, j in pairs], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket and held:
                    yield solve(held)
                    held = []
                bucket = b
                held.append(member)
        if held:
            yield solve(held)
    return run


def _labelled(frame: DataFrame, labels: DataFrame) -> DataFrame:
    return frame.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _band_keys(bands: int, rows: int) -> Column:
    width = 4 * rows
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width))))


def _spread(members: DataFrame) -> DataFrame:
    """(bucket, node, label, n) of open buckets -> (bucket, node, label, mover): bounded buckets in which every pair of different labels meets.

    The members of a bucket's largest component lie once in blocks of their own; the others are copied to each of these blocks and meet each other in pairs of blocks.
    """
    sizes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    sizes = sizes.groupBy("bucket").agg(F.sum("c").alias("m"), F.sum("t").alias("tokens"), F.max(F.struct("c", "t", "label")).alias("top"))

    def blocks(count: Column, tokens: Column) -> Column:
        return F.greatest(F.ceil(count * 2 / BLOCK), F.ceil(tokens * 2 / BLOCK_TOKENS), F.lit(1))
    sizes = sizes.select("bucket", F.col("top.label").alias("main"), blocks(F.col("top.c"), F.col("top.t")).alias("k"),
                         blocks(F.col("m") - F.col("top.c"), F.col("tokens") - F.col("top.t")).alias("others"),
                         ((F.col("m") > BLOCK) | (F.col("tokens") > BLOCK_TOKENS)).alias("large"))
    dealt = members.join(sizes, "bucket")
    plain = dealt.where("not large").select("bucket", "node", "label", F.lit(True).alias("mover"))
    is_main = F.col("label") == F.col("main")
    large = dealt.where("large").withColumn("block", F.pmod(F.xxhash64("node"), F.when(is_main, F.col("k")).otherwise(F.col("others"))))
    main = large.where("label = main").select("*", F.lit(False).alias("mover"))
    rest = large.where("label <> main")
    # (block of the main component, -1 - block of the others) and (smaller, larger block of the others)
    to_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.struct(i.alias("x"), (-1 - F.col("block")).alias("y")))
    among = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("x"), F.greatest(i, F.col("block")).alias("y")))
    rest = rest.withColumn("p", F.explode(F.concat(to_main, among)))
    main = main.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda i: F.struct(F.col("block").alias("x"), (-1 - i).alias("y")))))
    both = main.select("bucket", "node", "label", "mover", "p").union(rest.select("bucket", "node", "label", F.lit(True).alias("mover"), "p"))
    return plain.union(both.select(F.xxhash64("bucket", "p.x", "p.y").alias("bucket"), "node", "label", "mover"))


def minhash_components(docs: DataFrame, k: int = 5, num: int = 85, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text). Links: den * intersection >= num * union."""
    count = bands * rows
    least = least_agreement(count, num, den)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = kept(base.mapInArrow(_profile(k, count), "doc_id long, n long, digest binary, signature binary"), "minhash-profile")
    classes = (profile.where("n > 0").groupBy("digest", "n")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("first"), F.first("signature").alias("signature")))
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    signatures = classes.select("node", "signature")

    banded = classes.select("node", F.explode(_band_keys(bands, rows)).alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("centre")).where("m > 1")
    groups = kept(banded.join(sizes, "band").select(F.col("centre").alias("bucket"), "node").distinct(), "minhash-groups")

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        """(node, tokens): full sets, made again from the texts of the classes concerned."""
        wanted = kept(classes.join(nodes.distinct(), "node", "left_semi").select("node", "digest", F.col("first.doc_id").alias("first_id")), f"{name}-wanted")
        texts = base.join(wanted.select("first_id").distinct(), base.doc_id.eqNullSafe(F.col("first_id")), "left_semi").select("text")
        sets = texts.mapInArrow(_sets(k), "digest binary, tokens binary").join(wanted.select("node", "digest"), "digest")
        return kept(sets.groupBy("node").agg(F.first("tokens").alias("tokens")), f"{name}-sets")

    stars = groups.where("node <> bucket").select(F.col("bucket").alias("a"), F.col("node").alias("b"))
    stars = stars.join(signatures.toDF("a", "x"), "a").join(signatures.toDF("b", "y"), "b").select("a", "b", "x", "y")
    stars = kept(stars.mapInArrow(_alike(count, least), "a long, b long"), "minhash-stars")
    sets = sets_of(stars.select(F.col("a").alias("node")).union(stars.select("b")), "minhash-stars")
    tried = stars.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = kept(tried.mapInArrow(_confirm(num, den), "a long, b long, ok boolean").where("ok").select("a", "b"), "minhash-links")
    labels = kept(components(links), "minhash-labels")

    members = _labelled(groups, labels)
    unsettled = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    members = kept(members.join(unsettled, "bucket").join(classes.select("node", "n"), "node").select("bucket", "node", "label", "n"), "minhash-open")
    shuffle = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _spread(members).join(sets_of(members.select("node"), "minhash-open"), "node").select("bucket", "node", "label", "mover", "tokens")
    dealt = dealt.repartition(shuffle, "bucket").sortWithinPartitions("bucket")
    late = kept(dealt.mapInArrow(_rest_links(num, den), "a long, b long").distinct(), "minhash-late")
    labels = kept(components(links.union(late)), "minhash-labels")

    named = _labelled(classes.select("node", "digest", "first"), labels)
    named = named.join(named.groupBy("label").agg(F.min("first").alias("least")), "label").select("digest", F.col("least.doc_id").alias("least_id"))
    full = profile.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    full = full.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return full.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
