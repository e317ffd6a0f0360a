"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact verification.

An item of L words is looked for in every window of L words of every text. Both are bags of five-word shingles (fewer words: one shingle of
all), lower-cased, words parted by white space. A window holds an item when their weighted similarity, the sum of the
smaller over the sum of the larger shingle counts, is at least 0.75.

1. Only a window that has enough shingles of items of its size can reach that, so windows are formed around such places only (lossless).
2. Each window gets a 64-bit SimHash: for each bit, the balance of its shingles' hash bits, counted in 16-bit lanes of long columns.
3. Fingerprints are cut into 8 blocks of 8 bits. Two fingerprints within 23 bits differ by at most 2 bits in at least one block, so the index of
   items holds each block value with all values within 2 bits, and a window finds all items within the radius by equality on (size, block, value). A
   pair of similarity 0.75 is expected to differ in 11 bits with a deviation of 3.
4. Pairs within the radius are compared exactly.

DataFrame functions only. Item tables are joined by whatever join their size calls for; nothing is broadcast by hint.

Items are told apart by their words, not by their ids: different texts under one id, or under none, have a fingerprint each.

Defined results: NULL or empty texts and items match nothing; an item shorter than five words is one shingle of that many words; repeated rows or
equal items give one result for each (doc_id, item_id); a text is removed for what it holds, not for its id; rows with a NULL id are reported under NULL; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfield.llm.storage import joined_by_digest, kept

SHINGLE = 5
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
LANES = 4  # bits counted in one long column, 16 bits for each count


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[\x20\x09-\x0D]+"), "")


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _grams(words: Column, k: int) -> Column:
    """All k-word shingle hashes of an array of words, in order."""
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: _gram(words, i, k)))


def _needed(window: Column, item: Column, num: int, den: int) -> Column:
    """Shingles that bags of these sizes must share: similarity num/den means at least num / (num + den) of both sizes together."""
    return F.ceil((window + item) * F.lit(num) / F.lit(num + den)).cast("int")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _items(items: DataFrame) -> DataFrame:
    """(item_id, item_key, length, k, grams): the key is a digest of the words."""
    w = items.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    w = w.withColumn("item_key", _digest(F.array_join("words", " ")))
    w = w.withColumn("length", F.size("words")).withColumn("k", F.least(F.col("length"), F.lit(SHINGLE)))
    grams = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        grams = F.when(F.col("k") == k, _grams(F.col("words"), k)).otherwise(grams)
    return w.select("item_id", "item_key", "length", "k", grams.alias("grams"))


def _lane_table() -> list[int]:
    """For each half byte, its bits in the lanes of a long."""
    return [sum(((value >> bit) & 1) << (16 * bit) for bit in range(LANES)) for value in range(1 << LANES)]


def _fingerprints(frame: DataFrame, keys: list[str]) -> DataFrame:
    """``fp`` for rows of keys and ``grams``: bit b is set where at least half of the shingles have it."""
    table = F.array(*[F.lit(v).cast("long") for v in _lane_table()])
    h = F.col("h")
    sums = [F.sum(F.get(table, F.shiftrightunsigned(h, LANES * g).bitwiseAND(F.lit(15)).cast("int"))).alias(f"s{g}") for g in range(64 // LANES)]
    counted = frame.select(*keys, F.explode("grams").alias("h")).groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("total"))
    fp = F.lit(0).cast("long")
    for g in range(64 // LANES):
        for bit in range(LANES):
            lane = F.shiftrightunsigned(F.col(f"s{g}"), 16 * bit).bitwiseAND(F.lit(0xFFFF))
            fp = fp.bitwiseOR(F.shiftleft((lane * 2 >= F.col("total")).cast("long"), LANES * g + bit))
    return counted.select(*keys, fp.alias("fp"))


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def windows_near_items(docs: DataFrame, items: DataFrame, num: int, den: int) -> DataFrame:
    """(text_key, length, k, start, grams): windows of item sizes with enough shingles of items of that size.

    Only positions are counted and moved; the words of a window come back from its text once its size has enough shingles there.
    """
    places = kept(items.select("length", "k", F.explode("grams").alias("g")).groupBy("k", "g").agg(F.collect_set("length").alias("lengths")), "decontam-places")
    found = None
    for k in [r.k for r in places.select("k").distinct().collect()]:  # at most five values
        at = docs.select(_digest(F.col("text").cast("string")).alias("text_key"), _words(F.col("text")).alias("words"))
        at = at.select("text_key", "words", F.posexplode("words").alias("pos", "word")).where(F.col("pos") + k <= F.size("words"))
        at = at.select("text_key", F.size("words").alias("n"), "pos", _gram(F.col("words"), F.col("pos"), k).alias("g"))
        hit = at.join(places.where(F.col("k") == k), "g").select("text_key", "n", "k", "pos", "lengths")
        found = hit if found is None else found.union(hit)
    if found is None:
        schema = "text_key binary, length int, k int, start int, grams array<bigint>"
        return docs.sparkSession.createDataFrame([], schema)
    L, k, n = F.col("length"), F.col("k"), F.col("n")
    enough = _needed(F.least(n, L) - k + 1, L - k + 1, num, den)
    # a text that all copies share comes once from a task; the sizes are unfolded where all hits of a text are at hand
    texts = found.groupBy("text_key", "n", "k").agg(F.collect_set(F.struct("pos", "lengths")).alias("hits"))
    hits = texts.select("text_key", "n", "k", F.explode("hits").alias("hit")).select("text_key", "n", "k", "hit.pos", F.explode("hit.lengths").alias("length"))
    hits = hits.groupBy("text_key", "n", "k", "length").agg(F.collect_list("pos").alias("hits")).where(F.size("hits") >= enough)
    # a window that starts in one block of ``length`` words ends in the next: its shared shingles are all at hand under its first block
    hits = hits.select("text_key", "n", "k", "length", F.explode("hits").alias("pos"))
    block = F.floor(F.col("pos") / L).cast("int")
    hits = hits.withColumn("first", F.explode(F.array(block - 1, block))).withColumn("low", F.col("first") * L)
    hits = hits.where((F.col("low") >= 0) & (F.col("low") <= F.greatest(F.lit(0), n - L)))
    near = hits.groupBy("text_key", "n", "k", "length", "low").agg(F.collect_list("pos").alias("hits")).where(F.size("hits") >= enough)
    last = F.least(F.col("low") + L - 1, F.greatest(F.lit(0), n - L))
    starts = F.filter(F.sequence(F.col("low"), last), lambda s: F.size(F.filter("hits", lambda p: (p >= s) & (p <= s + L - k))) >= enough)
    near = near.select("text_key", "length", "k", F.explode(starts).alias("start"))
    near = kept(near.groupBy("text_key").agg(F.collect_list(F.struct("length", "k", "start")).alias("windows")), "decontam-starts")
    rows = joined_by_digest(docs.select("doc_id", F.col("text").cast("string").alias("text"), _digest(F.col("text").cast("string")).alias("digest")), near.withColumnRenamed("text_key", "digest"))
    rows = rows.where("windows is not null").select(F.col("digest").alias("text_key"), _words(F.col("text")).alias("words"), "windows")
    rows = rows.select("text_key", "words", F.explode("windows").alias("w")).select("text_key", "words", "w.*")
    rows = rows.select("text_key", "length", "k", "start", F.slice("words", F.col("start") + 1, L).alias("words"))
    grams = F.lit(None).cast("array<bigint>")
    for size in range(1, SHINGLE + 1):
        grams = F.when(F.col("k") == size, _grams(F.col("words"), size)).otherwise(grams)
    return rows.select("text_key", "length", "k", "start", grams.alias("grams")).distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame, num: int, den: int) -> DataFrame:
    """(text_key, item_id, similarity, start): every window of a text that holds an item."""
    rows = kept(_items(benchmark), "decontam-items")
    items = rows.select("item_key", "length", "k", "grams").distinct()
    near = kept(windows_near_items(docs, items, num, den), "decontam-windows")

    item_fp = kept(_fingerprints(items, ["item_key", "length"]), "decontam-item-fp")
    flips = [0, *[sum(1 << b for b in c) for r in range(1, BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]]
    variants = F.explode(F.array(*[F.lit(v).cast("long") for v in flips])).alias("flip")
    index = item_fp.select("item_key", "length", "fp", F.posexplode(F.array(*[_block(F.col("fp"), b) for b in range(BLOCKS)])).alias("block", "value"))
    index = index.select("item_key", "length", F.col("fp").alias("item_fp"), "block", "value", variants)
    index = index.select("item_key", "length", "item_fp", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    index = kept(index, "decontam-index")
    probe = _fingerprints(near.withColumn("wid", F.xxhash64("grams")), ["text_key", "length", "start", "wid"])
    probe = kept(probe, "decontam-probe")
    keyed = probe.select("text_key", "length", "start", "wid", "fp", F.posexplode(F.array(*[_block(F.col("fp"), b) for b in range(BLOCKS)])).alias("block", "value"))
    pairs = (keyed.join(index, ["length", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
             .select("text_key", "length", "start", "wid", "item_key").distinct())
    left = near.select(F.col("text_key").alias("d"), F.col("length").alias("l"), F.col("start").alias("s"), F.xxhash64("grams").alias("w"), F.col("grams").alias("window"))
    both = pairs.join(left, (pairs.text_key == F.col("d")) & (pairs.length == F.col("l")) & (pairs.start == F.col("s")) & (pairs.wid == F.col("w")))
    both = both.join(items.select("item_key", F.col("length").alias("il"), F.col("grams").alias("item")), "item_key").where("il = length")

    def times(array: str, g: Column) -> Column:
        return F.size(F.filter(array, lambda x: x == g))
    common = F.aggregate(F.array_intersect("window", "item"), F.lit(0), lambda acc, g: acc + F.least(times("window", g), times("item", g)))
    scored = both.withColumn("common", common).withColumn("union", F.size("window") + F.size("item") - F.col("common"))
    leaks = scored.where(F.col("common") * den >= F.col("union") * num).withColumn("similarity", F.col("common") / F.col("union"))
    leaks = kept(leaks.select("text_key", "item_key", "similarity", "start").distinct(), "decontam-leaks")
    return leaks.join(rows.select("item_id", "item_key").distinct(), "item_key").select("text_key", "item_id", "similarity", "start")


def find_leaks(docs: DataFrame, benchmark: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_windows): for each document and item it holds, the best (earliest) window."""
    rows = docs.select("doc_id", _digest(F.col("text").cast("string")).alias("text_key"))
    leaks = rows.join(_leaks(docs, benchmark, num, den), "text_key")
    best = F.min(F.struct((-F.col("similarity")).alias("low"), "start").alias("b"))
    grouped = leaks.groupBy("doc_id", "item_id").agg(best.alias("b"), F.count_distinct("start").alias("n_windows"))
    return grouped.select("doc_id", "item_id", (-F.col("b.low")).alias("similarity"), F.col("b.start").cast("long").alias("start_word"), "n_windows")


def clean_documents(docs: DataFrame, benchmark: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of docs whose text has no leak."""
    leaked = kept(_leaks(docs, benchmark, num, den).select(F.col("text_key").alias("__leaked")).distinct(), "decontam-leaked")
    return docs.join(leaked, _digest(docs.text.cast("string")) == F.col("__leaked"), "left_anti")
