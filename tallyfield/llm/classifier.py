"""Quality classifier by importance resampling.

Two bag-of-n-grams generative models over hashed words and word pairs: one of the target (labelled good text), one of all raw text. A document's log weight is
the log ratio of its probabilities under the two. Sampling without replacement in proportion to the weights is the top k of log weight plus
a Gumbel draw.

Raw counts cover every whole document. The target model is fitted on at most ``max_labels`` labelled documents (those with the least hash
of their id); that bound is what allows their ids to be broadcast. Both models have ``buckets`` entries, whatever the input. Draws are hashes of the id, so reruns agree. The cut of the top k comes
from a distributed ranking, not from a sort in one place.

Defined results: NULL and empty texts have log weight 0; without usable labels the target model is flat; k is the given share of all rows, by default the share of
good labels (all rows without labels); repeated rows get the same weight and draw and are ranked one after the other; NULL ids draw as
one id; an empty table gives an empty result; extra columns are ignored. Labels with NULL are not used; a document labelled twice counts
as target if one label is good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.functions.ordering import with_row_number
from tallyfield.llm.storage import kept
from tallyfield.llm.text import LOWER, chunks, sequence_hashes, span_hashes, word_bounds

BUCKETS = 1 << 14
MAX_LABELS = 20_000
SMOOTHING = 1.0


def hashed_ngrams(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all words and word pairs, A-Z lowered."""
    low = LOWER[buf]
    starts, ends, rows = word_bounds(low, offsets)
    if not starts.size:
        return np.zeros(0, np.int64), rows
    words = span_hashes(low, starts, ends)
    pairs = sequence_hashes(words, 2)
    together = np.flatnonzero(rows[1:] == rows[:-1])
    codes = np.concatenate([words, pairs[together]])
    return (codes % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, rows[together]])


def _histograms(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for first, buf, offsets in chunks(batch.column(0)):
                codes, rows = hashed_ngrams(buf, offsets, buckets)
                raw += np.bincount(codes, minlength=buckets)
                target += np.bincount(codes[good[rows + first]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])
    return run


def _weigher(weights, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, offsets in chunks(batch.column(1)):
                n = len(offsets) - 1
                codes, rows = hashed_ngrams(buf, offsets, buckets)
                total = np.bincount(rows, weights=weights.value[codes], minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.bincount(rows, minlength=n)), pa.array(total)],
                                                 names=["doc_id", "n_ngrams", "log_weight"])
    return run


def target_ids(labels: DataFrame, max_labels: int) -> DataFrame:
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    return good.orderBy(F.xxhash64("__id"), "__id").limit(max_labels).withColumn("__good", F.lit(True))


def importance_model(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_labels: int = MAX_LABELS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of the target and the raw model for each bucket."""
    ids = kept(target_ids(labels, max_labels), "importance-target")  # at most max_labels rows of nine bytes
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left")
    marked = marked.select(F.col("text").cast("string").alias("text"), F.coalesce("__good", F.lit(False)).alias("good"))
    counted = marked.mapInArrow(_histograms(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counted.collect():  # at most ``buckets`` rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return (np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets)))


def importance_sample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, max_labels: int = MAX_LABELS, seed: int = 7) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, gumbel_key, place, kept) for every row of docs(doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(importance_model(docs, labels, buckets, max_labels))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = source.mapInArrow(_weigher(model, buckets), "doc_id long, n_ngrams long, log_weight double")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = kept(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "importance-keys")
    if share is None:
        share = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double")).alias("s")).first().s
    n = keyed.count()
    k = n if share is None else -int(-(n * share) // 1)
    ranked = with_row_number(keyed.withColumn("__down", -F.col("gumbel_key")), ["__down", "doc_id"], out="place").drop("__down")
    return ranked.select("doc_id", "n_ngrams", "log_weight", "gumbel_key", "place", (F.col("place") <= k).alias("kept"))
