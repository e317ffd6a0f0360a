import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tallyfield.llm import mixing, quality  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_each_stage_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    good = corpus_pipeline.kept(stages["quality"](spark, docs, DATA), "t")
    assert good.columns == columns
    verdict = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == {d for d, k in verdict.items() if k}

    single = corpus_pipeline.kept(stages["near-duplicates"](spark, good, DATA), "t")
    rows = [tuple(r) for r in good.select("doc_id", "text").collect()]
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted({c for _, _, c in brute.components(rows)})

    clean = corpus_pipeline.kept(stages["decontamination"](spark, single, DATA), "t")
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in single.select("doc_id", "text").collect()]
    leaked = {d for d, _ in brute.leaks(rows, items)}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - leaked

    mixed = corpus_pipeline.kept(stages["mixing"](spark, clean, DATA), "t")
    assert mixed.columns == columns
    copies = {r.doc_id: r.copies for r in mixing.mix_words(clean).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies

    shards = stages["sharding"](spark, mixed, DATA)
    assert shards.count() == mixed.count()
    assert {r.text_crc32 for r in shards.select("text_crc32").distinct().collect()} == {r.c for r in mixed.select(F.crc32(F.col("text").cast("binary")).alias("c")).distinct().collect()}


def test_whole_pipeline_and_empty_input(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, DATA), name)
        assert docs.count() == 0
