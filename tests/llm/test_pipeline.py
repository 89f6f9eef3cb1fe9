import corpus_pipeline
from anonspark.llm import decontam, quality_knn

from .test_neardup import slow_least


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    done = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in done.collect()}
    good = {r["doc_id"] for r in quality_knn.quality(docs, labels).filter("predicted = 1").collect()}
    assert ids <= good
    kept = docs.filter(docs["doc_id"].isin(sorted(good)))
    first = set(slow_least(sorted((r["doc_id"], r["text"]) for r in kept.collect())))  # similarity by brute force
    leaks = {r["doc_id"] for r in decontam.contamination(kept, bench).filter("contaminated").collect()}
    assert ids == first - leaks
    assert set(docs.columns) <= set(done.columns) and {"shard", "n_bytes"} <= set(done.columns)


def test_stages_keep_the_columns(spark, odd, none, sf):
    for docs in (odd, none):
        now = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, sf)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert now.columns == docs.columns
        assert now.count() >= 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "mixing", "sharding"]
