from collections import Counter

from evenkeel.llm import language, mixing, sharding
from tests.llm.test_dedup import naive_components, naive_fingerprint
from tests.llm.test_text import naive_contamination

import corpus_pipeline


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*docs.columns, "shard"]
    rows = [r for r in docs.collect()]
    told = {r["doc_id"] for r in language.identified(docs).where("NOT rejected").collect()}
    rows = sorted((r for r in rows if r["doc_id"] in told), key=lambda r: r["doc_id"])
    ids = [r["doc_id"] for r in rows]
    first = set(naive_components(ids, [naive_fingerprint(r["text"]) for r in rows]))
    rows = [r for r in rows if r["doc_id"] in first]
    dirty = {line.split(",")[0][1:] for line in naive_contamination([(r["doc_id"], r["text"]) for r in rows], items) if line.endswith("True)")}
    rows = [r for r in rows if str(r["doc_id"]) not in dirty]
    kept = spark.createDataFrame(rows, docs.schema)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixed_sizes(kept).collect() if r["size"]}
    have = Counter(r["doc_id"] for r in got.collect())
    assert have == Counter({k: v for k, v in want.items() if v})
    shards = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs).collect()}
    assert all(shards[r["doc_id"]] == r["shard"] for r in got.collect())
    assert dirty and len(first) < len(ids)


def test_pipeline_stages_keep_columns_and_clean_documents(spark, messy, nothing):
    sf = "/root/testdata/sf0.001"
    for docs in (messy, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
