import os

import pytest

import corpus_pipeline
from treelake.llm import privacy, quality

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        kept[name] = out.toPandas()
        docs = spark.createDataFrame(kept[name], docs.schema)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = quality.classify(spark.read.parquet(f"{DATA}/documents.parquet"), labels).toPandas()
    assert set(kept["quality"]["doc_id"]) == set(scored[scored["score"] >= 0.5]["doc_id"])
    norm = kept["exact_dedup"]["text"].map(lambda t: " ".join((t or "").split()))
    assert norm.is_unique and set(norm) == set(kept["quality"]["text"].map(lambda t: " ".join((t or "").split())))
    assert set(kept["near_dedup"]["doc_id"]) <= set(kept["exact_dedup"]["doc_id"])
    assert set(kept["pii"]["doc_id"]) == set(kept["near_dedup"]["doc_id"])
    counted = privacy.personal_data(docs).toPandas()
    assert counted[["n_email", "n_ip", "n_card", "n_phone"]].to_numpy().sum() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(packed["doc_id"]) == set(kept["pii"]["doc_id"])
