"""run() against the stages put together by hand, and the stages on empty input."""

import corpus_pipeline
from kinweave.llm import minhash, queries, secret_scan, toxicity
from tests.llm.test_operators import brute_classes

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    data = [(r.doc_id, r.text or "") for r in docs.collect() if model(r.text or "") < 0.5]
    classes = brute_classes(data)
    left = {i: secret_scan.redacted(t) for i, t in data if classes[i] == i}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    assert [c for c in corpus_pipeline.STAGES[1][1](spark, docs, SF).columns] == docs.columns


def test_registered():
    assert [k for k in queries.QUERIES if k.startswith("op")] == sorted((k for k in queries.QUERIES if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")} == set(range(1, 14))
    assert minhash.SIMILARITY == 0.8 and minhash.WORDS == 5
