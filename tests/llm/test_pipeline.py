from __future__ import annotations

import corpus_pipeline
from carrygrid.llm import near_dup, packing, passages, quality, toxicity
from carrygrid.llm.store import written
from tests.llm.conftest import SF


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    expected = {
        "toxicity": lambda d: ids(toxicity.report(d, labels).where("predicted = 0")),
        "quality_rules": lambda d: ids(quality.report(d, labels).where("kept")),
        "minhash_near_dedup": lambda d: ids(near_dup.near_duplicates(spark, d).where("kept")),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = written(spark, stage(spark, docs, SF), name)
        if name in expected:
            assert ids(out) == expected[name](docs)
        if name == "substring_dedup":
            touched = ids(passages.repeats(spark, docs))
            before = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.text == before[r.doc_id] or r.doc_id in touched for r in out.collect())
        if name == "best_fit_packing":
            assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
            assert out.agg({"length": "sum"}).first()[0] == packing.pieces(docs).agg({"length": "sum"}).first()[0]
        else:
            assert out.columns == columns and 0 < out.count() <= docs.count()
            docs = out
