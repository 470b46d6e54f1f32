import re

import corpus_pipeline
from .test_resemblance import slow_classes


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(900_001, "12 34 !?", "en", "src1", 8), (900_002, None, "en", "src1", None), (900_003, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumns({"keep": docs.doc_id % 2, "score": docs.doc_id * 2})
    kept = [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, kept[-1], sf_dir).cache()
        assert out.columns == docs.columns, name
        assert out.exceptAll(kept[-1]).count() == 0, name
        kept.append(out)
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] - ids[1] == {900_001, 900_002, 900_003}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert not (ids[2] & bad) and len(good & ids[1] - ids[2]) <= 0.02 * len(good)
    rows = kept[2].select("doc_id", "text").collect()
    assert ids[3] == {min(rows[i].doc_id for i in c) for c in slow_classes([r.text for r in rows])}
    texts = {r.doc_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in kept[3].collect()}
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in texts[d] for d in ids[4] for i in items)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf_dir).collect()
    assert {p.doc_id for p in pieces} == ids[4]
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        assert out.count() == 0, name


def test_run_is_the_stages_in_turn(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns[:3] == ["doc_id", "start", "length"] and found.count() > 0


def test_clean_documents_without_id_stay(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(None, "one clean text", None, None, 14), (None, "and another clean one", None, None, 21), (None, f"Before. {item} Behind.", None, None, 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    kept = corpus_pipeline.decontamination(spark, corpus_pipeline.near_duplicates(spark, docs, sf_dir), sf_dir)
    assert {r.text for r in kept.collect()} == {"one clean text", "and another clean one"}
