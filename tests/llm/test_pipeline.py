import corpus_pipeline
from tidemark.llm import decontam

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        if name != "pack_tokens":
            assert out.columns == first.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name in ("toxicity", "near_dedup", "decontaminate"):
            assert 0 < docs.count() <= before.count()
        if name == "decontaminate":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontam.contamination(docs, bench).filter("n_hit > 0").count() == 0
            untouched = decontam.contamination(before, bench).filter("n_hit = 0").select("doc_id")
            assert untouched.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "mix":
            mixed = docs.count()
    assert docs.count() == mixed and set(docs.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_an_empty_corpus_goes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0
