"""The language models count every bigram, however rare its words."""

import math

from pyspark.sql import functions as F

from tests.compare import same
from tests.llm.test_models import brute_lm
from tidemark.llm import lm, queries

SF = "/root/testdata/sf0.001"


def test_order_of_rare_words_counts(spark):
    """Target and background have the same words, all rarer than a thousand others, in another order."""
    often = " ".join(f"often{i}" for i in range(1001))
    docs = [(0, often), (1, often), (2, often)] + [(10 + i, f"left{i} right{i}") for i in range(20)] + [(40 + i, f"right{i} left{i}") for i in range(20)]
    got = {r["doc_id"]: r["score"] for r in lm.scores(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(10 + i,) for i in range(20)], "doc_id bigint")).collect()}
    assert len(got) == 43 and all(got[10 + i] > got[40 + i] + 0.1 for i in range(20))


def test_all_bigrams_against_brute_force(spark):
    odd = spark.createDataFrame([(10001, None), (10002, "!!"), (10003, "word " * 20000), (None, "no id")], "doc_id bigint, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd)
    target = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    want = brute_lm([(r["doc_id"], r["text"]) for r in docs.collect()], {r["doc_id"] for r in target.collect()}, 10**9)
    # One block a partition, and many of them, with documents longer than a block.
    for block, bucket in ((lm.BLOCK, lm.BUCKET), (500, 100)):
        got = lm.scores(docs, target, block=block, bucket=bucket).collect()
        assert len(got) == docs.count()
        for r in got:
            n, t, b = want[r["doc_id"]]
            assert r["n_tokens"] == n and math.isclose(r["loss_target"], t, abs_tol=1e-9) and math.isclose(r["score"], b - t, abs_tol=1e-9)
    assert lm.scores(docs.limit(0), target).count() == 0
    assert {r["score"] for r in lm.scores(docs.limit(40), target.limit(0)).collect()} != {0.0}
    assert lm.scores(docs.select(F.col("doc_id"), F.lit(None).cast("string").alias("text")).limit(5), target).filter("score = 0 and n_tokens = 0").count() == 5


def test_query_against_duckdb(spark):
    same(spark, SF, queries.op5_lm_score, queries.ORACLE_SQL["op5_lm_score"])
