"""Terms that disclose an entity, wherever in the document they stand and however rare the value is."""

import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import pii

DOCS = "doc_id bigint, text string, source string"


def test_terms_far_away_and_of_rare_values(spark):
    rng = np.random.default_rng(4)
    common = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    fill = lambda i: " ".join(rng.choice(common, 40))
    rows = [(i, f"zorblax {fill(i)} joe@x.com", "s") for i in range(20)]  # 40 words lie between them
    rows += [(100 + i, f"quibbert {fill(i)} user{i}@rare.org", "s") for i in range(20)]  # no value occurs twice
    rows += [(200 + i, f"flimdorp {fill(i)} 10.{i}.3.4", "s") for i in range(20)]  # only the kind is common
    rows += [(1000 + i, fill(i + 50), "s") for i in range(600)]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert all("term:0:7" in got[i]["spans"] for i in range(20))
    assert all("term:0:8" in got[i]["spans"] for k in (100, 200) for i in range(k, k + 20))
    assert all(r["n_term"] == 0 for i, r in got.items() if i >= 1000) and all(r["n_term"] <= 3 for r in got.values())


def test_terms_are_counted_once_a_bag_whichever_way(spark):
    texts = ["Alpha beta joe@x.com", "beta ALPHA, alpha joe@x.com", "gamma beta", "gamma  beta!", "gamma", "", None, "delta"] + ["copied words here"] * 50
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    sizes = docs.select(pii._bag(pii._words()).alias("bag")).groupBy("bag").agg(F.count(F.lit(1)).alias("n"))
    bags = {frozenset(re.findall(r"[a-z]{2,}", re.sub(r"\S+@\S+", " ", (t or "").lower()))) for t in texts}
    want = {w: sum(w in b for b in bags) for b in bags for w in b}
    names = spark.createDataFrame([(w,) for w in want], "w string").select(F.xxhash64("w").alias("t"), "w")
    for rows in (1000, 0):  # repeated bags fit a broadcast, or not
        got = pii._term_counts(docs, sizes, rows).join(names, "t", "left").collect()
        assert {r["w"]: r["n_term"] for r in got} == want
    assert sizes.count() == len(bags)
