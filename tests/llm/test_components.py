"""Components of few edges are found at once, and as by rounds."""

import numpy as np

from tidemark.llm import near


def test_few_edges_are_one_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 540)]
    some = [(int(a), int(b)) for a, b in rng.integers(1000, 1060, (45, 2))]
    edges = spark.createDataFrame([*chain, *star, *some, (7, 7), (9, 8), (8, 9)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("components", "")
    try:
        few = {(r["id"], r["comp"]) for r in near.components(edges).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8
    assert {(i, 100) for i in range(100, 161)} | {(i, 500) for i in range(500, 540)} | {(8, 8), (9, 8)} <= few
    assert near.components(edges.limit(0)).count() == 0
    monkeypatch.setattr(near, "FEW", 0)
    assert few == {(r["id"], r["comp"]) for r in near.components(edges).collect()}
