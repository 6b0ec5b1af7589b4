"""Operators of DataFrame functions against SQL and brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tidemark.llm import decontam, exact, mixing, pii, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_heavy_light_null_and_repeated(spark):
    rows = [(i, "hot", "s") for i in range(300)] + [(299, "hot", "s"), (None, "hot", None), (500, None, "s"), (501, "", "s"), (502, "one", "s"), (502, "one", "s"), (None, "alone", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("text_sha256", F.lit("clash")).withColumn("kept", F.lit(1))
    for share in (2, 256):  # the hot text goes the heavy way, or everything the light way
        got = exact.dedup(docs, share).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r["text_sha256"], []).append(r)
        assert all(sum(r["kept"] for r in own) == 1 for own in by.values())
        hot = by[hashlib.sha256(b"hot").hexdigest()]
        assert len(hot) == 302 and {(r["keep_id"], r["group_size"]) for r in hot} == {(299, 302)}
        assert [r["doc_id"] for r in by[hashlib.sha256(b"").hexdigest()] if r["kept"]] == [501]
    assert exact.dedup(empty(spark)).count() == 0
    assert exact.heavy(spark.createDataFrame([(i % 3, str(i % 3)) for i in range(99)], "doc_id bigint, d string"), "d", 4).count() == 3


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_pii_base_spans_as_the_plain_patterns_find_them(spark):
    texts = [None, "", "a@b.c_d@e.f.g a@b..c@d.e x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559", "+1 (212) 555-0199 é😀+44 20 7946 0958 +1", "1" * 30000 + " " + "a" * 30000, "a@b" + ".c" * 5000, "😀 joe@x.com 10.0.0.1 " * 700]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "source"))
    truth = {r["doc_id"]: brute_spans(r["text"]) for r in docs.collect()}
    for r in pii.report(docs).collect():
        want = truth[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k + ":") for s in want) for k in PLAIN]
        assert r["spans"].split(",")[: len(want)] == (want or [""])[: len(want)]
    assert pii.report(empty(spark)).count() == 0


def test_pii_terms_that_give_an_entity_away(spark):
    letters = "abcdefgh"
    rows = [(i, f"Contact zorblax al{letters[i % 7]} be{letters[i % 5]} joe@x.com ga{letters[i % 3]} delta", "s") for i in range(40)]
    rows += [(100 + i, f"the al{letters[i % 7]} be{letters[i % 5]} ga{letters[i % 3]} delta contact", "s") for i in range(400)]
    rows += [(900 + i, "Contact unusualword same words jim@y.com here", "s") for i in range(30)]  # copies are no evidence
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert all("term:8:15" in got[i]["spans"] and got[i]["n_term"] == 1 for i in range(40))
    assert all(r["n_term"] == 0 for i, r in got.items() if i >= 100)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    assert clean[0] == "Contact  ala bea [email] gaa delta" and clean[100] == rows[40][1]


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "Hello a, B. c d e f g h i j!! tail\nnew", "s"), (2, "x Y z", "s"), (3, None, "s"), (4, "(a b c d e f g h) then A-B-C-D-E-F-G-H.", "s"), (4, "clean ü text", "s"), (None, "short one", "s")], DOCS)
    bench = spark.createDataFrame([(1, "b c d e f g h i"), (2, "a b c d e f g h"), (3, "Short"), (4, None), (5, "..."), (None, "tail")], "item_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.contamination(docs.withColumn("key", F.lit(1)).withColumn("items", F.lit(1)), bench).collect())
    assert got == [(0, 2, 1, 1, False), (1, 13, 9, 2, True), (2, 3, 0, 0, False), (3, 0, 0, 0, False), (4, 3, 0, 0, False), (4, 17, 16, 1, False)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in decontam.clean(docs, bench).collect() if r["text"])
    assert [k for k, _ in kept] == [0, 2, 4, 4]
    cut = {(r["doc_id"], r["text"]) for r in decontam.clean(docs, bench, least_items=9, cut=True).collect()}
    assert (1, "Hello  j!! tail\nnew") in cut and (4, "() then .") in cut and (4, "clean ü text") in cut and (None, " one") in cut
    none = bench.limit(0)
    assert decontam.contamination(docs, none).filter("n_hit > 0").count() == 0 and decontam.contamination(empty(spark), bench).count() == 0
    assert decontam.clean(docs, none, cut=True).count() == docs.count()


def water(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * len(sizes)))
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weights[s] for s in sizes if s not in capped)
        goal = {s: 3 * sizes[s] if s in capped else left * weights[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_mixing_targets_mass_and_caps(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), s) for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 200 + [None] * 15 + ["e"] * 700)]
    rows += [(5000, None, "a"), (5001, "", "zero"), (7, rows[7][1], "a"), (7, rows[7][1], "a"), (None, "x y", "b"), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    for block in (16, 256):
        got = mixing.copies(docs, block=block).collect()
        assert len(got) == len(rows)
        sizes, taken, most = {}, {}, {}
        for r in got:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
            taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
            most[r["source"]] = max(most.get(r["source"], 0), r["size"])
            assert 0 <= r["copies"] <= 3
        goal = water(sizes)
        assert {r["source"]: r["target"] for r in got} == pytest.approx(goal)
        assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)
        again = sorted((r["doc_id"] or -1, r["th"], r["i"], r["copies"]) for r in mixing.copies(docs.repartition(7), block=block).collect())
        assert again == sorted((r["doc_id"] or -1, r["th"], r["i"], r["copies"]) for r in got)
        assert mixing.mix(docs, block=block).count() == sum(r["copies"] for r in got)
        assert mixing.mix(docs, block=block).columns == docs.columns
    assert mixing.shares(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_mixing_is_unbiased(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "a" if i < 60 else "b") for i in range(100)], DOCS)
    totals, share = {}, {}
    for seed in range(12):
        for r in mixing.copies(docs, seed=seed * 100, block=32).collect():
            totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["copies"]
            share[r["doc_id"]] = r["target"] / r["source_size"]
    gap = sum(totals[i] / 12 - share[i] for i in totals) / len(totals)
    assert abs(gap) < 0.1
