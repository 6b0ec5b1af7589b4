"""Nulls, repeated rows, clashing names, damaged input, and the ways beyond a broadcast."""

import gzip

from pyspark.sql import functions as F

from tidemark.llm import decontam, exact, mixing, near, shared, warc

DOCS = "doc_id bigint, text string, source string"
CLASHES = ["_id", "_key", "_skey", "_th", "_n", "_part", "_at", "_row", "_k0", "row", "id", "th", "key", "n", "m", "p", "skey", "spans", "items", "kept", "same", "a.b"]


def clashing(docs):
    return docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASHES])


def untouched(rows):
    return all(r[c] == f"{c}-{'null' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHES)


def test_columns_of_the_user_stay_as_they_are(spark):
    rows = [(i, f"word{i} " * (5 + i % 7) + "b c d e f g h i" * (i % 5 == 0), "abc"[i % 3]) for i in range(60)] + [(None, "x y z", None), (None, None, None), (3, "other text", "a")]
    docs = clashing(spark.createDataFrame(rows + rows[:4], DOCS))
    bench = spark.createDataFrame([(1, "b c d e f g h i"), (2, "x y z")], "item_id bigint, text string")
    for made in (mixing.mix(docs), decontam.clean(docs, bench, cut=True), decontam.clean(docs, bench, least_items=1), near.without_copies(docs)):
        assert made.columns == docs.columns
        got = made.collect()
        assert got and untouched(got)


def test_null_and_repeated_ids_are_linear(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(None if i % 2 else 7, words(i), "s") for i in range(300)] + [(None, words(1) + " more", "s"), (7, words(0) + " more", "s")] + [(9, words(0), "s")] * 3
    docs = spark.createDataFrame(rows, DOCS)
    got = near.classes(docs).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 300
    assert sorted(r["class_size"] for r in got)[-7:] == [2, 2, 5, 5, 5, 5, 5]
    kept = near.without_copies(docs).collect()
    assert len(kept) == 300 and len({r["text"] for r in kept}) == 300
    one = near.without_copies(spark.createDataFrame([(1, "a b", "s")] * 5 + [(None, "c d", "s")] * 5, DOCS)).collect()
    assert sorted(r["text"] for r in one) == ["a b", "c d"]


def test_rows_are_numbered_and_summed_in_parts(spark):
    rows = spark.range(0, 5000, 1, 9).select((F.col("id") % 3).cast("string").alias("k"), "id")
    got = shared.numbered(rows, "k").collect()
    for k in "012":
        assert sorted(r["_at"] for r in got if r["k"] == k) == list(range(1, sum(r["k"] == k for r in got) + 1))
    got = shared.sums_before(rows.repartition(5), [F.col("k").desc(), F.col("id")], at=F.lit(1), ids=F.col("id")).collect()
    total = 0
    for i, r in enumerate(sorted(got, key=lambda r: (-int(r["k"]), r["id"]))):
        assert (r["at"], r["ids"]) == (i, total)
        total += r["id"]


def test_decontamination_beyond_the_broadcast(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.unionByName(spark.createDataFrame([(5000, None), (5001, "..."), (5001, "..."), (5002, "word " * 60000)], "doc_id bigint, text string"), allowMissingColumns=True)
    rows = [sorted(map(tuple, decontam.contamination(docs, bench, most=most).collect()), key=repr) for most in (1, 200_000)]
    assert rows[0] == rows[1] and any(r[2] for r in rows[0])
    texts = [sorted(map(repr, decontam.clean(docs, bench, cut=True, most=most).select("doc_id", "text").collect())) for most in (1, 200_000)]
    assert texts[0] == texts[1]
    plan = decontam.hits(docs, bench, ["doc_id"], most=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan


def test_large_groups_of_equal_texts(spark):
    rows = [(i // 2, f"t{i % 7}" if i % 3 else None, "s") for i in range(4000)] + [(None, f"t{i % 7}", "s") for i in range(20)] + [(9000, "long " * 100000, "s")] * 2
    docs = spark.createDataFrame(rows, DOCS)
    want = {}
    for i, t, _ in rows:
        want.setdefault(t or "", []).append(i)
    for share in (2, 256):
        got = exact.dedup(docs, share).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["doc_id"] is not None) == sorted((False, i, max(x for x in ids if x is not None), len(ids)) for ids in want.values() for i in ids if i is not None)
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(want)


def test_mixing_long_texts_and_many_equal_rows(spark):
    rows = [(1, "same words here", "a")] * 50 + [(i, "w " * (i % 30 + 1), "a") for i in range(2, 200)] + [(900, "z " * 100000, "b"), (901, "z", "b")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("other", F.monotonically_increasing_id())
    copies = mixing.copies(docs).collect()
    made = mixing.mix(docs)
    assert made.count() == sum(r["copies"] for r in copies)
    total = sum(r["copies"] for r in copies if r["doc_id"] == 1)
    per = [r["count"] for r in made.filter("doc_id = 1").groupBy("other").count().collect()]
    assert sum(per) == total and max(per) - min(per) <= 1


def test_revisits_with_odd_headers_times_and_ties(spark):
    schema = warc.RECORD
    rows = [
        ("r1", "response", "http://x.org/", 1000, 200, {"ETag": "1", "etag": "2", "Expires": "0"}, None),
        ("r2", "response", "http://x.org/", 2000, 200, {"ETag": "9"}, None),
        ("r3", "response", "http://x.org/", 2000, 200, {"ETag": "2"}, None),
        ("v1", "revisit", "http://x.org/", 1500, 304, {"ETAG": "2", "etag": "2"}, None),
        ("v2", "revisit", "http://x.org/", 2000, 304, {"ETag": "2"}, None),
        ("v2", "revisit", "http://x.org/", 2000, 304, {"ETag": "2"}, None),
        ("v3", "revisit", "http://x.org/", None, 304, None, None),
    ]
    records = spark.createDataFrame(rows, schema).withColumn("key", F.lit("clash")).withColumn("_b", F.lit(1)).withColumn("held", F.lit(2))
    for blocks in (1, 7):
        got = sorted((r["record_id"], r["found_id"], r["reason"]) for r in warc.resolve(records, blocks).collect())
        assert got == [("v1", "r1", "resolved"), ("v2", "r3", "resolved"), ("v2", "r3", "resolved"), ("v3", None, "no earlier response")]


def test_damaged_files_are_read_as_far_as_they_go(spark, tmp_path):
    one = {"record_id": "r", "kind": "response", "url": "http://x.org/", "at": 1000, "status": 200, "headers": {"ETag": "1"}, "payload": b"hello " * 50}
    parts = [warc.write([{**one, "record_id": f"r{i}"}]) for i in range(4)]
    zipped = [gzip.compress(p) for p in parts]
    (tmp_path / "date.warc").write_bytes(parts[0].replace(b"1970-01-01T", b"1970-99-01T") + parts[1].replace(b"200 X", b"2x0 X"))
    (tmp_path / "torn.warc.gz").write_bytes(zipped[2] + zipped[3][:-30])
    (tmp_path / "middle.warc.gz").write_bytes(zipped[0] + zipped[1][:20] + b"junk" * 9 + zipped[2] + b"\0" * 8)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = sorted((r["record_id"], r["at"] or 0, r["status"] or 0) for r in warc.read(spark, str(tmp_path), rows=1).collect())
    assert got == [("r0", 0, 200), ("r0", 1000, 200), ("r1", 1000, 0), ("r2", 1000, 200), ("r2", 1000, 200)]
    assert warc.moment("2024-02-30T00:00:00Z") is None and warc.moment(None) is None and warc.moment("1970-01-01T00:00:01.5+00:00") == 1500
