"""What the tables hold: secrets, near copies, and the rounding of the mix, against brute force."""

import collections
import re
import struct

import xxhash
from pyspark.sql import functions as F

from tests.llm.test_models import shingle_bag
from tidemark.llm import mixing, near, queries, secrets


def test_secrets_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t, re.I)}
    got = queries.op6_secret_scan(spark, sf).collect()
    found = {(r["doc_id"], *map(int, s.split(":"))) for r in got for s in r["spans"].split(",") if s}
    assert len(planted) >= 5 and len(planted & found) >= 0.95 * len(planted)
    others = sum(r["n_candidates"] for r in got) - len(planted)
    assert len(found - planted) <= 0.05 * others


def test_recall_of_near_copies(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bags = {r["doc_id"]: shingle_bag(r["text"]) for r in docs.collect()}
    holders = collections.defaultdict(list)
    for i, bag in bags.items():
        for g in bag:
            holders[g].append(i)
    of = {r["doc_id"]: r["class_id"] for r in near.classes(docs).collect()}
    links = met = 0
    for i in (i for i in bags if i % 50 == 0):
        for j in {j for g in bags[i] for j in holders[g]} - {i}:
            both = sum((bags[i] & bags[j]).values())
            if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                links, met = links + 1, met + (of[i] == of[j])
    assert met >= 0.9 * links


def draw(seed, *numbers):
    """What Spark's xxhash64 makes of an int and some longs, as a number in [0, 1)."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for n in numbers:
        h = h if n is None else xxhash.xxh64_intdigest(struct.pack("<q", n), h)
    return (h % (1 << 52)) / (1 << 52)


def test_rounding_of_the_mix_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hashes = {r["doc_id"]: r["th"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    got = {r["doc_id"]: r for r in queries.op10_mix(spark, sf).collect()}
    by = collections.defaultdict(list)
    for i, r in got.items():
        by[sources[i]].append(i)
    for ids in by.values():
        assert len(ids) <= mixing.BLOCK
        share = got[ids[0]]["target"] / max(1, got[ids[0]]["source_size"])
        base = int(share + mixing.EPS)
        p = max(0.0, share - base)
        p = 0.0 if p < mixing.EPS else 1.0 if p > 1 - mixing.EPS else p
        done, live = {}, None
        for unit in sorted((-got[i]["size"], i) for i in ids):
            x = [-unit[0], unit[1], p]
            if x[0] == 0 or p in (0.0, 1.0):
                done[x[1]] = float(draw(0, x[1], hashes[x[1]], 1) < p)
                continue
            if live is None:
                live = x
                continue
            up, down = min(live[0] * (1 - live[2]), x[0] * x[2]), min(live[0] * live[2], x[0] * (1 - x[2]))
            t = up if draw(0, live[1], hashes[live[1]], 1, x[1], hashes[x[1]], 1) * (up + down) < down else -down
            pair = [[live[0], live[1], live[2] + t / live[0]], [x[0], x[1], x[2] - t / x[0]]]
            live = None
            for d in pair:
                d[2] = 0.0 if d[2] < mixing.EPS else 1.0 if d[2] > 1 - mixing.EPS else d[2]
                if d[2] in (0.0, 1.0):
                    done[d[1]] = d[2]
                elif live is None:
                    live = d
        if live is not None:
            done[live[1]] = float(draw(-1, live[1], hashes[live[1]], 1) < live[2])
        assert {i: got[i]["taken"] for i in ids} == {i: (base + int(done[i])) * got[i]["size"] for i in ids}
