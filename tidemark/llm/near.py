"""Near-duplicates by BagMinHash: weighted Jaccard of word-shingle multisets.

Signatures: every distinct shingle of a text, with its number of occurrences as weight, drives Poisson processes
over the weight axis, cut at 0, 1, 2, 4, 8 and so on. A process is seeded by shingle and interval alone, so texts
share its points; a point counts for a text if its place on the weight axis (a whole cell, so weights are
discretised) lies below the text's weight. Points come in ascending order, each falls into one of the signature's
registers, which keep their least point, and a process ends as soon as its points exceed all registers. Two registers
are equal with exactly the probability of the weighted Jaccard similarity.

Candidates: ``BANDS`` bands of ``ROWS`` registers; texts that share a band share a bucket. Equal word sequences are
one node. Within a bucket pairs are not all emitted. In each of ``PIVOTS`` rounds one member, the one farthest from the
pivots so far, is compared with all others, and verified links merge classes; buckets with a single class are done.
What is left of the others is compared in pairs of bounded blocks, without the pairs that distances to the pivots rule
out. So every link between members of a bucket is verified, implied by others, or ruled out exactly. Similarities
are multiset overlaps of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fits, gram_hashes, held, let, numbered, scratch, small_join, stage, unheld, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
PIVOTS = 2
#: Elements of a block of members that one task compares.
BLOCK = 1_000_000
#: Edges up to which a single task finds the components; more are settled round by round over shuffled tables.
FEW = 200_000

_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def bags(flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of shingles, text by text: text and shingle of each occurrence in sorted order, its rank among equal ones, and where runs begin."""
    doc = np.repeat(np.arange(len(lens)), lens)
    order = np.lexsort((flat, doc))
    doc, flat = doc[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    rank = np.arange(len(flat)) - np.repeat(heads, np.diff(np.append(heads, len(flat))))
    return doc, flat, rank, heads


def signatures(flat: np.ndarray, lens: np.ndarray, registers: int) -> np.ndarray:
    """A row of ``registers`` numbers for each text; of a text without shingles all are infinite."""
    doc, shingle, _, heads = bags(flat.view(np.uint64), lens)
    weight = np.diff(np.append(heads, len(doc)))
    doc, shingle = doc[heads], shingle[heads]
    seeds, docs, sizes, lows, weights = [mixed(shingle)], [doc], [np.ones(len(doc), np.int64)], [np.zeros(len(doc), np.int64)], [weight]
    low = 1
    while (more := np.flatnonzero(weight > low)).size:  # the interval from low to 2 * low
        seeds.append(mixed(shingle[more] + np.uint64(low * 0x9E3779B97F4A7C15 % 2**64)))
        docs.append(doc[more])
        sizes.append(np.full(len(more), low))
        lows.append(np.full(len(more), low))
        weights.append(weight[more])
        low *= 2
    seed, doc, size, low_, weight = map(np.concatenate, (seeds, docs, sizes, lows, weights))
    if len(seeds) > 1:
        order = np.argsort(doc, kind="stable")
        seed, doc, size, low_, weight = (a[order] for a in (seed, doc, size, low_, weight))
    least = np.full((len(lens), registers), np.inf)
    cells = least.ravel()
    x = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        h = mixed(seed + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        x = x - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
        g = mixed(h ^ _A)
        at = doc * registers + ((g >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        hit = x < cells[at]
        partial = np.flatnonzero(size > 1)
        hit[partial] &= low_[partial] + (g[partial] & np.uint64(0xFFFFFFFF)).astype(np.int64) % size[partial] < weight[partial]
        np.minimum.at(cells, at[hit], x[hit])
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        limit = np.repeat(least[doc[first]].max(1), np.diff(np.append(first, len(doc))))
        go = x <= limit
        seed, doc, size, low_, weight, x = seed[go], doc[go], size[go], low_[go], weight[go], x[go]
    return least


def band_keys(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One bucket key per text and band."""
    bits = np.ascontiguousarray(least).view(np.uint64).reshape(len(least), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD), bits.shape[:2])
    for k in range(rows):
        key = mixed((key ^ bits[:, :, k]) * _GOLD + np.uint64(k))
    return key.view(np.int64)


def shingles(ws: Column, n: int = SHINGLE) -> Column:
    """From words, hashes of all runs of ``n``; of fewer words, one hash of them all."""
    some = lambda h: F.when(F.size(h) >= n, gram_hashes(h, n)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(ws, lambda w: F.xxhash64(w)), some)


def node(ws: Column) -> Column:
    """Identity of a word sequence, 16 bytes."""
    return F.unhex(F.md5(F.array_join(ws, " ").cast("binary")))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")).alias("id")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64), np.diff(ends)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, shingles) to (id, node, bands), some hundred thousand shingles at a time."""
    for batch in batches:
        _, lens = _lists(batch.column(2))
        cuts = np.flatnonzero(np.diff(np.cumsum(lens) // 250_000, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(lens))):
            some = batch.slice(a, b - a)
            flat, lens_ = _lists(some.column(2))
            keys = band_keys(signatures(flat, lens_, BANDS * ROWS))
            count = np.where(lens_ > 0, BANDS, 0)
            made = pa.ListArray.from_arrays(np.append(0, np.cumsum(count)).astype(np.int32), keys[lens_ > 0].ravel())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), made], ["id", "node", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, shingles) to (nid, els): each occurrence of a shingle becomes an element of its own."""
    for batch in batches:
        flat, lens = _lists(batch.column(1))
        _, shingle, rank, _ = bags(flat.view(np.uint64), lens)
        els = mixed(shingle + rank.astype(np.uint64) * _GOLD).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.append(0, np.cumsum(lens)).astype(np.int32), els)], ["nid", "els"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) to (id, comp): ids hook on to lesser ones, and paths are halved, until no edge joins two components."""
    both = [[b.column(k).to_numpy() for k in (0, 1)] for b in batches]
    if not both:
        return
    ids, flat = np.unique(np.concatenate([np.concatenate(side) for side in zip(*both)]), return_inverse=True)
    x, y = np.split(flat, 2)
    comp = np.arange(len(ids))
    while (comp[x] != comp[y]).any():
        least = np.minimum(comp[x], comp[y])
        for side in (comp[x], comp[y]):
            np.minimum.at(comp, side, least)
        while (comp[comp] != comp).any():
            comp = comp[comp]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[comp])], ["id", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): id, comp, where comp is the least id of the component; ids without edges are absent.

    Up to ``FEW`` edges are one task's. More take large-star and small-star steps in turn, until nothing changes; every step is
    written, groups are aggregated to their least member before they are shuffled, and no component is ever gathered.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "cc")
    if fits(edges, FEW):
        return stage(edges.coalesce(1).mapInArrow(_joined, "id bigint, comp bigint"), "cc")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = stage(small, "cc")
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before or not now[0]:
            break
        before = now
    comps = edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return comps.unionByName(comps.select(F.col("comp").alias("id"), "comp").distinct())


def _similar(pairs: DataFrame, els: DataFrame) -> DataFrame:
    """The pairs (a, b) with the weighted Jaccard similarity j of their multisets."""
    left, right = els.select(F.col("nid").alias("a"), F.col("els").alias("ea")), els.select(F.col("nid").alias("b"), F.col("els").alias("eb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size("ea").alias("na"), F.size("eb").alias("nb"), F.size(F.array_intersect("ea", "eb")).alias("i"))
    return both.select("a", "b", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("j"))


def _pairs(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _block_links(similarity: float):
    """For two blocks of a bucket (``i`` equal to ``j``: one block), the links between members of different classes.

    A pair is looked at in the first band that it shares, and only if its distances to all pivots allow a link (1 minus
    the similarity is a metric). Links merge classes at once, and merged classes are not compared further.
    """

    def links(group: pd.DataFrame) -> pd.DataFrame:
        own = group["block"].to_numpy()
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        bands = np.stack(group["bands"].to_numpy())
        far = np.stack(group["far"].to_numpy())
        nid, comp = group["nid"].to_numpy(), group["comp"].to_numpy().copy()
        els = [np.sort(e) for e in group["els"]]
        sizes = np.array([len(e) for e in els])
        band = int(np.flatnonzero((bands == group["key"].iloc[0]).all(0))[0])
        rows = np.flatnonzero(own == i)
        found = []
        for x in rows:
            others = np.flatnonzero((own == j) & ((nid > nid[x]) if i == j else True) & (comp != comp[x]))
            others = others[(np.abs(far[others] - far[x]) <= 1 - similarity + 1e-9).all(1) & (np.minimum(sizes[others], sizes[x]) >= np.maximum(sizes[others], sizes[x]) * similarity)]
            others = others[~(bands[others, :band] == bands[x, :band]).any(1)]
            if not len(others):
                continue
            flat = np.concatenate([els[y] for y in others])
            at = np.minimum(np.searchsorted(els[x], flat), sizes[x] - 1)
            shared = np.add.reduceat((els[x][at] == flat).astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
            for y in others[shared >= (sizes[others] + sizes[x] - shared) * similarity]:
                if comp[y] != comp[x]:
                    found.append((nid[x], nid[y]))
                    comp[comp == comp[y]] = comp[x]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return links


def _unsettled_links(left: DataFrame, nodes: DataFrame, els: DataFrame, similarity: float, most: int = BLOCK) -> DataFrame:
    """Links (a, b) that remain in buckets of several classes, found in pairs of blocks of about ``most`` elements."""
    rows = left.select("key", "nid", "comp", "far").join(nodes.select("nid", "bands"), "nid").join(els, "nid")
    sizes = left.join(els.select("nid", F.size("els").alias("n")), "nid").groupBy("key").agg(F.ceil(F.sum("n") / most).alias("blocks"))
    rows = small_join(rows, stage(sizes, "near-blocks"), "key").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    rows = rows.withColumn("_o", other).withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_o", "blocks")
    return rows.groupBy("key", "i", "j").applyInPandas(_block_links(similarity), "a bigint, b bigint")


def _classes(docs: DataFrame, similarity: float, pivots: int) -> DataFrame:
    """What ``classes`` gives, with th: the hash of the row's text."""
    sign = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), words(F.col("text")).alias("ws"))
    sign = sign.select(F.struct("doc_id", _text_key().alias("th")).alias("id"), node(F.col("ws")).alias("node"), shingles(F.col("ws")).alias("shingles"))
    sign = stage(sign.mapInArrow(_sign, "id struct<doc_id:bigint,th:bigint>, node binary, bands array<bigint>"), "near-bands")
    # Of a node the row with the least doc_id stands for it, nulls last; texts with the same th and doc_id are equal.
    rep = F.min(F.struct(F.col("id.doc_id").isNull().alias("none"), "id.doc_id", "id.th"))
    nodes = sign.groupBy("node").agg(rep.alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("nid"), "node", "rep", "n", "bands"), "near-nodes")
    bands = nodes.select(F.explode("bands").alias("key"), "nid")
    shared = bands.groupBy("key").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).filter("lo != hi").select("key")
    members = stage(small_join(bands, stage(shared, "near-keys"), "key"), "near-members")
    some = stage(small_join(nodes.select("nid", "rep"), members.select("nid").distinct(), "nid", "left_semi"), "near-some")
    reps = some.select("nid", F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _text_key().alias("th"))
    texts = texts.join(F.broadcast(reps) if fits(reps) else reps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("nid", words(F.col("text")).alias("ws"))
    els = stage(texts.select("nid", shingles(F.col("ws")).alias("shingles")).mapInArrow(_elements, "nid bigint, els array<bigint>").dropDuplicates(["nid"]), "near-elements")
    comp = some.select(F.col("nid").alias("id"), F.col("nid").alias("comp"))
    state, known = members.select("key", "nid", F.array().cast("array<double>").alias("far")), None
    for turn in range(pivots + 1):
        now = state.join(comp.withColumnRenamed("id", "nid"), "nid")
        parts = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.array_min("far"), F.xxhash64("nid"), "nid")).alias("lead"))
        open_ = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.max("lead").alias("lead"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("key", F.col("top.comp").alias("main"), F.col("lead.nid").alias("pivot"))
        left = stage(now.join(open_, "key"), "near-left")  # buckets that hold members of several classes
        if left.isEmpty():
            break
        if turn < pivots:
            wanted = left.filter("nid != pivot").select(*_pairs("pivot", "nid")).distinct()
            new = stage(_similar(wanted if known is None else wanted.join(known, ["a", "b"], "left_anti"), els), "near-pairs")
            known = new if known is None else known.unionByName(new)
            links = new.filter(F.col("j") >= similarity)
        else:
            links = stage(_unsettled_links(left, nodes, els, similarity), "near-links")
        links = links.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(links).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        comp = stage(small_join(comp, merged, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "near-classes")
        if turn < pivots:
            seen = left.select("key", "nid", "far", "pivot", *_pairs("pivot", "nid")).join(known, ["a", "b"], "left")
            state = stage(seen.select("key", "nid", F.concat("far", F.array(F.when(F.col("nid") == F.col("pivot"), 0.0).otherwise(1 - F.col("j")))).alias("far")), "near-state")
    of = small_join(nodes.select("nid", "node", "rep", "n"), comp.withColumnRenamed("id", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    of = stage(of, "near-of")
    every = of.groupBy("comp").agg(F.min("rep").alias("head"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("nodes"))
    # A class of one node is settled by the node itself; the others meet their class, and only where classes are small in number all at once.
    of = stage(small_join(of, every.filter("nodes > 1").select("comp", "head", "class_size"), "comp", "left").select("node", F.coalesce("head", "rep").alias("head"), F.coalesce("class_size", "n").alias("class_size")), "near-result")
    # Equal rows are one until the end; of those that stand for the class exactly one stays.
    rows = sign.groupBy("id", "node").agg(F.count(F.lit(1)).alias("m")).join(of, "node")
    top = F.col("id.doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("id.th") == F.col("head.th"))
    rows = rows.select("id.doc_id", F.col("head.doc_id").alias("class_id"), "class_size", "node", F.col("id.th").alias("th"), top.alias("top"), F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("i"))
    return rows.select("doc_id", "class_id", "class_size", (F.col("top") & (F.col("i") == 1)).alias("kept"), "node", "th")


def classes(docs: DataFrame, similarity: float = SIMILARITY, pivots: int = PIVOTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, class_size, kept, node.

    A class holds texts that links of at least ``similarity`` connect; class_id is its least doc_id, and of the
    class one row with that doc_id stays. Texts without words (null too) are all equal. Texts under five words
    are one shingle. A null doc_id stays only in a class without others. Of repeated rows each gets a row, and one at most
    stays. An empty table gives no rows; other columns are ignored. Whole texts are read.
    """
    return _classes(docs, similarity, pivots).drop("th")


def without_copies(docs: DataFrame, similarity: float = SIMILARITY, pivots: int = PIVOTS) -> DataFrame:
    """``docs`` with one row of each class, columns as before, whatever their names.

    Which row stays is as in ``classes``; of rows that repeat both doc_id and text any one stays, as it is. Nulls and
    empty texts are as there, and an empty table stays empty.
    """
    with scratch(docs.sparkSession):
        found = _classes(docs, similarity, pivots).groupBy("doc_id", "th").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
        gone = stage(found.filter("not kept or n > 1").select(_id_key(), "th", "kept"), "near-gone", keep=True)
    rows = small_join(held(docs, id=_id_key(), th=_text_key()), gone, ["id", "th"], "left").filter(F.coalesce("kept", F.lit(True)))
    if gone.filter("kept").isEmpty():
        return unheld(rows, docs.columns)
    again = numbered(rows.filter("kept").select(F.concat_ws(" ", "th", "id").alias("same"), "row"), "same").filter("_at = 1")
    return unheld(rows.filter("kept is null").select("row").unionByName(again.select("row")), docs.columns)
