"""Scores by cross-entropy difference: matched target and background n-gram models over one vocabulary.

Both are bigram models of words. Every word of the corpus is in the vocabulary and every bigram is counted, however rare:
P(c | p) = WEIGHT * n(p, c) / n(p) + (1 - WEIGHT) * u(c), where u(c) = (1 - FLOOR) * n(c) / N + FLOOR * q(c) with q from all
documents. The models are matched: the same words, the same weights, relative frequencies only, and a floor that both take
from the whole corpus. So the size of the target or of the background by itself changes nothing, and what one model has not
seen costs the same in either. A target document is scored by models that counted it, as all documents are.

Documents are kept in blocks of about ``BLOCK`` words. A block counts its own words and bigrams and asks for each distinct
one once, by bucket of keys; buckets add up, and answer only what several blocks have: of the rest a block's own counts are
the corpus's. Nothing is broadcast or gathered but five numbers, so the tables may grow with the corpus, and a frequent
word is a row a block.

With ``classes`` given, bigrams are those of word classes: the most frequent words, at most so many, are a class each, all others
are one class and are told apart by how often they occur in it: P(c | p) = P(class of c | class of p) * p(c | class of c), where
p(c | C) = (1 - FLOOR) * n(c) / n(C) + FLOOR * the same of all documents. That model's table of bigrams is of bounded size. A
document's loss is a sum over its bigrams of classes and its words, so the classes' costs and those of the more frequent words,
a bounded number, are broadcast; documents meet the other words in one shuffle, which no frequent word takes part in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near import mixed
from .shared import scratch, small_join, stage, words

#: Words of a block, about, which one task holds, and words of the corpus for each bucket of keys.
BLOCK, BUCKET = 1_000_000, 1_000_000
#: Share of all words from which on a word's cost is broadcast: at most 1 / share words.
FREQUENT = 4e-6
WEIGHT, FLOOR = 0.6, 0.1


def _hashes() -> Column:
    return F.transform(words(F.col("text")), lambda w: F.xxhash64(w))


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's arrays of word hashes (the second column): the row of each word, its hash, and whether it is the first."""
    column = batch.column(1)
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
    lens = np.diff(ends)
    first = np.zeros(len(flat), bool)
    first[(ends[:-1] - ends[0])[lens > 0]] = True
    return np.repeat(np.arange(len(lens)), lens), flat, first


def _tally(batch: pa.RecordBatch, row: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """How often each key occurs, and how often in target documents."""
    t = batch.column(0).to_numpy(zero_copy_only=False)[row]
    keys, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64)), pa.array(np.bincount(inverse, t, len(n)).astype(np.int64))], ["key", "n", "nt"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, hashes) to (key, n, nt) of words."""
    for batch in batches:
        row, flat, _ = _tokens(batch)
        yield _tally(batch, row, flat)


def _classes(flat: np.ndarray, top: np.ndarray) -> np.ndarray:
    """1 and up for words in ``top`` (sorted), 0 for all others."""
    if not len(top):
        return np.zeros(len(flat), np.int64)
    at = np.minimum(np.searchsorted(top, flat), len(top) - 1)
    return np.where(top[at] == flat, at + 1, 0)


def _steps(flat: np.ndarray, first: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word, and its bigram: the class before it (that of a beginning is the last) and its own, as one number."""
    own = _classes(flat, top)
    before = np.where(first, len(top) + 1, np.roll(own, 1))
    return own, before * (len(top) + 1) + own


def _count_steps(top: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, flat, first = _tokens(batch)
            yield _tally(batch, row, _steps(flat, first, top)[1])

    return count


def _costs(key: np.ndarray, n: np.ndarray, nt: np.ndarray, k: int) -> list[np.ndarray]:
    """Of target and background, what each bigram of ``k + 1`` classes (and the beginning) costs."""
    every = np.zeros((2, (k + 2) * (k + 1)))
    every[0, key], every[1, key] = nt, n - nt
    every = every.reshape(2, k + 2, k + 1)
    one = every.sum(1)
    floor = (one.sum(0) + 1) / (one.sum() + k + 1)
    out = []
    for m in (0, 1):
        total, heads = one[m].sum(), every[m].sum(1, keepdims=True)
        uni = (1 - FLOOR) * one[m] / total + FLOOR * floor if total else floor
        seen = WEIGHT * every[m] / np.maximum(heads, 1) + (1 - WEIGHT) * uni
        out.append(-np.log(np.where(heads > 0, seen, uni)).ravel())
    return out


def _added(sent):
    """(row, hashes) to the costs of all bigrams and of the frequent words, and the others' keys: row, n, vt, vb, rest."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, steps, keys, values = sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                row, flat, first = _tokens(batch)
                own, step = _steps(flat, first, top)
                count = lambda of, weights=None: np.bincount(of, weights, batch.num_rows)  # noqa: B023, E731
                row_, flat = row[own == 0], flat[own == 0]
                at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
                met = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
                sums = [(count(row, steps[m][step]) + count(row_[met], values[m][at[met]])).astype(np.float64) for m in (0, 1)]
                rest = pa.ListArray.from_arrays(np.append(0, np.cumsum(count(row_[~met]))).astype(np.int32), flat[~met])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(row).astype(np.int64)), *map(pa.array, sums), rest], ["row", "n", "vt", "vb", "rest"])

    return add


def _squeezed(of: np.ndarray) -> bytes:
    """Numbers byte by byte, first all lowest ones; most of the higher ones are zeros."""
    of = np.ascontiguousarray(of)
    return zlib.compress(np.ascontiguousarray(of.view(np.uint8).reshape(-1, of.itemsize).T).tobytes(), 1)


def _full(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _gaps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, each in as few bytes as the largest needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = -(-int(gaps[1:].max(initial=1)).bit_length() // 8)
    return gaps[:1].tobytes() + gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _keys(data: bytes, count: int) -> np.ndarray:
    gaps = np.zeros((count, 8), np.uint8)
    gaps[0] = np.frombuffer(data, np.uint8, 8)
    if count > 1:
        rest = np.frombuffer(data, np.uint8, offset=8).reshape(count - 1, -1)
        gaps[1:, : rest.shape[1]] = rest
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


class Block:
    """Documents as words of a vocabulary of their own, the most frequent first."""

    SCHEMA = "block bigint, n bigint, nt bigint, docs bigint, docs_t bigint, ids array<bigint>, lens binary, t binary, vocab binary, words binary"
    #: What stands before the first word of a document.
    START = np.uint64(0x9FB21C651E98DF25)

    def __init__(self, row: dict):
        self.number, self.ids = row["block"], row["ids"]
        self.lens, self.t = np.frombuffer(row["lens"], "<u4").astype(np.int64), np.frombuffer(row["t"], np.uint8)
        self.vocab, self.words = np.frombuffer(row["vocab"], "<u8"), _full(row["words"], "<u4").astype(np.int64)

    @staticmethod
    def made(number: int, ids: list, lens: np.ndarray, t: np.ndarray, flat: np.ndarray) -> dict:
        vocab, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        sums = {"n": int(lens.sum()), "nt": int(lens[t > 0].sum()), "docs": int((lens > 0).sum()), "docs_t": int((lens[t > 0] > 0).sum())}
        return {"block": number, **sums, "ids": ids, "lens": lens.astype("<u4").tobytes(), "t": t.astype(np.uint8).tobytes(), "vocab": vocab[order].astype("<i8").tobytes(), "words": _squeezed(place[inverse])}

    def counted(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words and for bigrams: their keys in ascending order, their places in that order, and in rows how often each occurs and how often in target documents.

        Two more rows for words: how often each is a document's last, and a target document's.
        """
        k, t, ends = len(self.vocab), np.repeat(self.t, self.lens), np.cumsum(self.lens)
        some = self.lens > 0
        first, last = (ends - self.lens)[some], (ends - 1)[some]
        before = np.roll(self.words, 1)
        before[first] = k
        distinct, self.step = np.unique(before * max(k, 1) + self.words, return_inverse=True)
        self.head, self.tail = np.divmod(distinct, max(k, 1))
        count = lambda of, size, weights=None: np.bincount(of, weights, size).astype(np.int64)
        rows = np.stack([count(self.words, k), count(self.words, k, t), count(self.words[last], k), count(self.words[last], k, t[last])])
        order = np.argsort(self.vocab)
        yield self.vocab[order], order, rows
        keys = mixed(mixed(np.append(self.vocab, self.START))[self.head] + self.vocab[self.tail] * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        yield keys[order], order, np.stack([count(self.step, len(distinct)), count(self.step, len(distinct), t)])

    def losses(self, words: np.ndarray, pairs: np.ndarray, size: int, size_t: int, docs: int, docs_t: int, distinct: int) -> list[np.ndarray]:
        """Of target and background, each document's loss a word, from the corpus's counts of its words and bigrams (as in ``counted``)."""
        row, floor = np.repeat(np.arange(len(self.lens)), self.lens), (words[0] + 1) / (size + distinct + 1)
        sides = (words[1], words[3], pairs[1], size_t, docs_t), (words[0] - words[1], words[2] - words[3], pairs[0] - pairs[1], size - size_t, docs - docs_t)
        out = []
        for one, last, two, total, begun in sides:
            heads = np.append(one - last, begun)[self.head]
            uni = ((1 - FLOOR) * one / total + FLOOR * floor if total else floor)[self.tail]
            cost = -np.log(np.where(heads > 0, WEIGHT * two / np.maximum(heads, 1) + (1 - WEIGHT) * uni, uni))
            out.append(np.bincount(row, cost[self.step], len(self.lens)) / np.maximum(self.lens, 1))
        return out


def _to_blocks(size: int):
    """(t, hashes, doc_id) to blocks of about ``size`` words; a longer document is one of its own."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, held = TaskContext.get().partitionId() << 32, [], 0

        def full() -> pa.RecordBatch:
            ids, lens, t, flat = zip(*waiting)
            made = Block.made(number, [i for part in ids for i in part], *map(np.concatenate, (lens, t, flat)))
            return pa.RecordBatch.from_pydict({c: pa.array([v], pa.list_(pa.int64()) if c == "ids" else None) for c, v in made.items()})

        for batch in batches:
            ends = batch.column(1).offsets.to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff((ends[1:] - ends[0]) // max(1, size // 8), prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                some = batch.slice(a, b - a)
                _, flat, _ = _tokens(some)
                if waiting and held + len(flat) > size:
                    yield full()
                    number, waiting, held = number + 1, [], 0
                waiting.append((some.column(2).to_pylist(), np.diff(ends[a : b + 1]), some.column(0).to_numpy(zero_copy_only=False), flat))
                held += len(flat)
        if waiting:
            yield full()

    return blocks


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the ascending keys begins, and the end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _ask(buckets: int):
    """Blocks to what each asks each bucket: keys and its own counts. Buckets of words are numbered -1 and down, those of bigrams 0 and up."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.slice(k, 1).to_pylist()[0])
                for words, (keys, order, rows) in zip((True, False), block.counted()):
                    at, rows = _bounds(keys, buckets), rows[:, order].astype("<u4")
                    made = [(-1 - i if words else i, block.number, int(y - x), _gaps(keys[x:y]), _squeezed(rows[:, x:y])) for i, (x, y) in enumerate(zip(at, at[1:])) if y > x]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), (*[pa.int64()] * 3, *[pa.binary()] * 2))] if made else [pa.array([], kind) for kind in (*[pa.int64()] * 3, *[pa.binary()] * 2)], ["bucket", "block", "n", "keys", "counts"])

    return ask


ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("known", pa.binary()), ("counts", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """What a bucket is asked to, for each block, a bit for each key, set if other blocks have it too, and the corpus's counts of those.

    For block -1, n is the number of distinct keys.
    """
    bucket, lens = table.column("bucket")[0].as_py(), table.column("n").to_numpy()
    keys = np.concatenate([_keys(d, n) for d, n in zip(table.column("keys").to_pylist(), lens)])
    rows = np.concatenate([_full(d, "<u4").reshape(-1, n) for d, n in zip(table.column("counts").to_pylist(), lens)], 1).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.append(heads, len(keys)))
    known = np.empty(len(keys), bool)
    known[order] = np.repeat(sizes > 1, sizes)
    rows[:, order] = np.repeat(np.add.reduceat(rows[:, order], heads, 1), sizes, 1)
    ends = np.cumsum(lens)
    made = [(block, bucket, int(known[x:y].sum()), np.packbits(known[x:y]).tobytes(), _squeezed(rows[:, x:y][:, known[x:y]])) for block, x, y in zip(table.column("block").to_pylist(), ends - lens, ends)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, (-1, bucket, len(heads), b"", b"")), ANSWER)], schema=ANSWER)


def _losses(buckets: int, *sums: int):
    def losses(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        told = {r["bucket"]: r for r in answers.to_pylist()}
        for row in blocks.to_pylist():  # one
            block, tables = Block(row), []
            for words, (keys, order, rows) in zip((True, False), block.counted()):
                for i, (x, y) in enumerate(zip(at := _bounds(keys, buckets), at[1:])):
                    if y > x and (r := told[-1 - i if words else i])["n"]:
                        known = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=y - x).view(bool)
                        rows[:, order[x:y][known]] = _full(r["counts"], "<i8").reshape(len(rows), -1)
                tables.append(rows)
            t, b = block.losses(*tables, *sums)
            out.append(pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(block.lens), pa.array(t), pa.array(b), pa.array(b - t)], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.float64()) for c in ("loss_target", "loss_background", "score"))]))

    return losses


def _word_scores(rows: DataFrame, block: int, bucket: int) -> DataFrame:
    """Scores by bigrams of all words, from (t, hashes, doc_id)."""
    spark = rows.sparkSession
    blocks = stage(rows.mapInArrow(_to_blocks(block), Block.SCHEMA), "lm-blocks")
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "nt", "docs", "docs_t")]).first()
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sums[0] // bucket))
    asked = blocks.mapInArrow(_ask(buckets), "bucket bigint, block bigint, n bigint, keys binary, counts binary")
    answers = stage(asked.groupBy("bucket").applyInArrow(_answer, "block bigint, bucket bigint, n bigint, known binary, counts binary"), "lm-answers")
    distinct = answers.filter("block = -1 and bucket < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    meet = blocks.groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block"))
    return meet.applyInArrow(_losses(buckets, *sums, distinct), "doc_id bigint, n_tokens bigint, loss_target double, loss_background double, score double")


def scores(docs: DataFrame, target: DataFrame, classes: int | None = None, frequent: float = FREQUENT, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, loss_target, loss_background, score.

    Losses are nats per word; score is background loss minus target loss, so what reads like the target scores
    high. ``target`` names the target's documents by doc_id; all others are the background. A side without words has the floor
    alone. Texts without words (null too) have n_tokens 0 and score 0; ids in ``target`` that no document has are ignored, and
    so is null; repeated rows all count. An empty table gives no rows; other columns are ignored.

    Bigrams are those of all words, or with ``classes`` of word classes: the words more frequent than the one in place
    ``classes + 1``, so ties decide nothing, and all others as one. ``frequent`` is used with classes only, ``block`` and ``bucket``
    without them.
    """
    spark = docs.sparkSession
    ids = target.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("t", F.lit(1))
    rows = small_join(docs.select("doc_id", "text"), ids, "doc_id", "left")
    with scratch(spark):
        if classes is None:
            rows = rows.select(F.coalesce("t", F.lit(0)).alias("t"), _hashes().alias("hashes"), F.col("doc_id").cast("bigint").alias("doc_id"))
            return stage(_word_scores(rows, block, bucket), "lm-scores", keep=True)
        rows = stage(rows.select(F.struct(F.monotonically_increasing_id().alias("i"), "doc_id").alias("row"), F.coalesce("t", F.lit(0)).alias("t"), _hashes().alias("hashes")), "lm-rows")
        tally = lambda of: rows.select("t", "hashes").mapInArrow(of, "key bigint, n bigint, nt bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("nt").alias("nt"))
        every = stage(tally(_count_words), "lm-words")
        most = every.orderBy(F.col("n").desc()).limit(classes + 1).collect()
        least = most[-1]["n"] if len(most) > classes else 0
        top = np.array(sorted(r["key"] for r in most if r["n"] > least), np.int64)
        found = tally(_count_steps(top)).toArrow()  # at most (classes + 2) * (classes + 1) rows
        steps = _costs(*(found.column(c).to_numpy() for c in ("key", "n", "nt")), len(top))
        others = every.filter(F.col("n") <= least) if least else every.limit(0)
        size = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        n0, t0 = others.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("nt"), F.lit(0))).first()
        floor = F.col("n") / F.lit(float(max(1, n0)))
        cost = lambda own, total: -F.log(own * F.lit((1 - FLOOR) / total) + floor * FLOOR if total else floor)
        table = stage(others.select("key", "n", cost(F.col("nt"), t0).alias("vt"), cost(F.col("n") - F.col("nt"), n0 - t0).alias("vb")), "lm-table")
        often = F.col("n") >= size * frequent
        some = table.filter(often).select("key", "vt", "vb").toArrow()  # at most 1 / frequent rows
        key = some.column("key").to_numpy()
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((top, steps, key[order], [some.column(c).to_numpy()[order] for c in ("vt", "vb")]))
        each = stage(rows.select("row", "hashes").mapInArrow(_added(sent), "row struct<i:bigint,doc_id:bigint>, n bigint, vt double, vb double, rest array<bigint>"), "lm-each")
        rare = each.select("row.i", F.explode("rest").alias("key")).groupBy("key", "i").agg(F.count(F.lit(1)).alias("k"))
        rare = rare.join(table.filter(~often), "key").groupBy("i").agg(*[F.sum(F.col("k") * F.col(f"v{m}")).alias(f"r{m}") for m in "tb"])
        both = each.select("row.i", "row.doc_id", "n", "vt", "vb").join(rare, "i", "left")
        n = F.greatest("n", F.lit(1))
        loss = {m: (F.col(f"v{m}") + F.coalesce(f"r{m}", F.lit(0.0))) / n for m in "tb"}
        return stage(both.select("doc_id", F.col("n").alias("n_tokens"), loss["t"].alias("loss_target"), loss["b"].alias("loss_background"), (loss["b"] - loss["t"]).alias("score")), "lm-scores", keep=True)
