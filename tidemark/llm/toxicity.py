"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained here in numpy.

A bag holds the character n-grams (with word ends) of some words and the words themselves, hashed to buckets. The vectors
of a bag are averaged and go through a linear softmax of two classes; vectors and softmax are trained together, so an
unseen misspelling or inflection shares the vectors of the n-grams it has in common with known words.

The bags of a text are its windows of ``Shape.window`` words in a row (a shorter text is one window), and a text is judged by
its most toxic window, in training as in scoring: a single insult in a text of 20,000 words counts, and a long clean text
stays clean. Documents are labelled, windows are not, so training starts from bags of single words, each with the label of its
documents. Long tokens, as in text without spaces, are taken apart and read to their end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores from here on are predicted toxic.
THRESHOLD = 0.7
#: Bound of the training sample, in labelled rows of each class.
SAMPLE = 3_000
#: Tokens whose sums a task remembers.
REMEMBERED = 300_000
#: Words whose n-grams are made in one go.
CHUNK = 20_000
#: Characters of a token beyond which it is taken apart and not remembered, and of the pieces of an unbroken run.
LONG, PIECE = 64, 24
BREAK = re.compile(r"[^\w\u0300-\u036f\u0900-\u0dff\u0e00-\u0eff]+|_+")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"


@dataclass(frozen=True)
class Shape:
    """Of the model: 2**bits buckets, vectors of dim numbers, n-grams from low to high characters, windows of so many words.

    Training ends after ``rounds``, or as soon as the mean loss (both classes weigh the same) is below ``loss``.
    """

    bits: int = 18
    dim: int = 8
    low: int = 3
    high: int = 6
    window: int = 4
    warm: int = 12
    rounds: int = 60
    loss: float = 0.01
    rate: float = 0.4
    seed: int = 7


def plain(token: str) -> str:
    return token.strip(EDGE).lower()


def pieces(token: str) -> list[str]:
    """The words of a token: itself, or what a token over ``LONG`` characters falls into.

    A long one is split at whatever is no letter, digit or mark; runs that are still long (text without spaces) are
    cut into pieces that overlap by half, so that a word of up to ``PIECE // 2`` characters is whole in one of them.
    """
    bare = plain(token)
    if len(bare) <= LONG:
        return [bare] if bare else []
    step = PIECE // 2
    out = []
    for run in BREAK.split(bare):
        if len(run) > LONG:
            out.extend(run[k : k + PIECE] for k in range(0, len(run) - step, step))
        elif run:
            out.append(run)
    return out


def in_order(text: str) -> list[str]:
    """The words of a text as they come."""
    return [w for token in text.split() for w in pieces(token)]


def features(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each word, one word after the other, and where each word begins."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(chars))
    grams, owners = [], []
    prime = np.uint64(0x100000001B3)
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, shape.high + 1):
        h[: len(chars) - n + 1] = h[: len(chars) - n + 1] * prime + chars[n - 1 :]
        if n >= shape.low:
            good = at + n <= end
            grams.append((h[good] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - shape.bits))
            owners.append(word[good])
    whole = np.fromiter((zlib.crc32(m.encode("utf-8", "surrogatepass")) for m in marked), np.uint64, len(marked))
    grams.append(whole * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - shape.bits))
    owners.append(np.arange(len(marked)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(marked))
    return np.concatenate(grams)[order].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def bag_sums(words: list[str], weights: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, the sum of its buckets' ``weights`` and how many there are."""
    if not words:
        return np.zeros(0), np.zeros(0)
    made = [features(words[k : k + CHUNK], shape) for k in range(0, len(words), CHUNK)]
    return np.concatenate([np.add.reduceat(weights[b], at[:-1], dtype=np.float64) for b, at in made]), np.concatenate([np.diff(at) for _, at in made]).astype(np.float64)


def windows(sums: np.ndarray, counts: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of ``lens`` words one after the other: start, end and mean of each window, text by text.

    A text of fewer words is one window, and one without words has none; a window without n-grams has the mean 0.
    """
    total, size = np.append(0.0, np.cumsum(sums)), np.append(0.0, np.cumsum(counts))
    first = np.repeat(np.cumsum(lens) - lens, lens)
    last = np.repeat(np.cumsum(lens), lens)
    start = np.arange(len(sums))
    some = (start + width <= last) | (start == first)
    start, last = start[some], last[some]
    end = np.minimum(start + width, last)
    return start, end, (total[end] - total[start]) / np.maximum(size[end] - size[start], 1)


def train(texts: list[str | None], labels: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias: the embedding times the softmax's difference of classes.

    With no rows, or only one class, everything scores the same.
    """
    size = 1 << shape.bits
    if not len(texts) or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.0
        return np.zeros(size, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    vocabulary: dict[str, int] = {}
    every = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in in_order(text or "")), np.int64) for text in texts]
    words = list(vocabulary)
    full = [i for i, e in enumerate(every) if len(e)]
    if not full:
        return np.zeros(size, np.float32), 0.0
    flat, lens, y = np.concatenate([every[i] for i in full]), np.array([len(every[i]) for i in full]), labels[full].astype(np.float64)
    n_pos, n_neg = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    made = [features(words[k : k + CHUNK], shape) for k in range(0, len(words), CHUNK)]
    buckets, counts = np.concatenate([b for b, _ in made]), np.concatenate([np.diff(at) for _, at in made])
    begins = np.append(0, np.cumsum(counts))
    del made, every
    rng = np.random.default_rng(shape.seed)
    vectors = rng.normal(0, 0.3, (size, shape.dim)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (2, shape.dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = np.full(size, 1e-3, np.float32), np.full((2, shape.dim), 1e-3, np.float32), np.full(2, 1e-3, np.float32)

    def update(some: np.ndarray, bag: np.ndarray, bags: int, weight: np.ndarray, want: np.ndarray) -> None:
        """A step (Adagrad) on bags of words (``bag``: which one each word is in), each with its weight and the share of label 1 that it should have."""
        nonlocal softmax, bias
        own = np.repeat(np.arange(len(some)), counts[some])
        first = np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
        b = buckets[np.arange(len(own)) - first + np.repeat(begins[some], counts[some])]
        own = bag[own]
        n = np.bincount(own, minlength=bags)
        mean = np.stack([np.bincount(own, vectors[b, k], bags) for k in range(shape.dim)], 1) / n[:, None]
        z = mean @ softmax.T + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - np.stack([1 - want, want], 1)) * weight[:, None]).astype(np.float32)
        gs, gb, gm = g.T @ mean.astype(np.float32), g.sum(0), (g @ softmax) / n[:, None]
        used, inverse = np.unique(b, return_inverse=True)
        gv = np.stack([np.bincount(inverse, gm[own, k], len(used)) for k in range(shape.dim)], 1).astype(np.float32)
        seen_v[used] += (gv**2).mean(1)
        vectors[used] -= shape.rate * gv / np.sqrt(seen_v[used])[:, None]
        seen_s[:] += gs**2
        softmax = softmax - shape.rate * 0.2 * gs / np.sqrt(seen_s)
        seen_b[:] += gb**2
        bias = bias - shape.rate * 0.2 * gb / np.sqrt(seen_b)

    # Each word with the share of label 1 among its documents, both classes with the same weight.
    pairs = np.unique(np.repeat(np.arange(len(lens)), lens) * len(words) + flat)
    doc, word = pairs // len(words), pairs % len(words)
    f1, f0 = np.bincount(word, y[doc], len(words)) / n_pos, np.bincount(word, 1 - y[doc], len(words)) / n_neg
    support = np.bincount(word, minlength=len(words))
    many = np.flatnonzero(support >= min(3, support.max()))
    for _ in range(shape.warm):
        update(many, np.arange(len(many)), len(many), support[many] / support[many].mean(), (f1[many] + 1 / n_pos * 0.1) / (f1[many] + f0[many] + 0.1 / n_pos + 1 / n_neg))
    weight = np.where(y == 1, 1 / n_pos, 1 / n_neg)
    for _ in range(shape.rounds):
        plain_ = vectors @ (softmax[1] - softmax[0])
        sums = np.add.reduceat(plain_[buckets], begins[:-1], dtype=np.float64)
        start, end, mean = windows(sums[flat], counts[flat].astype(np.float64), lens, shape.window)
        heads = np.flatnonzero(np.r_[True, np.searchsorted(np.cumsum(lens), start[1:], "right") != np.searchsorted(np.cumsum(lens), start[:-1], "right")])
        most = np.maximum.reduceat(mean, heads)
        margin = (most + bias[1] - bias[0]) * np.where(y == 1, 1, -1)
        if np.average(np.logaddexp(0, -margin), weights=weight) < shape.loss:
            break
        best = np.minimum.reduceat(np.where(mean == np.repeat(most, np.diff(np.r_[heads, len(mean)])), np.arange(len(mean)), len(mean)), heads)
        size_ = (end - start)[best]
        at = np.repeat(start[best] - (np.cumsum(size_) - size_), size_) + np.arange(size_.sum())
        update(flat[at], np.repeat(np.arange(len(best)), size_), len(best), weight * len(best), y)
    return (vectors @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0])


def held_out() -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shape: Shape = Shape()) -> tuple[np.ndarray, float]:
    """Trains on at most ``sample`` labelled rows of each class, chosen by a hash of their id.

    The sample is chosen among the labels, so no more than 2 * sample texts ever move; training runs in one
    task, which Spark starts again elsewhere if its executor is lost. Null labels are none; of labels that
    contradict each other the larger counts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(shape.seed))
    # A repeated doc_id brings all its rows, of which the least text is learned from.
    chosen = known.filter("toxic = 0").orderBy(order, "doc_id").limit(sample).unionByName(known.filter("toxic = 1").orderBy(order, "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        data = pd.concat(frames).fillna({"text": ""}).sort_values(["doc_id", "text"]) if frames else pd.DataFrame({"text": [], "toxic": []})
        weights, bias = train(list(data["text"]), data["toxic"].to_numpy(np.float64), shape)
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    row = rows.repartition(1).mapInPandas(learn, "weights binary, bias double").first()
    if row is None:  # an empty partition may start no task
        return train([], np.zeros(0), shape)
    return np.frombuffer(row["weights"], np.float32), row["bias"]


class Scorer:
    """Scores texts and remembers the tokens it has met, but for long ones."""

    def __init__(self, weights: np.ndarray, bias: float, shape: Shape = Shape()):
        self.weights, self.bias, self.shape = weights, bias, shape
        self.known: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0)

    def _tokens(self, text: str) -> list[str]:
        tokens = text.split()
        if max(map(len, tokens), default=0) <= LONG:
            return tokens
        return [w for t in tokens for w in ((t,) if len(t) <= LONG else pieces(t))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One score per text; a text without words has the score of an empty bag."""
        every = [self._tokens(t or "") for t in texts]
        new = list(set().union(*every) - self.known.keys()) if every else []
        if len(self.known) + len(new) > REMEMBERED:  # begin anew: frequent tokens come back at once
            self.known, self.sums, self.counts = {}, np.zeros(0), np.zeros(0)
            new = list(set().union(*every))
        bare = [plain(t) for t in new]
        some = sorted(set(bare) - {""})
        own = dict(zip(some, zip(*bag_sums(some, self.weights, self.shape))))
        made = np.array([own.get(w, (0.0, 0.0)) for w in bare]).reshape(-1, 2)
        self.known.update(zip(new, range(len(self.sums), len(self.sums) + len(new))))
        self.sums, self.counts = np.append(self.sums, made[:, 0]), np.append(self.counts, made[:, 1])
        lens = np.fromiter(map(len, every), np.int64, len(every))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(every)), np.int64, lens.sum())
        at = at[solid] if not (solid := self.counts[at] > 0).all() else at  # what is punctuation alone is no word
        if len(at) < len(solid):
            lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[solid], minlength=len(lens))
        z = np.full(len(every), float(self.bias))
        full = np.flatnonzero(lens)
        if len(full):
            start, _, mean = windows(self.sums[at], self.counts[at], lens, self.shape.window)
            z[full] += np.maximum.reduceat(mean, np.searchsorted(start, (np.cumsum(lens) - lens)[full]))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_udf(spark, model: tuple[np.ndarray, float], shape: Shape = Shape()):
    """A pandas UDF from text to score; whole texts are read."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*sent.value, shape)
        for texts in batches:
            yield pd.Series(np.concatenate([scorer.scores(list(texts[k : k + 500])) for k in range(0, len(texts), 500)] or [np.zeros(0)]))

    return score


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, shape: Shape = Shape()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null counts as an empty text; repeated rows score the same; a null doc_id is never held out and never
    learned from. Only the text is scored: labels, lang, source and doc_id are no inputs.
    """
    score = score_udf(docs.sparkSession, fit(docs, labels, sample, shape), shape)
    out = docs.select("doc_id", held_out().alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, shape: Shape = Shape()) -> DataFrame:
    """``docs`` without the documents that are predicted toxic, columns as before, whatever their names.

    Nulls, empty texts, repeated rows and labels are as in ``scored``; without labels of both classes every document has the
    same score. An empty table stays empty.
    """
    score = score_udf(docs.sparkSession, fit(docs, labels, sample, shape), shape)
    return docs.filter(score(F.coalesce("text", F.lit(""))) < threshold)
