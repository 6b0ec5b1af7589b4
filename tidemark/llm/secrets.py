"""Secret scans: a random forest tells secrets from strings that only look like them.

Candidates are runs of key characters, with digits or without. The forest (trained here, in numpy) sees a candidate's length,
its transitions between classes of characters, how much of it a dictionary covers, words of its path and
neighbouring words. The dictionary is the corpus' own: words above a share of all words, which bounds their number.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.~-]{16,}")
#: Characters of a candidate that are judged together; a longer one has the highest score of its windows and parts.
WINDOW = 512
PART = re.compile(r"[A-Za-z0-9_+-]{16,}")
#: Share of all words that a dictionary word must have, so there are fewer than 1 / share.
SHARE = 1e-4
#: Words beside or before a candidate, and in its path, that speak for or against a secret.
FOR = ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "api", "auth", "bearer", "credential", "private", "access")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "uuid", "guid", "id", "digest", "integrity", "revision", "version", "example", "sample", "dummy", "test", "build")
PATH = ("test", "tests", "example", "examples", "fixture", "fixtures", "doc", "docs", "sample", "mock", "vendor", "lock")
THRESHOLD = 0.5


@dataclass(frozen=True)
class Shape:
    """Of the forest: trees, their depth, least rows in a leaf, features tried per split, cuts tried per feature."""

    trees: int = 40
    depth: int = 8
    leaf: int = 3
    tried: int = 6
    cuts: int = 12
    seed: int = 5


@lru_cache(maxsize=4)
def _longest(dictionary: frozenset[str]) -> int:
    return max(map(len, dictionary), default=0)


def windows(candidate: str) -> list[tuple[int, int]]:
    """What of a candidate is judged: all of it, or of a long one overlapping windows and the parts between separators."""
    size = len(candidate)
    if size <= WINDOW:
        return [(0, size)]
    step = WINDOW // 2
    parts = [m.span() for m in PART.finditer(candidate)]
    return [(k, min(k + WINDOW, size)) for k in range(0, size - step, step)] + [(a, b) for a, b in parts if b - a <= WINDOW]


def covered(text: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that lie in words of the dictionary (three letters at least, longest first)."""
    low, at, n, longest = text.lower(), 0, 0, _longest(dictionary)
    while at < len(low):
        size = next((k for k in range(min(longest, len(low) - at), 2, -1) if low[at : at + k] in dictionary), 0)
        n, at = n + size, at + (size or 1)
    return n / len(low) if low else 0.0


_CLASS = {c: i for i, chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits)) for c in chars}


def features(candidate: str, before: str, after: str, path: str, dictionary: frozenset[str]) -> list[float]:
    """What the forest sees. ``before`` and ``after`` are the text beside the candidate."""
    kinds = [_CLASS.get(c, 3) for c in candidate]
    size = len(kinds)
    moves = np.zeros((4, 4))
    for a, b in zip(kinds, kinds[1:]):
        moves[a, b] += 1
    counts = np.unique(list(candidate), return_counts=True)[1] / size
    near = re.findall(r"[a-z0-9]+", before[-60:].lower())[-3:]
    glue = 1.0 if before[-1:] in "=:\"'" and before else 0.0
    tail = re.findall(r"[a-z0-9]+", after[:40].lower())[:2]
    places = set(re.split(r"[^a-z0-9]+", path.lower()))
    hexes = sum(c in "0123456789abcdefABCDEF" for c in candidate) / size
    return [
        float(np.log1p(len(candidate))),
        *(np.bincount(kinds, minlength=4)[:4] / size),
        *(moves / max(1, size - 1)).ravel(),
        float(-(counts * np.log2(counts)).sum()),
        hexes,
        float(len(candidate) in (32, 40, 64)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", candidate))),
        float(bool(re.match(r"AKIA[0-9A-Z]{16}$|gh[pousr]_|sk_live_|xox[bap]-|eyJ", candidate))),
        covered(candidate, dictionary),
        glue,
        float(any(w in FOR for w in re.findall(r"[a-z0-9]+", candidate.rpartition("=")[0][-60:].lower()))),
        float(sum(w in FOR for w in near)),
        float(sum(w in AGAINST for w in near)),
        float(sum(w in AGAINST for w in tail)),
        float(sum(w in PATH for w in places)),
    ]


class Forest:
    """Trees as arrays: feature, cut, children, and the share of secrets in each node."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shape: Shape = Shape()):
        rng = np.random.default_rng(shape.seed)
        self.trees = [self._grow(x, y, rng, shape) for _ in range(shape.trees)] if len(y) else []

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, shape: Shape) -> np.ndarray:
        rows = [(rng.integers(0, len(y), len(y)), 0)]
        nodes: list[list[float]] = []
        links = [None]
        while rows:
            own, depth = rows.pop()
            link = links.pop()
            if link is not None:
                nodes[link[0]][link[1]] = len(nodes)
            share = y[own].mean()
            node = [-1, 0.0, 0, 0, share]
            nodes.append(node)
            if depth >= shape.depth or len(own) < 2 * shape.leaf or share in (0.0, 1.0):
                continue
            best = None
            for f in rng.choice(x.shape[1], min(shape.tried, x.shape[1]), replace=False):
                values = x[own, f]
                for cut in np.unique(np.quantile(values, np.linspace(0.05, 0.95, shape.cuts))):
                    low = values <= cut
                    n = low.sum()
                    if shape.leaf <= n <= len(own) - shape.leaf:
                        a, b = y[own][low].mean(), y[own][~low].mean()
                        gini = n * a * (1 - a) + (len(own) - n) * b * (1 - b)
                        if best is None or gini < best[0]:
                            best = (gini, f, cut, low)
            if best is None:
                continue
            node[0], node[1] = best[1], best[2]
            for side, part in ((2, own[best[3]]), (3, own[~best[3]])):
                rows.append((part, depth + 1))
                links.append((len(nodes) - 1, side))
        return np.array(nodes, np.float64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row reaches."""
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := tree[at, 0] >= 0).any():
                rows = np.flatnonzero(inner)
                node = tree[at[rows]]
                left = x[rows, node[:, 0].astype(np.int64)] <= node[:, 1]
                at[rows] = np.where(left, node[:, 2], node[:, 3]).astype(np.int64)
            total += tree[at, 4]
        return total / max(1, len(self.trees))


def labelled(n: int = 3000, seed: int = 11) -> pd.DataFrame:
    """Labelled findings by rule (candidate, before, after, path, secret), for corpora without findings of their own.

    Secrets have the shapes that vendors publish or follow an assignment to a telling name; the others are what
    scanners wrongly report: digests of commits and files, UUIDs, version and file names, placeholders, prose.
    """
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    lower, upper, digits, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    word = lambda: pick(lower, int(rng.integers(2, 9)))
    prose = lambda: " ".join(word() for _ in range(4))
    one = lambda of: of[int(rng.integers(len(of)))]
    camel = lambda: "".join(pick(lower, int(rng.integers(5, 9))).capitalize() for _ in range(int(rng.integers(3, 5))))
    yes = (
        lambda: ("AKIA" + pick(upper + digits, 16), one((f"{prose()} ", f'{prose()} aws_access_key_id = "'))),
        lambda: (one(("ghp_", "gho_", "ghs_")) + pick(lower + upper + digits, 36), one((f"{prose()} ", "token: "))),
        lambda: (pick(hexa, int(rng.choice([32, 40, 64]))), f'{prose()} {one(("token", "secret", "api_key", "auth"))} {one(("= ", ": "))}{one((chr(34), ""))}'),
        lambda: (one(("password=", "passwd=", "pwd=", "secret=", "apikey=")) + pick(hexa if rng.random() < 0.6 else lower + upper + digits, int(rng.integers(12, 33))), f"{prose()} "),
        lambda: (pick(lower + upper + digits + "+/", 40), f'{one(("secret", "private key", "access key"))}: "'),
        lambda: ("sk_live_" + pick(lower + upper + digits, 24), f"{prose()} "),
        lambda: ("AKIA" + pick(upper, 16), f"{prose()} "),
        lambda: (one(("sk_live_", "ghp_")) + pick(lower + upper, int(rng.choice([24, 36]))), f"{prose()} "),
        lambda: (one(("password=", "passwd=", "pwd=", "secret=")) + pick(lower + upper, int(rng.integers(12, 33))), f"{prose()} "),
        lambda: (one(("password=", "passwd=", "pwd=", "secret=")) + camel(), f"{prose()} "),
    )
    no = (
        lambda: (pick(hexa, int(rng.choice([32, 40, 64]))), f'{prose()} {one(("commit", "sha1", "md5", "checksum", "revision", "digest"))} {one(("", "= ", ": "))}'),
        lambda: (pick(hexa, 32), f"{prose()} "),
        lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), f'{prose()} {one(("id", "uuid", "guid", ""))} '),
        lambda: ("-".join(word() for _ in range(4)) + pick(digits, 2), f"{prose()} "),
        lambda: ("/".join(word() for _ in range(4)) + f"/{pick(digits, 3)}.html", f"{prose()} http://www."),
        lambda: (one(("your_", "example_", "dummy_")) + one(("token_", "key_", "secret_")) + pick("x0", 12), f"{prose()} token = "),
        lambda: ("x" * int(rng.integers(15, 30)) + "1", f"{prose()} password="),
        lambda: (pick(digits, int(rng.integers(16, 20))), f"{prose()} "),
        lambda: ("".join(w.capitalize() for w in (word(), word(), word())) + pick(digits, 2), f"{prose()} "),
        lambda: (word() + "." + pick(digits, 2) + "@".replace("@", ".") + word() + pick(digits, 1) + ".example.com", f"{prose()} "),
        lambda: (".".join(pick(digits, 3) for _ in range(5)), f"{prose()} version "),
        lambda: (pick(lower, int(rng.integers(16, 31))).capitalize() if rng.random() < 0.3 else pick(lower, int(rng.integers(16, 31))), f"{prose()} "),
        lambda: (one("-_/").join(pick(lower, int(rng.integers(4, 10))) for _ in range(4)), f"{prose()} "),
        lambda: (one(("", "name=", "class=", "href=")) + camel(), f"{prose()} "),
        lambda: (one(("password=", "token=", "secret=")) + one(("your_password_here", "changeme_please", "example_value", "xxxxxxxxxxxxxxxx")), f"{prose()} "),
    )
    rows = []
    for k in range(n):
        secret = k % 2
        candidate, before = one(yes if secret else no)()
        path = one(("src/app", "conf/prod", "src0", "www", "tests/fixtures", "docs/example")) if not secret else one(("src/app", "conf/prod", "src0", "www", "deploy"))
        rows.append((candidate, before, f" {prose()}", path, secret))
    return pd.DataFrame(rows, columns=["candidate", "before", "after", "path", "secret"])


def dictionary(docs: DataFrame, share: float = SHARE) -> frozenset[str]:
    """Words (three letters at least) above a share of all words: fewer than 1 / share, so they fit the driver."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    counts = docs.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).filter(F.length("w") >= 3).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all_n"))
    return frozenset(r["w"] for r in counts.join(F.broadcast(total)).filter(F.col("n") >= F.col("all_n") * share).select("w").collect())


def train(findings: pd.DataFrame, words: frozenset[str], shape: Shape = Shape()) -> Forest:
    x = np.array([features(f.candidate, f.before, f.after, f.path, words) for f in findings.itertuples()]).reshape(len(findings), -1)
    return Forest(x, findings["secret"].to_numpy(np.float64), shape)


def candidates(text: str) -> list[tuple[int, int]]:
    """Starts and ends; dots and dashes at the ends belong to the sentence."""
    out = []
    for m in CANDIDATE.finditer(text):
        found = m.group()
        bare = found.strip(".-~")
        start = m.start() + len(found) - len(found.lstrip(".-~"))
        if len(bare) >= 16:
            out.append((start, start + len(bare)))
    return out


def scan(docs: DataFrame, findings: pd.DataFrame | None = None, threshold: float = THRESHOLD, shape: Shape = Shape()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, n_candidates, n_secrets, score, spans.

    ``findings`` are labelled ones (default: ``labelled()``); ``source`` is the path. score is the highest of the
    candidates' (0 without any); spans lists secrets as start:end in code points, comma-joined. Null texts
    have no candidates, a null source is an empty path, repeated rows each get a row. Whole texts are scanned.
    """
    spark: SparkSession = docs.sparkSession
    words = dictionary(docs)
    forest = train(labelled() if findings is None else findings, words, shape)
    sent = spark.sparkContext.broadcast((forest, words))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, words = sent.value
        for batch in batches:
            found = [candidates(t) for t in batch["text"]]
            cut = [[(a + i, a + j) for i, j in windows(t[a:b])] for t, spans in zip(batch["text"], found) for a, b in spans]
            owners = [(t, p) for t, p, spans in zip(batch["text"], batch["source"], found) for _ in spans]
            x = [features(t[a:b], t[max(0, a - 80) : a], t[b : b + 80], p, words) for (t, p), pieces in zip(owners, cut) for a, b in pieces]
            begins = np.cumsum([0, *map(len, cut)])[:-1]
            scores = np.maximum.reduceat(forest.scores(np.array(x)), begins) if x else np.zeros(0)
            ends = np.cumsum([0, *map(len, found)])
            own = [scores[a:b] for a, b in zip(ends, ends[1:])]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_candidates": [len(f) for f in found],
                    "n_secrets": [int((s >= threshold).sum()) for s in own],
                    "score": [float(s.max()) if len(s) else 0.0 for s in own],
                    "spans": [",".join(f"{a}:{b}" for (a, b), z in zip(f, s) if z >= threshold) for f, s in zip(found, own)],
                }
            )

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    made = rows.mapInPandas(look, "doc_id string, n_candidates bigint, n_secrets bigint, score double, spans string")
    return made.withColumn("doc_id", F.col("doc_id").cast("bigint"))
