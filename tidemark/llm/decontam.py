"""Benchmark decontamination (DataFrame functions only).

The windows of the benchmark items (eight words; a shorter item is one window) are a hash set that is
broadcast after its size was checked. Each document's windows are hashed within the row, probed against
the set without a shuffle, and hits are verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, fits, gram_hashes, held, let, small_join, stage, unheld, words

WIDTH = 8
#: A word's character, any other, and the places between the two.
IN_WORD, OUTSIDE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
EDGES = f"(?<={IN_WORD})(?={OUTSIDE})|(?<={OUTSIDE})(?={IN_WORD})"
#: A document with windows of this many items is contaminated.
LEAST_ITEMS = 2


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: key (hash), len, gram (the words), items (sorted distinct item_ids as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).filter((F.size("ws") > 0) & F.col("item").isNotNull())
    items = items.withColumn("len", F.least(F.size("ws"), F.lit(width)))
    grams = items.select("item", "len", F.explode(F.expr("transform(sequence(1, size(ws) - len + 1), i -> array_join(slice(ws, i, len), ' '))")).alias("gram"))
    sets = grams.groupBy("len", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hashed = F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))
    key = F.coalesce(*[F.when(F.col("len") == n, F.element_at(gram_hashes(hashed, n), 1)) for n in range(1, width + 1)])
    return sets.select(key.alias("key"), "len", "gram", "items")


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], width: int = WIDTH, most: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: ``keep`` columns, n_words, and found: array of (at, len, items) in order.

    ``at`` counts words from 0. Up to ``most`` windows (and so many bytes) are broadcast: a document's row survives the
    probe through a sentinel window, so one scan and one small shuffle (documents and hits, no texts) are all that is
    needed. With more windows, words are written once, only their windows' places and hashes are shuffled to meet the
    windows, and what meets is verified beside the words, which are shuffled once.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], words(F.col("text")).alias("_ws"))
    kept = [f"_k{i}" for i in range(len(keep))]
    wins = windows(benchmark, width)
    lens = sorted(r["len"] for r in wins.select("len").distinct().collect())  # at most ``width`` rows
    found = F.array_sort(F.collect_list(F.when(F.col("_at") >= 0, F.struct(F.col("_at").alias("at"), "len", "items"))))
    if fits(wins, most):
        seen = _probed(rows, wins, lens).groupBy("_row", *kept).agg(F.max(F.when(F.col("_at") < 0, F.size("_ws"))).alias("n_words"), found.alias("found"))
    else:
        rows = stage(rows, "decontam-words")
        places = rows.select("_row", F.explode(F.concat(*_probes(_hashes(F.col("_ws")), lens))).alias("_p")).select("_row", "_p.*")
        met = places.join(wins, ["len", "key"]).groupBy("_row").agg(F.collect_list(F.struct("at", "len", "gram", "items")).alias("_met"))
        right = F.filter("_met", lambda x: F.array_join(F.slice(F.col("_ws"), x["at"] + 1, x["len"]), " ") == x["gram"])
        right = F.array_sort(F.transform(right, lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), x["items"].alias("items"))))
        none = F.array().cast("array<struct<at:int,len:int,items:array<string>>>")
        seen = rows.join(met, "_row", "left").select("_row", *kept, F.size("_ws").alias("n_words"), F.coalesce(right, none).alias("found"))
    return seen.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("n_words").cast("bigint").alias("n_words"), "found")


def _probes(hashes: Column, lens: list[int]) -> list[Column]:
    def probe(n: int) -> Column:
        return F.transform(gram_hashes(hashes, n), lambda k, i: F.struct(i.alias("at"), F.lit(n).alias("len"), k.alias("key")))

    return [probe(n) for n in lens]


def _probed(rows: DataFrame, wins: DataFrame, lens: list[int]) -> DataFrame:
    """From rows with _ws: one row per verified hit (_at, len, items), and one with _at = -1 per row."""
    mark = rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("len"), F.lit("").alias("gram"), F.array().cast("array<string>").alias("items"))
    rows = rows.withColumn("_hs", _hashes(F.col("_ws")))
    first = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(0).cast("bigint").alias("key")))
    rows = rows.withColumn("_p", F.explode(F.concat(first, *_probes(F.col("_hs"), lens))))
    found = rows.select("*", F.col("_p.len").alias("len"), F.col("_p.key").alias("key"), F.col("_p.at").alias("_at")).join(F.broadcast(wins.unionByName(mark)), ["len", "key"])
    exact = F.array_join(F.slice("_ws", F.greatest("_at", F.lit(0)) + 1, F.col("len")), " ") == F.col("gram")
    return found.filter((F.col("_at") < 0) | exact)


def _covered() -> Column:
    """Words inside any hit: hits come in order, so the end reached so far is enough."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["at"] + x["len"]).alias("end"), (a["n"] + F.greatest(x["at"] + x["len"] - F.greatest(x["at"], a["end"]), F.lit(0))).cast("bigint").alias("n"))
    return F.aggregate("found", start, step, lambda a: a["n"])


def _items(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: x["items"]))))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_items: int = LEAST_ITEMS, most: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; a null item_id or an item without words has no windows; repeated rows
    each get a row; an empty benchmark hits nothing. Whole texts are scanned.
    """
    rows = hits(docs, benchmark, ["doc_id"], width, most).withColumn("_items", _items(F.col("found")))
    return rows.select("doc_id", "n_words", _covered().alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("_items") >= least_items).alias("contaminated"))


#: Runs of hit words, from the first (a) to the one behind the last (b).
SPANS = "array<struct<a:int,b:int>>"


def _spans(found: Column) -> Column:
    """Hits that touch or overlap as one run; they come in order."""

    def step(out: Column, x: Column) -> Column:
        end = x["at"] + x["len"]
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], end).alias("b"))))
        return F.when((F.size(out) > 0) & (x["at"] <= F.get(out, F.size(out) - 1)["b"]), longer).otherwise(F.concat(out, F.array(F.struct(x["at"].alias("a"), end.alias("b")))))

    return F.aggregate(found, F.array().cast(SPANS), step)


def _uncut(text: Column, spans: Column) -> Column:
    """The text outside of the runs: of every run, its words and the separators between them go.

    Splitting at the ends of words gives words and separators in turn; the slices between runs are put together, so the
    work is in proportion to the text.
    """
    parts = F.split(text, EDGES)
    lead = F.when(F.element_at(parts, 1).rlike(f"^{IN_WORD}"), 0).otherwise(1)

    def pieces(v: Column) -> Column:
        n = F.size(v["spans"])
        start = lambda k: F.when(k == 0, 1).otherwise(2 * (F.get(v["spans"], k - 1)["b"] - 1) + v["lead"] + 2)
        stop = lambda k: F.when(k == n, F.size(v["parts"])).otherwise(2 * F.get(v["spans"], k)["a"] + v["lead"])
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(v["parts"], start(k), F.greatest(stop(k) - start(k) + 1, F.lit(0))))), "")

    return let(F.struct(parts.alias("parts"), lead.alias("lead"), spans.alias("spans")), pieces)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_items: int = LEAST_ITEMS, cut: bool = False, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without contaminated documents, columns as before, whatever their names.

    With ``cut``, the hit words of the documents that stay are cut out of their texts, from the first to
    the last character of each run of hit words, and documents of which nothing but separators is left go.
    Null and empty texts stay as they are, repeated rows have the same fate, an empty benchmark changes nothing.
    Documents meet their hits by SHA-256 of text and doc_id.
    """
    names = docs.columns
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))).cast("binary"), 256))
    seen = hits(docs.select(key.alias("key"), "text"), benchmark, ["key"], width, most).filter(F.size("found") > 0)
    seen = stage(seen.select("key", F.size(_items(F.col("found"))).alias("items"), _spans(F.col("found")).alias("spans")).dropDuplicates(["key"]), "leaks", keep=True)
    rows = small_join(held(docs, key=key), seen, "key", "left").filter(F.coalesce(F.col("items") < least_items, F.lit(True)))
    if not cut:
        return unheld(rows, names)
    rows = rows.withColumn("left", F.when(F.col("spans").isNotNull(), _uncut(F.coalesce(F.col("row").getField("text"), F.lit("")), F.col("spans"))))
    rows = rows.filter(F.col("spans").isNull() | (F.size(words(F.col("left"))) > 0))
    text = F.when(F.col("spans").isNull(), F.col("row").getField("text")).otherwise(F.col("left"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names])
