"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Each document starts with the same fractional number of copies as all of its source. Whole copies are
certain; the fractions are settled in pairs: probability mass, counted in words, moves at random from one
document to the other until one of them is 0 or 1, and the other goes on to the next pair. Bounded blocks
are folded side by side, and the one residual that each block leaves goes to the next level of a tree, until
one document of a source is left, which is rounded at random. The expected copies of every document are
exact, and a source misses its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fits, held, let, numbered, scratch, small_join, stage, sums_before, unheld

#: Fixed value: weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 256
#: Fixed value: a word, as it counts for size.
WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """From source, size: source, source_size, target. One row per source.

    Sharing by weight, with the excess over ``most`` times a source's size shared again until none is
    above, caps sources in order of size over weight: those come first for which that ratio is below
    what a unit of weight gets of the words that are left.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = sums_before(by, [F.col("source").asc_nulls_last()], at=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights)).cast("int") + 1)
    by = by.withColumn("weight", weight.cast("bigint")).withColumn("most", F.col("source_size") * F.lit(most))
    by = by.withColumn("ratio", F.col("most") / F.col("weight"))
    by = stage(sums_before(by, [F.col("ratio"), F.col("source").asc_nulls_last()], most_before=F.col("most"), weight_before=F.col("weight")), "mix-shares")
    words, unit = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, shared = F.lit(words) - F.col("most_before"), F.lit(unit) - F.col("weight_before")
    capped = left * F.col("weight") > F.col("most") * shared
    # The first source that is not capped says what is left for a unit of weight of all that are not.
    first = by.filter(~capped).agg(F.min(F.struct("ratio", left.alias("left"), shared.alias("shared")))).first()[0]
    open_ = F.col("weight") * F.lit(first["left"]) / F.lit(first["shared"]) if first else F.lit(None)
    return by.select("source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(open_.cast("double")).alias("target"))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


#: A document of a block: large ones first, so that what is left at the end tends to be a short one.
UNIT = "struct<neg:bigint,doc_id:bigint,th:bigint,i:bigint,p:double>"
EPS = 1e-9


def _snap(p: Column) -> Column:
    return F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p)


def _whole(p: Column) -> Column:
    return (p == 0.0) | (p == 1.0)


def _with_p(unit: Column, p: Column) -> Column:
    return F.struct(*[unit[c].alias(c) for c in ("neg", "doc_id", "th", "i")], p.alias("p"))


def _fold(items: Column, seed: int) -> Column:
    """Settles a block: {live: the residual or null, done: documents with p 0 or 1}."""

    def pair(a: Column, x: Column) -> Column:
        """Both after moving mass; moving t words keeps size * p of the two together."""
        sa, sx = -a["neg"], -x["neg"]
        up = F.least(sa * (1 - a["p"]), sx * x["p"])  # words that a can take from x
        down = F.least(sa * a["p"], sx * (1 - x["p"]))
        moves = F.struct(up.alias("up"), down.alias("down"), _draw(F.lit(seed), a["doc_id"], a["th"], a["i"], x["doc_id"], x["th"], x["i"]).alias("u"))
        move = let(moves, lambda m: F.when(m["u"] * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]))
        return let(move, lambda t: F.array(_with_p(a, _snap(a["p"] + t / sa)), _with_p(x, _snap(x["p"] - t / sx))))

    def step(acc: Column, x: Column) -> Column:
        settled = let(
            pair(acc["live"], x),
            lambda both: F.struct(F.element_at(F.concat(F.filter(both, lambda d: ~_whole(d["p"])), F.array(F.lit(None).cast(UNIT))), 1).alias("live"), F.concat(acc["done"], F.filter(both, lambda d: _whole(d["p"]))).alias("done")),
        )
        return F.when(acc["live"].isNull(), F.struct(x.alias("live"), acc["done"].alias("done"))).otherwise(settled)

    zero = F.struct(F.lit(None).cast(UNIT).alias("live"), F.array().cast(f"array<{UNIT}>").alias("done"))
    return F.aggregate(items, zero, step)


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def _settled(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The sources (skey, source, source_size, target, base, p) and what ``copies`` gives."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size(F.col("text")).alias("size"), _text_key().alias("th"))
    rows = rows.groupBy("doc_id", "source", "size", "th").agg(F.count(F.lit(1)).alias("_m"))
    rows = stage(rows, "mix-sizes")
    aims = targets(rows.select("source", (F.col("size") * F.col("_m")).alias("size")), weights, most)
    counts = rows.groupBy("source").agg(F.sum(F.when(F.col("size") > 0, F.col("_m")).otherwise(0)).alias("_n"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.withColumn("skey", _source_key()).join(counts.withColumn("skey", _source_key()).drop("source"), "skey")
    aims = aims.withColumn("base", F.floor(share + EPS).cast("bigint")).withColumn("p", _snap(F.greatest(share - F.col("base"), F.lit(0.0))))
    aims = stage(aims, "mix-targets", keep=True)
    units = small_join(rows.withColumn("skey", _source_key()).drop("source"), aims, "skey")
    units = units.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m"))))
    alone = (F.col("size") == 0) | _whole(F.col("p"))
    info = ["skey", "source", "source_size", "target", "base"]
    drawn = (_draw(F.lit(seed), F.col("doc_id"), F.col("th"), F.col("i")) < F.col("p")).cast("bigint")
    out = units.filter(alone).select(*info, "doc_id", "th", "i", "size", (F.col("base") + drawn).alias("copies"))
    live = units.filter(~alone).select("skey", F.struct((-F.col("size")).alias("neg"), "doc_id", "th", "i", "p").alias("unit"), F.ceil(F.col("_n") / block).alias("_blocks"))
    most_blocks = aims.agg(F.max(F.ceil(F.col("_n") / block))).first()[0] or 0
    level = 0
    while most_blocks:
        # The level's blocks are folded where they are gathered; each holds about ``block`` documents.
        live = live.withColumn("_b", F.pmod(F.xxhash64(F.lit(level), "unit.doc_id", "unit.th", "unit.i"), F.col("_blocks")))
        folded = live.groupBy("skey", "_blocks", "_b").agg(F.sort_array(F.collect_list("unit")).alias("units")).select("skey", "_blocks", _fold(F.col("units"), seed + level).alias("f"))
        folded = stage(folded.select("skey", "_blocks", "f.live", "f.done"), f"mix-level{level}")
        done = folded.select("skey", F.explode("done").alias("u"))
        live = folded.filter(F.col("live").isNotNull()).select("skey", F.col("live").alias("unit"), F.ceil(F.col("_blocks") / block).alias("_blocks"))
        if most_blocks == 1:
            last = live.select("skey", _with_p(F.col("unit"), (_draw(F.lit(seed - 1), "unit.doc_id", "unit.th", "unit.i") < F.col("unit.p")).cast("double")).alias("u"))
            done = done.unionByName(last)
        done = small_join(done, aims.select(*info), "skey")
        out = out.unionByName(done.select(*info, "u.doc_id", "u.th", "u.i", (-F.col("u.neg")).alias("size"), (F.col("base") + F.col("u.p").cast("bigint")).alias("copies")))
        if most_blocks == 1:
            break
        most_blocks, level = -(-most_blocks // block), level + 1
    return aims, out


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, source, th, i, size, source_size, target, copies.

    ``th`` is the text's hash and ``i`` numbers repeated rows from 1. Null texts have size 0; documents
    of size 0 have no mass and are rounded alone; null is a source of its own, the last. A document gets at
    most ``most`` copies. Draws hash the documents, so a rerun gives the same copies. An empty table gives no
    rows; other columns are ignored.
    """
    return _settled(docs, weights, most, seed, block)[1]


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as in ``docs``, whatever their names.

    Nulls, empty texts and the rounding are as in ``copies``. Rows that repeat doc_id, text and source share what the mix
    takes of them evenly, and which of them comes once more often is not defined. An empty table stays empty.

    Where a source's documents all get the same number of copies, texts stay where they are read; the others
    meet their copies in one shuffle, at every size.
    """
    names = docs.columns
    with scratch(docs.sparkSession):
        aims, out = _settled(docs, **options)
        made = out.join(F.broadcast(aims.filter(~_whole(F.col("p"))).select("skey")), "skey", "left_semi") if fits(aims) else out
        made = stage(made.groupBy("doc_id", "skey", "th").agg(F.count(F.lit(1)).alias("m"), F.sum("copies").alias("n")), "mix-copies", keep=True)
    rows = held(docs, id=F.col("doc_id").cast("bigint"), skey=F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), th=_text_key())
    rows = small_join(rows, aims.select("skey", "p", (F.col("base") + F.col("p").cast("bigint")).alias("same")), "skey")
    sure = rows.filter(_whole(F.col("p"))).select("row", F.col("same").alias("n"))
    own = made.filter("n > 0").withColumnsRenamed({"doc_id": "_id", "skey": "_skey", "th": "_th"})
    rest = rows.filter(~_whole(F.col("p"))).join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("skey") == F.col("_skey")) & (F.col("th") == F.col("_th")))
    each = rest.filter("n % m = 0").select("row", (F.col("n") / F.col("m")).cast("bigint").alias("n"))
    if not made.filter("n % m != 0").isEmpty():
        odd = numbered(rest.filter("n % m != 0").select(F.to_json(F.struct("id", "skey", "th")).alias("group"), "m", "n", "row"), "group")
        each = each.unionByName(odd.select("row", (F.floor(F.col("n") / F.col("m")) + (F.col("_at") <= F.col("n") % F.col("m")).cast("bigint")).alias("n")))
    every = sure.unionByName(each).filter("n > 0")
    return unheld(every.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_again")), names)


def shares(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (copies times size)."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
