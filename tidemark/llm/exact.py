"""Exact dedup by a heavy-hitter split (DataFrame functions only).

Digests that are frequent are found with a Misra-Gries summary, counted exactly, and their verified
winners (a bounded table) are broadcast: rows with such a digest never reach the shuffle. All other
digests, each below ``1 / SHARE`` of the rows, are settled by an ordinary shuffle, after equal rows were counted map-side.

The summary is Spark's ``approx_top_k``: a frequent-items sketch of the Misra-Gries family (counters
that are decremented together when the table is full), summed map-side and merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: A digest is heavy if it has more than one in SHARE of all rows, so there are fewer than SHARE of them.
SHARE = 256
#: Counters of the summary: its error is far below one in SHARE of the rows.
COUNTERS = 8192


def heavy(digests: DataFrame, column: str, share: int = SHARE) -> DataFrame:
    """The verified heavy digests: ``column``, group_size, keep_id; fewer than ``share`` rows."""
    found = digests.select(F.expr(f"explode(approx_top_k(xxhash64({column}), {share}, {COUNTERS}))").alias("top")).select(F.col("top.item").alias("_h"))
    total = digests.agg(F.count(F.lit(1)).alias("_n"))
    counted = digests.join(F.broadcast(found), F.xxhash64(column) == F.col("_h"), "left_semi").groupBy(column).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    return counted.join(F.broadcast(total), F.col("group_size") * share > F.col("_n")).drop("_n")


def dedup(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays; of
    repeated rows with that doc_id exactly one stays, and a null doc_id loses to any other. An empty
    table gives no rows. Other columns are ignored. The size of a text does not matter: only its
    digest is shuffled.
    """
    rows = stage(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")), "digests")
    winners = stage(heavy(rows, "text_sha256", share).select("text_sha256", F.col("group_size").alias("_size"), F.col("keep_id").alias("_keep")), "heavy").coalesce(1)
    split = rows.join(F.broadcast(winners), "text_sha256", "left")
    light, hot = split.filter(F.col("_size").isNull()).drop("_size", "_keep"), split.filter(F.col("_size").isNotNull())
    # Equal rows are counted where they are read; a digest's rows never have to meet in one task.
    each = stage(light.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("_same")), "light")
    groups = each.groupBy("text_sha256").agg(F.max("doc_id").alias("_keep"), F.sum("_same").alias("_size"), F.count(F.lit(1)).alias("_ids"))
    # The rows with the winning id come from the groups, the others from a join that only groups of several ids take part in.
    top = groups.filter(F.col("_ids") == 1).drop("_ids").withColumns({"doc_id": F.col("_keep"), "_same": F.col("_size")})
    more = each.join(groups.filter("_ids > 1").drop("_ids"), "text_sha256")
    # Of a heavy digest's rows only those with the winning id are counted; the rest is settled where it was read.
    wins = F.col("doc_id").eqNullSafe(F.col("_keep"))
    own = hot.filter(wins).groupBy("text_sha256", "doc_id", "_keep", "_size").agg(F.count(F.lit(1)).alias("_same"))
    rest = hot.filter(~wins).withColumn("_i", F.lit(2).cast("bigint"))
    every = top.unionByName(more).unionByName(own)
    every = every.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "_same")).alias("_i")).drop("_same").unionByName(rest)
    kept = F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_i") == 1)
    return every.select("doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), kept.alias("kept"), "text_sha256")
