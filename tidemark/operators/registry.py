"""Series identities: canonical label sets to numbers, and the index from labels to numbers.

Numbers are dense and never change. New ones come from a single writer: an anti-join finds unknown keys, and a
row number over those keys alone, never over samples, extends the numbering.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import canonical_key, label_key, sorted_labels
from .selector import Matcher, condition


def keys(samples: DataFrame) -> DataFrame:
    """Distinct canonical_key and labels of (labels, ...). Label sets are told apart as they came, so keys are not made for every sample."""
    own = samples.select("labels").distinct()
    return own.select(canonical_key(F.col("labels")).alias("canonical_key"), sorted_labels(F.col("labels")).alias("labels")).dropDuplicates(["canonical_key"])


#: Ranges of keys that are numbered side by side.
RANGES = 64
#: Identities up to which they are broadcast to samples; Spark would judge by the size of compressed files.
BROADCAST_SERIES = 50_000


def sized(series: DataFrame, n: int | None) -> DataFrame:
    """The series as a side of a join: broadcast if there are few, never if there are many, and as Spark likes if ``n`` is unknown."""
    if n is None:
        return series
    return F.broadcast(series) if n <= BROADCAST_SERIES else series.hint("merge")


def unknown(found: DataFrame, known: DataFrame, n: int | None = None) -> DataFrame:
    """The keys in ``found`` that ``known`` (of about ``n`` rows) lacks."""
    return found.join(sized(known.select("canonical_key"), n), "canonical_key", "left_anti")


def resolve_new(found: DataFrame, known: DataFrame, after: int) -> DataFrame:
    """series_id, canonical_key, labels of the keys in ``found`` that ``known`` lacks, numbered after ``after`` in key order."""
    return number(unknown(found, known), after).select("series_id", "canonical_key", "labels")


def number(new: DataFrame, after: int) -> DataFrame:
    """Rows of distinct canonical_key with a series_id, after ``after`` in key order; they are read three times.

    The keys with the least hashes are a sample that gives the ends of ranges. Ranges are counted, and each is numbered by
    itself from where the ones before it end, so no task sees all keys. Fewer keys than ranges are one range.
    """
    sample = sorted(r[0] for r in new.select("canonical_key").orderBy(F.xxhash64("canonical_key"), "canonical_key").limit(RANGES * 4).collect())
    ends = sample[4::4] if len(sample) == RANGES * 4 else []
    if not ends:
        return new.select((F.row_number().over(W.orderBy("canonical_key")) + F.lit(after).cast("bigint")).alias("series_id"), *new.columns)
    place = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("canonical_key")))
    rows = new.withColumn("_range", place)
    counts = dict(rows.groupBy("_range").agg(F.count(F.lit(1))).collect())  # one number per range
    starts = [after]
    for k in range(len(ends)):
        starts.append(starts[-1] + counts.get(k, 0))
    start = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in starts]), F.col("_range") + 1)
    own = F.row_number().over(W.partitionBy("_range").orderBy("canonical_key"))
    return rows.select((start + own).alias("series_id"), *new.columns)


def with_keys(series: DataFrame, keys: list[str]) -> DataFrame:
    """The series with one of the keys; a few keys reach the scan."""
    if len(keys) <= 1000:
        return series.filter(F.col("canonical_key").isin(keys))
    wanted = series.sparkSession.createDataFrame([(k,) for k in keys], "canonical_key string")
    return series.join(wanted, "canonical_key", "left_semi")


def max_id(series: DataFrame) -> int:
    return series.agg(F.coalesce(F.max("series_id"), F.lit(0))).first()[0]


def with_ids(samples: DataFrame, series: DataFrame, n: int | None = None) -> DataFrame:
    """series_id, ts_ms, value of (labels, ts_ms, value), by series of about ``n`` rows."""
    rows = samples.withColumn("canonical_key", canonical_key(F.col("labels")))
    return rows.join(sized(series.select("series_id", "canonical_key"), n), "canonical_key").select("series_id", "ts_ms", "value")


def inverted(pairs: DataFrame, series: DataFrame, n: int | None = None) -> DataFrame:
    """day, name, value, series_id of distinct (day, series_id) pairs, by series of about ``n`` rows."""
    own = sized(series.select("series_id", F.array_distinct("labels").alias("labels")), n)
    rows = pairs.join(own, "series_id").select("day", "series_id", F.explode("labels").alias("l"))
    return rows.select("day", "l.name", "l.value", "series_id")


def postings(index: DataFrame) -> DataFrame:
    """label_key per day with the number of series and the least and greatest of them."""
    rows = index.groupBy("day", "name", "value").agg(F.countDistinct("series_id").alias("n_series"), F.min("series_id").alias("first_id"), F.max("series_id").alias("last_id"))
    return rows.select("day", label_key(F.col("name"), F.col("value")).alias("label_key"), "name", "value", "n_series", "first_id", "last_id")


def unindexed(pairs: DataFrame, indexed: DataFrame) -> DataFrame:
    """(day, series_id) pairs that the index does not have."""
    return pairs.select("day", "series_id").distinct().join(indexed.select("day", "series_id"), ["day", "series_id"], "left_anti")


def match(index: DataFrame, matchers: list[Matcher]) -> DataFrame:
    """series_id of the series that all matchers hold for, on any day of the index: one scan, whatever the number of matchers."""
    wanted = sorted({(m.name, m.value) for m in matchers})
    own = reduce(or_, ((F.col("name") == n) & (F.col("value") == v) for n, v in wanted))
    rows = index.filter(own).select("series_id", "name", "value").distinct()
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(wanted)).select("series_id")


def matching(series: DataFrame, matchers: list[Matcher]) -> DataFrame:
    """The series that all matchers hold for."""
    return series.filter(condition(matchers))
