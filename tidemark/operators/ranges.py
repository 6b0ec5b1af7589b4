"""Range queries: which series, which days and parts, which samples; statistics and JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NAME, day_of, label
from ..functions.text import shortest

#: Up to so many series, their numbers become a filter that reaches the scan.
PUSHED_IDS = 1000
#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000


def in_range(points: DataFrame, start_ms: int, end_ms: int, day: bool = False) -> DataFrame:
    """Samples from start to end, both included; with ``day``, partitions are pruned as well."""
    rows = points.filter(F.col("ts_ms").between(start_ms, end_ms))
    if day:
        first, last = (day_of(F.lit(t).cast("bigint")) for t in (start_ms, end_ms))
        rows = rows.filter(F.col("day").between(first, last))
    return rows


def few_ids(wanted: DataFrame) -> list[int] | None:
    """The wanted numbers, if there are at most ``PUSHED_IDS``."""
    few = [r[0] for r in wanted.select("series_id").limit(PUSHED_IDS + 1).collect()]
    return few if len(few) <= PUSHED_IDS else None


def of_series(points: DataFrame, wanted: DataFrame, few: list[int] | None | bool = True) -> DataFrame:
    """Samples of the wanted series: a pushed-down list for a few (given, or found out), a semi-join (broadcast if small) for many."""
    few = few_ids(wanted) if few is True else few
    if few is not None:
        return points.filter(F.col("series_id").isin(few)) if few else points.limit(0)
    ids = wanted.select("series_id")
    fits = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return points.join(F.broadcast(ids) if fits else ids, "series_id", "left_semi")


def ordered(points: DataFrame) -> DataFrame:
    """By series and time; value breaks ties, so the order is the same every time."""
    return points.orderBy("series_id", "ts_ms", "value")


def select(points: DataFrame, wanted: DataFrame, start_ms: int, end_ms: int, day: bool = False) -> DataFrame:
    """series_id, metric, labels, ts_ms, value: labels come last, after everything is pruned."""
    names = wanted.select("series_id", label(F.col("labels"), NAME).alias("metric"), "labels")
    some = names.limit(PUSHED_IDS + 1).collect()
    if len(some) <= PUSHED_IDS:  # found out once: for the filter, and as the labels
        few, names = [r["series_id"] for r in some], F.broadcast(points.sparkSession.createDataFrame(some, names.schema))
    else:
        few = None
    rows = of_series(in_range(points, start_ms, end_ms, day), wanted, few).select("series_id", "ts_ms", "value")
    return ordered(rows.join(names, "series_id").select("series_id", "metric", "labels", "ts_ms", "value"))


def _entries(labels: pd.Series, samples: pd.Series) -> pd.Series:
    """Elements of a matrix; of a label that occurs twice the greatest value is shown."""

    def one(own, points) -> str:
        metric = {x["name"]: x["value"] for x in own}
        return json.dumps({"metric": dict(sorted(metric.items())), "values": [[p["ts_ms"] / 1000 if p["ts_ms"] % 1000 else p["ts_ms"] // 1000, shortest(p["value"])] for p in points]}, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(a, b) for a, b in zip(labels, samples)])


def matrix(rows: DataFrame) -> DataFrame:
    """series_id and entry (JSON) of a range query's rows."""
    groups = rows.groupBy("series_id").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("samples"))
    entry = F.pandas_udf(_entries, "string")
    return groups.select("series_id", entry("labels", "samples").alias("entry")).orderBy("series_id")


def response(rows: DataFrame) -> str:
    """The whole JSON response: what a client asked for is what the driver holds."""
    entries = ",".join(r["entry"] for r in matrix(rows).toLocalIterator())
    return '{"status":"success","data":{"resultType":"matrix","result":[' + entries + "]}}"


def block_counts(points: DataFrame, *keys: str) -> DataFrame:
    """Per block (a series' samples in one part): n, min_ts, max_ts."""
    return points.groupBy(*keys, "series_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))


def part_meta(blocks: DataFrame, *keys: str) -> DataFrame:
    """Per part, from its blocks: min_ts, max_ts, series_count, samples_count."""
    return blocks.groupBy(*keys).agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"), F.count(F.lit(1)).alias("series_count"), F.sum("n").alias("samples_count"))


def pruned(parts: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Parts whose days and times meet the range."""
    return parts.filter((F.col("max_ts") >= start_ms) & (F.col("min_ts") <= end_ms))


def summary(points: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Per series: n, first and last sample (of equal times the least and the greatest value)."""
    first, last = F.min(F.struct("ts_ms", "value")), F.max(F.struct("ts_ms", "value"))
    rows = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), first.alias("f"), last.alias("l"))
    rows = rows.select("series_id", "n", F.col("f.ts_ms").alias("first_ts"), F.col("f.value").alias("first_value"), F.col("l.ts_ms").alias("last_ts"), F.col("l.value").alias("last_value"))
    return rows if series is None else rows.join(series.select("series_id", "labels"), "series_id", "left")


def first_samples(points: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` samples of each series (0: all), and how many more there are."""
    from pyspark.sql import Window as W

    by = W.partitionBy("series_id")
    rows = points.select("series_id", "ts_ms", "value", F.row_number().over(by.orderBy("ts_ms", "value")).alias("at"), F.count(F.lit(1)).over(by).alias("n"))
    rows = rows.filter(F.col("at") <= limit) if limit > 0 else rows
    more = F.greatest(F.col("n") - limit, F.lit(0)) if limit > 0 else F.lit(0)
    return rows.select("series_id", F.col("at").cast("bigint").alias("at"), "ts_ms", "value", more.cast("bigint").alias("more"), "n")
