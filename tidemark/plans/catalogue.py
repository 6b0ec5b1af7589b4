"""The queries of the metrics engine over the test tables, and the same as DuckDB SQL.

Two mappings make metrics of the tables: every event is a sample of ``event_<type>{user="<id>"}``, and every line item one of
``lineitem_quantity{linestatus="..", returnflag=".."}`` (with many samples at the same time).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.labels import day_of, iso_seconds, label, labels_of, millis, shown
from ..operators import ranges, registry
from ..operators.selector import condition, parse
from ..sources import json_import, parts, remote_write
from ..sources.files import shared_folder
from ..streaming import flush as streaming
from .database import Config, Database

DAY = 86_400_000
JAN = 1_704_067_200_000  # 2024-01-01
NOW = JAN + 30 * DAY
FLUSHES, THRESHOLD, KEEP = 5, 2, 10


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, labels, ts_ms, value."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", labels_of(metric=F.concat(F.lit("event_"), F.col("event_type")), user=F.col("user_id")).alias("labels"), millis(F.col("ts")).alias("ts_ms"), "value")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(labels_of(metric=F.lit("lineitem_quantity"), linestatus=F.col("l_linestatus"), returnflag=F.col("l_returnflag")).alias("labels"), millis(F.col("l_shipdate")).alias("ts_ms"), F.col("l_quantity").alias("value"))


def _series(samples: DataFrame) -> DataFrame:
    return registry.resolve_new(registry.keys(samples), samples.sparkSession.createDataFrame([], "canonical_key string"), 0)


def _points(samples: DataFrame, series: DataFrame) -> DataFrame:
    return registry.with_ids(samples, series)


def _flat(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("series_id", "metric", *[label(F.col("labels"), n).alias(n) for n in names], "ts_ms", "value")


def _select(samples: DataFrame, selector: str, start: int, end: int, *names: str) -> DataFrame:
    """The range query's operators over a table: matchers reach the scan, so only matching samples get numbers."""
    matchers = parse(selector)
    series = registry.matching(_series(samples), matchers)
    points = _points(ranges.in_range(samples.filter(condition(matchers)), start, end), series)
    rows = points.join(series.select("series_id", label(F.col("labels"), "__name__").alias("metric"), "labels"), "series_id")
    return _flat(ranges.ordered(rows), *names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions: samples of events (e), their series (s), and both with day and flush (p).
E = f"""e AS (SELECT event_id, 'event_' || event_type AS metric, CAST(user_id AS VARCHAR) AS "user", epoch_us(ts) // 1000 AS ts_ms, value FROM events),
s AS (SELECT row_number() OVER (ORDER BY metric, "user") AS series_id, metric, "user" FROM (SELECT DISTINCT metric, "user" FROM e)),
p AS (SELECT e.*, s.series_id, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS day, event_id % {FLUSHES} AS flush FROM e JOIN s USING (metric, "user")),
f AS (SELECT day, flush, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(DISTINCT series_id) AS series_count, count(*) AS samples_count,
lpad(CAST(row_number() OVER (PARTITION BY day ORDER BY flush) AS VARCHAR), 6, '0') AS part_id FROM p GROUP BY day, flush)"""
#: A value as text, as far as the tables' values need it.
TEXT = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"
RANGE = 'SELECT series_id, metric, "user", ts_ms, value FROM p'


def _query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@_query(f"WITH {E} {RANGE} WHERE metric = 'event_click' AND ts_ms BETWEEN {JAN + DAY} AND {JAN + 2 * DAY}")
def query_range_metric(spark, sf_dir):
    return _select(_events(spark, sf_dir), "event_click", JAN + DAY, JAN + 2 * DAY, "user")


@_query(f"WITH {E} {RANGE} WHERE \"user\" = '17' AND ts_ms BETWEEN {JAN} AND {NOW}")
def query_range_labels_only(spark, sf_dir):
    return _select(_events(spark, sf_dir), '{user="17"}', JAN, NOW, "user")


@_query(f"WITH {E} {RANGE} WHERE metric = 'event_view' AND \"user\" = '17' AND ts_ms BETWEEN {JAN} AND {NOW}")
def query_range_multi_matcher(spark, sf_dir):
    return _select(_events(spark, sf_dir), 'event_view{user="17"}', JAN, NOW, "user")


@_query(f"WITH {E} {RANGE} WHERE metric = 'event_view' AND \"user\" = ''")
def query_range_empty(spark, sf_dir):
    return _select(_events(spark, sf_dir), 'event_view{user=""}', JAN, NOW, "user")


@_query(f"WITH {E} {RANGE} WHERE metric = 'event_error' AND ts_ms BETWEEN {JAN + 5 * DAY - 3_600_000} AND {JAN + 5 * DAY + 3_600_000}")
def query_range_cross_day(spark, sf_dir):
    return _select(_events(spark, sf_dir), "event_error", JAN + 5 * DAY - 3_600_000, JAN + 5 * DAY + 3_600_000, "user")


@_query("""WITH d AS (SELECT l_linestatus AS linestatus, l_returnflag AS returnflag, epoch_us(l_shipdate) // 1000 AS ts_ms, l_quantity AS value FROM lineitem),
s AS (SELECT row_number() OVER (ORDER BY linestatus, returnflag) AS series_id, linestatus, returnflag FROM (SELECT DISTINCT linestatus, returnflag FROM d))
SELECT series_id, 'lineitem_quantity' AS metric, linestatus, returnflag, ts_ms, value FROM d JOIN s USING (linestatus, returnflag)
WHERE returnflag = 'R' AND ts_ms BETWEEN 820454400000 AND 828316800000""")
def query_range_duplicates_kept(spark, sf_dir):
    return _select(_items(spark, sf_dir), 'lineitem_quantity{returnflag="R"}', 820_454_400_000, 828_316_800_000, "linestatus", "returnflag")


@_query(f"WITH {E} {RANGE} WHERE metric = 'event_signup' AND ts_ms BETWEEN {JAN} AND {JAN + 3 * DAY}")
def query_range_mem_and_disk_union(spark, sf_dir):
    """A quarter of the events stand for the buffer, the rest for parts."""
    rows = _events(spark, sf_dir)
    series = registry.matching(_series(rows), parse("event_signup"))
    points = [_points(rows.filter(c), series) for c in ("event_id % 4 = 0", "event_id % 4 != 0")]
    return _flat(ranges.select(points[0].unionByName(points[1]), series, JAN, JAN + 3 * DAY), "user")


@_query(f"WITH {E} SELECT series_id, '__name__' || chr(1) || metric || chr(2) || 'user' || chr(1) || \"user\" || chr(2) AS canonical_key, metric || '{{user=\"' || \"user\" || '\"}}' AS shown FROM s")
def series_registry(spark, sf_dir):
    return _series(_events(spark, sf_dir)).select("series_id", "canonical_key", shown(F.col("labels")).alias("shown"))


@_query("""WITH e AS (SELECT DISTINCT 'event_' || event_type AS metric, CAST(user_id AS VARCHAR) AS "user", event_id % 10 = 0 AS early FROM events),
a AS (SELECT row_number() OVER (ORDER BY metric, "user") AS series_id, metric, "user" FROM e WHERE early),
b AS (SELECT (SELECT count(*) FROM a) + row_number() OVER (ORDER BY metric, "user") AS series_id, metric, "user" FROM (SELECT metric, "user" FROM e EXCEPT SELECT metric, "user" FROM a))
SELECT * FROM a UNION ALL SELECT * FROM b""")
def series_resolve_incremental(spark, sf_dir):
    """A tenth of the events comes first; what the rest adds is numbered after it."""
    rows = _events(spark, sf_dir)
    early = _series(rows.filter("event_id % 10 = 0"))
    late = registry.resolve_new(registry.keys(rows), early, registry.max_id(early))
    return early.unionByName(late).select("series_id", label(F.col("labels"), "__name__").alias("metric"), label(F.col("labels"), "user").alias("user"))


def _indexed(spark, sf_dir, rows=None):
    rows = _events(spark, sf_dir) if rows is None else rows
    series = _series(rows)
    pairs = _points(rows, series).select(day_of(F.col("ts_ms")).alias("day"), "series_id").distinct()
    return series, pairs, registry.inverted(pairs, series)


@_query(f"""WITH {E} SELECT day, name || chr(1) || val AS label_key, name, val AS value, count(DISTINCT series_id) AS n_series, min(series_id) AS first_id, max(series_id) AS last_id
FROM (SELECT day, series_id, '__name__' AS name, metric AS val FROM p UNION ALL SELECT day, series_id, 'user', "user" FROM p) GROUP BY ALL""")
def inverted_index_postings(spark, sf_dir):
    return registry.postings(_indexed(spark, sf_dir)[2])


@_query(f"WITH {E} SELECT series_id FROM s WHERE metric = 'event_purchase' AND \"user\" = '17'")
def match_series_ids(spark, sf_dir):
    return registry.match(_indexed(spark, sf_dir)[2], parse('event_purchase{user="17"}'))


@_query(f"WITH {E} SELECT day, series_id FROM p WHERE flush >= 4 EXCEPT SELECT day, series_id FROM p WHERE flush < 4")
def inverted_index_unindexed_delta(spark, sf_dir):
    points = _flushed(spark, sf_dir)
    return registry.unindexed(points.filter("flush >= 4"), points.filter("flush < 4").select("day", "series_id").distinct())


def _flushed(spark, sf_dir):
    """series_id, ts_ms, value, day, flush: eight flushes, by event_id."""
    rows = _events(spark, sf_dir)
    keyed = rows.withColumn("canonical_key", registry.canonical_key(F.col("labels"))).join(_series(rows).select("series_id", "canonical_key"), "canonical_key")
    return keyed.select("series_id", "ts_ms", "value", day_of(F.col("ts_ms")).alias("day"), (F.col("event_id") % FLUSHES).alias("flush"))


_databases: dict[tuple, dict] = {}


def _flushing(spark, sf_dir, threshold: int, version: str) -> tuple[Database, dict[str, int]]:
    """A database of the events in ``FLUSHES`` flushes, made once for a session, and its versions by name.

    With a high threshold, a forced merge and then retention follow, once a version of theirs is asked for.
    """
    key = spark.sparkContext.applicationId, sf_dir, threshold
    if key not in _databases:
        db, rows, versions = _database(spark, sf_dir, threshold), _events(spark, sf_dir), {}
        for k in range(FLUSHES):
            db.ingest(rows.filter(F.col("event_id") % FLUSHES == k).select("labels", "ts_ms", "value"))
            db.flush()
        versions["flushed"] = db.version
        _databases[key] = {"path": db.files.root, "versions": versions}
    made = _databases[key]
    if version not in made["versions"]:
        db = Database(spark, made["path"], Config(merge_threshold=threshold))
        if "merged" not in made["versions"]:
            db.force_merge()
            made["versions"]["merged"] = db.version
        if version == "kept":
            db.apply_retention(KEEP, NOW)
            made["versions"]["kept"] = db.version
    return made["path"], made["versions"]


def _at(spark, sf_dir, version: str, threshold: int = 100) -> Database:
    path, versions = _flushing(spark, sf_dir, threshold, version)
    return Database(spark, path, version=versions[version])


def _parts(db: Database) -> DataFrame:
    return db.parts_meta()


@_query(f"WITH {E} SELECT day, count(DISTINCT flush) AS n_parts, count(*) AS n_samples, count(DISTINCT series_id) AS n_series FROM p GROUP BY day")
def flush_day_partitions(spark, sf_dir):
    return _at(spark, sf_dir, "flushed").blocks().groupBy("day").agg(F.countDistinct("part_id").alias("n_parts"), F.sum("n").alias("n_samples"), F.countDistinct("series_id").alias("n_series"))


@_query(f"WITH {E} SELECT day, part_id, 'small' AS tier, min_ts, max_ts, series_count, samples_count FROM f")
def part_meta(spark, sf_dir):
    return _parts(_at(spark, sf_dir, "flushed"))


@_query(f"WITH {E} SELECT day, part_id, samples_count FROM f WHERE max_ts >= {JAN + 3 * DAY + 7_200_000} AND min_ts <= {JAN + 4 * DAY + 600_000}")
def parts_pruned_by_time(spark, sf_dir):
    """The parts that a query of that range opens."""
    db = _at(spark, sf_dir, "flushed")
    rows = [(p.day, p.part_id, p.samples_count) for p in db._in_range(db.parts(), JAN + 3 * DAY + 7_200_000, JAN + 4 * DAY + 600_000)]
    return spark.createDataFrame(rows, "day string, part_id string, samples_count bigint")


@_query(f"""WITH {E}, o AS (SELECT day, flush FROM f WHERE max_ts >= {JAN + 3 * DAY} AND min_ts <= {JAN + 5 * DAY - 1}),
b AS (SELECT p.* FROM p JOIN o USING (day, flush) WHERE metric = 'event_click')
SELECT (SELECT count(*) FROM o) AS parts_scanned, (SELECT count(*) FROM (SELECT DISTINCT day, flush, series_id FROM b)) AS blocks_scanned,
(SELECT count(*) FROM b) AS points_scanned, (SELECT count(*) FROM b WHERE ts_ms BETWEEN {JAN + 3 * DAY} AND {JAN + 5 * DAY - 1}) AS points_returned""")
def query_stats(spark, sf_dir):
    return _at(spark, sf_dir, "flushed").query_stats("event_click", JAN + 3 * DAY, JAN + 5 * DAY - 1)


@_query(f"WITH {E} SELECT day, count(*) AS n_small FROM f GROUP BY day HAVING count(*) >= {FLUSHES}")
def compaction_candidates(spark, sf_dir):
    db = _at(spark, sf_dir, "flushed")
    return spark.createDataFrame([(day, len(own)) for day, own in db.candidates(db.days(), FLUSHES).items()], "day string, n_small bigint")


@_query(f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY flush) - 1 AS place, count(*) OVER (PARTITION BY day) AS k FROM f),
g AS (SELECT *, place < k // {THRESHOLD} * {THRESHOLD} AS goes FROM r)
SELECT day, CASE WHEN goes THEN 'big' ELSE 'small' END AS tier, min(min_ts) AS min_ts, max(max_ts) AS max_ts, CAST(sum(samples_count) AS BIGINT) AS samples_count
FROM g GROUP BY day, goes, CASE WHEN goes THEN place // {THRESHOLD} ELSE place END""")
def compaction_result_parts(spark, sf_dir):
    return _parts(_at(spark, sf_dir, "flushed", THRESHOLD)).select("day", "tier", "min_ts", "max_ts", "samples_count")


@_query(f"""WITH {E}, c AS (SELECT day, count(DISTINCT series_id) AS series_count FROM p GROUP BY day)
SELECT day, CASE WHEN count(*) > 1 THEN 'big' ELSE 'small' END AS tier, min(min_ts) AS min_ts, max(max_ts) AS max_ts, CAST(sum(samples_count) AS BIGINT) AS samples_count, c.series_count FROM f JOIN c USING (day) GROUP BY day, c.series_count""")
def force_merge_result(spark, sf_dir):
    return _parts(_at(spark, sf_dir, "merged")).drop("part_id")


@_query(f"WITH {E} SELECT metric, \"user\", ts_ms, value, count(*) AS n FROM p GROUP BY ALL")
def compaction_preserves_samples(spark, sf_dir):
    """All samples of the database after its merges, repeated ones too."""
    rows = _at(spark, sf_dir, "flushed", THRESHOLD).samples(0, 1 << 43)
    return rows.groupBy(label(F.col("labels"), "__name__").alias("metric"), label(F.col("labels"), "user").alias("user"), "ts_ms", "value").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {E} SELECT day, CAST(count(*) AS BIGINT) AS n_samples FROM p WHERE day >= '20240121' GROUP BY day")
def retention_live_days(spark, sf_dir):
    return _parts(_at(spark, sf_dir, "kept")).groupBy("day").agg(F.sum("samples_count").alias("n_samples"))


def _renumbered(db: Database, rows: DataFrame) -> DataFrame:
    """Numbers in order of the keys in place of the database's, which depend on what came first."""
    names = registry.number(db.series().select(F.col("series_id").alias("_id"), "canonical_key"), 0).select("_id", F.col("series_id").alias("at"))  # by ranges, no task sees all
    return rows.join(names, rows["series_id"] == names["_id"]).withColumn("series_id", F.col("at")).drop("_id", "at")


@_query(f"WITH {E} {RANGE} WHERE metric = 'event_error' AND day >= '20240121'")
def retention_query_after_drop(spark, sf_dir):
    """Identities are those of all samples; only live days are left to read."""
    db = _at(spark, sf_dir, "kept")
    return _renumbered(db, _flat(db.query_range("event_error", JAN, NOW + DAY), "user"))


@_query(f"WITH {E} SELECT series_id FROM s WHERE series_id NOT IN (SELECT series_id FROM p WHERE day >= '20240121')")
def retention_forgotten_series(spark, sf_dir):
    """Identities stay, but series without a live day cannot be found."""
    db = _at(spark, sf_dir, "kept")
    return _renumbered(db, db.series().join(db.live_ids(), "series_id", "left_anti")).select("series_id")


@_query(f"WITH {E}, d AS (SELECT DISTINCT day FROM p WHERE day >= '20240121') SELECT (SELECT count(*) FROM s) AS n_series, (SELECT count(*) FROM s) + 1 AS next_id, (SELECT count(*) FROM d) AS n_days, (SELECT min(day) FROM d) AS first_day, 0 AS missing")
def database_reopened(spark, sf_dir):
    """What a second process finds after merges and retention: identities, the next number, live days in order, and files for all of them."""
    db = Database(spark, _flushing(spark, sf_dir, 100, "kept")[0])
    days = db.days()
    missing = sum(not db.files.exists(p.path) for p in db.parts()) + (days != sorted(days))
    return spark.createDataFrame([(db.series().count(), db.append([("__name__", "new")], [(1, 1.0)]), len(days), days[0], missing)], "n_series bigint, next_id bigint, n_days bigint, first_day string, missing int")


@_query(f"WITH {E} SELECT DISTINCT day, CAST(0 AS BIGINT) AS out_of_order FROM p")
def part_order(spark, sf_dir):
    """Samples of a day's merged part that stand behind a greater (series, time) in their file."""
    db = _at(spark, sf_dir, "merged")
    rows = None
    for p in db.parts():
        own = spark.read.parquet(db.files.full(p.path)).select(F.lit(p.day).alias("day"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("i"), F.struct("series_id", "ts_ms").alias("k"))
        rows = own if rows is None else rows.unionByName(own)
    by = W.partitionBy("day", "file").orderBy("i")
    return rows.withColumn("odd", F.lag("k").over(by) > F.col("k")).groupBy("day").agg(F.coalesce(F.sum(F.col("odd").cast("bigint")), F.lit(0)).alias("out_of_order"))


@_query(f"""WITH {E}, one AS (SELECT * FROM p WHERE day = '20240103' AND flush = (SELECT min(flush) FROM p WHERE day = '20240103')),
h AS (SELECT series_id, metric, "user", count(*) AS n, min(ts_ms) AS a, max(ts_ms) AS b, arg_min(value, ts_ms) AS va, arg_max(value, ts_ms) AS vb FROM one GROUP BY ALL),
iso AS (SELECT metric || '{{user="' || "user" || '"}}  (' || n || ' samples)' AS l1, strftime(make_timestamp(a * 1000), '%Y-%m-%dT%H:%M:%SZ') AS ia, strftime(make_timestamp(b * 1000), '%Y-%m-%dT%H:%M:%SZ') AS ib, va, vb FROM h)
SELECT 'tier: small  encoding: parquet' AS line UNION ALL SELECT 'series: ' || count(*) || '  samples: ' || CAST(sum(n) AS BIGINT) FROM h
UNION ALL SELECT l1 FROM iso UNION ALL SELECT '  first: ' || ia || ' = ' || {TEXT.replace("value", "va")} FROM iso UNION ALL SELECT '  last:  ' || ib || ' = ' || {TEXT.replace("value", "vb")} FROM iso""")
def inspect_command(spark, sf_dir):
    """The lines that the command prints for a part, but for its path and times, and empty ones."""
    import io

    from ..sources import inspect

    out = io.StringIO()
    _at(spark, sf_dir, "flushed")
    path, versions = _flushing(spark, sf_dir, 100, "flushed")
    db = Database(spark, path, version=versions["flushed"])
    if inspect.show(db, "20240103", "000001", out=out):
        raise ValueError("no such part")
    return spark.createDataFrame([(x,) for x in out.getvalue().split("\n") if x and not x.startswith(("part: ", "time range: "))], "line string")


NATIONS = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation"


def _nations(spark, sf_dir) -> list:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    return [([("__name__", "nation"), ("name", r[1])], [(1000 * r[0], float(r[2])), (1000 * r[0] + 500, r[0] / 4)]) for r in rows]


@_query(f"WITH n AS ({NATIONS}) SELECT turn, name, 1000 * k + late AS ts_ms, CASE WHEN late = 0 THEN CAST(r AS DOUBLE) ELSE k / 4.0::DOUBLE END AS value FROM n, (VALUES (0), (500)) a(late), (VALUES ('buffered'), ('failed'), ('flushed'), ('reopened')) t(turn)")
def buffer_life(spark, sf_dir):
    """Appended samples are found in the buffer, after a flush that failed, after one that did not, and by another process."""
    db = _database(spark, sf_dir, 100)
    db.append_many(_nations(spark, sf_dir))
    found = lambda turn, db: db.query_range("nation", 0, 1 << 40).select(F.lit(turn).alias("turn"), label(F.col("labels"), "name").alias("name"), "ts_ms", "value")
    out = found("buffered", db)
    publish = db._publish
    db._publish = lambda change: (_ for _ in ()).throw(OSError("no space"))
    try:
        db.flush()
    except OSError:
        out = out.unionByName(found("failed", db))
    db._publish = publish
    stop = db.start_flushing(0.01)  # the background's flush
    while not db.parts():
        stop.wait(0.05)
    db.close()
    return out.unionByName(found("flushed", db)).unionByName(found("reopened", Database(spark, db.files.root)))


@_query(f"""WITH n AS ({NATIONS}) SELECT * FROM (VALUES ('health', 200, 'OK'), ('nowhere', 404, 'not found'), ('no post', 405, 'use POST'), ('bad body', 400, NULL), ('bad selector', 400, NULL), ('bad time', 400, NULL), ('flush', 204, ''), ('merge', 204, ''), ('broken', 500, 'no space')) v(request, status, body)
UNION ALL SELECT 'import', 200, '{{"ingested": ' || 2 * count(*) || '}}' FROM n UNION ALL SELECT 'write', 204, CAST(2 * count(*) AS VARCHAR) FROM n
UNION ALL SELECT 'points', 200, CAST(4 * count(*) AS VARCHAR) FROM n""")
def http_replies(spark, sf_dir):
    """Status and body (or the points that a header names) of requests."""
    import json

    from ..sources.http import PREFIX, respond

    db, own, out = _database(spark, sf_dir, 100), _nations(spark, sf_dir), []

    def ask(request, method, target, body=b"", said=lambda headers, body: body.decode().strip()):
        status, headers, text = respond(db, method, target, body)
        out.append((request, status, said(headers, text)))

    nothing = lambda headers, body: None
    ask("health", "GET", "/healthz")
    ask("nowhere", "GET", "/x")
    ask("no post", "GET", "/api/v1/import")
    ask("bad body", "POST", "/api/v1/import", b"{", nothing)
    ask("import", "POST", "/api/v1/import", json.dumps([{"metric": "nation", "labels": {"name": labels[1][1]}, "samples": [{"t": t, "v": v} for t, v in samples]} for labels, samples in own]).encode())
    ask("write", "POST", "/api/v1/write", remote_write.encode(own), lambda headers, body: headers[f"{PREFIX}Points-Ingested"])
    ask("flush", "POST", "/internal/force_flush")
    ask("merge", "POST", "/internal/force_merge")
    ask("points", "GET", "/api/v1/query_range?query=nation&start=0&end=1e9", said=lambda headers, body: headers[f"{PREFIX}Points-Returned"] if len(json.loads(body)["data"]["result"]) == len(own) else "?")
    ask("bad selector", "GET", "/api/v1/query_range?query=%7B&start=0&end=1", said=nothing)
    ask("bad time", "GET", "/api/v1/query_range?query=nation&start=x&end=1", said=nothing)
    db.append_many(own)
    db._publish = lambda change: (_ for _ in ()).throw(OSError("no space"))
    ask("broken", "POST", "/internal/force_flush")
    return spark.createDataFrame(out, "request string, status int, body string")


@_query(f"SELECT event_id, {TEXT} AS shown, epoch_us(ts) // 1000 AS parsed, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS seconds, event_id % 50 AS days FROM events")
def text_and_times(spark, sf_dir):
    """Numbers as text, RFC 3339 times and periods read, and milliseconds as seconds."""
    from ..functions.labels import seconds
    from ..functions.text import retention_days, shortest, time_param

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", millis(F.col("ts")).alias("ts_ms"), "value")
    text = F.concat(F.regexp_replace(iso_seconds(F.col("ts_ms")), "Z$", "."), F.lpad(F.pmod("ts_ms", F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))
    of = lambda f, kind: F.pandas_udf(lambda s: s.map(f), kind)
    return rows.select("event_id", of(shortest, "string")("value").alias("shown"), of(time_param, "bigint")(text).alias("parsed"), seconds(F.col("ts_ms")).alias("seconds"), of(retention_days, "bigint")(F.concat((F.col("event_id") % 50).cast("string"), F.lit("d"))).alias("days"))


@_query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'gorilla' END AS encoding, o_custkey AS series_id, o_orderkey * 1000 AS ts_ms, o_totalprice AS value FROM orders WHERE o_custkey <= 20")
def part_folders(spark, sf_dir):
    """Orders of twenty customers as part folders in both encodings, read back."""
    import uuid as ids

    folder = f"{shared_folder(spark)}/parts-{ids.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_custkey <= 20").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double")).collect()
    for k, encoding in enumerate(("raw", "gorilla")):
        series: dict = {}
        for c, o, price in rows:
            if o % 2 == k:
                series.setdefault(c, []).append((o * 1000, price))
        parts.write(f"{folder.removeprefix('file://').removeprefix('file:')}/{encoding}", parts.encode(series, encoding=encoding))
    back = parts.read(spark, folder)
    return back.select(F.substring_index("part", "/", -1).alias("encoding"), "series_id", "ts_ms", "value")


@_query(f"""WITH {E} SELECT series_id, count(*) AS n, min(ts_ms) AS first_ts, arg_min(value, ts_ms) AS first_value, max(ts_ms) AS last_ts, arg_max(value, ts_ms) AS last_value,
strftime(make_timestamp(min(ts_ms) * 1000), '%Y-%m-%dT%H:%M:%SZ') AS first_at FROM p GROUP BY series_id""")
def inspect_series_summary(spark, sf_dir):
    return ranges.summary(_flushed(spark, sf_dir)).withColumn("first_at", iso_seconds(F.col("first_ts")))


@_query(f"""WITH {E} SELECT series_id, "at", ts_ms, value, greatest(n - 5, 0) AS more FROM (SELECT series_id, ts_ms, value, row_number() OVER (PARTITION BY series_id ORDER BY ts_ms, value) AS "at",
count(*) OVER (PARTITION BY series_id) AS n FROM p) WHERE "at" <= 5""")
def inspect_samples_limit(spark, sf_dir):
    return ranges.first_samples(_flushed(spark, sf_dir), 5).drop("n")


@_query(f"""WITH {E}, d AS (SELECT series_id, ts_ms, ts_ms - lag(ts_ms) OVER w AS delta FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts_ms, value))
SELECT series_id, ts_ms, delta, delta - coalesce(lag(delta) OVER (PARTITION BY series_id ORDER BY ts_ms), 0) AS dod FROM d WHERE delta IS NOT NULL""")
def timestamp_delta_of_delta(spark, sf_dir):
    by = W.partitionBy("series_id")
    rows = _flushed(spark, sf_dir).select("series_id", "ts_ms", (F.col("ts_ms") - F.lag("ts_ms").over(by.orderBy("ts_ms", "value"))).alias("delta"))
    return rows.filter("delta IS NOT NULL").withColumn("dod", F.col("delta") - F.coalesce(F.lag("delta").over(by.orderBy("ts_ms")), F.lit(0)))


_SIZE = lambda n: "(1" + "".join(f" + CASE WHEN {n} >= {1 << 7 * k} THEN 1 ELSE 0 END" for k in range(1, 9)) + ")"


@_query(f"""WITH {E}, d AS (SELECT series_id, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY series_id ORDER BY ts_ms) AS delta FROM p),
z AS (SELECT series_id, delta - coalesce(lag(delta) OVER (PARTITION BY series_id ORDER BY ts_ms), 0) AS dod FROM d),
c AS (SELECT series_id, CASE WHEN dod >= 0 THEN 2 * dod ELSE -2 * dod - 1 END AS coded FROM z)
SELECT series_id, count(*) AS n, CAST({_SIZE("count(*)")} + 8 + sum(CASE WHEN coded IS NULL THEN 0 ELSE {_SIZE("coded")} END) AS BIGINT) AS n_bytes FROM c GROUP BY series_id""")
def timestamp_block_bytes(spark, sf_dir):
    return codec.timestamp_bytes(_flushed(spark, sf_dir))


@_query(f"WITH {E} SELECT series_id, ts_ms, value FROM p")
def value_block_roundtrip(spark, sf_dir):
    """Encoded blocks of all series, decoded again."""
    return codec.samples(codec.blocks(_flushed(spark, sf_dir)))


@_query(f"WITH {E} SELECT series_id, ts_ms, value FROM p")
def raw_block_roundtrip(spark, sf_dir):
    return codec.samples(codec.blocks(_flushed(spark, sf_dir), "raw"), "raw")


@_query(f"WITH {E} SELECT series_id, count(*) AS n, count(*) * 16 AS raw_bytes FROM p GROUP BY series_id")
def raw_block_bytes(spark, sf_dir):
    rows = codec.blocks(_flushed(spark, sf_dir), "raw")
    return rows.select("series_id", "n", (F.length("timestamps") + F.length("values")).cast("bigint").alias("raw_bytes"))


@_query(f"WITH {E} SELECT metric, \"user\", ts_ms, value FROM p WHERE metric <> 'event_view'")
def remote_write_ingest(spark, sf_dir):
    """Each series' samples as request bodies, decoded again; views come without a metric name and are skipped.

    A body ends with the batch of rows that it is made of, so no series has to fit one Python value.
    """
    rows = _events(spark, sf_dir).select("labels", "ts_ms", "value").repartitionByRange("labels", "ts_ms").sortWithinPartitions("labels", "ts_ms")
    own = lambda labels: [(x["name"], x["value"]) for x in labels if not (x["name"] == "__name__" and x["value"] == "event_view")]

    def bodies(batches):
        import pandas as pd

        for batch in batches:
            runs = groupby(zip(map(own, batch["labels"]), batch["ts_ms"].tolist(), batch["value"].tolist()), key=lambda r: r[0])
            yield pd.DataFrame({"content": [remote_write.encode([(labels, [(t, v) for _, t, v in samples])]) for labels, samples in runs]})

    back = remote_write.parse_bodies(rows.mapInPandas(bodies, "content binary"))
    return back.select(label(F.col("labels"), "__name__").alias("metric"), label(F.col("labels"), "user").alias("user"), "ts_ms", "value")


@_query(f"WITH {E} SELECT metric, \"user\", ts_ms, value FROM p")
def json_import_ingest(spark, sf_dir):
    """Each series' samples as an import body, read again."""
    rows = _events(spark, sf_dir).groupBy(label(F.col("labels"), "__name__").alias("metric"), label(F.col("labels"), "user").alias("user")).agg(F.collect_list(F.struct(F.col("ts_ms").alias("t"), F.col("value").alias("v"))).alias("samples"))
    made = rows.select(F.to_json(F.struct("metric", F.create_map(F.lit("user"), F.col("user")).alias("labels"), "samples")).alias("value"))
    back = json_import.parse_json(made)
    return back.select(label(F.col("labels"), "__name__").alias("metric"), label(F.col("labels"), "user").alias("user"), "ts_ms", "value")


@_query(f"""WITH {E} SELECT series_id, '{{"metric":{{"__name__":"event_click","user":"' || "user" || '"}},"values":[' ||
string_agg('[' || CASE WHEN ts_ms % 1000 = 0 THEN CAST(ts_ms // 1000 AS VARCHAR) ELSE CAST(ts_ms / 1000.0::DOUBLE AS VARCHAR) END || ',"' || {TEXT} || '"]', ',' ORDER BY ts_ms, value) || ']}}' AS entry
FROM p WHERE metric = 'event_click' AND ts_ms BETWEEN {JAN} AND {NOW} GROUP BY series_id, "user\"""")
def matrix_response(spark, sf_dir):
    rows = _events(spark, sf_dir)
    series = registry.matching(_series(rows), parse("event_click"))
    return ranges.matrix(ranges.select(_points(rows, series), series, JAN, NOW))


def _database(spark, sf_dir, threshold: int = 2):
    return Database(spark, f"{shared_folder(spark)}/db-{uuid.uuid4().hex}", Config(merge_threshold=threshold))


@_query(f"WITH {E} {RANGE} WHERE metric = 'event_click' AND ts_ms BETWEEN {JAN + DAY} AND {JAN + 4 * DAY}")
def database_round_trip(spark, sf_dir):
    """Two flushes, which are merged at once, and a third of the events still in the buffer."""
    db, rows = _database(spark, sf_dir), _events(spark, sf_dir)
    for k in range(3):
        db.ingest(rows.filter(F.col("event_id") % 3 == k).select("labels", "ts_ms", "value"))
        if k < 2:
            db.flush()
    return _renumbered(db, _flat(db.query_range("event_click", JAN + DAY, JAN + 4 * DAY), "user"))


@_query(f"WITH {E} SELECT day, CAST(1 AS BIGINT) AS n_parts, count(*) AS samples_count FROM p GROUP BY day")
def streaming_flush(spark, sf_dir):
    """A stream of the events' file, one batch, one flush."""
    db = _database(spark, sf_dir)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(labels_of(metric=F.concat(F.lit("event_"), F.col("event_type")), user=F.col("user_id")).alias("labels"), millis(F.col("ts")).alias("ts_ms"), "value")
    streaming.start(db, rows, "events", f"{db.files.root}/checkpoint", once=True).awaitTermination()
    return db.parts_meta().groupBy("day").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("samples_count").alias("samples_count"))
