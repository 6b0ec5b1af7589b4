"""A time-series database: samples in day partitions of immutable Parquet parts, described by commits.

On disk, below one root: ``data/<id>/day=YYYYMMDD`` (a part's files), ``blocks/batch=<id>/day=YYYYMMDD`` (samples per series
and part), ``series/<id>`` (identities), ``inverted/batch=<id>/day=YYYYMMDD`` (labels per day) and ``commits/NNNNNNNNNN.json``. A commit names everything
that is live; files come first and the commit last, so a crash leaves at most files that nothing names,
which ``vacuum`` removes. A query plans against one commit and one copy of the buffer: the index of the days in question
says which series the selector means, and only their samples are read. Files that a merge or retention replaces are deleted
after ``Config.grace_seconds``, since DataFrames that were planned before may still read them.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import AFTER_NAME, AFTER_VALUE, DAY_MS, POINTS, SERIES, day_of, iso_seconds, shown
from ..operators import ranges, registry
from ..operators.selector import Matcher, condition, parse
from ..sources.files import Files

BLOCKS = "day string, series_id bigint, n bigint, min_ts bigint, max_ts bigint"
KEYS = "canonical_key string, labels array<struct<name:string,value:string>>"
INVERTED = "day string, name string, value string, series_id bigint"
SMALL, BIG = "small", "big"
#: Files of identities, or of a day's index, that are merged into one; keys that a process remembers; old commits that stay.
FOLDERS, REMEMBERED, COMMITS = 16, 1_000_000, 100


@dataclass(frozen=True)
class Config:
    """Small parts of a day at which they are merged, days to keep (0: all), seconds between flushes, address to listen on,
    seconds between retention passes, and seconds that replaced files stay."""

    merge_threshold: int = 3
    retention_days: int = 0
    flush_seconds: float = 5.0
    retention_seconds: float = 3600.0
    grace_seconds: float = 3600.0
    listen: str = "127.0.0.1:8428"


@dataclass(frozen=True)
class Part:
    day: str
    part_id: str
    path: str
    blocks: str
    tier: str
    min_ts: int
    max_ts: int
    series_count: int
    samples_count: int


def utc_day(ts_ms: int) -> str:
    return time.strftime("%Y%m%d", time.gmtime(ts_ms // 1000))


def key_of(labels: Iterable[tuple[str, str]]) -> tuple[str, tuple[tuple[str, str], ...]]:
    """Canonical key and sorted labels; the input is left alone."""
    own = tuple(sorted((str(n), str(v)) for n, v in labels))
    return "".join(f"{n}{AFTER_NAME}{v}{AFTER_VALUE}" for n, v in own), own


class Database:
    """Ingest, flush, merge, retention and queries. Writers are one process; readers may be many."""

    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), version: int | None = None):
        """Opens the latest commit, or the one of ``version`` to read from (its files last as long as ``grace_seconds``)."""
        self.spark, self.config, self.files = spark, config, Files(spark, path)
        self._lock = threading.RLock()  # buffer and commit together
        self._writing = threading.RLock()  # flush, merge, retention
        self._points: list[tuple[int, int, float]] = []
        self._frames: list[tuple[str, DataFrame]] = []  # staged samples with their folders
        self._fresh: dict[str, tuple[int, tuple]] = {}  # identities that no commit has yet
        self._fresh_frames: list[tuple[str, DataFrame]] = []
        self._ids: dict[str, int] = {}  # of keys met in this process
        self._stops: list[threading.Event] = []
        self._threads: list[threading.Thread] = []
        self._commit = self._latest(version)
        self._counter = self._commit["next_series"] - 1

    # -- commits ---------------------------------------------------------------------------------------

    def _latest(self, version: int | None = None) -> dict:
        names = [n for n in self.files.names("commits") if re.fullmatch(r"\d+\.json", n)]
        if version is not None:
            names = [n for n in names if int(n.removesuffix(".json")) == version]
            if not names:
                raise KeyError(f"no version {version}")
        if not names:
            return {"version": 0, "parts": [], "next_part": {}, "next_series": 1, "series": [], "inverted": [], "batches": {}, "gone": []}
        return json.loads(self.files.read(f"commits/{names[-1]}"))

    @property
    def version(self) -> int:
        return self._commit["version"]

    def _publish(self, change: Callable[[dict], None]) -> None:
        """Makes the next commit durable, then visible. Another writer's commit is an error, not a merge."""
        new = json.loads(json.dumps(self._commit))
        change(new)
        new["version"] += 1
        if not self.files.create(f"commits/{new['version']:010d}.json", json.dumps(new)):
            raise RuntimeError("another process has written to this database")
        with self._lock:
            self._commit = new

    def parts(self) -> list[Part]:
        return sorted((Part(**p) for p in self._commit["parts"]), key=lambda p: (p.day, p.part_id))

    def days(self) -> list[str]:
        return sorted({p.day for p in self.parts()})

    def manifest(self, day: str) -> list[str]:
        """Names of a day's live parts."""
        return [p.part_id for p in self.parts() if p.day == day]

    # -- series ----------------------------------------------------------------------------------------

    def _committed_series(self) -> DataFrame:
        paths = [self.files.full(p) for p in self._commit["series"]]
        return self.spark.read.schema(SERIES).parquet(*paths) if paths else self.spark.createDataFrame([], SERIES)

    def series(self) -> DataFrame:
        """All identities: series_id, canonical_key, labels."""
        with self._lock:
            out = self._committed_series()
            if self._fresh:
                out = out.unionByName(self.spark.createDataFrame([(i, k, list(own)) for k, (i, own) in self._fresh.items()], SERIES))
            for _, frame in self._fresh_frames:
                out = out.unionByName(frame)
        return out

    def _buffered_ids(self) -> DataFrame | None:
        with self._lock:
            points, frames = {p[0] for p in self._points}, [f for _, f in self._frames]
        out = self.spark.createDataFrame(sorted((i,) for i in points), "series_id bigint") if points else None
        for frame in frames:
            own = frame.select("series_id").distinct()
            out = own if out is None else out.unionByName(own)
        return out

    def live_ids(self) -> DataFrame:
        """series_id with samples on a live day or in the buffer: those that can be found."""
        ids, memory = self.inverted().select("series_id"), self._buffered_ids()
        return (ids if memory is None else ids.unionByName(memory)).distinct()

    def inverted(self, days: Callable[[str], bool] = lambda day: True) -> DataFrame:
        """day, name, value, series_id of the index, of the live days or some of them."""
        with self._lock:
            paths = [f"{p['path']}/day={d}" for p in self._commit["inverted"] for d in p["days"] if days(d)]
        return self._leaves("inverted", INVERTED, paths).select("day", "name", "value", "series_id").distinct()

    def _leaves(self, folder: str, schema: str, paths: list[str]) -> DataFrame:
        """One scan, however many folders, of columns, batch and day."""
        full = f"{schema}, batch string"
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.files.full(folder)).parquet(*[self.files.full(p) for p in paths])

    def match(self, matchers: list[Matcher], days: Callable[[str], bool] = lambda day: True) -> DataFrame:
        """Findable series that all matchers hold for."""
        series, ids, few = self._found(matchers, days)
        if few is not None:  # the numbers reach the scan of the identities
            return series.filter(F.col("series_id").isin(few)) if few else series.limit(0)
        return ranges.of_series(series, ids, few=None)

    def _found(self, matchers: list[Matcher], days: Callable[[str], bool] = lambda day: True) -> tuple[DataFrame, DataFrame, list[int] | None]:
        """All series, the numbers of those that all matchers hold for (by the index of the days, and what is only in the buffer
        by its labels), and these numbers as a list if they are few."""
        series = self.series()
        ids, memory = registry.match(self.inverted(days), matchers), self._buffered_ids()
        if memory is not None:
            ids = ids.unionByName(series.filter(condition(matchers)).join(memory, "series_id", "left_semi").select("series_id"))
            ids = ids.distinct()
        return series, ids, ranges.few_ids(ids)

    # -- ingest ----------------------------------------------------------------------------------------

    def append(self, labels: Iterable[tuple[str, str]], samples: Iterable[tuple[int, float]]) -> int:
        """Buffers samples of one series; its number, or 0 (and no series) without samples."""
        return self.append_many([(labels, samples)])[0]

    def append_many(self, entries: Iterable[tuple[Iterable[tuple[str, str]], Iterable[tuple[int, float]]]]) -> list[int]:
        """``append`` for many series at the cost of one lookup, which no query waits for."""
        own = [(*key_of(labels), [(int(t), float(v)) for t, v in samples]) for labels, samples in entries]
        labels_of = {k: labels for k, labels, samples in own if samples}
        while True:
            with self._lock:
                seen, unknown = self._commit["version"], [k for k in labels_of if k not in self._ids and k not in self._fresh]
                look = self.series() if unknown and (self._commit["series"] or self._fresh_frames) else None
                frames = len(self._fresh_frames)
            found = {r["canonical_key"]: r["series_id"] for r in registry.with_keys(look, unknown).collect()} if look is not None else {}
            with self._lock:
                if unknown and (seen != self._commit["version"] or frames != len(self._fresh_frames)):
                    continue  # a flush or an ingest came between: what was unknown may have a number now
                if len(self._ids) + len(found) > REMEMBERED:
                    self._ids = {}
                self._ids.update(found)
                ids = {k: found.get(k) or self._ids.get(k) or (self._fresh[k][0] if k in self._fresh else None) for k in labels_of}
                if any(ids[k] is None and k not in unknown for k in ids):
                    continue  # forgotten just now
                for k in [k for k in ids if ids[k] is None]:
                    self._counter += 1
                    ids[k] = self._ids[k] = self._counter
                    self._fresh[k] = (self._counter, labels_of[k])
                for k, _, samples in own:
                    self._points.extend((ids[k], t, v) for t, v in samples)
                return [ids[k] if samples else 0 for k, _, samples in own]

    def ingest(self, samples: DataFrame) -> None:
        """Buffers a DataFrame (labels, ts_ms, value) of any size: identities are resolved in Spark, and the
        samples wait in a staged table, not on the driver. A missing time or value is 0."""
        with self._lock:
            self._frames.append(self._staged(samples))

    def _staged(self, samples: DataFrame) -> tuple[str, DataFrame]:
        """Numbers new identities, which wait for the next commit, and writes the samples: their folder and rows."""
        rows = samples.select("labels", F.coalesce("ts_ms", F.lit(0)).cast("bigint").alias("ts_ms"), F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))
        with self._lock:
            name = uuid.uuid4().hex
            # written in between: else Spark looks every sample up instead of every key, and numbering does it all three times
            found = self._kept(registry.keys(rows), f"staged/{name}-keys")
            unknown = self._kept(registry.unknown(found, self.series(), self._counter), f"staged/{name}-new")
            new = registry.number(unknown, self._counter).select("series_id", "canonical_key", "labels")
            new.write.parquet(self.files.full(f"series/0-{name}"))
            new = self.spark.read.schema(SERIES).parquet(self.files.full(f"series/0-{name}"))
            for kind in ("keys", "new"):
                self.files.delete(f"staged/{name}-{kind}")
            last = registry.max_id(new)
            if last:
                self._counter = last
                self._fresh_frames.append((f"series/0-{name}", new))
            else:
                self.files.delete(f"series/0-{name}")
            registry.with_ids(rows, self.series(), self._counter).write.parquet(self.files.full(f"staged/{name}"))
            return f"staged/{name}", self.spark.read.schema(POINTS).parquet(self.files.full(f"staged/{name}"))

    def _kept(self, keys: DataFrame, path: str) -> DataFrame:
        keys.select("canonical_key", "labels").write.parquet(self.files.full(path))
        return self.spark.read.schema(KEYS).parquet(self.files.full(path))

    # -- flush -----------------------------------------------------------------------------------------

    def _buffered(self, points: list, frames: list) -> DataFrame | None:
        out = self.spark.createDataFrame(points, POINTS) if points else None
        for _, frame in frames:
            out = frame if out is None else out.unionByName(frame)
        return out

    def flush(self) -> bool:
        """Writes the buffer as one small part per day, all days in one commit, then merges days that have enough.

        On any failure everything is back in the buffer. False if there was nothing to write.
        """
        with self._writing:
            with self._lock:
                points, frames = self._points, self._frames
                rows = self._buffered(points, frames)
                if rows is None:
                    return False
                self._points, self._frames = [], []
            try:
                days = self._commit_rows(rows, [path for path, _ in frames])
            except BaseException:
                with self._lock:
                    self._points, self._frames = points + self._points, frames + self._frames
                raise
            self.compact(days, self.config.merge_threshold)
            self.vacuum()
            return True

    def write_batch(self, samples: DataFrame, batch: tuple[str, int]) -> bool:
        """Writes samples past the buffer: their parts and the batch's number (of a stream) become visible in one commit.

        A batch that a commit has already is left out, and the answer is False. After a failure nothing of it is there, not in the
        buffer either, so it can be written again.
        """
        with self._writing:
            if self._commit["batches"].get(batch[0], -1) >= batch[1]:
                return False
            path, rows = self._staged(samples)
            days = self._commit_rows(rows, [path], batch)
            self.compact(days, self.config.merge_threshold)
            self.vacuum()
            return True

    def _commit_rows(self, rows: DataFrame, staged: list[str], batch: tuple[str, int] | None = None) -> list[str]:
        """Parts, index and identities of the rows, and the commit that names them; the days written to."""
        with self._lock:
            fresh, fresh_frames, commit, series, counter = dict(self._fresh), list(self._fresh_frames), self._commit, self.series(), self._counter
        name = uuid.uuid4().hex
        new_series = [path for path, _ in fresh_frames]
        if fresh:
            self.spark.createDataFrame([(i, k, list(own)) for k, (i, own) in fresh.items()], SERIES).write.parquet(self.files.full(f"series/0-{name}"))
            new_series.append(f"series/0-{name}")
        made = self._write(rows.withColumn("day", day_of(F.col("ts_ms"))), SMALL, commit)
        days = sorted({p.day for p in made})
        # a series is in a day's index if a part of that day has a block of it; of one part, blocks are distinct pairs
        pairs, known = (self._leaves("blocks", BLOCKS, own).select("day", "series_id") for own in ([p.blocks for p in made], [p["blocks"] for p in commit["parts"] if p["day"] in days]))
        self._write_index(registry.inverted(pairs.join(known.hint("merge"), ["day", "series_id"], "left_anti"), series, counter), name)
        indexed = [n.removeprefix("day=") for n in self.files.names(f"inverted/batch={name}") if n.startswith("day=")]

        def change(new: dict) -> None:
            new["parts"] += [vars(p) for p in made]
            new["next_part"].update({p.day: int(p.part_id) + 1 for p in made})
            new["series"] += new_series
            new["next_series"] = max(new["next_series"], counter + 1)
            new["inverted"] += [{"path": f"inverted/batch={name}", "days": indexed}] if indexed else []
            new["gone"] += [[path, time.time()] for path in staged]
            if batch:
                new["batches"][batch[0]] = batch[1]

        self._publish(change)
        with self._lock:
            self._fresh = {k: v for k, v in self._fresh.items() if k not in fresh}
            self._fresh_frames = [f for f in self._fresh_frames if f[0] not in new_series]
            if len(self._ids) > REMEMBERED:
                self._ids = {}
        self._merge_series()
        return days

    def _write_index(self, rows: DataFrame, name: str) -> None:
        """In order of label, so that a lookup reads few row groups."""
        rows.repartitionByRange("day", "name", "value", "series_id").sortWithinPartitions("day", "name", "value", "series_id").write.partitionBy("day").parquet(self.files.full(f"inverted/batch={name}"))

    def _merge_series(self) -> None:
        """Merges ``FOLDERS`` files of identities of a level into one of the next, so that few are read and each row is written seldom."""
        level = lambda path: int(path.split("/")[1].split("-")[0])
        for n in range(max(map(level, self._commit["series"]), default=-1) + 1):
            old = [p for p in self._commit["series"] if level(p) == n]
            if len(old) < FOLDERS:
                continue
            made = f"series/{n + 1}-{uuid.uuid4().hex}"
            self.spark.read.schema(SERIES).parquet(*[self.files.full(p) for p in old]).repartitionByRange("series_id").sortWithinPartitions("series_id").write.parquet(self.files.full(made))
            self._publish(lambda new: new.update(series=[p for p in new["series"] if p not in old] + [made], gone=new["gone"] + [[p, time.time()] for p in old]))  # noqa: B023

    def _write(self, rows: DataFrame, tier: str, commit: dict) -> list[Part]:
        """Files of one part per day, in order of series and time; parts are named but not yet live."""
        name = uuid.uuid4().hex
        data, blocks = f"data/{name}", f"blocks/batch={name}"
        rows = rows.repartitionByRange("day", "series_id", "ts_ms").sortWithinPartitions("day", "series_id", "ts_ms")
        rows.write.partitionBy("day").parquet(self.files.full(data))
        written = self.spark.read.schema("series_id bigint, ts_ms bigint, value double, day string").parquet(self.files.full(data))
        counts = ranges.block_counts(written, "day").repartitionByRange("day", "series_id")  # else every task has a file of every day
        counts.write.partitionBy("day").parquet(self.files.full(blocks))
        meta = ranges.part_meta(self.spark.read.schema(BLOCKS).parquet(self.files.full(blocks)), "day").collect()  # one row per day
        return [
            Part(r["day"], f"{commit['next_part'].get(r['day'], 1):06d}", f"{data}/day={r['day']}", f"{blocks}/day={r['day']}", tier, r["min_ts"], r["max_ts"], r["series_count"], r["samples_count"]) for r in sorted(meta, key=lambda r: r["day"])
        ]

    # -- merge, retention, vacuum ----------------------------------------------------------------------

    def candidates(self, days: list[str], least: int) -> dict[str, list[Part]]:
        """The small parts of those days that have ``least`` of them, one at least."""
        small: dict[str, list[Part]] = {}
        for p in self.parts():
            if p.tier == SMALL and p.day in days:
                small.setdefault(p.day, []).append(p)
        return {day: own for day, own in small.items() if len(own) >= max(1, least)}

    def compact(self, days: list[str], least: int) -> list[Part]:
        """Merges all small parts of those days that have ``least`` of them into one big part; duplicates stay."""
        with self._writing:
            old = [p for own in self.candidates(days, least).values() for p in own]
            if not old:
                return []
            rows = self.spark.read.schema(POINTS).parquet(*[self.files.full(p.path) for p in old]).withColumn("day", day_of(F.col("ts_ms")))
            made = self._write(rows, BIG, self._commit)
            gone = {p.path for p in old}
            index = self._merged_index({p.day for p in old})

            def change(new: dict) -> None:
                new["parts"] = [p for p in new["parts"] if p["path"] not in gone] + [vars(p) for p in made]
                new["next_part"].update({p.day: int(p.part_id) + 1 for p in made})
                new["gone"] += [[path, time.time()] for p in old for path in (p.path, p.blocks)]
                if index:
                    new["gone"] += [[f"{p['path']}/day={d}", time.time()] for p in new["inverted"] for d in p["days"] if d in index["days"]]
                    new["inverted"] = [{"path": p["path"], "days": left} for p in new["inverted"] if (left := [d for d in p["days"] if d not in index["days"]])] + [index]

            self._publish(change)
            return made

    def _merged_index(self, days: set[str]) -> dict | None:
        """One file for each of the days whose index has grown to ``FOLDERS`` of them."""
        count = Counter(d for p in self._commit["inverted"] for d in p["days"] if d in days)
        if not (many := sorted(d for d, n in count.items() if n >= FOLDERS)):
            return None
        name = uuid.uuid4().hex
        self._write_index(self.inverted(set(many).__contains__), name)
        return {"path": f"inverted/batch={name}", "days": many}

    def force_merge(self) -> list[Part]:
        """Merges every day that has two small parts or more."""
        return self.compact(self.days(), 2)

    def apply_retention(self, days: int, now_ms: int) -> list[str]:
        """Drops days before the day of ``now - days``, with their index (orphaned index days too); identities stay."""
        if days <= 0:
            return []
        cutoff = utc_day(now_ms - days * DAY_MS)
        with self._writing:
            indexed = {d for p in self._commit["inverted"] for d in p["days"]}
            drop = sorted(d for d in {*self.days(), *indexed} if d < cutoff)
            if drop:

                def change(new: dict) -> None:
                    new["gone"] += [[path, time.time()] for p in new["parts"] if p["day"] in drop for path in (p["path"], p["blocks"])]
                    new["gone"] += [[f"{p['path']}/day={d}", time.time()] for p in new["inverted"] for d in p["days"] if d in drop]
                    new["parts"] = [p for p in new["parts"] if p["day"] not in drop]
                    new["inverted"] = [{"path": p["path"], "days": left} for p in new["inverted"] if (left := [d for d in p["days"] if d not in drop])]

                self._publish(change)
                self.vacuum()
            return drop

    def vacuum(self, grace_seconds: float | None = None) -> list[str]:
        """Deletes what has been gone for that long (by default the configured time), and old commits; every flush, merge and
        retention pass does so. With no grace, also what no commit names (after a crash)."""
        grace = self.config.grace_seconds if grace_seconds is None else grace_seconds
        with self._writing, self._lock:
            commit, now, out = self._commit, time.time(), []
            for path, at in commit["gone"]:
                if now - at >= grace:
                    self.files.delete(path)
                    parent = path.rsplit("/", 1)[0]
                    if parent.count("/") and not [n for n in self.files.names(parent) if not n.startswith(("_", "."))]:
                        self.files.delete(parent)
                    out.append(path)
            if grace <= 0:
                live = {p["path"].split("/")[1] for p in commit["parts"]} | {p["blocks"].split("/")[1] for p in commit["parts"]}
                live |= {p.split("/")[1] for p in commit["series"]} | {p["path"].split("/")[1] for p in commit["inverted"]}
                if not self._frames and not self._fresh_frames:
                    for folder in ("data", "blocks", "series", "inverted", "staged"):
                        for name in self.files.names(folder):
                            if name not in live:
                                self.files.delete(f"{folder}/{name}")
                                out.append(f"{folder}/{name}")
            if out:
                done = set(out)
                self._publish(lambda new: new.update(gone=[g for g in new["gone"] if g[0] not in done]))
                for name in self.files.names("commits"):
                    if name.split(".")[0].isdigit() and int(name.split(".")[0]) <= self.version - COMMITS:
                        self.files.delete(f"commits/{name}")
            return out

    # -- queries ---------------------------------------------------------------------------------------

    def _blocks(self, parts: list[Part]) -> DataFrame:
        """day, part_id, series_id, n, min_ts, max_ts of the parts' blocks."""
        names = self.spark.createDataFrame([(p.blocks.split("batch=")[1].split("/")[0], p.day, p.part_id) for p in parts], "batch string, day string, part_id string")
        rows = self._leaves("blocks", BLOCKS, [p.blocks for p in parts])
        return rows.join(F.broadcast(names), ["batch", "day"]).drop("batch")

    def _snapshot(self) -> tuple[list[Part], DataFrame | None]:
        with self._lock:
            return self.parts(), self._buffered(list(self._points), list(self._frames))

    def _scan(self, parts: list[Part], memory: DataFrame | None, start_ms: int, end_ms: int) -> DataFrame:
        """Samples in range of parts and memory; parts out of range are never opened."""
        live = self._in_range(parts, start_ms, end_ms)
        rows = self.spark.read.schema(POINTS).parquet(*[self.files.full(p.path) for p in live]) if live else self.spark.createDataFrame([], POINTS)
        if memory is not None:
            rows = rows.unionByName(memory)
        return ranges.in_range(rows, start_ms, end_ms)

    @staticmethod
    def _in_range(parts: list[Part], start_ms: int, end_ms: int) -> list[Part]:
        return [p for p in parts if utc_day(start_ms) <= p.day <= utc_day(end_ms) and p.max_ts >= start_ms and p.min_ts <= end_ms]

    def query_range(self, selector: str, start_ms: int, end_ms: int) -> DataFrame:
        """series_id, metric, labels, ts_ms, value in order; both ends are included, duplicates stay."""
        parts, memory = self._snapshot()
        wanted = self.match(parse(selector), lambda day: utc_day(start_ms) <= day <= utc_day(end_ms))
        return ranges.select(self._scan(parts, memory, start_ms, end_ms), wanted, start_ms, end_ms)

    def query_stats(self, selector: str, start_ms: int, end_ms: int) -> DataFrame:
        """parts_scanned, blocks_scanned, points_scanned (of parts, whole blocks), points_returned (with memory).

        Parts that days or times rule out are not scanned; no matching series, no scan.
        """
        parts, memory = self._snapshot()
        _, ids, few = self._found(parse(selector))
        live = self._in_range(parts, start_ms, end_ms)
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        blocks = self._leaves("blocks", BLOCKS, [p.blocks for p in live]).select("series_id", one.alias("b"), F.col("n").alias("p"), none.alias("r"))
        points = self._scan(parts, memory, start_ms, end_ms).select("series_id", none.alias("b"), none.alias("p"), one.alias("r"))
        rows = ranges.of_series(blocks.unionByName(points), ids, few)  # the series are looked up once for both
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        scanned = F.lit(0 if few == [] else len(live)).cast("bigint")
        return rows.agg(total("b").alias("blocks_scanned"), total("p").alias("points_scanned"), total("r").alias("points_returned")).select(scanned.alias("parts_scanned"), "blocks_scanned", "points_scanned", "points_returned")

    def samples(self, start_ms: int, end_ms: int) -> DataFrame:
        """series_id, labels, ts_ms, value of all samples in range, in no order."""
        parts, memory = self._snapshot()
        return self._scan(parts, memory, start_ms, end_ms).join(self.series().select("series_id", "labels"), "series_id")

    def blocks(self) -> DataFrame:
        """day, part_id, series_id, n, min_ts, max_ts of all live parts' blocks."""
        return self._blocks(self.parts())

    def query_json(self, selector: str, start_ms: int, end_ms: int) -> str:
        return ranges.response(self.query_range(selector, start_ms, end_ms))

    def parts_meta(self) -> DataFrame:
        schema = "day string, part_id string, tier string, min_ts bigint, max_ts bigint, series_count bigint, samples_count bigint"
        return self.spark.createDataFrame([(p.day, p.part_id, p.tier, p.min_ts, p.max_ts, p.series_count, p.samples_count) for p in self.parts()], schema)

    # -- inspection ------------------------------------------------------------------------------------

    def inspect_part(self, day: str, part_id: str, series: int | None = None, samples: bool = False, limit: int = 20) -> DataFrame:
        """A part's series with their first and last samples, or their first ``limit`` samples (0: all). Reads only."""
        part = next((p for p in self.parts() if (p.day, p.part_id) == (day, part_id)), None)
        if part is None:
            raise KeyError(f"no part {day}/{part_id}")
        rows = self.spark.read.schema(POINTS).parquet(self.files.full(part.path))
        if series:
            rows = rows.filter(F.col("series_id") == series)
        names = self._committed_series().select("series_id", shown(F.col("labels")).alias("name"))
        out = ranges.first_samples(rows, limit) if samples else ranges.summary(rows)
        return out.join(names, "series_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("SeriesID "), F.col("series_id").cast("string"))))

    def inspect_lines(self, day: str, part_id: str, series: int | None = None, samples: bool = False, limit: int = 20) -> Iterator[str]:
        """The same as lines for a terminal, read bit by bit."""
        from ..functions.text import shortest

        part = next((p for p in self.parts() if (p.day, p.part_id) == (day, part_id)), None)
        if part is None:
            raise KeyError(f"no part {day}/{part_id}")
        span = self.spark.range(1).select(iso_seconds(F.lit(part.min_ts)), iso_seconds(F.lit(part.max_ts))).first()
        yield f"part: {self.files.full(part.path)}"
        yield f"tier: {part.tier}  encoding: parquet"
        yield f"time range: {span[0]} .. {span[1]}"
        yield f"series: {part.series_count}  samples: {part.samples_count}"
        if not samples:
            heads = self.inspect_part(day, part_id, series).withColumns({"f": iso_seconds(F.col("first_ts")), "l": iso_seconds(F.col("last_ts"))}).orderBy("series_id")
            for r in heads.toLocalIterator():
                yield from ("", f"{r['name']}  ({r['n']} samples)", f"  first: {r['f']} = {shortest(r['first_value'])}", f"  last:  {r['l']} = {shortest(r['last_value'])}")
            return
        rows = self.inspect_part(day, part_id, series, True, limit).withColumn("t", iso_seconds(F.col("ts_ms"))).orderBy("series_id", "at")
        for _, own in groupby(rows.toLocalIterator(), lambda r: r["series_id"]):
            shown_ = 0
            for r in own:
                if not shown_:
                    yield from ("", f"{r['name']}  ({r['n']} samples)")
                yield f"  {r['t']}  {shortest(r['value'])}"
                shown_, more = shown_ + 1, r["more"]
            if more:
                yield f"  ... ({more} more)"

    def inspect_text(self, day: str, part_id: str, series: int | None = None, samples: bool = False, limit: int = 20) -> str:
        return "\n".join(self.inspect_lines(day, part_id, series, samples, limit)) + "\n"

    # -- background ------------------------------------------------------------------------------------

    def _every(self, seconds: float, work: Callable[[], object], at_once: bool = False) -> threading.Event:
        stop = threading.Event()

        def loop() -> None:
            wait = 0 if at_once else seconds
            while not stop.wait(wait):
                wait = seconds
                try:
                    work()
                except Exception as error:  # the next turn tries again; nothing was lost
                    print(f"background work failed: {error}")

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()
        self._stops.append(stop)
        self._threads.append(thread)
        return stop

    def start_flushing(self, seconds: float | None = None) -> threading.Event:
        return self._every(seconds or self.config.flush_seconds, self.flush)

    def start_retention(self, now_ms: Callable[[], int] = lambda: int(time.time() * 1000)) -> threading.Event:
        """Once now, then at intervals."""
        return self._every(self.config.retention_seconds, lambda: self.apply_retention(self.config.retention_days, now_ms()), at_once=True)

    def close(self) -> None:
        """Stops background work and flushes what is buffered."""
        for stop in self._stops:
            stop.set()
        for thread in self._threads:
            thread.join()
        self.flush()
