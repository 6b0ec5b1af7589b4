import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators.selector import parse
from tidemark.plans.database import Config, Database
from tidemark.sources import http, json_import, remote_write

DAY = 86_400_000
NOW = 1_790_000_000_000 // DAY * DAY + DAY // 2


def labels(metric, job):
    return [("job", job), ("__name__", metric)]


def values(db, selector, start=0, end=1 << 43):
    return [(r["ts_ms"], r["value"]) for r in db.query_range(selector, start, end).collect()]


def stats(db, selector, start, end):
    return tuple(db.query_stats(selector, start, end).first())


def test_life_of_a_database(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    assert (db.append(labels("m", "api"), [(3000, 3.0), (1000, 1.0)]), db.append(labels("m", "web"), [(1000, 9.0)]), db.append(labels("none", "x"), [])) == (1, 2, 0)
    assert values(db, 'm{job="api"}', 1000, 3000) == [(1000, 1.0), (3000, 3.0)]
    assert values(db, 'm{job=""}') == [] and values(db, 'm{job="api"}', 1001, 2999) == []
    assert stats(db, "m", 0, 10_000) == (0, 0, 0, 3)
    db.flush()
    assert not db.flush()
    db.append(labels("m", "api"), [(1000, 1.0), (500_000, 5.0)])
    assert values(db, 'm{job="api"}') == [(1000, 1.0), (1000, 1.0), (3000, 3.0), (500_000, 5.0)]
    assert stats(db, 'm{job="api"}', 0, 2000) == (1, 1, 2, 2)
    assert stats(db, "m", 400_000, 600_000) == (0, 0, 0, 1)
    assert stats(db, "other", 0, 10_000) == (0, 0, 0, 0)
    db.flush()
    db.append(labels("m", "web"), [(2000, 2.0)])
    db.flush()  # the third small part: they become one big part
    assert [(p.part_id, p.tier, p.samples_count) for p in db.parts()] == [("000004", "big", 6)]
    assert db.force_merge() == []
    again = Database(spark, str(tmp_path))
    assert values(again, 'm{job="api"}') == [(1000, 1.0), (1000, 1.0), (3000, 3.0), (500_000, 5.0)]
    assert again.append(labels("m", "web"), [(1, 1.0)]) == 2 and again.append(labels("new", "x"), [(1, 1.0)]) == 3
    assert again.inverted().filter("name = 'job' and value = 'web'").count() == 1
    assert "m{job=\"api\"}  (4 samples)" in again.inspect_text("19700101", "000004")
    text = again.inspect_text("19700101", "000004", 1, True, 2)
    assert "web" not in text and "... (2 more)" in text
    old = again.query_range("m", 0, 10_000)
    assert again.vacuum() == [] and old.count() == 6
    assert len(again.vacuum(0)) > 0 and again.vacuum(0) == []
    assert values(again, 'm{job="web"}') == [(1, 1.0), (1000, 9.0), (2000, 2.0)]


def test_days_retention_and_merge(spark, tmp_path):
    db = Database(spark, str(tmp_path), Config(merge_threshold=100))
    for ago in (10, 8, 7, 0):
        db.append(labels("m", "api"), [(NOW - ago * DAY, float(ago))])
    db.append(labels("old", "api"), [(NOW - 10 * DAY, 1.0)])
    db.flush()
    assert len(db.days()) == 4
    assert db.match(parse("old")).count() == 1
    assert db.apply_retention(0, NOW) == [] and len(db.apply_retention(7, NOW)) == 2
    assert [v for _, v in values(db, "m")] == [7.0, 0.0]
    assert db.match(parse("old")).count() == 0 and db.series().count() == 2
    db.append(labels("m", "api"), [(NOW, 5.0)])
    db.flush()
    assert [p.tier for p in db.force_merge()] == ["big"] and sorted(v for _, v in values(db, "m")) == [0.0, 5.0, 7.0]


def test_failed_flush_keeps_everything(spark, tmp_path, monkeypatch):
    db = Database(spark, str(tmp_path))
    db.append(labels("m", "a"), [(0, 1.0), (DAY, 2.0)])
    monkeypatch.setattr(db, "_publish", lambda change: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        db.flush()
    assert db.parts() == [] and values(db, "m") == [(0, 1.0), (DAY, 2.0)]
    monkeypatch.undo()
    db.flush()
    assert len(db.days()) == 2 and values(db, "m") == [(0, 1.0), (DAY, 2.0)]


def test_second_writer_is_refused(spark, tmp_path):
    one, two = Database(spark, str(tmp_path)), Database(spark, str(tmp_path))
    for db in (one, two):
        db.append(labels("m", "a"), [(0, 1.0)])
    one.flush()
    with pytest.raises(RuntimeError):
        two.flush()


def test_bulk_ingest(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    schema = "labels array<struct<name:string,value:string>>, ts_ms bigint, value double"
    first = spark.createDataFrame([([("__name__", "m"), ("k", str(i % 5))], i, float(i)) for i in range(50)], schema)
    db.ingest(first)
    assert db.append([("k", "2"), ("__name__", "m")], [(99, 1.0)]) == 3
    assert db.append([("__name__", "n")], [(99, 1.0)]) == 6
    assert len(values(db, "m")) == 51
    db.flush()
    db.ingest(spark.createDataFrame([([("k", "7"), ("__name__", "m")], None, None)], schema))
    db.flush()
    again = Database(spark, str(tmp_path))
    assert again.series().count() == 7 and len(values(again, "m")) == 52
    assert again.append([("k", "7"), ("__name__", "m")], [(1, 1.0)]) == 7


def test_http(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    ask = lambda method, target, body=b"": http.respond(db, method, target, body)
    assert ask("GET", "/healthz")[2] == b"OK" and ask("GET", "/nothing")[0] == 404
    one = b'{"metric":"m","labels":{"a":"b"},"samples":[{"t":1000,"v":2},{"v":0.5},{"t":2000}]}'
    assert json.loads(ask("POST", "/api/v1/import", one)[2]) == {"ingested": 3}
    assert ask("GET", "/api/v1/import")[0] == 405
    for bad in (b"", b"{", b'{"metric":"x","samples":[{"t":1.5}]}', b'{"metric":1}', b'[{"metric":"kept","samples":[{"t":1,"v":1}]},{"samples":[]}]'):
        assert ask("POST", "/api/v1/import", bad)[0] == 400
    assert len(values(db, "kept")) == 1  # what came before the fault stays
    status, headers, body = ask("GET", "/api/v1/query_range?query=m&start=0&end=2")
    assert status == 200 and headers["X-Tidemark-Points-Returned"] == "3"
    assert json.loads(body)["data"]["result"] == [{"metric": {"__name__": "m", "a": "b"}, "values": [[0.0, "0.5"], [1.0, "2"], [2.0, "0"]]}]
    assert json.loads(ask("GET", "/api/v1/query_range?query=zzz&start=0&end=2")[2])["data"]["result"] == []
    for bad in ("query=&start=0&end=1", "query=m&start=abc&end=1", "query=m&start=10&end=0", "query=m%7Ba%3Db%7D&start=0&end=1", "query=m&end=1"):
        assert ask("GET", f"/api/v1/query_range?{bad}")[0] == 400
    sent = remote_write.encode([(labels("rw", "a"), [(5, 1.5), (-7, 2.5)]), ([("job", "x")], [(1, 1.0)]), (labels("rw", "b"), [])])
    status, headers, _ = ask("POST", "/api/v1/write", sent)
    assert (status, headers["X-Tidemark-Points-Ingested"]) == (204, "2")
    assert ask("POST", "/api/v1/write", b"no snappy")[0] == 400 and ask("GET", "/api/v1/write")[0] == 405
    import pyarrow as pa

    assert ask("POST", "/api/v1/write", pa.Codec("snappy").compress(b"no protobuf", asbytes=True))[0] == 400
    assert ask("POST", "/internal/force_flush")[0] == 204 and ask("POST", "/internal/force_merge")[0] == 204 and ask("GET", "/internal/force_merge")[0] == 405
    assert values(db, "rw", -10, 10) == [(-7, 2.5), (5, 1.5)]


def test_json_files(spark):
    lines = ['{"metric":"m","labels":{"a":"b"},"samples":[{"t":1,"v":2.0}]}', '[{"metric":"n","samples":[{}]},{"metric":"","samples":[{"t":1,"v":1}]}]']
    got = json_import.parse_json(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r["labels"][0]["value"], r["ts_ms"], r["value"]) for r in got) == [("m", 1, 2.0), ("n", 0, 0.0)]


def test_stream(spark, tmp_path):
    from tidemark.streaming.flush import start

    schema = "labels array<struct<name:string,value:string>>, ts_ms bigint, value double"
    db = Database(spark, str(tmp_path / "db"))
    for k in range(2):
        spark.createDataFrame([([("__name__", "m")], k, float(k))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(db, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "s", str(tmp_path / "ck"), once=True).awaitTermination()
    assert values(db, "m") == [(0, 0.0), (1, 1.0)]
    db.append([("__name__", "m")], [(5, 5.0)])
    again = spark.createDataFrame([([("__name__", "m")], 1, 1.0)], schema)
    assert not db.write_batch(again, ("s", 1)) and len(values(db, "m")) == 3  # a batch that is in already


def test_a_stream_batch_is_in_once_whatever_fails(spark, tmp_path, monkeypatch):
    schema = "labels array<struct<name:string,value:string>>, ts_ms bigint, value double"
    batch = spark.createDataFrame([([("__name__", "m")], k, float(k)) for k in range(5)], schema)
    db = Database(spark, str(tmp_path))
    monkeypatch.setattr(db, "_publish", lambda change: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        db.write_batch(batch, ("s", 0))
    monkeypatch.undo()
    assert values(db, "m") == [] and not db.flush()  # nothing is left in the buffer, so a flush in between adds nothing
    assert db.write_batch(batch, ("s", 0)) and len(values(db, "m")) == 5
    db.append(labels("m", "x"), [(9, 9.0)])
    staged = db._staged

    def flushed_between(samples):
        out = staged(samples)
        db.flush()
        return out

    monkeypatch.setattr(db, "_staged", flushed_between)
    assert db.write_batch(batch, ("s", 1)) and len(values(db, "m")) == 11
    monkeypatch.undo()
    again = Database(spark, str(tmp_path))  # a restart repeats the last batch
    assert not again.write_batch(batch, ("s", 1)) and len(values(again, "m")) == 11
    assert again.write_batch(batch.limit(0), ("s", 2)) and not again.write_batch(batch, ("s", 2))


def test_replaced_files_and_index_go(spark, tmp_path):
    from tidemark.plans import database

    db = Database(spark, str(tmp_path), Config(merge_threshold=2, grace_seconds=0))
    for k in range(2):
        db.append(labels("m", "a"), [(k, 1.0), (DAY, 1.0)])
        db.flush()
    assert [p.tier for p in db.parts()] == ["big", "big"]
    assert len(db.files.names("blocks")) == len(db.files.names("data")) == 1 and db.files.names("staged") == []
    assert len(db.apply_retention(1, 2 * DAY)) == 1 and sum("day=19700101" in n for b in db.files.names("inverted") for n in db.files.names(f"inverted/{b}")) == 0
    assert values(db, "m") == [(DAY, 1.0)] * 2
    old, database.FOLDERS = database.FOLDERS, 2
    try:
        for k in range(4):
            db.append(labels("m", f"new{k}"), [(DAY, 2.0)])
            db.flush()
    finally:
        database.FOLDERS = old
    assert len(db._commit["series"]) <= 3 and db.series().count() == 5 and len(values(db, "m")) == 6
    assert values(Database(spark, str(tmp_path)), 'm{job="new2"}') == [(DAY, 2.0)]


def test_queries_read_the_index_and_prune(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.append_many([(labels("m", f"j{k}"), [(d * DAY, 1.0) for d in range(3)]) for k in range(20)])
    db.flush()
    days_of = lambda frame: {f.split("day=")[1].split("/")[0] for f in frame.inputFiles() if "day=" in f}
    index = db.inverted(lambda day: day == "19700102").filter("name = 'job' and value = 'j3'")
    assert "EqualTo(name,job)" in index._jdf.queryExecution().executedPlan().toString() and days_of(index) == {"19700102"}
    rows = db.query_range('m{job="j3"}', DAY, DAY + 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert days_of(rows) == {"19700102"} and "GreaterThanOrEqual(ts_ms" in plan
    assert re.search(r"series_id#\d+L = 4\)", plan)  # the number reaches the scan
    assert "SinglePartition" not in db.match(parse("m"))._jdf.queryExecution().executedPlan().toString()


def test_numbering_is_dense_and_dealt_out(spark):
    from tidemark.operators import registry

    found = spark.range(3000).select(F.format_string("k%05d", "id").alias("canonical_key"), F.array().cast("array<struct<name:string,value:string>>").alias("labels"))
    known = found.limit(0)
    got = registry.resolve_new(found, known, 7)
    assert [(r[0], r[1]) for r in got.orderBy("series_id").collect()] == [(8 + i, f"k{i:05d}") for i in range(3000)]
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_one_commit_has_one_writer(spark, tmp_path):
    import threading

    from tidemark.sources.files import Files

    files, won = Files(spark, str(tmp_path)), []
    threads = [threading.Thread(target=lambda k=k: won.append((files.create("commits/1.json", str(k)), k))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [files.read("commits/1.json")] == [str(k) for ok, k in won if ok] and files.names("commits") == ["1.json"]


def test_background_work_and_replies_survive_failures(spark, tmp_path, monkeypatch):
    db = Database(spark, str(tmp_path), Config(retention_seconds=0.02, retention_days=1))
    turns = []

    def fails_once(days, now):
        turns.append(now)
        if len(turns) == 1:
            raise OSError("disk")

    monkeypatch.setattr(db, "apply_retention", fails_once)
    stop = db.start_retention(lambda: NOW)
    while len(turns) < 3:
        stop.wait(0.01)
    stop.set()
    for name in ("flush", "force_merge", "query_stats"):
        monkeypatch.setattr(db, name, lambda *a: (_ for _ in ()).throw(OSError("disk")))
    for method, target in (("POST", "/internal/force_flush"), ("POST", "/internal/force_merge"), ("GET", "/api/v1/query_range?query=m&start=0&end=1")):
        assert http.respond(db, method, target, b"")[0] == 500


def test_inspect_command(spark, tmp_path):
    import io

    from tidemark.sources import inspect

    db = Database(spark, str(tmp_path))
    db.append_many([(labels("m", f"j{k}"), [(1000 * t, t / 2) for t in range(30)]) for k in range(2)])
    db.flush()
    run = lambda *args: (out := io.StringIO(), inspect.main([*args, "--data", str(tmp_path)], out, spark))
    out, code = run("19700101/000001")
    assert code == 0 and out.getvalue().count("(30 samples)") == 2 and "  last:  1970-01-01T00:00:29Z = 14.5" in out.getvalue()
    out, code = run("19700101/000001", "--samples", "--series", "2")
    assert code == 0 and out.getvalue().count(" = ") == 0 and "... (10 more)" in out.getvalue() and out.getvalue().count("1970-01-01T00:00:") == 22
    assert "more)" not in run("19700101/000001", "--samples", "--limit", "0")[0].getvalue()
    assert run("19700101/000009")[1] == 1 and run("x")[1] == 2 and run("19700101/000001", "--nothing")[1] == 2


def test_a_flush_makes_few_files_and_reads_samples_twice(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            count.add(len(batch))
            yield batch

    schema = "labels array<struct<name:string,value:string>>, ts_ms bigint, value double"
    rows = spark.createDataFrame([([("__name__", "m"), ("k", str(i % 40))], i * DAY // 40, float(i)) for i in range(400)], schema)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        db = Database(spark, str(tmp_path))
        db.ingest(rows.mapInPandas(counted, schema))
        assert count.value <= 800 and db.files.names("staged") == [db._frames[0][0].split("/")[1]]  # for keys and for samples
        db.flush()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [f for f in db.blocks().inputFiles() if "day=" in f]
    assert len(db.days()) == 10 and len(files) <= 10 + 16  # days and ranges, not days times tasks
    assert len(values(db, 'm{k="3"}')) == 10 and db.inverted().count() == 10 * 40 * 2


def test_many_identities_are_not_broadcast(spark):
    from tidemark.operators import registry

    series = spark.createDataFrame([(1, "a", [("__name__", "m")])], "series_id bigint, canonical_key string, labels array<struct<name:string,value:string>>")
    samples = spark.createDataFrame([([("__name__", "m")], 1, 1.0)], "labels array<struct<name:string,value:string>>, ts_ms bigint, value double")
    plans = [registry.with_ids(samples, series, n)._jdf.queryExecution().executedPlan().toString() for n in (1, 1_000_000)]
    assert "BroadcastHashJoin" in plans[0] and "Broadcast" not in plans[1]


def test_stats_look_many_series_up_once(spark, tmp_path, monkeypatch):
    from tidemark.operators import ranges

    db = Database(spark, str(tmp_path))
    db.append_many([(labels("m", f"j{k}"), [(d * DAY, 1.0) for d in range(3)]) for k in range(5)])
    db.flush()
    db.append(labels("m", "j0"), [(DAY, 1.0)])
    monkeypatch.setattr(ranges, "PUSHED_IDS", 2)
    found = db.query_stats("m", DAY, DAY + 5)
    assert tuple(found.first()) == (1, 5, 5, 6) and stats(db, "none", 0, DAY) == (0, 0, 0, 0)
    assert found._jdf.queryExecution().executedPlan().toString().count("EqualTo(name,__name__)") <= 3  # once for each of blocks, parts and buffer, and equal exchanges are reused
