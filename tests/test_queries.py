import pytest

from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

from .compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, name):
    same(spark, SF, QUERIES[name], ORACLE_SQL[name])


def test_matrix(spark):
    import json

    rows = QUERIES["matrix_response"](spark, SF).collect()
    assert rows and all(json.loads(r["entry"])["metric"]["__name__"] == "event_click" for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["series_id", "metric", "user", "ts_ms", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_query_is_pruned_before_its_join(spark):
    plan = QUERIES["query_range_metric"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan  # what reaches scans is tested with the database


def test_bodies_hold_bounded_rows(spark):
    from tidemark.sources import remote_write

    plan = QUERIES["remote_write_ingest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SinglePartition" not in plan  # a body is made of a batch of rows
    sent = b"".join(remote_write._message(1, remote_write._message(1, remote_write._message(1, b"__name__"))) for _ in range(2))
    assert next(remote_write.each(sent + b"\x07")) == ([("__name__", "")], [])  # read before what is damaged behind it


def test_series_are_renumbered_by_ranges(spark, monkeypatch):
    from tidemark.operators import registry

    monkeypatch.setattr(registry, "RANGES", 4)
    plan = QUERIES["database_round_trip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
