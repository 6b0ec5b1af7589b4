"""JSON import: ``{"metric": ..., "labels": {...}, "samples": [{"t": ms, "v": number}]}``, or an array of these."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import LABELS, NAME, sorted_labels
from ..plans.database import Database

#: Largest body of a request.
MOST_BYTES = 64 << 20

SCHEMA = "array<struct<metric:string,labels:map<string,string>,samples:array<struct<t:bigint,v:double>>>>"


class BadRequest(ValueError):
    """The body cannot be imported. ``ingested`` samples came before the fault and stay."""

    def __init__(self, message: str, ingested: int = 0):
        super().__init__(message)
        self.ingested = ingested


def _number(value: object, whole: bool) -> float:
    if value is None:
        return 0
    if isinstance(value, bool) or not isinstance(value, (int, float)) or whole and not isinstance(value, int):
        raise BadRequest(f"not a {'whole ' if whole else ''}number: {value!r}")
    if whole and not -(1 << 63) <= value < 1 << 63:
        raise BadRequest(f"out of range: {value}")
    return value


def _entry(item: object) -> tuple[str, list[tuple[str, str]], list[tuple[int, float]]]:
    if not isinstance(item, dict):
        raise BadRequest("entries must be objects")
    metric, labels, samples = item.get("metric") or "", item.get("labels") or {}, item.get("samples") or []
    if not isinstance(metric, str) or not isinstance(labels, dict) or not isinstance(samples, list) or not all(isinstance(v, str) for v in labels.values()) or not all(isinstance(s, dict) for s in samples):
        raise BadRequest("metric must be a string, labels an object of strings, samples an array of objects")
    return metric, [(NAME, metric), *labels.items()], [(int(_number(s.get("t"), True)), float(_number(s.get("v"), False))) for s in samples]


def import_json(db: Database, body: bytes | str) -> int:
    """Buffers a request's samples and returns their number.

    A body that is empty, too long or no JSON of the right shape is refused as a whole. An entry without a metric is
    refused as well, but what came before it is kept.
    """
    data = body.encode() if isinstance(body, str) else body
    if len(data) > MOST_BYTES:
        raise BadRequest("body is too long")
    if not data.strip():
        raise BadRequest("body is empty")
    try:
        parsed = json.loads(data)
    except (ValueError, RecursionError) as error:
        raise BadRequest(f"no JSON: {error}") from None
    entries = [_entry(x) for x in (parsed if isinstance(parsed, list) else [parsed])]
    good = next((k for k, (metric, _, _) in enumerate(entries) if not metric), len(entries))
    db.append_many((labels, samples) for _, labels, samples in entries[:good])
    count = sum(len(samples) for _, _, samples in entries[:good])
    if good < len(entries):
        raise BadRequest("metric is missing", count)
    return count


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of import bodies, one object or array per line, as (labels, ts_ms, value), for ``Database.ingest``.

    Entries without a metric are left out; missing times and values are 0.
    """
    return parse_json(spark.read.text(path))


def parse_json(lines: DataFrame) -> DataFrame:
    """The same of a column ``value`` with the bodies."""
    body = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    rows = lines.select(F.explode(F.from_json(body, SCHEMA)).alias("e")).select("e.*")
    rows = rows.filter(F.coalesce("metric", F.lit("")) != "")
    pairs = F.map_entries(F.coalesce("labels", F.create_map().cast("map<string,string>"))).cast(LABELS)
    own = sorted_labels(F.concat(F.array(F.struct(F.lit(NAME), F.col("metric"))).cast(LABELS), pairs))
    rows = rows.select(own.alias("labels"), F.explode("samples").alias("s"))
    return rows.select("labels", F.coalesce("s.t", F.lit(0)).cast("bigint").alias("ts_ms"), F.coalesce("s.v", F.lit(0.0)).alias("value"))
