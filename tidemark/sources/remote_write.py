"""Prometheus remote_write bodies: a snappy block that holds a protobuf WriteRequest.

Wire format: WriteRequest.timeseries = 1; TimeSeries.labels = 1, .samples = 2; Label.name = 1, .value = 2;
Sample.value = 1 (double), .timestamp = 2 (int64). All other fields (metadata, exemplars, histograms) are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import get_uvarint, put_uvarint
from ..functions.labels import NAME, sorted_labels
from ..plans.database import Database
from .json_import import MOST_BYTES, BadRequest

#: Samples that are handed to Spark in one go, about.
FRAME = 20_000

Series = tuple[list[tuple[str, str]], list[tuple[int, float]]]


def uncompress(data: bytes, most: int = MOST_BYTES * 8) -> bytes:
    """A raw snappy block."""
    try:
        size, _ = get_uvarint(data, 0)
        if size > most:
            raise BadRequest("body is too long")
        return pa.Codec("snappy").decompress(data, size, asbytes=True) if size else b""
    except (EOFError, OverflowError, OSError, pa.ArrowException) as error:
        raise BadRequest(f"no snappy block: {error}") from None


def _fields(data: memoryview) -> Iterator[tuple[int, int, object]]:
    """Number, wire type and content of each field."""
    at = 0
    while at < len(data):
        tag, at = get_uvarint(data, at)
        number, kind = tag >> 3, tag & 7
        if not number:
            raise ValueError("field number 0")
        if kind == 0:
            value, at = get_uvarint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = get_uvarint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(data):
            raise EOFError("message is cut off")
        yield number, kind, value


def _text(value: object) -> str:
    return bytes(value).decode("utf-8", "replace")


def _label(data: memoryview) -> tuple[str, str]:
    own = {n: _text(v) for n, kind, v in _fields(data) if kind == 2}
    return own.get(1, ""), own.get(2, "")


def _sample(data: memoryview) -> tuple[int, float]:
    value, ts = 0.0, 0
    for n, kind, v in _fields(data):
        if (n, kind) == (1, 1):
            value = struct.unpack("<d", v)[0]
        elif (n, kind) == (2, 0):
            ts = v - (1 << 64) if v >> 63 else v
    return ts, value


def each(data: bytes) -> Iterator[Series]:
    """Labels and samples of each series in a WriteRequest, one after the other."""
    try:
        for n, kind, series in _fields(memoryview(data)):
            if (n, kind) == (1, 2):
                own = [(m, v) for m, k, v in _fields(series) if k == 2]
                yield [_label(v) for m, v in own if m == 1], [_sample(v) for m, v in own if m == 2]
    except (EOFError, OverflowError, ValueError, struct.error) as error:
        raise BadRequest(f"no WriteRequest: {error}") from None


def decode(data: bytes) -> list[Series]:
    """All series in a WriteRequest."""
    return list(each(data))


def _message(number: int, data: bytes) -> bytes:
    out = bytearray()
    put_uvarint(out, number << 3 | 2)
    put_uvarint(out, len(data))
    return bytes(out) + data


def encode(series: list[Series]) -> bytes:
    """A body as senders make it (snappy block and all), for tests and for forwarding."""
    out = b""
    for labels, samples in series:
        own = b"".join(_message(1, _message(1, n.encode()) + _message(2, v.encode())) for n, v in labels)
        for ts, value in samples:
            stamp = bytearray(b"\x10")
            put_uvarint(stamp, ts & (1 << 64) - 1)
            own += _message(2, b"\x09" + struct.pack("<d", value) + bytes(stamp))
        out += _message(1, own)
    return pa.Codec("snappy").compress(out, asbytes=True)


def usable(series: list[Series]) -> list[Series]:
    """Series with a metric name (an empty one will do) and samples; others are skipped."""
    return [(labels, samples) for labels, samples in series if samples and any(n == NAME for n, _ in labels)]


def remote_write(db: Database, body: bytes) -> int:
    """Buffers a request's samples and returns their number."""
    if len(body) > MOST_BYTES:
        raise BadRequest("body is too long")
    own = usable(decode(uncompress(body)))
    db.append_many(own)
    return sum(len(samples) for _, samples in own)


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """(labels, ts_ms, value) of a binary column ``content``; one body a row, decoded on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for body in batch["content"]:
                for series in each(uncompress(bytes(body))):
                    for labels, samples in usable([series]):
                        shared = [{"name": n, "value": v} for n, v in labels]
                        for start in range(0, len(samples), FRAME):
                            rows += [(shared, ts, value) for ts, value in samples[start : start + FRAME]]
                            if len(rows) >= FRAME:
                                yield pd.DataFrame(rows, columns=["labels", "ts_ms", "value"])
                                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["labels", "ts_ms", "value"])

    rows = bodies.select("content").mapInPandas(read, "labels array<struct<name:string,value:string>>, ts_ms bigint, value double")
    return rows.withColumn("labels", sorted_labels(F.col("labels")))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one body."""
    return parse_bodies(spark.read.format("binaryFile").load(path))
