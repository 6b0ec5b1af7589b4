"""Part folders: ``meta.json``, ``series.index``, ``timestamps.bin`` and ``values.bin``, in either encoding.

The index gives, for each series number, the count of samples and where its blocks lie: in bytes of either file, or, raw,
in samples of both.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec

#: The files of a part.
META, INDEX, TIMES, VALUES = "meta.json", "series.index", "timestamps.bin", "values.bin"


def decode(meta: bytes, index: bytes, times: bytes, values: bytes) -> Iterator[tuple[int, list[tuple[int, float]]]]:
    """Samples of each series of a part, in order of number. Raises ValueError or EOFError on damage."""
    encoding = json.loads(meta).get("encoding") or "raw"
    for number, entry in sorted((int(k), v) for k, v in json.loads(index).items()):
        n = entry.get("count", 0)
        if encoding == "raw":
            a = 8 * entry.get("offset", 0)
            t, v = times[a : a + 8 * n], values[a : a + 8 * n]
        else:
            a, b = entry.get("tsOffset", 0), entry.get("valOffset", 0)
            t, v = times[a : a + entry.get("tsLength", 0)], values[b : b + entry.get("valLength", 0)]
        yield number, codec.decode_block(t, v, encoding, n)


def encode(series: dict[int, list[tuple[int, float]]], tier: str = "small", encoding: str = "gorilla") -> dict[str, bytes]:
    """The files of a part, by name."""
    times, values, index, every = bytearray(), bytearray(), {}, [t for own in series.values() for t, _ in own]
    for number in sorted(series):
        own = sorted(series[number], key=lambda s: s[0])
        ts, vs = [t for t, _ in own], [v for _, v in own]
        if encoding == "raw":
            index[str(number)] = {"offset": len(times) // 8, "count": len(own)}
            blocks = codec.encode_raw(ts, "i8"), codec.encode_raw(vs, "f8")
        else:
            blocks = codec.encode_timestamps(ts), codec.encode_values(vs)
            index[str(number)] = {"count": len(own), "tsOffset": len(times), "tsLength": len(blocks[0]), "valOffset": len(values), "valLength": len(blocks[1])}
        times += blocks[0]
        values += blocks[1]
    meta = {"minTime": min(every, default=0), "maxTime": max(every, default=0), "seriesCount": len(series), "samplesCount": len(every), "tier": tier, "encoding": encoding}
    return {META: json.dumps(meta).encode(), INDEX: json.dumps(index).encode(), TIMES: bytes(times), VALUES: bytes(values)}


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, series_id, ts_ms, value of all part folders below ``path``; a folder without one of the files is left out.

    A part's files meet in one task, as a part is made to be read by one process.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/[^/]*$", "")
    own = files.filter(name.isin(META, INDEX, TIMES, VALUES)).groupBy(folder.alias("part"))
    rows = own.agg(*[F.first(F.when(name == n, F.col("content")), ignorenulls=True).alias(c) for n, c in ((META, "meta"), (INDEX, "series"), (TIMES, "times"), (VALUES, "data"))])

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, meta, index, times, data in batch.itertuples(index=False):
                for number, found in decode(meta, index, times, data):
                    yield pd.DataFrame({"part": part, "series_id": number, "ts_ms": [t for t, _ in found], "value": [v for _, v in found]})

    whole = rows.dropna().select("part", "meta", "series", "times", "data")
    return whole.mapInPandas(samples, "part string, series_id bigint, ts_ms bigint, value double")


def write(path: str, files: dict[str, bytes]) -> None:
    """Writes a part folder on the driver (for tests and small exports)."""
    os.makedirs(path, exist_ok=True)
    for name, data in files.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(data)
