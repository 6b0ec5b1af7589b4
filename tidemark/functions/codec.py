"""Codecs for blocks of samples: delta-of-delta timestamps, XOR values, and raw cells.

Timestamps: the count as a varint, the first as 8 bytes (little-endian), the first difference and then the changes
of the difference as zigzag varints. Values: the count, the first one's bits as 8 bytes, then for every value the XOR
with the one before: bit 0 if they are equal; bits 10 and the significant bits if these fit the last window;
bits 11, five bits of leading zeros, six bits of length (0 for 64) and the significant bits otherwise.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1
#: Fixed value: leading zeros are written in five bits.
MOST_LEADING = 31


def put_uvarint(out: bytearray, n: int) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def get_uvarint(data: bytes, at: int) -> tuple[int, int]:
    """The number and where it ends."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise EOFError("varint is cut off")
        if shift > 63 or (shift == 63 and data[at] > 1):
            raise OverflowError("varint has over 64 bits")
        n |= (data[at] & 0x7F) << shift
        at += 1
        if data[at - 1] < 0x80:
            return n, at
        shift += 7


def zigzag(n: int) -> int:
    return (n << 1 ^ n >> 63) & MASK


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def _signed(n: int) -> int:
    n &= MASK
    return n - (1 << 64) if n >> 63 else n


def encode_timestamps(ts: list[int]) -> bytes:
    out = bytearray()
    put_uvarint(out, len(ts))
    if ts:
        out += struct.pack("<q", ts[0])
        previous = 0
        for a, b in zip(ts, ts[1:]):
            delta = _signed(b - a)
            put_uvarint(out, zigzag(_signed(delta - previous)))
            previous = delta
    return bytes(out)


def decode_timestamps(data: bytes) -> list[int]:
    count, at = get_uvarint(data, 0)
    if not count:
        return []
    if len(data) < at + 8:
        raise EOFError("first timestamp is cut off")
    out = [struct.unpack_from("<q", data, at)[0]]
    at, delta = at + 8, 0
    for _ in range(count - 1):
        n, at = get_uvarint(data, at)
        delta = _signed(delta + unzigzag(n))
        out.append(_signed(out[-1] + delta))
    return out


def encode_values(values: list[float]) -> bytes:
    out = bytearray()
    put_uvarint(out, len(values))
    if not values:
        return bytes(out)
    bits = np.asarray(values, np.float64).view(np.uint64).tolist()
    out += struct.pack("<Q", bits[0])
    stream, used = 0, 0  # all bits so far as one number

    def put(value: int, n: int) -> None:
        nonlocal stream, used
        stream, used = stream << n | value, used + n
        while used >= 8 * 64:  # keep the number short
            used -= 8 * 64
            out.extend((stream >> used).to_bytes(64, "big"))
            stream &= (1 << used) - 1

    lead = trail = 0
    for a, b in zip(bits, bits[1:]):
        x = a ^ b
        if not x:
            put(0, 1)
            continue
        zeros_before = min(64 - x.bit_length(), MOST_LEADING)
        zeros_after = (x & -x).bit_length() - 1
        if lead and zeros_before >= lead and zeros_after >= trail:
            put(0b10, 2)
            put(x >> trail, 64 - lead - trail)
        else:
            lead, trail = zeros_before, zeros_after
            size = 64 - lead - trail
            put(0b11, 2)
            put(lead, 5)
            put(size & 63, 6)
            put(x >> trail, size)
    pad = -used % 8
    return bytes(out) + (stream << pad).to_bytes((used + pad) // 8, "big")


def decode_values(data: bytes) -> list[float]:
    count, at = get_uvarint(data, 0)
    if not count:
        return []
    if len(data) < at + 8:
        raise EOFError("first value is cut off")
    bits = [struct.unpack_from("<Q", data, at)[0]]
    at = (at + 8) * 8
    end = len(data) * 8

    def take(n: int) -> int:
        nonlocal at
        if at + n > end:
            raise EOFError("values are cut off")
        first, last = at // 8, (at + n + 7) // 8
        out = int.from_bytes(data[first:last], "big") >> (last * 8 - at - n) & ((1 << n) - 1)
        at += n
        return out

    lead = trail = 0
    for _ in range(count - 1):
        if not take(1):
            bits.append(bits[-1])
            continue
        if take(1):
            lead, size = take(5), take(6) or 64
            trail = 64 - lead - size
            if trail < 0:
                raise ValueError("a window of over 64 bits")
        bits.append(bits[-1] ^ take(64 - lead - trail) << trail)
    return np.array(bits, np.uint64).view(np.float64).tolist()


def encode_raw(values: list, kind: str) -> bytes:
    """Cells of 8 bytes, little-endian; ``kind`` is ``i8`` or ``f8``."""
    return np.asarray(values, f"<{kind}").tobytes()


def decode_raw(data: bytes, kind: str, count: int | None = None) -> list:
    """Cells; with ``count``, an error unless there are so many."""
    if len(data) % 8 or count is not None and len(data) != 8 * count:
        raise EOFError(f"{len(data)} bytes for {count} cells")
    return np.frombuffer(data, f"<{kind}").tolist()


def decode_block(timestamps: bytes, values: bytes, encoding: str, count: int) -> list[tuple[int, float]]:
    """Samples of a block in either encoding (an empty name is raw); an error unless there are ``count``."""
    if encoding in ("", "raw"):
        ts, vs = decode_raw(timestamps, "i8", count), decode_raw(values, "f8", count)
    elif encoding == "gorilla":
        ts, vs = decode_timestamps(timestamps), decode_values(values)
    else:
        raise ValueError(f"unknown encoding {encoding!r}")
    if len(ts) != count or len(vs) != count:
        raise ValueError(f"block has {len(ts)} timestamps and {len(vs)} values, not {count}")
    return list(zip(ts, vs))


def _udf(f: Callable, kind: T.DataType):
    return F.pandas_udf(lambda s: pd.Series([f(x) for x in s], dtype=object), kind)


encode_timestamps_udf = lambda c: _udf(lambda x: encode_timestamps([int(v) for v in x]), T.BinaryType())(c)
decode_timestamps_udf = lambda c: _udf(decode_timestamps, T.ArrayType(T.LongType()))(c)
encode_values_udf = lambda c: _udf(lambda x: encode_values(list(x)), T.BinaryType())(c)
decode_values_udf = lambda c: _udf(decode_values, T.ArrayType(T.DoubleType()))(c)


def blocks(points: DataFrame, encoding: str = "gorilla", *keys: str) -> DataFrame:
    """From (series_id, ts_ms, value) one row per series (and ``keys``): n, timestamps, values as bytes."""
    by = [*keys, "series_id"]
    rows = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("s"))
    ts, vs = F.transform("s", lambda x: x["ts_ms"]), F.transform("s", lambda x: x["value"])
    if encoding == "gorilla":
        made = encode_timestamps_udf(ts), encode_values_udf(vs)
    else:
        made = _udf(lambda x: encode_raw(list(x), "i8"), T.BinaryType())(ts), _udf(lambda x: encode_raw(list(x), "f8"), T.BinaryType())(vs)
    return rows.select(*by, F.size("s").cast("bigint").alias("n"), made[0].alias("timestamps"), made[1].alias("values"))


def samples(encoded: DataFrame, encoding: str = "gorilla", *keys: str) -> DataFrame:
    """The inverse of ``blocks``."""
    by = [*keys, "series_id"]

    @F.pandas_udf("array<struct<ts_ms:bigint,value:double>>")
    def read(n: pd.Series, ts: pd.Series, vs: pd.Series) -> pd.Series:
        return pd.Series([[{"ts_ms": t, "value": v} for t, v in decode_block(a, b, encoding, c)] for c, a, b in zip(n, ts, vs)])

    return encoded.select(*by, F.explode(read("n", "timestamps", "values")).alias("s")).select(*by, "s.ts_ms", "s.value")


def timestamp_bytes(points: DataFrame) -> DataFrame:
    """Size of each series' encoded timestamps without encoding them: series_id, n, n_bytes (DataFrame functions only)."""
    from pyspark.sql import Window as W

    by = W.partitionBy("series_id").orderBy("ts_ms")
    rows = points.select("series_id", "ts_ms", (F.col("ts_ms") - F.lag("ts_ms").over(by)).alias("delta")).withColumn("dod", F.col("delta") - F.coalesce(F.lag("delta").over(by), F.lit(0)))
    coded = F.when(F.col("dod") >= 0, 2 * F.col("dod")).otherwise(-2 * F.col("dod") - 1)
    size = lambda n: sum((F.when(n >= 1 << 7 * k, 1).otherwise(0) for k in range(1, 9)), F.lit(1))
    rows = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("dod").isNotNull(), size(coded)).otherwise(0)).alias("rest"))
    return rows.select("series_id", "n", (size(F.col("n")) + 8 + F.col("rest")).cast("bigint").alias("n_bytes"))
