import math
import random

import numpy as np
import pytest

from tidemark.functions import codec
from tidemark.functions.labels import canonical_key, day_of, iso_seconds, label, shown
from tidemark.functions.text import retention_days, shortest, time_param
from tidemark.operators.selector import SelectorError, parse, unquote


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("m", [("__name__", "m")]),
        (' m{job="api", instance="h1:9090"} ', [("__name__", "m"), ("job", "api"), ("instance", "h1:9090")]),
        ('{job="api"}', [("job", "api")]),
        ('m{path="/a,b"}', [("__name__", "m"), ("path", "/a,b")]),
        ("m{}", [("__name__", "m")]),
        ('m{a="x",}', [("__name__", "m"), ("a", "x")]),
        ("m{a=`r\\n`, b='x', c=\"\\\"q,\\\"\"}", [("__name__", "m"), ("a", "r\\n"), ("b", "x"), ("c", '"q,"')]),
        ('a:b{c:d=""}', [("__name__", "a:b"), ("c:d", "")]),
        ('{__name__="odd name"}', [("__name__", "odd name")]),
    ],
)
def test_selectors(text, want):
    assert [(m.name, m.value) for m in parse(text)] == want


@pytest.mark.parametrize("text", ["", "  ", "{}", "m{job=api}", "9bad", 'm{job="api"', 'm{a!="x"}', 'm{a=~"x"}', 'm{a!~"x"}', "m[5m]", "m offset 5m", "rate(m)", 'm{a="x"}[5m]', 'm{a="x" b="y"}', 'm{="x"}', "m{a='xy'}", 'm{a="\\q"}', 'm{a="\\ud800"}'])
def test_bad_selectors(text):
    with pytest.raises(SelectorError):
        parse(text)


def test_unquote_escapes():
    assert unquote(r'"\x41\102é\U0001F600\n\\"') == "ABé\U0001f600\n\\"
    assert unquote("'\\''") == "'"


def test_shortest():
    cases = {1.0: "1", 1.5: "1.5", 100000.0: "100000", 1e6: "1e+06", 123456789.0: "1.23456789e+08", 1e-4: "0.0001", 1e-5: "1e-05", -0.0: "-0", math.inf: "+Inf", -math.inf: "-Inf", 1e300: "1e+300"}
    assert [shortest(v) for v in cases] == list(cases.values())
    assert shortest(math.nan) == "NaN"


def test_times_and_periods():
    assert time_param("1970-01-01T00:00:01.5Z") == 1500
    assert time_param("2024-01-01T02:00:00+02:00") == 1_704_067_200_000
    assert (time_param("1.5"), time_param("-1.2345"), time_param("1e3")) == (1500, -1234, 1_000_000)
    for bad in ("", "abc", "nan", "2024-01-01"):
        with pytest.raises(ValueError):
            time_param(bad)
    assert [retention_days(x) for x in ("", "0", " 0 ", "7d", "30d")] == [0, 0, 0, 7, 30]
    for bad in ("7", "7h", "xd", "-1d", "d", "7.5d"):
        with pytest.raises(ValueError):
            retention_days(bad)


def test_codec_vectors():
    assert codec.encode_timestamps([]).hex() == "00"
    assert codec.encode_timestamps([1000, 2000, 3000]).hex() == "03e803000000000000d00f00"
    assert codec.encode_values([1.5, 1.5]).hex() == "02000000000000f83f00"
    assert codec.encode_values([1.5, 2.5]).hex() == "02000000000000f83fc26fffc0"
    assert len(codec.encode_timestamps([15000 * k for k in range(1000)])) == 1011
    assert len(codec.encode_values([42.0] * 1000)) == 135


def test_codec_round_trips():
    for ts in ([], [1000], [15000 * k for k in range(100)], [1000, 1001, 5000, 5001, 5002, 90000], [1000] * 3, [0, 2**40, 2**50], [-(2**63), 2**63 - 1, 0]):
        assert codec.decode_timestamps(codec.encode_timestamps(ts)) == ts
    rng = random.Random(42)
    for vs in ([], [3.14], [7.0] * 8, [0, 1, 2, 3, 4, 5, 100, 101, 102], [rng.gauss(0, 1000) for _ in range(500)], [0, math.inf, -math.inf, math.nan, -0.0, 5e-324, 1.7e308], [1.5, 1.6, 1e300, 1.5, 1.6, -1e-300, 1.5]):
        assert np.array(codec.decode_values(codec.encode_values(vs))).tobytes() == np.array(vs, np.float64).tobytes()


def test_codec_errors():
    for data in (b"", b"\x02\x00", codec.encode_timestamps([1, 2, 300])[:-1]):
        with pytest.raises(EOFError):
            codec.decode_timestamps(data)
    with pytest.raises(OverflowError):
        codec.decode_timestamps(b"\xff" * 11)
    with pytest.raises(EOFError):
        codec.decode_values(codec.encode_values([1.0, 2.0, 3.0])[:-1])
    with pytest.raises(ValueError):
        codec.decode_block(b"", b"", "zip", 0)
    assert codec.decode_block(codec.encode_raw([5], "i8"), codec.encode_raw([1.5], "f8"), "", 1) == [(5, 1.5)]
    with pytest.raises(EOFError):
        codec.decode_block(b"1234", b"", "raw", 1)


def test_columns(spark):
    from pyspark.sql import functions as F

    schema = "labels array<struct<name:string,value:string>>, ts bigint"
    rows = spark.createDataFrame([([("job", "a"), ("__name__", "m"), ("job", "b")], 1789948799999), ([("__name__", "m"), ("job", 'q"\\')], 1789948800000), ([("x", "")], -1)], schema)
    got = rows.select(canonical_key(F.col("labels")), day_of(F.col("ts")), iso_seconds(F.col("ts")), label(F.col("labels"), "job"), shown(F.col("labels"))).collect()
    assert [tuple(r) for r in got] == [
        ("__name__\x01m\x02job\x01a\x02job\x01b\x02", "20260920", "2026-09-20T23:59:59Z", "b", 'm{job="a", job="b"}'),
        ('__name__\x01m\x02job\x01q"\\\x02', "20260921", "2026-09-21T00:00:00Z", 'q"\\', 'm{job="q\\"\\\\"}'),
        ("x\x01\x02", "19691231", "1969-12-31T23:59:59Z", None, '{x=""}'),
    ]
