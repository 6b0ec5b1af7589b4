"""Column expressions over label sets and time.

A label set is an array of (name, value) structs, not a map: a name may occur twice. All time arithmetic is
on whole milliseconds and does not depend on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = "__name__"
DAY_MS = 86_400_000
#: The bytes that close a label's name and its value in a canonical key.
AFTER_NAME, AFTER_VALUE = "\x01", "\x02"

LABEL = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
LABELS = T.ArrayType(LABEL)
SAMPLE = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("value", T.DoubleType())])
SAMPLES_IN = T.StructType([T.StructField("labels", LABELS), T.StructField("ts_ms", T.LongType()), T.StructField("value", T.DoubleType())])
SERIES = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("canonical_key", T.StringType()), T.StructField("labels", LABELS)])
POINTS = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("ts_ms", T.LongType()), T.StructField("value", T.DoubleType())])


def sorted_labels(labels: Column) -> Column:
    """By name, then value."""
    return F.array_sort(labels)


def label_key(name: Column, value: Column) -> Column:
    return F.concat(name, F.lit(AFTER_NAME), value)


def canonical_key(labels: Column) -> Column:
    """The same text for the same labels in whatever order."""
    return F.array_join(F.transform(sorted_labels(labels), lambda x: F.concat(x["name"], F.lit(AFTER_NAME), x["value"], F.lit(AFTER_VALUE))), "")


def labels_of(**columns: Column) -> Column:
    """Sorted label set from columns; ``metric`` is the metric's name."""
    pairs = {NAME if k == "metric" else k: v for k, v in columns.items()}
    return sorted_labels(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in pairs.items()]))


def label(labels: Column, name: str) -> Column:
    """The value of a label, the greatest if there are several; null without it."""
    return F.get(F.transform(F.filter(F.reverse(sorted_labels(labels)), lambda x: x["name"] == name), lambda x: x["value"]), F.lit(0))


def has_label(labels: Column, name: str, value: str | None = None) -> Column:
    """Whether the set holds the label (with exactly that value)."""
    return F.exists(labels, lambda x: (x["name"] == name) if value is None else (x["name"] == name) & (x["value"] == value))


def day_of(ts_ms: Column) -> Column:
    """UTC day as YYYYMMDD."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / DAY_MS).cast("int")), "yyyyMMdd")


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, rounded down."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))
    return F.floor(micros / F.lit(1000).cast("decimal(20,0)")).cast("bigint")


def iso_seconds(ts_ms: Column) -> Column:
    """RFC 3339 in UTC, to the second."""
    seconds = F.floor(ts_ms / 1000).cast("bigint")
    day, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    part = lambda n, of: F.lpad(F.floor(n).cast("bigint").cast("string"), of, "0")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), part(rest / 3600, 2), F.lit(":"), part((rest % 3600) / 60, 2), F.lit(":"), part(rest % 60, 2), F.lit("Z"))


def seconds(ts_ms: Column) -> Column:
    return ts_ms / F.lit(1000.0)


def shown(labels: Column) -> Column:
    """``metric{a="x", b="y"}``, the rest in order; quotes, backslashes and common controls are escaped."""
    text = lambda v: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r")), F.lit('"'))
    others = F.filter(labels, lambda x: x["name"] != NAME)
    inner = F.array_join(F.transform(others, lambda x: F.concat(x["name"], F.lit("="), text(x["value"]))), ", ")
    return F.concat(F.coalesce(label(labels, NAME), F.lit("")), F.when(F.size(others) > 0, F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(""))
