"""What several training-data operators need: a shared work folder, size-checked broadcasts and words.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``; a
temporary folder is used only in local mode, where driver and executors are one machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes beyond which ``small_join`` shuffles instead of broadcasting.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words (every ASCII character but digits and letters).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_local: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that executors and driver share, as a URI or path."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local.setdefault("dir", tempfile.mkdtemp(prefix="tidemark-"))


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver's JVM ends."""
    path = f"{work_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged within go at the end, but for those that were staged to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(quoted(name)), F.lit(0))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(quoted(name)))), F.lit(0))
    return F.lit(8)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the table has at most so many rows and bytes; it is read to find out, but no further than that many rows."""
    each = reduce(add, [_width(f.name, f.dataType) for f in df.schema.fields], F.lit(8))
    n, bytes_ = df.select(each.cast("bigint").alias("w")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= rows and bytes_ <= size


def small_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` only if it is small in rows and bytes, which it measures first."""
    return left.join(F.broadcast(right) if fits(right, rows) else right, on, how)


def quoted(name: str) -> Column:
    """A column by exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def held(docs: DataFrame, **keys: Column) -> DataFrame:
    """``keys`` and, as ``row``, all columns of a row: whatever these are called, ``unheld`` gives them back."""
    return docs.select(*[v.alias(k) for k, v in keys.items()], F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row"))


def unheld(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names])


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_at``: 1, 2 and so on within each ``key``, which is not null.

    A key's rows are numbered in each partition apart, and only the partitions' counts are put in order, so a key
    with any number of rows is no single task.
    """
    rows = stage(rows.withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy(key, "_part").orderBy(F.lit(0))))
    both = rows.join(sizes.select(key, "_part", before.alias("_before")), [key, "_part"])
    return both.withColumn("_at", F.col("_at") + F.col("_before")).drop("_part", "_before")


def sums_before(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with, under each name, the sum of that expression over all rows that come before in a total ``order``.

    Rows are dealt by ranges of the order; only one total per range is put in order by a single task.
    """
    rows = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = rows.groupBy("_part").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    whole = whole.select("_part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(e).over(inside), F.lit(0)).alias(n) for n, e in sums.items()])
    both = rows.join(F.broadcast(whole), "_part")  # as many rows as partitions
    return both.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gram_hashes(hashes: Column, n: int) -> Column:
    """From an array of word hashes, the hash of each run of ``n`` of them (none if there are fewer).

    Runs are put together by doubling, so a run of eight takes three passes over the array.
    """

    def joined(powers: dict[int, Column], a: Column, na: int, nb: int) -> Column:
        count = F.size(powers[1]) - (na + nb - 1)
        pairs = F.zip_with(F.slice(a, F.lit(1), F.greatest(count, F.lit(0))), F.slice(powers[nb], F.lit(na + 1), F.greatest(count, F.lit(0))), lambda x, y: F.xxhash64(x, y))
        return F.when(count > 0, pairs).otherwise(F.array().cast("array<bigint>"))

    def grown(powers: dict[int, Column], size: int) -> Column:
        if size * 2 <= n:
            return let(joined(powers, powers[size], size, size), lambda p: grown({**powers, size * 2: p}, size * 2))
        out, have = powers[size], size
        while have < n:
            step = max(k for k in powers if k <= n - have)
            out, have = joined(powers, out, have, step), have + step
        return out

    return let(hashes, lambda h: grown({1: h}, 1))
