"""WARC: records, and revisits that say "not modified" resolved to what they stand for.

A server that answers 304 sends no body; the record stands for the latest earlier full response of the same
canonical URL. Records are joined as of their time: full responses and revisits of a URL are put in order and
each revisit takes the last response before it. Records are cut into blocks of about as many rows first, blocks are summed up
side by side, and only their summaries are carried forward, so a URL with a third of all records is no
single task. Then validators are checked and the headers that a 304 may update are merged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import small_join, stage

#: Header fields that a 304 response may update in what it stands for.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

#: Where a record may begin again after a damaged one.
HEAD = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")

RECORD = "record_id string, kind string, url string, at bigint, status int, headers map<string,string>, payload binary"


def canonical(url: Column) -> Column:
    """Lower-cased host without ``www.`` or ``m.`` and default port, path without a closing slash, query sorted, no fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def latest(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """``records`` (key, at, record_id, full, held) with ``found``: ``held`` of the last full row before each row.

    Rows at the same time are in order of record_id; of rows equal in that as well, any comes first. Blocks are ranges of
    (key, at, record_id) with about the same number of rows each (``blocks`` of them; by default as many as shuffle
    partitions), so a burst of one URL is many blocks.
    """
    order = ("key", "at", "record_id")
    dealt = records.repartitionByRange(blocks, *order) if blocks else records.repartitionByRange(*order)
    rows = stage(dealt.withColumn("_b", F.spark_partition_id()), "warc-blocks")
    held = F.when(F.col("full"), F.struct("at", "record_id", "held"))
    sums = rows.groupBy("key", "_b").agg(F.max_by(held, F.when(F.col("full"), F.struct("at", "record_id"))).alias("_last"))
    before = W.partitionBy("key").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("key", "_b", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = W.partitionBy("key", "_b").orderBy("at", "record_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.last(held, ignorenulls=True).over(inside))
    return small_join(rows, stage(sums.filter("_carried is not null"), "warc-carried"), ["key", "_b"], "left").withColumn("found", F.coalesce("_near", "_carried")["held"]).drop("_b", "_near", "_carried")


def _lowered(headers: Column) -> Column:
    """Names in lower case; of names that differ by case alone the greatest value counts. Null is no header."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    low = F.array_sort(F.transform(entries, lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value"))))
    return F.map_from_entries(F.filter(low, lambda x, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda y: y["key"] == x["key"])))


def _header(name: str) -> Column:
    return F.col("headers").getItem(name)


def resolve(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every revisit with what it stands for: record_id, url, key, at, found_id, reason, headers.

    ``records`` has the columns of ``RECORD``, others are ignored; header names are made lower case. A full response has kind ``response`` and
    status 200; a revisit has kind ``revisit``. reason is ``resolved``; ``no earlier response``; ``validator differs``
    if both sides carry an etag and these differ (weak marks aside), or, without etags, both carry a last-modified
    and the response's is later; or ``no validator`` if neither pair can be compared. found_id is null unless resolved.
    headers are the response's, with permitted fields of the 304 in their place. Null urls or times match nothing;
    repeated records give repeated rows; of records at the same time the one with the lesser record_id is the earlier. An
    empty table gives no rows. Bodies are not moved: found_id names the record that has it.
    """
    rows = records.select("record_id", "kind", "url", "at", "status", _lowered(F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = rows.withColumn("key", canonical(F.col("url"))).filter((F.col("kind") == "revisit") | full)
    rows = rows.withColumn("full", F.coalesce(full, F.lit(False))).withColumn("held", F.struct(F.col("record_id").alias("id"), F.map_entries("headers").alias("headers")))
    known = F.col("key").isNotNull() & F.col("at").isNotNull()
    lost = rows.filter(~known & ~F.col("full")).withColumn("found", F.lit(None).cast(rows.schema["held"].dataType))
    # Written once: texts are not read again, and a lost executor costs little.
    rows = stage(rows, "warc-rows")
    seen = latest(rows.filter(known), blocks).filter(~F.col("full"))
    both = seen.unionByName(lost).withColumn("old", F.map_from_entries("found.headers"))
    strip = lambda c: F.regexp_replace(c, "^W/", "")
    old_tag, new_tag = strip(F.col("old").getItem("etag")), strip(_header("etag"))
    when = lambda c: F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    old_time, new_time = when(F.col("old").getItem("last-modified")), when(_header("last-modified"))
    tags, times = old_tag.isNotNull() & new_tag.isNotNull(), old_time.isNotNull() & new_time.isNotNull()
    reason = (
        F.when(F.col("found").isNull(), "no earlier response")
        .when(tags & (old_tag != new_tag), "validator differs")
        .when(~tags & times & (old_time > new_time), "validator differs")
        .when(~tags & ~times, "no validator")
        .otherwise("resolved")
    )
    both = both.withColumn("reason", reason)
    good = F.col("reason") == "resolved"
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda k, _: ~F.coalesce(F.map_contains_key(fresh, k), F.lit(False))), fresh)
    return both.select("record_id", "url", "key", "at", F.when(good, F.col("found.id")).alias("found_id"), "reason", F.when(good, merged).otherwise(F.col("headers")).alias("headers"))


def _parse(data: bytes) -> Iterator[dict]:
    """Records of an uncompressed WARC file; damaged ones are left out, and reading goes on at the next record's head."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0:  # what is left holds no whole head
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = fields.get("content-length") or "0"
        size = int(length) if re.fullmatch("[0-9]{1,18}", length) else -1
        after = end + 4 + size
        # A record that ends neither at an empty line, nor at another record, nor with the data has a damaged length.
        if not lines[0].startswith("WARC/") or size < 0 or after > len(data) or not (data[after : after + 4] in (b"", b"\r\n") or data.startswith((b"\r\n\r\n", b"\r\nWARC/", b"WARC/"), after)):
            head = HEAD.search(data, at + 1)
            if head is None:
                return
            at = head.start()
            continue
        body = data[end + 4 : after]
        at = after
        head, _, payload = body.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", body)
        http = head.decode("latin-1").split("\r\n")
        status = http[0].split(" ")[1] if http[0].startswith("HTTP/") and " " in http[0] else ""
        yield {"fields": fields, "status": int(status) if re.fullmatch("[0-9]{3}", status) else None, "headers": {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http[1:]) if k.strip()}, "payload": payload}


def unpacked(data: bytes) -> bytes:
    """What can be read of a file, plain or gzip: of a torn or damaged member its sound beginning, then on at the next member."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        view, used = memoryview(data), at
        try:
            while used < len(data) and not member.eof:
                step = view[used : used + (1 << 16)]
                out.append(member.decompress(step))
                used += len(step)
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                break
            continue
        at = used - len(member.unused_data)
        while member.eof and at < len(data) and data[at] == 0:  # padding
            at += 1
        if not member.eof:
            break
    return b"".join(out)


def moment(text: str | None) -> int | None:
    """Milliseconds since 1970 of a WARC-Date; None if it is none."""
    import datetime

    try:
        when = datetime.datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    when = when if when.tzinfo else when.replace(tzinfo=datetime.UTC)
    return (when - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(milliseconds=1)


def read(spark: SparkSession, path: str, rows: int = 1000) -> DataFrame:
    """WARC files (plain or gzip) below ``path`` as records, ``rows`` at a time; ``at`` is milliseconds since 1970.

    Damaged records, and what is torn off a file's end, are left out; a date that cannot be read is null, and so is a missing
    field. An empty file has no records. A file is read by one task as a whole, so it must fit a worker; crawlers write files
    of about a gigabyte.
    """
    import pandas as pd

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                records = _parse(unpacked(bytes(data)))
                while some := list(islice(records, rows)):
                    frame = pd.DataFrame(
                        {
                            "record_id": [r["fields"].get("warc-record-id") for r in some],
                            "kind": [r["fields"].get("warc-type") for r in some],
                            "url": [r["fields"].get("warc-target-uri") for r in some],
                            "at": [moment(r["fields"].get("warc-date")) for r in some],
                            "status": [r["status"] for r in some],
                            "headers": [r["headers"] for r in some],
                            "payload": [r["payload"] for r in some],
                        }
                    )
                    yield frame.astype({"at": "Int64", "status": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(parse, RECORD)


def write(records: list[dict]) -> bytes:
    """A WARC file of records as ``read`` gives them (for tests and small exports)."""
    out = []
    for r in records:
        import datetime

        when = datetime.datetime.fromtimestamp((r["at"] or 0) / 1000, datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        http = f"HTTP/1.1 {r['status']} X\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (r["headers"] or {}).items()) + "\r\n"
        body = http.encode("latin-1") + (r["payload"] or b"")
        head = f"WARC/1.1\r\nWARC-Type: {r['kind']}\r\nWARC-Record-ID: {r['record_id']}\r\nWARC-Date: {when}\r\nWARC-Target-URI: {r['url']}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
        out.append(head.encode() + body + b"\r\n\r\n")
    return b"".join(out)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records made from ``pages`` (page_id, url, html), for the query: no crawl with revisits is at hand.

    Every page is visited three times: a full response at second 10 * page_id, dated if page_id is even; a revisit
    four seconds later whose etag is the page's (of every seventh page a stale one); and a dated revisit one
    second before, which can only stand for a page of the same canonical URL with a lower id.
    """
    page, tag, epoch = F.col("page_id").cast("bigint"), F.md5(F.coalesce("html", F.lit("")).cast("binary")), "Thu, 01 Jan 1970 00:00:00 GMT"
    some = lambda **h: F.map_filter(F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))]), lambda _, v: v.isNotNull())
    made = lambda name, kind, shift, status, headers: F.struct(F.concat(F.lit(name), F.col("p").cast("string")).alias("record_id"), F.lit(kind).alias("kind"), (F.col("p") * 10_000 + shift).alias("at"), F.lit(status).alias("status"), headers.alias("headers"))
    full = made("r", "response", 0, 200, some(ETag=F.col("tag"), Content_Type=F.lit("text/html"), Expires=F.lit("0"), Last_Modified=F.when(F.col("p") % 2 == 0, epoch)))
    late = made("l", "revisit", 4000, 304, some(ETag=F.when(F.col("p") % 7 == 0, "stale").otherwise(F.col("tag")), Expires=F.col("p"), Content_Type=F.lit("none")))
    early = made("e", "revisit", -1000, 304, some(Last_Modified=F.lit(epoch)))
    rows = pages.select(page.alias("p"), "url", tag.alias("tag")).select("url", F.explode(F.array(full, late, early)).alias("x"))
    return rows.select("x.record_id", "x.kind", "url", "x.at", "x.status", "x.headers", F.lit(None).cast("binary").alias("payload"))
