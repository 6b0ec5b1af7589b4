"""Token ids in fixed-width bit packing.

Texts are encoded with a public tokenizer file, an end id follows each document, and the ids are written in
ascending order of doc_id to files of blocks: every id takes the fewest bits that the vocabulary needs, every
block holds the same number of ids, and a table of block offsets at the end of the file lets a reader unpack
any range with numpy.

A file: ``MAGIC``, the blocks, then 64-bit little-endian numbers (doc_ids, 1 for each null doc_id, first id of each
document, offset of each block) and ``FOOT``: documents, blocks, ids, offset of the tables, bits, ids in a block.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import new_path

MAGIC, FOOT = b"TMTOKEN1", struct.Struct("<6Q")
BLOCK = 8192
END_ID = 0
#: Pieces of text whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1_000_000, 64
#: Documents, pieces and whole texts that are encoded at once: encodings take many times their ids, and a worker keeps the memory of the most it ever held.
ROWS, PIECES, WHOLE = 128, 1024, 16
#: Marks (a power of two) that tell whether a piece was met before.
MET = 1 << 22
#: Marks that often close a word.
MARKS = ",."
#: Two white-space characters side by side; texts with them are encoded whole.
SPACES = re.compile(r"\s\s")
#: Fixed value: the settings under which a white-space character always begins a new piece.
PIECEWISE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, the lowest bit first, each in ``bits`` bits; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


class Encoder:
    """Encodes texts as ``Tokenizer.encode`` does, but each distinct piece between spaces only once.

    A byte-level pre-tokenizer begins a new piece at a lone space or line break, so pieces between them can
    be encoded apart. Other tokenizers, and texts with white space side by side, are encoded whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has its core
        self.tokenizer = Tokenizer.from_str(spec)
        settings = json.loads(spec)
        before = settings.get("pre_tokenizer") or {}
        self.piecewise = all(before.get(k) == v for k, v in PIECEWISE.items()) and settings.get("normalizer") is None and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in settings.get("added_tokens", []))
        self.known: dict[str, bytes] = {}
        self.met = bytearray(MET)
        self.line = self._raw(["\n"])[0]
        self.marks = dict(zip(MARKS, self._raw(list(MARKS))))

    def _raw(self, texts: list[str], step: int = PIECES) -> list[bytes]:
        return [array("I", e.ids).tobytes() for k in range(0, len(texts), step) for e in self.tokenizer.encode_batch_fast(texts[k : k + step], add_special_tokens=False)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known, each behind a space, or with the line break that it begins with. Most pieces are met only once, so they are stored the second time. A full store keeps what it has: frequent pieces come early."""
        # A closing comma or full stop is a piece of its own, so only the word before it is encoded.
        closed = {p for p in new if p and p[-1] in MARKS and p[-2:-1].isalnum()}
        raw = [p for p in {p[:-1] for p in closed} | (new - closed) if p not in self.known]
        made = dict(zip(raw, self._raw([p[1:] if p[:1] == "\n" else " " + p for p in raw]))) if raw else {}
        made.update((p, self.line + made[p]) for p in raw if p[:1] == "\n")
        made.update((p, (made.get(p[:-1]) or self.known[p[:-1]]) + self.marks[p[-1]]) for p in closed)
        again = []
        for p in made:
            at = hash(p) & (MET - 1)
            if not self.met[at]:
                self.met[at] = 1
            elif len(p) <= LONGEST:
                again.append(p)
        if len(self.known) + len(again) <= REMEMBERED:
            self.known.update((p, made[p]) for p in again)
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        apart = [self.piecewise and not SPACES.search(t) for t in texts]
        pieces, ends = [], [0]
        for t in compress(texts, apart):  # a line break before the text makes its first piece like that of any line
            pieces += f"\n{t}".replace("\n", " \n").split(" ")[1:]
            ends.append(len(pieces))
        ids = list(map(self.known.get, pieces))
        if new := [k for k, known in enumerate(ids) if known is None]:
            made = self._learn({pieces[k] for k in new})
            for k in new:
                ids[k] = made[pieces[k]]
        joined = (b"".join(ids[a:b])[len(self.line) :] for a, b in pairwise(ends))
        whole = iter(self._raw([t for t, x in zip(texts, apart) if not x], WHOLE))
        return [next(joined if x else whole) for x in apart]


class Writer:
    """Writes one file; documents come in order."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.doc_ids, self.nulls, self.starts, self.offsets = array("q"), array("q"), array("q"), array("q")
        self.ids, self.waiting, self.pieces, self.at = 0, 0, [], len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.ids)
        self.ids += len(ids) // 4
        self.waiting += len(ids) // 4
        self.pieces.append(ids)
        if self.waiting >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pieces), "<u4")
        end = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, end, self.block):
            data = pack(ids[k : min(end, k + self.block)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.pieces, self.waiting = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        for table in (self.doc_ids, self.nulls, self.starts, self.offsets):
            self.out.write(table.tobytes())
        self.out.write(FOOT.pack(len(self.doc_ids), len(self.offsets), self.ids, self.at, self.bits, self.block))
        self.out.close()


class Reader:
    """Random access to one file: ``docs`` and ``ids(a, b)``."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_docs, self.blocks, self.count, tables, self.bits, self.block = FOOT.unpack(source.read_at(FOOT.size, size - FOOT.size))
        flat = np.frombuffer(source.read_at(size - FOOT.size - tables, tables), "<i8")
        self.doc_ids, nulls, self.starts, self.offsets = np.split(flat, [n_docs, 2 * n_docs, 3 * n_docs])
        self.nulls, self.tables = nulls.astype(bool), tables

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (end exclusive), from no more blocks than hold them."""
        if a >= b:
            return np.zeros(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        end = int(self.offsets[last + 1]) if last + 1 < self.blocks else self.tables
        count = min(self.count, (last + 1) * self.block) - first * self.block
        data = self.source.read_at(end - int(self.offsets[first]), int(self.offsets[first]))
        if self.block * self.bits % 8:  # blocks begin at bytes
            cuts = [int(o) - int(self.offsets[first]) for o in self.offsets[first : last + 1]] + [len(data)]
            sizes = [self.block] * (last - first) + [count - (last - first) * self.block]
            ids = np.concatenate([unpack(data[x:y], self.bits, n) for x, y, n in zip(cuts, cuts[1:], sizes)])
        else:
            ids = unpack(data, self.bits, count)
        return ids[a - first * self.block : b - first * self.block]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block: int = BLOCK) -> list[dict]:
    """Encodes and writes all documents below ``path``; returns one entry per file, in order.

    Documents are dealt by ranges of (doc_id, hash of the text) and sorted within them, nulls first, so files
    hold consecutive documents and repeated ids are spread as well. A file appears under its name only when
    it is complete; a task that runs again writes the same file again.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    bits = bits_for(max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True), end_id + 1))
    sent = spark.sparkContext.broadcast(spec)
    end = array("I", [end_id]).tobytes()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        task = TaskContext.get()
        part, name, out = f"{folder}/.{task.partitionId():06d}-{task.taskAttemptId()}", f"{task.partitionId():06d}.ids", None
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                some = batch.slice(k, ROWS)
                if out is None:
                    encoder = _encoder(sent.value)
                    store.create_dir(folder, recursive=True)
                    out = Writer(store.open_output_stream(part), bits, block)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    out.add(doc_id, ids + end)
        if out is not None:
            out.close()
            store.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [len(out.doc_ids)], "ids": [out.ids]})

    key = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), key).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key)
    files = sorted(rows.mapInArrow(save, "file string, docs bigint, ids bigint").collect(), key=lambda r: int(r["file"].split(".")[0]))  # one row per file
    out, base = [], 0
    for r in files:
        out.append({"path": f"{path}/{r['file']}", "docs": r["docs"], "ids": r["ids"], "base": base})
        base += r["ids"]
    return out


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def digests(spark, files: list[dict]) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 of each document."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not files:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(files)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                file = sent.value[k]
                store, name = _store(file["path"])
                with store.open_input_file(name) as source:
                    reader = Reader(source)
                    ends = np.append(reader.starts[1:], reader.count)
                    crcs, first = np.zeros(len(ends), np.int64), 0
                    while first < len(ends):  # about a million ids at a time, one document at least
                        last = max(first + 1, int(np.searchsorted(ends, reader.starts[first] + (1 << 20), "right")))
                        a = int(reader.starts[first])
                        data = memoryview(reader.ids(a, int(ends[last - 1])).tobytes())
                        for i in range(first, last):
                            crcs[i] = zlib.crc32(data[4 * (int(reader.starts[i]) - a) : 4 * (int(ends[i]) - a)])
                        first = last
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, mask=reader.nulls), pa.array(reader.starts + file["base"]), pa.array(ends - reader.starts), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(files), 1, len(files)).mapInArrow(load, schema)


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Writes the documents' ids and reads them back: doc_id, start, n_tokens, ids_crc32, one row per row.

    Null counts as an empty text (its only id is the end id); null doc_ids come first; repeated rows are all
    written; an empty table writes no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    return digests(spark, write(docs, tokenizer, new_path(spark, "ids"), end_id, block))
