"""Token ids in files of length-delimited binary records, with an index for reading in any order.

A record file holds, one after the other::

    length    u64   bytes of the payload
    check     u32   masked CRC-32 of the eight bytes before
    payload         key flag u8 (0: no key), key i64, then the ids
    check     u32   masked CRC-32 of the payload

all little-endian. Ids take two bytes where the vocabulary allows it, else four; the manifest says which. The
index beside it has an (offset u64, ids u64) entry for each record. Files are named by the attempt that wrote them
and count only once the manifest, a Parquet table, names them: a lost or repeated task leaves nothing behind that
is read. Every file is at most ``file_bytes`` and one record long.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tablesieve.llm import arrow
from tablesieve.llm.encoding import encoder, library_tokenizer

# Layout of a record and the constant that masks its checks.
HEAD = struct.Struct("<QI")
KEY = struct.Struct("<Bq")
TAIL = struct.Struct("<I")
ENTRY = np.dtype([("offset", "<u8"), ("ids", "<u8")])
MASK = 0xA282EAD8

FILE_BYTES = 32 << 20

MANIFEST = "part long, seq long, name string, records long, ids long, bytes long, width int"
MANIFEST_ARROW = pa.schema(
    [("part", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("records", pa.int64()), ("ids", pa.int64()),
     ("bytes", pa.int64()), ("width", pa.int32())]
)
READ_ARROW = pa.schema(
    [("part", pa.int64()), ("seq", pa.int64()), ("place", pa.int64()), ("before", pa.int64()), ("doc_id", pa.int64()),
     ("n_tokens", pa.int64()), ("ids", pa.binary())]
)


class DamagedRecord(ValueError):
    """A record whose checks do not agree with its bytes."""


def masked(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that checks of checks differ."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join([size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload))])


def payload_at(data: memoryview, offset: int) -> bytes:
    """The checked payload of the record at ``offset`` of a file's bytes."""
    head = bytes(data[offset : offset + HEAD.size])
    if len(head) < HEAD.size:
        raise DamagedRecord(f"no record at {offset}")
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise DamagedRecord(f"length at {offset}")
    start = offset + HEAD.size
    payload, tail = bytes(data[start : start + size]), bytes(data[start + size : start + size + TAIL.size])
    if len(payload) < size or len(tail) < TAIL.size or TAIL.unpack(tail)[0] != masked(payload):
        raise DamagedRecord(f"payload at {offset}")
    return payload


def store(uri: str):
    """File system and path of a folder, through the stores that Arrow knows.

    A path without a scheme would mean the disk of whoever reads it, so it is refused.
    """
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    if "://" not in uri:
        raise ValueError(f"{uri} names no store: give it with its scheme")
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes the records of one task into files of bounded size."""

    def __init__(self, uri: str, part: int, width: int):
        self.files, self.folder = store(uri)
        self.files.create_dir(self.folder, recursive=True)
        self.part, self.width, self.done, self.attempt = part, width, [], uuid.uuid4().hex
        self._open()

    def _open(self) -> None:
        self.name = f"ids-{self.part:06d}-{len(self.done):05d}-{self.attempt}"
        self.out, self.entries, self.at, self.ids = None, [], 0, 0

    def add(self, key: int | None, ids: bytes) -> None:
        if self.out is None:
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}.rec")
        record = frame(KEY.pack(key is not None, key or 0) + ids)
        self.entries.append((self.at, len(ids) // self.width))
        self.out.write(record)
        self.at += len(record)
        self.ids += len(ids) // self.width
        if self.at >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        with self.files.open_output_stream(f"{self.folder}/{self.name}.idx") as index:
            index.write(np.array(self.entries, ENTRY).tobytes())
        self.done.append((self.part, len(self.done), self.name, len(self.entries), self.ids, self.at, self.width))
        self._open()


def write_batches(batches: Iterator[pa.RecordBatch], path: str, end: int, width: int, uri: str):
    encode = encoder(path, width)
    last = np.array([end], encode.dtype).tobytes()
    writer = Writer(uri, TaskContext.get().partitionId(), width)
    for rows in batches:
        for key, ids in zip(rows.column(0).to_pylist(), encode.ids(rows.column(1).to_pylist()), strict=True):
            writer.add(key, ids + last)
    writer.close()
    yield arrow.batch(MANIFEST_ARROW, [list(c) for c in zip(*writer.done, strict=True)] or [[]] * 7)


def write_ids(docs: DataFrame, path: str, end: int, uri: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end``, write the records in ascending key order; returns the manifest.

    The rows are placed by ranges of the key and sorted within them, so the order of (part, seq) and of
    the records in a file is the order of keys. Missing keys come first, rows of equal keys stay
    next to each other, in an order that their texts give. A missing text counts as empty and still has its end id. An empty
    table has an empty manifest. Only key and text are read.
    """
    spark = arrow.prepared(docs.sparkSession)
    width = 2 if max(library_tokenizer(path).get_vocab_size() - 1, end) < 1 << 16 else 4
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # equal and missing keys can be many: their rows are told apart by their texts
    named = rows.withColumn("named", F.xxhash64("text"))
    placed = named.repartitionByRange("doc_id", "named").sortWithinPartitions("doc_id", "named", "text").drop("named")
    manifest = placed.mapInArrow(lambda it: write_batches(it, path, end, width, uri), MANIFEST)
    manifest.write.parquet(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def read_batches(batches: Iterator[pa.RecordBatch], uri: str, seed: int | None) -> Iterator[pa.RecordBatch]:
    files, folder = store(uri)
    for row in (r for b in batches for r in b.to_pylist()):
        with files.open_input_stream(f"{folder}/{row['name']}.idx") as index:
            entries = np.frombuffer(index.read(), ENTRY)
        before = np.cumsum(entries["ids"], dtype=np.int64) - entries["ids"].astype(np.int64)
        order = np.arange(len(entries))
        if seed is not None:
            order = np.random.default_rng([seed, row["part"], row["seq"]]).permutation(len(entries))
        out, held = [], 0
        # one request for a file, whose size is bounded; any order of its records is then a matter of memory
        with files.open_input_stream(f"{folder}/{row['name']}.rec") as file:
            data = memoryview(file.read())
        for place in order:
            payload = payload_at(data, int(entries["offset"][place]))
            known, key = KEY.unpack_from(payload)
            ids = payload[KEY.size :]
            if row["width"] == 2:
                ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            if len(ids) // 4 != entries["ids"][place]:
                raise DamagedRecord(f"index entry {place} of {row['name']}")
            out.append((row["part"], row["seq"], int(place), int(before[place]), key if known else None, len(ids) // 4, ids))
            held += len(ids)
            if held >= 8 << 20:
                yield arrow.batch(READ_ARROW, [list(c) for c in zip(*out, strict=True)])
                out, held = [], 0
        if out:
            yield arrow.batch(READ_ARROW, [list(c) for c in zip(*out, strict=True)])


def read_ids(spark: SparkSession, uri: str, seed: int | None = None) -> DataFrame:
    """Records of the files a manifest names: ``part, seq, place, before, doc_id, n_tokens, ids``.

    ``ids`` are unsigned 32-bit little-endian; ``before`` counts the ids before a record in its file. With ``seed``
    each file's records are visited through the index in a shuffled order. Damaged records raise ``DamagedRecord``.
    """
    arrow.prepared(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")
    # a task per file: the manifest is small, what it stands for is not
    spread = manifest.repartition(max(1, manifest.count()), "part", "seq")
    return spread.mapInArrow(
        lambda it: read_batches(it, uri, seed),
        "part long, seq long, place long, before long, doc_id long, n_tokens long, ids binary",
    )


def record_starts(spark: SparkSession, uri: str) -> DataFrame:
    """Ids in all files before each file: ``part, seq, base``. One row per file, so the window is small."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")
    earlier = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return manifest.select("part", "seq", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))


def summary(spark: SparkSession, uri: str) -> DataFrame:
    """Per record: ``doc_id, start, n_tokens, ids_crc32``, from the files alone."""
    read = read_ids(spark, uri).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return read.join(record_starts(spark, uri), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
