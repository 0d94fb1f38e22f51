"""Binary record files.

A log has a 16-byte little-endian header (timestamp, expiry, key size, value size), the value and the key of each record.
A sorted run has two lengths, each a zigzag varint in 8 bytes, the key and the value.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "<4I"
HEADER_SIZE = struct.calcsize(HEADER)


def encode(records: list[tuple[int, int, bytes, bytes]]) -> bytes:
    """Records (timestamp, expiry, key, value) as the bytes of a file."""
    return b"".join(struct.pack(HEADER, ts, expiry, len(key), len(value)) + value + key for ts, expiry, key, value in records)


def decode(data: bytes) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(offset, timestamp, expiry, key, value); a cut last record ends the log."""
    at = 0
    while at + HEADER_SIZE <= len(data):
        ts, expiry, key_size, value_size = struct.unpack_from(HEADER, data, at)
        end = at + HEADER_SIZE + value_size + key_size
        if end > len(data):
            return
        yield at, ts, expiry, data[end - key_size : end], data[at + HEADER_SIZE : end - key_size]
        at = end


def varint(n: int) -> bytes:
    """A length as a zigzag varint, filled up to 8 bytes."""
    n, out = n << 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n]).ljust(8, b"\0")


def from_varint(data: bytes) -> int:
    """The length that varint() wrote."""
    n = 0
    for shift, byte in enumerate(data):
        n |= (byte & 127) << 7 * shift
        if byte < 128:
            return n >> 1
    raise ValueError("a varint without an end")


def encode_run(records: list[tuple[bytes, bytes]]) -> bytes:
    """Records (key, value), sorted by key, as the bytes of a run."""
    return b"".join(varint(len(k)) + varint(len(v)) + k + v for k, v in sorted(records))


def decode_run(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, key, value) of a run, or of the block of it between two offsets of a sparse index."""
    end = len(data) if end is None else end
    while start + HEADER_SIZE <= end:
        key_size, value_size = from_varint(data[start : start + 8]), from_varint(data[start + 8 : start + 16])
        at = start + HEADER_SIZE
        yield start, data[at : at + key_size], data[at + key_size : at + key_size + value_size]
        start = at + key_size + value_size


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id, file_offset, key, value, tombstone of the run files below a path; run_id is the number in a file's name."""
    rows = _decoded(spark, path, lambda data: ((o, 0, k, v) for o, k, v in decode_run(data)))
    return rows.select(F.col("file_id").alias("run_id"), "file_offset", F.col("key").cast("string"), F.col("value").cast("string"), (F.octet_length("value") == 0).alias("tombstone"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """file_id, seq, file_offset, ts, key, value, tombstone of the files N.* below a path, file by file in parallel.

    seq orders records by the number in the file's name and then by offset; an empty value deletes, as in the format.
    """
    rows = _decoded(spark, path, lambda data: ((o, ts, k, v) for o, ts, _, k, v in decode(data)))
    return rows.select("file_id", (F.col("file_id") * F.lit(1 << 32) + F.col("file_offset")).alias("seq"), "file_offset", "ts",
                       F.col("key").cast("string"), F.col("value").cast("string"), (F.octet_length("value") == 0).alias("tombstone"))


def pack(log: DataFrame, file_id: str = "run_id", order: str = "seq", sorted_run: bool = False) -> DataFrame:
    """path, content of the files of log(key, value, and the two columns named): a row for each file, as binaryFile reads them.

    A log file has its records in the given order, a sorted run by key. Files are cut to a size by who names them.
    """
    schema = "path string, content binary"

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for who, at, key, value in zip(*(c.to_pylist() for c in batch.columns)):
                if who != now and parts:
                    yield out(now, parts)
                    parts = []
                now = who
                parts.append(encode_run([(key, value)]) if sorted_run else encode([(at % (1 << 32), 0, key, value)]))
        if parts:
            yield out(now, parts)

    def out(who: int, parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{who}.log"]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

    rows = log.select(F.col(file_id).cast("long").alias("who"), F.col(order).cast("long").alias("at"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    return rows.repartition("who").sortWithinPartitions("who", "key" if sorted_run else "at").mapInArrow(files, schema)


def unpack(files: DataFrame, decoder: Callable[[bytes], Iterable[tuple[int, int, bytes, bytes]]] | None = None) -> DataFrame:
    """file_id, file_offset, ts, key, value of files(path, content); those of a log unless a decoder is given."""
    decoder = decoder or (lambda data: ((o, ts, k, v) for o, ts, _, k, v in decode(data)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(decoder(content.as_py()))
                file_id = int("".join(c for c in name.rpartition("/")[2].partition(".")[0] if c.isdigit()) or 0)
                columns = [[file_id] * len(rows), *([r[k] for r in rows] for k in range(4))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file_id", "file_offset", "ts", "key", "value"])

    return files.select("path", "content").mapInArrow(run, "file_id long, file_offset long, ts long, key binary, value binary")


def read_blocks(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """run_id, file_offset, key, value of the blocks(run_id, start, stop) of sorted runs files(path, content); other bytes are not decoded."""
    schema = "run_id long, file_offset long, key string, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for who, start, stop, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(who, at, k.decode(), v.decode()) for at, k, v in decode_run(content, start, stop)]
            columns = [list(c) for c in zip(*rows)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["run_id", "file_offset", "key", "value"])

    number = F.regexp_extract("path", r"(\d+)\D*$", 1).cast("long")
    asked = files.select(number.alias("r"), "content").join(blocks, F.col("r") == F.col("run_id"))
    return asked.select("run_id", "start", F.coalesce("stop", F.octet_length("content").cast("long")), "content").mapInArrow(run, schema)


def _decoded(spark: SparkSession, path: str, decoder: Callable[[bytes], Iterable[tuple[int, int, bytes, bytes]]]) -> DataFrame:
    """unpack() of whole files below a path, one file at a time in a task; files are cut to a size by their writers."""
    return unpack(spark.read.format("binaryFile").load(path), decoder)
