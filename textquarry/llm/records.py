"""Token ids in length-delimited binary records.

A shard is a file of records in the layout of TFRecord files: length (8 bytes, little-endian), masked CRC-32C of those
bytes, payload, masked CRC-32C of the payload. A payload is flags (1 byte: bit 0, the document has an id; bit 1, its
token ids take 4 bytes each, else 2), doc_id (8 bytes) and the token ids, all little-endian. Beside each shard lies an index of (offset of the record, number
of ids) in two 8-byte numbers a record, so that readers can fetch records in any order.

Documents are dealt to shards by ranges of doc_id, and each task writes its shard under a name of its own attempt; the
manifest that the tasks return names the shards of the attempts that count, so a repeated or lost task leaves none behind
that is read. Shards go through pyarrow's file systems to the shared folder (file, hdfs, s3, ...).

Defined cases: a null or empty text has the end id only. Null ids come first; equal ids in the order of their texts'
hashes. Repeated rows are all written. An empty table has no shards. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, scratch, small_batches, stored, text_of
from .tokens import word_encoder

HEAD = struct.Struct("<Bq")
INDEX = np.dtype([("offset", "<u8"), ("ids", "<u8")])
CHUNK = 256
MASK = 0xA282EAD8


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of CRC-32C: by byte, and by the byte of a state that CHUNK zero bytes then pass through."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0x82F63B78), table >> np.uint32(1))
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(CHUNK):
        basis = table[basis & np.uint32(255)] ^ (basis >> np.uint32(8))
    skip = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for bit in range(8):
            skip[place, (np.arange(256) >> bit & 1).astype(bool)] ^= basis[8 * place + bit]
    return table, skip


TABLE, SKIP = _crc_tables()


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, of at least 4 bytes. All parts' chunks advance together, a byte at a time."""
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in parts])
    chunks = -(-sizes // CHUNK)
    last = np.cumsum(chunks)
    data = np.zeros(int(last[-1]) * CHUNK, np.uint8)
    for part, n, end in zip(parts, sizes.tolist(), (last * CHUNK).tolist(), strict=True):
        data[end - n : end] = np.frombuffer(part, np.uint8)  # zeros in front don't change a CRC that starts at zero
        data[end - n : end - n + 4] ^= 255
    columns = np.ascontiguousarray(data.reshape(-1, CHUNK).T)
    state = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        state = TABLE[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    total, first = np.zeros(len(parts), np.uint32), last - chunks
    for k in range(int(chunks.max())):
        on = np.flatnonzero(chunks > k)
        t = total[on]
        t = SKIP[0, t & 255] ^ SKIP[1, t >> 8 & 255] ^ SKIP[2, t >> 16 & 255] ^ SKIP[3, t >> 24]
        total[on] = t ^ state[first[on] + k]
    return ~total


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    of_heads, of_payloads = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [h + struct.pack("<I", a) + p + struct.pack("<I", b) for h, a, p, b in zip(heads, of_heads, payloads, of_payloads, strict=True)]


def file_system(uri: str):  # noqa: ANN201
    """(file system, path) of pyarrow for a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


class ShardWriter:
    def __init__(self, folder: str, name: str):
        self.fs, path = file_system(folder)
        self.fs.create_dir(path, recursive=True)
        self.name, self.at, self.ids, self.records = name, 0, 0, 0
        self.data, self.index = self.fs.open_output_stream(f"{path}/{name}.rec"), self.fs.open_output_stream(f"{path}/{name}.idx")

    def add(self, rows: list[tuple[int | None, np.ndarray]]) -> None:
        wide = [bool((ids > 65535).any()) for _, ids in rows]
        records = framed([HEAD.pack((doc is not None) + 2 * w, doc or 0) + ids.astype("<u4" if w else "<u2").tobytes() for (doc, ids), w in zip(rows, wide, strict=True)])
        entries = np.zeros(len(rows), INDEX)
        sizes = np.array([len(r) for r in records], np.uint64)
        entries["offset"], entries["ids"] = np.uint64(self.at) + np.cumsum(sizes) - sizes, [len(ids) for _, ids in rows]
        self.data.write(b"".join(records))
        self.index.write(entries.tobytes())
        self.at += int(sizes.sum())
        self.ids += int(entries["ids"].sum())
        self.records += len(rows)

    def close(self) -> None:
        self.data.close()
        self.index.close()


def read_index(folder: str, name: str) -> np.ndarray:
    fs, path = file_system(folder)
    with fs.open_input_stream(f"{path}/{name}.idx") as f:
        return np.frombuffer(f.read(), INDEX)


def parsed(record: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc = HEAD.unpack_from(record)
    return doc if flags & 1 else None, np.frombuffer(record, "<u4" if flags & 2 else "<u2", offset=HEAD.size).astype("<u4")


def read_record(folder: str, name: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record, by its offset in the index; wrong checksums raise."""
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/{name}.rec") as f:
        f.seek(offset)
        head = f.read(12)
        payload = f.read(struct.unpack_from("<Q", head)[0])
        check([head[:8]], [head[8:]])
        check([payload], [f.read(4)])
    return parsed(payload)


def check(parts: list[bytes], sums: list[bytes]) -> None:
    if not np.array_equal(masked(crc32c(parts)), np.frombuffer(b"".join(sums), "<u4")):
        raise ValueError("a record's checksum is wrong")


def read_shard(folder: str, name: str, at_once: int = 1 << 22) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """The records of a shard in order, in lists of about at_once bytes, checked."""
    fs, path = file_system(folder)
    with fs.open_input_stream(f"{path}/{name}.rec") as f:
        payloads: list[bytes] = []
        heads: list[bytes] = []
        sums: list[bytes] = []
        size = 0
        while True:
            head = f.read(12)
            if head:
                n = struct.unpack_from("<Q", head)[0]
                body = f.read(n + 4)
                payloads.append(body[:n])
                heads.append(head[:8])
                sums += [head[8:], body[n:]]
                size += n
            if payloads and (not head or size >= at_once):
                check(heads, sums[::2])
                check(payloads, sums[1::2])
                yield [parsed(p) for p in payloads]
                payloads, heads, sums, size = [], [], [], 0
            if not head:
                return


MANIFEST = "shard long, name string, records long, ids long"


def write_records(docs: DataFrame, folder: str, encoder: Callable[[], Callable[[str], np.ndarray]]) -> DataFrame:
    """Write docs (doc_id, text) as shards in ascending order of doc_id; returns the manifest (MANIFEST), stored."""
    spark = docs.sparkSession
    small_batches(spark)
    ordered = docs.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, writer = TaskContext.get(), encoder(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or ShardWriter(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
            writer.add([(d, encode(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int64()), "name": [writer.name], "records": pa.array([writer.records], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    return stored(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_back(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the manifest's shards."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    starts = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    dealt = starts.repartition(partitions(spark), "shard").select("name", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = start
                for rows in read_shard(folder, name):
                    sizes = np.array([len(ids) for _, ids in rows], np.int64)
                    begins = at + np.cumsum(sizes) - sizes
                    at += int(sizes.sum())
                    crcs = [zlib.crc32(ids) for _, ids in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(begins), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def records_query(docs: DataFrame, tokenizers: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    columns = text_of(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id").withColumn("tie", F.xxhash64("text"))
    folder = scratch(spark, "token_records")
    manifest = write_records(columns, folder, lambda: word_encoder(tokenizers).ids)
    return read_back(spark, manifest, folder)
