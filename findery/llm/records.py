"""Operator 8: token ids in length-delimited binary records with an offset index.

File format.  A shard ``NNNNNN.rec`` is a run of frames, one per document:

    uint64  length of the payload          (all little-endian)
    uint32  masked crc32 of those 8 bytes
    payload int64 doc_id, then the ids, 2 bytes each (4 if the vocabulary has over 65,536)
    uint32  masked crc32 of the payload

A masked crc is ``rotr(crc, 15) + 0xA282EAD8`` modulo 2**32, so that a checksum of
data that holds checksums stays useful.  The checksum is the CRC-32 of zlib.
Beside each shard, ``NNNNNN.idx`` has 32 bytes per frame (doc_id, byte offset,
first token within the shard, tokens) after a 16-byte head, so that a shuffled
reader can seek to any document.  ``manifest.json`` names the shards in order
with the tokens before each.

Documents are in ascending ``doc_id`` order across the shards.  Rows without an id
come first, ordered by a hash of their text; rows that share an id keep all their
copies, in that order too, so also whole rows that repeat.  A NULL or empty text is just the end id.
A text of any length is one record, encoded and written by one task.  No documents make no shards and
give no rows.  Columns besides ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm.common import Scratch, bounded_batches, share, slices, table
from findery.llm.tokens import default_tokenizer, encoder, ids_crc32, read_spec

MAGIC = b"FNDRIDX1"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("start", "<u8"), ("tokens", "<u8")])
NO_ID = np.iinfo(np.int64).min


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the frame at a byte offset and the offset behind it; ValueError if a checksum differs."""
    head = bytes(data[at : at + 8])
    (length,), (crc,) = struct.unpack("<Q", head), struct.unpack("<I", data[at + 8 : at + 12])
    if masked_crc(head) != crc:
        raise ValueError(f"the length at byte {at} is damaged")
    payload = bytes(data[at + 12 : at + 12 + length])
    if len(payload) != length or struct.unpack("<I", data[at + 12 + length : at + 16 + length])[0] != masked_crc(payload):
        raise ValueError(f"the record at byte {at} is damaged")
    return payload, at + 16 + length


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard under names of its own and puts them in place at the end, so a repeated task does no harm."""

    def __init__(self, folder: str, number: int, width: int):
        self.fs, base = _filesystem(folder)
        self.names = [f"{base}/{number:06d}.{x}" for x in ("rec", "idx")]
        self.own = [f"{x}.{uuid.uuid4().hex}" for x in self.names]
        self.out = self.fs.open_output_stream(self.own[0])
        self.kind = "<u2" if width == 2 else "<u4"
        self.rows: list[tuple[int, int, int, int]] = []
        self.bytes = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        doc_id = NO_ID if doc_id is None else doc_id
        data = frame(struct.pack("<q", doc_id) + ids.astype(self.kind).tobytes())
        self.rows.append((doc_id, self.bytes, self.tokens, len(ids)))
        self.out.write(data)
        self.bytes += len(data)
        self.tokens += len(ids)

    def close(self) -> None:
        self.out.close()
        with self.fs.open_output_stream(self.own[1]) as f:
            index = np.array(self.rows, dtype=INDEX).tobytes()
            f.write(MAGIC + struct.pack("<II", len(self.rows), zlib.crc32(index)) + index)
        for own, name in zip(self.own, self.names):
            self.fs.move(own, name)


def read_index(folder: str, number: int) -> np.ndarray:
    fs, base = _filesystem(folder)
    with fs.open_input_stream(f"{base}/{number:06d}.idx") as f:
        data = f.read()
    count, crc = struct.unpack("<II", data[8:16])
    if data[:8] != MAGIC or zlib.crc32(data[16:]) != crc or len(data) != 16 + count * INDEX.itemsize:
        raise ValueError(f"the index of shard {number} is damaged")
    return np.frombuffer(data, dtype=INDEX, offset=16)


def read_records(folder: str, number: int, width: int, rows: np.ndarray | None = None, block: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a shard: all records in order, or those of the index rows given, in their order (seeks)."""
    fs, base = _filesystem(folder)
    kind = "<u2" if width == 2 else "<u4"

    def parse(payload: bytes) -> tuple[int, np.ndarray]:
        return struct.unpack("<q", payload[:8])[0], np.frombuffer(payload, dtype=kind, offset=8).astype(np.uint32)

    with fs.open_input_file(f"{base}/{number:06d}.rec") as f:
        if rows is not None:
            for row in rows:
                size = 16 + 8 + width * int(row["tokens"])
                yield parse(unframe(f.read_at(size, int(row["offset"])), 0)[0])
            return
        held = b""
        while data := f.read(block):
            held, at = held + data, 0
            while len(held) - at >= 12:
                need = 16 + struct.unpack_from("<Q", held, at)[0]
                if masked_crc(held[at : at + 8]) != struct.unpack_from("<I", held, at + 8)[0]:
                    raise ValueError(f"a length in shard {number} is damaged")
                if len(held) - at < need:
                    break
                payload, at = unframe(held, at)
                yield parse(payload)
            held = held[at:]
        if held:
            raise ValueError(f"shard {number} ends within a record")


def write_token_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, rows_per_shard: int | None = None) -> list[dict]:
    """Encode every text, write the shards below ``folder`` and return the manifest's shards.

    One range shuffle of (doc_id, text) gives the order; equal or missing ids are
    spread by a hash of the text, and equal texts of these by the rows' places in the input.  The driver gets one row per shard.
    """
    spark = docs.sparkSession
    spec = share(spark, read_spec(tokenizer))
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        enc = encoder(spec.value)
        width = 2 if max(enc.vocabulary - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], dtype=np.uint32)
        out = None
        for batch in slices(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                out = out or ShardWriter(folder, number, width)
                out.add(doc_id, np.concatenate([ids, end]))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"number": [number], "records": [len(out.rows)], "tokens": [out.tokens], "bytes": [out.bytes], "width": [width]})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_row")]
    count = max(1, docs.count() // rows_per_shard) if rows_per_shard else None
    ranged = keyed.repartitionByRange(count, *keys) if count else keyed.repartitionByRange(*keys)
    done = (
        ranged.sortWithinPartitions(*keys)
        .select("doc_id", "text")
        .mapInArrow(write, "number long, records long, tokens long, bytes long, width long")
        .collect()
    )
    shards, before = [], 0
    for row in sorted(done, key=lambda x: x["number"]):
        shards.append(row.asDict() | {"start": before})
        before += row["tokens"]
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"tokens": before, "end_id": end_id, "shards": shards}).encode())
    return shards


def read_token_records(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Digest of the files: a row per document, in any order; each shard is read by one task, as a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                index = read_index(folder, shard["number"])
                rows = []
                for row, (doc_id, ids) in zip(index, read_records(folder, shard["number"], shard["width"]), strict=True):
                    if doc_id != row["doc_id"] or len(ids) != row["tokens"]:
                        raise ValueError(f"index and records of shard {shard['number']} differ")
                    rows.append((None if doc_id == NO_ID else doc_id, shard["start"] + int(row["start"]), len(ids), ids_crc32(ids), shard["number"], int(row["offset"])))
                names = ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "byte_offset")
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=pa.schema([(n, pa.int64()) for n in names]))

    names = ("number", "width", "start")
    kind = "number long, width int, start long"
    plan = spark.createDataFrame([tuple(x[n] for n in names) for x in shards], kind)
    out = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, byte_offset long"
    return plan.repartition(max(1, len(shards)), "number").mapInArrow(read, out)


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    folder = Scratch(spark).sub("records")
    return read_token_records(spark, folder, write_token_records(docs, folder, default_tokenizer(), end_id=2))
