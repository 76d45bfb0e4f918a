"""Token ids as wavelet-matrix shards: one compressed file a shard, readable by position, count and occurrence.

A shard holds the ids of a run of documents in ascending doc_id order, an end id after each document.
Its matrix has one bit-plane for each bit of an id, highest first; a plane is the bit of every id in the
order that the planes above have left (zeros before ones, each kept in order). Running counts of ones
every 512 bits give rank, and rank gives access, counts and occurrences without unpacking the ids.
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
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costweave.llm import textops
from costweave.llm.tokens import ENCODED_BYTES, encoder_for, vocabulary_path
from costweave.session import reuse, shared_folder

MAGIC = b"WVM1"
BLOCK = 512
SHARD_IDS = 2_000_000
END_ID = 0


class WaveletMatrix:
    """A sequence of ids below 2**bits: access, rank, select and whole decoding."""

    def __init__(self, size: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray] | None = None):
        self.size, self.zeros, self.planes = size, zeros, planes  # planes: packed bits, padded to whole blocks
        self.ranks = ranks if ranks is not None else [self._running(p) for p in planes]

    @staticmethod
    def _running(plane: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        now = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        room = -(-len(ids) // BLOCK) * BLOCK // 8
        zeros, planes = [], []
        for bit in reversed(range(max(1, top.bit_length()))):
            ones = (now >> np.array(bit, now.dtype)) & np.array(1, now.dtype) != 0
            plane = np.zeros(room, np.uint8)
            packed = np.packbits(ones, bitorder="little")
            plane[: len(packed)] = packed
            low, high = now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))  # bits without order: no branch on them
            planes.append(plane)
            zeros.append(len(low))
            now = np.concatenate([low, high])
        return cls(len(ids), zeros, planes)

    def _ones(self, level: int, position: int) -> int:
        """Ones among the first `position` bits of a plane."""
        block, rest = divmod(position, BLOCK)
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[:rest].sum())

    def access(self, position: int) -> int:
        """The id at a position."""
        if not 0 <= position < self.size:
            raise IndexError(position)
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][position >> 3] >> (position & 7)) & 1
            ones = self._ones(level, position)
            position = self.zeros[level] + ones if bit else position - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, position: int) -> int:
        """How often an id occurs before a position."""
        low, high = self._range(value, position)
        return high - low

    def _range(self, value: int, position: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        low, high = 0, min(max(position, 0), self.size)
        for level, bit in enumerate(reversed(range(len(self.planes)))):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if value >> bit & 1 else (low - a, high - b)
        return low, high

    def count(self, value: int, start: int, end: int) -> int:
        return self.rank(value, end) - self.rank(value, start)

    def select(self, value: int, nth: int) -> int:
        """Position of the nth occurrence (from 0) of an id; -1 if there are fewer."""
        low, high = self._range(value, self.size)
        if not 0 <= nth < high - low:
            return -1
        position = low + nth
        for level in reversed(range(len(self.planes))):
            bit = value >> (len(self.planes) - 1 - level) & 1
            position = self._find(level, bit, position - self.zeros[level] if bit else position)
        return position

    def _find(self, level: int, bit: int, nth: int) -> int:
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - before[block]])

    def occurrences(self, value: int) -> list[int]:
        low, high = self._range(value, self.size)
        return [self.select(value, k) for k in range(high - low)]

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for bit, level in enumerate(reversed(range(len(self.planes)))):
            ones = np.unpackbits(self.planes[level], bitorder="little", count=self.size).view(bool)
            now[self.zeros[level] :] |= np.array(1 << bit, now.dtype)
            above = np.empty_like(now)
            above[np.flatnonzero(~ones)], above[np.flatnonzero(ones)] = now[: self.zeros[level]], now[self.zeros[level] :]
            now = above
        return now.astype(np.uint32)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard as bytes: header, then documents, planes and their running counts, each compressed alone."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids)
    valid = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], np.int64)
    parts = [press(valid.tobytes()), press(numbers.tobytes()), press(np.array(lengths, np.int64).tobytes())]
    parts += [press(p.tobytes()) for p in matrix.planes] + [press(r.tobytes()) for r in matrix.ranks]
    head = json.dumps({"size": matrix.size, "zeros": matrix.zeros, "docs": len(doc_ids), "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def open_shard(content: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(doc ids, lengths, matrix) of a shard."""
    import zstandard

    if content[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    (size,) = struct.unpack("<I", content[4:8])
    head, at, parts = json.loads(content[8 : 8 + size]), 8 + size, []
    for length in head["parts"]:
        parts.append(zstandard.ZstdDecompressor().decompress(content[at : at + length]))
        at += length
    valid, numbers = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.int64)
    doc_ids = [int(n) if ok else None for n, ok in zip(numbers, valid)]
    levels = len(head["zeros"])
    planes = [np.frombuffer(p, np.uint8) for p in parts[3 : 3 + levels]]
    ranks = [np.frombuffer(p, np.uint32) for p in parts[3 + levels :]]
    return doc_ids, np.frombuffer(parts[2], np.int64), WaveletMatrix(head["size"], head["zeros"], planes, ranks)


def _place(folder: str):
    """(file system, path) of a folder, made if it is not there."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    files.create_dir(path, recursive=True)
    return files, path


def _store(folder: str, name: str, content: bytes) -> None:
    """Whole or not at all: a task that runs again puts the same file in place of the first."""
    files, path = _place(folder)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(content)
    files.move(part, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, path: str | None = None, shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> DataFrame:
    """Encode docs (doc_id long, text string) into `*.wvm` files below `folder`; returns the stored list of files.

    Rows are ordered by doc_id, then by a hash of the text; equal rows are interchangeable. A NULL text is an
    empty document, a NULL doc_id comes first, an empty table gives no file. A file holds about `shard_ids`
    ids, or one longer document. Columns: file, part, piece (their order is the order of the ids), n_ids, n_docs.
    """
    path = path or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, piece = encoder_for(path), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, size = [], [], [], 0
        end = np.array([end_id], np.uint32).tobytes()

        def flush():
            nonlocal piece, doc_ids, lengths, held, size
            name = f"shard-{part:06d}-{piece:06d}.wvm"
            _store(folder, name, pack_shard(doc_ids, lengths, np.frombuffer(b"".join(held), np.uint32)))
            row = pa.RecordBatch.from_pydict(
                {"file": [name], "part": [part], "piece": [piece], "n_ids": [size], "n_docs": [len(doc_ids)]},
                schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("piece", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]),
            )
            piece += 1
            doc_ids, lengths, held, size = [], [], [], 0
            return row

        for batch in batches:
            _, offsets = textops.byte_column(batch.column(1))
            for first, last in textops.blocks(offsets, ENCODED_BYTES):
                texts = batch.column(1).slice(first, last - first)
                for doc_id, ids in zip(batch.column(0).slice(first, last - first).to_pylist(), encoder.encode(texts)):
                    doc_ids.append(doc_id)
                    lengths.append(len(ids) // 4 + 1)
                    held += [ids, end]
                    size += lengths[-1]
                    if size >= shard_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return reuse(ordered.mapInArrow(write, "file string, part long, piece long, n_ids long, n_docs long"))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: file, doc_id, place (ids before it in its file), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, lengths, matrix = open_shard(content.as_py())
                raw = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path.rsplit("/", 1)[-1]] * len(doc_ids)), pa.array(doc_ids, pa.int64()),
                    pa.array(ends - lengths), pa.array(lengths),
                    pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                ], names=["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    return files.mapInArrow(read, "file string, doc_id long, place long, n_tokens long, ids_crc32 long")


def token_shards(spark: SparkSession, docs: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Write docs as shards, read them back: doc_id, start, n_tokens, ids_crc32, file."""
    folder = folder or f"{shared_folder(spark)}/shards/{uuid.uuid4().hex}"
    _place(folder)
    files = write_shards(docs, folder, **how)
    # one row a file: ids of the parts before, then of the files before in the part
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn(
        "base", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.join(parts.select("part", "base"), "part").select(
        "file", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base")
    )
    return read_shards(spark, folder).join(starts, "file").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "file"
    )
