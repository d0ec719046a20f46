"""Token ids in files of fixed-width bits, with numpy and random access.

A file holds a run of documents in ascending order of doc_id:

    header   8 bytes TOKBITS1, then unsigned 64-bit: bits, ids, documents, ids in a block, blocks
    docs     doc_id as signed 64-bit (least value: null), then documents + 1 ends: ids before each document
    blocks   blocks + 1 byte offsets into the packed part
    packed   blocks of ids, each id in `bits` bits, least bit first; a block begins at a whole byte

`bits` is the least that holds the vocabulary. A block is unpacked in arrays, and any range of ids needs only its blocks.

A file is one row of the store's table (shard, name, content), which Spark's writers commit in the shared folder,
whatever file system that is on; a lost executor's shard is written again under the same number.

Defined cases: a null or empty text is the end id alone; documents under one doc_id stand in the order of their texts,
nulls first; a null doc_id comes first of all; ids beyond the vocabulary raise; an empty table gives an empty store; further columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landlace.llm.common import chunks, map_batches, shared_dir

MAGIC, BLOCK, END_ID = b"TOKBITS1", 4096, 2
#: A shard is cut after so many ids, so a worker's memory doesn't follow the partition.
SHARD_IDS = 4_000_000
#: Bytes of text in a range of doc_id, so ranges become more, not larger, with the data.
RANGE_BYTES = 64_000_000
NULL_ID = np.iinfo(np.int64).min


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, least bit first, ending at a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = ((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack_bits(packed: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def encode_file(doc_ids: list, ends: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    parts = [pack_bits(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    header = np.array([bits, len(ids), len(doc_ids), block, len(parts)], "<u8").tobytes()
    own = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    return b"".join([MAGIC, header, own, np.concatenate([[0], ends]).astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *parts])


class File:
    """A file's content, read in place."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.n, self.n_docs, self.block, n_blocks = (int(x) for x in np.frombuffer(content, "<u8", 5, 8))
        at = 48
        self.doc_ids = np.frombuffer(content, "<i8", self.n_docs, at)
        self.ends = np.frombuffer(content, "<u8", self.n_docs + 1, at := at + 8 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(content, "<u8", n_blocks + 1, at := at + 8 * (self.n_docs + 1)).astype(np.int64)
        self.packed = memoryview(content)[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start..end, unpacking only the blocks they lie in."""
        if not 0 <= start <= end <= self.n:
            raise IndexError((start, end))
        if start == end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        if self.bits % 8 == 0:  # blocks of whole bytes join without a gap
            own = unpack_bits(self.packed[self.offsets[first] : self.offsets[last + 1]], min(self.n, (last + 1) * self.block) - first * self.block, self.bits)
        else:
            own = np.concatenate([unpack_bits(self.packed[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.n - k * self.block), self.bits) for k in range(first, last + 1)])
        return own[start - first * self.block : end - first * self.block]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k]), int(self.ends[k + 1]))


def write(docs: DataFrame, encode: Callable[[], Callable[[str | None], bytes]], vocabulary: int, folder: str, partitions: int | None = None) -> str:
    """Write the ids of all documents, in ascending order of doc_id, as files of a store; returns the store's path.

    The documents are dealt by ranges of doc_id before they are encoded, so the shuffle carries plain rows and each task
    encodes one range in order.
    """
    spark, bits = docs.sparkSession, width(vocabulary)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = 0 if partitions else own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]):
        ids_of, task = encode(), TaskContext.get().partitionId()
        names, parts, held, number = [], [], 0, 0

        def shard():
            ends = np.cumsum([len(p) // 4 for p in parts])
            return {"shard": [task << 32 | number], "ids": [int(ends[-1])], "content": [encode_file(names, ends, np.frombuffer(b"".join(parts), "<u4"), bits)]}

        for b in chunks(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                names.append(doc_id)
                parts.append(ids_of(text))
                held += len(parts[-1]) // 4
                if held >= SHARD_IDS:
                    yield shard()
                    names, parts, held, number = [], [], 0, number + 1
        if names:
            yield shard()

    ordered = own.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    path = f"{folder}/tokens"
    map_batches(ordered, run, "shard long, ids long, content binary").write.option("compression", "none").parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema("shard long, ids long, content binary").parquet(path)
    # The place of each file: ids of the ranges before its own (one narrow row for each range), then of the files before it in its range.
    sizes = files.select("shard", "ids", F.shiftright("shard", 32).alias("range"))
    ranges = sizes.groupBy("range").agg(F.sum("ids").alias("ids"))
    first = ranges.select("range", (F.sum("ids").over(Window.orderBy("range")) - F.col("ids")).alias("first"))
    within = F.sum("ids").over(Window.partitionBy("range").orderBy("shard")) - F.col("ids")
    before = sizes.withColumn("within", within).join(first, "range").select("shard", (F.col("first") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for shard, content in zip(b.column("shard").to_pylist(), b.column("content"), strict=True):
                f = File(content.as_buffer().to_pybytes())
                ids = [f.doc(k).astype("<u4").tobytes() for k in range(f.n_docs)]
                yield {"shard": [shard] * f.n_docs, "doc_id": [None if d == NULL_ID else d for d in f.doc_ids.tolist()], "at": f.ends[:-1].tolist(), "n_tokens": np.diff(f.ends).tolist(), "ids_crc32": [zlib.crc32(x) for x in ids]}

    rows = map_batches(files.select("shard", "content"), run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(before, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store(docs: DataFrame, encode: Callable[[], Callable[[str | None], bytes]], vocabulary: int, folder: str | None = None) -> DataFrame:
    return read(docs.sparkSession, write(docs, encode, vocabulary, folder or shared_dir(docs.sparkSession)))
