"""Stupid-backoff scores of documents, with n-gram counts of the whole corpus in tables partitioned by hash.

    explode   each block of documents becomes its different n-grams (orders 0 to `order`) with their counts, as
              sorted 60-bit hashes, cut into the ranges of the hash that the count table is partitioned by
    count     each range adds up its n-grams over all blocks: one partition of the count table
    join      the total of each n-gram goes back to the blocks that have it
    sum       a block's documents look their n-grams up and add up the scores

A block's n-grams travel as one packed row for each range, so an n-gram moves once for each block it is in, not for
each occurrence, and a frequent one is as cheap as any other. Scores leave a document's own counts out, so a text isn't
predicted from itself: an n-gram that only this document has is backed off from.

    S(w | context) = c(context w) / c(context) if c(context w) > 0, else alpha * S(w | shorter context)
    S(w) = c(w) / N, or 1 / (N + 1) if no other document has w

Words are white-space separated, in lower case. Defined cases: a null or blank text has 0 words, score 0 and a null
mean; a repeated doc_id gives a row for each of its rows, scored as a document of its own; null doc_ids are kept; an empty
table gives no rows; further columns are ignored. The documents have to be read from a table (common.written cuts
off anything else), as they are read twice in the same blocks; a difference raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.llm.common import chunks, map_batches, runs, shared_dir, written

ORDER, ALPHA, BITS = 3, 0.4, 60
#: Bytes of text in a block, and of input for each range of the count table.
BLOCK, RANGE = 8_000_000, 4_000_000
#: Ranges that a block or sum of blocks is cut into at a level; beyond them counting takes further levels.
FAN = 4096
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
WHITE = np.array([chr(b) in " \t\n\r\x0b\x0c" for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, without building the words: differences of a running sum of bytes by powers."""
    if len(text) > SEGMENT:  # cut at a space, so the tables stay small; a longer word is cut
        at, out = 0, []
        while at < len(text):
            end = min(len(text), at + SEGMENT)
            if end < len(text) and (space := max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t"))) > at:
                end = space
            out.append(word_hashes(text[at:end]))
            at = end
        return np.concatenate(out)
    if not _tables:
        _tables.extend((_powers(BASE, SEGMENT + 1), _powers(pow(BASE, -1, 1 << 64), SEGMENT + 1)))
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~WHITE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * _tables[0][: len(raw)], dtype=np.uint64)])
    return mixed((total[end] - total[start]) * _tables[1][start] + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For each order from 1: the 60-bit hash of the n-gram that starts at each word."""
    out, now = [], words
    for n in range(1, order + 1):
        if n > 1:
            now = mixed(now[:-1] * np.uint64(BASE) + words[n - 1 :]) if len(words) >= n else words[:0]
        out.append(mixed(now + np.uint64(n)) >> np.uint64(64 - BITS))
    return out


ALL = np.zeros(1, np.uint64)  # the n-gram of order 0, which every word is counted under


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed; high planes that are zero go."""
    import zstandard

    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if planes[k].any()), default=0)
    return len(x).to_bytes(4, "little") + bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpacked(b: bytes) -> np.ndarray:
    import zstandard

    n, used = int.from_bytes(b[:4], "little"), b[4]
    out = np.zeros((8, n), np.uint8)
    if used and n:
        out[:used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[5:]), np.uint8).reshape(used, n)
    return np.ascontiguousarray(out.T).view("<u8").ravel()


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of the hash that a key lies in: rising with the key."""
    return ((keys >> np.uint64(BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)  # up to 2**32 ranges


class Block:
    """Texts of some documents: ids, and lower-case bytes."""

    def __init__(self, doc_ids: list, texts: list[bytes]):
        self.doc_ids, self.texts = doc_ids, texts

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Block:
        return cls(b.column("doc_id").to_pylist(), [(t or "").lower().encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()])

    def dump(self) -> bytes:
        import pickle

        import zstandard

        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((self.doc_ids, self.texts)))

    @classmethod
    def load(cls, b: bytes) -> Block:
        import pickle

        import zstandard

        return cls(*pickle.loads(zstandard.ZstdDecompressor().decompress(b)))

    def number(self) -> int:
        """A signed 64-bit hash of what the block holds, the same in every read."""
        from xxhash import xxh64

        h = xxh64(repr(self.doc_ids).encode())
        for t in self.texts:
            h.update(len(t).to_bytes(8, "little") + t)
        return h.intdigest() - (1 << 63)

    def grams(self, order: int) -> list[list[np.ndarray]]:
        return [gram_hashes(word_hashes(t), order) for t in self.texts]


def counted(grams: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a block, sorted, with their counts."""
    words = sum(len(g[0]) for g in grams)
    keys, counts = np.unique(np.concatenate([ALL, *(x for g in grams for x in g)]), return_counts=True)
    counts[0] += words - 1  # ALL is zero and so comes first
    return keys, counts


def scores(block: Block, grams: list[list[np.ndarray]], totals: np.ndarray, order: int = ORDER, alpha: float = ALPHA) -> list[tuple[int, float]]:
    """(words, sum of log scores) of each document, given the corpus's total for each of the block's n-grams."""
    sizes = [[len(x) for x in g] for g in grams]
    keys, place = np.unique(np.concatenate([ALL, *(x for g in grams for x in g)]), return_inverse=True)
    if len(keys) != len(totals):
        raise RuntimeError("a block has other n-grams than were counted: the documents changed between two reads")
    at, everything, out = 1, int(totals[0]), []
    for n in sizes:
        counts = []
        for size in n:
            own = place[at : at + size]
            _, inverse, times = np.unique(own, return_inverse=True, return_counts=True)
            counts.append(totals[own].astype(np.int64) - times[inverse])
            at += size
        words = n[0]
        if not words:
            out.append((0, 0.0))
            continue
        rest = everything - words
        log = np.zeros(words)
        open_ = np.ones(words, bool)  # words whose score isn't settled yet
        for k in range(order, 0, -1):
            c, first = counts[k - 1], k - 1  # the n-gram that ends at word i starts at i - first
            ends = np.arange(first, first + len(c))
            have = np.zeros(words, bool)
            have[ends] = c > 0
            now = open_ & have
            if now.any():
                i = np.flatnonzero(now)
                below = counts[k - 2][i - first] if k > 1 else rest
                log[i] += np.log(c[i - first] / below)
                open_ &= ~now
            if k > 1:  # where there is a context of this length, it has been backed off from
                back = open_.copy()
                back[:first] = False
                log[back] += math.log(alpha)
        log[open_] -= math.log(rest + 1)
        out.append((words, float(log.sum())))
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, sorted; their summed counts; the place of each key of the parts, one part after the other)."""
    every = np.concatenate([k for k, _ in parts])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.concatenate([[True], every[1:] != every[:-1]])
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(first) - 1
    return every[first], np.add.reduceat(np.concatenate([c for _, c in parts])[order], np.flatnonzero(first)), place


def _keys(r: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unpacked(r["keys"]), dtype=np.uint64), unpacked(r["counts"]) + np.uint64(1)


def _cut(keys: np.ndarray, counts: np.ndarray, where: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """(range, packed keys, packed counts) for each range that sorted keys lie in."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(keys)]])
    return [(int(where[a]), packed(np.diff(keys[a:z], prepend=np.uint64(0))), packed(counts[a:z] - 1)) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


PART = "unit long, range long, keys binary, counts binary"
TOTAL = "unit long, range long, data binary"


def totals(parts: DataFrame, ranges: int, folder: str, fan: int, level: int = 0, have: int = 1) -> DataFrame:
    """The corpus's total of each key of each part: (unit, range, data) for the parts (unit, range, keys, counts), written.

    parts are cut into `have` ranges of the hash. Where that is all the ranges there are, a range's parts meet in one task: one partition
    of the count table. Else the parts of one range and of `fan` units at most are added up to one part each, cut into up to `fan` times as
    many ranges, sent a level down, and their totals are taken apart again. So a part sends at most `fan` rows at a level, however
    many ranges there are, and rows grow as the n-grams do.
    """
    spark = parts.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]):
        for number, rows in runs(batches, "range"):
            _, counts, place = merged([_keys(r) for r in rows])
            back, at = counts[place], 0
            for r in rows:
                n = int.from_bytes(r["keys"][:4], "little")
                yield {"unit": [r["unit"]], "range": [number], "data": [packed(back[at : at + n] - 1)]}
                at += n

    if have >= ranges:
        dealt = parts.repartition(max(shuffles, have), "range").sortWithinPartitions("range", "unit")
        return written(map_batches(dealt, count, TOTAL), f"{folder}/totals{level}")

    more = min(ranges, have * fan)
    grouped = parts.withColumn("unit_group", F.pmod(F.xxhash64("unit"), F.lit(max(1, -(-ranges // fan)))))
    grouped = grouped.withColumn("super", F.xxhash64("range", "unit_group"))

    def add(batches: Iterator[pa.RecordBatch]):
        for number, rows in runs(batches, "super"):
            keys, counts, _ = merged([_keys(r) for r in rows])
            for where, k, c in _cut(keys, counts, range_of(keys, more)):
                yield {"unit": [number], "range": [where], "keys": [k], "counts": [c]}

    def apart(batches: Iterator[pa.RecordBatch]):
        for _, rows in runs(batches, "super"):
            data = [r for r in rows if r["keys"] is None]
            own = [r for r in rows if r["keys"] is not None]
            whole = np.concatenate([unpacked(r["data"]) for r in data])
            keys, _, place = merged([_keys(r) for r in own])
            if len(keys) != len(whole):
                raise RuntimeError("the parts of a range changed between two reads")
            at = 0
            for r in own:
                n = int.from_bytes(r["keys"][:4], "little")
                yield {"unit": [r["unit"]], "range": [r["range"]], "data": [packed(whole[place[at : at + n]])]}
                at += n

    kept = written(grouped, f"{folder}/parts{level}")
    wide = max(shuffles, have * max(1, -(-ranges // fan)))
    sums = map_batches(kept.repartition(wide, "super").sortWithinPartitions("super", "range", "unit"), add, PART)
    below = totals(sums, ranges, folder, fan, level + 1, more)
    none = F.lit(None).cast("binary")
    both = kept.select("super", "unit", "range", "keys", "counts", none.alias("data")).unionAll(below.select(F.col("unit").alias("super"), F.lit(0).cast("long").alias("unit"), "range", none.alias("keys"), none.alias("counts"), "data"))
    back = both.repartition(wide, "super").sortWithinPartitions("super", "range", "unit")
    return written(map_batches(back, apart, TOTAL), f"{folder}/totals{level}")


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, folder: str | None = None, fan: int = FAN) -> DataFrame:
    """doc_id, n_tokens, log_score and mean_log_score for each row."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(shuffles, math.ceil(size / RANGE))

    def blocks(batches: Iterator[pa.RecordBatch]):
        """(number, block): the batches of a task, joined up to about BLOCK bytes."""
        ids, texts, held = [], [], 0
        for b in chunks(batches, BLOCK):
            new = Block.of(b)
            if held and held + b.nbytes > BLOCK:
                yield (own := Block(ids, texts)).number(), own
                ids, texts, held = [], [], 0
            ids, texts, held = ids + new.doc_ids, texts + new.texts, held + b.nbytes
        if ids:
            yield (own := Block(ids, texts)).number(), own

    first = ranges if ranges <= fan else fan

    def explode(batches: Iterator[pa.RecordBatch]):
        for number, block in blocks(batches):
            keys, counts = counted(block.grams(order))
            parts = _cut(keys, counts, range_of(keys, first))
            for i in range(0, len(parts), 16):
                where, k, c = zip(*parts[i : i + 16], strict=True)
                yield {"unit": [number] * len(where), "range": list(where), "keys": list(k), "counts": list(c)}

    def texts(batches: Iterator[pa.RecordBatch]):
        for number, block in blocks(batches):
            yield {"unit": [number], "range": [-1], "data": [block.dump()]}

    def add_up(batches: Iterator[pa.RecordBatch]):
        for number, rows in runs(batches, "unit"):
            copies = sum(r["range"] < 0 for r in rows)  # more than one where whole blocks repeat, which then have equal counts
            if not copies or (len(rows) - copies) % copies:
                raise RuntimeError(f"block {number} has counts but no text: the documents changed between two reads")
            block = Block.load(rows[0]["data"])
            found = np.concatenate([unpacked(r["data"]) for r in rows[copies::copies]]) + np.uint64(1)
            rows.clear()
            n, log = zip(*scores(block, block.grams(order), found, order, alpha), strict=True)
            yield {"doc_id": block.doc_ids * copies, "n_tokens": list(n) * copies, "log_score": list(log) * copies, "mean_log_score": [x / k if k else None for k, x in zip(n, log, strict=True)] * copies}

    counts = totals(map_batches(own, explode, PART), ranges, folder, fan, 0, first)
    both = counts.unionAll(map_batches(own, texts, TOTAL))
    joined = both.repartition(max(shuffles, math.ceil(size / BLOCK)), "unit").sortWithinPartitions("unit", "range")
    return map_batches(joined, add_up, "doc_id long, n_tokens long, log_score double, mean_log_score double")
