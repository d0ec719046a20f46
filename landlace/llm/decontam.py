"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes may differ from a passage in k = rate * m edits. It is cut into k + 1 pieces, so one piece at least is
found unchanged in any such passage. Exact piece hits come from one pass over a block of texts as arrays: the eight bytes
at every position are looked up among the pieces' first eight. The group of g pieces around a hit must then hold with g - 1
edits at most (the same argument one level up), and the whole item is verified with Myers' bit-parallel distance around
each hit that is left.

Texts are compared in lower case with white space runs as one space, as UTF-8 bytes; edits count bytes.

Items under `least` bytes say too little for edits: they are found as whole words in a row, without an edit.

The benchmark's different texts are taken in blocks of bounded size, each broadcast in turn against all documents; the
documents are never shuffled, and items that share a text meet again only in a join on it. Defined cases: null or
blank texts and items match nothing; repeated documents and items each give their rows; null ids are kept; empty tables
give no rows; further columns are ignored (or kept, by clean).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.llm.common import chunks, map_batches

RATE, LEAST, WINDOW = 0.1, 32, 8
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).replace("\0", " ").encode("utf-8", "surrogatepass")


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed for an item of m bytes: pieces keep at least WINDOW bytes."""
    return max(0, min(int(rate * m), m // WINDOW - 1))


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the first end at which it is reached."""
    m, peq = len(pattern), {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, at = score, j
    return best, at


@dataclass
class Items:
    """A block of the benchmark, cut into pieces and ready to be searched for; texts under `least` bytes are kept whole.

    Pieces lie in groups of up to 64 bytes. As all groups together have one piece more than there are edits,
    some group of g pieces has g - 1 edits at most, and so an unchanged piece.
    """

    ids: list
    texts: list[bytes]
    rate: float = RATE
    least: int = LEAST

    def __post_init__(self):
        self.short: dict[bytes, list[int]] = {}
        rows, groups = [], []  # item, start, end, group; item, start, end, edits
        for i, t in enumerate(self.texts):
            if len(t) < self.least or len(t) < WINDOW:
                self.short.setdefault(t, []).append(i)
                continue
            n = budget(len(t), self.rate) + 1
            cut = [len(t) * j // n for j in range(n + 1)]
            many = math.ceil(n / max(1, min(n, 60 // (len(t) // n + 1))))
            for g in range(many):
                own = range(n * g // many, n * (g + 1) // many)
                rows += [(i, cut[j], cut[j + 1], len(groups)) for j in own]
                groups.append((i, cut[own[0]], cut[own[-1] + 1], len(own) - 1))
        self.item, self.start, self.end, self.group = np.array(rows, np.int64).reshape(-1, 4).T
        self.groups = np.array(groups, np.int64).reshape(-1, 4)
        self.bytes = np.frombuffer(b"".join(self.texts) + b"\0", np.uint8)
        self.offset = np.cumsum([0, *map(len, self.texts)])[:-1]
        key = np.zeros(len(rows), np.uint64)
        for b in range(WINDOW):
            key |= self.bytes[self.offset[self.item] + self.start + b].astype(np.uint64) << np.uint64(8 * b)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.lengths = sorted({t.count(b" ") + 1 for t in self.short})
        self.bits = max(16, int(32 * len(key)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.key * MIX) >> np.uint64(64 - self.bits)] = True
        # For the group check bytes count as equal if their last six bits are: it lets more through, never less.
        self.peq = np.zeros((len(groups), 64), np.uint64)
        for g, (i, first, last, _) in enumerate(groups):
            for j, c in enumerate(self.texts[i][first : min(last, first + 64)]):
                self.peq[g, c & 63] |= np.uint64(1 << j)

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) for every piece that stands in the text."""
        if len(text) < WINDOW or not len(self.key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Eight views of the bytes, each of aligned words from another start: all windows without building them.
        found = []
        for shift in range(WINDOW):
            own = text[shift : shift + (len(text) - shift) // WINDOW * WINDOW].view("<u8")
            at = np.flatnonzero(self.seen[(own * MIX) >> np.uint64(64 - self.bits)])
            low, high = np.searchsorted(self.key, own[at], "left"), np.searchsorted(self.key, own[at], "right")
            n = high - low
            where = np.repeat(at * WINDOW + shift, n)
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((where, self.order[which]))
        where, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        size, b = self.end[piece] - self.start[piece], WINDOW
        while (more := size > b).any():  # the rest of each piece, byte by byte over all hits
            inside = where + b < len(text)
            same = text[np.minimum(where + b, len(text) - 1)] == self.bytes[self.offset[self.item[piece]] + self.start[piece] + np.minimum(b, size - 1)]
            ok = ~more | (inside & same)
            where, piece, size, b = where[ok], piece[ok], size[ok], b + 1
        return where, piece

    def likely(self, text: np.ndarray, where: np.ndarray, piece: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Whether the group around each hit holds within its edits: Myers' columns for many hits at once."""
        out = np.ones(len(where), bool)
        for a in range(0, len(where), step):
            w, p = where[a : a + step], piece[a : a + step]
            g = self.group[p]
            _, first, last, edits = self.groups[g].T
            size = np.minimum(last - first, 64)
            left = w - self.start[p] + first - edits
            top = np.uint64(1) << (size - 1).astype(np.uint64)
            pv, mv = np.full(len(w), ~np.uint64(0)), np.zeros(len(w), np.uint64)
            score, best, one = size.copy(), size.copy(), np.uint64(1)
            steps = size + 2 * edits
            for t in range(int(steps.max(initial=0))):
                at = left + t
                eq = self.peq[g, np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)], 0) & 63]
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
                ph, mh = ph << one, mh << one
                pv, mv = mh | ~(xv | ph), ph & xv
                np.minimum(best, score, out=best, where=t < steps)
            out[a : a + step] = best <= edits
        return out

    def whole(self, d: int, text: bytes) -> Iterator[tuple[int, int, int, int, int]]:
        """find() for the short items: the first place of each that stands in the text word by word."""
        words, seen = text.split(b" "), set()
        for k in self.lengths:
            at = 0
            for i in range(len(words) - k + 1):
                run = b" ".join(words[i : i + k])
                if run in self.short and run not in seen:
                    seen.add(run)
                    yield from ((d, item, 0, at, at + len(run)) for item in self.short[run])
                at += len(words[i]) + 1

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of the best passage for each item that a text holds within its budget."""
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        whole = b"\0".join(texts)
        text = np.frombuffer(whole, np.uint8)
        where, piece = self.hits(text)
        if len(where):
            ok = self.likely(text, where, piece)
            where, piece = where[ok], piece[ok]
        doc = np.searchsorted(starts, where, "right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], list[int]] = {}
        for at, d, p in sorted(zip(where.tolist(), doc.tolist(), piece.tolist(), strict=True)):
            i = int(self.item[p])
            own, low = self.texts[i], int(starts[d])
            k, high, origin = budget(len(own), self.rate), low + len(texts[d]), at - int(self.start[p])
            if any(abs(origin - o) <= k // 2 for o in done.get((d, i), ())[-4:]):
                continue  # this place has been verified, with room for the shift
            done.setdefault((d, i), []).append(origin)
            left = max(low, origin - k - k // 2)
            distance, end = myers(own, whole[left : min(high, origin + len(own) + k + k // 2)])
            if distance <= k and distance < best.get((d, i), (k + 1,))[0]:
                best[d, i] = (distance, max(low, left + end - len(own)) - low, left + end - low)
        short = [x for d, t in enumerate(texts) for x in self.whole(d, t)] if self.short else []
        return sorted([(d, i, *x) for (d, i), x in best.items()] + short)


def blocks(items: DataFrame, rate: float = RATE, least: int = LEAST, size: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark's different texts in blocks of about `size` bytes, dealt by a hash; one is on the driver at a time. Ids: digests of the texts."""
    own = items.select("text").where(F.col("text").isNotNull()).distinct()
    n = max(1, math.ceil((own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / size))
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select("text", F.md5(F.col("text").cast("binary")).alias("digest")).orderBy("text").collect()
        kept = [(r["digest"], t) for r in rows if (t := normal(r["text"]))]
        if kept:
            yield Items([i for i, _ in kept], [t for _, t in kept], rate, least)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """One row for each document row and item that it holds: doc_id, item_id, distance, item_bytes, and the
    passage's place (from, upto) in the normalised text's bytes, upto being exact."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, digest string, distance int, item_bytes int, from long, upto long"

    def of(block: Items) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]):
            block = held.value
            for b in chunks(batches):
                ids, texts = b.column("doc_id").to_pylist(), [normal(t) for t in b.column("text").to_pylist()]
                if rows := block.find(texts):
                    d, i, distance, start, end = zip(*rows, strict=True)
                    yield {"doc_id": [ids[x] for x in d], "digest": [block.ids[x] for x in i], "distance": list(distance), "item_bytes": [len(block.texts[x]) for x in i], "from": list(start), "upto": list(end)}

        return map_batches(own, run, schema)

    parts = [of(b) for b in blocks(items, rate, least)]
    found = reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    named = items.where(F.col("text").isNotNull()).select(F.md5(F.col("text").cast("binary")).alias("digest"), F.col("item_id").cast("long").alias("item_id"))
    return found.join(named, "digest").select("doc_id", "item_id", "distance", "item_bytes", "from", "upto")


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The rows that hold no item, with all their columns; no shuffle."""
    columns, schema = docs.columns, docs.schema
    for block in blocks(items, rate, least):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held):
            for b in chunks(batches):
                dirty = {x[0] for x in held.value.find([normal(t) for t in b.column("text").to_pylist()])}
                kept = b.filter(pa.array([i not in dirty for i in range(b.num_rows)], pa.bool_()))
                yield {c: kept.column(i) for i, c in enumerate(columns)}

        docs = map_batches(docs, run, schema)
    return docs
