"""Bounded-space online packing of documents into sequences of token ids.

Each task keeps `windows` open windows. A document's full windows leave at once; its rest is placed in the open window
that it fits best (least space left). When it fits none, the fullest window is emitted: a gap of more than `gap` ids
is first filled by cutting the piece. At the end of a task its open windows are taken apart, and the pieces of a bounded number
of tasks are merged by best fit, largest first; what is left of them is merged with that of as many other groups, level by
level, so no task meets the leftovers of all.

One row for each piece: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset.

Defined cases: a null or empty text is a document of the end id alone; repeated rows are documents of their own; a
null doc_id is kept; a document longer than a sequence is cut; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.llm import tokens
from landlace.llm.common import chunks, map_batches, shared_dir, written

LENGTH, WINDOWS, GAP, END_ID = 2048, 16, 32, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECE.split(", ")]
#: A sequence's number is the task's number shifted by so many bits, plus its own number there; merged ones are negative and hold level, group and number.
SHIFT = 32

Piece = tuple  # doc_id, start, length, ids_crc32, doc_tokens


class Online:
    """Open windows of one task, ordered by their free space."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS, gap: int = GAP):
        self.length, self.most, self.gap = length, windows, gap
        self.free: list[tuple[int, int]] = []  # (free ids, window), sorted
        self.held: dict[int, list[Piece]] = {}
        self.next = 0
        self.out: list[tuple[int, list[Piece]]] = []

    def emit(self, pieces: list[Piece]) -> None:
        self.out.append((self.next, pieces))
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        """All ids of one document, as little-endian unsigned 32-bit bytes."""
        total = len(ids) // 4
        piece = lambda a, z: (doc_id, a, z - a, zlib.crc32(ids[4 * a : 4 * z]), total)
        at = total - total % self.length
        for a in range(0, at, self.length):
            self.emit([piece(a, a + self.length)])
        while at < total:
            rest = total - at
            k = bisect_left(self.free, (rest, -1))
            if k == len(self.free) and len(self.free) == self.most:
                room, w = self.free.pop(0)  # the fullest
                if room > self.gap:
                    self.held[w].append(piece(at, at + room))
                    at += room
                self.emit(self.held.pop(w))
                continue
            if k == len(self.free):
                room, w = self.length, max(self.held, default=-1) + 1
                self.held[w] = []
            else:
                room, w = self.free.pop(k)
            self.held[w].append(piece(at, total))
            at = total
            if room == rest:
                self.emit(self.held.pop(w))
            else:
                insort(self.free, (room - rest, w))

    def take(self) -> list[tuple[int, list[Piece]]]:
        out, self.out = self.out, []
        return out


def fit_largest_first(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin of each piece: best fit, largest first. Bins stand by free space, so each step is a look into a table of that size."""
    bins, rooms = np.zeros(len(sizes), np.int64), [[] for _ in range(length + 1)]
    open_ = np.zeros(length + 1, bool)
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = int(open_[s:].argmax()) + s
        if open_[k]:
            b = rooms[k].pop()
            open_[k] = bool(rooms[k])
            left = k - s
        else:
            b, left, n = n, length - s, n + 1
        bins[i] = b
        if left:
            rooms[left].append(b)
            open_[left] = True
    return bins


def _columns(rows: list[tuple]) -> dict[str, list]:
    return {n: list(c) for n, c in zip(NAMES, zip(*rows, strict=True) if rows else [[]] * len(NAMES), strict=True)}


def _laid(number: int, pieces: list[Piece]) -> list[tuple]:
    out, at = [], 0
    for p in pieces:
        out.append((*p, number, at))
        at += p[2]
    return out


def pack(docs: DataFrame, encode: Callable[[], Callable[[str | None], bytes]], length: int = LENGTH, windows: int = WINDOWS, gap: int = GAP, group: int = 16, folder: str | None = None) -> DataFrame:
    """The pieces of all documents. encode: makes, on a worker, what gives a text's ids with their end id."""

    def run(batches: Iterator[pa.RecordBatch]):
        ids, own, task = encode(), Online(length, windows, gap), TaskContext.get().partitionId()
        for b in chunks(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own.add(doc_id, ids(text))
            yield _columns([r for n, pieces in own.take() for r in _laid(task << SHIFT | n, pieces)])
        yield _columns([(*p, -1 - task, 0) for w in sorted(own.held) for p in own.held[w]])  # what is left, by task

    folder = folder or shared_dir(docs.sparkSession)
    first = written(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECE), f"{folder}/packed")
    done, left = first.where("sequence_id >= 0"), first.where("sequence_id < 0")

    # Leftovers of `group` tasks meet in one; windows of theirs that stay under seven eighths full go a level up, where the
    # leftovers of `group` such groups meet, until one group has all that is left.
    def merge(batches: Iterator[pa.RecordBatch], level: int, last: bool):
        rows: dict[int, list[tuple]] = {}
        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in NAMES), strict=True):
                rows.setdefault((-1 - r[5]) // group, []).append(r[:5])
        for g, pieces in sorted(rows.items()):
            pieces.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1], p[3]))
            sizes = np.array([p[2] for p in pieces], np.int64)
            bins = fit_largest_first(sizes, length)
            full = np.bincount(bins, sizes)
            out = []
            order = np.argsort(bins, kind="stable")
            for n, own in enumerate(np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)):
                if last or full[n] >= length * 7 // 8:
                    out += _laid(-1 - (level << 58 | g << 28 | n), [pieces[i] for i in own])
                else:
                    out += [(*pieces[i], -1 - g, -1) for i in own]
            yield _columns(out)

    tasks = left.select(F.min("sequence_id")).first()[0]
    groups, level = -tasks if tasks is not None else 0, 0
    while groups:
        groups, level = -(-groups // group), level + 1
        last = groups == 1
        met = left.repartition(groups, F.floor((-1 - F.col("sequence_id")) / group))
        merged = written(map_batches(met, lambda b, level=level, last=last: merge(b, level, last), PIECE), f"{folder}/merged{level}")
        done, left = done.unionAll(merged.where("offset >= 0")), merged.where("offset < 0")
        if last:
            break
    return done


def with_end(path_name: str = "word_bpe_49k.json", end_id: int = END_ID) -> Callable[[], Callable[[str | None], bytes]]:
    """Encoder for pack: ids of a public tokenizer file found on the worker, then the end id."""

    def make():
        ids, end = tokens.words(tokens.public_path(path_name)).ids, np.array([end_id], "<u4").tobytes()
        return lambda text: ids(text) + end

    return make
