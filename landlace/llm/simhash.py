"""SimHash near-duplicates: exact Hamming join over a Gray-order hierarchical index, then components.

fingerprints()  one 64-bit fingerprint per document.
links()         a spanning set of links between different fingerprints at `bits` or fewer differing bits.
components()    the smallest member of each connected component.
classes()       all three: doc_id, fingerprint, component_id. (similar.dedup keeps one row of each group of near-duplicates.)

Distribution: fingerprints are cut into blocks. With d differing bits spread over `blocks` blocks, some
blocks - d of them agree exactly, so two linked fingerprints meet under at least one choice of agreeing blocks
(pigeonhole). The number of blocks follows the number of distinct fingerprints alone, and every choice is exact. Within
such a group the fingerprints are sorted by Gray rank and indexed by a tree whose upper nodes hold the bit
pattern that all fingerprints below share; a search adds up the differences on the way down and drops a
whole node once they pass the limit. A group that a sample shows to be very large is split: its fingerprints are dealt into parts
by a hash, and each pair of parts is a group of its own, so that all its pairs still meet.

Defined cases: a null or blank text has fingerprint zero, which links like any other; a repeated doc_id gives a row for
each of its rows, the fingerprint of each being that of its own text; null doc_ids are kept and never become a
component's smallest id unless the component has no other (then component_id is null); an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.llm.common import chunks, drop, map_batches, runs, shared_dir, written

SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 values (seed 42) of all word shingles, repeats included; none for a blank text."""
    from xxhash import xxh64_intdigest as xxh

    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(parts) - words + 1)
    spans = zip(starts[:last].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)
    return np.fromiter((xxh(joined[a:b], SEED) for a, b in spans), np.uint64, last)


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bit i is 1 if set in over half of the XXH64 values (seed 42) of all word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the values; zero for none."""
    if not (last := len(h)):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((counts * 2 > last).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches):
            fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield {"doc_id": b.column("doc_id"), "fp": pa.array(fps.view(np.int64))}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


# --- the index -------------------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order: the prefix xor of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes of `fan` children; each node has the mask and the bits all below it share.

    A node's own mask leaves out what its parent's mask has already, so differences add up along a path.
    """

    def __init__(self, codes: np.ndarray, fan: int = 8):
        self.order, self.fan = np.argsort(gray_rank(codes), kind="stable"), fan
        self.codes = codes[self.order]
        ones, zeros = self.codes, ~self.codes
        self.levels = [(self.codes, np.full(len(codes), ~np.uint64(0)))]
        while len(ones) > fan:
            cut = np.arange(0, len(ones), fan)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            self.levels.append((ones, ones | zeros))
        self.own = [m if k + 1 == len(self.levels) else m & ~np.repeat(self.levels[k + 1][1], fan)[: len(m)] for k, (_, m) in enumerate(self.levels)]

    def reach(self, first: int, last: int, bits: int) -> np.ndarray:
        """Numbers of the lowest nodes that may hold codes within `bits` of codes first to last - 1; differences add up on the way
        down over the bits that the codes share."""
        top = len(self.levels) - 1
        if not top:
            return np.zeros(1, np.int64)
        ones, zeros = np.bitwise_and.reduce(self.codes[first:last]), np.bitwise_and.reduce(~self.codes[first:last])
        node = np.arange(len(self.levels[top][0]))
        seen = np.zeros(len(node), np.uint8)
        for level in range(top, 0, -1):
            seen = seen + np.bitwise_count((ones ^ self.levels[level][0][node]) & self.own[level][node] & (ones | zeros))
            node, seen = node[seen <= bits], seen[seen <= bits]
            if level > 1:
                below = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                there = below < len(self.levels[level - 1][0])
                node, seen = below[there], np.repeat(seen, self.fan)[there]
        return node

    def within(self, queries: np.ndarray, bits: int, step: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query position, code position) at `bits` or fewer differing bits, in parts of bounded size."""
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        for a in range(0, len(queries), max(1, step // width)):
            q = np.arange(a, min(len(queries), a + max(1, step // width)))
            stack = [(top, np.repeat(q, width), np.tile(np.arange(width), len(q)), np.zeros(len(q) * width, np.uint8))]
            while stack:
                level, who, node, seen = stack.pop()
                if len(who) > step:
                    stack += [(level, who[i : i + step], node[i : i + step], seen[i : i + step]) for i in range(0, len(who), step)]
                    continue
                seen = seen + np.bitwise_count((queries[who] ^ self.levels[level][0][node]) & self.own[level][node])
                ok = seen <= bits
                who, node, seen = who[ok], node[ok], seen[ok]
                if not level:
                    yield who, node
                elif len(who):
                    n = len(self.levels[level - 1][0])
                    below = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    there = below < n
                    stack.append((level - 1, np.repeat(who, self.fan)[there], below[there], np.repeat(seen, self.fan)[there]))


class Forest:
    """Union of positions by smallest root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook larger roots under smaller ones until all given links lie within a tree."""
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def spanning(codes: np.ndarray, bits: int, block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(code, smallest code of its component) for codes linked to others, given different codes of one group.

    Groups larger than `block` are searched block of queries by block of queries, so memory stays bounded.
    """
    codes = np.sort(codes)
    if len(codes) < 2:
        return codes[:0], codes[:0]
    if len(codes) == 2:
        near = np.bitwise_count(codes[:1] ^ codes[1:]) <= bits
        return codes[1:][near], codes[:1][near]
    forest = Forest(len(codes))
    if len(codes) <= 8:  # a single node of the index
        i, j = np.triu_indices(len(codes), 1)
        near = np.bitwise_count(codes[i] ^ codes[j]) <= bits
        forest.join(i[near], j[near])
    else:
        index = GrayIndex(codes)
        place = np.searchsorted(codes, index.codes)
        for a in range(0, len(codes), block):
            for who, found in index.within(index.codes[a : a + block], bits):
                forest.join(place[who + a], place[found])
    linked = forest.root != np.arange(len(codes))
    return codes[linked], codes[forest.root[linked]]


def layout(distinct: int, bits: int, most: int = 2048, agree: int = 1) -> tuple[int, int]:
    """(blocks, agreeing): the least number of blocks for which a group of random fingerprints has about `most` at most, `agree` agreeing at least."""
    for blocks in range(bits + agree, 33):
        if distinct / 2 ** (64 * (blocks - bits) // blocks) <= most:
            return blocks, blocks - bits
    return 32, 32 - bits


#: Entries of a group from which it is split, if there are no more than MOST_SPLIT such groups by far; one in SAMPLED is looked at to find them.
HOT, MOST_SPLIT, SAMPLED = 50_000, 100_000, 64


def key_of(family: int, part: np.ndarray) -> np.ndarray:
    """A 64-bit hash that names the group of a choice of blocks and what they hold; groups that share one only make more work."""
    x = (part + np.uint64(family + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) + np.uint64(family)


def meet(fps: DataFrame, columns: list[str], distinct: int, bits: int, each: Callable[[np.ndarray], Iterator[dict]], schema: str, most: int = 2048, agree: int = 1) -> DataFrame:
    """What `each` makes of every group of rows whose fingerprints agree in enough blocks; it gets the rows' `columns` (long, fp first) as
    one array of rows. Entries travel packed by task and group."""
    blocks, agree = layout(distinct, bits, most, agree)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [np.uint64(sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in own)) for own in combinations(range(blocks), agree)]
    entries, width = distinct * len(masks), len(columns)
    hot = max(HOT, entries // MOST_SPLIT)

    def arrays(batches: Iterator[pa.RecordBatch], rows: int = 200_000):
        held: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in columns], 1))
            if sum(map(len, held)) >= rows:
                yield np.concatenate(held)
                held = []
        if held:
            yield np.concatenate(held)

    def keys(batches: Iterator[pa.RecordBatch]):
        for own in arrays(batches):
            codes = np.ascontiguousarray(own[:, 0]).view(np.uint64)
            for k, m in enumerate(masks):
                yield {"key": pa.array(key_of(k, codes & m).view(np.int64))}

    split: dict[int, int] = {}
    if distinct > hot:
        sample = map_batches(fps.select(*columns).where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0), keys, "key long")
        split = {r["key"]: math.ceil(r["count"] * SAMPLED / hot) for r in sample.groupBy("key").count().where(F.col("count") * SAMPLED > hot).collect()}

    def packed(key: np.ndarray, rows: np.ndarray) -> dict:
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        ends = np.append(cut, len(key)).astype(np.int32) * 8 * width
        data = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])
        return {"key": pa.array(key[cut].view(np.int64)), "data": data}

    known = np.sort(np.fromiter(split, np.int64, len(split)))

    def deal(batches: Iterator[pa.RecordBatch]):
        for own in arrays(batches):
            codes = np.ascontiguousarray(own[:, 0]).view(np.uint64)
            for k, m in enumerate(masks):
                key = key_of(k, codes & m)
                order = np.argsort(key, kind="stable")
                key, rows = key[order], own[order]
                if len(known):
                    large = known[np.minimum(np.searchsorted(known, key.view(np.int64)), len(known) - 1)] == key.view(np.int64)
                    for name in np.unique(key[large]):
                        at = key == name
                        n, salt = split[int(name.view(np.int64))], key_of(7, codes[order][at]) % np.uint64(split[int(name.view(np.int64))])
                        for t in range(n):
                            cell = np.minimum(salt, np.uint64(t)) * np.uint64(n) + np.maximum(salt, np.uint64(t)) + name
                            turn = np.argsort(cell, kind="stable")
                            yield packed(cell[turn], rows[at][turn])
                    key, rows = key[~large], rows[~large]
                if len(key):
                    yield packed(key, rows)

    def gather(batches: Iterator[pa.RecordBatch]):
        for _, own in runs(batches, "key"):
            x = np.frombuffer(b"".join(r["data"] for r in own), np.int64).reshape(-1, width)
            if len(x) > 1:
                yield from each(x)

    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / 2_000_000))
    dealt = map_batches(fps.select(*columns), deal, "key long, data binary").repartition(n, "key").sortWithinPartitions("key")
    return map_batches(dealt, together(gather), schema)


def together(f: Callable, rows: int = 50_000) -> Callable:
    """f with its small results joined to batches of about `rows` rows."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list] = {}
        n = 0
        for out in f(batches):
            for c, x in out.items():
                held.setdefault(c, []).append(x)
            n += len(next(iter(out.values())))
            if n >= rows:
                yield {c: np.concatenate(x) for c, x in held.items()}
                held, n = {}, 0
        if n:
            yield {c: np.concatenate(x) for c, x in held.items()}

    return run


def links(fps: DataFrame, distinct: int, bits: int = 4) -> DataFrame:
    """(a, b) with b < a as unsigned numbers: links between different fingerprints that leave every component whole.

    fps: different fingerprints, one to a row, column fp.
    """

    def each(rows: np.ndarray):
        a, b = spanning(np.unique(rows[:, 0].view(np.uint64)), bits)
        if len(a):
            yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    return meet(fps, ["fp"], distinct, bits, each, "a long, b long").distinct()


# --- components ------------------------------------------------------------------------------------------------------


def components(pairs: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """(node, root): for each node of the links (a, b), the smallest node (signed order) of its connected component.

    Alternates large-star and small-star steps; the links of each step are written in the shared folder, nothing is
    collected but a count and a checksum. The least neighbours are written before they are joined, so that a node with very many
    neighbours can be split over tasks.
    """
    spark = pairs.sparkSession
    now, held = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{folder}/links0"), 0

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    for k in range(1, most):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{folder}/large{k}")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), f"{folder}/between{k}")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{folder}/small{k}")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        now, last = written(small, f"{folder}/links{k}"), held
        held = k
        for done in (f"large{k}", f"between{k}", f"small{k}", f"links{last}"):
            drop(spark, f"{folder}/{done}")
        if (after := state(now)) == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return spark.read.schema(now.schema).parquet(f"{folder}/links{held}").select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, words: int = 4, bits: int = 4, folder: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable, itself included)."""
    folder = folder or shared_dir(docs.sparkSession)
    prints = written(fingerprints(docs, words), f"{folder}/prints")
    codes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/codes")
    roots = components(links(codes.select("fp"), codes.count(), bits), f"{folder}/stars")
    # One row for each fingerprint. What is aggregated is written before it is joined, so either join deals out rows of its own
    # and Spark can split a component or a fingerprint that holds very many of them.
    rooted = written(codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), f"{folder}/rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), f"{folder}/least")
    named = written(rooted.join(least, "root").select("fp", "component_id"), f"{folder}/named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
