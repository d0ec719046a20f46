"""Near-duplicates of whole texts: SimHash links, verified by exact Jaccard similarity, then components; one row of each stays.

Rows with equal shingle sets are one node. A node has two fingerprints: the bits that over half of its different shingles' hashes set, and the
same of the hashes scrambled. Two nodes are candidates if one of their fingerprints differs in `bits` bits at most, the upper 48 bits
of the other in SIDE_BITS, and the sizes allow the similarity. Two nodes of one component of candidates are linked if their sets have
a Jaccard similarity of `tenths` tenths or more, exactly.

Fingerprints of sets of similarity 0.8 differ in 9.7 of 64 bits on average; both in more than BITS for one pair in a hundred,
at 0.85 for one in a thousand. Such a pair is lost unless its texts are in one component of candidates through others.

Candidates come from the groups and the Gray-order index of `simhash`; a group gives each node's link to the first of its
component there, never its pairs. The texts of a component of candidates then meet in one task, which holds all its sets against one
another by lists of the nodes that have a shingle, and gives each node's link to the first of its class. A component of more than CELL shingles
is cut into parts by a hash, and each pair of parts is a task's work of its own, so that all its pairs still meet.

Defined cases: blank and null texts have the empty set and are copies of each other; a text of fewer words is one
shingle; of a component stays the row of the smallest doc_id (a null one last), then of the least hash of the text, and of rows equal in
both any one; rows of one doc_id with texts of different components all stay; an empty table gives no rows; further columns are kept. Sets
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landlace.llm.common import chunks, map_batches, schema_with, shared_dir, written
from landlace.llm.simhash import SEED, Forest, GrayIndex, components, key_of, majority, meet, shingle_hashes, together

BITS, SIDE_BITS, SIDE = 13, 15, np.uint64(0xFFFF)
#: Shingles of a component's sets from which it is cut into parts of about that many.
CELL = 2_000_000
#: Bytes of text in a bucket of the rows.
BUCKET_BYTES = 128_000_000
NODE, ROW, FP, SECOND, SIZE, DIGEST = (f"landlace_{x}" for x in ("node", "row", "fp", "second", "size", "digest"))


def number(raw: bytes) -> int:
    """A signed 64-bit hash."""
    from xxhash import xxh64_intdigest as xxh

    return int(np.uint64(xxh(raw, SEED)).view(np.int64))


def second(hashes: np.ndarray) -> int:
    """The fingerprint of the scrambled hashes."""
    return majority(key_of(1, hashes)) if len(hashes) else 0


def sides(other: Column, size: Column) -> Column:
    """The other fingerprint's upper 48 bits, and a thousand times the logarithm of the size in the lower 16."""
    return other.bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(F.round(1000 * F.ln(F.greatest(F.lit(1), size))).cast("long"))


def may_match(x: np.ndarray, y: np.ndarray, tenths: int) -> np.ndarray:
    """Whether other fingerprints and sizes (sides, unsigned) allow the similarity."""
    near = np.bitwise_count((x ^ y) & ~SIDE) <= SIDE_BITS
    return near & (np.abs((x & SIDE).astype(np.int64) - (y & SIDE).astype(np.int64)) <= 1000 * math.log(10 / tenths) + 1)


def with_nodes(docs: DataFrame, words: int, folder: str) -> DataFrame:
    """The rows with a number of their own, the hash of their shingle set, its size and fingerprints: written in buckets of that
    number, so that rows can be picked by it again and again without a shuffle of texts, and no bucket holds a group of copies."""
    spark, columns = docs.sparkSession, docs.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches):
            texts = b.column("text").to_pylist()
            sets = [np.unique(shingle_hashes(t, words)) for t in texts]
            out = {c: b.column(i) for i, c in enumerate(columns)} | {NODE: [number(h.astype("<u8").tobytes()) if len(h) else 0 for h in sets], SIZE: list(map(len, sets))}
            out |= {FP: np.array([majority(h) for h in sets], np.uint64).view(np.int64), SECOND: np.array([second(h) for h in sets], np.uint64).view(np.int64)}
            yield out | {DIGEST: [number((t or "").encode("utf-8", "surrogatepass")) for t in texts]}

    more = f"{NODE} long, {SIZE} long, {FP} long, {SECOND} long, {DIGEST} long"
    rows = map_batches(docs, run, schema_with(docs.schema, more)).withColumn(ROW, F.monotonically_increasing_id())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    name = f"landlace_rows_{uuid.uuid4().hex}"
    rows.repartition(n, ROW).write.bucketBy(n, ROW).option("path", folder).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose numbers are wanted; the numbers go to the rows' buckets."""
    return rows.join(wanted.hint("shuffle_hash"), ROW, "left_semi")


def stars(rows: np.ndarray, bits: int, tenths: int, block: int = 128, leaf: int = 32, span: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(node, first node of its component) for the candidates among a group's rows (fp, sides, node).

    Block by block of nodes in Gray order against the index's lowest nodes that can hold candidates, `span` of them at a time; what is in
    the block's own component by then needs no look.
    """
    index = GrayIndex(np.ascontiguousarray(rows[:, 0]).view(np.uint64), leaf)
    codes, side, node = index.codes, np.ascontiguousarray(rows[index.order, 1]).view(np.uint64), rows[index.order, 2]
    forest = Forest(len(codes))
    differ, count = np.empty(block * leaf * span, np.uint64), np.empty(block * leaf * span, np.uint8)
    for first in range(0, len(codes), block):
        last = min(len(codes), first + block)
        reached = index.reach(first, last, bits)
        reached = reached[reached >= first // leaf]
        for at in range(0, len(reached), span):
            columns = (reached[at : at + span, None] * leaf + np.arange(leaf)).ravel()
            columns = columns[: np.searchsorted(columns, len(codes))]
            own = forest.root[first:last]
            if (own == own[0]).all():
                columns = columns[forest.root[columns] != own[0]]
            if not len(columns):
                continue
            shape = (last - first, len(columns))
            x, n = (v[: shape[0] * shape[1]].reshape(shape) for v in (differ, count))
            np.bitwise_xor(codes[first:last, None], codes[None, columns], out=x)
            np.bitwise_count(x, out=n)
            hit = np.flatnonzero(n.ravel() <= bits)
            i, j = hit // shape[1] + first, columns[hit % shape[1]]
            ok = (i < j) & may_match(side[i], side[j], tenths)
            if ok.any():
                forest.join(i[ok], j[ok])
    linked = forest.root != np.arange(len(codes))
    return node[linked], node[forest.root[linked]]


def candidates(nodes: DataFrame, n: int, bits: int, tenths: int) -> DataFrame:
    """(a, b): links that leave the components of candidates whole; nodes: (fp, second, size, node)."""

    def each(rows: np.ndarray):
        a, b = stars(rows, bits, tenths)
        if len(a):
            yield {"a": a, "b": b}

    def by(own: str, other: str) -> DataFrame:
        marked = nodes.select(F.col(own).alias("fp"), sides(F.col(other), F.col("size")).alias("sides"), "node")
        return meet(marked, ["fp", "sides", "node"], n, bits, each, "a long, b long", most=65_536, agree=2)

    return by("fp", "second").union(by("second", "fp")).distinct()


def alike(sets: list[np.ndarray], tenths: int) -> np.ndarray:
    """For each set the first one of its class, by links of the wanted Jaccard similarity between any two; the sets are sorted hashes."""
    forest, size = Forest(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets))
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    first = np.concatenate([[True], every[order][1:] != every[order][:-1]])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(every))
    shingle = np.empty(len(every), np.int64)
    shingle[order] = np.cumsum(first) - 1
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(len(sets)):
        if (forest.root == 0).all():
            break
        own = shingle[at[i] : at[i + 1]]
        own = own[ends[own] - starts[own] > 1]
        n = ends[own] - starts[own]
        where = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = np.bincount(owner[where], minlength=len(sets))
        j = np.flatnonzero((same > 0) & (10 * same >= tenths * (size[i] + size - same)))
        j = j[j > i]
        if len(j):
            forest.join(np.full(len(j), i), j)
    return forest.root


def linked(members: DataFrame, words: int, tenths: int) -> DataFrame:
    """(a, b): each node with the first of its class in its group; members: (unit, cell, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for _, rows in groups(batches):
            if len(rows) > 1:
                root = alike([h for _, h in rows], tenths)
                node = np.array([n for n, _ in rows], np.int64)
                other = root != np.arange(len(rows))
                if other.any():
                    yield {"a": node[other], "b": node[root[other]]}

    def groups(batches: Iterator[pa.RecordBatch]):
        """((unit, cell), [(node, its set)]): texts become sets as they come."""
        now, held = None, []
        for b in chunks(batches):
            for unit, cell, node, text in zip(*(b.column(c).to_pylist() for c in ("unit", "cell", "node", "text")), strict=True):
                if held and (unit, cell) != now:
                    yield now, held
                    held = []
                now = (unit, cell)
                held.append((node, np.unique(shingle_hashes(text, words))))
        if held:
            yield now, held

    met = members.select("unit", "cell", "node", "text").repartition("unit", "cell").sortWithinPartitions("unit", "cell", "node")
    with small_batches(members.sparkSession):
        return map_batches(met, together(run), "a long, b long")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Batches of few rows for Python workers, as each row holds a whole text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def in_cells(members: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    """The members (unit, node, row, size) with a cell: 0, or for units of more than CELL shingles one for each pair of parts; whether there are any of these."""
    large = members.groupBy("unit").agg(F.sum("size").alias("all")).where(F.col("all") > CELL).select("unit", F.ceil(F.col("all") / CELL).cast("long").alias("parts"))
    large = written(large, f"{folder}/large")
    if large.isEmpty():
        return members.withColumn("cell", F.lit(0).cast("long")), False
    salted = members.join(large, "unit", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
    cell = F.least("salt", "other") * F.coalesce("parts", F.lit(1)) + F.greatest("salt", "other")
    return salted.withColumn("other", other).withColumn("cell", cell).select("unit", "node", "row", "size", "cell"), True


def classes(nodes: DataFrame, rows: DataFrame, words: int, tenths: int, bits: int, folder: str) -> DataFrame:
    """(node, root) for the nodes that are not the first of their class."""
    live = nodes.where("size > 0")
    found = components(candidates(live, live.count(), bits, tenths), f"{folder}/candidates")
    member = found.select(F.col("root").alias("unit"), "node").union(found.select("root", F.col("root").alias("node")).distinct())
    members = written(member.join(nodes.select("node", "size", F.col(f"best.{ROW}").alias("row")), "node").select("unit", "node", "row", "size"), f"{folder}/members")
    dealt, cut = in_cells(members, folder)
    texts = written(picked(rows.select(ROW, "text"), members.select(F.col("row").alias(ROW))).select(F.col(ROW).alias("row"), "text"), f"{folder}/texts")
    links = written(linked(dealt.join(texts, "row"), words, tenths), f"{folder}/alike")
    return components(links, f"{folder}/classes") if cut else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def dedup(docs: DataFrame, words: int = 5, tenths: int = 8, bits: int = BITS) -> DataFrame:
    """One row of each class, with the columns of docs. tenths: ten times the least Jaccard similarity that links two rows."""
    folder, columns = shared_dir(docs.sparkSession), docs.columns
    rows = with_nodes(docs, words, f"{folder}/rows")
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(DIGEST).alias("text"), F.col(ROW))
    nodes = rows.groupBy(F.col(NODE).alias("node")).agg(F.min(best).alias("best"), F.min(FP).alias("fp"), F.min(SECOND).alias("second"), F.min(SIZE).alias("size"))
    nodes = written(nodes, f"{folder}/nodes")
    roots = classes(nodes, rows, words, tenths, bits, folder)
    own = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("node"), "best")
    kept = own.groupBy("node").agg(F.min("best").alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
    return picked(rows, kept).select(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])
