"""Near-duplicates against all pairs: fingerprints of different shingles within some bits, and Jaccard similarity of 0.8 or more."""

import math
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from landlace.llm import simhash, similar

SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_marks(shingles):
    """Both fingerprints and the size's logarithm."""
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    top = lambda v: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in v) > len(v))
    second = [int(x) for x in simhash.key_of(1, np.array(h, np.uint64))]
    return top(h), top(second), math.log(max(1, len(h)))


def plain_kept(rows, bits=similar.BITS):
    """The smallest id of each class, None where a class has no other; one row each. bits=64: by similarity alone."""
    sets = [plain_set(t) for _, t in rows]
    marks = [plain_marks(s) for s in sets]

    def classes(linked):
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if linked(i, j):
                    root[find(i)] = find(j)
        return [find(i) for i in range(len(rows))]

    def near(i, j):
        (a, b, c), (x, y, z) = marks[i], marks[j]
        if sets[i] == sets[j] or not sets[i] or not sets[j]:
            return sets[i] == sets[j]
        first, other = a ^ x, b ^ y
        by = lambda v, w: v.bit_count() <= bits and (bits > 63 or (w >> 16).bit_count() <= similar.SIDE_BITS)
        return (by(first, other) or by(other, first)) and abs(c - z) < math.log(1.25) + 0.0015

    unit = classes(near)
    best = classes(lambda i, j: sets[i] == sets[j] or unit[i] == unit[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    least = {}
    for (d, _), k in zip(rows, best, strict=True):
        held = least.setdefault(k, d)
        least[k] = d if held is None else held if d is None else min(d, held)
    return sorted(least.values(), key=repr)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)


def test_whole_table(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    kept = corpus_pipeline.drop_copies(spark, documents, "")
    assert kept.columns == documents.columns and ids(kept) == plain_kept(rows)
    assert ids(kept) == plain_kept(rows, 64)  # by similarity alone: the fingerprints lose nothing here
    assert {1} <= set(ids(kept)) and 177 not in ids(kept)  # Jaccard 0.83; one fingerprint differs in 18 bits


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("cell", [300, 10**9])
def test_groups_and_a_common_line(spark, monkeypatch, cell):
    """A large group of near copies, a chain, exact copies, and one line that all texts hold; with large components and groups cut, and whole."""
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(simhash, "HOT", 40 if cell == 300 else 10**9)
    monkeypatch.setattr(simhash, "SAMPLED", 2)
    r = random.Random(cell)
    text = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    line, base, chain = text(12), text(80), text(60)
    rows = [edited(r, base, r.randrange(4)) for _ in range(60)] + [" ".join(base)] * 40
    for _ in range(15):
        chain[r.randrange(60)] = f"c{r.randrange(10**6)}"
        rows.append(" ".join(chain))
    rows += [" ".join(line + text(r.randrange(1, 40))) for _ in range(80)]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    assert ids(similar.dedup(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain_kept(rows)


def parts(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    return sorted(sorted(i for i in range(n) if find(i) == k) for k in {find(i) for i in range(n)})


def test_stars_hold_the_components():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 60).astype(np.uint64)
    codes = np.concatenate([base[k] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (60, 6)).astype(np.uint64), axis=1) for k in range(60)])
    side = np.where(r.random(len(codes)) < 0.5, 0, 500).astype(np.uint64)
    rows = np.stack([codes.view(np.int64), side.view(np.int64), np.arange(len(codes))], 1)
    for bits in (4, 9):
        near = (np.bitwise_count(codes[:, None] ^ codes[None]) <= bits) & (side[:, None] == side[None])
        a, b = similar.stars(rows, bits, 8)
        assert parts(len(codes), zip(a.tolist(), b.tolist(), strict=True)) == parts(len(codes), np.argwhere(near).tolist())


def test_alike_is_jaccard():
    r = random.Random(9)
    base = [r.sample(range(10_000), 40) for _ in range(8)]
    sets = [set(r.sample(b, r.randrange(33, 41))) | {r.randrange(10_000) for _ in range(r.randrange(4))} for b in base for _ in range(20)]
    r.shuffle(sets)
    got = similar.alike([np.array(sorted(s), np.uint64) for s in sets], 8).tolist()
    want = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 10 * len(a & b) >= 8 * len(a | b)]
    assert parts(len(sets), enumerate(got)) == parts(len(sets), want) and 8 < len(set(got)) < 160


def test_odd_rows(odd, empty):
    kept = similar.dedup(odd)
    assert kept.columns == odd.columns
    assert ids(kept) == plain_kept([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert "text without an id" in {r["text"] for r in kept.collect()} and "another text under the same id" in {r["text"] for r in kept.collect()}
    assert similar.dedup(empty).count() == 0
