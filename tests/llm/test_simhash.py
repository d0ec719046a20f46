import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from landlace.llm import simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows):
    prints = [(d, plain_print(t)) for d, t in rows]
    codes = sorted({f for _, f in prints})
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in prints), key=repr)


def test_whole_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = simhash.classes(documents).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_classes(rows)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = simhash.classes(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_classes(rows)


def test_empty(empty):
    assert simhash.classes(empty).count() == 0


def clustered(r, n):
    codes = set()
    while len(codes) < n:
        base = r.getrandbits(64)
        codes |= {base ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (1 << 64) - 1 for _ in range(r.randrange(1, 30))}
    return np.array(sorted(codes), np.uint64)


def brute(codes, bits):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[:i] ^ codes[i]) <= bits).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {int(codes[i]): int(codes[find(i)]) for i in range(len(codes)) if find(i) != i}


def test_index_finds_every_link():
    r = random.Random(2)
    codes = clustered(r, 700)
    index = simhash.GrayIndex(codes)
    assert (simhash.gray_rank(index.codes)[1:] >= simhash.gray_rank(index.codes)[:-1]).all()
    got = {(int(index.codes[a]), int(index.codes[b])) for who, found in index.within(index.codes, 4, step=5000) for a, b in zip(who, found, strict=True)}
    want = {(int(a), int(b)) for a in codes for b in codes[np.bitwise_count(codes ^ a) <= 4]}
    assert got == want
    a, b = simhash.spanning(codes, 4, block=100)
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == brute(codes, 4)


def test_links_hold_components(spark):
    r = random.Random(4)
    codes = clustered(r, 400)
    df = spark.createDataFrame([(int(np.int64(np.uint64(c))) if c < 2**63 else int(c) - 2**64,) for c in codes.tolist()], "fp long")
    for distinct in (len(codes), 1 << 26):  # few blocks, and as many as far larger tables get
        stars = simhash.components(simhash.links(df, distinct), simhash.shared_dir(spark))
        got = {}
        for n, root in stars.collect():
            got.setdefault(root, set()).update((n % 2**64, root % 2**64))
        want = {}
        for n, root in brute(codes, 4).items():
            want.setdefault(root, set()).update((n, root))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "SAMPLED", 2)
    r = random.Random(5)
    base = r.getrandbits(64)
    codes = sorted({base ^ sum(1 << r.randrange(64) for _ in range(r.randrange(7))) & (1 << 64) - 1 for _ in range(400)})
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long").repartition(3)
    stars = simhash.components(simhash.links(df, len(codes)), simhash.shared_dir(spark))
    roots = {n % 2**64: root % 2**64 for n, root in stars.collect()}
    want = brute(np.array(codes, np.uint64), 4)
    parts = lambda m: sorted(sorted(c for c in codes if m.get(c, c) == x) for x in {m.get(c, c) for c in codes})
    assert parts(roots) == parts(want)


def test_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    stars = simhash.components(pairs, simhash.shared_dir(spark))
    assert stars.agg(F.max("root"), F.count("*")).first()[:] == (0, 300)
