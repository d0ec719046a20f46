import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landlace.llm import common, media, packing, tokens, tokenstore

# --- tokenizer -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return tokens.Words(tokens.public_path(), most=50)


@given(st.text(st.one_of(st.sampled_from("aB1 .'<|>é́ß²ªΣ\n\t\x1c\x85 日🙂ÀÿİŒ"), st.characters(codec="utf-8")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_librarys(encoder, t):
    assert np.frombuffer(encoder.ids(t), "<u4").tolist() == encoder.whole.encode(t, add_special_tokens=False).ids


def test_ids_of_documents(documents, encoder):
    texts = [r["text"] for r in documents.limit(60).collect()] + ["<|endoftext|> x<|startoftext|>", "it's we'll I'M", ""]
    for t in texts:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == encoder.whole.encode(t, add_special_tokens=False).ids
    assert len(encoder.runs) <= 50


# --- packing ---------------------------------------------------------------------------------------------------------


def check_packing(rows, docs, end, length=2048):
    """Every id in one piece, pieces with the right checksum, sequences gapless and of `length` ids at most; returns the share of padding."""
    encode = packing.with_end("word_bpe_49k.json", end)()
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(encode(t))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == sum(len(x) // 4 for x in want[d])
        if len(want[d]) > 1:
            continue
        ids, at = want[d][0], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) // 4
            assert p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])
            at += p["length"]
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return 1 - sum(p["length"] for p in rows) / (len(by_seq) * length)


def test_packing_documents(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    for df in (documents, documents.repartition(7)):
        rows = packing.pack(df, packing.with_end()).collect()
        assert check_packing(rows, docs, 1) < 0.05


def test_leftovers_level_by_level(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    rows = packing.pack(documents.repartition(30), packing.with_end(), group=3).collect()
    assert check_packing(rows, docs, 1) < 0.05 and len({-1 - r["sequence_id"] >> 58 for r in rows if r["sequence_id"] < 0}) > 1


def test_odd_packing(odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_packing(packing.pack(odd, packing.with_end()).collect(), docs, 1)
    assert packing.pack(empty, packing.with_end()).count() == 0


def test_online_windows():
    r, own = random.Random(2), packing.Online(64, 4, 8)
    sizes = [r.randint(1, 200) for _ in range(500)]
    for i, n in enumerate(sizes):
        own.add(i, b"\1\0\0\0" * n)
        assert len(own.held) <= 4 and all(sum(p[2] for p in w) < 64 for w in own.held.values())
    full = own.take()
    assert all(64 - 8 <= sum(p[2] for p in pieces) <= 64 for _, pieces in full)
    got = defaultdict(int)
    for p in [p for _, w in full for p in w] + [p for w in own.held.values() for p in w]:
        got[p[0]] += p[2]
    assert [got[i] for i in range(500)] == sizes


@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(sizes):
    bins = packing.fit_largest_first(np.array(sizes, np.int64), 64)
    if sizes:
        fill = np.bincount(bins, sizes)
        assert fill.max() <= 64 and (fill > 0).all()


# --- token files -----------------------------------------------------------------------------------------------------


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=80))
def test_bits(bits, ids):
    x = np.array([i & (1 << bits) - 1 for i in ids], np.uint32)
    packed = tokenstore.pack_bits(x, bits)
    assert len(packed) == -(-len(x) * bits // 8) and (tokenstore.unpack_bits(packed, len(x), bits) == x).all()


def test_file_random_access():
    r = np.random.default_rng(1)
    for bits in (5, 16, 17):
        ids, ends = r.integers(0, 1 << bits, 1000).astype(np.uint32), np.array([0, 10, 10, 700, 1000])
        f = tokenstore.File(tokenstore.encode_file([3, 4, None, 5, 6], ends, ids, bits, block=64))
        assert f.doc_ids.tolist() == [3, 4, tokenstore.NULL_ID, 5, 6]
        assert (f.doc(3) == ids[10:700]).all() and len(f.doc(2)) == 0
        for a, z in ((0, 1), (63, 65), (64, 64), (999, 1000), (130, 900)):
            assert (f.ids(a, z) == ids[a:z]).all()
    with pytest.raises(ValueError):
        tokenstore.pack_bits(np.array([9], np.uint32), 3)
    with pytest.raises(IndexError):
        f.ids(0, 1001)
    assert tokenstore.width(49_408) == 16 and tokenstore.width(65_537) == 17 and tokenstore.width(1) == 1


def check_store(df, docs):
    encode, at, want = packing.with_end("word_bpe_49k.json", 2)(), 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = encode(t)
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == want


def test_store(documents, odd, empty, monkeypatch):
    monkeypatch.setattr(tokenstore, "SHARD_IDS", 5_000)
    monkeypatch.setattr(tokenstore, "RANGE_BYTES", 30_000)
    encode = packing.with_end("word_bpe_49k.json", 2)
    for df in (documents, documents.repartition(5), odd):
        check_store(tokenstore.store(df, encode, 49_408), [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert tokenstore.store(empty, encode, 49_408).count() == 0


# --- media -----------------------------------------------------------------------------------------------------------


def test_sequences_align():
    html = """<html><head><title>t</title><style>p{}</style></head><body><p>one <b>two</b></p><figure><img src="a.png" alt="x"><figcaption>Cap &amp; A</figcaption></figure>
      <p>three<img src='b.png' alt='bee'>four</p><script>var p='<p>no</p>'</script><figure><video><source src="c.mp4"></video></figure><img><p>last"""
    assert media.elements(html) == [
        ["text", "one two", None, None], ["media", None, "a.png", "Cap & A"], ["text", "three", None, None], ["media", None, "b.png", "bee"], ["text", "four", None, None],
        ["media", None, "c.mp4", None], ["text", "last", None, None],
    ]
    assert media.elements(None) == media.elements("") == media.elements("<figure>") == []


def test_open_elements():
    """What HTML lets stay open: a head before its body, a caption before its figure's end."""
    assert media.elements("<head><title>t</title><body><p>hello") == [["text", "hello", None, None]]
    assert media.elements("<head><script>x<body>") == []  # a script has no end here, and so no body
    assert media.elements("<figure><img src=a><figcaption>cap</figure><p>later text<p>more") == [["media", None, "a", "cap"], ["text", "later text", None, None], ["text", "more", None, None]]
    assert media.elements("<figure><img src=a><figcaption>cap<figure><img src=b></figure>end") == [["media", None, "a", "cap"], ["media", None, "b", None], ["text", "end", None, None]]


def test_pages(spark, sf):
    """Text order against a plain reading of each page by patterns."""
    import html as entities
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = media.sequences(pages, ("url",)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["page_id"]].append(r)
    for p in pages.collect():
        own = sorted(by[p["page_id"]], key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own))) and all(r["url"] == p["url"] for r in own)
        bare = re.sub(r"(?is)<(script|style|noscript|template|title)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "", p["html"] or "")
        want = "".join(entities.unescape(re.sub(r"<[^>]*>", "", bare)).split())
        assert "".join("".join(x for x in (r["text"], None if r["kind"] == "text" else r["caption"]) if x) for r in own if r["kind"] == "text").replace(" ", "") == want or any(r["kind"] == "media" for r in own)
        assert sum(r["kind"] == "media" for r in own) == len(re.findall(r"(?i)<(?:img|video|audio|source|embed)\b[^>]*\ssrc=", bare))


def test_interleaved(spark):
    folder = common.shared_dir(spark)
    media.put(spark.createDataFrame([(1, bytearray(b"abc"))], "key long, payload binary"), f"{folder}/m")
    ref = "sha256:" + hashlib.sha256(media.padded(b"abc")).hexdigest()
    pages = spark.createDataFrame([(7, f"<p>x</p><figure><img src='{ref}'><figcaption>A</figure>y<img src='{ref}'><img src='gone'>"), (7, "<p>again"), (8, None), (None, "z")], "page_id long, html string")
    got = media.interleaved(pages, common.written(media.described(spark, f"{folder}/m"), f"{folder}/d")).collect()
    seen = sorted(((r["page_id"], [(e["position"], e["text"] or e["ref"], e["caption"], e["media_bytes"] is not None) for e in r["elements"]]) for r in got), key=repr)
    assert seen == sorted([(7, [(0, "x", None, False), (1, ref, "A", True), (2, "y", None, False), (3, ref, None, True), (4, "gone", None, False)]), (7, [(0, "again", None, False)]), (8, []), (None, [(0, "z", None, False)])], key=repr)


def test_resolve(spark):
    folder = common.shared_dir(spark)
    payloads = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"abc")), (3, None)], "key long, payload binary")
    media.put(payloads, f"{folder}/m")
    ref = lambda b: "sha256:" + hashlib.sha256(media.padded(b)).hexdigest()
    pages = spark.createDataFrame([(7, f"<p>x</p><img src='{ref(b'abc')}' alt='A'><img src='sha256:none'><p>y</p><img src='{ref(b'')}'>")], "page_id long, html string")
    out = media.resolve(media.sequences(pages).where("kind = 'media'"), media.described(spark, f"{folder}/m")).orderBy("position").collect()
    assert [(r["position"], r["caption"], r["payload_bytes"]) for r in out] == [(1, "A", 576), (2, None, None), (4, None, 576)]


def check_media(df, docs):
    got = defaultdict(list)
    for r in df.collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(docs)
    for d, t in docs:
        raw = (t or "").encode("utf-8", "surrogatepass")
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        sums = [(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in got[d]]
        png = media.to_png(full)
        assert (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), hashlib.sha256(png).hexdigest(), len(png), media.feature(full)) in sums


def test_text_media(documents, odd, empty):
    for df in (documents, odd):
        check_media(media.text_media(df), [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert media.text_media(empty).count() == 0


@given(st.binary(max_size=2000))
def test_png(payload):
    full = media.padded(payload)
    assert media.from_png(media.to_png(full)) == full
    broken = bytearray(media.to_png(full))
    broken[60] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        media.from_png(bytes(broken))
