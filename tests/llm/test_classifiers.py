import numpy as np
import pytest
from pyspark.sql import functions as F

from landlace.llm import common, langid, quality, tokens, toxicity
from landlace.llm.words import RUNS, words


def test_words_are_the_pattern():
    import random

    r = random.Random(1)
    for _ in range(300):
        t = "".join(chr(r.choice([r.randrange(256), r.randrange(0x3000)])) for _ in range(50))
        assert words(t) == RUNS(t.lower())


def test_held_out_is_crc(spark):
    import zlib

    df = spark.range(200).select(common.is_held_out(F.col("id")).alias("h"))
    assert [r["h"] for r in df.collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)] == [common.held_out(i) for i in range(200)]


def scored(df, labels, label):
    held = df.where(common.is_held_out(F.col("doc_id"))).join(labels.where(F.col(label).isNotNull()), "doc_id")
    return [(r["predicted"], r[label]) for r in held.select("predicted", label).collect()]


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(docs, quality.fit(docs, labels))
    pairs = scored(out, labels, "quality")
    assert len(pairs) > 50 and np.mean([p == y for p, y in pairs]) > 0.9
    assert np.mean([p for p, y in pairs if y]) > 0.93
    assert out.count() == docs.count() and out.where("score < 0 or score > 1").isEmpty()


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    pairs = scored(out, labels, "toxic")
    assert np.mean([p == y for p, y in pairs]) > 0.9
    assert out.count() == docs.count() and out.where("score < 0 or score > 1").isEmpty()


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, langid.fit(docs, tokens.public_path("piece_bpe_32k.model")))
    right = out.join(docs.select("doc_id", "lang"), "doc_id").where(common.is_held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_odd_rows(odd, empty, documents, labels):
    q, t = quality.fit(documents, labels), toxicity.fit(documents, labels)
    lang = langid.fit(documents, tokens.public_path("piece_bpe_32k.model"))
    for df, n in ((odd, 13), (empty, 0)):
        for out in (quality.score(df, q), toxicity.score(df, t), langid.predict(df, lang)):
            rows = out.collect()
            assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, lang).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got
    assert all(r["predicted"] == 0 for r in quality.score(odd.where("doc_id <= 3"), q).collect())
    kept = quality.keep_good(odd, q)
    assert kept.columns == odd.columns and kept.where("doc_id <= 3").isEmpty()


def test_learning_from_nothing(empty, documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        assert quality.score(documents, quality.fit(documents, labels)).where("score <> 0.5").isEmpty()
        assert toxicity.score(documents, toxicity.fit(documents, labels)).where("predicted = 1").isEmpty()
    assert langid.predict(documents, langid.fit(empty, tokens.public_path("piece_bpe_32k.model"))).where("lang_pred <> 'und'").isEmpty()


def test_long_words_keep_their_languages():
    """No length runs out of the numbers' range, and both ways of summing agree."""
    vocab = langid.pieces(tokens.public_path("piece_bpe_32k.model"))
    assert max(map(len, vocab)) > 12 and "authentication" in {v.strip("▁") for v in vocab}
    table, r = langid.Pieces(vocab), np.random.default_rng(1)
    p = r.random((len(vocab) + 1, 3)) / len(vocab)
    p[-1] = np.exp(langid.UNKNOWN)
    for n in (20, 24, 25, 60, 1000):
        w = "".join(r.choice(list("abcdefghij"), n))
        whole = langid.Long(w, table).forward(np.log(p))[-1]
        assert np.isfinite(whole).all() and len(set(whole.tolist())) == 3
        if n <= langid.SHORT:
            assert np.allclose(whole, langid.Lattice([w], table).whole(p)[0])
    unknown = [langid.Lattice(["\u0e01" * n], table).whole(p)[0] for n in (38, 39, 45)]
    assert unknown[0][0] > unknown[1][0] > unknown[2][0]


@pytest.mark.parametrize("short", [24, 3, 0])
def test_forward_sums_all_segmentations(short, monkeypatch):
    vocab = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    table = langid.Pieces(vocab)
    p = np.random.default_rng(0).random((len(vocab) + 1, 2))
    at = {v: i for i, v in enumerate(vocab)}

    def total(s):
        if not s:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(s) + 1):
            if s[:k] in at:
                out += p[at[s[:k]]] * total(s[k:])
            elif k == 1:
                out += p[-1] * total(s[1:])
        return out

    monkeypatch.setattr(langid, "SHORT", short)
    given = ["ab", "aabb", "c", "abcab", "bababa"]
    got = langid.Lattice(given, table).whole(p)
    assert np.allclose(np.exp(got), [total("▁" + w) for w in given])
    # expected counts are the derivative of the log of the total by log p
    counts, eps = np.ones((len(given), 2)), 1e-6
    expected = langid.Lattice(given, table).expected(p, counts)
    for i in range(len(p)):
        q = p.copy()
        q[i] *= 1 + eps
        slope = (langid.Lattice(given, table).whole(q) - got).sum(0) / np.log(1 + eps)
        assert np.allclose(slope, expected[i], atol=1e-4)


def toxic_sample():
    """Toxic texts name a group more often than others do: without the penalty its name would look toxic."""
    r = np.random.default_rng(3)
    texts, y = [], []
    for k in range(600):
        bad = k % 3 == 0
        t = {f"w{j}" for j in r.integers(0, 40, 8)}
        if bad:
            t.add(["vile", "scum"][k % 2])
        if r.random() < (0.8 if bad else 0.05):
            t.add("women")
        texts.append(sorted(t))
        y.append(float(bad))
    return texts, np.array(y)


def test_counterfactual_penalty():
    texts, y = toxic_sample()
    fair, naive = (toxicity.learn(*toxicity.numbered(texts), y, swap=s) for s in (10.0, 0.0))
    moved = lambda m: abs(sum(m.weights.get(f, 0.0) for f in toxicity.features("women")))
    assert moved(naive) > 0.3 and moved(fair) < 0.1
    a, b = (fair.scorer().score(f"a neutral line on {g}") for g in ("women", "men"))
    assert abs(a - b) < 0.05 and a < 0.3
    assert fair.scorer().score("such vile things") > 0.5


def test_fit_is_the_least_of_the_objective():
    """Toxicity against a plain version: the objective is written out text by text, and no nearby model does better."""
    texts, y = toxic_sample()
    texts = texts[:150] + [["women", "men", "w1"], ["women", "womens"]]
    y = np.append(y[:150], [0.0, 1.0])
    m = toxicity.learn(*toxicity.numbered(texts), y, ridge=0.02, swap=10.0, rounds=60)
    names = sorted(m.weights)

    def objective(w, offset):
        value = 0.02 / 2 * sum(x * x for x in w.values())
        for k, t in enumerate(texts):
            has = lambda ws: sum(w.get(f, 0.0) for f in {f for x in ws for f in toxicity.features(x)})
            z = offset + has(t)
            value += np.log1p(np.exp(z)) - y[k] * z
            named = [x for x in t if x in toxicity.PARTNER]
            other = [[toxicity.PARTNER[x] if v == x else v for v in t] for x in named] or [[*t, toxicity.TERMS[k % len(toxicity.TERMS)]]]
            value += sum(10.0 * (has(t) - has(o)) ** 2 for o in other)
        return value

    best = objective(m.weights, m.offset)
    for f in names:
        for step in (-0.05, 0.05):
            assert objective(m.weights | {f: m.weights[f] + step}, m.offset) > best - 1e-4
    assert min(objective(m.weights, m.offset + step) for step in (-0.05, 0.05)) > best


def test_no_difference_where_the_partner_stands_already():
    d = toxicity.difference({"women", "men"}, "women", "men")
    assert set(d) == set(toxicity.features("women")) and set(d.values()) == {1.0}
    assert "wome*" not in toxicity.difference({"women", "womens"}, "women", "men")


def test_score_is_the_size_difference():
    """Quality against plain calls of the compressor."""
    import zstandard as z

    texts = [f"A good line, number {k}. It says little.".encode() for k in range(60)] + [f"BAD!! {k} BAD!!".encode() for k in range(60)]
    m = quality.learn(texts, np.array([1] * 60 + [0] * 60))
    text = "Some text. " * 700

    def size(part, raw):
        d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        return len(z.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress(part)) - quality.FRAME + 1

    raw = text.encode()
    parts = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)]
    s = [[size(view(p), d) for p in parts] for d, view in zip(m.dicts, (bytes, bytes, quality.shape, quality.shape), strict=True)]
    some = slice(None) if len(parts[-1]) >= quality.BLOCK // 4 else slice(len(parts) - 1)
    x = []
    for g, b in ((s[0], s[1]), (s[2], s[3])):
        x += [(sum(b) - sum(g)) / (sum(b) + sum(g)), min((j - i) / (j + i) for i, j in zip(g[some], b[some], strict=True))]
    rate = [np.log(i / (len(p) + 1)) for i, p in zip(s[0][some], parts[some], strict=True)]
    x += [np.log(sum(s[0]) / (len(raw) + len(parts))), min(rate), max(rate)]
    assert np.allclose(m.scorer().features(text), x)
    assert np.isclose(m.scorer().score(text), 1 / (1 + np.exp(-(np.dot(m.weights, x) + m.offset))))


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    whole, per = common.labelled_sample(docs, labels, "toxic", 10_000, 10**9)
    few, _ = common.labelled_sample(docs, labels, "toxic", 10_000, 40_000)
    assert whole.count() == sum(per.values()) == sum(not common.held_out(i) for i in range(400))
    assert sorted(r["count"] for r in few.groupBy("label").count().collect()) == [20, 20]
    assert 20 < common.labelled_sample(docs, labels, "toxic", 100, 10**9)[0].count() < 180
    far = spark.range(2_000_000).where(common.drawn(F.col("id"), 1e-5)).count()
    assert 5 <= far <= 50


def test_dictionaries_differ():
    import random

    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(20, 90)))
    good = lambda: line().capitalize() + "."
    bad = lambda: "!! ".join(line().upper().split())
    m = quality.learn([f().encode() for _ in range(80) for f in (good, good, bad, bad)], np.array([1, 1, 0, 0] * 80))
    s = m.scorer()
    assert np.mean([s.score(good()) >= 0.7 for _ in range(100)]) > 0.95 and np.mean([s.score(bad()) < 0.7 for _ in range(100)]) > 0.95
    assert s.features(" \n") is None and s.score(None) == s.score("") == m.blank


def test_dictionary_reaches_the_whole_of_all_texts():
    texts = [b"".join(b"<%d.%d>" % (k, i) for i in range(1200)) for k in range(300)]
    d = quality.dictionary(texts)
    assert len(d) <= quality.DICT_BYTES
    held = {tuple(map(int, x.split(b"."))) for x in __import__("re").findall(rb"<(\d+\.\d+)>", d)}
    assert max(k for k, _ in held) > 295 and max(i for _, i in held) > 1100 and np.mean([i < 100 for _, i in held]) < 0.2


def test_copies_count_once():
    texts, y = [b"good text %d." % k for k in range(60)] + [b"BAD!! %d" % k for k in range(60)], np.array([1] * 60 + [0] * 60)
    assert quality.learn(texts + texts[:1] * 500, np.append(y, [1] * 500), 0.5) == quality.learn(texts, y, 0.5)
