import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landlace.llm import decontam, ngrams, pii

# --- decontamination -------------------------------------------------------------------------------------------------


def edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return min(row)


@given(st.binary(min_size=1, max_size=90), st.binary(max_size=120))
@settings(max_examples=60, deadline=None)
def test_myers(p, t):
    assert decontam.myers(p, t)[0] == edit(p, t)


def test_edited_passages_are_found():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(200)]
    items = [" ".join(r.choice(words) for _ in range(r.randint(8, 60))).encode() for _ in range(40)]
    block = decontam.Items(list(range(40)), items)
    for _ in range(150):
        k = r.randrange(40)
        passage = bytearray(items[k])
        for _ in range(r.randint(0, decontam.budget(len(passage)))):
            at = r.randrange(len(passage))
            kind = r.random()
            if kind < 0.4:
                passage[at] = ord(r.choice("xyz "))
            elif kind < 0.7:
                del passage[at]
            else:
                passage.insert(at, ord(r.choice("xyz ")))
        text = b" ".join([" ".join(r.choice(words) for _ in range(20)).encode(), bytes(passage), b"and the rest"])
        found = {x[1]: x for x in block.find([b"", text])}
        assert found[k][0] == 1 and found[k][2] == edit(items[k], text)
    clean = [" ".join(r.choice(words) for _ in range(80)).encode() for _ in range(200)]
    got = {(d, i) for d, i, *_ in block.find(clean)}
    assert got == {(d, i) for d, t in enumerate(clean) for i, p in enumerate(items) if edit(p, t) <= decontam.budget(len(p))}


def test_whole_benchmark(spark, sf, documents):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = decontam.contaminated(documents, bench).collect()
    texts = {r["doc_id"]: decontam.normal(r["text"]) for r in documents.collect()}
    items = {r["item_id"]: decontam.normal(r["text"]) for r in bench.collect()}
    exact = {(d, i) for d, t in texts.items() for i, p in items.items() if p in t}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in got}
    assert all(edit(items[r["item_id"]], texts[r["doc_id"]][max(0, r["upto"] - 2 * r["item_bytes"]) : r["upto"]]) == r["distance"] for r in got)
    small = [tuple(sorted(map(tuple, decontam.contaminated(documents, bench).collect()))), tuple(sorted(map(tuple, _in_blocks(documents, bench).collect())))]
    assert small[0] == small[1]
    kept = decontam.clean(documents, bench)
    assert kept.columns == documents.columns and {r[0] for r in kept.select("doc_id").collect()} == set(texts) - {r["doc_id"] for r in got}


def _in_blocks(documents, bench):
    size = decontam.blocks.__defaults__
    decontam.blocks.__defaults__ = (*size[:2], 2_000)
    try:
        return decontam.contaminated(documents, bench)
    finally:
        decontam.blocks.__defaults__ = size


def test_odd_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "lorem ipsum dolor lorem ipsum dolor"), (4, "ONE two  three four five six seven eight"), (None, "another text under the same id")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contaminated(odd, bench).collect()}
    assert got == {(7, 4, 0), (4, None, 0)}  # the last one is short and stands there word for word; the others are too far off
    assert decontam.contaminated(odd, bench, least=20).where("item_id is null and doc_id = 4").count() == 1
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert decontam.clean(odd, bench).count() == odd.count() - 2
    spaced = decontam.clean(odd.withColumnRenamed("fp", "my col"), bench)
    assert "my col" in spaced.columns and spaced.count() == odd.count() - 2


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "so What is  the capital of france? yes"), (2, "what is the capital of france?s"), (3, "paris"), (4, "in paris. or paris")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Paris"), (2, "Paris")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"], r["from"], r["upto"]) for r in decontam.contaminated(docs, bench).collect())
    assert got == [(1, 1, 0, 3, 33), (3, 2, 0, 0, 5), (3, 2, 0, 0, 5), (4, 2, 0, 13, 18), (4, 2, 0, 13, 18)]


def test_equal_items_are_one(spark, documents):
    text = documents.where("length(text) > 200").first()["text"][:150]
    bench = spark.createDataFrame([(i, text) for i in range(3000)], "item_id long, text string")
    assert [len(b.texts) for b in decontam.blocks(bench, size=2_000)] == [1]
    one = documents.where(documents.text.startswith(text)).limit(1)
    assert decontam.contaminated(one, bench).count() == 3000


# --- language model --------------------------------------------------------------------------------------------------


def plain_scores(texts):
    toks = [(t or "").lower().split() for t in texts]
    c, n = Counter(), sum(map(len, toks))
    for t in toks:
        for k in (1, 2, 3):
            c.update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
    out = []
    for t in toks:
        own = Counter(tuple(t[i : i + k]) for k in (1, 2, 3) for i in range(len(t) - k + 1))
        left, s = lambda x: c[x] - own[x], 0.0  # noqa: E731, B023
        rest = n - len(t)
        for i in range(len(t)):
            f = 1.0
            for k in range(min(3, i + 1), 0, -1):
                x = tuple(t[i - k + 1 : i + 1])
                if left(x) > 0:
                    s += math.log(f * left(x) / (left(x[:-1]) if k > 1 else rest))
                    break
                f *= 0.4 if k > 1 else 1
            else:
                s += math.log(f / (rest + 1))
        out.append((len(t), s))
    return out


def check_scores(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = sorted(((d, n, round(s, 3)) for (d, _), (n, s) in zip(rows, plain_scores([t for _, t in rows]), strict=True)), key=repr)
    got = ngrams.score(df).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], round(r["log_score"], 3)) for r in got), key=repr) == want
    assert all((r["mean_log_score"] is None) == (r["n_tokens"] == 0) for r in got)


def test_scores(documents):
    check_scores(documents)


def test_odd_scores(spark, odd, empty, tmp_path):
    odd.where("doc_id <> 10").write.parquet(str(tmp_path / "odd"))
    check_scores(spark.read.parquet(str(tmp_path / "odd")))
    assert ngrams.score(empty).count() == 0


def test_many_blocks(spark, documents, monkeypatch):
    whole = sorted(map(tuple, ngrams.score(documents.repartition(1)).collect()))
    monkeypatch.setattr(ngrams, "RANGE", 10_000)
    assert sorted(map(tuple, ngrams.score(documents).collect())) == whole


def test_levels_of_counting(documents, monkeypatch):
    """Ranges far beyond what a block is cut into at once: counts go through several levels, and come out the same."""
    docs = documents.repartition(3)
    whole = sorted(map(tuple, ngrams.score(docs).collect()))
    monkeypatch.setattr(ngrams, "RANGE", 10_000)
    monkeypatch.setattr(ngrams, "BLOCK", 40_000)
    assert sorted(map(tuple, ngrams.score(docs, fan=5).collect())) == whole


@given(st.lists(st.integers(0, 2**63), max_size=50))
def test_packed(x):
    assert ngrams.unpacked(ngrams.packed(np.array(x, np.uint64))).tolist() == x


def test_long_text_hashes(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)).encode()
    whole = ngrams.word_hashes(text)
    assert len(set(whole.tolist())) == 3000
    monkeypatch.setattr(ngrams, "SEGMENT", 1000)
    assert (ngrams.word_hashes(text) == whole).all()


# --- personal data ---------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    count = lambda s: len(re.sub("[^0-9]", "", s))
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(t) if 16 <= count(m.group()) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= count(m.group()) <= 15]


@given(st.text("a1.2@+ -0(9)é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans(t):
    assert pii.base_spans(t) == plain_spans(t)


@pytest.fixture(scope="module")
def model(documents):
    return pii.fit(documents)


def test_spans_of_documents(documents, model):
    got = {r["doc_id"]: r for r in pii.find(documents, model).collect()}
    for r in documents.collect():
        base = plain_spans(r["text"])
        assert got[r["doc_id"]]["base"] == pii.joined(base)
        assert set(pii.joined(base).split(",")) <= set(got[r["doc_id"]]["spans"].split(",")) | {""}


def test_added_spans(model):
    text = "write to jane.doe (at) example (dot) com or call (555) 123-4567; order 4929123456781234 of 2024-01-02"
    base, every = model.spans(text)
    found = {text[a:z] for _, a, z in every}
    assert base == [] and "jane.doe (at) example (dot) com" in found
    assert not any("2024" in x for x in found)
    assert model.spans("mail a.b@c.org, host 10.1.2.3, card 4111 1111 1111 1111, tel +1 (555) 123-4567")[0] == model.spans("mail a.b@c.org, host 10.1.2.3, card 4111 1111 1111 1111, tel +1 (555) 123-4567")[1]


def test_numbers_side_by_side(model):
    found = lambda t: {(pii.KINDS[k], t[a:z]) for k, a, z in model.spans(t)[1]}
    assert {("card", "7536784127813050"), ("card", "4845168114407329")} <= found("sent 7536784127813050 4845168114407329 today")
    assert {("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")} <= found("see +1 (826) 555-4081 190.137.223.204 there")
    r, row = random.Random(5), []
    while len(row) < 12:  # cards whose neighbours make no further valid number with them
        more = [*row, *("".join(r.choice("0123456789") for _ in range(4)) for _ in range(4))]
        if all(pii.luhn("".join(more[i : i + 4])) == (i % 4 == 0) for i in range(len(more) - 3)):
            row = more
    cards = [" ".join(row[i : i + 4]) for i in range(0, 12, 4)]
    assert {("card", c) for c in cards} <= found("list: " + " ".join(cards) + " end")
    long = "1 " * 20_000
    assert len(pii.candidates(long, [])) < 20 * 20_000


def test_spelt_addresses():
    long = "a" * 80
    for t in ("jane (At)example(Dot)com", "jane{at}host{dot}com", f"{long} (at) {long} dot b dot c dot d dot e dot f dot g"):
        assert pii.spelt(f"to {t}, now") == [(3, 3 + len(t))]
    assert pii.spelt("met at noon dot") == [] and pii.spelt("a at b dot c at d dot e") == [(0, 12)]
    for t in (" at" * 100_000, "a" * 100_000 + " at " + "b" * 100_000, "x(at)" * 50_000):
        assert pii.spelt(t) == []


def test_masking(model):
    assert pii.masked("a x@y.zz b", [(0, 2, 8)]) == "a [EMAIL] b"
    assert pii.masked("0123456789", [(2, 1, 6), (3, 4, 8)]) == "0[CARD]89"


def test_odd_pii(odd, empty, model):
    assert pii.find(odd, model).where("spans <> ''").isEmpty() and pii.find(odd, model).count() == 13
    assert pii.find(empty, model).count() == 0
    out = pii.redact(odd, model)
    assert out.columns == odd.columns and out.where("doc_id = 1 and text is null").count() == 1
    for t in ("9" * 200_000, "1." * 100_000, "a" * 100_000 + "@", "+1" * 50_000, "a@" * 50_000):
        assert pii.base_spans(t) == [] or t.startswith("1.")


def test_boosting_learns():
    from landlace.llm.boosting import Boosted

    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = Boosted().fit(x[:1000], y[:1000]).predict(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.93
