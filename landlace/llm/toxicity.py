"""Toxicity classifier, regularised by counterfactuals: swapping a group's name must not change the score.

Features are the different words of a text and their beginnings of 4 to 6 letters, chosen by how far they are from chance
on the labelled sample. A logistic model is fitted with a penalty on the squared change of its score when an identity
term in a labelled text is swapped for another one of its set, or a neutral mention is put into a text that has none; so
a mere mention earns no weight, also where toxic texts mention a group more often.

Defined cases: a null or blank text has no features and scores the model's base rate; null labels are ignored; labels of
one class give that class for all rows; an empty table gives no rows; a repeated doc_id is scored row by row; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.llm.common import chunks, labelled_sample, map_batches
from landlace.llm.words import words

#: Documented bounds of the labelled sample, in rows and in bytes of text; the whole texts of these rows are taken.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 48_000_000
#: Names of groups that may be swapped for one another, by set.
IDENTITY = (
    "women men girls boys mujeres hombres femmes hommes frauen männer".split(),
    "black white asian african latino arab negro blanco noir blanc schwarze weiße".split(),
    "muslim christian jewish hindu buddhist atheist musulmán cristiano judío musulman chrétien juif moslem christ jude".split(),
    "gay straight lesbian bisexual transgender heterosexual homosexual".split(),
    "immigrants refugees foreigners citizens inmigrantes refugiados immigrés réfugiés flüchtlinge ausländer".split(),
    "disabled deaf blind elderly young behinderte anciano handicapé".split(),
)


def features(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings, marked so that they differ from words."""
    return (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    offset: float = 0.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, m: Model):
        self.m, self.starts = m, {f.rstrip("*")[:4] for f in m.weights}

    def score(self, text: str | None) -> float:
        starts = self.starts  # of few words: most are passed over without building their features
        likely = {w for w in words(text) if w[:4] in starts}
        found = {f for w in likely for f in features(w) if f in self.m.weights}
        x = self.m.offset + sum(self.m.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


#: Each identity term with the one it is swapped for: the next of its set.
PARTNER = {t: own[(k + 1) % len(own)] for own in IDENTITY for k, t in enumerate(own)}
TERMS = list(PARTNER)


def difference(text: set[str], gone: str | None, come: str) -> dict[str, float]:
    """Features of the text less features of the text with one word swapped (or put in): what both have, from whatever word, is no difference."""
    before = {f for w in text for f in features(w)}
    after = {f for w in (text - {gone}) | {come} for f in features(w)}
    return dict.fromkeys(before - after, 1.0) | dict.fromkeys(after - before, -1.0)


def counterfactuals(text: set[str], number: int) -> list[dict[str, float]]:
    """One difference for each identity term of a text; for a text that names no group, of a neutral mention (the number-th term)."""
    if named := sorted(text & PARTNER.keys()):
        return [difference(text, t, PARTNER[t]) for t in named]
    return [difference(text, None, TERMS[number % len(TERMS)])]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Learn from at most about `rows` labelled rows that aren't held out, and `size` bytes of text; workers reduce each text to its words."""
    sample, per_class = labelled_sample(docs, labels, "toxic", rows, size)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches):
            yield {"doc_id": b.column("doc_id"), "label": b.column("label"), "words": [sorted(set(words(t))) for t in b.column("text").to_pylist()]}

    got = map_batches(sample.select("doc_id", "label", "text"), run, "doc_id long, label int, words array<string>").orderBy("doc_id").toArrow()
    table = got.combine_chunks()
    lists = table.column("words").combine_chunks()
    words_ = pc.dictionary_encode(lists.values)
    vocab = words_.dictionary.to_pylist()
    ids, ends = words_.indices.to_numpy(), lists.offsets.to_numpy()
    y = np.array(table.column("label").to_pylist(), float)
    del got, table, lists, words_
    return learn(vocab, ids, ends, y, per_class.get(1, 0) / max(1, sum(per_class.values())))


def numbered(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(vocabulary, word numbers of all texts, where each text begins and the last ends)."""
    vocab = sorted({w for t in texts for w in t})
    at = {w: i for i, w in enumerate(vocab)}
    return vocab, np.array([at[w] for t in texts for w in t], int), np.cumsum([0, *map(len, texts)])


def learn(vocab: list[str], ids: np.ndarray, ends: np.ndarray, y: np.ndarray, toxic_share: float | None = None, swap: float = 10.0, ridge: float = 0.02, far: float = 5.0, most: int = 600, rounds: int = 25) -> Model:
    """Fit from texts as numbers of their different words: text k has ids[ends[k]:ends[k + 1]]."""
    if not len(y) or y.min() == y.max():
        return Model({}, 30.0 if len(y) and y.max() else -30.0)
    share = y.mean() if toxic_share is None else toxic_share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    n, n1 = len(y), y.sum()
    text = np.repeat(np.arange(n), np.diff(ends))
    named = {f for t in TERMS for f in features(t)}
    chosen: list[tuple[float, str]] = []
    kept: dict[str, np.ndarray] = {}
    # One kind of feature after another: words, then beginnings by length; each is a number of a text's words.
    for k in (None, 4, 5, 6):
        names = [w if k is None else f"{w[:k]}*" if len(w) >= k else "" for w in vocab]
        number: dict[str, int] = {}
        of = np.array([number.setdefault(f, len(number)) for f in names])
        pairs = np.unique(text * len(number) + of[ids])  # a feature counts once in a text
        where, what = pairs // len(number), pairs % len(number)
        seen, toxic = np.bincount(what, minlength=len(number)), np.bincount(what, y[where], len(number))
        p = seen / n
        chance = np.abs(toxic / n1 - (seen - toxic) / (n - n1)) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)) + 1e-12)
        order = np.argsort(what, kind="stable")
        cut = np.searchsorted(what[order], np.arange(len(number) + 1))
        for f, j in number.items():
            if f and ((seen[j] >= 8 and chance[j] >= far) or f in named):
                chosen.append((np.inf if f in named else chance[j], f))
                kept[f] = where[order[cut[j] : cut[j + 1]]]
        del names, number, of, pairs, where, what
    best = sorted(f for _, f in sorted(chosen, key=lambda c: (-c[0], c[1]))[: most + sum(f in named for _, f in chosen)])
    at = {f: i for i, f in enumerate(best)}
    x = np.zeros((n, len(at) + 1), np.float32)
    for f, i in at.items():
        x[kept[f], i] = 1.0
    x[:, -1] = 1.0
    # Differences of feature vectors under a swap; texts that name no group get a neutral mention of one.
    rows = []
    for r in range(n):
        own = {vocab[i] for i in ids[ends[r] : ends[r + 1]].tolist()}
        for d in counterfactuals(own, r):
            if d := {at[f]: v for f, v in d.items() if f in at}:
                rows.append(d)
    m = len(at)
    fixed = np.diag(np.append(np.full(m, ridge), 0.0))
    for d in rows:
        c, v = np.array(list(d), int), np.array(list(d.values()))
        fixed[np.ix_(c, c)] += 2 * swap * np.outer(v, v)
    w = np.append(np.zeros(m), np.log(share / (1 - share)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = fixed + 1e-9 * np.eye(m + 1)
        for a in range(0, n, 1000):  # in parts, so the weighted copy stays small
            part, curve = x[a : a + 1000], (weight * p * (1 - p))[a : a + 1000]
            h += (part * curve[:, None].astype(np.float32)).T @ part
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + fixed @ w)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return Model({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-3}, float(w[-1]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # features that passed the test on a bounded sample

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = held.value.scorer()
        for b in chunks(batches):
            s = [scorer.score(t) for t in b.column("text").to_pylist()]
            yield {"doc_id": b.column("doc_id"), "score": s, "predicted": [int(x >= threshold) for x in s]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")
