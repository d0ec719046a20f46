"""Language identification by unigrams over the pieces of a public vocabulary, with the segmentation summed out.

Each language has a probability for every piece of a fixed vocabulary. A word's probability is the sum over all its
segmentations into pieces (forward algorithm); a text's is the product over its words. Piece probabilities
come from expectation-maximisation: pieces are counted by how likely each segmentation makes them.

Words are runs of letters in lower case, with the vocabulary's word mark in front. Words of up to SHORT letters are summed many at
a time; longer ones one by one on a log scale, so no length under- or overflows. Work is linear in a text's length either way.

Defined cases: a null text or one without a letter is `und` with score 0; an empty learning sample predicts `und` for all;
ties take the language first in the alphabet; a repeated doc_id is predicted row by row; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.llm.common import chunks, drawn, is_held_out, map_batches
from landlace.llm.words import words

#: Documented bound of the learning sample, in rows, and the rows that each language has at least; their whole texts are taken.
SAMPLE_ROWS, LEAST_ROWS, ROUNDS = 2_500, 100, 3
SHORT, MARK = 24, "▁"
#: Log-probability of a single character that the vocabulary lacks.
UNKNOWN = -18.0


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, with or without its word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = {p.lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (p := model.id_to_piece(i))}
    return sorted(p for p in own if p == MARK or p.removeprefix(MARK).isalpha())


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...] = ()
    vocab: tuple[str, ...] = ()
    logp: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))  # piece by language; the last row is for what the vocabulary lacks
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scorer(self) -> Scorer:
        return Scorer(self)


class Pieces:
    """The vocabulary and all beginnings of its pieces as hash tables that arrays of substrings are looked up in at once."""

    BASE, MIX, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 1 << 64

    def __init__(self, vocab: list[str]):
        self.n, self.longest = len(vocab), max(map(len, vocab), default=1)
        number = {p[:k]: -2 for p in vocab for k in range(1, len(p))} | {p: i for i, p in enumerate(vocab)}
        keys, values = np.array([self.hash(p) for p in number], np.uint64), np.fromiter(number.values(), np.int32, len(number))
        self.tables, rest = [], np.arange(len(keys))
        while len(rest):  # what meets a taken slot goes to the next, smaller table
            bits = max(6, int(4 * len(rest)).bit_length())
            salt, shift = np.uint64((2 * len(self.tables) + 1) * self.MIX % self.WORD), np.uint64(64 - bits)
            slot, holder = (keys[rest] * salt) >> shift, np.full(1 << bits, -1)
            holder[slot[::-1]] = rest[::-1]
            key, of = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            key[slot], of[slot] = keys[holder[slot]], values[holder[slot]]
            self.tables.append((salt, shift, key, of))
            rest = rest[holder[slot] != rest]

    def hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * self.BASE + ord(c) + 1) % self.WORD
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash; -2 if it only begins one, -1 if it doesn't."""
        out = np.full(len(h), -1, np.int32)
        for salt, shift, key, of in self.tables:
            slot = (h * salt) >> shift
            np.copyto(out, of[slot], where=key[slot] == h)
        return out


class Long:
    """All pieces of one word of any length, summed position by position on a log scale."""

    def __init__(self, word: str, pieces: Pieces):
        chars = np.array([MARK + word]).view(np.uint32)
        self.size = len(chars)
        width = min(pieces.longest, self.size)
        upto = np.zeros(self.size + 1, np.uint64)
        base, add = pieces.BASE, (chars.astype(np.uint64) + np.uint64(1)).tolist()
        h = 0
        for i, c in enumerate(add, 1):
            h = (h * base + c) % pieces.WORD
            upto[i] = h
        self.piece = np.full((self.size + 1, width), -1, np.int32)  # by end and length less one
        for k in range(1, width + 1):
            found = pieces.find(upto[k:] - upto[:-k] * np.uint64(pow(base, k, pieces.WORD)))
            if k == 1:
                found[found < 0] = pieces.n
            self.piece[k:, k - 1] = np.maximum(found, -1)

    def steps(self, logp: np.ndarray):
        """(end, starts, pieces, their log probabilities) in order of the end."""
        for e in range(1, self.size + 1):
            k = np.flatnonzero(self.piece[e] >= 0)
            own = self.piece[e, k]
            yield e, e - 1 - k, own, logp[own]

    def forward(self, logp: np.ndarray) -> np.ndarray:
        alpha = np.zeros((self.size + 1, logp.shape[1]))
        for e, start, _, lp in self.steps(logp):
            x = alpha[start] + lp
            top = x.max(0)
            alpha[e] = top + np.log(np.exp(x - top).sum(0))
        return alpha

    def expected(self, logp: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """Add the expected piece counts, given how often the word occurs in each language."""
        alpha = self.forward(logp)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0.0
        for e, start, own, lp in reversed(list(self.steps(logp))):
            x = beta[e] + lp
            beta[start] = np.logaddexp(beta[start], x)
            np.add.at(out, own, counts * np.exp(np.minimum(0.0, alpha[start] + x - alpha[-1])))


class Lattice:
    """All pieces of many words, by word length: for each end position the starts, words and pieces that lead there."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.n, self.groups = len(words), []
        size = np.fromiter(map(len, words), np.int64, len(words))
        power = [np.uint64(pow(pieces.BASE, k, pieces.WORD)) for k in range(pieces.longest + 1)]
        self.long = [(i, Long(words[i], pieces)) for i in np.flatnonzero(size > SHORT).tolist()]
        for n in np.unique(size[size <= SHORT]).tolist():
            which = np.flatnonzero(size == n)
            chars = np.array([words[i] for i in which], f"<U{n}").view(np.uint32).reshape(len(which), n)
            chars = np.concatenate([np.full((len(which), 1), ord(MARK), np.uint32), chars], 1).T.astype(np.uint64) + np.uint64(1)
            upto = [np.zeros(len(which), np.uint64)]
            for c in chars:
                upto.append(upto[-1] * power[1] + c)
            steps: list[list] = [[] for _ in range(n + 1)]
            for start in range(n + 1):
                live = np.arange(len(which))
                for e in range(start + 1, min(n + 1, start + pieces.longest) + 1):
                    piece = pieces.find(upto[e][live] - upto[start][live] * power[e - start])
                    begins = piece != -1
                    if e == start + 1:
                        piece[piece < 0] = pieces.n
                    there = piece >= 0
                    if there.any():
                        steps[e - 1].append((start, live[there], piece[there]))
                    live = live[begins]
                    if not len(live):
                        break
            self.groups.append((which, steps))

    @staticmethod
    def forward(steps: list, count: int, p: np.ndarray) -> np.ndarray:
        """alpha[position, word, language] of words of one length."""
        alpha = np.zeros((len(steps) + 1, count, p.shape[1]))
        alpha[0] = 1.0
        for e, own in enumerate(steps, 1):
            for start, there, piece in own:
                alpha[e, there] += alpha[start, there] * p[piece]
        return alpha

    def whole(self, p: np.ndarray) -> np.ndarray:
        """log of the sum over segmentations, word by language."""
        out = np.zeros((self.n, p.shape[1]))
        for which, steps in self.groups:
            out[which] = np.log(self.forward(steps, len(which), p)[-1])
        logp = np.log(p) if self.long else p
        for i, word in self.long:
            out[i] = word.forward(logp)[-1]
        return out

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts by language, given how often each word occurs in each."""
        out = np.zeros_like(p)
        for which, steps in self.groups:
            alpha = self.forward(steps, len(which), p)
            share = counts[which] / alpha[-1]
            beta = np.zeros_like(alpha)
            beta[-1] = 1.0
            for e in range(len(steps), 0, -1):
                for start, there, piece in steps[e - 1]:
                    back = beta[e, there] * p[piece]
                    beta[start, there] += back
                    np.add.at(out, piece, back * alpha[start, there] * share[there])
        logp = np.log(p) if self.long else p
        for i, word in self.long:
            word.expected(logp, counts[i], out)
        return out


class Scorer:
    """Scores words once for each Python worker; what it keeps is bounded."""

    MOST = 600_000

    def __init__(self, m: Model):
        self.m, self.p, self.pieces = m, np.exp(m.logp), Pieces(list(m.vocab))
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(m.langs)), np.float64)

    def rows(self, new: list[str]) -> None:
        """Make room for new words and score them together."""
        if len(self.row) + len(new) > self.MOST:
            self.row, self.table = {}, self.table[:1024]
        at = len(self.row)
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:at], np.zeros((max(len(new), at), len(self.m.langs)))])
        for i in range(0, len(new), 16384):
            own = new[i : i + 16384]
            self.table[at + i : at + i + len(own)] = Lattice(own, self.pieces).whole(self.p)
        self.row.update(zip(new, range(at, at + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        found = [words(t) for t in texts]
        if self.m.langs and (new := set().union(*found).difference(self.row)):
            before = len(self.row)
            self.rows(sorted(new))
            if len(self.row) < before + len(new):  # what was kept went: score this batch's other words anew
                self.rows(sorted(set().union(*found).difference(self.row)))
        for own in found:
            if not self.m.langs or not any(c.isalpha() for w in own for c in w):  # digits of other kinds make words too
                langs.append("und"), scores.append(0.0)
                continue
            x = self.table[np.fromiter(map(self.row.__getitem__, own), np.int64, len(own))].sum(0) + self.m.prior
            best = int(x.argmax())
            langs.append(self.m.langs[best]), scores.append(float(1 / np.exp(x - x[best]).sum()))
        return langs, scores


def fit(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, least: int = LEAST_ROWS) -> Model:
    """Learn from text and non-null lang of about `rows` rows that aren't held out, `least` of each language, chosen by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    per_lang = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not per_lang:
        return Model()
    keep = F.lit(False)
    for lang, n in per_lang.items():
        keep = keep | ((F.col("lang") == lang) & drawn(F.col("doc_id"), max(least, rows / len(per_lang)) / n))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches):
            count: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                count.update((lang, w) for w in words(text))
            yield {"lang": [k[0] for k in count], "word": [k[1] for k in count], "n": list(count.values())}

    counted = map_batches(known.where(keep).select("lang", "text"), run, "lang string, word string, n long")
    got = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().sort_by([("word", "ascending"), ("lang", "ascending")])
    return learn(got.column("lang").to_pylist(), got.column("word").to_pylist(), got.column("n").to_pylist(), per_lang, pieces(path), rounds)


def learn(lang: list[str], word: list[str], n: list[int], per_lang: dict[str, int], vocab: list[str], rounds: int = ROUNDS) -> Model:
    langs = sorted(per_lang)
    col = {x: i for i, x in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for x, w, k in zip(lang, word, n, strict=True):
        counts.setdefault(w, np.zeros(len(langs)))[col[x]] += k
    table = Pieces(vocab)
    p = np.full((len(vocab) + 1, len(langs)), 1.0 / max(1, len(vocab)))
    p[-1] = np.exp(UNKNOWN)
    known = sorted(counts)
    lattices = [(Lattice(known[i : i + 20_000], table), np.stack([counts[w] for w in known[i : i + 20_000]])) for i in range(0, len(known), 20_000)]
    for _ in range(rounds):
        e = sum((own.expected(p, c) for own, c in lattices), np.zeros_like(p))[:-1] + 0.01
        p[:-1] = e / e.sum(0)
    prior = np.log(np.array([per_lang[x] for x in langs], float) / sum(per_lang.values()))
    return Model(tuple(langs), tuple(vocab), np.log(p), prior)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language, 0 for `und`) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary by languages: a few MB

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = _scorer(held)
        for b in chunks(batches):
            langs, scores = scorer.predict(b.column("text").to_pylist())
            yield {"doc_id": b.column("doc_id"), "lang_pred": langs, "score": scores}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


_last: list = []


def _scorer(held) -> Scorer:
    """The worker's scorer for a broadcast model, kept from task to task; one at a time."""
    model = held.value
    if not _last or _last[0] is not model:
        _last[:] = [model, model.scorer()]
    return _last[1]
