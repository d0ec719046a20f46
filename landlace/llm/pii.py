"""Personal data: generators propose overlapping spans, boosted trees judge them, calibrated thresholds select.

The base spans (fixed patterns with their checks) always stay. The generators also propose looser forms: addresses spelt
with at and dot, card and phone numbers with other separators or without a plus sign, dotted quads next to a port. Each
proposal has features of its format (digits, checksum, groups, separators) and its context (neighbouring characters and
words). The trees learn from proposals on a bounded sample of documents, where a base span of the same kind is the
positive class and one that can't be personal data the negative, and from formats that are written out for every kind;
proposals that may be either are left out. For each kind the threshold is the
lowest at which the calibration half reaches the wanted precision.

Positions are code points, ends exclusive. Defined cases: a null or empty text has no spans; a failing match is dropped
without a retry; long runs of digits or address characters are read in linear time; a repeated doc_id is read row by
row; an empty table gives no rows; further columns are ignored (or kept, by redact).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.llm.boosting import Boosted
from landlace.llm.common import chunks, drawn, is_held_out, map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

#: Documented bound of the sample the trees learn from, in rows, and the precision that each threshold has to reach.
SAMPLE_ROWS, PRECISION = 4_000, 0.99

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
AT = re.compile(r" ?[(\[{] ?at ?[)\]}] ?| at ", re.I).finditer
SPELT = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot )[A-Za-z0-9-]+)+", re.I).match
LOOSE = re.compile(r"\+?\(?[0-9](?:[ ().\-/ ]{0,2}[0-9])+").finditer
NEAR = [re.compile(p, re.I).search for p in (r"phone|tel|call|mobile|fax", r"card|visa|credit|account", r"\bip\b|host|server|addr", r"mail|contact|write", r"token|key|hash|id\b|no\.|number|order")]


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(own)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of local@domain, leftmost and non-overlapping, found from the at signs."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free, at = at + 1, text.find("@", at + 1)
    return out


def spelt(text: str) -> list[tuple[int, int]]:
    """Addresses with at and dot as words, of any length, found from the at: leftmost and non-overlapping."""
    out, free = [], 0
    for m in AT(text):
        start = m.start()
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start() and (host := SPELT(text, m.end())):
            out.append((start, host.end()))
            free = host.end()
        else:
            free = max(free, m.start())
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted parts, from chains of dotted numbers; parts of more than 255 fail."""
    out = []
    for m in DOTTED(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in four):
                out.append((start, end))
            start = end + 1
    return out


def base_spans(text: str | None) -> list[Span]:
    """All base spans, by kind and then start."""
    if not text:
        return []
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, z) for a, z in emails(text)]
    if not any(d in text for d in "0123456789"):
        return out
    if "." in text:
        out += [(1, a, z) for a, z in ips(text)]
    for m in CARD(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def numbers(run: str, at: int) -> list[Span]:
    """The parts of a run of numbers, `at` in its text, that begin and end at its groups of digits and have the digits of a kind.

    A part's digits are bounded, so the parts grow with the groups alone.
    """
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run)]
    out: list[Span] = []
    for i, (first, _) in enumerate(groups):
        digits = 0
        for k in range(i, len(groups)):
            a, z = first, groups[k][1]
            digits += z - groups[k][0]
            if digits > 19:
                break
            if not i:
                a = 0
            elif run[a - 1] == "(" and ")" in run[a:z]:
                a -= 1
            if z - a < 7:
                continue
            if 13 <= digits <= 19:
                out.append((2, at + a, at + z))
            if 7 <= digits <= 15:
                out.append((3, at + a, at + z))
            if 4 <= digits <= 12 and run.count(".", a, z) == 3:
                out.append((1, at + a, at + z))
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """The base spans and what the generators propose besides; they may overlap."""
    out = dict.fromkeys(base)
    out |= dict.fromkeys((0, a, z) for a, z in spelt(text))
    if any(d in text for d in "0123456789"):
        for m in LOOSE(text):
            if m.end() - m.start() >= 7:
                out |= dict.fromkeys(numbers(m.group(), m.start()))
    return sorted(out)


def features(text: str, span: Span) -> list[float]:
    kind, a, z = span
    s = text[a:z]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    before, after = text[max(0, a - 1) : a], text[z : z + 1]
    context = text[max(0, a - 40) : a]
    quads = s.split(".")
    return [
        kind, z - a, len(digits), float(bool(digits) and luhn(digits)), len(groups), max(groups), min(groups), float(len(set(groups)) == 1),
        len(set(digits)), float(s[:1] == "+"), s.count("("), s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count("@"),
        float(len(quads) == 4 and all(q.isdigit() and len(q) <= 3 and int(q) <= 255 for q in quads)),
        float(before.isalnum()), float(after.isalnum()), float(before in "=\"'_#-/." and before != ""), float(after in "=\"'_#-/" and after != ""),
        float(bool(re.search(r"[(\[{ ]at[)\]} ]", s, re.I))), float(bool(re.search(r"[(\[{ ]dot[)\]} ]", s, re.I))),
        *(float(bool(f(context))) for f in NEAR),
    ]


def plausible(text: str, span: Span) -> bool:
    """Whether a proposal outside the base may well be personal data: nothing says that it isn't, so it is no negative."""
    kind, s = span[0], text[span[1] : span[2]]
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p) <= 3 and int(p) <= 255 for p in re.findall("[0-9]+", s))
    return luhn(digits) if kind == 2 else s[0] in "+("


def written_out(n: int = 400, seed: int = 7) -> list[tuple[str, Span, int]]:
    """(text, span, class): for each kind formats that carry personal data, and look-alikes that don't."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def card(valid: bool) -> str:
        d = r.choice("3456") + digits(15)
        last = next(c for c in "0123456789" if luhn(d[:-1] + c))
        return d[:-1] + (last if valid else str((int(last) + r.randint(1, 9)) % 10))

    out = []
    for _ in range(n):
        c, p = card(True), (digits(3), digits(3), digits(4))
        sep = r.choice(["", " ", "-", ".", " "])
        name, host, tld = word(), word(), r.choice(["com", "org", "net", "de"])
        good = [
            (0, f"{name}.{digits(2)}@{host}.{tld}"), (0, f"{name} {r.choice(['(at)', '[at]', 'at'])} {host} {r.choice(['dot', '(dot)', '[dot]'])} {tld}"),
            (1, ".".join(str(r.randint(0, 255)) for _ in range(4))), (2, sep.join((c[:4], c[4:8], c[8:12], c[12:]))),
            (3, f"+{r.randint(1, 49)} ({p[0]}) {p[1]}-{p[2]}"), (3, f"({p[0]}) {p[1]}-{p[2]}"),
        ]
        x = card(False)
        bad = [
            (0, f"{word()} at {word()} dot the {word()}"), (1, ".".join([str(r.randint(256, 999)), *(str(r.randint(0, 999)) for _ in range(3))])),
            (2, sep.join((x[:4], x[4:8], x[8:12], x[12:]))), (2, digits(13)), (3, digits(r.randint(7, 15))), (3, f"{r.randint(1900, 2030)}-{digits(4)}"), (3, c), (3, ".".join(digits(3) for _ in range(4))),
        ]
        for label, own in ((1, good), (0, bad)):
            for kind, s in own:
                lead = f"{word()} {word()} " if r.random() < 0.8 else f"{word()} = \""
                out.append((f"{lead}{s} {word()}.", (kind, len(lead), len(lead) + len(s)), label))
    return out


class Taken:
    """Places that spans hold, to ask whether another one meets them."""

    def __init__(self, places: list[tuple[int, int]]):
        self.places: list[tuple[int, int]] = []
        for a, z in places:  # sorted; those that overlap become one
            if self.places and a < self.places[-1][1]:
                self.places[-1] = (self.places[-1][0], max(z, self.places[-1][1]))
            else:
                self.places.append((a, z))

    def free(self, s: Span) -> bool:
        k = bisect_left(self.places, (s[2],))
        return not k or self.places[k - 1][1] <= s[1]

    def add(self, s: Span) -> None:
        insort(self.places, s[1:])


@dataclass(frozen=True)
class Model:
    trees: Boosted
    thresholds: tuple[float, ...] = field(default=(2.0,) * len(KINDS))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Proposals that reach the threshold of their kind and meet no base span, best first, none overlapping another."""
        taken = sorted((a, z) for _, a, z in base)
        held = Taken(taken)
        open_ = [s for s in candidates(text, base) if held.free(s)]
        if not open_:
            return []
        p = np.concatenate([self.trees.predict(np.array([features(text, s) for s in open_[i : i + 20_000]])) for i in range(0, len(open_), 20_000)])
        out: list[Span] = []
        for k in np.argsort(-p, kind="stable"):
            s = open_[k]
            if p[k] >= self.thresholds[s[0]] and held.free(s):
                held.add(s)
                out.append(s)
        return out

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by kind and then start."""
        base = base_spans(text)
        return base, sorted(base + self.added(text, base)) if text else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on the proposals of about `rows` documents that aren't held out, chosen by a hash of the id, and the written-out formats."""
    total = docs.count()
    sample = docs.where(F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")) & drawn(F.col("doc_id").cast("long"), rows / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches):
            x, y = [], []
            for t in b.column("text").to_pylist():
                base = base_spans(t)
                known = set(base)
                for s in candidates(t, base):
                    if s in known or not plausible(t, s):
                        x.append(features(t, s))
                        y.append(int(s in known))
            yield {"x": x, "y": y}

    got = map_batches(sample.select("text"), run, "x array<double>, y int").toArrow()
    extra = written_out()
    x = got.column("x").to_pylist() + [features(t, s) for t, s, _ in extra]
    y = got.column("y").to_pylist() + [label for _, _, label in extra]
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    return learn(np.array([x[i] for i in order], float), np.array([y[i] for i in order], float))


def learn(x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Model:
    half = np.arange(len(y)) % 2 == 0
    trees = Boosted().fit(x[half], y[half])
    p, k, t = trees.predict(x[~half]), x[~half, 0], y[~half]
    thresholds = []
    for kind in range(len(KINDS)):
        order = np.argsort(-p[k == kind], kind="stable")
        own, right = p[k == kind][order], np.cumsum(t[k == kind][order])
        share = right / np.arange(1, len(own) + 1) if len(own) else np.zeros(0)
        last = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)  # equal scores stand or fall together
        good = np.flatnonzero(last & (share >= precision))
        thresholds.append(max(0.5, float(own[good[-1]])) if len(good) else 2.0)
    return Model(trees, tuple(thresholds))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base spans and all spans as text, and the number of base spans of each kind, for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches):
            both = [held.value.spans(t) for t in b.column("text").to_pylist()]
            out = {f"n_{kind}": [sum(s[0] == k for s in base) for base, _ in both] for k, kind in enumerate(KINDS)}
            yield out | {"doc_id": b.column("doc_id"), "base": [joined(x) for x, _ in both], "spans": [joined(x) for _, x in both]}

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, {counts}, base string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans by the kind of the first."""
    out, at = [], 0
    for k, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """All rows with all columns; texts masked, and n_chars, where there, their new length."""
    held, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches):
            out = {c: b.column(i) for i, c in enumerate(columns)}
            out["text"] = [masked(t, s) if t and (s := held.value.spans(t)[1]) else t for t in b.column("text").to_pylist()]
            if "n_chars" in out:
                out["n_chars"] = [None if t is None else len(t) for t in out["text"]]
            yield out

    return map_batches(docs, run, docs.schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
