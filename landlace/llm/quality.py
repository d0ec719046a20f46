"""Quality classifier by compression: zstandard with a dictionary of good text against one of bad text.

A text is cut into blocks of a few kilobytes, each compressed once with either dictionary, so that the dictionaries count
for the whole of a long text. The features are the normalised size difference (bad - good) / (bad + good) of the text and of its
shape (a second view with dictionaries of its own), over all blocks and in the worst block, and the size under the good
dictionary by the text's own: text that repeats itself is as small under either dictionary, so that no difference
shows it. A logistic curve fitted on labelled rows that the dictionaries did not see turns them into a score.

Defined cases: a null or empty text scores `blank`, below every threshold; rows without a label only get scored;
if the labels have one class only, all scores are that class; an empty table gives no rows; a repeated doc_id is scored
row by row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.llm.common import chunks, labelled_sample, map_batches

#: Documented bounds of the labelled sample, in rows and in bytes of text; the whole texts of these rows are taken.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 48_000_000
#: Bytes of a block and of a dictionary, zstandard level, and about what a frame costs besides its content.
BLOCK, DICT_BYTES, LEVEL, FRAME = 2_048, 112_640, 3, 9


#: The second view of a text: small letters and bytes of other scripts go, capitals become one letter, digits one digit.
SHAPE = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
NO_SHAPE = bytes([*range(97, 123), *range(128, 256)])


@dataclass(frozen=True)
class Model:
    """Two dictionaries for each view, good first, and the logistic curve over the features."""

    dicts: tuple[bytes, ...] = ()
    weights: tuple[float, ...] = ()
    offset: float = 0.0
    blank: float = 0.01
    constant: float | None = None

    def scorer(self) -> Scorer:
        return Scorer(self)


def shape(raw: bytes) -> bytes:
    return raw.translate(SHAPE, NO_SHAPE)


#: What the dictionaries are made of and compress: the text itself and its shape, with the bytes of their dictionaries.
VIEWS = ((bytes, DICT_BYTES), (shape, DICT_BYTES // 4))


class Scorer:
    def __init__(self, m: Model):
        import zstandard as z

        self.m, self.sizes = m, []
        for raw in m.dicts:
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.sizes.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress)

    def features(self, text: str | None) -> list[float] | None:
        """Normalised size differences (bad - good) / (bad + good) of either view, over the whole text and in its worst block, and
        the size under the good dictionary by the text's own; None for a blank text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw.strip():
            return None
        rows = []
        for i in range(0, len(raw), BLOCK):
            part = raw[i : i + BLOCK]
            views = [x for view, _ in VIEWS for x in [view(part)] * 2]
            rows.append([len(f(x)) - FRAME for f, x in zip(self.sizes, views, strict=True)] + [len(part)])
        r = np.array(rows, float) + 1
        s = r.sum(0)
        w = r if len(rows) == 1 or len(part) >= BLOCK // 4 else r[:-1]  # a short last block says little on its own
        diff = lambda m, g, b: (m[..., b] - m[..., g]) / (m[..., b] + m[..., g])
        views = range(0, 2 * len(VIEWS), 2)
        differences = [x for k in views for x in (diff(s, k, k + 1), diff(w, k, k + 1).min())]
        return [*differences, np.log(s[0] / s[-1]), np.log(w[:, 0] / w[:, -1]).min(), np.log(w[:, 0] / w[:, -1]).max()]

    def score(self, text: str | None) -> float:
        if self.m.constant is not None:
            return self.m.constant
        if (x := self.features(text)) is None:
            return self.m.blank
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.m.weights, x) + self.m.offset, -30, 30))))


def dictionary(texts: list[bytes], size: int = DICT_BYTES, piece: int = 512) -> bytes:
    """Raw dictionary content: all texts if they fit, else pieces at even distances over their joined bytes."""
    joined = b"\n".join(texts)
    if len(joined) <= size:
        return joined.ljust(8)
    starts = np.linspace(0, len(joined) - piece, max(1, size // (piece + 1))).astype(int)
    return b"\n".join(joined[a : a + piece] for a in starts.tolist())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and offset of a weighted logistic curve, by Newton steps on standardised features."""
    mean, sd = np.average(x, axis=0, weights=weight), x.std(0)
    sd[sd == 0] = 1.0
    a = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w, hold = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    hold[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + hold, a.T @ (weight * (p - y)) + hold @ w)
        w -= np.clip(step, -3, 3)
        if abs(step).max() < 1e-9:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] / sd) @ mean)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Learn from at most about `rows` labelled rows that aren't held out, and `size` bytes of text, the same number of each class."""
    sample, per_class = labelled_sample(docs, labels, "quality", rows, size)
    sample = sample.select("label", F.crc32(F.col("text").cast("binary")).alias("turn"), "text")
    got = sample.where(F.trim("text") != "").orderBy("turn", "text").toArrow()
    return learn([t.encode("utf-8", "surrogatepass") for t in got.column("text").to_pylist()], np.array(got.column("label").to_pylist(), int), per_class.get(1, 0) / max(1, sum(per_class.values())))


def learn(texts: list[bytes], y: np.ndarray, good_share: float | None = None) -> Model:
    """Every second different text goes into the dictionaries, the others calibrate; good_share: of good texts among all labelled."""
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.max()) if len(y) else 0.5)
    once = sorted({x: i for i, x in reversed(list(enumerate(zip(texts, y.tolist(), strict=True))))}.values())  # copies count once
    texts, y = [texts[i] for i in once], y[once]
    odd = np.arange(len(y)) % 2 == 1
    views = [[t for t, k, o in zip(texts, y, odd, strict=True) if k == v and o] for v in (1, 0)]
    dicts = tuple(dictionary(x, size) or b" " * 8 for view, size in VIEWS for x in [[view(t) for t in v] for v in views])
    scorer = Model(dicts).scorer()
    got = [(scorer.features(t.decode("utf-8", "replace")), k) for t, k, o in zip(texts, y, odd, strict=True) if not o]
    x, own = np.array([f for f, _ in got if f]), np.array([float(k) for f, k in got if f])
    share = own.mean() if good_share is None else good_share
    weight = np.where(own == 1, share / max(own.mean(), 1e-9), (1 - share) / max(1 - own.mean(), 1e-9))
    weights, offset = logistic(x, own, weight)
    return Model(dicts, tuple(weights.tolist()), offset)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = held.value.scorer()
        for b in chunks(batches):
            s = [scorer.score(t) for t in b.column("text").to_pylist()]
            yield {"doc_id": b.column("doc_id"), "score": s, "predicted": [int(x >= threshold) for x in s]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows that score at least the threshold, with all their columns, in one pass without a shuffle."""
    held, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = held.value.scorer()
        for b in chunks(batches):
            kept = b.filter(pa.array([scorer.score(t) >= threshold for t in b.column("text").to_pylist()], pa.bool_()))
            yield {c: kept.column(i) for i, c in enumerate(columns)}

    return map_batches(docs, run, docs.schema)
