"""Interleaved document sequences: HTML becomes ordered text and media references, digests resolve to payloads.

sequences()  page -> one row for each element: position, kind (text or media), text, ref, caption. Positions count all elements
             of a page from 0 in document order, and a caption stays with the medium it describes.
put()        payloads -> a store of media, each as an 8-bit greyscale PNG of width 576 that holds the payload's bytes.
described()  the store's media, read back: payload and stored digests, sizes and features, one row for each digest.
resolve()    media references joined to what they refer to, by digest.

A payload is padded with bytes 255 to a positive multiple of the image's width. The digest that a page refers to is the SHA-256 of
the padded payload.

Defined cases: a null or empty page has no elements, a null payload is an empty one; broken HTML is read as far as it goes; a
reference that the store lacks stays, with null media columns; equal payloads are one medium; repeated rows each give theirs;
empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landlace.llm.common import chunks, map_batches, shared_dir, written

WIDTH, PAD, TAIL, LEVEL = 576, 255, 32, 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Elements that end a run of text, that hold none, and that refer to media.
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset("script style noscript template title".split())
MEDIA = frozenset("img video audio source embed".split())


class _Reader(HTMLParser):
    """Elements of one page in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []  # kind, text, ref, caption
        self.text: list[str] = []
        self.silent, self.caption, self.figure = 0, None, []

    def flush(self) -> None:
        if self.caption is None and (t := " ".join("".join(self.text).split())):
            self.out.append(["text", t, None, None])
        if self.caption is None:
            self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.silent = 0  # whatever the head left open ends here
        elif tag in SILENT:
            self.silent += 1
        elif tag in ("figcaption", "figure"):
            if self.caption is not None:  # one that was left open
                self.close_caption()
            self.flush()
            if tag == "figure":
                self.figure.append(len(self.out))
            else:
                self.caption = []
        elif tag in MEDIA and (ref := dict(attrs).get("src") or dict(attrs).get("data-src")):
            self.flush()
            self.out.append(["media", None, ref.strip(), " ".join((dict(attrs).get("alt") or "").split()) or None])
        elif tag in BREAKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("figcaption", "figure", "body", "html") and self.caption is not None:  # a caption ends with its figure at the latest
            self.close_caption()
        elif tag in BREAKS:
            self.flush()
        if tag == "figure" and self.figure:
            self.figure.pop()

    def close_caption(self) -> None:
        caption, self.caption = " ".join("".join(self.caption).split()) or None, None
        own = [e for e in self.out[self.figure[-1] if self.figure else len(self.out) - 1 :] if e[0] == "media"]
        if own and caption:
            for e in own:
                e[3] = caption
        elif caption:
            self.out.append(["text", caption, None, None])

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def elements(html: str | None) -> list[list]:
    """[kind, text, ref, caption] in document order."""
    own = _Reader()
    own.feed(html or "")
    own.close()
    if own.caption is not None:
        own.close_caption()
    own.flush()
    return own.out


def sequences(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, position, kind, text, ref, caption) for each element of each page, and the page's `carry` columns."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", *carry)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, by="html"):
            found = [elements(html) for html in b.column("html").to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            kind, text, ref, caption = zip(*(e for x in found for e in x), strict=True) if len(of) else ((), (), (), ())
            out = {"position": [i for x in found for i in range(len(x))], "kind": list(kind), "text": list(text), "ref": list(ref), "caption": list(caption)}
            yield out | {c: b.column(c).take(pa.array(of)) for c in ("page_id", *carry)}

    elements_ = T._parse_datatype_string("page_id long, position int, kind string, text string, ref string, caption string")
    return map_batches(own, run, T.StructType([*elements_.fields, *(own.schema[c] for c in carry)]))


def interleaved(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id and elements, one row for each page: its ordered array of (position, kind, text, ref, caption, media_sha256, media_bytes).

    The elements are resolved by digest (`found` as described() gives it). Only media references are joined; texts go
    past the join. A page is gathered from its own elements, which parsing had in one row before; a page without elements has an empty array.
    """
    spark = pages.sparkSession
    own = pages.select("page_id", "html").withColumn("row", F.monotonically_increasing_id())
    shown = written(sequences(own, ("row",)), f"{shared_dir(spark)}/elements")
    none = (F.lit(None).cast("string").alias("media_sha256"), F.lit(None).cast("long").alias("media_bytes"))
    media = resolve(shown.where("kind = 'media'"), found).select(*shown.columns, "media_sha256", "media_bytes")
    every = media.unionByName(shown.where("kind <> 'media'").select("*", *none))
    element = F.struct("position", "kind", "text", "ref", "caption", "media_sha256", "media_bytes")
    gathered = every.groupBy("page_id", "row").agg(F.sort_array(F.collect_list(element)).alias("elements"))
    blank = shown.select(F.col("row").alias("seen")).distinct()
    empty = own.select(F.col("page_id").cast("long").alias("page_id"), "row").join(blank, F.col("row") == F.col("seen"), "left_anti")
    return gathered.select("page_id", "elements").unionByName(empty.select("page_id", F.array().cast(gathered.schema["elements"].dataType).alias("elements")))


# --- media -----------------------------------------------------------------------------------------------------------


def padded(payload: bytes) -> bytes:
    return payload + bytes([PAD]) * (max(WIDTH, -(-len(payload) // WIDTH) * WIDTH) - len(payload))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A greyscale image of 8-bit samples, WIDTH wide; the payload's length is a multiple of that."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1)  # each line begins with its filter: none
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """The samples of an image that to_png made, with its checksums checked."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read here")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Shares of the 16 grey ranges in thousandths, and the mean grey of the whole."""
    x = np.frombuffer(samples, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return "-".join(map(str, shares.tolist())) + f":{int(x.sum(dtype=np.int64)) * 100 // len(x)}"


def put(payloads: DataFrame, path: str) -> None:
    """Write (key, payload bytes) as a store at `path`: key, ref, n_bytes, and the medium once for each digest and task."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[bytes] = set()  # digests of this task, 32 bytes each; what several tasks store is merged when it is read
        for b in chunks(batches, by="payload"):
            raw = [x or b"" for x in b.column("payload").to_pylist()]
            full = [padded(x) for x in raw]
            digests = [hashlib.sha256(x).digest() for x in full]
            media = []
            for d, x in zip(digests, full, strict=True):
                media.append(None if d in seen else to_png(x))
                if len(seen) < 1_000_000:
                    seen.add(d)
            yield {"key": b.column("key"), "ref": ["sha256:" + d.hex() for d in digests], "n_bytes": list(map(len, raw)), "media": media}

    map_batches(payloads.select("key", "payload"), run, "key long, ref string, n_bytes long, media binary").write.option("compression", "none").parquet(path)


STORED = "key long, ref string, n_bytes long, media binary"


def described(spark: SparkSession, path: str) -> DataFrame:
    """One row for each digest of the store, from its stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, by="media"):
            media = b.column("media").to_pylist()
            own = [from_png(x) for x in media]
            yield {
                "ref": b.column("ref"), "payload_bytes": list(map(len, own)), "payload_sha256": [hashlib.sha256(x).hexdigest() for x in own], "tail_crc32": [zlib.crc32(x[-TAIL:]) for x in own],
                "media_bytes": list(map(len, media)), "media_sha256": [hashlib.sha256(x).hexdigest() for x in media], "feature": [feature(x) for x in own],
            }

    columns = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = map_batches(spark.read.schema(STORED).parquet(path).where("media is not null").select("ref", "media"), run, f"ref string, {columns}")
    return rows.groupBy("ref").agg(F.min(F.struct(*[c.split()[0] for c in columns.split(", ")])).alias("own")).select("ref", "own.*")


def resolve(refs: DataFrame, found: DataFrame) -> DataFrame:
    """References with what they refer to, nulls where the store lacks it. The join is on the digest alone: a digest that very
    many pages share is one row of `found`, so Spark can split its references over tasks."""
    return refs.join(found, "ref", "left")


def text_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Each document's text as one medium of a page that shows it, stored, read back and resolved through the page.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption.
    """
    spark, folder = docs.sparkSession, folder or shared_dir(docs.sparkSession)
    put(docs.select(F.col("doc_id").cast("long").alias("key"), F.encode("text", "utf-8").alias("payload")), f"{folder}/media")
    stored = spark.read.schema(STORED).parquet(f"{folder}/media")
    page = F.concat(F.lit("<article><p>"), F.col("n_bytes").cast("string"), F.lit(" bytes</p><figure><img src='"), "ref", F.lit("'><figcaption>"), F.coalesce(F.col("key").cast("string"), F.lit("none")), F.lit("</figcaption></figure></article>"))
    shown = sequences(stored.select(F.col("key").alias("page_id"), page.alias("html"), "n_bytes"), ("n_bytes",))
    found = described(spark, f"{folder}/media")
    found.write.option("compression", "zstd").parquet(f"{folder}/described")
    return resolve(shown.where("kind = 'media'").withColumnRenamed("page_id", "doc_id"), spark.read.schema(found.schema).parquet(f"{folder}/described"))
