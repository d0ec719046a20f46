"""Ids of a public tokenizer file, exactly as the tokenizers library gives them, with the work for a word done once.

A document made of plain characters (ASCII without the apostrophe, Latin letters of one code point) splits into runs of
letters, single digits and runs of marks, as the file's own pattern does; each run's ids come from the library's BPE model
and are kept. Other documents are cut at ASCII white space, and each part with any other character goes through the whole
library pipeline. Both are checked against the library on whole texts in the tests.
"""

from __future__ import annotations

import os
import re

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"
SPACE = " \t\n\r\x0b\x0c"
RUNS = re.compile(rf"[{LETTERS}]+|[0-9]|[{MARKS}]+").findall
PLAIN = bytes(b for b in range(256) if re.fullmatch(rf"[{LETTERS}0-9{MARKS}{SPACE}]", chr(b)))


def plain(text: str) -> bool:
    """Whether the text has plain characters alone and nothing that could begin a special token."""
    try:
        return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


def _byte_chars() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Runs(dict):
    """run -> its ids as little-endian unsigned 32-bit bytes; it stops growing at `most`, so memory is bounded."""

    def __init__(self, tokenize, most: int):
        super().__init__()
        self.tokenize, self.most, self.map = tokenize, most, _byte_chars()

    def __missing__(self, run: str) -> bytes:
        ids = np.array([x.id for x in self.tokenize(run.encode().decode("latin-1").translate(self.map))], "<u4").tobytes()
        if len(self) < self.most and len(run) <= 64:
            self[run] = ids
        return ids


class Words:
    """Encoder of texts with the file at `path`; `most` bounds the number of kept runs."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.runs = _Runs(self.model.tokenize, most)
        self.odd: dict[str, bytes] = {}

    def _odd(self, part: str) -> bytes:
        if (ids := self.odd.get(part)) is None:
            ids = np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.odd) < 50_000 and len(part) <= 64:
                self.odd[part] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """All ids of the text as little-endian unsigned 32-bit bytes; null or empty: none."""
        if not text:
            return b""
        get = self.runs.__getitem__
        if plain(text):
            return b"".join(map(get, RUNS(text.lower())))
        out = []
        for part in re.split(f"[{SPACE}]+", text):
            if part:
                out.append(b"".join(map(get, RUNS(part.lower()))) if plain(part) else self._odd(part))
        return b"".join(out)


_made: dict[str, Words] = {}


def words(path: str) -> Words:
    """The encoder for a file, one for each Python worker."""
    if path not in _made:
        _made[path] = Words(path)
    return _made[path]


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies; found on the machine that asks, as the path may differ there."""
    import public_tokenizers

    return public_tokenizers.path(name)
