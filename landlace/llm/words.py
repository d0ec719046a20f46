"""Words of a text: runs of letters in lower case, with a byte-wise way for texts of Latin letters."""

from __future__ import annotations

import re

RUNS = re.compile(r"[^\W\d_]+").findall
#: For each code point below 256: its small letter, or a space if it is no letter.
TABLE = bytes(ord(c.lower()) if RUNS(c := chr(b)) and ord(c.lower()) < 256 else 32 for b in range(256))


def words(text: str | None) -> list[str]:
    """All runs of letters, in lower case and in order; the same list as the pattern gives, of any text."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(TABLE).decode("latin-1").split()
    except UnicodeEncodeError:
        return RUNS(text.lower())
