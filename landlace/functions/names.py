"""Similarity of names as plain functions: longest common subsequences with the bits of one number as a column."""

from __future__ import annotations

import re
from functools import lru_cache

_OTHER, _SPACES = re.compile(r"[^a-z0-9 ]+"), re.compile(r"\s+")


def normal(s: str | None) -> str:
    return _SPACES.sub(" ", _OTHER.sub(" ", (s or "").lower())).strip()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    return 2.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best ratio among the common tokens and either side's common and own ones; 1 if all tokens of one side are common."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both = ta & tb
    if both and (ta == both or tb == both):
        return 1.0
    common = " ".join(sorted(both))
    full_a, full_b = (" ".join([*sorted(both), *sorted(own)]) for own in (ta - tb, tb - ta))
    return max(ratio(full_a, full_b), ratio(common, full_a) if both else 0.0, ratio(common, full_b) if both else 0.0)


@lru_cache(maxsize=100_000)
def owner_similarity(a: str | None, b: str | None) -> float:
    """Likeness of two owners' names from 0 to 1, forgiving initials, order, spelling and slipped spaces."""
    ta, tb = normal(a).split(), normal(b).split()
    if not ta or not tb:
        return 0.0

    def expanded(own: list[str], other: list[str]) -> list[str]:
        words: dict[str, str] = {}
        for w in other:
            if len(w) > 1:
                words.setdefault(w[0], w)
        return [words.get(t, t) if len(t) == 1 else t for t in own]

    ea, eb = expanded(ta, tb), expanded(tb, ta)
    sa, sb = " ".join(ea), " ".join(eb)
    loose = max(ratio("".join(sorted(ea)), "".join(sorted(eb))), ratio("".join(ea), "".join(eb))) * 0.97
    return max(token_sort(sa, sb), token_set(sa, sb) * 0.95, loose)
