"""Names and codes as columns: normal forms, land-use classes, similarity by longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from landlace.functions import names
from landlace.workers import ship

#: Codes of the land registers and the class each stands for.
LAND_USE = {
    "residential": "Residential", "res": "Residential", "r": "Residential", "dwelling": "Residential", "natham": "Residential",
    "commercial": "Commercial", "com": "Commercial", "c": "Commercial", "shop": "Commercial", "business": "Commercial",
    "mixed": "Mixed", "mix": "Mixed", "m": "Mixed", "res cum com": "Mixed",
}


def normal(c: Column) -> Column:
    """Lower case, anything but letters, digits and spaces as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), "\\s+", " "))


def cleaned(c: Column) -> Column:
    """As normal, with underscores as spaces and inner spaces left alone."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), "[^a-z0-9 ]+", " "))


def land_use(c: Column) -> Column:
    """The class of a code; null for one that isn't known."""
    return F.create_map(*[F.lit(x) for kv in LAND_USE.items() for x in kv])[cleaned(c)]


def _by_name(f):
    """A similarity of two names over Arrow batches; columns with few different pairs cost one call for each of these."""

    def columns(a: Column, b: Column) -> Column:
        ship()

        @F.pandas_udf("double")
        def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
            pairs = list(zip(x.where(x.notna(), None), y.where(y.notna(), None), strict=True))
            found = {k: f(k[0] or "", k[1] or "") for k in set(pairs)}
            return pd.Series([found[k] for k in pairs], dtype="float64")

        return similarity(a, b)

    columns.__name__, columns.__doc__ = f.__name__, f.__doc__
    return columns


ratio, token_sort, token_set, owner_similarity = (_by_name(f) for f in (names.ratio, names.token_sort, names.token_set, names.owner_similarity))
