"""Conversions that need the Unicode tables: compatibility forms and ASCII slugs, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


_ELLIPSES = re.compile("([…⋯]+)")


def compatible(t: str) -> str:
    """NFKC, with ellipses left as they are."""
    # most texts are in that form already, and so is each part of them
    return t if unicodedata.is_normalized("NFKC", t) else "".join(p if p[:1] in "…⋯" else unicodedata.normalize("NFKC", p) for p in _ELLIPSES.split(t) if p)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, with ellipses left as they are."""
    return s.map(lambda t: t if t is None else compatible(t))


@F.pandas_udf(StringType())
def slug(s: pd.Series) -> pd.Series:
    """ASCII letters and digits of the decomposed text, other runs as hyphens, 60 characters at most; `chapter` if nothing is left."""

    def one(t):
        plain = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:60] or "chapter"

    return s.map(one)
