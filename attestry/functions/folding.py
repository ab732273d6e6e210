"""Folding of literals before they are compared: width, dashes, quotes, blanks and case."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dashes and quotes that are typed in many ways, and the plain sign of each.
_SIGNS = {
    **dict.fromkeys("‐‑‒–—―−﹣－", "-"), **dict.fromkeys("‘’‚‛′", "'"), **dict.fromkeys("“”„‟«»″", '"'),
    "µ": "μ", "∆": "Δ", "Ω": "Ω",
}
_TABLE = str.maketrans(_SIGNS)
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def fold_signs(text: str) -> str:
    """NFKC with plain dashes and quotes, nothing invisible, single blanks; letter case stays."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text).translate(_TABLE)).translate(_TABLE)
    return " ".join(text.split())


def fold_literal(text: str) -> str:
    """As :func:`fold_signs`, with full case folding."""
    return fold_signs(text).casefold()


@F.pandas_udf(T.StringType())
def folded_signs(values: pd.Series) -> pd.Series:
    """Column form of :func:`fold_signs`; null stays null."""
    return values.map(fold_signs, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def folded_literal(values: pd.Series) -> pd.Series:
    """Column form of :func:`fold_literal`; null stays null."""
    return values.map(fold_literal, na_action="ignore").astype(object)
