"""What counts as no value: nulls, blanks and words that stand in for a missing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole values that stand for nothing, after lower case and removal of outer blanks and brackets.
EMPTY_WORDS = (
    "", "-", "--", "—", "?", ".", "n/a", "na", "n.a.", "n.d.", "nan", "nil", "none", "null", "unknown",
    "unbekannt", "desconocido", "inconnu", "tbd", "missing", "not available", "undefined", "pdf only",
)

#: A short notice that a text is held elsewhere or was never obtained (en, es, de, fr).
NOTICE = (
    r"(?i)^\W*(the\s+)?(full[\s-]*text|full article|article text|text|abstract|summary|pdf|resumen|texto completo|texto|"
    r"volltext|zusammenfassung|résumé|texte intégral|no abstract|no full[\s-]*text|no text|sin resumen|sin texto|"
    r"kein volltext|keine zusammenfassung|pas de résumé|no)\b.{0,40}"
    r"\b(not available|unavailable|missing|not provided|not found|only|no disponible|available|disponible|"
    r"held by the publisher|cannot be shown|nicht verfügbar|verfügbar|indisponible|non disponible|withheld|removed|omitted)\b.{0,60}$"
)

#: Longest value that can be a notice.
NOTICE_CHARS = 120

#: White space and invisible characters at the edges of a value (Java regular expression class).
_EDGE = r"\s\u00a0\u2000-\u200f\u202f\u205f\u2060\u3000\ufeff"
_BLANKS = rf"^[{_EDGE}\[\](){{}}<>]+|[{_EDGE}\[\](){{}}<>]+$"


def trimmed(c: Column) -> Column:
    """The value without outer white space of any kind."""
    return F.regexp_replace(c, rf"^[{_EDGE}]+|[{_EDGE}]+$", "")


def is_missing(c: Column) -> Column:
    """Null, blank or a word such as ``n/a``."""
    return c.isNull() | F.lower(F.regexp_replace(c, _BLANKS, "")).isin(*EMPTY_WORDS)


def is_standin(c: Column) -> Column:
    """Null, blank, a word such as ``n/a``, or a notice that the text is not here."""
    return is_missing(c) | ((F.length(c) <= NOTICE_CHARS) & c.rlike(NOTICE))
