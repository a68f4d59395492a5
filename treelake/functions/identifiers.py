"""Checks of identifiers: shapes by pattern, check digits by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORCID = r"^(?:https?://orcid\.org/)?([0-9]{4})-([0-9]{4})-([0-9]{4})-([0-9]{3}[0-9X])/?$"


def _digits(s: Column) -> Column:
    """Each character as a number; X counts ten."""
    return F.transform(F.regexp_extract_all(s, F.lit("."), F.lit(0)), lambda c: F.when(F.upper(c) == "X", 10).otherwise(c.try_cast("int")))


def orcid_valid(s: Column) -> Column:
    """Four groups of four, and the ISO 7064 mod 11-2 check character."""
    d = _digits(F.regexp_replace(F.regexp_extract(s, r"([0-9X-]{19})/?$", 1), "-", ""))
    total = F.aggregate(F.slice(d, 1, 15), F.lit(0).cast("long"), lambda a, x: (a + x) * 2)
    return F.coalesce(F.when(s.rlike(_ORCID), (12 - total % 11) % 11 == F.element_at(d, -1)), F.lit(False))


def isbn10_valid(s: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(s, r"(?i)^\s*(?:urn:)?isbn(?:-10)?:?\s*", ""), "[- ]", "")
    weighted = F.transform(_digits(bare), lambda x, i: x * (10 - i))
    return F.coalesce(F.when(bare.rlike("^[0-9]{9}[0-9Xx]$"), F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 11 == 0), F.lit(False))


def isbn13_valid(s: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(s, r"(?i)^\s*(?:urn:)?isbn(?:-13)?:?\s*", ""), "[- ]", "")
    weighted = F.transform(_digits(bare), lambda x, i: x * F.when(i % 2 == 0, 1).otherwise(3))
    return F.coalesce(F.when(bare.rlike("^97[89][0-9]{10}$"), F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 10 == 0), F.lit(False))


def isbn_valid(s: Column) -> Column:
    return isbn10_valid(s) | isbn13_valid(s)


#: Shapes without a check digit.
PATTERNS = {
    "ror": r"^(?:https?://ror\.org/)?0[a-hj-km-np-tv-z0-9]{6}[0-9]{2}$",
    "urn": r"(?i)^urn:[a-z0-9][a-z0-9-]{0,31}:[^\s]+$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "semver": r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$",
    "doi": r"^(?:https?://(?:dx\.)?doi\.org/)?10\.[0-9]{4,9}/\S+$",
}


def identifier_valid(s: Column, kind: str) -> Column:
    if kind in ("orcid", "isbn"):
        return {"orcid": orcid_valid, "isbn": isbn_valid}[kind](s)
    return F.coalesce(s.rlike(PATTERNS[kind]), F.lit(False))


def identifier_kind(s: Column) -> Column:
    """The first kind whose check passes, or null."""
    out = F.when(orcid_valid(s), "orcid").when(isbn_valid(s), "isbn")
    for kind in PATTERNS:
        out = out.when(identifier_valid(s, kind), kind)
    return out
