"""Structured personal data: ordered patterns that redact, and the places where they still match."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values: (name, pattern, flags, replacement), applied in this order. The names keep_date and keep_law mark the two
# patterns that leave calendar dates and citations of public law as they are.
PII_PATTERNS = (
    ("mrz", r"[A-Z0-9<]*<<[A-Z0-9<]*", "", "[MRZ]"),
    ("barcode", r"\b[A-Z]{20,}\b", "", "[code-barres]"),
    ("ics", r"\b[A-Z]{2}\d{2}[A-Z]{3}\d{4,}\b", "", "[ICS]"),
    ("email", r"[\w.+-]+@[\w-]+\.[\w.]+", "", "[email]"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}\b", "", "[IBAN]"),
    ("phone", r"\b(?:\+33|0)\s?[1-9](?:[\s.-]?\d{2}){4}\b", "", "[telephone]"),
    ("labelled_phone", r"\b(?:t[ée]l(?:[ée]phone)?|mobile|portable|fax|gsm)\b\s*[.:;]?\s*\+?\d[\d .\-]{6,}\d", "i", "Tél. [telephone]"),
    ("siret", r"\b\d{3}[ ]?\d{3}[ ]?\d{3}[ ]?\d{5}\b", "", "[SIRET]"),
    ("siren_before", r"\b\d{3}[ ]?\d{3}[ ]?\d{3}\b(?=\s*(?:RCS|SIREN))", "", "[SIREN]"),
    ("siren_after", r"\b(?:RCS|RCS\s+[A-ZÀ-Ý][\w'\-]+|SIREN|SIRET)\s+\d{3}[ ]?\d{3}[ ]?\d{3}\b", "", "[SIREN]"),
    ("triplets", r"\b\d{3}[ ]\d{3}[ ]\d{3}\b(?!\s*(?:€|EUR\b|euros?\b))", "", "[réf.]"),
    ("regulator", r"\b(?:[Nn]°?\s?)?(?:GP|GC)\s?\d(?:[\d ]{3,}\d|\d{3,})\b", "", "[réf.]"),
    ("street", r"\b\d{1,4}\s?(?:bis|ter)?\s*(?:bd|boulevard|av|avenue|rue|place|impasse|chemin|route|quai|allee|allée)\b[^,\n\[]{0,40}", "i", "[adresse]"),
    ("postcode_city", r"\b\d{5}\s+[A-ZÀ-Ý][\w'\-]+(?:\s+[A-ZÀ-Ý][\w'\-]+)?", "", "[code postal] [ville]"),
    ("postcode", r"\(\s?\d{5}\s?\)", "", "([code postal])"),
    ("keep_date", r"(?<![0-9A-Za-z])\d{8,}(?![0-9A-Za-z])", "", "[réf.]"),
    ("keep_law", r"(?:(ordonnance|loi|d[ée]cret|arr[êe]t[ée]|r[èe]glement|directive|circulaire)\s+)?\b[Nn]°\s?[A-Z]?\d[\w/.-]{5,}\b", "i", "[réf.]"),
    ("deed", r"\bacte\s+n[°o]\s?\d[\w/.-]*", "i", "acte n° [réf.]"),
)
DATESTAMP = r"(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
_COMPILED = tuple((name, re.compile(p, re.IGNORECASE if "i" in f else 0), to) for name, p, f, to in PII_PATTERNS)


def is_datestamp(digits: str) -> bool:
    return re.fullmatch(DATESTAMP, digits) is not None


def _replacement(name: str, to: str, m: re.Match) -> str:
    if name == "keep_date":
        return m[0] if is_datestamp(m[0]) else to
    if name == "keep_law":
        return m[0] if m[1] else to
    return to


def redacted(s: str | None) -> str | None:
    if not s:
        return s
    for name, pattern, to in _COMPILED:
        s = pattern.sub(lambda m, n=name, t=to: _replacement(n, t, m), s)
    return s


@F.pandas_udf(StringType())
def redact_exactly(s: pd.Series) -> pd.Series:
    """The patterns with Python's own regular expressions."""
    return s.map(redacted)


#: Stands for a moment where a citation is kept; a noncharacter, which no text has.
KEPT = "\ufdd4"


def redact(c: Column) -> Column:
    """The patterns as a chain of regexp_replace, inside the JVM; two use lookarounds for what they keep."""
    for name, pattern, flags, to in PII_PATTERNS:
        head = "(?U)" + ("(?iu)" if "i" in flags else "")
        if name == "keep_date":
            pattern = rf"(?<![0-9A-Za-z])(?!{DATESTAMP}(?![0-9A-Za-z]))\d{{8,}}(?![0-9A-Za-z])"
        if name == "keep_law":
            # a citation is matched and put back, so that its number isn't matched apart
            c = F.regexp_replace(c, head + r"\b((?:ordonnance|loi|d[ée]cret|arr[êe]t[ée]|r[èe]glement|directive|circulaire)\s+)(n)(°\s?[A-Z]?\d[\w/.-]{5,}\b)", f"$1{KEPT}$2$3")
            c = F.regexp_replace(c, head + f"(?<!{KEPT})" + r"\bn°\s?[A-Z]?\d[\w/.-]{5,}\b", to)
            c = F.replace(c, F.lit(KEPT), F.lit(""))
            continue
        c = F.regexp_replace(c, head + pattern, to)
    return c


def hits(c: Column) -> Column:
    """array<struct<kind, n>> of patterns that match; before redaction."""
    n = lambda pattern, flags: F.size(F.regexp_extract_all(c, F.lit("(?U)" + ("(?iu)" if "i" in flags else "") + pattern), F.lit(0)))
    return F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), n(p, f).alias("n")) for k, p, f, _ in PII_PATTERNS]), lambda x: x["n"] > 0)


def leaks(s: str | None) -> list[str]:
    """Names of the patterns that would still change the text."""
    return [name for name, p, to in _COMPILED if any(_replacement(name, to, m) != m[0] for m in p.finditer(s or ""))]


@F.pandas_udf(ArrayType(StringType()))
def leaking(s: pd.Series) -> pd.Series:
    return s.map(leaks)
