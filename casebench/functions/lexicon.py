"""Words and numbers of case texts: folding, amounts, party counts, markers, polarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Obligation markers, words that outbound text may not use, and polarity axes (name, positive, negative stems).
OBLIGATION_MARKERS = (
    "s'oblige", "s'engage", "sera tenu", "est tenu de", "seront tenus",
    "devra", "devront", "il sera fait", "remettra", "notifiera",
    "s'interdit", "a la charge de", "aux termes de la presente",
    "sous reserve de", "s'obligent",
)
OUTBOUND_FORBIDDEN_TERMS = (
    "detournement", "detourne", "detourner",
    "dissimulation", "dissimule",
    "appropriation", "approprie",
    "abus de confiance", "escroquerie", "malversation",
    "soustraction frauduleuse", "frauduleux", "frauduleuse",
    "intentionnel", "intentionnelle", "dolosif", "dolosive",
    "faux et usage de faux",
)
ANTONYM_AXES = (
    ("accepter/refuser", ("accept", "agre"), ("refus", "rejet", "decline")),
    ("verser/retenir", ("vers", "regl", "pai", "credit"), ("reten", "preleve", "debit")),
    ("remettre/conserver", ("remis", "remet", "deliv", "transmis"), ("conserv", "gard")),
    ("debloquer/bloquer", ("debloqu", "liber"), ("bloqu", "gel", "consign")),
    ("signer/contester", ("sign", "ratifi"), ("contest", "denie", "desavou")),
    ("notifier/omettre", ("notifi", "inform", "avis"), ("omis", "omet", "neglig")),
    ("autoriser/interdire", ("autoris", "habilit"), ("interdi", "oppos")),
    ("inscrire/omettre", ("inscri", "porte au passif"), ("omis", "omet")),
)
MONEY = r"(\d[\d\s.,]*)\s*(?:€|eur\b|euros?\b)"
PARTY_COUNT = r"(\d+)\s+(heritiers?|indivisaires?|nus?-proprietaires?|petits-enfants|ayants? droit)"
APOSTROPHES = "’ʼ‘`"


def folded(s: str | None) -> str:
    """Lower case, no accents, plain apostrophes, single blanks; '' for null. For matching only."""
    if not s:
        return ""
    plain = "".join("'" if c in APOSTROPHES else c for c in s)
    bare = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    return " ".join(bare.lower().split())


_ACCENTS = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
#: Texts that fold_native() folds as folded() does: ASCII, precomposed Latin letters, and letters and marks that stay as they are.
_PLAIN = "(?s)\\A[\\t\\n\\x0B\\f\\r\\x20-\\x7E" + _ACCENTS + _ACCENTS.upper() + APOSTROPHES + "ßœæøŒÆØ«»€–—" + "]*+\\z"


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: folded(x) if x is not None else None)


def fold(c: Column) -> Column:
    """folded() of a column, '' for null: inside the JVM, but for texts that need NFKD, which has no built-in."""
    return F.coalesce(_folded(F.when(~F.rlike(c, F.lit(_PLAIN)), c)), fold_native(c))


def fold_native(c: Column) -> Column:
    """Folding for text whose only accents are precomposed Latin letters, inside code generation."""
    plain = "aaaaaaceeeeiiiinooooouuuuyy" + "'" * len(APOSTROPHES)
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), _ACCENTS + APOSTROPHES, plain), r"(?U)\s+", " "))


def contained(terms: list[str] | tuple[str, ...], text: Column) -> Column:
    """Those of the terms (already folded) that the folded text holds, in their order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]))


def obligation_markers(text: Column) -> Column:
    return contained(OBLIGATION_MARKERS, text)


def forbidden_terms(text: Column) -> Column:
    return contained(OUTBOUND_FORBIDDEN_TERMS, text)


def amounts(text: Column) -> Column:
    """Distinct whole-euro amounts of folded text, ascending: a decimal tail of one or two digits is dropped."""
    raw = F.regexp_extract_all(text, F.lit(f"(?U){MONEY}"), F.lit(1))
    digits = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[^\d,.]", ""), r"[.,]\d{1,2}$", ""), r"[^\d]", ""))
    return F.array_sort(F.array_distinct(F.transform(F.filter(digits, lambda x: x != ""), lambda x: x.cast("decimal(38,0)"))))


def party_counts(text: Column) -> Column:
    """Distinct (n, noun) pairs of folded text."""
    n, noun = (F.regexp_extract_all(text, F.lit(PARTY_COUNT), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.zip_with(n, noun, lambda a, b: F.struct(a.cast("long").alias("n"), b.alias("noun"))))


def polarity(action: Column) -> Column:
    """struct(axis, sign) of the first axis that a folded action is on, or null; an axis's positive stems come first."""
    out = F.lit(None).cast("struct<axis:string,sign:int>")
    has = lambda stems: F.greatest(*[F.contains(action, F.lit(s)) for s in stems]) if len(stems) > 1 else F.contains(action, F.lit(stems[0]))
    for axis, positive, negative in reversed(ANTONYM_AXES):
        of = lambda sign: F.struct(F.lit(axis).alias("axis"), F.lit(sign).alias("sign"))  # noqa: B023, E731
        out = F.when(has(positive), of(1)).when(has(negative), of(-1)).otherwise(out)
    return out
