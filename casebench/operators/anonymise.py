"""Anonymising a case: known names, replacements that can't cascade, field policies, ids, and the scan for what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebench.functions import phrases, pii, scalars, trees
from casebench.functions.lexicon import fold, folded
from casebench.functions.text import whole_words

# Words of names that identify nobody.
GENERIC_TOKENS = frozenset("""
immobilier immobiliere societe notaire notaires etude cabinet conseil caisse banque assurance assurances mutuel mutuelle
regionale regional national nationale generale general depots consignations retraite gestion france francaise groupe
compagnie credit agricole monsieur madame maitre veuve epouse instrumentaire redacteur redactrice stagiaire associe
associee collaborateur collaboratrice clerc mandataire mandant usufruitier usufruitiere proprietaire heritier heritiere
heritiers defunt defunte gestionnaire succession successions charge chargee juge juges tutelle tutelles contentieux
officier officiers etat civil civile central dispositions dernieres volontes contact service clients client
""".split())  # fmt: skip
LEAST_TOKEN = 4


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)[^\w]+"), lambda t: t != "")


def distinctive(c: Column) -> Column:
    """Words of a folded name that can stand for it: four letters or more, not generic, not a number."""
    generic = F.array(*[F.lit(t) for t in sorted(GENERIC_TOKENS)])
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= LEAST_TOKEN) & ~F.array_contains(generic, t) & ~t.rlike(r"^\d+$")))


def only_role_words(c: Column) -> Column:
    generic = F.array(*[F.lit(t) for t in sorted(GENERIC_TOKENS | {"de", "du", "des", "la", "le", "les", "d", "l", "et"})])
    return F.forall(tokens(c), lambda t: F.array_contains(generic, t))


def known_names(persons: DataFrame) -> DataFrame:
    """(person_id, name): canonical names and aliases of three characters or more that aren't just a role."""
    each = persons.select("person_id", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    return each.filter((F.length(F.trim("name")) >= 3) & ~only_role_words(fold(F.col("name"))))


def pseudonyms(names: DataFrame, personas: DataFrame, placeholder: str = "la personne", overrides: DataFrame | None = None) -> DataFrame:
    """(key, value): folded names, and the distinctive words of one person only; words of several get the placeholder; overrides win.

    A whole name shared by several persons gets the placeholder too.
    """
    n = names.select("person_id", fold(F.col("name")).alias("key")).join(personas, "person_id")
    words = n.select("person_id", "persona", F.explode(distinctive(F.col("key"))).alias("key"))
    both = n.select("person_id", "persona", "key").unionByName(words.select("person_id", "persona", "key"))
    made = both.groupBy("key").agg(F.when(F.count_distinct("person_id") > 1, placeholder).otherwise(F.min("persona")).alias("value"))
    if overrides is None:
        return made
    o = overrides.select(fold(F.col("key")).alias("key"), "value")
    return made.join(o, "key", "left_anti").unionByName(o)


def cascading(mapping: DataFrame) -> DataFrame:
    """(key, value, token) where a word of a replacement is itself a key that changes it."""
    t = mapping.select("key", "value", F.explode(tokens(fold(F.col("value")))).alias("token"))
    k = mapping.select(F.col("key").alias("token"), fold(F.col("value")).alias("__to"))
    return t.join(k, "token").filter("token <> __to").select("key", "value", "token")


def guarded(mapping: DataFrame) -> dict[str, str]:
    """The mapping of one case as a dict; one that cascades raises."""
    bad = cascading(mapping).limit(20).collect()
    if bad:
        raise ValueError(f"replacements cascade: {[(r.key, r.token) for r in bad]}")
    return {r.key: r.value for r in mapping.collect()}


def anonymised(c: Column, mapping: dict[str, str], extras: dict[str, str] | None = None) -> Column:
    """Structured data, then names, then extra identifiers (keys that begin with '_' are notes)."""
    out = whole_words(mapping)(pii.redact_exactly(c)) if mapping else pii.redact_exactly(c)
    real = {k: v for k, v in (extras or {}).items() if not k.startswith("_")}
    return whole_words(real)(out) if real else out


def anonymised_documents(documents: DataFrame, mapping: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """documents (doc_id, body, more) anonymised by tables (key, value) of any size: structured data, names, extra identifiers.

    Keys of extras that begin with '_' are notes. A mapping that cascades raises.
    """
    bad = cascading(mapping).limit(20).collect()
    if bad:
        raise ValueError(f"replacements cascade: {[(r.key, r.token) for r in bad]}")
    out = phrases.replaced(documents.withColumn("body", pii.redact_exactly(F.col("body"))), mapping)
    return phrases.replaced(out, extras.filter(~F.col("key").startswith("_"))) if extras is not None else out


def swept(before: Column, after: Column) -> Column:
    """A model's clean-up, unless it lost more than half of the text."""
    return F.when(F.coalesce(F.length(after), F.lit(0)) < 0.5 * F.length(before), before).otherwise(after)


POLICIES = ("keep", "drop", "text", "doc_id", "fact_id", "person_id", "blank", "list_text")


def by_policy(df: DataFrame, policy: dict[str, str], mapping: dict[str, str], ids: dict[str, Column] | None = None) -> DataFrame:
    """df with each column as its policy says; a column without one, or an unknown policy, raises before anything runs."""
    unknown = [c for c in df.columns if policy.get(c) not in POLICIES]
    if unknown:
        raise ValueError(f"no policy for {unknown}")
    out = []
    for c in df.columns:
        p = policy[c]
        if p == "drop":
            continue
        v = F.col(c)
        if p == "text":
            v = anonymised(v, mapping)
        elif p == "list_text":
            v = F.split(anonymised(F.array_join(v, "\u0001"), mapping), "\u0001")
        elif p == "blank":
            v = F.lit("").cast(df.schema[c].dataType)
        elif p in ("doc_id", "fact_id", "person_id"):
            v = (ids or {}).get(c, v)
        out.append(v.alias(c))
    return df.select(out)


def renamed_document(c: Column, names: list[str]) -> Column:
    """A doc_id without names (x) and without numbers of five digits or more (ref), but for calendar dates."""
    out = c
    for t in sorted(names, key=lambda x: (-len(x), x)):
        out = F.regexp_replace(out, rf"(?<![a-z]){t}(?![a-z])", "x")
    return F.regexp_replace(out, rf"(?<!\d)(?!{pii.DATESTAMP}(?!\d))\d{{5,}}(?!\d)", "ref")


def renamed_fact(c: Column, doc: Column) -> Column:
    """A fact id under its document's new id."""
    return F.concat(doc, F.lit("-"), F.regexp_extract(c, r"^.*-([a-z]\d+)$", 1))


def file_tokens(mapping: dict[str, str]) -> list[str]:
    """Words of keys that may not stand in a file name: distinctive, and in no replacement."""
    placed = {t for v in mapping.values() for t in folded(v).split()}
    return sorted({t for k in mapping for t in folded(k).split() if len(t) >= LEAST_TOKEN and t not in GENERIC_TOKENS and not t.isdigit() and t not in placed})


def leaks(documents: DataFrame, needles: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kind, needle): names and phrases that still stand as words, and the patterns that would still change the text.

    needles (needle): folded or not. All are looked for at once (phrases.occurring).
    """
    d = documents.select("doc_id", "body")
    ok = needles.filter(~phrases.evened_phrase(F.col("needle")).isin(*allowed)) if allowed else needles
    names = phrases.occurring(d, ok).select("doc_id", F.lit("name").alias("kind"), "needle")
    structured = d.select("doc_id", F.explode(pii.leaking(F.col("body"))).alias("needle")).select("doc_id", F.lit("pattern").alias("kind"), "needle")
    return names.unionByName(structured).distinct()


def residual_nouns(documents: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """(token, n): capitalised words inside sentences that no list knows, by frequency: for a person to look at."""
    w = documents.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?<=[a-zà-ÿ,] )([A-ZÀ-Ý][a-zà-ÿ]{2,})"), F.lit(1))).alias("token"))
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).withColumn("__f", fold(F.col("token"))).join(known.select(F.col("token").alias("__f")), "__f", "left_anti").drop("__f")


def scrubbed(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with the columns redacted, one row: how many rows changed). A second pass changes none."""
    new = {f"__{c}": pii.redact_exactly(F.col(c)) for c in columns}
    both = df.withColumns(new)
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return both.select(*[F.col(f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns]), both.agg(F.count_if(changed).alias("changed"))


def scrubbed_json(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with the string leaves of JSON columns redacted, one row: how many rows changed and how many aren't JSON).

    Keys, order, numbers and layout stay, so a replacement can't break a file. A second pass changes none; what isn't JSON stays
    as it is and is counted, as a scrub that skips it isn't done.
    """
    both = df.withColumns({f"__{c}": trees.with_leaves(F.col(c), pii.redacted) for c in columns})
    changed, bad = F.lit(False), F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        bad = bad | (F.col(c).isNotNull() & ~trees.is_json(F.col(c)))
    return both.select(*[F.col(f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns]), both.agg(F.count_if(changed).alias("changed"), F.count_if(bad).alias("malformed"))


def translated_findings(findings: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Findings with their text anonymised, and ids made anew from it."""
    out = findings.withColumns({c: anonymised(F.col(c), mapping) for c in ("subject", "claim", "evidence")})
    return out.withColumn("id", scalars.short_id(F.col("pass_name"), F.col("subject"), F.col("claim")))
