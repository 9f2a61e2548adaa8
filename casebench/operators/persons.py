"""Roles and persons: catalogues, caps, resolving persons across roles, co-occurrence, backfilled quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebench.functions import scalars
from casebench.functions.lexicon import fold
from casebench.functions.text import squeeze

# Honorifics and legal forms before a name.
HONORIFICS = ("maître", "maitre", "me", "monsieur", "madame", "mme", "mlle", "mademoiselle", "m.", "mr", "mr.", "docteur", "dr", "dr.", "professeur", "pr.", "scp", "sarl", "sas", "sa")
FACTS_PER_ROLE, RESOLVER_FACTS_PER_ROLE = 30, 20


def capped_facts(facts: DataFrame, cap: int = FACTS_PER_ROLE, role: str = "actor_role") -> DataFrame:
    """The `cap` earliest facts of each role, undated last; the group limit runs in each task before the shuffle."""
    w = W.partitionBy(role).orderBy(F.col("date").asc_nulls_last(), "fact_id")
    return facts.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= cap).drop("__n")


def without_ambiguous(facts: DataFrame, ambiguities: DataFrame) -> DataFrame:
    return facts.join(ambiguities.select(F.explode("fact_ids").alias("fact_id")).distinct(), "fact_id", "left_anti")


def ambiguity_facts(ambiguities: DataFrame, facts: DataFrame) -> DataFrame:
    """(ambiguity_id, fact_ids): facts of the same document whose role is a candidate."""
    j = ambiguities.join(facts, ambiguities.doc_id == facts.source_doc_id).filter(F.array_contains("candidate_roles", F.col("actor_role")))
    return j.groupBy("ambiguity_id").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"))


def first_actions(facts: DataFrame, n: int = 5) -> DataFrame:
    """(actor_role, actions): the first n different actions of each role, in order of date and id."""
    w = W.partitionBy("actor_role", "action").orderBy(F.col("date").asc_nulls_last(), "fact_id")
    first = facts.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    v = W.partitionBy("actor_role").orderBy(F.col("date").asc_nulls_last(), "fact_id")
    top = first.withColumn("__k", F.row_number().over(v)).filter(F.col("__k") <= n)
    return top.groupBy("actor_role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "action"))), lambda x: x["action"]), " ; ").alias("actions"))


def role_catalogue(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(role_id, label, fact_count, first_doc): counts from the facts, the label first seen in order of document. labels: role_id, doc_id, label."""
    n = facts.groupBy(F.col("actor_role").alias("role_id")).agg(F.count(F.lit(1)).alias("fact_count"), F.min("source_doc_id").alias("first_doc"))
    first = labels.groupBy("role_id").agg(F.min_by("label", F.struct("doc_id", "label")).alias("label"))
    return n.join(first, "role_id", "left").select("role_id", F.coalesce("label", "role_id").alias("label"), "fact_count", "first_doc")


def co_occurring(facts: DataFrame, n: int = 3) -> DataFrame:
    """(role, others): up to n other roles, in order, in the documents of each role. Both sides are distinct first."""
    d = facts.select("source_doc_id", F.col("actor_role").alias("role")).distinct()
    o = d.withColumnRenamed("role", "other")
    return d.join(o, "source_doc_id").filter("role <> other").groupBy("role").agg(F.slice(F.array_sort(F.collect_set("other")), 1, n).alias("others"))


def merge_key(name: Column) -> Column:
    """Folded name without one leading honorific, if a blank follows it."""
    import re

    ascii_name = F.regexp_replace(fold(name), r"[^\x00-\x7F]", "")
    titles = "|".join(sorted({re.escape(h.replace("î", "i")) for h in HONORIFICS}, key=lambda x: (-len(x), x)))
    return squeeze(F.regexp_replace(ascii_name, rf"^(?:{titles})\s+", ""))


def without_bare_surnames(people: DataFrame) -> DataFrame:
    """people (role_id, key, more) less one-word keys that are a word of a longer key in the same role."""
    longer = people.filter(F.contains("key", F.lit(" "))).select(F.col("role_id").alias("__r"), F.explode(F.split("key", " ")).alias("__w")).distinct()
    return people.join(longer, (F.col("role_id") == F.col("__r")) & (F.col("key") == F.col("__w")), "left_anti")


def resolved(mentions: DataFrame, case_id: str) -> DataFrame:
    """Persons of mentions (role_id, name, aliases, confidence, note, evidence_fact_ids, pos), one a merge key.

    The longest name wins, the first on ties; aliases and other names in order, once; of each role the best confidence,
    the first note and all evidence.
    """
    keyed = without_bare_surnames(mentions.withColumn("key", merge_key(F.col("name"))).filter("key <> ''"))
    rank = scalars.ranked(F.col("confidence"), scalars.CONFIDENCES)
    inner = keyed.groupBy("key", "role_id").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("pos"))).alias("name"), F.min("pos").alias("pos"), F.max(rank).alias("c"),
        F.min(F.when(F.col("note").isNotNull(), F.struct("pos", "note"))).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_fact_ids")))).alias("evidence"),
        F.array_sort(F.collect_list(F.struct("pos", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names")))).alias("named"))
    role = F.struct("role_id", F.element_at(F.array(*[F.lit(x) for x in scalars.CONFIDENCES]), (F.col("c") + 1).cast("int")).alias("confidence"), F.col("n.note").alias("ambiguity_note"), F.col("evidence").alias("evidence_fact_ids"))
    out = inner.groupBy("key").agg(F.max_by("name", F.struct(F.length("name"), -F.col("pos"))).alias("canonical_name"), F.array_sort(F.collect_list(role)).alias("role_assignments"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.flatten(F.collect_list("named"))), lambda x: x["names"]))).alias("names"))
    slug = F.regexp_replace(F.regexp_replace(F.col("key"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return out.select(F.concat(F.lit(f"{case_id}-"), F.when(slug == "", "person").otherwise(slug)).alias("person_id"), F.lit(case_id).alias("case_id"), "canonical_name", F.filter("names", lambda x: x != F.col("canonical_name")).alias("aliases"), "role_assignments")


def edges(persons: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(person_id, fact_id) as persons say, dangling ones too; and those whose fact exists."""
    all_edges = persons.select("person_id", F.explode("role_assignments").alias("a")).select("person_id", F.explode("a.evidence_fact_ids").alias("fact_id")).distinct()
    return all_edges, all_edges.join(facts.select("fact_id"), "fact_id", "left_semi").select("person_id", "fact_id")


def backfilled(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """facts with source_chunk_id: the smallest chunk of the same document that holds the quote exactly, else with blanks and case evened out."""
    c = chunks.select(F.col("doc_id").alias("__doc"), "chunk_id", "texte", F.lower(squeeze(F.col("texte"))).alias("__even"))
    q = facts.select("fact_id", "source_doc_id", "verbatim_quote", F.lower(squeeze(F.col("verbatim_quote"))).alias("__q"))
    exact, even = F.contains("texte", F.col("verbatim_quote")), F.contains("__even", F.col("__q"))
    j = q.join(c, (F.col("source_doc_id") == F.col("__doc")) & even)
    best = j.groupBy("fact_id").agg(F.min(F.struct(F.when(exact, 0).otherwise(1).alias("t"), "chunk_id")).alias("b"))
    return facts.drop("source_chunk_id").join(best.select("fact_id", F.col("b.chunk_id").alias("source_chunk_id")), "fact_id", "left")


def numbered_labels(holders: DataFrame) -> DataFrame:
    """holders (role, person_id) with label: the bare role for its only holder, else role_1, role_2, ... by id."""
    w = W.partitionBy("role")
    n = F.row_number().over(w.orderBy("person_id"))
    return holders.withColumn("label", F.when(F.count(F.lit(1)).over(w) == 1, F.col("role")).otherwise(F.concat("role", F.lit("_"), n.cast("string"))))


def chosen_role(roles: DataFrame, weak: tuple[str, ...]) -> DataFrame:
    """(person_id, role): a specific role before a weak one, then by name."""
    return roles.groupBy("person_id").agg(F.min(F.struct(F.col("role").isin(*weak).alias("weak"), "role")).alias("r")).select("person_id", F.col("r.role").alias("role"))


def personas(people: DataFrame, roster: DataFrame, pinned: DataFrame, pool: DataFrame, label: str = "Personne") -> DataFrame:
    """people (person_id) with persona: of the roster, else pinned before, else the next unused of pool (pos, persona), else the
    label with the next unused of the letters A, B, ..., Z, AA, ... roster and pinned: person_id, persona.
    """
    given = people.select("person_id").join(roster.withColumnRenamed("persona", "__a"), "person_id", "left").join(pinned.withColumnRenamed("persona", "__b"), "person_id", "left").withColumn("persona", F.coalesce("__a", "__b"))
    used = given.filter("persona IS NOT NULL").select("persona")
    rest = given.filter("persona IS NULL").select("person_id")
    made_up = F.concat(F.lit(f"{label} "), F.upper(scalars.ordinal_letters(F.col("pos"))))
    # enough letters even if all of them were used
    letters = people.sparkSession.range(1, 1 + given.count()).withColumnRenamed("id", "pos").select(F.lit(1).alias("late"), "pos", made_up.alias("persona"))
    free = pool.select(F.lit(0).alias("late"), F.col("pos").cast("long").alias("pos"), "persona").unionByName(letters).join(used, "persona", "left_anti")
    # persons of one case are numbered in their order, which takes one window
    free = free.withColumn("__m", F.row_number().over(W.orderBy("late", "pos")))
    late = rest.withColumn("__n", F.row_number().over(W.orderBy("person_id"))).join(free, F.col("__n") == F.col("__m")).select("person_id", "persona")
    return given.filter("persona IS NOT NULL").select("person_id", "persona").unionByName(late)


def with_entities(persons: DataFrame, entities: DataFrame) -> DataFrame:
    """Persons and entities (person_id, name) as one, the entity's filled name before the person's."""
    j = persons.select("person_id", F.col("canonical_name").alias("__n")).join(entities.select("person_id", F.col("name").alias("__e")), "person_id", "full_outer")
    return j.select("person_id", F.coalesce(F.nullif(F.trim("__e"), F.lit("")), "__n").alias("name"))
