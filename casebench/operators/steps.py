"""Steps of building a case that ask a model: verification of transcripts, mentions of persons, persons of a role.

Each is cache first: a step's stored cache is probed by what was asked, misses alone reach the model, an answer is committed as
a batch, and what can't be read isn't, so that the next run asks again. Documents that didn't change cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebench.functions import scalars
from casebench.models import ModelProvider, StoredCache, cache_key
from casebench.operators import cycle, persons

MENTION = "struct<name:string,role:string,quote:string>"
PERSON = "struct<canonical_name:string,aliases:array<string>,person_type:string,confidence:string,evidence_fact_ids:array<string>>"
#: Replies of the same step under another wording of its prompt are other replies.
VERSIONS = {"gate": "1", "mentions": "1", "roles": "1"}


def asked(rows: DataFrame, step: str, subject: str, context: list[Column], prompt: Column, model: str) -> DataFrame:
    """rows with cache_key (step, version, model, subject and context), pass_name, subject and prompt."""
    key = cache_key(F.lit(step), F.lit(VERSIONS[step]), F.lit(model), F.col(subject), *context)
    return rows.withColumns({"cache_key": key, "pass_name": F.lit(step), "subject": F.col(subject).cast("string"), "prompt": prompt})


def gated(documents: DataFrame, cache: StoredCache, provider: ModelProvider) -> DataFrame:
    """(doc_id, status, missing_facts, mistranscriptions) of documents (doc_id, source, transcript): what a verifier says.

    status: source_missing, without a call, where there is no source; else ok, parse_recovered (a cut-off reply: what it still
    says, but never a verdict) or parse_failed. Only ok is cached. The rows are what coverage's log gets appended.
    """
    prompt = F.concat(F.lit("Source :\n"), F.col("source"), F.lit("\n\nTranscription :\n"), F.coalesce("transcript", F.lit("")))
    there = asked(documents.filter("source IS NOT NULL"), "gate", "doc_id", [F.col("source"), F.col("transcript")], prompt, provider.name)
    got = _answers(there, cache, provider, lambda raw: cycle.verifier_parsed(raw)["status"] == "ok")
    v = got.select("doc_id", cycle.verifier_parsed(F.col("raw")).alias("v")).select("doc_id", "v.status", "v.missing_facts", "v.mistranscriptions")
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<struct<claimed:string,actual:string>>")
    return v.unionByName(documents.filter("source IS NULL").select("doc_id", F.lit("source_missing").alias("status"), none.alias("missing_facts"), nothing.alias("mistranscriptions")))


def _answers(work: DataFrame, cache: StoredCache, provider: ModelProvider, keep) -> DataFrame:
    """work with raw: the cached or new reply, also one that `keep` refuses, which isn't stored."""
    return cache.answered(work, "prompt", provider, keep, whole=True).withColumnRenamed("result_json", "raw")


def listed(raw: Column, kind: str) -> Column:
    """The objects of a reply that is a JSON list, prose after it and a fence around it ignored; of one that is cut off, the
    whole objects; null if there are none to read in something that isn't a list."""
    bare = scalars.unfenced(raw)
    whole, lost = scalars.first_json(bare), scalars.recovered_objects(bare)
    read = F.filter(F.from_json(whole, f"array<{kind}>"), lambda x: x.isNotNull())
    part = F.filter(F.transform(lost, lambda x: F.from_json(x, kind)), lambda x: x.isNotNull())
    return F.when(whole.startswith("["), read).when(whole.isNull() & bare.startswith("[") & (F.size(lost) > 0), part)


def mentions(documents: DataFrame, cache: StoredCache, provider: ModelProvider) -> DataFrame:
    """(doc_id, name, role, quote, pos): the persons that each document (doc_id, text) mentions, by the model.

    A reply that is no list isn't cached and gives no row; an empty list is cached. Mentions without a name are left out. A
    null or blank text is not asked about.
    """
    there = documents.filter(F.trim("text") != "")
    work = asked(there, "mentions", "doc_id", [F.col("text")], F.col("text"), provider.name)
    got = _answers(work, cache, provider, lambda raw: listed(raw, MENTION).isNotNull())
    each = got.select("doc_id", F.posexplode(listed(F.col("raw"), MENTION)).alias("pos", "m"))
    return each.select("doc_id", "m.name", "m.role", "m.quote", "pos").filter(F.trim("name") != "")


def mention_stats(documents: DataFrame, cache: StoredCache, provider: ModelProvider, rate_in: float, rate_out: float, out_tokens: int) -> DataFrame:
    """One row: documents, those answered already, and what the others would cost at most; no call."""
    work = asked(documents.filter(F.trim("text") != ""), "mentions", "doc_id", [F.col("text")], F.col("text"), provider.name)
    known = cache.table.read().select("cache_key", F.lit(True).alias("__known"))
    j = work.join(known, "cache_key", "left")
    tokens = F.when(F.col("__known").isNull(), F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    return j.agg(F.count(F.lit(1)).alias("documents"), F.count("__known").alias("cached"), F.round((F.coalesce(F.sum(tokens), F.lit(0)) * rate_in + F.count(tokens) * out_tokens * rate_out) / 1e6, 6).alias("cost_usd"))


def role_persons(roles: DataFrame, facts: DataFrame, cache: StoredCache, provider: ModelProvider, most: int = 30) -> DataFrame:
    """(role_id, canonical_name, aliases, person_type, confidence, evidence_fact_ids): who stands behind each role, by the model.

    roles (role_id, label); facts (fact_id, role_id, day, quote): the `most` earliest of a role, undated last, are shown. What
    was asked about, not when, is the key. One-word names that are a word of a longer name of the role are placeholders and are
    dropped after reading. A reply that is no list isn't cached.
    """
    shown = persons_facts(facts, most)
    prompt = F.concat(F.lit("Rôle : "), F.coalesce("label", "role_id"), F.lit("\n"), F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f["fact_id"], F.lit(" : "), F.coalesce(f["quote"], F.lit("")))), "\n"))
    work = asked(roles.join(shown, "role_id"), "roles", "role_id", [F.to_json("facts")], prompt, provider.name)
    got = _answers(work, cache, provider, lambda raw: listed(raw, PERSON).isNotNull())
    each = got.select("role_id", F.explode(listed(F.col("raw"), PERSON)).alias("p")).select("role_id", "p.*").withColumn("key", persons.merge_key(F.col("canonical_name"))).filter("key <> ''")
    return persons.without_bare_surnames(each).drop("key")


def persons_facts(facts: DataFrame, most: int) -> DataFrame:
    """(role_id, facts): the earliest of each role, in order; tasks pass on no more than `most` of a role."""
    from pyspark.sql import Window as W

    first = facts.withColumn("__n", F.row_number().over(W.partitionBy("role_id").orderBy(F.col("day").asc_nulls_last(), "fact_id"))).filter(F.col("__n") <= most)
    return first.groupBy("role_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "fact_id", "quote"))), lambda x: F.struct(x["fact_id"].alias("fact_id"), x["quote"].alias("quote"))).alias("facts"))


def checked_roster(roster: DataFrame, forbidden: DataFrame, keep_real_legal_persons: bool = False, role_mode: bool = False) -> DataFrame:
    """roster (person_id, persona) as it is, if it may be used; else an error that names what is wrong.

    A persona must not hold a name or phrase of forbidden (needle), nor anything that the structured patterns would change: the
    gate would stop what it is written into. In role mode real names of legal persons can't be kept.
    """
    from casebench.operators import anonymise

    if role_mode and keep_real_legal_persons:
        raise ValueError("a register of roles can't keep the real names of legal persons")
    personas = roster.filter("persona IS NOT NULL").select(F.col("persona").alias("doc_id"), F.col("persona").alias("body")).distinct()
    wrong = anonymise.leaks(personas, forbidden).orderBy("doc_id", "kind", "needle").limit(20).collect()
    if wrong:
        raise ValueError(f"personas that the gate would stop: {[(r.doc_id, r.needle) for r in wrong]}")
    return roster
