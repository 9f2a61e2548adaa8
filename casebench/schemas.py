"""Row types of the case tables, and splitting rows into valid and rejected with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _strings(names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names.split()]


CHUNK_FIELDS = "chunk_id source source_label num section_path titre texte etat date_debut date_fin legiarti_id url".split()
DOSSIER_CHUNK_FIELDS = "chunk_id source source_label num section_path titre texte url".split()
CHUNK = StructType(_strings(" ".join(CHUNK_FIELDS)))
FACT = StructType(_strings("fact_id date actor_role action target verbatim_quote source_doc_id source_chunk_id distilled_context"))
ROLE = StructType([*_strings("role_id label_fr grounding_note first_seen_doc_id"), StructField("fact_count", IntegerType()), *_strings("confidence")])
AMBIGUITY = StructType([*_strings("ambiguity_id doc_id description"), StructField("candidate_roles", ArrayType(StringType())), StructField("fact_ids", ArrayType(StringType())), *_strings("resolution")])
ASSIGNMENT = StructType([*_strings("role_id confidence ambiguity_note"), StructField("evidence_fact_ids", ArrayType(StringType()))])
PERSON = StructType([*_strings("person_id case_id canonical_name kind"), StructField("aliases", ArrayType(StringType())), StructField("role_assignments", ArrayType(ASSIGNMENT)), *_strings("note")])
CONFOUNDER = StructType([*_strings("text_fr source"), StructField("dispositive", BooleanType()), *_strings("added_at")])
CALIBRATION = StructType(_strings("ts tier confidence reason actor"))
POINTERS = StructType([StructField(n, ArrayType(StringType())) for n in "fact_ids doc_ids chunk_ids person_ids candidate_fact_ids scope_doc_ids".split()] + [StructField("trigger_fact_id", StringType())])
FINDING = StructType([*_strings("id pass_name subject claim evidence tier tier_basis severity confidence status obligation_id rule_version"), StructField("externalisable", BooleanType()), *_strings("qualification_interne gravite_interne"), StructField("penal_refs", ArrayType(StringType())), StructField("evidence_pointers", POINTERS), StructField("confounders", ArrayType(CONFOUNDER)), StructField("calibration", ArrayType(CALIBRATION)), *_strings("first_seen last_seen resolved_at")])
CONVERSATION = StructType([*_strings("id title"), StructField("created_at", TimestampType()), StructField("updated_at", TimestampType())])
TURN = StructType([*_strings("turn_id conversation_id"), StructField("position", IntegerType()), *_strings("question answer model citations"), StructField("cost_usd", DoubleType()), StructField("elapsed_seconds", DoubleType()), StructField("error", BooleanType()), StructField("created_at", TimestampType())])
FEEDBACK = StructType([*_strings("turn_id"), StructField("rating", IntegerType()), *_strings("comment"), StructField("created_at", TimestampType())])
VERDICT = StructType([*_strings("cache_key pass_name subject model prompt_version result_json"), StructField("cost_usd", DoubleType()), *_strings("created_at")])
USAGE = StructType([*_strings("model"), StructField("prompt_tokens", LongType()), StructField("completion_tokens", LongType())])

ROLE_ID = r"^[a-z][a-z0-9_]{2,60}$"
CASE_ID = r"^[a-z0-9][a-z0-9_-]{1,63}$"
MAX_ACTION_WORDS = 15


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def words(c: Column) -> Column:
    return F.when(blank(c), F.lit(0)).otherwise(F.size(F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " ")))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with `reason`): a row is rejected by the first rule that is true of it; null doesn't reject."""
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    marked = df.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def valid_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = F.col
    return split_valid(facts, {
        "missing_id": blank(c("fact_id")) | blank(c("source_doc_id")),
        "bad_role": ~F.coalesce(c("actor_role").rlike(ROLE_ID), F.lit(False)),
        "blank_quote": blank(c("verbatim_quote")),
        "long_action": words(c("action")) > MAX_ACTION_WORDS,
    })


def check_chunks(chunks: DataFrame, required: list[str] = DOSSIER_CHUNK_FIELDS) -> DataFrame:
    """chunks, or ValueError: a required column is missing or has nulls, or chunk_id isn't unique. One aggregate."""
    missing = [c for c in required if c not in chunks.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    got = chunks.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required], (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("__dup")).first().asDict()
    dup = got.pop("__dup")
    nulls = {c: n for c, n in got.items() if n}
    if nulls or dup:
        raise ValueError(f"nulls: {nulls}; repeated chunk_ids: {dup}")
    return chunks
