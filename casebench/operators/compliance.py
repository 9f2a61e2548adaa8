"""Compliance of roles with statute: entries, model comparison, and discovery of obligations in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebench.functions import lexicon, scalars
from casebench.functions.text import glob_column, pages

STATUSES = ("met", "breached", "unclear", "not_applicable")
ENTRY = "array<struct<chunk_id:string,status:string,confidence:string,rationale:string,fact_ids:array<string>>>"


def role_queries(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, query): for each role its label and first five actions, to search the statute with."""
    from casebench.operators.persons import first_actions

    a = first_actions(facts)
    return a.join(labels.select(F.col("role_id").alias("actor_role"), "label"), "actor_role", "left").select(F.col("actor_role").alias("query_id"), F.concat_ws(" : ", F.coalesce("label", "actor_role"), "actions").alias("query"))


def entries(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason) of model answers (role_id, result_json): one row an entry, id by chunk and role.

    A truncated list gives its complete entries.
    """
    from casebench.functions.scalars import recovered_objects
    from casebench.schemas import blank, split_valid

    each = answers.select("role_id", F.explode(recovered_objects("result_json")).alias("o"))
    parsed = each.select("role_id", F.from_json("o", ENTRY[6:-1]).alias("e")).select("role_id", "e.*")
    valid, rejected = split_valid(parsed, {"missing_chunk": blank(F.col("chunk_id")), "bad_status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "blank_rationale": blank(F.col("rationale"))})
    return valid.withColumn("entry_id", scalars.short_sha1(F.col("chunk_id"), F.col("role_id"))), rejected


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(entry_id, presence, status_a, status_b, agree) of two models' entries: shared, a_only or b_only."""
    x, y = a.select("entry_id", F.col("status").alias("status_a")), b.select("entry_id", F.col("status").alias("status_b"))
    return x.join(y, "entry_id", "full_outer").select("entry_id", F.when(F.col("status_b").isNull(), "a_only").when(F.col("status_a").isNull(), "b_only").otherwise("shared").alias("presence"), "status_a", "status_b", (F.col("status_a") == F.col("status_b")).alias("agree"))


def with_persons(matrix: DataFrame, holders: DataFrame) -> DataFrame:
    """entries with persons: holders (role_id, person_id, name, confidence) of the role; for met and breached not those of low confidence."""
    j = matrix.join(holders.withColumnRenamed("confidence", "__c"), "role_id", "left")
    ok = F.col("person_id").isNotNull() & ~(F.col("status").isin("met", "breached") & (F.col("__c") == "low"))
    keep = [c for c in matrix.columns if c != "role_id"]
    people = j.groupBy("role_id", "entry_id").agg(F.array_sort(F.collect_set(F.when(ok, F.struct("person_id", "name")))).alias("persons"))
    return matrix.join(people, ["role_id", "entry_id"], "left").select("role_id", *keep, "persons")


def cost_gate(estimates: DataFrame, ceiling: float) -> DataFrame:
    """One row with the total; over the ceiling it raises when read."""
    total = F.sum(F.coalesce("cost_usd", F.lit(0.0)))
    return estimates.agg(F.when(total > ceiling, F.raise_error(F.concat(F.lit("estimated cost over the ceiling: "), total.cast("string"))).cast("double")).otherwise(total).alias("cost_usd"))


def prorated(log: DataFrame, ceiling: float) -> DataFrame:
    """log (seq, cost_usd): running cost against the share of the ceiling that seq of all is due."""
    n = log.agg(F.count(F.lit(1)).alias("__n"))
    w = W.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)  # one run's clusters
    return log.crossJoin(n).withColumns({"spent": F.sum(F.coalesce("cost_usd", F.lit(0.0))).over(w), "due": F.row_number().over(W.orderBy("seq")) / F.col("__n") * ceiling}).withColumn("over", F.col("spent") > F.col("due")).drop("__n")


def documents_to_read(documents: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Documents (doc_id, body) that have an obligation marker, or whose id a pattern matches; most markers first."""
    marked = documents.withColumn("markers", lexicon.obligation_markers(lexicon.fold(F.col("body"))))
    if patterns:
        named = F.lit(False)
        for p in patterns:
            named = named | F.rlike(F.col("doc_id"), glob_column(F.lit(p)))
        return marked.filter(named).orderBy(F.size("markers").desc(), "doc_id")
    return marked.filter(F.size("markers") > 0).orderBy(F.size("markers").desc(), "doc_id")


def page_windows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode(pages(F.col("body"))).alias("p")).select("doc_id", "p.page", "p.body")


def proposals(raw: DataFrame, windows: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of proposals (seq, doc_id, page, obligation_id, excerpt, role, terms).

    Rejected: a field is missing, the excerpt isn't in its page word for word, the role is unknown, no terms. Of one
    obligation_id the first stays.
    """
    from casebench.schemas import blank, split_valid

    j = raw.join(windows.select("doc_id", "page", F.col("body").alias("__b")), ["doc_id", "page"], "left").join(roles.select(F.col("role_id").alias("role"), F.lit(True).alias("__known")), "role", "left")
    rules = {"missing_field": blank(F.col("obligation_id")) | blank(F.col("excerpt")) | blank(F.col("role")), "excerpt_not_verbatim": ~F.coalesce(F.contains("__b", F.col("excerpt")), F.lit(False)), "unknown_role": F.col("__known").isNull(), "no_terms": F.coalesce(F.size("terms"), F.lit(0)) <= 0}
    valid, rejected = split_valid(j, rules)
    first = valid.withColumn("__n", F.row_number().over(W.partitionBy("obligation_id").orderBy("seq"))).filter("__n = 1")
    return first.select(*raw.columns), rejected.select(*raw.columns, "reason")


def role_inputs(facts: DataFrame, hits: DataFrame, model: str) -> DataFrame:
    """(role_id, fingerprint) of all that a role's answer depends on: facts and chunks, whatever their order, and the model."""
    f = facts.groupBy(F.col("actor_role").alias("role_id")).agg(F.array_sort(F.collect_set("fact_id")).alias("f"))
    h = hits.groupBy(F.col("query_id").alias("role_id")).agg(F.array_sort(F.collect_set("chunk_id")).alias("c"))
    return f.join(h, "role_id", "left").select("role_id", scalars.fingerprint(F.concat("f", F.coalesce("c", F.array().cast("array<string>"))), F.lit(model)).alias("fingerprint"))
