"""What is wrong with a case's tables and citations, and what they leave unexamined."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casebench.functions import scalars
from casebench.functions.lexicon import fold
from casebench.functions.text import glob_column, squeeze


def dangling_edges(edges: DataFrame, facts: DataFrame) -> DataFrame:
    return edges.join(facts.select("fact_id"), "fact_id", "left_anti")


def uncatalogued_roles(facts: DataFrame, roles: DataFrame) -> DataFrame:
    return facts.select(F.col("actor_role").alias("role_id")).distinct().join(roles.select("role_id"), "role_id", "left_anti")


def documents_without_facts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    return documents.select("doc_id").join(facts.select(F.col("source_doc_id").alias("doc_id")).distinct(), "doc_id", "left_anti")


def integrity(facts: DataFrame, roles: DataFrame, edges: DataFrame, documents: DataFrame, coverage: DataFrame, rejected: int = 0, sample: int = 5) -> DataFrame:
    """(kind, n, sample) of each defect there is: seven kinds, each a count and its first members."""
    none = facts.sparkSession.createDataFrame([(f"{rejected} lignes",)] if rejected else [], "m string")
    kinds = {
        "dangling_edge": dangling_edges(edges, facts).select(F.concat_ws("|", "person_id", "fact_id").alias("m")),
        "uncatalogued_role": uncatalogued_roles(facts, roles).select(F.col("role_id").alias("m")),
        "document_without_facts": documents_without_facts(documents, facts).select(F.col("doc_id").alias("m")),
        "document_not_verified": documents.join(coverage.filter("status = 'ok'"), "doc_id", "left_anti").select(F.col("doc_id").alias("m")),
        "undated_fact": facts.filter(scalars.iso_date(F.col("date")).isNull()).select(F.col("fact_id").alias("m")),
        "unanchored_fact": facts.filter("source_chunk_id IS NULL").select(F.col("fact_id").alias("m")),
        "unparsed_rows": none,
    }
    union = None
    for kind, df in kinds.items():
        part = df.select(F.lit(kind).alias("kind"), "m")
        union = part if union is None else union.unionByName(part)
    # smallest members without gathering all of them
    return union.distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[F.min("m").alias("__first")]).join(_heads(union, sample), "kind").drop("__first")


def _heads(members: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window as W

    top = members.distinct().withColumn("__n", F.row_number().over(W.partitionBy("kind").orderBy("m"))).filter(F.col("__n") <= n)
    return top.groupBy("kind").agg(F.array_sort(F.collect_list("m")).alias("sample"))


def health(facts: DataFrame, coverage: DataFrame | None, ambiguous: DataFrame, rejected: int) -> DataFrame:
    """One row: whether coverage and parsing are known to be sound, and how many facts are defective."""
    known = coverage is not None and not coverage.isEmpty() and rejected == 0
    return facts.join(ambiguous.select("fact_id").distinct().withColumn("bad", F.lit(1)), "fact_id", "left").agg(F.lit(known).alias("coverage_known"), F.count("bad").alias("defective"))


def anchors(obligations: DataFrame) -> DataFrame:
    """(obligation_id, chunk_id, kind) of obligations (source_chunk_id, also, penal: arrays of chunk ids)."""
    of = lambda kind, c: F.transform(c, lambda x: F.struct(x.alias("chunk_id"), F.lit(kind).alias("kind")))
    all_of = F.concat(F.filter(F.array(F.struct(F.col("source_chunk_id").alias("chunk_id"), F.lit("source").alias("kind"))), lambda a: a["chunk_id"].isNotNull()), of("also", F.col("also")), of("penal", F.col("penal")))
    return obligations.select("obligation_id", F.explode(all_of).alias("a")).select("obligation_id", "a.chunk_id", "a.kind")


def citations(obligations: DataFrame, statute: DataFrame) -> DataFrame:
    """(obligation_id, chunk_id, kind, problem): absent from the corpus, not in force, or (source) an excerpt that isn't in the text.

    A state of VIGUEUR_DIFF, though kept when articles are read, counts as not in force here. obligations also has excerpt.
    """
    a = anchors(obligations).join(obligations.select("obligation_id", "excerpt"), "obligation_id")
    j = a.join(statute.select("chunk_id", "etat", "texte").withColumn("__there", F.lit(True)), "chunk_id", "left")
    verbatim = F.contains(squeeze(fold(F.coalesce("texte", F.lit("")))), squeeze(fold(F.col("excerpt"))))
    problem = F.when(F.col("__there").isNull(), "anchor_absent").when(~F.col("etat").isin("", "VIGUEUR"), "not_in_force").when((F.col("kind") == "source") & ~verbatim, "excerpt_not_verbatim")
    return j.withColumn("problem", problem).filter("problem IS NOT NULL").select("obligation_id", "chunk_id", "kind", "problem")


def clause_citations(obligations: DataFrame, documents: DataFrame) -> DataFrame:
    """(obligation_id, problem) of clauses (doc_id_pattern, excerpt) over documents (doc_id, body): no such document, or the excerpt in none."""
    o = F.broadcast(obligations.select("obligation_id", "doc_id_pattern", fold(F.col("excerpt")).alias("x"))) if obligations.count() <= 10_000 else obligations.select("obligation_id", "doc_id_pattern", fold(F.col("excerpt")).alias("x"))
    met = documents.join(o, F.rlike(F.col("doc_id"), glob_column(F.col("doc_id_pattern")))).groupBy("obligation_id").agg(F.bool_or(F.contains(fold(F.col("body")), F.col("x"))).alias("found"))
    return obligations.select("obligation_id").join(met, "obligation_id", "left").withColumn("problem", F.when(F.col("found").isNull(), "no_document").when(~F.col("found"), "excerpt_not_found")).filter("problem IS NOT NULL").drop("found")


def corpus_gaps(obligations: DataFrame, statute: DataFrame) -> DataFrame:
    """(chunk_id, obligations): anchors that the corpus lacks, with who wants them."""
    return anchors(obligations).join(statute.select("chunk_id"), "chunk_id", "left_anti").groupBy("chunk_id").agg(F.array_sort(F.collect_set("obligation_id")).alias("obligations"))


def unexamined(evaluations: DataFrame, documents: DataFrame, coverage: DataFrame, facts: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(topic, n): what a report must say it didn't look at."""
    rows = [
        evaluations.filter("status = 'not_triggered'").agg(F.lit("untriggered_obligations").alias("topic"), F.count(F.lit(1)).alias("n")),
        documents.join(coverage.select("doc_id"), "doc_id", "left_anti").agg(F.lit("documents_of_unknown_fidelity").alias("topic"), F.count(F.lit(1)).alias("n")),
        facts.filter(scalars.iso_date(F.col("date")).isNull()).agg(F.lit("undated_facts").alias("topic"), F.count(F.lit(1)).alias("n")),
        ambiguous.agg(F.lit("ambiguous_facts").alias("topic"), F.count_distinct("fact_id").alias("n")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of all columns, in one pass."""
    each = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return each.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c) for c in df.columns]))).alias("column", "nulls"))
