"""The whole brief of a case as ordered lines: what to look into, each argued, what wasn't examined, weaker signals, defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casebench.functions import scalars
from casebench.operators import cycle, register
from casebench.sources.sinks import put_small

#: Ids that a line of what wasn't examined names at most, and documents that are listed.
NAMED, LISTED = 8, 10


def not_examined(checked: DataFrame, obligations: DataFrame, facts: DataFrame, coverage: DataFrame | None, ambiguous: DataFrame | None = None) -> DataFrame:
    """(kind, n, total, sample): what a run can say nothing about.

    untriggered: obligations (obligation_id) that checked (obligation_id of the check's findings) hasn't; unknown_documents:
    coverage (doc_id, status) other than ok, or no_coverage: all documents, if none is known; undated: facts (fact_id, doc_id,
    day) without day; ambiguous: facts whose role is open. sample: the first ids. Each is one aggregation; a kind with nothing
    to say has no row, but untriggered always has one.
    """
    first = lambda c, n: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, n), ", ")
    total = obligations.select("obligation_id").distinct()
    never = total.join(checked.select("obligation_id").distinct(), "obligation_id", "left_anti")
    rows = never.agg(F.count(F.lit(1)).alias("n"), first("obligation_id", NAMED).alias("sample")).crossJoin(total.agg(F.count(F.lit(1)).alias("total"))).select(F.lit("untriggered").alias("kind"), "n", "total", "sample")  # one row each
    docs = facts.agg(F.count_distinct("doc_id").alias("total"))
    if coverage is None:
        rows = rows.unionByName(docs.select(F.lit("no_coverage").alias("kind"), F.col("total").alias("n"), "total", F.lit("").alias("sample")))
    else:
        bad = coverage.filter("status <> 'ok' OR status IS NULL").select("doc_id").distinct()
        # documents are many: the first ones are picked by a bounded sort, not gathered
        names = bad.orderBy("doc_id").limit(LISTED).agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ", ").alias("sample"))
        rows = rows.unionByName(bad.agg(F.count(F.lit(1)).alias("n")).crossJoin(coverage.agg(F.count_distinct("doc_id").alias("total"))).crossJoin(names).filter("n > 0").select(F.lit("unknown_documents").alias("kind"), "n", "total", "sample"))
    dated = facts.agg(F.count_if(F.col("day").isNull()).alias("n"), F.count(F.lit(1)).alias("total"))
    rows = rows.unionByName(dated.filter("n > 0").select(F.lit("undated").alias("kind"), "n", "total", F.lit("").alias("sample")))
    if ambiguous is not None:
        unsure = ambiguous.select("fact_id").distinct().agg(F.count(F.lit(1)).alias("n")).crossJoin(facts.agg(F.count(F.lit(1)).alias("total")))
        rows = rows.unionByName(unsure.filter("n > 0").select(F.lit("ambiguous").alias("kind"), "n", "total", F.lit("").alias("sample")))
    return rows


def _said(gaps: DataFrame) -> DataFrame:
    """A line for each kind of not_examined(), in a fixed order."""
    n, total, sample = F.col("n").cast("string"), F.col("total").cast("string"), F.col("sample")
    more = F.when(sample != "", F.concat(F.lit(" ("), sample, F.when(F.col("n") > F.when(F.col("kind") == "untriggered", NAMED).otherwise(LISTED), F.lit(", …")).otherwise(""), F.lit(")"))).otherwise("")
    kinds = {
        "untriggered": F.concat(F.lit("- Sans déclencheur au dossier, donc non contrôlées : "), n, F.lit(" obligation(s) du catalogue sur "), total, more),
        "no_coverage": F.concat(F.lit("- Fidélité inconnue pour tous les documents : "), n),
        "unknown_documents": F.concat(F.lit("- Documents de fidélité inconnue : "), n, F.lit(" sur "), total, more),
        "undated": F.concat(F.lit("- Faits sans date, hors de tout délai : "), n, F.lit(" sur "), total),
        "ambiguous": F.concat(F.lit("- Faits dont le rôle n'est pas résolu : "), n, F.lit(" sur "), total),
    }
    at = {k: i for i, k in enumerate(kinds)}
    pick = lambda of: F.coalesce(*[F.when(F.col("kind") == k, of(k)) for k in kinds])
    return gaps.select(pick(lambda k: F.lit(at[k])).cast("long").alias("pos"), pick(lambda k: kinds[k]).alias("line"))


def brief(store: DataFrame, obligations: DataFrame, facts: DataFrame, verdicts: DataFrame, statute: DataFrame, coverage: DataFrame | None = None, ambiguous: DataFrame | None = None, case_id: str = "") -> DataFrame:
    """(part, pos, line): the brief in order of part and pos; as many lines as the store asks for, none of them on the driver.

    store: findings; obligations, facts, verdicts and statute as for cycle.report(), facts also with doc_id and day. Parts: 0
    title and number of findings to look into, 1 a table of them, 2 their argued sections, 3 what wasn't examined, 4 pairs
    that were brought together, 5 defects of the filing. Parts 1 and 2 go by severity, tier, obligation and id.
    """
    spark = store.sparkSession
    to_do = cycle.actionable(store).select("id", "severity", "tier", "obligation_id", F.coalesce("obligation_id", F.lit("")).alias("__o"), scalars.ranked(F.col("severity"), scalars.SEVERITIES).alias("__s"), scalars.tier_rank(F.col("tier")).alias("__t"))
    numbered = register.in_order(to_do, [], ["__s", "__t", "__o", "id"], "pos")
    named = numbered.join(obligations.select("obligation_id", "title"), "obligation_id", "left")
    table = named.select(F.lit(1).alias("part"), "pos", F.concat(F.lit("| "), F.col("pos").cast("string"), F.lit(" | "), F.coalesce("title", "obligation_id", F.lit("")), F.lit(" | "), F.coalesce("severity", F.lit("")), F.lit(" | "), F.coalesce("tier", F.lit("")), F.lit(" |")).alias("line"))
    sections = cycle.report(store, obligations, facts, verdicts, statute).join(numbered.select("id", "pos"), "id").select(F.lit(2).alias("part"), "pos", F.col("section").alias("line"))
    head = to_do.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("part"), F.lit(1).cast("long").alias("pos"), F.concat(F.lit(f"# Rapport — {case_id}\n\nDocument de travail. À instruire : "), F.col("n").cast("string")).alias("line"))
    frames = spark.createDataFrame([(1, 0, "| # | Obligation | Gravité | Niveau |\n|---|---|---|---|"), (3, -1, "## Ce qui n'a pas été examiné")], "part int, pos long, line string")
    checked = store.filter("pass_name = 'check'").select("obligation_id")
    gaps = _said(not_examined(checked, obligations, facts, coverage, ambiguous)).select(F.lit(3).alias("part"), "pos", "line")
    out = head.unionByName(frames).unionByName(table).unionByName(sections).unionByName(gaps)
    for part, name, title in ((4, "contradict", "## Rapprochements à vérifier"), (5, "graph", "## État du dossier")):
        own = store.filter((F.col("status") == "open") & (F.col("pass_name") == name)).select("id", F.coalesce("subject", F.lit("")).alias("subject"), F.concat_ws("\n  - ", F.concat(F.lit("- "), F.coalesce("claim", F.lit(""))), "evidence").alias("line"))
        lines = register.in_order(own, [], ["subject", "id"], "pos").select(F.lit(part).alias("part"), "pos", "line")
        out = out.unionByName(lines).unionByName(lines.limit(1).select("part", F.lit(0).cast("long").alias("pos"), F.lit(title).alias("line")))
    return out


def write_brief(lines: DataFrame, path: str) -> None:
    """The brief as one text file. A brief is what a person reads, so it is read into the driver a partition at a time."""
    ordered = lines.orderBy("part", "pos").select("line")
    put_small(lines.sparkSession, path, "\n\n".join(r.line for r in ordered.toLocalIterator()) + "\n")


def divergences(votes: DataFrame, evaluations: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings of facts that judges read differently: T5, low, never to leave, one for each obligation and fact.

    votes (obligation_id, fact_id, judge, label, reason): of each judge the label most votes have, ties to the smaller; a judge
    without one says nothing. evaluations (obligation_id, title); facts (fact_id, doc_id).
    """
    per = votes.filter("label IS NOT NULL").groupBy("obligation_id", "fact_id", "judge", "label").agg(F.count(F.lit(1)).alias("n"), F.min("reason").alias("reason"))
    said = per.groupBy("obligation_id", "fact_id", "judge").agg(F.min(F.struct((-F.col("n")).alias("n"), "label", "reason")).alias("v"))
    both = said.groupBy("obligation_id", "fact_id").agg(F.count_distinct("v.label").alias("labels"), F.array_sort(F.collect_list(F.struct("judge", F.col("v.label").alias("label"), F.left(F.coalesce("v.reason", F.lit("")), F.lit(160)).alias("reason")))).alias("judges")).filter("labels > 1")
    j = both.join(evaluations.select("obligation_id", "title").distinct(), "obligation_id", "left").join(facts.select("fact_id", "doc_id"), "fact_id", "left")
    subject = F.concat_ws("|", F.lit("divergence"), "obligation_id", "fact_id")
    claim = F.concat(F.lit("Lecture divergente d'une pièce : "), F.coalesce("title", "obligation_id"))
    each = F.array_join(F.transform("judges", lambda x: F.concat(x["judge"], F.lit("="), x["label"])), ", ")
    why = F.array_join(F.transform("judges", lambda x: F.concat(x["judge"], F.lit(" : "), x["reason"])), " ‖ ")
    none = F.array().cast("array<string>")
    return j.select(
        scalars.short_id(F.lit("check"), subject, claim).alias("id"), F.lit("check").alias("pass_name"), subject.alias("subject"), claim.alias("claim"), F.concat_ws(" · ", F.concat(F.lit("fait="), "fact_id"), each, why).alias("evidence"), F.lit("T5").alias("tier"), F.lit("lecture_divergente_entre_modeles").alias("tier_basis"),
        F.lit("info").alias("severity"), F.lit("low").alias("confidence"), "obligation_id", F.lit(False).alias("externalisable"),
        F.struct(F.array("fact_id").alias("fact_ids"), F.when(F.col("doc_id").isNotNull(), F.array("doc_id")).otherwise(none).alias("doc_ids"), none.alias("person_ids"), none.alias("candidate_fact_ids"), none.alias("scope_doc_ids"), F.lit(None).cast("string").alias("trigger_fact_id")).alias("evidence_pointers"))
