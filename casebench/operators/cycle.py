"""A case's cycle of passes, its argued report, the answers to questions, and the checks of what models return."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from casebench.functions import scalars
from casebench.functions.text import shortened
from casebench.models import ModelProvider, completed, embedded
from casebench.operators import findings, retrieval

ACTIONABLE = ("gap", "window_breach", "unverifiable")


def run_cycle(store: DataFrame, passes: list[tuple[str, Callable[[DataFrame], tuple[DataFrame, bool]]]], recorded: Callable[[DataFrame, str], DataFrame], now: Column) -> tuple[DataFrame, list[tuple[str, int, bool]]]:
    """(the store after all passes in their order, (pass, findings, complete) of each).

    A pass takes the store as the earlier ones left it and returns its findings and whether it is complete; only then are its
    open findings that it didn't make again resolved. recorded(store, pass) writes the store and returns it as read back, so
    what a pass found stands before the next one begins.
    """
    done = []
    for name, run in passes:
        made, complete = run(store)
        store = findings.reconciled(findings.upserted(store, made, now), made.select("id"), name, complete, now)
        store = recorded(store, name)
        done.append((name, made.count(), complete))
    return store, done


def status_in(evidence: Column) -> Column:
    """The status that a finding's evidence text names."""
    return F.regexp_extract(evidence, r"statut=(\w+)", 1)


def actionable(store: DataFrame) -> DataFrame:
    """Open findings of check with a status that asks for something, in the order of the report: severity, tier, obligation."""
    order = (scalars.ranked(F.col("severity"), scalars.SEVERITIES), scalars.tier_rank(F.col("tier")), "obligation_id", "id")
    kept = store.filter((F.col("status") == "open") & (F.col("pass_name") == "check")).withColumn("outcome", status_in(F.col("evidence")))
    return kept.filter(F.col("outcome").isin(*ACTIONABLE)).orderBy(*order)


def cached_verdicts(cache: DataFrame, pass_name: str = "check") -> DataFrame:
    """(obligation_id, fact_id, result_json) of cached rows (pass_name, subject, result_json) whose subject has three parts:
    obligation@version|case|fact. What isn't JSON is left out."""
    part = F.split("subject", r"\|")
    rows = cache.filter((F.col("pass_name") == pass_name) & (F.size(part) == 3) & F.try_parse_json("result_json").isNotNull())
    return rows.select(F.split(part[0], "@")[0].alias("obligation_id"), part[2].alias("fact_id"), "result_json")


def report(store: DataFrame, obligations: DataFrame, facts: DataFrame, verdicts: DataFrame, statute: DataFrame) -> DataFrame:
    """(id, section): a section for each actionable finding: title, severity, tier, claim, its law, and its facts with verdicts.

    obligations: obligation_id, title, source_chunk_id; facts: fact_id, verbatim_quote; statute: chunk_id, num, texte, url.
    Left joins only: a finding without any of these keeps its section.
    """
    of = actionable(store).select("id", "severity", "tier", "claim", "obligation_id", "outcome", F.col("evidence_pointers.fact_ids").alias("matched"), F.col("evidence_pointers.candidate_fact_ids").alias("candidates"))
    used = of.select("id", "obligation_id", F.posexplode(F.when(F.size("matched") > 0, F.col("matched")).otherwise(F.col("candidates"))).alias("pos", "fact_id"))
    used = used.join(facts.select("fact_id", "verbatim_quote"), "fact_id", "left").join(verdicts, ["obligation_id", "fact_id"], "left")
    label = F.coalesce(F.get_json_object("result_json", "$.label"), F.lit("non jugé"))
    line = F.concat(F.lit("- « "), F.coalesce(shortened(F.col("verbatim_quote"), 300), F.lit("?")), F.lit(" » `"), "fact_id", F.lit("` : "), label)
    lines = used.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    law = obligations.select("obligation_id", "title", F.col("source_chunk_id").alias("chunk_id")).join(statute.select("chunk_id", "num", "texte", "url"), "chunk_id", "left")
    j = of.join(law, "obligation_id", "left").join(lines, "id", "left")
    cited = F.concat(F.lit("> "), shortened(F.col("texte"), 600), F.lit("\n\n— art. "), "num", F.coalesce(F.concat(F.lit(" · "), F.nullif("url", F.lit(""))), F.lit("")))
    head = F.concat(F.lit("## "), F.coalesce("title", F.left("claim", F.lit(90))), F.lit("\n\n"), "severity", F.lit(" · "), "tier", F.lit(" · `"), "id", F.lit("`\n\n"), "claim")
    return j.select("id", F.concat_ws("\n\n", head, cited, "lines").alias("section"))


def merged_index(statute: DataFrame, cases: list[DataFrame], vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all chunks, (state, n) of vectors and chunks that lack each other): what a search loads, and what to warn of."""
    chunks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cases, statute)
    chunks = chunks.na.fill("", [c for c, kind in chunks.dtypes if kind == "string"])
    return chunks, retrieval.reconciled(vectors, chunks).filter("state <> 'ok'").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def answered(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, provider: ModelProvider, statute: list[str], scope: str | None = None) -> DataFrame:
    """Answers to queries (query_id, query, case_id): route, rewrite, retrieve, rerank, prompt, generate.

    The rewritten query retrieves and reranks; the prompt has the query as asked. A scope that is given skips the router. The
    scopes that occur, one a case and kind, are gone through one by one; a query without a hit has no row.
    """
    if scope is None:
        asked = completed(queries.withColumn("__p", F.concat(F.lit("route: "), "query")), "__p", provider, "__r")
        asked = retrieval.routed(asked.withColumns({"intent": F.get_json_object("__r", "$.intent"), "confidence": F.get_json_object("__r", "$.confidence")})).drop("__p", "__r")
    else:
        asked = queries.withColumns({"scope": F.lit(scope), "intent": F.lit("override"), "confidence": F.lit("high")})
    asked = completed(asked.withColumn("__p", F.concat(F.lit("rewrite: "), "query")), "__p", provider, "__r")
    asked = retrieval.rewritten(asked, "__r").drop("__p", "__r")
    search = embedded(asked.select("query_id", "scope", F.col("query_rewritten").alias("query")), "query", provider)
    out = None
    for one in [r["scope"] for r in asked.select("scope").distinct().orderBy("scope").collect()]:
        part = search.filter(F.col("scope") == one)
        hits = retrieval.retrieve(chunks, vectors, part, one, statute)
        top = retrieval.rerank(hits, part, provider)
        n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_retrieved"))
        cited = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "num", "url"))), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["num"].alias("num"), c["url"].alias("url"))).alias("citations"))
        own = asked.filter(F.col("scope") == one)
        got = completed(retrieval.prompts(top, own), "prompt", provider).join(cited, "query_id").join(n, "query_id")
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no queries")
    return asked.select("query_id", "query_rewritten", "intent", "scope", "confidence").join(out, "query_id").withColumn("chunks_reranked", F.size("citations"))


_VERDICT = "struct<missing_facts:array<string>,mistranscriptions:array<struct<claimed:string,actual:string>>>"


def verifier_parsed(raw: Column) -> Column:
    """struct(status, missing_facts, mistranscriptions) of a verifier's reply.

    ok: JSON of the right shape, prose after it ignored; parse_recovered: cut off, its complete mistranscriptions kept, which
    is never a full verdict; parse_failed: neither.
    """
    bare = scalars.unfenced(raw)
    whole = scalars.first_json(bare)
    v = F.from_json(whole, _VERDICT)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(whole), path, "variant"))
    strings = F.coalesce(kind("$.missing_facts").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True))
    pairs = F.coalesce(F.forall(v["mistranscriptions"], lambda x: x["claimed"].isNotNull() & x["actual"].isNotNull()), F.lit(True))
    lost = F.transform(scalars.recovered_objects(bare), lambda x: F.from_json(x, "struct<claimed:string,actual:string>"))
    none, nothing = F.array().cast("array<string>"), F.array().cast("array<struct<claimed:string,actual:string>>")
    made = lambda status, a, b: F.struct(F.lit(status).alias("status"), F.coalesce(a, none).alias("missing_facts"), F.coalesce(b, nothing).alias("mistranscriptions"))
    return F.when(whole.startswith("{") & strings & pairs, made("ok", v["missing_facts"], v["mistranscriptions"])).when(whole.isNull() & (F.size(lost) > 0), made("parse_recovered", none, lost)).otherwise(made("parse_failed", none, nothing))


def roster(bindings: DataFrame, groups: DataFrame) -> DataFrame:
    """(person_id, head, persona) of bindings (person_id, persona) and merge groups (head, person_id).

    A group's persona, its head's or else its first member's, goes to all of it. Two heads with one persona raise when read.
    """
    named = groups.join(bindings, "person_id", "left").groupBy("head").agg(F.coalesce(F.max(F.when(F.col("person_id") == F.col("head"), F.col("persona"))), F.min_by("persona", F.when(F.col("persona").isNotNull(), F.col("person_id")))).alias("persona"))
    merged = groups.join(named, "head").select("person_id", "head", "persona")
    alone = bindings.join(groups, "person_id", "left_anti").select("person_id", F.col("person_id").alias("head"), "persona")
    rows = merged.unionByName(alone).filter("persona IS NOT NULL")
    heads = rows.groupBy(F.col("persona").alias("__p")).agg(F.count_distinct("head").alias("__heads"))
    clash = F.raise_error(F.concat(F.lit("one persona for several people: "), "persona")).cast("string")
    return rows.join(heads, F.col("persona") == F.col("__p")).select("person_id", "head", F.when(F.col("__heads") > 1, clash).otherwise(F.col("persona")).alias("persona"))


def read_conversations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(file, id, title, turns) of a folder's JSON files, one conversation each; and the files that hold none."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.try_parse_json("value").alias("body"))
    ident = F.try_variant_get("body", "$.id", "string")
    good = files.filter(ident.isNotNull()).select("file", ident.alias("id"), F.try_variant_get("body", "$.title", "string").alias("title"), F.coalesce(F.try_variant_get("body", "$.turns", "array<variant>"), F.array().cast("array<variant>")).alias("turns"))
    return good, files.filter(ident.isNull()).select("file")


def import_stats(conversations: DataFrame, malformed: DataFrame) -> DataFrame:
    """One row: conversations, turns, errors."""
    a = conversations.agg(F.count(F.lit(1)).alias("conversations"), F.coalesce(F.sum(F.size("turns")), F.lit(0)).alias("turns"))
    return a.crossJoin(malformed.agg(F.count(F.lit(1)).alias("errors")))


def number_gaps(numbers: DataFrame, number: str, group: str) -> DataFrame:
    """(group, before, after, missing): the neighbours, in order, between which numbers of a group lack, and how many."""
    w = W.partitionBy(group).orderBy(number)
    each = numbers.select(group, number).distinct().withColumn("before", F.lag(number).over(w))
    return each.filter(F.col(number) - F.col("before") > 1).select(group, "before", F.col(number).alias("after"), (F.col(number) - F.col("before") - 1).alias("missing"))


def h2_chunks(text: Column) -> Column:
    """array<struct<heading, body>> of markdown cut at lines that begin with '## '; what stands before is '(preamble)'; blank ones go."""
    parts = F.split(text, r"(?m)^(?=## )")
    heading = lambda p: F.when(p.startswith("## "), F.trim(F.regexp_extract(p, r"^## ?([^\n]*)", 1))).otherwise("(preamble)")
    return F.filter(F.transform(parts, lambda p: F.struct(heading(p).alias("heading"), F.regexp_replace(p, r"^\s+|\s+$", "").alias("body"))), lambda x: x["body"] != "")


def looks_like_path(candidate: Column) -> Column:
    return F.contains(candidate, F.lit("/")) | candidate.rlike(r"\.[A-Za-z0-9]{1,6}$")


def stage_summary(facts: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """One row: documents with facts, facts, roles, ambiguities."""
    a = facts.agg(F.count_distinct("source_doc_id").alias("docs"), F.count(F.lit(1)).alias("facts"), F.count_distinct("actor_role").alias("roles"))
    return a.crossJoin(ambiguities.agg(F.count(F.lit(1)).alias("ambiguities")))
