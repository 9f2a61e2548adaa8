"""Obligations against facts: triggers, evidence, deadlines, coverage, five statuses, tiers and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebench.functions import scalars
from casebench.functions.lexicon import fold
from casebench.functions.text import glob_column, template
from casebench.session import written

MATCH_FIELDS = ("action", "target", "verbatim_quote", "distilled_context")
MAX_CANDIDATES = 8

LEAF = ("obligation_id string, leaf int, branch string, actor_roles array<string>, any_actor boolean, any_terms array<string>, match_fields array<string>, "
        "after_trigger boolean, before_or_at_trigger boolean, bind_to_foreach boolean, min_count int")
OBLIGATION = ("obligation_id string, rule_version string, title string, severity string, externalisable boolean, bearer_roles array<string>, "
              "trigger_roles array<string>, trigger_terms array<string>, trigger_fields array<string>, trigger_select string, deadline_days int, foreach_roles array<string>, "
              "doc_id_patterns array<string>, require_gate_status string, absence_tier_cap string, presence_tier_cap string, claim_template string")


def leaf(branch: str, terms: tuple[str, ...] = (), roles: tuple[str, ...] = (), any_actor: bool = False, fields: tuple[str, ...] = MATCH_FIELDS, after: bool = False, before: bool = False, bind: bool = False, least: int = 1) -> dict:
    """A leaf of an obligation's evidence; bad ones raise."""
    if branch not in ("all_of", "any_of", "none_of") or not fields or set(fields) - set(MATCH_FIELDS) or (after and before) or least < 1:
        raise ValueError(f"bad leaf: {branch} {fields} after={after} before={before} min_count={least}")
    return {"branch": branch, "actor_roles": list(roles), "any_actor": any_actor, "any_terms": list(terms), "match_fields": list(fields), "after_trigger": after, "before_or_at_trigger": before, "bind_to_foreach": bind, "min_count": least}


def obligation(ident: str, bearer: tuple[str, ...], leaves: list[dict], claim: str, version: str = "1", title: str = "", severity: str = "medium", externalisable: bool = True, trigger_terms: tuple[str, ...] | None = None, trigger_roles: tuple[str, ...] = (), trigger_select: str = "earliest", deadline_days: int | None = None, foreach: tuple[str, ...] | None = None, patterns: tuple[str, ...] = (), gate: str = "ok", absence_cap: str = "T3", presence_cap: str = "T1") -> tuple[dict, list[dict]]:
    """An obligation's row and its leaves' rows; a defect raises ValueError."""
    placeholders = {p for p in ("foreach_role", "foreach_key") if "{" + p + "}" in claim}
    if not leaves or not bearer or not version.strip():
        raise ValueError(f"{ident}: needs leaves, bearers and a version")
    if foreach is None and (any(x["bind_to_foreach"] for x in leaves) or placeholders):
        raise ValueError(f"{ident}: bound to a foreach that isn't there")
    if foreach is not None and len(placeholders) < 2:
        raise ValueError(f"{ident}: the claim must name foreach_role and foreach_key, or its instances are one finding")
    if trigger_terms is None and any(x["after_trigger"] or x["before_or_at_trigger"] for x in leaves):
        raise ValueError(f"{ident}: a leaf is relative to a trigger that isn't there")
    row = {"obligation_id": ident, "rule_version": version, "title": title, "severity": severity, "externalisable": externalisable, "bearer_roles": list(bearer), "trigger_roles": list(trigger_roles) if trigger_terms is not None else None, "trigger_terms": list(trigger_terms) if trigger_terms is not None else None, "trigger_fields": list(MATCH_FIELDS), "trigger_select": trigger_select, "deadline_days": deadline_days, "foreach_roles": list(foreach) if foreach is not None else None, "doc_id_patterns": list(patterns), "require_gate_status": gate, "absence_tier_cap": absence_cap, "presence_tier_cap": presence_cap, "claim_template": claim}
    return row, [{"obligation_id": ident, "leaf": i, **x} for i, x in enumerate(leaves)]


def catalog(spark, entries: list[tuple[dict, list[dict]]]) -> tuple[DataFrame, DataFrame]:
    """(obligations, leaves) as DataFrames, terms folded."""
    from casebench.functions.lexicon import folded

    rows = [{**o, "trigger_terms": None if o["trigger_terms"] is None else [folded(t) for t in o["trigger_terms"]]} for o, _ in entries]
    leaves = [{**x, "any_terms": [folded(t) for t in x["any_terms"]]} for _, ls in entries for x in ls]
    return spark.createDataFrame(rows, OBLIGATION), spark.createDataFrame(leaves, LEAF)


def prepared(facts: DataFrame) -> DataFrame:
    """fact_id, doc_id, role, day and the folded fields."""
    return facts.select("fact_id", F.col("source_doc_id").alias("doc_id"), F.col("actor_role").alias("role"), scalars.iso_date(F.col("date")).alias("day"), *[fold(F.col(f)).alias(f) for f in MATCH_FIELDS])


def _has_term(terms: Column, fields: Column) -> Column:
    """Any term within the named folded fields joined by blanks; no terms: true."""
    blob = F.concat_ws(" ", *[F.when(F.array_contains(fields, f), F.col(f)).otherwise(F.lit("")) for f in MATCH_FIELDS])
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(blob, t))


def triggers(obligations: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each obligation with a trigger that fires: trigger_id, trigger_day, trigger_doc, trigger_ambiguous (more than one date).

    The dated fact chosen by trigger_select: the earliest with the smallest id, or the latest with the largest; without dates the
    smallest id, with no day. A fact whose role is unsure (column unsure, if there) fires nothing by role. One pass over the
    facts, one aggregation.
    """
    asked = obligations.filter("trigger_terms IS NOT NULL").select("obligation_id", F.col("trigger_roles").alias("roles"), F.col("trigger_terms").alias("any_terms"), F.col("trigger_fields").alias("match_fields"), "trigger_select")
    met = _met(asked, facts, F.lit(True), "trigger_select")
    first = F.min(F.struct(F.col("day").isNull().alias("undated"), "day", "fact_id", "doc_id"))
    last = F.max(F.when(F.col("day").isNotNull(), F.struct("day", "fact_id", "doc_id")))
    got = met.groupBy("obligation_id").agg(first.alias("f"), last.alias("l"), F.any_value("trigger_select").alias("s"), (F.min("day") != F.max("day")).alias("several"))
    pick = lambda c: F.when((F.col("s") == "latest") & F.col("l").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"f.{c}"))
    return got.select("obligation_id", pick("fact_id").alias("trigger_id"), pick("day").alias("trigger_day"), pick("doc_id").alias("trigger_doc"), F.coalesce("several", F.lit(False)).alias("trigger_ambiguous"))


def _met(asked: DataFrame, facts: DataFrame, also: Column, *kept: str) -> DataFrame:
    """(obligation_id, kept, fact_id, doc_id, day) where a fact meets a row of asked (roles, any_terms, match_fields) and `also`.

    Rows with roles meet the facts by an equi-join on the role. Those without meet every fact, as they must: they are a part of
    the catalogue, which was made on the driver, so they go to the tasks that hold the facts, and only hits leave them. A fact
    whose role is unsure is met by no role.
    """
    held = facts if "unsure" in facts.columns else facts.withColumn("unsure", F.lit(False))
    out = ["obligation_id", *kept, "fact_id", "doc_id", "day"]
    term = _has_term(F.col("any_terms"), F.col("match_fields"))
    by_role = asked.filter(F.size("roles") > 0).withColumn("__role", F.explode(F.array_distinct("roles")))
    known = held.filter(~F.col("unsure")).join(F.broadcast(by_role), F.col("role") == F.col("__role")).filter(term & also).select(out)
    anyone = held.join(F.broadcast(asked.filter(F.size("roles") == 0)), term & also).select(out)
    return known.unionByName(anyone)


def instances(obligations: DataFrame, person_roles: DataFrame | None) -> DataFrame:
    """A row an obligation, or with a foreach a row for each role of its roles and person (person_id, role) that has it."""
    plain = obligations.filter("foreach_roles IS NULL").select(*KEPT, F.lit(None).cast("string").alias("foreach_key"), F.lit(None).cast("string").alias("foreach_role"))
    if person_roles is None:
        return plain
    each = obligations.filter("foreach_roles IS NOT NULL").select(*KEPT, F.explode(F.array_distinct("foreach_roles")).alias("foreach_role"))
    held = person_roles.select(F.col("person_id").alias("foreach_key"), F.col("role").alias("__pr")).distinct()
    return plain.unionByName(each.join(held, F.col("foreach_role") == F.col("__pr")).select(*KEPT, "foreach_key", "foreach_role"))


#: What an instance needs of its obligation before its facts are met.
KEPT = ("obligation_id", "bearer_roles", "doc_id_patterns", "require_gate_status")


def hits(obligations: DataFrame, leaves: DataFrame, facts: DataFrame, fired: DataFrame) -> DataFrame:
    """(obligation_id, leaf, branch, bind, fact_id, doc_id, day): the facts that each leaf of a fired obligation hits, as rows.

    A leaf goes by its own roles, else by the bearers', else (any_actor) by none. An undated fact satisfies any before/after
    condition. fired: triggers(). Who a bound leaf's facts belong to is not looked at yet.
    """
    rules = obligations.select("obligation_id", "bearer_roles", "trigger_terms").join(fired.select("obligation_id", "trigger_id", "trigger_day"), "obligation_id", "left").filter("trigger_terms IS NULL OR trigger_id IS NOT NULL")
    roles = F.when(F.size("actor_roles") > 0, F.col("actor_roles")).when(~F.col("any_actor"), F.col("bearer_roles")).otherwise(F.array().cast("array<string>"))
    asked = leaves.join(rules, "obligation_id").select("obligation_id", "leaf", "branch", F.col("bind_to_foreach").alias("bind"), roles.alias("roles"), "any_terms", "match_fields", "after_trigger", "before_or_at_trigger", "trigger_day")
    in_time = (~F.col("after_trigger") | scalars.after_or_unknown(F.col("day"), F.col("trigger_day"))) & (~F.col("before_or_at_trigger") | scalars.before_or_unknown(F.col("day"), F.col("trigger_day")))
    return _met(asked, facts, in_time, "leaf", "branch", "bind")


def ranked_candidates(obligations: DataFrame, leaves: DataFrame, facts: DataFrame, each: DataFrame, owned: DataFrame) -> DataFrame:
    """(__i, candidates): of each instance the facts of its bearers that mention most of the obligation's terms, then by id.

    With a foreach only the person's own. MAX_CANDIDATES at most: tasks pass on no more than that of an instance.
    """
    terms = leaves.groupBy("obligation_id").agg(F.flatten(F.collect_list("any_terms")).alias("terms"))
    bearers = obligations.join(terms, "obligation_id").select("obligation_id", "terms", F.explode(F.array_distinct("bearer_roles")).alias("__role"))
    found = F.size(F.filter("terms", lambda t: F.contains(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in MATCH_FIELDS]), t)))
    best = lambda df, by: df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(F.col("found").desc(), "fact_id"))).filter(F.col("__n") <= MAX_CANDIDATES)
    pool = facts.join(F.broadcast(bearers), F.col("role") == F.col("__role")).select("obligation_id", "fact_id", found.alias("found"))
    # the first of an obligation, before instances meet them
    loose = each.filter("foreach_key IS NULL").select("__i", "obligation_id").join(best(pool, "obligation_id"), "obligation_id")
    tied = each.filter("foreach_key IS NOT NULL").select("__i", "obligation_id", F.col("foreach_key").alias("__p")).join(pool.join(owned, F.col("fact_id") == F.col("__f")), ["obligation_id", "__p"])
    first = loose.select("__i", "fact_id", "__n").unionByName(best(tied.select("__i", "fact_id", "found"), "__i").select("__i", "fact_id", "__n"))
    return first.groupBy("__i").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "fact_id"))), lambda x: x["fact_id"]).alias("candidates"))


def evaluate(obligations: DataFrame, leaves: DataFrame, facts: DataFrame, coverage: DataFrame | None = None, person_facts: DataFrame | None = None, person_roles: DataFrame | None = None, ambiguous: DataFrame | None = None, with_matched: bool = True) -> DataFrame:
    """One row an obligation and foreach instance: status, matched, candidates, breach_days, scope and coverage.

    facts: prepared(); coverage (doc_id, status); person_facts (person_id, fact_id); ambiguous (fact_id): left out where a
    leaf goes by role. An undated fact makes no deadline late. Hits are counted by leaf before instances meet them, so an
    instance that every fact satisfies is a few partial sums. The lists of matched facts are as long as there are hits;
    without with_matched they are null, and hits() has them as rows. The folded facts, the triggers and the hits are written to
    the shared folder, as several branches read them.
    """
    if ambiguous is not None:
        facts = facts.join(ambiguous.select(F.col("fact_id").alias("__f"), F.lit(True).alias("unsure")).distinct(), F.col("fact_id") == F.col("__f"), "left").withColumn("unsure", F.coalesce("unsure", F.lit(False))).drop("__f")
    else:
        facts = facts.withColumn("unsure", F.lit(False))
    facts = written(facts, "facts")
    none = F.array().cast("array<string>")
    owned = person_facts.select(F.col("person_id").alias("__p"), F.col("fact_id").alias("__f")).distinct() if person_facts is not None else facts.select(F.col("role").alias("__p"), F.col("fact_id").alias("__f")).limit(0)
    fired = written(triggers(obligations, facts), "fired")
    instance = F.concat_ws("|", "obligation_id", F.concat(F.lit("="), "foreach_role"), F.concat(F.lit("="), "foreach_key")).alias("__i")
    each = instances(obligations, person_roles).select("*", instance).join(fired, "obligation_id", "left")
    met = written(hits(obligations, leaves, facts, fired), "hits")
    tied = met.filter("bind").join(owned, F.col("fact_id") == F.col("__f"))
    count = [F.count(F.lit(1)).alias("n"), F.min("day").alias("day")]
    loose_n = met.filter("NOT bind").groupBy("obligation_id", "leaf").agg(*count).select("obligation_id", "leaf", F.lit(None).cast("string").alias("__p"), "n", "day")
    counts = loose_n.unionByName(tied.groupBy("obligation_id", "leaf", "__p").agg(*count))
    asked = each.select("__i", "obligation_id", "foreach_key").join(leaves.select("obligation_id", "leaf", "branch", "min_count", "bind_to_foreach"), "obligation_id")
    asked = asked.withColumn("__of", F.when(F.col("bind_to_foreach"), F.col("foreach_key")))
    counts = counts.withColumnsRenamed({"obligation_id": "__o", "leaf": "__l"})
    counted = asked.join(counts, (F.col("obligation_id") == F.col("__o")) & (F.col("leaf") == F.col("__l")) & F.col("__of").eqNullSafe(F.col("__p")), "left")
    enough = F.coalesce("n", F.lit(0)) >= F.col("min_count")
    of = lambda b: F.col("branch") == b
    sums = counted.groupBy("__i").agg(
        (F.bool_and(~of("all_of") | enough) & (~F.bool_or(of("any_of")) | F.bool_or(of("any_of") & enough)) & ~F.bool_or(of("none_of") & enough)).alias("holds"), F.min(F.when(~of("none_of"), F.col("day"))).alias("evidence_day"))
    out = each.drop(*[c for c in KEPT if c != "obligation_id"]).join(sums, "__i").join(obligations, "obligation_id")
    out = out.join(scoped(each, facts, coverage, obligations.filter(F.size("doc_id_patterns") > 0).isEmpty()), "__i", "left")
    out = out.join(ranked_candidates(obligations, leaves, facts, each, owned), "__i", "left")
    if with_matched:
        loose_ids = met.filter("NOT bind AND branch <> 'none_of'").groupBy("obligation_id").agg(F.collect_set("fact_id").alias("__loose"))
        tied_ids = tied.filter("branch <> 'none_of'").groupBy(F.col("obligation_id").alias("__o"), "__p").agg(F.collect_set("fact_id").alias("__tied"))
        out = out.join(loose_ids, "obligation_id", "left").join(tied_ids, (F.col("obligation_id") == F.col("__o")) & (F.col("foreach_key") == F.col("__p")), "left")
        matched = F.array_sort(F.array_union(F.coalesce("__loose", none), F.coalesce("__tied", none)))
    else:
        matched = F.lit(None).cast("array<string>")
    fires = F.col("trigger_terms").isNull() | F.col("trigger_id").isNotNull()
    due = F.date_add("trigger_day", F.col("deadline_days"))
    late = F.col("deadline_days").isNotNull() & F.col("trigger_day").isNotNull() & ~F.coalesce("trigger_ambiguous", F.lit(False)) & (F.col("evidence_day") > due)
    status = F.when(~fires, "not_triggered").when(F.col("holds"), F.when(F.coalesce(late, F.lit(False)), "window_breach").otherwise("satisfied")).when(F.coalesce("verified_docs", F.lit(0)) > 0, "gap").otherwise("unverifiable")
    return out.select("obligation_id", "foreach_key", "foreach_role", "rule_version", "title", "severity", "externalisable", "claim_template", "absence_tier_cap", "presence_tier_cap", status.alias("status"), matched.alias("matched"), F.when(fires, F.coalesce("candidates", none)).otherwise(none).alias("candidates"),
                      "trigger_id", "trigger_day", F.coalesce("trigger_ambiguous", F.lit(False)).alias("trigger_ambiguous"), F.when(status == "window_breach", F.datediff("evidence_day", due)).alias("breach_days"), F.coalesce("scope_docs", none).alias("scope_docs"), F.coalesce("verified_docs", F.lit(0)).cast("int").alias("verified_docs"), F.lit(coverage is not None).alias("coverage_known"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys that may be null."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, on, "left").drop(*[f"__{k}" for k in keys])


def scoped(each: DataFrame, facts: DataFrame, coverage: DataFrame | None, no_patterns: bool) -> DataFrame:
    """(__i, scope_docs, verified_docs) of instances: documents where the evidence would be, and those that passed the gate.

    By glob patterns over all documents if an obligation has any; else those of the bearers' facts and of the trigger: both are
    looked up in one table of documents by role and by their own name.
    """
    by = facts.select(F.explode(F.array(F.struct(F.lit("role").alias("kind"), F.col("role").alias("of"), "doc_id"), F.struct(F.lit("doc").alias("kind"), F.col("doc_id").alias("of"), "doc_id"))).alias("d")).select("d.*").distinct()
    wants = F.concat(F.transform("bearer_roles", lambda r: F.struct(F.lit("role").alias("kind"), r.alias("of"))), F.array(F.struct(F.lit("doc").alias("kind"), F.col("trigger_doc").alias("of"))))
    scope = each.filter(F.size("doc_id_patterns") == 0).select("__i", "require_gate_status", F.explode(wants).alias("w")).select("__i", "require_gate_status", "w.*").join(by, ["kind", "of"]).select("__i", "require_gate_status", "doc_id")
    if not no_patterns:
        docs = facts.select("doc_id") if coverage is None else facts.select("doc_id").unionByName(coverage.select("doc_id"))
        globs = each.filter(F.size("doc_id_patterns") > 0).select("__i", "require_gate_status", F.explode("doc_id_patterns").alias("glob"))
        # a catalogue's patterns: few, whatever the documents are; each document meets each
        scope = scope.unionByName(docs.distinct().join(globs, F.rlike(F.col("doc_id"), glob_column(F.col("glob")))).select("__i", "require_gate_status", "doc_id"))
    scope = scope.distinct()
    if coverage is None:
        return scope.groupBy("__i").agg(F.array_sort(F.collect_set("doc_id")).alias("scope_docs"), F.lit(0).alias("verified_docs"))
    return scope.join(coverage.select("doc_id", "status"), "doc_id", "left").groupBy("__i").agg(F.array_sort(F.collect_set("doc_id")).alias("scope_docs"), F.count_if(F.col("status") == F.col("require_gate_status")).alias("verified_docs"))


def latest_coverage(log: DataFrame) -> DataFrame:
    """(doc_id, status): the last line of each document in an append log (doc_id, status, line)."""
    return log.groupBy("doc_id").agg(F.max_by("status", "line").alias("status"))


def tier_of(status: Column, matched: Column, defective: Column, docs: Column, all_ok: Column, coverage_known: Column, scope: Column, verified: Column) -> Column:
    """struct(tier, basis) by the decision table. matched, defective, docs, scope, verified: counts; defective: of matched or candidate facts."""
    made = lambda t, b: F.struct(F.lit(t).alias("tier"), F.lit(b).alias("basis"))
    presence = F.when((matched > 0) & (defective > 0), made("T5", "presence_defaut_integrite")).when((docs >= 2) & all_ok & coverage_known, made("T1", "presence_multi_source_couvert")).when(matched > 0, made("T2", "presence_source_unique")).otherwise(made("T5", "presence_sans_fait"))
    absence = F.when(defective > 0, made("T5", "absence_defaut_integrite")).when(~coverage_known, made("T5", "absence_perimetre_non_couvert")).when((scope > 0) & (verified == scope), made("T3", "absence_perimetre_couvert")).when(verified == 0, made("T5", "absence_perimetre_non_couvert")).otherwise(made("T4", "absence_perimetre_partiellement_couvert"))
    return F.when(status.isin("satisfied", "window_breach"), presence).when(status.isin("gap", "unverifiable"), absence)


def capped(tier: Column, basis: Column, adjudicated: Column, cap: Column) -> Column:
    t = F.when(adjudicated, scalars.weaker(tier, F.lit("T4"))).otherwise(tier)
    return F.struct(scalars.weaker(t, cap).alias("tier"), F.when(adjudicated, F.concat(basis, F.lit("+adjudication"))).otherwise(basis).alias("basis"))


def findings(evaluations: DataFrame, facts: DataFrame, coverage: DataFrame | None = None, defective: DataFrame | None = None, adjudicated: DataFrame | None = None) -> DataFrame:
    """Findings of evaluations that were triggered: id, subject, claim, evidence, tier and basis, severity, confidence, pointers."""
    key = ["obligation_id", "foreach_role", "foreach_key"]
    on = evaluations.filter("status <> 'not_triggered'")
    presence = F.col("status").isin("satisfied", "window_breach")
    used = on.select(*key, F.explode_outer(F.when(presence, F.col("matched")).otherwise(F.col("candidates"))).alias("fact_id")).join(facts.select("fact_id", "doc_id"), "fact_id", "left")
    used = used.join(defective.select("fact_id", F.lit(1).alias("bad")).distinct(), "fact_id", "left") if defective is not None else used.withColumn("bad", F.lit(None).cast("int"))
    used = used.join(coverage.filter("status = 'ok'").select("doc_id", F.lit(1).alias("ok")).distinct(), "doc_id", "left") if coverage is not None else used.withColumn("ok", F.lit(None).cast("int"))
    stats = used.groupBy(*key).agg(F.count("bad").alias("n_bad"), F.count_distinct("doc_id").alias("n_docs"), (F.count_distinct("doc_id") == F.count_distinct(F.when(F.col("ok") == 1, F.col("doc_id")))).alias("docs_ok"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    j = _null_safe(on, stats, key)
    j = _null_safe(j, adjudicated.select("obligation_id", "foreach_key", F.lit(True).alias("__adj")).distinct(), ["obligation_id", "foreach_key"]) if adjudicated is not None else j.withColumn("__adj", F.lit(False))
    base = tier_of(F.col("status"), F.size("matched"), F.col("n_bad"), F.col("n_docs"), F.col("docs_ok"), F.col("coverage_known"), F.size("scope_docs"), F.col("verified_docs"))
    j = j.withColumn("__t", base).withColumn("__t", capped(F.col("__t.tier"), F.col("__t.basis"), F.coalesce("__adj", F.lit(False)), F.when(presence, F.col("presence_tier_cap")).otherwise(F.col("absence_tier_cap"))))
    suffix = F.when(F.col("foreach_key").isNotNull(), F.concat(F.lit(" ("), "foreach_role", F.lit(" : "), "foreach_key", F.lit(")"))).otherwise("")
    frames = {"satisfied": "Exécution attestée : ", "window_breach": "Exécution tardive : ", "unverifiable": "Exécution non vérifiable : "}
    framed = F.coalesce(*[F.when(F.col("status") == s, F.concat(F.lit(f), "title", suffix)) for s, f in frames.items()])
    claim = F.when(F.col("status") == "gap", template(F.col("claim_template"), foreach_role=F.col("foreach_role"), foreach_key=F.col("foreach_key"), title_fr=F.col("title"))).otherwise(framed)
    subject = F.concat_ws("|", "obligation_id", "foreach_role", "foreach_key")
    good = F.col("status") == "satisfied"
    listed = lambda head, ids: F.when(F.size(ids) > 0, F.concat(F.lit(head), F.array_join(F.slice(ids, 1, 6), ", ")))
    date = F.concat(F.lit("déclencheur="), "trigger_id", F.lit(" ("), F.coalesce(F.col("trigger_day").cast("string"), F.lit("sans date")), F.lit(")"))
    untested = F.when(F.col("trigger_ambiguous"), "échéance non testée : date du fait déclencheur ambiguë dans le dossier")
    evidence = F.concat_ws(
        " · ", F.concat(F.lit("statut="), "status"), F.concat(F.lit("faits_retenus="), F.size("matched").cast("string")), F.concat(F.lit("périmètre="), F.col("verified_docs").cast("string"), F.lit("/"), F.size("scope_docs").cast("string"), F.lit(" document(s) vérifié(s)")),
        date, F.coalesce(F.concat(F.lit("retard="), F.col("breach_days").cast("string"), F.lit(" jour(s)")), untested), F.coalesce(listed("faits=", F.col("matched")), listed("candidats=", F.col("candidates"))))
    return j.select(scalars.short_id(F.lit("check"), subject, claim).alias("id"), F.lit("check").alias("pass_name"), subject.alias("subject"), claim.alias("claim"), evidence.alias("evidence"), F.col("__t.tier").alias("tier"), F.col("__t.basis").alias("tier_basis"),
                    F.when(good, "info").otherwise(F.col("severity")).alias("severity"), F.when(F.col("__t.tier").isin("T1", "T2", "T3"), "high").otherwise("low").alias("confidence"), "status", "obligation_id", "rule_version", (F.col("externalisable") & ~good).alias("externalisable"),
                    F.struct(F.col("matched").alias("fact_ids"), F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"), F.when(F.col("foreach_key").isNotNull(), F.array("foreach_key")).otherwise(F.array().cast("array<string>")).alias("person_ids"), F.col("candidates").alias("candidate_fact_ids"), F.col("scope_docs").alias("scope_doc_ids"), F.col("trigger_id").alias("trigger_fact_id")).alias("evidence_pointers"))


def combined_verdicts(votes: DataFrame, runs: int = 2) -> DataFrame:
    """(subject, outcome, label) from judges' votes (subject, judge, label): each judge needs `runs` like votes.

    aucun_verdict, juge_unique, unanime, partiel (some judges without a verdict), divergence.
    """
    per = votes.filter("label IS NOT NULL").groupBy("subject", "judge", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("subject", "judge").agg(F.max(F.struct("n", "label")).alias("t"))
    settled = per.select("subject", F.when(F.col("t.n") >= runs, F.col("t.label")).alias("label"))
    asked = votes.groupBy("subject").agg(F.count_distinct("judge").alias("judges"))
    g = asked.join(settled.groupBy("subject").agg(F.count("label").alias("n"), F.count_distinct("label").alias("kinds"), F.min("label").alias("one")), "subject", "left")
    n, kinds = F.coalesce("n", F.lit(0)), F.coalesce("kinds", F.lit(0))
    return g.select("subject", F.when(n == 0, "aucun_verdict").when(kinds > 1, "divergence").when(F.col("judges") == 1, "juge_unique").when(n == F.col("judges"), "unanime").otherwise("partiel").alias("outcome"), F.when(kinds == 1, F.col("one")).alias("label"))


def overturned(status: Column, outcome: Column, label: Column, agreeing: Column, threshold: int = 3) -> Column:
    """The status after adjudication: it turns only if all judges say the opposite with `threshold` like votes; a divergent reading keeps it."""
    strong = outcome.isin("unanime", "juge_unique") & (agreeing >= threshold)
    return F.when(strong & status.isin("gap", "unverifiable") & (label == "met"), "satisfied").when(strong & (status == "satisfied") & (label == "breached"), "gap").otherwise(status)
