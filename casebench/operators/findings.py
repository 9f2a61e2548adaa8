"""The findings store: upsert by id, reconciliation of complete passes, attached arguments, the gate for outbound text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebench.functions import lexicon, scalars
from casebench.schemas import CALIBRATION

# The columns that each run refreshes, and those that never leave.
VOLATILE = ("evidence", "tier", "tier_basis", "severity", "confidence", "obligation_id", "rule_version", "externalisable", "evidence_pointers", "qualification_interne", "gravite_interne", "penal_refs", "last_seen")
INTERNAL_ONLY = ("qualification_interne", "gravite_interne", "penal_refs")
OUTBOUND_TEXT = ("claim", "evidence", "subject")


def upserted(store: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The store after a run: new ids are open and first seen now; known ones get the volatile columns and are open again.

    Identity, first_seen, confounders and calibration stay; a change of tier adds a calibration entry. New rows carry the
    store's volatile columns (those that they lack stay as they were), each id once.
    """
    o, n = store.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    known, seen = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
    cols: list[Column] = []
    for c in store.columns:
        old = F.col(f"o.{c}")
        fresh = F.col(f"n.{c}") if c in new.columns else None
        if c == "id":
            v = F.coalesce("o.id", "n.id")
        elif c == "first_seen":
            v = F.when(known, old).otherwise(now)
        elif c == "last_seen":
            v = F.when(seen, now).otherwise(old)
        elif c == "status":
            v = F.when(seen, "open").otherwise(old)
        elif c == "resolved_at":
            v = F.when(~seen, old)
        elif c == "calibration":
            moved = known & seen & ~F.col("o.tier").eqNullSafe(F.col("n.tier"))
            entry = F.array(F.struct(now.cast("string").alias("ts"), F.col("n.tier").alias("tier"), F.col("n.confidence").alias("confidence"), F.lit("tier changed").alias("reason"), F.lit("upsert").alias("actor")).cast(CALIBRATION))
            kept = F.coalesce(old, F.array().cast(store.schema[c].dataType))
            v = F.when(moved, F.concat(kept, entry)).otherwise(kept)
        elif fresh is None:
            v = old
        elif c in VOLATILE:
            v = F.when(seen, fresh).otherwise(old)
        else:
            v = F.when(known, old).otherwise(fresh)
        cols.append(v.alias(c))
    return both.select(*cols)


def reconciled(store: DataFrame, produced: DataFrame, pass_name: str, complete: bool, now: Column) -> DataFrame:
    """Open findings of a complete pass that it didn't produce again are resolved; an incomplete pass resolves nothing."""
    if not complete:
        return store
    made = produced.select(F.col("id").alias("__id")).distinct()
    gone = (F.col("pass_name") == pass_name) & (F.col("status") == "open") & F.col("__id").isNull()
    j = store.join(made, F.col("id") == F.col("__id"), "left")
    return j.withColumns({"resolved_at": F.when(gone, now.cast(store.schema["resolved_at"].dataType)).otherwise(F.col("resolved_at")), "status": F.when(gone, "resolved").otherwise(F.col("status"))}).select(*store.columns)


def attached(store: DataFrame, arguments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store with confounders added, (id, found)). arguments: id, confounder; a text that a finding has isn't added again."""
    per = arguments.groupBy(F.col("id").alias("__id")).agg(F.collect_list("confounder").alias("__new"))
    j = store.join(per, F.col("id") == F.col("__id"), "left")
    old = F.coalesce("confounders", F.array().cast(store.schema["confounders"].dataType))
    fresh = F.filter(F.coalesce("__new", F.array().cast(store.schema["confounders"].dataType)), lambda c: ~F.exists(old, lambda x: x["text_fr"] == c["text_fr"]))
    once = F.filter(F.transform(fresh, lambda c, i: F.struct(c.alias("c"), (~F.exists(F.slice(fresh, F.lit(1), i), lambda x: x["text_fr"] == c["text_fr"])).alias("k"))), lambda x: x["k"])
    out = j.withColumn("confounders", F.concat(old, F.transform(once, lambda x: x["c"])))
    found = arguments.select("id").distinct().join(store.select("id").withColumn("found", F.lit(True)), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))
    return out.select(*store.columns), found


def last_lines(lines: DataFrame) -> DataFrame:
    """A store from its append form (id, line, more): the last line of each id."""
    names = [c for c in lines.columns if c != "line"]
    return lines.groupBy("id").agg(F.max_by(F.struct(*names), "line").alias("r")).select("r.*")


def attack_targets(store: DataFrame) -> DataFrame:
    """Open findings of check and contradict of T4 or better, strongest first."""
    return store.filter((F.col("status") == "open") & F.col("pass_name").isin("check", "contradict") & scalars.at_least(F.col("tier"), "T4")).orderBy(scalars.tier_rank(F.col("tier")), "id")


def digest(store: DataFrame) -> DataFrame:
    """Open findings in the order of a report: tier, severity, pass, subject."""
    return store.filter("status = 'open'").orderBy(scalars.tier_rank(F.col("tier")), scalars.ranked(F.col("severity"), scalars.SEVERITIES), "pass_name", "subject")


def digest_text(store: DataFrame) -> DataFrame:
    """(tier, pass_name, body): the lines of each group, one string."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "subject", F.lit(" — "), "claim")
    g = store.filter("status = 'open'").groupBy("tier", "pass_name").agg(F.array_sort(F.collect_list(F.struct(scalars.ranked(F.col("severity"), scalars.SEVERITIES).alias("s"), "subject", line.alias("line")))).alias("l"))
    return g.select("tier", "pass_name", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def outbound(store: DataFrame, case_id: str, allowed: tuple[str, ...], least: str = "T2") -> DataFrame:
    """What may leave: open, externalisable, of `least` or better, no dispositive confounder; internal columns dropped, persons numbered.

    A case that isn't allowed raises now; a forbidden word in outbound text raises when the result is read, naming the finding.
    """
    if case_id not in allowed:
        raise ValueError(f"case {case_id!r} may not be sent out")
    keep = store.filter(scalars.at_least(F.col("tier"), least) & F.col("externalisable") & (F.col("status") == "open") & ~F.coalesce(F.exists("confounders", lambda c: F.coalesce(c["dispositive"], F.lit(False))), F.lit(False)))
    keep = keep.drop(*INTERNAL_ONLY)
    people = keep.select(F.explode("evidence_pointers.person_ids").alias("person_id")).distinct()
    numbered = people.withColumn("label", F.concat(F.lit("personne#"), F.dense_rank().over(W.orderBy("person_id")).cast("string")))  # distinct persons of one case
    mine = keep.select("id", F.explode("evidence_pointers.person_ids").alias("person_id")).join(numbered, "person_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.length("person_id").alias("n"), "person_id", "label"))).alias("__p"))
    j = keep.join(mine, "id", "left").withColumn("__p", F.reverse(F.coalesce("__p", F.array().cast("array<struct<n:int,person_id:string,label:string>>"))))
    hide = lambda c: F.aggregate("__p", F.col(c), lambda s, p: F.replace(s, p["person_id"], p["label"]))
    text = {c: hide(c) for c in OUTBOUND_TEXT}
    pointers = F.col("evidence_pointers").withField("person_ids", F.array_sort(F.transform("__p", lambda p: p["label"])))
    j = j.withColumns({**text, "evidence_pointers": pointers}).drop("__p")
    j = j.withColumn("__folded", lexicon.fold(F.concat_ws(" | ", *OUTBOUND_TEXT)))
    bad = lexicon.forbidden_terms(F.col("__folded"))
    checked = F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("forbidden words in finding "), F.col("id"), F.lit(": "), F.array_join(bad, ", ")))).otherwise(F.col("claim"))
    return j.withColumn("claim", checked).drop("__folded")


def escalated(store: DataFrame, cost: Column, calls: int, ceiling: float) -> DataFrame:
    """Findings worth a paid call, strongest first, while calls and dollars last."""
    w = W.orderBy(scalars.tier_rank(F.col("tier")), "id")
    picked = store.filter(F.col("externalisable") & F.col("tier").isin("T1", "T2")).withColumn("__cost", cost)
    return picked.withColumns({"__n": F.row_number().over(w), "__spent": F.sum("__cost").over(w)}).filter((F.col("__n") <= calls) & (F.col("__spent") <= ceiling)).drop("__n", "__spent", "__cost")
