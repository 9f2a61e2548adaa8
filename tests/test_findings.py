import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casebench.operators import findings as fs
from casebench.schemas import CONFOUNDER, FINDING

EMPTY = {f.name: None for f in FINDING} | {"calibration": [], "confounders": []}


def finding(ident, tier="T3", **more):
    return EMPTY | {"id": ident, "pass_name": "check", "subject": "s", "claim": "c", "tier": tier, "severity": "medium", "confidence": "high", "externalisable": True, "status": "open", "evidence_pointers": {"person_ids": []}} | more


def table(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] if f.name != "evidence_pointers" else tuple((r[f.name] or {}).get(x.name) for x in f.dataType) for f in FINDING) for r in rows], FINDING)


def cycle(store, new, day):
    return fs.upserted(store, new, F.lit(day))


def test_upsert_keeps_identity_and_history(spark):
    one = cycle(table(spark), table(spark, finding("a")), "d1")
    arg = spark.createDataFrame([("a", ("a defence", "seed", False, "d1")), ("a", ("a defence", "seed", False, "d1")), ("ghost", ("x", "seed", False, "d1"))], StructType().add("id", "string").add("confounder", CONFOUNDER))
    with_arg, found = fs.attached(one, arg)
    assert {r.id: r.found for r in found.collect()} == {"a": True, "ghost": False}
    two = cycle(with_arg, table(spark, finding("a", "T1")), "d2").first()
    assert (two.first_seen, two.last_seen, two.tier, len(two.confounders)) == ("d1", "d2", "T1", 1)
    assert [(c.tier, c.ts) for c in two.calibration] == [("T1", "d2")]


def test_reconcile_resolves_only_complete_passes_and_reopens(spark):
    one = cycle(table(spark), table(spark, finding("a"), finding("b", pass_name="search")), "d1")
    nothing = table(spark)
    assert {r.status for r in fs.reconciled(one, nothing, "check", False, F.lit("d2")).collect()} == {"open"}
    two = fs.reconciled(one, nothing, "check", True, F.lit("d2"))
    assert {r.id: (r.status, r.resolved_at) for r in two.collect()} == {"a": ("resolved", "d2"), "b": ("open", None)}
    three = {r.id: (r.status, r.resolved_at, r.first_seen) for r in cycle(two, table(spark, finding("a")), "d3").collect()}
    assert three["a"] == ("open", None, "d1")


def test_gate(spark):
    people = lambda *p: {"person_ids": list(p)}
    rows = table(spark, finding("a", "T1", claim="about case-b and case-a", evidence_pointers=people("case-b", "case-a"), gravite_interne="x"), finding("b", "T3"), finding("c", "T1", externalisable=False), finding("d", "T1", status="resolved"), finding("e", "T2", confounders=[("x", "s", True, "d")]))
    got = fs.outbound(rows, "demo", ("demo",)).collect()
    assert [(r.id, r.claim, r.evidence_pointers.person_ids) for r in got] == [("a", "about personne#2 and personne#1", ["personne#1", "personne#2"])]
    assert not set(fs.INTERNAL_ONLY) & set(fs.outbound(rows, "demo", ("demo",)).columns)
    with pytest.raises(ValueError):
        fs.outbound(rows, "other", ("demo",))
    with pytest.raises(Exception, match="forbidden words in finding f"):
        fs.outbound(table(spark, finding("f", "T1", claim="un Détournement")), "demo", ("demo",)).collect()


def test_orders(spark):
    rows = table(spark, finding("a", "T4"), finding("b", "T1", severity="low"), finding("c", "T1", severity="critical"), finding("d", "T5"))
    assert [r.id for r in fs.digest(rows).collect()] == ["c", "b", "a", "d"]
    assert [r.id for r in fs.attack_targets(rows).collect()] == ["b", "c", "a"]
    assert [r.id for r in fs.escalated(rows, F.lit(0.4), 20, 0.5).collect()] == ["b"]


def test_last_line_wins(spark):
    lines = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "id string, line int, claim string")
    assert {(r.id, r.claim) for r in fs.last_lines(lines).collect()} == {("a", "new"), ("b", "only")}
