"""The decision tables: statuses, triggers, scope, foreach, tiers."""

import pytest

from casebench.operators import obligations as ob
from casebench.schemas import FACT


def facts(spark, *rows):
    """(fact_id, role, date, text): the document is what stands before -f."""
    return ob.prepared(spark.createDataFrame([(i, d, r, t, None, t, i.split("-f")[0], None, None) for i, r, d, t in rows], FACT))


def coverage(spark, **docs):
    return spark.createDataFrame(list(docs.items()), "doc_id string, status string")


def rule(spark, leaves, **more):
    return ob.catalog(spark, [ob.obligation("o1", ("bearer",), leaves, more.pop("claim", "Rien n'atteste {title_fr}"), title="la remise", **more)])


def run(spark, cat, f, cov=None, **more):
    return ob.evaluate(*cat, f, cov, **more).collect()


def test_trigger_absent(spark):
    cat = rule(spark, [ob.leaf("all_of", ("remet",))], trigger_terms=("décès",))
    assert [r.status for r in run(spark, cat, facts(spark, ("d-f1", "bearer", None, "remet")))] == ["not_triggered"]


def test_only_the_bearer_performs(spark):
    f, cov = facts(spark, ("d-f1", "other", None, "a remis"), ("d-f2", "bearer", None, "rien")), coverage(spark, d="ok")
    assert run(spark, rule(spark, [ob.leaf("all_of", ("remis",))]), f, cov)[0].status == "gap"
    assert run(spark, rule(spark, [ob.leaf("all_of", ("remis",), any_actor=True)]), f, cov)[0].status == "satisfied"
    assert run(spark, rule(spark, [ob.leaf("all_of", ("remis",), roles=("other",))]), f, cov)[0].status == "satisfied"


@pytest.mark.parametrize(("status", "expected"), [("ok", "gap"), ("parse_failed", "unverifiable"), (None, "unverifiable")])
def test_absence_needs_coverage(spark, status, expected):
    cov = coverage(spark, d=status) if status else None
    assert run(spark, rule(spark, [ob.leaf("all_of", ("remis",))]), facts(spark, ("d-f1", "bearer", None, "rien")), cov)[0].status == expected


@pytest.mark.parametrize(("day", "expected", "late"), [("2020-06-01", "window_breach", 122), ("2020-01-20", "satisfied", None), (None, "satisfied", None)])
def test_deadline(spark, day, expected, late):
    cat = rule(spark, [ob.leaf("all_of", ("remis",), after=True)], trigger_terms=("demande",), deadline_days=30)
    got = run(spark, cat, facts(spark, ("d-f1", "heir", "2020-01-01", "demande"), ("d-f2", "bearer", day, "remis")), coverage(spark, d="ok"))[0]
    assert (got.status, got.breach_days) == (expected, late)


def test_ambiguous_trigger_makes_nothing_late(spark):
    cat = rule(spark, [ob.leaf("all_of", ("remis",))], trigger_terms=("demande",), deadline_days=183)
    rows = [("d-f1", "heir", "1981-01-01", "demande"), ("d-f2", "heir", "2026-01-09", "demande"), ("d-f3", "bearer", "2026-12-01", "remis")]
    got = run(spark, cat, facts(spark, *rows), coverage(spark, d="ok"))[0]
    assert (got.status, got.trigger_ambiguous, got.breach_days) == ("satisfied", True, None)
    one = run(spark, cat, facts(spark, *rows[1:]), coverage(spark, d="ok"))[0]
    assert one.status == "window_breach" and one.breach_days == 143


@pytest.mark.parametrize(("select", "expected"), [("earliest", "d-f1"), ("latest", "d-f2")])
def test_trigger_select(spark, select, expected):
    cat = rule(spark, [ob.leaf("all_of", ("remis",))], trigger_terms=("demande",), trigger_select=select)
    assert run(spark, cat, facts(spark, ("d-f1", "heir", "2020-01-01", "demande"), ("d-f2", "heir", "2026-01-01", "demande")))[0].trigger_id == expected


def test_undated_trigger_is_the_smallest_id(spark):
    cat = rule(spark, [ob.leaf("all_of", ("remis",))], trigger_terms=("demande",))
    got = run(spark, cat, facts(spark, ("d-f2", "heir", None, "demande"), ("d-f1", "heir", None, "demande")))[0]
    assert (got.trigger_id, got.trigger_day) == ("d-f1", None)


def test_scope_is_the_bearers_documents(spark):
    f = facts(spark, ("a-f1", "bearer", None, "rien"), ("b-f1", "other", None, "rien"))
    got = run(spark, rule(spark, [ob.leaf("all_of", ("remis",))]), f, coverage(spark, a="ok", b="parse_failed"))[0]
    assert (got.scope_docs, got.verified_docs, got.status) == (["a"], 1, "gap")
    globbed = run(spark, rule(spark, [ob.leaf("all_of", ("remis",))], patterns=("b*",)), f, coverage(spark, a="ok", b="parse_failed"))[0]
    assert (globbed.scope_docs, globbed.status) == (["b"], "unverifiable")


def test_branches(spark):
    f, cov = facts(spark, ("d-f1", "bearer", None, "alpha beta"), ("d-f2", "bearer", None, "alpha")), coverage(spark, d="ok")
    status = lambda *leaves: run(spark, rule(spark, list(leaves)), f, cov)[0].status
    assert status(ob.leaf("any_of", ("zzz",)), ob.leaf("any_of", ("beta",))) == "satisfied"
    assert status(ob.leaf("any_of", ("zzz",))) == "gap"
    assert status(ob.leaf("all_of", ("alpha",), least=2)) == "satisfied"
    assert status(ob.leaf("all_of", ("alpha",), least=3)) == "gap"
    assert status(ob.leaf("all_of", ("alpha",)), ob.leaf("none_of", ("beta",))) == "gap"
    failed = run(spark, rule(spark, [ob.leaf("all_of", ("alpha",), least=9)]), f, cov)[0]
    assert failed.matched == ["d-f1", "d-f2"]  # hits of a failed leaf are kept


def test_foreach(spark):
    cat = rule(spark, [ob.leaf("all_of", ("notifi",), bind=True)], foreach=("bank",), claim="Rien pour {foreach_role} {foreach_key}")
    f = facts(spark, ("d-f1", "bearer", None, "notifie"), ("d-f2", "bearer", None, "autre"))
    roles = spark.createDataFrame([("p1", "bank"), ("p2", "bank")], "person_id string, role string")
    edges = spark.createDataFrame([("p1", "d-f1"), ("p2", "d-f2")], "person_id string, fact_id string")
    got = ob.evaluate(*cat, f, coverage(spark, d="ok"), edges, roles)
    assert {r.foreach_key: r.status for r in got.collect()} == {"p1": "satisfied", "p2": "gap"}
    made = ob.findings(got, f, coverage(spark, d="ok")).collect()
    assert len({r.id for r in made}) == 2 and any(r.claim == "Rien pour bank p2" for r in made)


def test_ambiguous_facts_dont_count_by_role(spark):
    f = facts(spark, ("d-f1", "bearer", None, "remis"))
    unsure = spark.createDataFrame([("d-f1",)], "fact_id string")
    assert run(spark, rule(spark, [ob.leaf("all_of", ("remis",))]), f, coverage(spark, d="ok"), ambiguous=unsure)[0].status == "gap"
    assert run(spark, rule(spark, [ob.leaf("all_of", ("remis",), any_actor=True)]), f, coverage(spark, d="ok"), ambiguous=unsure)[0].status == "satisfied"


def test_findings_and_tiers(spark):
    cat = rule(spark, [ob.leaf("all_of", ("remis",))])
    two = facts(spark, ("a-f1", "bearer", None, "remis"), ("b-f1", "bearer", None, "remis"))
    tier = lambda f, cov, **m: [(r.tier, r.tier_basis, r.severity, r.externalisable) for r in ob.findings(ob.evaluate(*cat, f, cov), f, cov, **m).collect()]
    assert tier(two, coverage(spark, a="ok", b="ok")) == [("T1", "presence_multi_source_couvert", "info", False)]
    assert tier(two, coverage(spark, a="ok")) == [("T2", "presence_source_unique", "info", False)]
    none = facts(spark, ("a-f1", "bearer", None, "rien"), ("b-f1", "bearer", None, "rien"))
    assert tier(none, coverage(spark, a="ok", b="ok")) == [("T3", "absence_perimetre_couvert", "medium", True)]
    assert tier(none, coverage(spark, a="ok")) == [("T4", "absence_perimetre_partiellement_couvert", "medium", True)]
    assert tier(none, None) == [("T5", "absence_perimetre_non_couvert", "medium", True)]
    bad = spark.createDataFrame([("a-f1",)], "fact_id string")
    assert tier(two, coverage(spark, a="ok", b="ok"), defective=bad)[0][:2] == ("T5", "presence_defaut_integrite")
    judged = spark.createDataFrame([("o1", None)], "obligation_id string, foreach_key string")
    assert tier(two, coverage(spark, a="ok", b="ok"), adjudicated=judged)[0][:2] == ("T4", "presence_multi_source_couvert+adjudication")


def test_catalog_defects_raise():
    with pytest.raises(ValueError):
        ob.leaf("all_of", after=True, before=True)
    with pytest.raises(ValueError):
        ob.obligation("x", ("b",), [ob.leaf("all_of", after=True)], "c")
    with pytest.raises(ValueError):
        ob.obligation("x", ("b",), [ob.leaf("all_of", bind=True)], "c")
    with pytest.raises(ValueError):
        ob.obligation("x", ("b",), [ob.leaf("all_of")], "no placeholders", foreach=("r",))
