import json

import pytest

from casebench import models
from casebench.operators import steps


class Scripted:
    """Answers by what the prompt holds, and counts its calls in a file that tasks can write to."""

    name = "scripted"

    def __init__(self, replies, log):
        self.replies, self.log = replies, str(log)

    def complete(self, prompts):
        with open(self.log, "a") as f:
            f.writelines("x\n" for _ in prompts)
        return [next((r for k, r in self.replies.items() if k in p), None) for p in prompts]


def calls(log):
    return len(log.read_text().splitlines()) if log.exists() else 0


def test_gate(spark, tmp_path):
    log, cache = tmp_path / "log", models.StoredCache(spark, str(tmp_path / "cache"))
    ok = json.dumps({"missing_facts": ["f"], "mistranscriptions": []})
    cut = '{"missing_facts": [], "mistranscriptions": [{"claimed": "a", "actual": "b"}, {"claimed": "c"'
    model = Scripted({"GOOD": ok + " voilà", "CUT": cut, "BAD": "désolé"}, log)
    docs = spark.createDataFrame([("d1", "GOOD", "t"), ("d2", "CUT", "t"), ("d3", "BAD", None), ("d4", None, "t")], "doc_id string, source string, transcript string")
    want = {"d1": ("ok", ["f"], 0), "d2": ("parse_recovered", [], 1), "d3": ("parse_failed", [], 0), "d4": ("source_missing", [], 0)}
    assert {r.doc_id: (r.status, r.missing_facts, len(r.mistranscriptions)) for r in steps.gated(docs, cache, model).collect()} == want and calls(log) == 3
    assert {r.doc_id: r.status for r in steps.gated(docs, cache, model).collect()} == {k: v[0] for k, v in want.items()} and calls(log) == 5  # the full verdict is kept
    changed = spark.createDataFrame([("d1", "GOOD", "another")], docs.schema)
    assert steps.gated(changed, cache, model).first().status == "ok" and calls(log) == 6


def test_mentions(spark, tmp_path):
    log, cache = tmp_path / "log", models.StoredCache(spark, str(tmp_path / "cache"))
    some = json.dumps([{"name": "Anne", "role": "heir", "quote": "q"}, {"name": " "}, {"role": "x"}])
    model = Scripted({"anne": f"```json\n{some}\n```", "none": "[]", "prose": "je ne sais pas", "cut": '[{"name": "Zoé", "role": "r"}, {"name": "P'}, log)
    docs = spark.createDataFrame([("a", "anne"), ("b", "none"), ("c", "prose"), ("d", " "), ("e", None), ("f", "cut")], "doc_id string, text string")
    assert {(r.doc_id, r.name, r.role, r.pos) for r in steps.mentions(docs, cache, model).collect()} == {("a", "Anne", "heir", 0), ("f", "Zoé", "r", 0)} and calls(log) == 4
    assert steps.mentions(docs, cache, model).count() == 2 and calls(log) == 5  # what couldn't be read is asked again, an empty list isn't
    stats = steps.mention_stats(docs, cache, model, 1.0, 5.0, 100).first()
    assert (stats.documents, stats.cached, stats.cost_usd) == (4, 3, round((1 * 1.0 + 100 * 5.0) / 1e6, 6))


def test_persons_of_roles(spark, tmp_path):
    log, cache = tmp_path / "log", models.StoredCache(spark, str(tmp_path / "cache"))
    people = json.dumps([{"canonical_name": "Anne Blanc", "aliases": ["Mme Blanc"], "confidence": "high", "evidence_fact_ids": ["f1"]}, {"canonical_name": "Blanc"}, {"canonical_name": ""}])
    model = Scripted({"L'héritier": people, "other": "non"}, log)
    roles = spark.createDataFrame([("heir", "L'héritier"), ("other", None), ("alone", None)], "role_id string, label string")
    facts = spark.createDataFrame([(f"f{i}", "heir", f"2020-01-{i:02d}" if i > 1 else None, f"q{i}") for i in range(1, 9)] + [("g", "other", None, None)], "fact_id string, role_id string, day string, quote string")
    shown = {r.role_id: [f.fact_id for f in r.facts] for r in steps.persons_facts(facts, 3).collect()}
    assert shown == {"heir": ["f2", "f3", "f4"], "other": ["g"]}
    got = steps.role_persons(roles, facts, cache, model).collect()
    assert [(r.role_id, r.canonical_name, r.aliases) for r in got] == [("heir", "Anne Blanc", ["Mme Blanc"])] and calls(log) == 2
    assert steps.role_persons(roles, facts, cache, model).count() == 1 and calls(log) == 3


def test_roster_safety(spark):
    needles = spark.createDataFrame([("Durand",), ("Banque du Port",)], "needle string")
    good = spark.createDataFrame([("p1", "Zoé Petit"), ("p2", None)], "person_id string, persona string")
    assert steps.checked_roster(good, needles).count() == 2
    for persona in ("Luc DURAND", "la banque  du port", "zed@a.fr"):
        with pytest.raises(ValueError, match="gate would stop"):
            steps.checked_roster(good.unionByName(spark.createDataFrame([("p3", persona)], good.schema)), needles)
    with pytest.raises(ValueError, match="legal persons"):
        steps.checked_roster(good, needles, keep_real_legal_persons=True, role_mode=True)
