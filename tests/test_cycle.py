"""Cycle, report, answers, and the checks of what models return."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from casebench.models import Stub
from casebench.operators import cycle
from casebench.schemas import FINDING


def finding(spark, *rows):
    """(id, pass, evidence, severity, tier)."""
    base = {f.name: None for f in FINDING}
    made = [{**base, "id": i, "pass_name": p, "subject": "s", "claim": f"claim {i}", "evidence": e, "severity": s, "tier": t, "confidence": "low", "status": "open", "obligation_id": "o1", "evidence_pointers": {"fact_ids": [], "candidate_fact_ids": ["f1"]}, "confounders": [], "calibration": []} for i, p, e, s, t in rows]
    return spark.createDataFrame(made, StructType([StructField(f.name, f.dataType) for f in FINDING]))


def test_cycle_and_report(spark, tmp_path):
    def recorded(store, name):
        store.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    store = finding(spark, ("old", "check", "statut=gap", "low", "T3"), ("kept", "contradict", "x", "low", "T5"))
    new = finding(spark, ("a", "check", "statut=gap · x", "low", "T3"), ("b", "check", "statut=satisfied", "high", "T1"), ("c", "check", "statut=window_breach", "high", "T2"))
    after, done = cycle.run_cycle(store, [("check", lambda s: (new, True)), ("contradict", lambda s: (finding(spark), False))], recorded, F.lit("2026-01-01"))
    assert done == [("check", 3, True), ("contradict", 0, False)]
    assert {r.id: r.status for r in after.collect()} == {"old": "resolved", "kept": "open", "a": "open", "b": "open", "c": "open"}
    assert [r.id for r in cycle.actionable(after).collect()] == ["c", "a"]
    cache = spark.createDataFrame([("check", "o1@1|demo|f1", '{"label": "met"}'), ("check", "bad", "{}"), ("check", "o2@1|demo|f1", "{"), ("attack", "o1@1|demo|f1", "{}")], "pass_name string, subject string, result_json string")
    verdicts = cycle.cached_verdicts(cache)
    assert [(r.obligation_id, r.fact_id) for r in verdicts.collect()] == [("o1", "f1")]
    obligations = spark.createDataFrame([("o1", "The duty", "x-1")], "obligation_id string, title string, source_chunk_id string")
    facts = spark.createDataFrame([("f1", "said so")], "fact_id string, verbatim_quote string")
    statute = spark.createDataFrame([("x-1", "1", "The law says", "")], "chunk_id string, num string, texte string, url string")
    got = {r.id: r.section for r in cycle.report(after, obligations, facts, verdicts, statute).collect()}
    assert set(got) == {"a", "c"} and all(x in got["a"] for x in ("## The duty", "> The law says", "— art. 1", "« said so » `f1` : met"))


class Quiet(Stub):
    """Rewrites nothing, routes nothing."""

    def complete(self, prompts):
        return ["" if p.startswith("rewrite: ") else json.dumps({"intent": "case_factual", "confidence": "high"}) if p.startswith("route: ") else f"answer to {p[-9:]}" for p in prompts]


def test_answers(spark):
    rows = [("s1", "code", "Code", "1", "", "usufruct of the house", "law on usufruct", ""), ("d1", "dossier-demo", "Case", "", "", "letter", "the letter on the house", "u"), ("d2", "dossier-acme", "Case", "", "", "other", "the letter of another house", "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source string, source_label string, num string, section_path string, titre string, texte string, url string")
    from casebench.models import embedded

    vectors = embedded(chunks, "texte", Stub()).select("chunk_id", "embedding")
    queries = spark.createDataFrame([("q1", "letter on the house", "demo"), ("q2", "usufruct law", None)], "query_id string, query string, case_id string")
    got = {r.query_id: r for r in cycle.answered(chunks, vectors, queries, Quiet(), ["code"]).collect()}
    assert got["q1"].scope == "case:demo" and [c.chunk_id for c in got["q1"].citations] == ["d1"] and got["q1"].answer == "answer to the house"
    assert got["q2"].scope == "statute" and [c.chunk_id for c in got["q2"].citations] == ["s1"]
    merged, off = cycle.merged_index(chunks.filter("source = 'code'"), [chunks.filter("chunk_id = 'd1'").drop("url")], vectors)
    assert merged.count() == 2 and {r.chunk_id: r.url for r in merged.collect()}["d1"] == "" and [(r.state, r.n) for r in off.collect()] == [("orphan", 1)]


def test_verifier_replies(spark):
    replies = ['```json\n{"missing_facts": ["x"], "mistranscriptions": []}\n```', '{"missing_facts": [], "mistranscriptions": [{"claimed": "a", "actual": "b"}]} and prose', '{"missing_facts": ["x", "y', '{"mistranscriptions": [{"claimed": "a", "actual": "b"}, {"cl', '{"missing_facts": [1]}', '{"mistranscriptions": [{"claimed": "a"}]}', "no", "{}"]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, s string")
    got = {r.i: (r.v.status, r.v.missing_facts, [tuple(m) for m in r.v.mistranscriptions]) for r in df.select("i", cycle.verifier_parsed(F.col("s")).alias("v")).collect()}
    failed = ("parse_failed", [], [])
    assert got == {0: ("ok", ["x"], []), 1: ("ok", [], [("a", "b")]), 2: failed, 3: ("parse_recovered", [], [("a", "b")]), 4: failed, 5: failed, 6: failed, 7: ("ok", [], [])}


def test_roster(spark):
    groups = spark.createDataFrame([("h", "h"), ("h", "h2")], "head string, person_id string")
    of = lambda *rows: spark.createDataFrame(list(rows), "person_id string, persona string")
    got = {r.person_id: r.persona for r in cycle.roster(of(("h2", "X"), ("z", "Y")), groups).collect()}
    assert got == {"h": "X", "h2": "X", "z": "Y"}
    with pytest.raises(Exception, match="one persona for several people: X"):
        cycle.roster(of(("h", "X"), ("z", "X")), groups).collect()


def test_imports_gaps_and_headings(spark, tmp_path):
    for name, body in (("a", '{"id": "1", "title": "t", "turns": [{"q": 1}, {"q": 2}]}'), ("b", "{"), ("c", '{"x": 1}')):
        (tmp_path / f"{name}.json").write_text(body)
    good, bad = cycle.read_conversations(spark, str(tmp_path))
    assert tuple(cycle.import_stats(good, bad).first()) == (1, 2, 2) and sorted(r.file for r in bad.collect()) == ["b.json", "c.json"]
    md = spark.createDataFrame([("intro\n## One\nx\n\n## Two\n## \n y",)], "s string")
    assert [tuple(x) for x in md.select(cycle.h2_chunks(F.col("s"))).first()[0]] == [("(preamble)", "intro"), ("One", "## One\nx"), ("Two", "## Two"), ("", "## \n y")]
    paths = spark.createDataFrame([("a/b",), ("main",), ("x.py",), ("v2-agentic",)], "s string")
    assert [r[0] for r in paths.select(cycle.looks_like_path(F.col("s"))).collect()] == [True, False, True, False]
