import json

from pyspark.sql import functions as F

from casebench.functions import text
from casebench.operators import brief, evaluation, obligations as ob, telemetry
from casebench.schemas import FINDING
from casebench.sources import readers, sinks


def finding(ident, pass_name, **more):
    base = {f.name: None for f in FINDING.fields}
    return {**base, "id": ident, "pass_name": pass_name, "status": "open", "subject": ident, "claim": f"claim {ident}", "evidence": "statut=gap · faits_retenus=0", "severity": "high", "tier": "T3", "evidence_pointers": {"fact_ids": [], "doc_ids": [], "chunk_ids": [], "person_ids": [], "candidate_fact_ids": ["d-f1"], "scope_doc_ids": [], "trigger_fact_id": None}, **more}


def case(spark):
    store = spark.createDataFrame([
        finding("b", "check", obligation_id="o2"), finding("a", "check", obligation_id="o1", severity="low"), finding("c", "check", obligation_id="o1", tier="T5"), finding("ok", "check", obligation_id="o3", evidence="statut=satisfied"),
        finding("old", "check", obligation_id="o1", status="resolved"), finding("z", "contradict"), finding("y", "contradict", evidence=None), finding("g", "graph", status="resolved"),
    ], FINDING)
    obligations = spark.createDataFrame([("o1", "Titre un", "s1"), ("o2", "Titre deux", None), ("o3", "Trois", None), ("o4", "Quatre", None)], "obligation_id string, title string, source_chunk_id string")
    facts = spark.createDataFrame([("d-f1", "une citation", "d", None), ("d-f2", "autre", "e", "2020-01-01")], "fact_id string, verbatim_quote string, doc_id string, day string")
    verdicts = spark.createDataFrame([("o1", "d-f1", json.dumps({"label": "stipulation"}))], "obligation_id string, fact_id string, result_json string")
    statute = spark.createDataFrame([("s1", "12", "texte de loi", "")], "chunk_id string, num string, texte string, url string")
    return store, obligations, facts, verdicts, statute


def test_brief_is_whole_and_in_order(spark, tmp_path):
    coverage = spark.createDataFrame([("d", "ok"), ("e", "parse_failed"), ("f", None)], "doc_id string, status string")
    unsure = spark.createDataFrame([("d-f2",)], "fact_id string")
    lines = brief.brief(*case(spark), coverage, unsure, "c1")
    brief.write_brief(lines, str(tmp_path / "RAPPORT.md"))
    got = (tmp_path / "RAPPORT.md").read_text()
    marks = ["# Rapport — c1", "À instruire : 3", "| 1 | Titre deux | high | T3 |", "| 2 | Titre un | high | T5 |", "| 3 | Titre un | low | T3 |", "## Titre deux", "## Titre un", "Ce qui n'a pas été examiné", "1 obligation(s) du catalogue sur 4 (o4)", "fidélité inconnue : 2 sur 3 (e, f)", "sans date, hors de tout délai : 1 sur 2", "n'est pas résolu : 1 sur 2", "## Rapprochements à vérifier", "- claim y", "- claim z\n  - statut=gap"]
    at = -1
    for m in marks:
        assert got.find(m, at + 1) > at, m
        at = got.find(m, at + 1)
    assert "État du dossier" not in got and "claim old" not in got and "stipulation" in got and "> texte de loi" in got


def test_brief_of_nothing(spark):
    store, *rest = case(spark)
    lines = brief.brief(store.limit(0), *rest, None).collect()
    assert {r.part for r in lines} == {0, 1, 3} and any("À instruire : 0" in r.line for r in lines) and any("Fidélité inconnue pour tous les documents : 2" in r.line for r in lines)
    many = rest[0].sparkSession.range(20).select(F.format_string("x%02d", "id").alias("obligation_id"))
    got = {r.kind: r for r in brief.not_examined(store.select("obligation_id").limit(0), many, rest[1], None).collect()}
    assert (got["untriggered"].n, got["untriggered"].sample) == (20, ", ".join(f"x{i:02d}" for i in range(8)))


def test_divergences(spark):
    votes = [("o1", "d-f1", "m1", "execution", "a"), ("o1", "d-f1", "m1", "execution", "b"), ("o1", "d-f1", "m1", "autre", "c"), ("o1", "d-f1", "m2", "stipulation", "d"), ("o1", "d-f2", "m1", "autre", "e"), ("o1", "d-f2", "m2", "autre", "f"), ("o2", "d-f1", "m1", "autre", "g"), ("o2", "d-f1", "m2", None, "h")]
    _, obligations, facts, *_ = case(spark)
    got = brief.divergences(spark.createDataFrame(votes, "obligation_id string, fact_id string, judge string, label string, reason string"), obligations, facts).collect()
    assert len(got) == 1 and (got[0].tier, got[0].externalisable, got[0].subject) == ("T5", False, "divergence|o1|d-f1")
    assert got[0].evidence == "fait=d-f1 · m1=execution, m2=stipulation · m1 : a ‖ m2 : d" and got[0].evidence_pointers.doc_ids == ["d"]


def test_rows_of_hits_are_what_the_lists_hold(spark):
    cat = ob.catalog(spark, [ob.obligation("o1", ("b",), [ob.leaf("all_of", ("x",)), ob.leaf("none_of", ("q",), any_actor=True)], "c")])
    facts = ob.prepared(spark.createDataFrame([("d-f1", "2020-01-01", "b", "x", None, "x", "d", None, None), ("d-f2", None, "c", "q", None, "q", "d", None, None)], "fact_id string, date string, actor_role string, action string, target string, verbatim_quote string, source_doc_id string, source_chunk_id string, distilled_context string"))
    lean = ob.evaluate(*cat, facts, with_matched=False).first()
    whole = ob.evaluate(*cat, facts).first()
    assert lean.matched is None and whole.matched == ["d-f1"] and lean.status == whole.status == "unverifiable"
    rows = ob.hits(*cat, facts.withColumn("unsure", F.lit(False)), ob.triggers(cat[0], facts)).collect()
    assert {(r.leaf, r.branch, r.fact_id) for r in rows} == {(0, "all_of", "d-f1"), (1, "none_of", "d-f2")}


def test_small_functions(spark, tmp_path):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c).first()[0]
    lines = [f"l{i}" for i in range(60)]
    lines[10], lines[14], lines[40], lines[59] = "x COST", "retry", "cost", "cost"
    got = one(text.near_keywords(F.col("a"), ["cost", "retry"]), a=lines)
    assert got == [*lines[4:17], "...", *lines[34:47]]
    assert one(text.near_keywords(F.col("a"), ["zzz"]), a=lines) == lines[:20] and one(text.near_keywords(F.col("a"), ["l1"], head=3), a=["l0"]) == ["l0"]
    assert one(text.doc_ids_in(F.col("a")), a="voir acte__vente_1, le b__2 et acte__vente_1; __x a_b") == ["acte__vente_1", "b__2"]
    df = spark.createDataFrame([(i, g) for g in ("a", None) for i in range(5)], "i long, g string")
    assert {(r.g, r.i) for r in evaluation.head_split(df, ["i"], 2, ["g"]).filter("part = 'validation'").collect()} == {("a", 0), ("a", 1), (None, 0), (None, 1)}
    assert evaluation.head_split(df.filter("g = 'a'"), ["i"], 3).groupBy("part").count().count() == 2
    odd = spark.createDataFrame([("b", 'say "x"', None), ("a", "two\nlines, and more ", ""), ("c", " x", "NA")], "k string, v string, w string")
    sinks.write_csv(odd, str(tmp_path / "csv"), ["k"])
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "csv")).collect()) == [("a", "two\nlines, and more ", ""), ("b", 'say "x"', ""), ("c", " x", "NA")]
    for name in ("case_id=zed", "alpha", "Bad Name", "case_id=b1"):
        (tmp_path / "root" / name).mkdir(parents=True)
    (tmp_path / "root" / "file").write_text("")
    assert telemetry.cases(spark, str(tmp_path / "root")) == ["alpha", "b1", "zed"] and telemetry.cases(spark, str(tmp_path / "none")) == []
