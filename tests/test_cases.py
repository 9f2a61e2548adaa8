"""Contradictions, persons, integrity, anonymising, telemetry, sources, sinks and streaming on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from casebench import schemas
from casebench.operators import anonymise, compliance, contradictions, integrity, persons, telemetry
from casebench.sources import readers, sinks
from casebench.streaming import watch


def facts(spark, *rows):
    """(fact_id, date, role, action, target, quote)."""
    return spark.createDataFrame([(i, d, r, a, t, q, i.split("-f")[0], None, None) for i, d, r, a, t, q in rows], schemas.FACT)


def test_contradictions(spark):
    f = facts(spark, ("a-f1", "2020-01-01", "r1", "x", None, "payé 23 477,34 €"), ("b-f1", "2021-01-01", "r2", "x", None, "23477 euros"), ("c-f1", "2020-01-01", "r1", "x", None, "23 477 €"),
              ("d-f1", None, "r1", "accepte", "offre", "q"), ("e-f1", None, "r1", "refuse", "offre", "q"))
    pairs, complete = contradictions.candidates(f)
    got = {(p.bucket, p.a, p.b) for p in pairs.collect()}
    assert ("montant", "a-f1", "b-f1") in got and ("montant", "a-f1", "c-f1") not in got and ("sens_action", "d-f1", "e-f1") in got and complete
    few, complete = contradictions.candidates(f, 1)
    assert few.collect() == pairs.orderBy("bucket", "key", "a", "b").limit(1).collect() and not complete
    v = spark.createDataFrame([("a-f1", "b-f1", "compatible"), ("d-f1", "e-f1", "incompatible")], "a string, b string, label string")
    assert {(r.a, r.tier) for r in contradictions.judged(pairs, v).collect()} >= {("d-f1", "T4")} and ("a-f1", "b-f1") not in {(r.a, r.b) for r in contradictions.judged(pairs, v).collect()}
    assert contradictions.oversized(contradictions.buckets(f), 2).first().n == 3


def test_persons_merge(spark):
    m = spark.createDataFrame([("notaire", "Maître Jean Dupont", ["JD"], "low", None, ["f1"], 0), ("mandataire", "jean DUPONT", None, "high", "note", ["f2", "f1"], 1), ("notaire", "Dupont", None, "low", None, ["f3"], 2), ("banque", "Dupont", None, "low", None, ["f4"], 3)], "role_id string, name string, aliases array<string>, confidence string, note string, evidence_fact_ids array<string>, pos int")
    got = {p.person_id: p for p in persons.resolved(m, "demo").collect()}
    assert set(got) == {"demo-jean-dupont", "demo-dupont"}
    p = got["demo-jean-dupont"]
    assert p.canonical_name == "Maître Jean Dupont" and p.aliases == ["JD", "jean DUPONT"]
    assert {a.role_id: (a.confidence, a.ambiguity_note, a.evidence_fact_ids) for a in p.role_assignments} == {"notaire": ("low", None, ["f1"]), "mandataire": ("high", "note", ["f1", "f2"])}
    all_edges, sound = persons.edges(persons.resolved(m, "demo"), spark.createDataFrame([("f1",)], "fact_id string"))
    assert all_edges.count() == 3 and sound.count() == 1


def test_backfill(spark):
    f = facts(spark, ("d-f1", None, "r", "a", None, "exact quote"), ("d-f2", None, "r", "a", None, "EVEN   quote"), ("d-f3", None, "r", "a", None, "foreign"))
    c = spark.createDataFrame([("d", "c2", "an exact quote"), ("d", "c1", "an Even quote"), ("x", "c0", "exact quote")], "doc_id string, chunk_id string, texte string")
    assert {r.fact_id: r.source_chunk_id for r in persons.backfilled(f, c).collect()} == {"d-f1": "c2", "d-f2": "c1", "d-f3": None}


def test_roles_and_personas(spark):
    h = spark.createDataFrame([("a", "p2"), ("a", "p1"), ("b", "p3")], "role string, person_id string")
    assert {r.person_id: r.label for r in persons.numbered_labels(h).collect()} == {"p1": "a_1", "p2": "a_2", "p3": "b"}
    assert {r.person_id: r.role for r in persons.chosen_role(spark.createDataFrame([("p", "aaa"), ("p", "zzz")], "person_id string, role string"), ("aaa",)).collect()} == {"p": "zzz"}
    one = lambda *rows: spark.createDataFrame(list(rows), "person_id string, persona string")
    people = spark.createDataFrame([(p,) for p in ("p1", "p2", "p3", "p4")], "person_id string")
    got = persons.personas(people, one(("p1", "R")), one(("p1", "X"), ("p2", "P1")), spark.createDataFrame([(0, "P1"), (1, "P2")], "pos int, persona string"))
    assert {r.person_id: r.persona for r in got.collect()} == {"p1": "R", "p2": "P1", "p3": "P2", "p4": "Personne A"}


def test_integrity_and_citations(spark):
    f = facts(spark, ("d-f1", "2020-01-01", "r1", "a", None, "q"), ("d-f2", "junk", "r2", "a", None, "q"))
    docs = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    got = integrity.integrity(f, spark.createDataFrame([("r1",)], "role_id string"), spark.createDataFrame([("p", "ghost")], "person_id string, fact_id string"), docs, spark.createDataFrame([("d", "ok")], "doc_id string, status string"), rejected=3)
    assert {r.kind: (r.n, r.sample) for r in got.collect()} == {"dangling_edge": (1, ["p|ghost"]), "uncatalogued_role": (1, ["r2"]), "document_without_facts": (1, ["e"]), "document_not_verified": (1, ["e"]), "undated_fact": (1, ["d-f2"]), "unanchored_fact": (2, ["d-f1", "d-f2"]), "unparsed_rows": (1, ["3 lignes"])}
    o = spark.createDataFrame([("o", "c1", ["c2"], ["c9"], "le TEXTE")], "obligation_id string, source_chunk_id string, also array<string>, penal array<string>, excerpt string")
    s = spark.createDataFrame([("c1", "VIGUEUR", "voici le texte"), ("c2", "VIGUEUR_DIFF", "")], "chunk_id string, etat string, texte string")
    assert {(r.chunk_id, r.problem) for r in integrity.citations(o, s).collect()} == {("c2", "not_in_force"), ("c9", "anchor_absent")}
    assert [(r.chunk_id, r.obligations) for r in integrity.corpus_gaps(o, s).collect()] == [("c9", ["o"])]
    clause = spark.createDataFrame([("o1", "d*", "ABC"), ("o2", "d*", "zzz"), ("o3", "x*", "abc")], "obligation_id string, doc_id_pattern string, excerpt string")
    body = spark.createDataFrame([("doc", "abc def")], "doc_id string, body string")
    assert {(r.obligation_id, r.problem) for r in integrity.clause_citations(clause, body).collect()} == {("o2", "excerpt_not_found"), ("o3", "no_document")}


def test_anonymise(spark):
    p = spark.createDataFrame([("p1", "Maître Mena", ["Mena", "notaire"]), ("p2", "Hélène Régnier", None), ("p3", "Paul Régnier", None)], "person_id string, canonical_name string, aliases array<string>")
    names = anonymise.known_names(p)
    assert {r.name for r in names.collect()} == {"Maître Mena", "Mena", "Hélène Régnier", "Paul Régnier"}
    people = spark.createDataFrame([("p1", "Anne Blanc"), ("p2", "Zoé Petit"), ("p3", "Luc Grand")], "person_id string, persona string")
    m = anonymise.guarded(anonymise.pseudonyms(names, people))
    assert m["mena"] == "Anne Blanc" and m["regnier"] == "la personne" and m["helene"] == "Zoé Petit" and "maitre" not in m
    d = spark.createDataFrame([("d", "HELENE  REGNIER et Régnier, écrire à x@y.fr, menaces")], "doc_id string, body string")
    clean = d.select("doc_id", anonymise.anonymised(F.col("body"), m).alias("body"))
    assert clean.first().body == "Zoé Petit et la personne, écrire à [email], menaces"
    needles = spark.createDataFrame([(k,) for k in m], "needle string")
    assert {(r.kind, r.needle) for r in anonymise.leaks(d, needles).collect()} == {("name", "helene"), ("name", "regnier"), ("name", "helene regnier"), ("pattern", "email")}
    assert anonymise.leaks(clean, needles).isEmpty()
    with pytest.raises(ValueError, match="cascade"):
        anonymise.guarded(spark.createDataFrame([("jean", "Paul"), ("paul", "Luc")], "key string, value string"))
    with pytest.raises(ValueError, match="no policy"):
        anonymise.by_policy(d, {"doc_id": "keep"}, m)
    out, n = anonymise.scrubbed(d, ["body"])
    again, none = anonymise.scrubbed(out, ["body"])
    assert n.first().changed == 1 and none.first().changed == 0 and again.collect() == out.collect()


def test_compliance(spark):
    a = spark.createDataFrame([("r1", json.dumps([{"chunk_id": "c1", "status": "met", "confidence": "low", "rationale": "x", "fact_ids": []}, {"chunk_id": "c2", "status": "odd", "rationale": "x"}])[:-1] + ', {"cut')], "role_id string, result_json string")
    ok, bad = compliance.entries(a)
    assert [r.chunk_id for r in ok.collect()] == ["c1"] and [r.reason for r in bad.collect()] == ["bad_status"]
    holders = spark.createDataFrame([("r1", "p1", "A", "low"), ("r1", "p2", "B", "high")], "role_id string, person_id string, name string, confidence string")
    assert [x.person_id for x in compliance.with_persons(ok, holders).first().persons] == ["p2"]
    windows = spark.createDataFrame([("d", 1, "le mandataire devra payer")], "doc_id string, page int, body string")
    raw = spark.createDataFrame([(0, "d", 1, "o1", "devra payer", "m", ["payer"]), (1, "d", 1, "o1", "devra payer", "m", ["payer"]), (2, "d", 1, "o2", "devra  payer", "m", ["x"]), (3, "d", 1, "o3", "devra", "z", ["x"]), (4, "d", 1, "o4", "devra", "m", []), (5, "d", 1, "", "devra", "m", ["x"])], "seq int, doc_id string, page int, obligation_id string, excerpt string, role string, terms array<string>")
    good, rejected = compliance.proposals(raw, windows, spark.createDataFrame([("m",)], "role_id string"))
    assert [r.seq for r in good.collect()] == [0]
    assert {r.seq: r.reason for r in rejected.collect()} == {2: "excerpt_not_verbatim", 3: "unknown_role", 4: "no_terms", 5: "missing_field"}
    with pytest.raises(Exception, match="over the ceiling"):
        compliance.cost_gate(spark.createDataFrame([(26.0,)], "cost_usd double"), 25.0).collect()


def test_telemetry(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "turn_id string, conversation_id string, position int, question string, answer string, created_at string, citations string")
    got = {r.turn_id: (r.question, r.answer, r.created_at) for r in telemetry.save_turns(t(("t1", "c", 0, "q", "a", "d1", "[]")), t(("t1", "c", 0, "Q2", "A2", "d2", "[]"), ("t2", "c", 1, "q", "a", "d2", "[]"))).collect()}
    assert got == {"t1": ("q", "A2", "d1"), "t2": ("q", "a", "d2")}
    fb = spark.createDataFrame([("t1", 1, "d1"), ("t1", -1, "d2"), ("x", 5, "d1")], "turn_id string, rating int, created_at string")
    c = spark.createDataFrame([("c", "T", "d")], "id string, title string, updated_at string")
    h = telemetry.history(c, t(("t1", "c", 0, "q", "a", "d1", '[{"chunk_id": "k", "num": 1, "url": "u"}]'), ("t9", "gone", 0, "q", "a", "d1", "[]")), fb).collect()
    assert [(r.turn_id, r.rating, r.citations[0].chunk_id) for r in h] == [("t1", -1, "k")]
    assert {(r.problem, r.key) for r in telemetry.violations(c, t(("t9", "gone", 0, "q", "a", "d1", "[]")), fb).collect()} == {("turn_without_conversation", "t9"), ("feedback_without_turn", "t1"), ("feedback_without_turn", "x"), ("bad_rating", "x")}


def test_csv_and_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('chunk_id,source,texte\nx,s,\ny,s,"a ""quoted""\nline"\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("chunk_id,source,etat\n")
    got = readers.read_chunk_files(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")])
    assert got.columns == schemas.CHUNK_FIELDS and {r.chunk_id: (r.texte, r.etat) for r in got.collect()} == {"x": ("", ""), "y": ('a "quoted"\nline', "")}
    with pytest.raises(ValueError, match="repeated"):
        schemas.check_chunks(got.unionByName(got), ["chunk_id"])
    (tmp_path / "f.jsonl").write_text('{"fact_id": "d-f1", "actor_role": "role_a", "action": "a", "verbatim_quote": "q", "source_doc_id": "d"}\nnot json\n{"fact_id": "d-f2", "actor_role": "X", "verbatim_quote": " "}\n')
    rows, bad = readers.read_jsonl(spark, str(tmp_path / "f.jsonl"), schemas.FACT)
    ok, rejected = schemas.valid_facts(rows)
    assert bad.count() == 1 and [r.fact_id for r in ok.collect()] == ["d-f1"] and rejected.first().reason == "missing_id"
    table = sinks.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    for n in (1, 2, 3):
        table.write(spark.range(n))
        assert table.read().count() == n
    old = spark.createDataFrame([("d1", 1), ("d2", 2)], "doc string, n int")
    new = sinks.replaced_by_document(old, spark.createDataFrame([("d2", 5)], "doc string, n int"), "doc", spark.createDataFrame([("d2",), ("d3",)], "doc string"), ["doc"])
    assert [tuple(r) for r in new.collect()] == [("d1", 1), ("d2", 5)]


def test_articles(spark, tmp_path):
    src = tmp_path / "raw" / "cc"
    src.mkdir(parents=True)
    art = {"id": "LEGIARTI000001", "num": "L. 12", "texte": "<p>Le &eacute;t&eacute;</p>", "etat": "VIGUEUR", "dateDebut": -5231606400000, "context": {"titresTM": [{"titre": "Livre I"}, {"titre": "Titre II"}]}}
    for name, body in {"a": art, "b": art | {"num": "13", "etat": "ABROGE"}, "c": art | {"num": "14", "texte": " "}, "d": {"text": {"id": "JURITEXT01", "numeroAffaire": ["21-1"], "formation": "CIV", "texte": "x", "dateTexte": 86400000}}}.items():
        (src / f"{name}.json").write_text(json.dumps(body))
    (src / "e.json").write_text("{broken")
    got = {r.num: r for r in readers.article_rows(readers.read_articles(spark, str(tmp_path / "raw"))).collect()}
    a, d = got["L. 12"], got["21-1"]
    assert (a.chunk_id, a.texte, a.section_path, a.date_debut, a.date_fin, a.dropped) == ("cc-l12", "Le été", "Livre I > Titre II", "1804-03-21", "", None)
    assert (d.section_path, d.etat, d.date_debut) == ("CIV", "VIGUEUR", "1970-01-02")
    assert {n: r.dropped for n, r in got.items()} == {"L. 12": None, "13": "non_vigueur", "14": "empty", "21-1": None, "": "malformed"}


def test_sections(spark):
    s = spark.createDataFrame([("r", "s1", "section", 1), ("r", "a0", "article", 0), ("s1", "a1", "article", 0), ("s1", "r", "section", 1), ("s1", "a0", "article", 2)], "parent string, child string, kind string, position int")
    assert [r.article_id for r in readers.section_articles(s, "r").orderBy("position").collect()] == ["a0", "a1"]


def test_changed_documents(spark, tmp_path):
    raw = tmp_path / "raw" / "Dossier A"
    raw.mkdir(parents=True)
    (raw / "Lettre 1.txt").write_text("one")
    first = readers.changed_documents(spark, str(tmp_path / "raw"), spark.createDataFrame([], "doc_id string, sha256 string"))
    known = first.select("doc_id", "sha256")
    assert [r.doc_id for r in first.collect()] == ["dossier_a__lettre_1"] or [r.doc_id for r in first.collect()] == ["dossier_20a__lettre_201"]
    known = spark.createDataFrame(known.collect(), known.schema)
    assert readers.changed_documents(spark, str(tmp_path / "raw"), known).isEmpty()


def test_watch(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()
    answers = iter([False, True, True])

    def cycle(df, epoch):
        seen.append(df.count())
        return next(answers)

    for n in (1, 2):
        (inbox / f"{n}.json").write_text('{"k": 1}\n' * n)
        watch.watch(spark, str(inbox), "k int", str(tmp_path / "ckpt"), cycle)
    watch.watch(spark, str(inbox), "k int", str(tmp_path / "ckpt"), cycle)
    assert seen == [1, 1, 2]  # an incomplete cycle runs again at once; nothing new runs nothing
    assert [watch.due(*a) for a in ((True, False, True, 0), (False, True, True, 0), (False, False, False, 0), (False, False, True, 90_000), (False, False, True, 5))] == ["changed", "first_run", "backlog", "full_sweep", None]
    h = watch.artifact_hashes(spark, {"a": str(inbox / "1.json"), "b": str(inbox / "none")})
    hashes = {r.name: r.sha256 for r in h.collect()}
    assert hashes["b"] == "missing" and len(hashes["a"]) == 64
    assert [r.name for r in watch.changed(spark.createDataFrame([("a", "x"), ("b", "missing")], "name string, sha256 string"), h).collect()] == ["a"]
