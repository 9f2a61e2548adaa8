import random

import pytest
from pyspark.sql import functions as F

from casebench.operators import register


def least_reachable(edges, nodes):
    near = {n: {n} for n in nodes}
    for a, b in edges:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    out = {}
    for n in sorted(near):
        if n not in out:
            todo, seen = [n], {n}
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            out |= dict.fromkeys(seen, n)
    return out


@pytest.mark.parametrize("shape", ["random", "path", "star", "grid"])
def test_components_against_a_search(spark, shape):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "path": [(rng.sample(range(1000, 1080), 80)[i], 0) for i in range(1)] + [(a, a + 1) for a in range(60)],
        "star": [(50, i) for i in range(100)] + [(200, 201), (201, 201)],
        "grid": [(10 * i + j, 10 * i + j + 1) for i in range(8) for j in range(9)] + [(70, 3)],
    }[shape]
    frame = spark.createDataFrame([*edges, *edges[:3], (None, 5)], "a long, b long")
    got = {r.node: r.component for r in register.components(frame, spark.createDataFrame([(999,), (None,), (1,)], "node long")).collect()}
    assert got == least_reachable(edges, [999, 1])


def test_no_edges(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert register.components(none).count() == 0
    assert [tuple(r) for r in register.components(none, spark.createDataFrame([("x",)], "node string")).collect()] == [("x", "x")]


def test_classes_share_values_and_chain_through_groups(spark):
    ids = spark.createDataFrame([("b", "V"), ("a", "V"), ("c", "W"), ("d", "W"), ("e", None), ("f", "X"), (None, "X"), ("V", "Y")], "key string, value string")
    groups = spark.createDataFrame([("b", "zz"), ("zz", "d"), (None, "f")], "a string, b string")
    assert {tuple(r) for r in register.classes(ids, groups).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "f"), ("V", "V")}
    assert {tuple(r) for r in register.classes(ids).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e"), ("f", "f"), ("V", "V")}


def test_numbers_in_order(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i) for i in rng.sample(range(10_000), 900)]
    spark.conf.set("spark.sql.shuffle.partitions", 17)
    try:
        got = register.in_order(spark.createDataFrame(rows, "g string, x long"), ["g"], ["x"], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    assert {(r.g, r.x, r.n) for r in got} == {(g, x, i + 1) for g in ("a", "b", None) for i, x in enumerate(sorted(x for k, x in rows if k == g))} and len(got) == 900


def test_role_identifiers(spark):
    rows = [("k1", "Port-Bleu"), ("k2", "Port-Bleu"), ("k3", "Anse-Verte"), ("m", "[email]"), ("FOND A", "FOND A"), ("r1", "du moulin"), ("r2", "la Voie haute"), ("p1", "Zoé Petit"), ("p2", "Anne"), (None, "x"), ("n", None)]
    extras = spark.createDataFrame(rows, "key string, value string")
    tokens = spark.createDataFrame([("zoe", "p1"), ("k1", "p2"), ("lost", "nobody"), ("_note", "p1")], "token string, persona string")
    got = {r.key: r.slug for r in register.role_identifiers(extras, ("Port", "Anse"), tokens).collect()}
    assert got == {"k1": "commune_2", "k2": "commune_2", "k3": "commune_1", "m": "[email]", "FOND A": "produit_1", "r1": "voie_1", "r2": "voie_2", "p1": "personne_2", "p2": "personne_1", "zoe": "personne_2", "lost": "[nom]"}


def test_role_bindings(spark):
    roles = spark.createDataFrame([("p1", "heritier"), ("p1", "héritier nu-propriétaire"), ("p2", "notaire"), ("p3", "heritier"), ("p4", "heritier"), ("p5", ""), ("p6", None), ("p7", "notaire")], "person_id string, role string")
    groups = spark.createDataFrame([("p2", "p2"), ("p2", "p7")], "head string, person_id string")
    assert {tuple(r) for r in register.role_bindings(roles, groups).collect()} == {("p1", "heritier_nu_proprietaire"), ("p2", "notaire"), ("p3", "heritier_1"), ("p4", "heritier_2")}
    assert {r.label for r in register.role_bindings(roles).filter("head IN ('p2', 'p7')").collect()} == {"notaire_1", "notaire_2"}


def test_merged_persons(spark):
    rows = [("a", "Anne", "seen", "heir", "f2"), ("a", "Anne", "seen", "heir", "f1"), ("b", "A. Blanc", None, "heir", "f2"), ("b", "A. Blanc", "old", "buyer", "f9"), ("c", " ", None, None, None)]
    records = spark.createDataFrame(rows, "person_id string, name string, note string, role string, fact_id string")
    groups = spark.createDataFrame([("a", "a"), ("a", "b")], "head string, person_id string")
    got = {r.head: r for r in register.merged_persons(records, groups).collect()}
    assert set(got) == {"a", "c"} and got["a"].aliases == ["A. Blanc", "Anne"] and got["a"].note == "old · seen"
    assert [(x.role, x.facts) for x in got["a"].roles] == [("buyer", ["f9"]), ("heir", ["f1", "f2"])]
    assert got["c"].aliases == [] and got["c"].note is None and got["c"].roles == []
    assert register.merged_persons(records.filter(F.lit(False)), groups).count() == 0
