import json
import random

import pytest
from pyspark.sql import functions as F

from casebench.functions import pii, trees
from casebench.operators import anonymise
from casebench.sources import readers


def walk(node, found, sections, skip=readers.REFERENCE_KEYS):
    """A plain recursive walk."""
    if isinstance(node, dict):
        one = node.get("id") or node.get("cid")
        if isinstance(one, str) and len(one) == 20 and one[8:].isdigit():
            if one.startswith("LEGIARTI") and node.get("etat", "") in ("", "VIGUEUR", "VIGUEUR_DIFF"):
                found.add(one)
            elif one.startswith("LEGISCTA"):
                sections.add(one)
        for k, v in node.items():
            if k not in skip:
                walk(v, found, sections)
    elif isinstance(node, list):
        for v in node:
            walk(v, found, sections)


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([1, 2.5, None, True, "x", "LEGIARTI000000000001", []])
    if kind < 0.5:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    node = {k: tree(rng, depth - 1) for k in rng.sample(["a", "b", "sections", "lienCitations", "context", "articles"], rng.randrange(1, 5))}
    for k, values in (("id", ["", None, 0, 7, [], {}, "short"]), ("cid", [None, 3]), ("etat", ["", None, "VIGUEUR", "ABROGE", "VIGUEUR_DIFF", 1])):
        if rng.random() < 0.8:
            node[k] = rng.choice([*values, *[f"LEGI{rng.choice(['ARTI', 'SCTA'])}{rng.randrange(10**12):012d}"] * 4]) if k != "etat" else rng.choice(values)
    return node


@pytest.mark.parametrize("levels", [2, 64])
def test_collected_ids_against_a_plain_walk(spark, monkeypatch, levels):
    monkeypatch.setattr(readers, "LEVELS", levels)
    rng = random.Random(4)
    bodies = [tree(rng, rng.randrange(1, 9)) for _ in range(60)]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(100, "{not json"), (101, None), (102, "")]
    got = readers.collected_ids(spark.createDataFrame(rows, "n long, body string"), "n").collect()
    want = set()
    for i, b in enumerate(bodies):
        articles, sections = set(), set()
        walk(b, articles, sections)
        want |= {(i, "article", a) for a in articles} | {(i, "section", s) for s in sections}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 30


def test_no_bodies(spark):
    assert readers.collected_ids(spark.createDataFrame([], "body string")).count() == 0


def test_leaves_alone_change():
    text = '{"mail" : "a@b.fr",\n "n": 1.0e5, "big": 123456789012345678901, "k": ["x\\"y", "\\u00e9", {"mail": null, "mail": "c:d"}], "é": "a@b.fr" }'
    upper = trees.rewritten(text, lambda s: s.upper() if "@" in s else s)
    assert upper == text.replace('"a@b.fr"', '"A@B.FR"')
    assert trees.rewritten('"a"', str.upper) == '"A"' and trees.rewritten("[]", str.upper) == "[]" and trees.rewritten('{"a":"b"}', lambda s: 'q"\né') == '{"a":"q\\"\\né"}'
    with pytest.raises(ValueError):
        trees.rewritten('{"a"', str.upper)


def test_leaves_against_a_decoder():
    rng = random.Random(5)

    def mapped(v):
        return {k: mapped(x) for k, x in v.items()} if isinstance(v, dict) else [mapped(x) for x in v] if isinstance(v, list) else v.upper() if isinstance(v, str) else v

    for _ in range(80):
        v = tree(rng, 6)
        assert json.loads(trees.rewritten(json.dumps(v, indent=rng.choice([None, 2])), str.upper)) == mapped(v)


def test_scrubbed_json(spark):
    rows = [(1, '{"mail": "write to zed@a.fr", "n": 1}'), (2, '{"n": "nothing"}'), (3, "zed@a.fr {"), (4, None)]
    df = spark.createDataFrame(rows, "i long, props string")
    out, counts = anonymise.scrubbed_json(df, ["props"])
    by = {r.i: r.props for r in out.collect()}
    assert json.loads(by[1]) == {"mail": pii.redacted("write to zed@a.fr"), "n": 1} and by[2] == rows[1][1] and by[3] == rows[2][1] and by[4] is None
    assert tuple(counts.first()) == (1, 1)
    assert anonymise.scrubbed_json(out, ["props"])[1].first()["changed"] == 0
    assert out.filter(F.col("i") == 1).select(trees.is_json(F.col("props"))).first()[0]
