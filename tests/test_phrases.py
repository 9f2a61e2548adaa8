import random
import re

import pytest

from casebench.functions import phrases
from casebench.operators import anonymise

DOC = "doc_id long, body string, more string"


def brute_found(text, keys):
    f = phrases.fold_marks(text)
    return sorted({k for k in map(phrases.evened, keys) if re.search("[a-z0-9]", k) and re.search(pattern(k), f)})


def pattern(k):
    return r"(?<![a-z0-9])" + re.escape(k).replace(r"\ ", r"\s+") + "(?![a-z0-9])"


def brute_replaced(text, mapping):
    """Longest first, spans of the folded text; only for texts that fold character by character."""
    f = phrases.fold_marks(text)
    assert len(f) == len(text)
    taken, spans = [False] * len(f), []
    for k in sorted(mapping, key=lambda k: (-len(phrases.evened(k)), phrases.evened(k))):
        for m in re.finditer(pattern(phrases.evened(k)), f):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = [True] * (m.end() - m.start())
                spans.append((m.start(), m.end(), mapping[k]))
    out, at = "", 0
    for a, b, v in sorted(spans):
        out, at = out + text[at:a] + v, b
    return out + text[at:]


def made(rng):
    words = ["Anne", "René", "martin", "de", "la", "Saint-Jean", "l'Hôte", "x1", "S.A.", "élan", "banque"]
    keys = list({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(25)})
    texts = ["".join(rng.choice([*words, "foo", "Annette", "x12"]) + rng.choice([" ", " ", "  ", ", ", "-", "\n", "."]) for _ in range(rng.randrange(0, 40))) for _ in range(30)]
    return keys, texts


def test_trie_against_regular_expressions():
    rng = random.Random(1)
    for _ in range(30):
        keys, texts = made(rng)
        trie = phrases.Trie([phrases.evened(k) for k in keys])
        mapping = {phrases.evened(k): f"<{i}>" for i, k in enumerate(keys)}
        for t in texts:
            assert trie.found(t) == brute_found(t, keys)
            assert phrases.Trie(list(mapping)).replaced(t, mapping) == brute_replaced(t, mapping)


def test_longest_first_and_marks():
    swap = lambda t, **m: phrases.Trie(list(m)).replaced(t, m)
    assert phrases.Trie(["a b", "b c d"]).replaced("A b c d", {"a b": "1", "b c d": "2"}) == "A 2"
    assert swap("René, réne, renée", rene="X") == "X, X, renée"  # a mark goes with its letter
    assert swap("İrene irene", irene="X") == "X X" and phrases.fold_marks("Straße É") == "straße e"
    assert phrases.Trie([".x"]).found("a.x b") == [] and phrases.Trie([".x"]).found("a .x") == [".x"]


@pytest.mark.parametrize("most", [10**6, 0])
def test_tables_by_trie_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "MOST_CHARS", most)
    keys, texts = made(random.Random(2))
    rows = [(i, t, "m") for i, t in enumerate(texts)] + [(100, None, "m"), (101, "", None), (3, texts[3], "m"), (None, "nobody", "m")]
    docs = spark.createDataFrame(rows, DOC)
    needles = spark.createDataFrame([(k,) for k in [*keys, keys[0].upper(), "...", "", None]], "needle string")
    want = sorted((i, k) for i, t in enumerate(texts) for k in brute_found(t, keys))
    assert sorted({tuple(r) for r in phrases.occurring(docs, needles).collect()}) == want
    mapping = spark.createDataFrame([(k, f"<{i}>") for i, k in enumerate(keys)] + [("--", "gone"), (None, "gone")], "key string, value string")
    got = phrases.replaced(docs, mapping)
    assert got.columns == docs.columns
    by = dict((r.doc_id, r.body) for r in got.collect())
    assert got.count() == len(rows) and by[100] is None and by[101] == ""
    assert [by[i] for i in range(len(texts))] == [brute_replaced(t, {k: f"<{i}>" for i, k in enumerate(keys)}) for t in texts]
    assert phrases.occurring(docs.limit(0), needles).count() == 0 and phrases.occurring(docs, needles.limit(0)).count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_nothing_is_left_after_anonymising(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "MOST_CHARS", most)
    docs = spark.createDataFrame([(1, "Hélène Régnier a écrit à helene; Regnier répond.", "m"), (2, "Bonjour Mme RÉGNIER, zed@a.fr", "m")], DOC)
    mapping = spark.createDataFrame([("Helene Regnier", "Personne A"), ("helene", "Personne A"), ("regnier", "Personne A")], "key string, value string")
    extras = spark.createDataFrame([("Personne A répond", "Quelqu'un répond"), ("_note", "x"), ("note", "y")], "key string, value string")
    out = anonymise.anonymised_documents(docs, mapping, extras)
    by = {r.doc_id: r.body for r in out.collect()}
    assert by[1] == "Personne A a écrit à Personne A; Quelqu'un répond." and by[2].startswith("Bonjour Mme Personne A, [")
    assert anonymise.leaks(out, mapping.select(mapping.key.alias("needle"))).isEmpty()
    with pytest.raises(ValueError):
        anonymise.anonymised_documents(docs, spark.createDataFrame([("a", "b c"), ("b", "x")], "key string, value string"))
