"""Near-dedup on families of texts from one template, against all pairs."""

import numpy as np

from casebench.llm import simhash


def family(n, length, changes, copies, edits, seed=5):
    """n siblings, a template with words of their own at the same `changes` places, so that all pairs are equally similar;
    then `copies` of the first ones with `edits` more."""
    rng = np.random.default_rng(seed)
    places = np.arange(5, length - 5, 6)
    own = rng.choice(places, changes, replace=False)
    rest = np.setdiff1d(places, own)
    fresh = iter(range(10**9))

    def changed(words, at):
        out = list(words)
        for i in at:
            out[i] = f"n{next(fresh)}"
        return out

    template = [f"w{i}" for i in range(length)]
    siblings = [changed(template, own) for _ in range(n)]
    return [" ".join(w) for w in siblings + [changed(siblings[i], rng.choice(rest, edits, replace=False)) for i in range(copies)]]


def similarities(texts):
    """Jaccard similarity of the sets of 5-word shingles, of all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    common = {}
    for k, s in enumerate(sets):
        for x in s:
            common.setdefault(x, []).append(k)
    has = np.zeros((len(texts), sum(len(v) > 1 for v in common.values())), np.float32)
    for c, members in enumerate(v for v in common.values() if len(v) > 1):
        has[members, c] = 1
    shared = has @ has.T
    size = np.array([len(s) for s in sets])
    return shared / (size[:, None] + size - shared)


def roots(close):
    root, close = np.arange(len(close)), close | np.eye(len(close), dtype=bool)
    while not np.array_equal(new := np.where(close, root, len(close)).min(axis=1), root):
        root = new
    return root


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.root for r in simhash.similar_groups(docs).collect()}
    return np.array([got[i] for i in range(len(texts))])


def test_no_chance_links(spark):
    texts = family(600, 800, 19, 20, 2)
    true = roots(similarities(texts) >= 0.8)
    got = found(spark, texts)
    false = (got[:, None] == got) & (true[:, None] != true)
    assert not false.any()


def test_copies_within_a_family(spark):
    texts = family(1000, 400, 10, 100, 6)
    close = similarities(texts)
    assert np.triu(close[:1000, :1000], 1).max() < 0.8 and all(close[i, 1000 + i] >= 0.85 for i in range(100))
    got = found(spark, texts)
    assert (got[:100] == got[1000:]).sum() >= 99
    assert len(set(got.tolist())) >= 1000
