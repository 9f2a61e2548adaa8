import numpy as np

from casebench.llm import toxicity
from tests.llm.fixtures import documents, none

MILD, BAD, VILE = ["grumpel", "moskar"], ["drevok", "hattin"], ["zzorgh", "quiblax"]


def corpus(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in ("an", "el", "io", "ur") for c in ("to", "ra", "mi", "su")]
    out = []
    for i in range(n):
        grade = int(rng.integers(4))
        w = list(rng.choice(words, 60))
        for g, bad in zip((1, 2, 3), (MILD, BAD, VILE), strict=True):
            if grade >= g:
                w.insert(int(rng.integers(60)), str(rng.choice(bad)))
        out.append((i, " ".join(w), grade))
    return spark.createDataFrame(out, "doc_id long, text string, grade int")


def test_ordered_grades(spark):
    docs = corpus(spark, 600)
    model = toxicity.learned(docs, docs.filter("doc_id < 400"), "grade")
    assert len(model.cuts) == 3 and (np.diff(model.cuts) > 0).all()
    got = toxicity.grade_documents(docs, model).join(docs.select("doc_id", docs.grade.alias("true")), "doc_id").filter("doc_id >= 400").collect()
    assert np.mean([r.grade == r.true for r in got]) > 0.9
    assert np.mean([abs(r.severity - r.true) for r in got]) < 0.35
    assert all(r.toxic == (r.true > 0) for r in got if abs(r.severity - 0.5) > 0.4)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.grade_documents(docs, toxicity.learned(docs, labels.filter("doc_id % 4 <> 1"))).join(labels.select("doc_id", labels.toxic.alias("true")), "doc_id").filter("doc_id % 4 = 1").collect()
    hit = sum(r.toxic and r.true for r in got)
    assert hit >= 0.88 * sum(r.true for r in got) and sum(r.toxic and not r.true for r in got) <= 0.01 * len(got)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learned(documents(spark), labels)
    got = toxicity.grade_documents(documents(spark), model).collect()
    assert len(got) == 14 and all(0 <= r.severity <= 1 for r in got)
    assert toxicity.grade_documents(none(spark), model).count() == 0
    nothing = toxicity.learned(none(spark), labels.limit(0))
    assert {(r.severity, r.grade, r.toxic) for r in toxicity.grade_documents(documents(spark), nothing).collect()} == {(0.0, 0, False)}


def test_fit_against_a_plain_optimiser():
    """Three grades, five features: small gradient steps from zero come to the same loss, weights and cuts."""
    rng = np.random.default_rng(3)
    n, x = 240, rng.random((240, 5)) < 0.4
    score = x @ np.array([2.0, -1.0, 0.0, 1.0, 0.5]) + rng.logistic(size=n)
    grade = (score > 0.5).astype(int) + (score > 2)
    row, feature = np.nonzero(x)
    model = toxicity.fit(grade, row, feature, bits=3, steps=600, l1=0.0, min_texts=1)
    w, cuts = np.zeros(5), np.array([-1.0, 1.0])

    def loss(w, cuts):
        s = x @ w
        below = np.stack([np.zeros(n), *(1 / (1 + np.exp(-(c - s))) for c in cuts), np.ones(n)])
        return -np.log(below[grade + 1, np.arange(n)] - below[grade, np.arange(n)]).mean()

    for _ in range(4000):
        p = np.concatenate([w, cuts])
        slope = np.array([(loss((p + d)[:5], (p + d)[5:]) - loss((p - d)[:5], (p - d)[5:])) / 2e-5 for d in np.eye(7) * 1e-5])
        w, cuts = w - slope[:5], cuts - slope[5:]
    assert abs(loss(model.weights[:5], model.cuts) - loss(w, cuts)) < 1e-4
    assert abs(model.weights[:5] - w).max() < 0.05 and abs(model.cuts - cuts).max() < 0.05


def test_query_by_brute_force(spark, sf):
    """Severity of every document from the model's weights and its word beginnings, in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learned(docs, labels)
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    assert len(got) == docs.count()
    for r in docs.limit(60).collect():
        found = set()
        for word in toxicity.letters((r.text or "").encode()).split():
            starts = [0] if len(word) <= toxicity.LONG_RUN else [i for i, b in enumerate(word) if b & 0xC0 != 0x80]
            for w in (word[i:] for i in starts):
                for k in toxicity.BEGINNINGS:
                    if len(w) >= k or k == max(toxicity.BEGINNINGS):
                        head = int.from_bytes(w[:k].ljust(k, b"\0"), "big")
                        found.add((head + k - 1) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - toxicity.FEATURE_BITS)
        score = sum(model.weights[f] for f in found)
        below = [0.0, *(1 / (1 + np.exp(score - c)) for c in model.cuts), 1.0]
        want = sum(g * (b - a) for g, a, b in zip(model.grades, below, below[1:], strict=False))
        assert abs(got[r.doc_id].severity - want) < 1e-9


def test_long_runs_are_read_to_the_end():
    one, two = ("漢字" * 40 + end for end in ("悪口悪口", "平和平和"))
    row, feature = toxicity.features([one.encode(), two.encode()])
    assert set(feature[row == 0].tolist()) != set(feature[row == 1].tolist())
