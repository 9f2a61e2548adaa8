import numpy as np
from pyspark.sql import functions as F

from casebench.llm import neighbours


def brute(ids, vectors, queries, k=20):
    out = {}
    for q in queries:
        s = vectors @ vectors[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = [r.vec_id for r in e], np.array([r.embedding for r in e], np.float64)
    got = {}
    for r in neighbours.op5_ann_forest(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(ids, v, [i for i in ids if i % 20 == 0])
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        order = [found[k] for k in sorted(found)]
        assert all((-a[1], a[0]) < (-b[1], b[0]) for a, b in zip(order, order[1:], strict=False))
        assert all(abs(s - v[ids.index(i)] @ v[ids.index(q)]) < 1e-12 for i, s in order)
        hits += len({i for i, _ in order} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_copies_and_bad_vectors(spark):
    data = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(60, 120)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [1.0, float("nan"), 2.0]), (None, [1.0, 1.0, 1.0]), (300, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").withColumn("embedding_copy", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, v = [i for i, _ in data], np.array([x for _, x in data])
    want = brute(ids, v, [i for i in ids if i % 20 == 0])
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in want[q]]


def test_empty_and_few(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 4.0)]


def filled(spark, data, k=20, recall=0.95):
    ids, dim = [i for i, _ in data], max(len(x) for _, x in data)
    v = np.array([[*x, *[0.0] * (dim - len(x))] for _, x in data])
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in data], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k, recall).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(ids, v, [i for i in ids if i % 20 == 0], k)
    assert got.keys() == want.keys()
    assert all(len(x) == len(set(x)) == min(k, len(ids) - 1) for x in got.values())
    return sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_every_query_gets_all_it_asks_for(spark):
    """Tight clusters, a cluster with most rows, and tables hardly larger than k."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(2, 8))
    near = lambda c, n: (c + rng.normal(size=(n, 8)) * 1e-3).tolist()
    assert filled(spark, list(enumerate(near(centres[0], 20) + near(centres[1], 20)))) >= 0.9
    assert filled(spark, list(enumerate(near(centres[0], 21)))) == 1
    skewed = list(enumerate(near(centres[0], 2500) + near(centres[1], 15) + rng.normal(size=(400, 8)).tolist()))
    assert filled(spark, skewed) >= 0.9


def test_shorter_vectors_have_zeros_at_the_end(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=3 if i % 4 == 0 else 6).tolist()) for i in range(80)]
    assert filled(spark, data, recall=1.0) == 1


def test_crowded_prefixes_are_split(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=8) + rng.normal(size=(3000, 8)) * 1e-2
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    forest = neighbours.grow(df, df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), 20)
    for t in range(neighbours.TREES):
        n = np.diff(forest.before[t])
        assert n.sum() == 3000 and (np.diff(forest.starts[t]) > 0).all() and n.max() <= 3000 / 4
