import numpy as np
import pytest

from casebench.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string"


def brute(rows):
    """n, deviations and whitened coordinates by a plain eigendecomposition; rows: lists of finite numbers."""
    d = max(map(len, rows))
    x = np.floor(1024 * np.array([[*r, *[0.0] * (d - len(r))] for r in rows])).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviations = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
    centred = x - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, deviations, e, centred @ v, e.sum()


def compare(got, ids, rows, components=8):
    n, deviations, e, along, total = brute(rows)
    by = {(r.vec_id, r.component): r for r in got}
    kept = [k for k in range(min(components, len(e))) if e[k] > 1e-12 * e[0]]
    assert len(got) == len(ids) * len(kept)
    for k in kept:
        sign = np.sign(sum(by[i, k + 1].whitened * a for i, a in zip(ids, along[:, k], strict=True)))
        for i, a, dev in zip(ids, along[:, k], deviations, strict=True):
            r = by[i, k + 1]
            assert r.n == n and r.deviation == dev and r.identity_error <= 1e-4
            assert r.whitened == pytest.approx(sign * a / e[k] ** 0.5, abs=1e-6) and r.explained == pytest.approx(e[k] / total, rel=1e-6)


def test_merges_lose_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(-2000, 2000, (300, 7)) + 100_000
    for cuts in ([1], [3, 5, 200], [50, 51, 52, 53, 299]):
        parts = [whitening.whole_state(p) for p in np.split(x, cuts)]
        own = parts[0]
        for p in parts[1:]:
            own = whitening.merged(own, p)
        assert own.n == 300 and own.sums == list(x.sum(axis=0))
        assert np.allclose(own.covariance(), np.cov(x.T, bias=True), rtol=1e-10)
        assert np.allclose(own.vectors @ own.vectors.T, np.eye(7), atol=1e-12)


def test_wide_rows_keep_all_dimensions():
    rng = np.random.default_rng(6)
    x = rng.integers(-500, 500, (5, 40)) + 100_000
    own = whitening.merged(whitening.whole_state(x[:2]), whitening.whole_state(x[2:]))
    assert np.allclose(own.covariance(), np.cov(x.T, bias=True), atol=1e-6)


def test_numbers_beyond_64_bits():
    rows = np.array([[1 << 61, 5], [-(1 << 61), 7], [3, 9]], dtype=np.int64)
    own = whitening.whole_state(rows)
    assert own.sums == [3, 21]
    exact = whitening.apart(rows, 3, own.sums)
    assert [int(x) for x in exact[:, 0]] == [3 * (1 << 61) - 3, -3 * (1 << 61) - 3, 6]
    assert int((exact * exact).sum(axis=1)[0]) == (3 * (1 << 61) - 3) ** 2 + 36


def test_query_by_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = whitening.op12_whitening(spark, sf).collect()
    compare(got, [r.vec_id for r in table], [list(r.embedding) for r in table])


def test_tree_of_many_parts(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(70)
    rows = table.collect()
    compare(whitening.whiten(table, 3).collect(), [r.vec_id for r in rows], [list(r.embedding) for r in rows], 3)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 0.25, -1.0], "x"), (1, [0.5, 0.25, -1.0], "x"), (2, [0.1], None), (None, [3.0, 1.0, 2.0], "y"), (3, None, "y"), (4, [1.0, None, 2.0], "y"), (5, [inf, 0.0, 1.0], "y"), (6, [nan], "y"), (7, [], "y"), (8, [1e30, 0.0, 0.0], "y")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = whitening.whiten(table).collect()
    assert {r.vec_id for r in got} == {1, 2, None, 7, 8} and got[0].n == 6
    assert all(r.deviation is None for r in got)  # 1e30 takes every sum beyond 64 bits
    calm = [r for r in rows if r[0] not in (3, 4, 5, 6, 8)]
    got = whitening.whiten(spark.createDataFrame([(10 + i, v, n) for i, (_, v, n) in enumerate(calm)], SCHEMA)).collect()
    compare(got, [10 + i for i in range(len(calm))], [[float(np.float32(x)) for x in v] for _, v, _ in calm])


def test_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0], "")], [(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], [(1, [], "")], [(1, None, "")]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0
