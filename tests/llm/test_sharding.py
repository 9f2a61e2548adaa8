import zlib

import numpy as np

from casebench.llm import sharding
from tests.llm.fixtures import documents, none, rows


def check(got, n, shards):
    counts = np.bincount([r.shard for r in got], minlength=shards)
    assert len(got) == n and len(counts) == shards and counts.max() - counts.min() <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_exact_sizes_and_reruns(spark, sf):
    one, two = (sharding.op7_shard_shuffle(spark, sf) for _ in range(2))
    assert rows(one) == rows(two)
    check(one.collect(), spark.read.parquet(f"{sf}/documents.parquet").count(), 40)
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in one.collect())


def test_other_partitioning_same_result(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows(sharding.shard_documents(docs.repartition(7))) == rows(sharding.shard_documents(docs.coalesce(1)))


def drawn_matrix(sizes, shards, seed):
    rng = np.random.default_rng(seed)
    return sharding.matrix(sizes, sharding.even(sum(sizes), shards, rng), rng)


def test_matrix_margins():
    m = drawn_matrix([10, 0, 7, 23], 6, 1)
    assert m.sum(axis=1).tolist() == [10, 0, 7, 23] and sorted(m.sum(axis=0).tolist()) == [6, 6, 7, 7, 7, 7]
    big = drawn_matrix([3 * 10**9, 2 * 10**9 + 1], 3, 1)
    assert big.sum(axis=1).tolist() == [3 * 10**9, 2 * 10**9 + 1] and np.ptp(big.sum(axis=0)) <= 1 and big.min() >= 0


def test_uniform():
    """Over seeds each partition's rows go to each shard about equally often."""
    total = sum(drawn_matrix([6, 6], 3, seed) for seed in range(600))
    assert abs(total / 600 - 2).max() < 0.15


def test_matrix_law_by_brute_force():
    """How often each matrix comes, against counting all ways to deal 5 rows of two partitions to shards of 3 and 2."""
    from collections import Counter
    from itertools import combinations

    want = Counter()
    for chosen in combinations(range(5), 3):  # the rows of shard 0; rows 0 to 2 are partition 0
        of = sum(c < 3 for c in chosen)
        want[(of, 3 - of, 3 - of, of - 1)] += 1 / 10
    got = Counter(tuple(sharding.matrix([3, 2], [3, 2], np.random.default_rng(s)).ravel().tolist()) for s in range(6000))
    assert set(got) == set(want) and all(abs(got[k] / 6000 - p) < 0.03 for k, p in want.items())


def test_draws_beyond_the_generators_range():
    """By inversion: mean, deviation and bounds of the hypergeometric law, and the same law where both can draw."""
    rng = np.random.default_rng(7)
    good, bad, n = 3 * 10**11, 9 * 10**11, 250_000
    x = np.array([sharding.drawn(rng, good, bad, n) for _ in range(3000)])
    sd = (n * 0.25 * 0.75) ** 0.5
    assert abs(x.mean() - n / 4) < 5 * sd / 3000**0.5 and abs(x.std() / sd - 1) < 0.06
    assert {sharding.drawn(rng, 2 * 10**9, 0, 5) for _ in range(3)} == {5} and {sharding.drawn(rng, 0, 2 * 10**9, 5) for _ in range(3)} == {0}
    few = np.bincount([sharding.drawn(rng, 10**9, 10**9, 2) for _ in range(4000)], minlength=3) / 4000
    assert abs(few - [0.25, 0.5, 0.25]).max() < 0.04


def test_query_by_brute_force(spark, sf):
    """Every row's shard from the matrix as Spark drew it, and its slot, worked out again in Python."""
    from casebench.llm.common import materialize

    docs = materialize(sharding.sized(spark.read.parquet(f"{sf}/documents.parquet")), "t")
    hashed = docs.selectExpr("doc_id", "text_crc32", f"pmod(xxhash64({sharding.SEED}, doc_id, text_crc32), 16) part", f"xxhash64({sharding.SEED + 1}, doc_id, text_crc32) r1").collect()
    counts = {p: sum(r.part == p for r in hashed) for p in range(16)}
    table = spark.createDataFrame(list(counts.items()), "__part long, n long")
    ends = {r["__p"]: r["__ends"] for r in sharding.lines(table, 40, sharding.SEED, 16).collect()}
    want = {}
    for p in range(16):
        for rank, r in enumerate(sorted((x for x in hashed if x.part == p), key=lambda x: (x.r1, x.doc_id))):
            want[r.doc_id] = sum(e <= rank for e in ends[p])
    assert {r.doc_id: r.shard for r in sharding.shuffled(docs).collect()} == want


def test_odd_rows(spark, tmp_path):
    check(sharding.shard_documents(documents(spark), 4).collect(), 14, 4)
    assert sharding.shard_documents(none(spark)).count() == 0
    where = sharding.write_shards(documents(spark), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, "shard", "slot") == rows(where, "shard", "slot")
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(r.text) for r in documents(spark).collect())
