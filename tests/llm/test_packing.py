import itertools

from casebench.llm import packing
from tests.llm.fixtures import documents, none


def cost(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))


def test_boundaries_against_all_choices():
    lengths, counts = [1, 2, 3, 7, 8, 20, 21, 22, 40], [5, 1, 9, 2, 2, 7, 1, 3, 1]
    for k in (1, 2, 3, 4):
        best = min(cost(lengths, counts, [*c, 40]) for c in itertools.combinations(lengths[:-1], k - 1))
        assert cost(lengths, counts, packing.boundaries(lengths, counts, k)) == best
    assert packing.boundaries([], []) == [] and packing.boundaries([4], [9], 5) == [4]


def test_batches(spark, sf):
    rows = packing.op6_length_buckets(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() == len({r.doc_id for r in rows})
    batches = {}
    for r in rows:
        assert r.padding == r.bucket_length - r.n_words >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for rs in batches.values():
        assert sum(r.bucket_length for r in rs) <= packing.BUDGET or len(rs) == 1
        assert sorted(r.position for r in rs) == list(range(len(rs)))
    for b in {r.bucket for r in rows}:
        assert {k for x, k in batches if x == b} == set(range(len({k for x, k in batches if x == b})))


def test_odd_rows(spark):
    rows = packing.pack_documents(documents(spark), budget=1000).collect()
    assert len(rows) == 14 and {r.doc_id: r["size"] for r in rows}[5] == 0
    assert next(r for r in rows if r.doc_id == 8).padding == 0
    assert packing.pack_documents(none(spark)).count() == 0


def plain(lengths, counts, buckets):
    """The least padding by the plain dynamic program."""
    n = len(lengths)
    best = [0] + [None] * n
    for _ in range(buckets):
        best = [0] + [min(best[i] + sum(c * (lengths[j - 1] - x) for x, c in zip(lengths[i:j], counts[i:j], strict=True)) for i in range(j) if best[i] is not None) for j in range(1, n + 1)]
    return best[n]


def test_boundaries_against_the_plain_program():
    import random

    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted(rng.sample(range(30_000), rng.randrange(1, 25)))
        counts = [rng.choice([1, 1, 2, 50, 1000]) for _ in lengths]
        k = rng.randrange(1, 8)
        ends = packing.boundaries(lengths, counts, k)
        assert len(ends) <= k and ends[-1] == lengths[-1] and cost(lengths, counts, ends) == plain(lengths, counts, k)


def test_long_texts_are_not_padded_beyond_the_longest(spark):
    sized = spark.createDataFrame([(i, n) for i, n in enumerate([1, 3, 1025, 1025, 20_001, 20_003])], "doc_id long, size long")
    got = {r["size"]: r.bucket_length for r in packing.packed(sized, 4).collect()}
    assert got[20_003] == 20_003 and got[1025] == 1025


def test_query_by_brute_force(spark, sf):
    """Total padding is the least there is, and every batch holds as many rows as its budget has room for, but a bucket's last."""
    rows = packing.op6_length_buckets(spark, sf).collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_words for r in rows} == words
    lengths = sorted(set(words.values()))
    assert sum(r.padding for r in rows) == plain(lengths, [list(words.values()).count(x) for x in lengths], packing.BUCKETS)
    for b in {r.bucket for r in rows}:
        own = [r for r in rows if r.bucket == b]
        assert own[0].bucket_length == max(1, max(r.n_words for r in own))
        room = max(1, packing.BUDGET // own[0].bucket_length)
        assert all(sum(r.batch == k for r in own) == room for k in range(max(r.batch for r in own)))
