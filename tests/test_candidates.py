import collections
import itertools
import random

import pytest

from casebench.operators import candidates

SCHEMA = "entry long, file string, keys array<string>"


def brute(rows, k):
    rows = [(e, f or "", set(x for x in keys or [] if x is not None)) for e, f, keys in rows if e is not None]
    df = collections.Counter(x for _, _, keys in rows for x in keys)
    out = []
    for (a, fa, ka), (b, fb, kb) in itertools.combinations(sorted(rows, key=lambda r: r[0]), 2):
        both = ka & kb
        if fa != fb and both:
            out.append((-sum(len(rows) // df[x] for x in both), a, b, len(both)))
    return [(a, b, -s, n) for s, a, b, n in sorted(out)[:k]]


def found(df):
    return [tuple(r)[:4] for r in df.orderBy(df.score.desc(), "a", "b").collect()]


@pytest.mark.parametrize("k", [1, 5, 32])
def test_best_pairs_against_all_pairs(spark, k):
    rng = random.Random(k)
    rows = [(i, rng.choice(["f", "g", "h", None]), [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(0, 20))]) for i in range(250)]
    rows += [(1000 + i, rng.choice("fg"), ["twin", "pair", "w1"]) for i in range(60)] + [(2000, "f", ["only"]), (2001, "g", None), (None, "g", ["w1"]), (2002, "g", [None, "w1"])]
    assert found(candidates.best_pairs(spark.createDataFrame(rows, SCHEMA), k)) == brute(rows, k)


def test_twins_of_one_file_and_of_many(spark):
    rows = [(i, "f", ["a", "b"]) for i in range(80)] + [(100 + i, f"g{i}", ["a", "b"]) for i in range(80)]
    assert found(candidates.best_pairs(spark.createDataFrame(rows, SCHEMA), 32)) == brute(rows, 32)
    rows = [(i, f"g{i % 2}", ["a"]) for i in range(200)]
    assert found(candidates.best_pairs(spark.createDataFrame(rows, SCHEMA), 32)) == brute(rows, 32)


def test_nothing_shared(spark):
    assert candidates.best_pairs(spark.createDataFrame([(1, "f", ["a"]), (2, "f", ["a"]), (3, "g", ["b"])], SCHEMA)).count() == 0
    assert candidates.best_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_budgets_without_repeats(spark):
    rows = spark.createDataFrame([(i, f"f{i}", ["x", f"y{i // 2}"]) for i in range(20)], SCHEMA)
    other = spark.createDataFrame([(i, f"f{i}", [f"y{i // 2}", f"z{i % 3}"]) for i in range(20)], SCHEMA)
    got = candidates.candidate_pairs(rows, other, 10, 4).collect()
    first, rest = ([(r.a, r.b) for r in got if r.found_by == kind] for kind in ("keywords", "discovery"))
    assert len(first) == 10 and len(rest) == 4 and not set(first) & set(rest) and first == [(2 * i, 2 * i + 1) for i in range(10)]
